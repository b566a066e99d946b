"""Versions of decisions, refused models, interrupted publications and findings from served scores."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradewright.operators import actions as A
from tradewright.operators import serving as S

SCORE = "entity string, customer string, probability double, amount double, stake double"


def trained(spark, model, metric, reference, rows=(), **more):
    decision, ok = S.decide(spark, model, "candidate", "metric", metric, "reference", reference, more.pop("min_gain", 0.02), **more)
    return S.Trained(decision, spark.createDataFrame(list(rows), SCORE) if ok else None)


def test_two_runs_give_two_versions(spark, tmp_path):
    folder = str(tmp_path)
    assert S.history(spark, folder).count() == 0 and S.served(spark, folder, "churn") is None
    S.publish(spark, folder, "a", [trained(spark, "churn", 0.80, 0.70, [("1", "1", 0.9, 10.0, 9.0)]), trained(spark, "wape", 20.0, 30.0, min_gain=2.0, higher_is_better=False)])
    S.publish(spark, folder, "b", [trained(spark, "churn", 0.79, 0.70, [("2", "2", 0.8, 10.0, 8.0)]), trained(spark, "wape", 23.0, 30.0, min_gain=2.0, higher_is_better=False)])
    assert sorted((r.model, r.version) for r in S.history(spark, folder).collect()) == [("churn", "a"), ("churn", "b"), ("wape", "a"), ("wape", "b")]
    now = {r.model: r for r in S.state(spark, folder).collect()}
    assert all(r.version == "b" and r.deployed for r in now.values())
    assert not now["churn"].degraded and now["wape"].degraded and now["wape"].change == pytest.approx(0.15)
    assert [r.entity for r in S.served(spark, folder, "churn").collect()] == ["2"]
    with pytest.raises(ValueError, match="published already"):
        S.publish(spark, folder, "b", [trained(spark, "churn", 0.9, 0.7)])


def test_a_refused_model_is_not_served(spark, tmp_path):
    folder = str(tmp_path)
    S.publish(spark, folder, "a", [trained(spark, "churn", 0.80, 0.70, [("1", "1", 0.9, 10.0, 9.0)])])
    S.publish(spark, folder, "b", [trained(spark, "churn", 0.71, 0.70), trained(spark, "margin", None, 0.7)])
    assert S.served(spark, folder, "churn") is None and S.served(spark, folder, "margin") is None and S.served(spark, folder, "unknown") is None
    now = {r.model: r for r in S.state(spark, folder).collect()}
    assert (now["churn"].reason, now["margin"].reason, now["churn"].degraded) == ("gain below the threshold", "not measurable", True)
    assert S.model_findings({m: S.served(spark, folder, m) for m in ("churn", "margin")}, spark.createDataFrame([(1, "x")], "customer long, customer_name string"), F.lit("low")) == []


def test_an_interrupted_publication_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path)
    S.publish(spark, folder, "a", [trained(spark, "churn", 0.80, 0.70, [("1", "1", 0.9, 10.0, 9.0)])])
    bad = trained(spark, "churn", 0.85, 0.70, [("2", "2", 0.9, 10.0, 9.0)])
    broken = S.Trained(bad.decision, bad.scores.withColumn("stake", F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        S.publish(spark, folder, "b", [broken])
    assert S.state(spark, folder).first().version == "a" and S.served(spark, folder, "churn").first().entity == "1"
    S.publish(spark, folder, "b", [bad])                                  # tried again
    assert S.served(spark, folder, "churn").first().entity == "2"


def test_top_movements(spark):
    rows = [(str(i), str(i), None, float(100 - i), float(100 - i)) for i in range(20)]
    rows[9] = ("9", "9", None, 91.0, 1.0)                                 # leaves
    rows[15] = ("15", "15", None, 85.0, 500.0)                            # comes in
    rows += [("z", "z", None, None, None)]
    got = {r.customer: r for r in S.top_movements(spark.createDataFrame(rows, SCORE)).collect()}
    assert {c: r.movement for c, r in got.items() if r.movement != "stays"} == {"9": "out", "15": "in"}
    assert len(got) == 11 and got["15"].expected_rank == 1 and got["15"].observed_rank is None and got["0"].observed_rank == 1


def test_findings_come_from_served_scores(spark):
    score = lambda rows: spark.createDataFrame(rows, SCORE)
    tables = {"churn": score([("1", "1", 0.9, 100.0, 90.0), ("2", "2", 0.4, 900.0, 360.0)]), "margin": score([(str(i), str(i), 0.3, 10.0, float(i)) for i in range(1, 21)]),
              "quotes": score([("Q1", "1", 0.5, 40.0, 20.0), ("Q2", "1", 0.5, 20.0, 10.0)]), "revenue": score([(str(i), str(i), None, float(i), float(i if i != 20 else 0)) for i in range(1, 21)])}
    names = spark.createDataFrame([(i, f"name {i}") for i in range(1, 21)], "customer long, customer_name string")
    all_of = A.all_findings(S.model_findings(tables, names, A.stake_severity(F.lit(1000.0))))
    heads = {r.title: r for r in all_of.heads.collect()}
    assert (heads["customers likely to leave"].amount, heads["customers likely to leave"].n_targets, heads["customers likely to leave"].severity) == (90.0, 1, "high")
    assert (heads["margin erosion expected"].amount, heads["margin erosion expected"].n_targets) == (float(sum(range(6, 21))), 15)
    assert (heads["open quotes to follow up"].amount, heads["open quotes to follow up"].n_targets) == (30.0, 2)
    assert (heads["movements in the top ten"].severity, heads["movements in the top ten"].amount, heads["movements in the top ten"].n_targets) == ("medium", 10.0, 2)
    targets = {(r.title, r.code, r.name) for r in all_of.targets.collect()}
    assert ("movements in the top ten", "20", "name 20") in targets and ("open quotes to follow up", "Q2", "name 1") in targets and ("customers likely to leave", "2", "name 2") not in targets


def test_training_decides_by_the_part_after_the_cut(spark):
    draw, rows = random.Random(2), []
    for i in range(1200):
        a, b = draw.gauss(0, 1), draw.gauss(0, 1)
        rows.append((i % 100, dt.date(2001, 1, 1) + dt.timedelta(days=30 * (i // 100)), int(a + b + draw.gauss(0, 0.4) > 0), a, b, 10.0))
    panel = spark.createDataFrame(rows, "customer long, day date, y int, a double, b double, worth double")
    now = S.latest(panel, "customer", "day")
    assert now.count() == 100
    both = S.train_classifier("two", panel, now, ["a", "b"], {"a": 1, "b": 1}, "day", 30, "customer", F.col("worth"))
    d = both.decision.first()
    assert d.deployed and d.metric > 0.9 and d.gain > 0.05 and both.scores.count() == 100
    assert all(r.stake == pytest.approx(r.probability * 10) for r in both.scores.collect())
    alone = S.train_classifier("one", panel, now, ["a"], {"a": 1, "b": 1}, "day", 30, "customer", F.col("worth"))
    assert not alone.decision.first().deployed and alone.scores is None
    one_class = S.train_classifier("none", panel.withColumn("y", F.lit(0)), now, ["a"], {"a": 1}, "day", 30, "customer", F.col("worth"))
    assert one_class.decision.first().reason == "not measurable" and one_class.scores is None


def test_revenue_must_also_rank(spark):
    draw, rows = random.Random(4), []
    for i in range(1200):
        level = 10.0 ** (1 + (i % 100) / 25)
        rows.append((i % 100, dt.date(2001, 1, 1) + dt.timedelta(days=30 * (i // 100)), level * draw.uniform(0.9, 1.1), float((i % 100) / 25), draw.gauss(0, 1), level * 3))
    panel = spark.createDataFrame(rows, "customer long, day date, sold double, log_level double, noise double, before double")
    now = S.latest(panel, "customer", "day")
    good = S.train_revenue("revenue", panel, now, ["log_level"], "day", 30, "sold", "before")
    assert good.decision.first().deployed and good.scores.count() == 100 and good.scores.filter("probability is not null or stake < 0").count() == 0
    flat = S.train_revenue("revenue", panel, now, ["noise"], "day", 30, "sold", "before")
    assert flat.scores is None and flat.decision.first().reason in ("gain below the threshold", "does not rank the customers")
    lucky = S.train_revenue("revenue", panel.withColumn("before", F.lit(1e9)), now.withColumn("before", F.lit(1e9)), ["noise"], "day", 30, "sold", "before")
    assert lucky.scores is None and lucky.decision.first().reason == "does not rank the customers"
    assert S.train_revenue("revenue", panel.where("false"), now, ["noise"], "day", 30, "sold", "before").decision.first().reason == "not measurable"
