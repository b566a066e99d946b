"""Paired bootstrap beside loops over replicates, and basket scores beside plain dictionaries."""

import datetime as dt
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradewright.functions import bootstrap as B
from tradewright.operators import recommend as Y


def weight(unit, rep):
    code = int(hashlib.md5(str(unit).encode()).hexdigest()[:8], 16) % B.PRIME
    z = (code + rep * B.STEP) % B.PRIME
    z = (z * z + rep) % B.PRIME
    z = (z * z + code) % B.PRIME
    return sum(z / B.PRIME >= x for x in B.CDF)


def test_weights_are_poisson():
    codes = np.array([int(hashlib.md5(str(u).encode()).hexdigest()[:8], 16) % B.PRIME for u in range(3000)])
    w = B.weights(codes, 400)
    assert w[17, 3] == weight(17, 4) and w[2999, 399] == weight(2999, 400)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.15


def test_gap_intervals(spark):
    rng = random.Random(1)
    rows = [(u, rng.random(), rng.random() + 0.2, rng.random() + 1) for u in range(700)]
    got = B.bootstrap_gap(spark.createDataFrame(rows, "u int, a double, b double, base double"), "u", "a", "b", "base", 60).first()
    gaps = []
    for rep in range(1, 61):
        w = [weight(u, rep) for u, *_ in rows]
        gaps.append(100 * sum(x * (r[1] - r[2]) for x, r in zip(w, rows, strict=True)) / sum(x * r[3] for x, r in zip(w, rows, strict=True)))
    assert got.replicates == 60 and got.a_better_pct == 100.0
    assert (got.low, got.median, got.high) == pytest.approx(np.percentile(gaps, [2.5, 50, 97.5]), abs=1e-5)
    nothing = B.bootstrap_gap(spark.createDataFrame(rows[:0], "u int, a double, b double, base double"), "u", "a", "b", "base").first()
    assert nothing.replicates == 0 and nothing.low is None


def auc(rows, score, rep):
    pos, neg = Counter(), Counter()
    for r in rows:
        (pos if r["y"] else neg)[r[score]] += weight(r["u"], rep)
    won = sum(x * y * (1 if p > q else 0.5 if p == q else 0) for p, x in pos.items() for q, y in neg.items())
    return won / (sum(pos.values()) * sum(neg.values()))


def test_auc_gap_with_most_rows_at_one_score(spark):
    rng = random.Random(4)
    rows = [{"u": rng.randint(1, 300), "y": int(rng.random() < 0.3), "p": 0.5 if rng.random() < 0.6 else round(rng.random(), 2), "q": round(rng.random(), 3)} for _ in range(2500)]
    df = spark.createDataFrame([(r["u"], r["y"], r["p"], r["q"]) for r in rows], "u int, y int, p double, q double").repartition(5)
    got = {(r.side, r.rep): r.auc for r in B.replicate_aucs(df, "u", ["p", "q"], 12).collect()}
    assert len(got) == 24
    for (side, rep), value in got.items():
        assert value == pytest.approx(auc(rows, side, rep), abs=1e-9)
    gap = B.bootstrap_auc_gap(df, "u", "p", "q", 12).first()
    assert gap.replicates == 12 and gap.median == pytest.approx(np.median([got["p", i] - got["q", i] for i in range(1, 13)]), abs=1e-5)
    assert B.bootstrap_auc_gap(df.where("y = 1"), "u", "p", "q").first().replicates == 0


@pytest.fixture(scope="module")
def purchases(spark):
    rng = random.Random(9)
    day = lambda: dt.date(2000, 1, 1) + dt.timedelta(days=rng.randint(0, 500))
    rows = {(c, int(rng.paretovariate(0.6)) % 900, day()) for c in range(130) for _ in range(rng.randint(1, 14))} | {(500, i, day()) for i in range(700)}
    rows |= {(600, 899, dt.date(2000, 1, 2)), (601, 5, dt.date(2001, 3, 1))}
    return [(c, i, d, 10.0, "F", "t") for c, i, d in sorted(rows)]


def test_basket_scores_reach_the_whole_catalogue(spark, purchases):
    cut = dt.date(2001, 3, 31)
    df = spark.createDataFrame(purchases, "customer long, item long, date date, amount double, family string, type string")
    past, last = [r for r in purchases if r[2] <= cut], [r for r in purchases if dt.date(2000, 3, 31) < r[2] <= cut]
    shelf, active = {r[1] for r in last}, {r[0] for r in last}
    own = {}
    for c, i, *_ in past:
        if i in shelf:
            own.setdefault(c, set()).add(i)
    held, both = Counter(i for s in own.values() for i in s), Counter()
    for s in own.values():
        both.update((i, j) for i in s for j in s if i != j)
    sim = {(i, j): n / math.sqrt(held[i] * held[j]) for (i, j), n in both.items()}
    want = {}
    for c in active:
        for j in shelf - own[c]:
            values = [sim.get((i, j), 0.0) for i in own[c]]
            want[c, j] = (sum(values), max(values, default=0.0))
    at = F.lit(cut)
    got = {(r.customer, r.item): (r.knn_sum, r.knn_max) for r in Y.knn_candidates(df, at).collect()}
    assert got.keys() == want.keys() and any(v == (0.0, 0.0) for v in want.values()) and len(shelf) > Y.TILE
    for key, value in want.items():
        assert got[key] == pytest.approx(value, abs=1e-9)
    buyers = Counter(i for c, i in {(r[0], r[1]) for r in last})
    for c in (0, 500, 601):
        best = sorted(((-round(want[c, j][0] + 1e-3 * math.log1p(buyers[j]), 9), j) for k, j in want if k == c))[:10]
        rows = Y.knn_lists(df, at).where(F.col("customer") == c).orderBy("rank").collect()
        assert [r.item for r in rows] == [j for _, j in best]
    adopted = spark.createDataFrame([(c, j) for c, j in list(sorted(want))[::97]], "customer long, item long")
    dealt = Y.dealt_negatives(df, at, Y.catalogue(df, at), adopted, 3).collect()
    per = Counter(r.customer for r in adopted.collect())
    assert Counter(r.customer for r in dealt) == {c: min(3 * n, sum(1 for k, _ in want if k == c) - n) for c, n in per.items() if min(3 * n, sum(1 for k, _ in want if k == c) - n)}
    assert all((r.customer, r.item) in want for r in dealt) and not {(r.customer, r.item) for r in dealt} & {(r.customer, r.item) for r in adopted.collect()}


def test_pairs_are_counted_where_the_item_is(spark, purchases, monkeypatch):
    """No shuffle holds a row for a pair, and an item's neighbours are merged in bounded runs."""
    df = spark.createDataFrame(purchases, "customer long, item long, date date, amount double, family string, type string")
    plan = Y.similar_items(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" in plan and "hashpartitioning(item#" in plan and not [x for x in plan.splitlines() if "Exchange" in x and "other" in x]
    full, few = Y.item_similarity(df).count(), Y.item_similarity(df, 3).count()
    assert few < full
    rows = [(i, 3, [i, 7, 8, 100 + b], [3, 2, 2, 1]) for i in (1, 2) for b in range(3)]
    batches = [pd.DataFrame(rows[a:a + 2], columns=["item", "size", "others", "sizes"]) for a in range(0, 6, 2)]
    for bound in (1, 5, 1000):
        monkeypatch.setattr(Y, "PAIRS", bound)
        got = [(i, s, o.tolist(), z.tolist(), n.tolist()) for i, s, o, z, n in Y._neighbours(iter(batches))]
        assert got == [(i, 3, [7, 8, 100, 101, 102], [2, 2, 1, 1, 1], [3, 3, 1, 1, 1]) for i in (1, 2)]


def test_scores_do_not_depend_on_blocks_tiles_or_runs(spark, purchases, monkeypatch):
    at = F.lit(dt.date(2001, 3, 31))
    df = spark.createDataFrame(purchases, "customer long, item long, date date, amount double, family string, type string")
    lists = lambda: {(r.customer, r.rank): (r.item, round(r.score, 9)) for r in Y.knn_lists(df, at).collect()}
    whole = lists()
    for name, value in {"USERS": 40, "TILE": 64, "TILES": 7}.items():
        monkeypatch.setattr(Y, name, value)
    assert lists() == whole
    left = pd.DataFrame({"item": [-1, 0, 2], "size": [0, 4, 2], "others": [[0, 1, 2], [1, 2], [0, 1]], "n": [[4, 3, 2], [2, 1], [1, 2]], "bonus": [[0.3, 0.2, 0.1], None, None]})
    right = pd.DataFrame({"tile": 0, "customer": range(5), "items": [[0], [2], [0, 2], [], [9]], "wanted": [[]] * 5})
    want = Y._tile_scores(None, False, 4)(left, right)
    assert want.loc[(want.customer == 0) & (want.place == 1), "knn_sum"].tolist() == [2 / math.sqrt(12)]
    monkeypatch.setattr(Y, "CELLS", 5)
    pd.testing.assert_frame_equal(Y._tile_scores(None, False, 4)(left, right), want)


def test_unseen_items_of_equal_popularity_are_not_all_listed():
    left = pd.DataFrame({"item": [-1, 3], "size": [0, 2], "others": [list(range(200)), [150]], "n": [[2] * 200, [1]], "bonus": [[0.2] * 50 + [0.1] * 150, None]})
    right = pd.DataFrame({"tile": 0, "customer": [1, 2], "items": [[3], [0, 60]], "wanted": [[], []]})
    got = Y._tile_scores(60, False, 200)(left, right)
    places = {c: set(g.place) for c, g in got.groupby("customer")}
    assert places[1] == set(range(50)) - {3} | {150} | set(range(50, 110)) and places[2] == set(range(1, 50)) | set(range(50, 111)) - {60}


def test_weights_without_division():
    """a weight took three divisions of 64 bits and a search for each row and replicate; the weights are the same numbers."""
    import time

    import numpy as np

    from tradewright.functions import bootstrap as B

    def plain(codes, replicates):
        code, rep = codes.astype(np.int64)[:, None], np.arange(1, replicates + 1, dtype=np.int64)[None, :]
        z = (code + rep * B.STEP) % B.PRIME
        z = (z * z + rep) % B.PRIME
        z = (z * z + code) % B.PRIME
        return np.searchsorted(np.array(B.CDF), z / B.PRIME, side="right").astype(np.float64)
    deal = np.random.default_rng(3)
    codes = np.r_[0, 1, B.PRIME - 1, B.PRIME - B.STEP, deal.integers(0, B.PRIME, 700)]
    assert np.array_equal(B.weights(codes, 2000), plain(codes, 2000)) and B.weights(codes[:0], 5).shape == (0, 5)
    for bound, least in zip(B.CDF, B.BOUNDS, strict=True):
        assert least / B.PRIME >= bound > (least - 1) / B.PRIME
    spent = {f: min(_timed(time, f, codes) for _ in range(3)) for f in (B.weights, plain)}
    assert spent[B.weights] < 0.7 * spent[plain]


def _timed(time, f, codes):
    start = time.perf_counter()
    f(codes, 2000)
    return time.perf_counter() - start


def test_a_shared_score_is_dealt_over_tasks(spark):
    """all rows of one score were read by one task."""
    from pyspark.sql import functions as F

    from tradewright.functions import bootstrap as B
    df = spark.range(4000).select(F.col("id").alias("u"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.when(F.col("id") % 10 < 9, 0.5).otherwise(F.col("id") / 4000.0).alias("a"))
    got = {r.rep: r.auc for r in B.replicate_aucs(df, "u", ["a"], 3).collect()}
    rows = df.select("y", "a", B.unit_code(F.col("u")).alias("code")).toPandas()
    w = B.weights(rows["code"].to_numpy(), 3)
    for rep in range(3):
        pos, neg = rows["y"].to_numpy() == 1, rows["y"].to_numpy() == 0
        a, b = rows["a"].to_numpy()[pos][:, None], rows["a"].to_numpy()[neg][None, :]
        won = (w[pos, rep][:, None] * w[neg, rep][None, :] * ((a > b) + (a == b) / 2)).sum()
        assert abs(got[rep + 1] - won / (w[pos, rep].sum() * w[neg, rep].sum())) < 1e-12
    plan = B.replicate_aucs(df, "u", ["a"], 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [side" in plan and "code" in plan.split("RepartitionByExpression")[1].split("\n")[0]
