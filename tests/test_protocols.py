"""Folds, origins, blocks and permutations: what is trained on what, and that every fold and feature is used."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradewright.operators import learning as L

FEATURES = ["signal", "weak", "noise"]
START = dt.date(2001, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    draw, rows = random.Random(11), []
    for i in range(1600):
        x = draw.gauss(0, 1)
        rows.append((i % 160, START + dt.timedelta(days=30 * (i // 160)), int(x + draw.gauss(0, 0.6) > 0), x, x + draw.gauss(0, 3), draw.gauss(0, 1)))
    return spark.createDataFrame(rows, "customer long, day date, y int, signal double, weak double, noise double").cache()


def test_origins_by_hand(panel):
    days = sorted(r.day for r in panel.select("day").collect())
    n, step = len(days), int(len(days) * 0.15)
    want = [(days[i], days[i + step - 1] if i + step < n else days[-1]) for i in range(int(n * 0.4), n, step) if i + 120 <= n][:4]
    assert L.origins(panel, "day") == want and len(want) == 4
    assert L.origins(panel.limit(519), "day") == []


def test_walk_forward(panel):
    rows = {r.fold: r for r in L.walk_forward(panel, FEATURES, "day", 30).collect()}
    for i, (cut, end) in enumerate(L.origins(panel, "day"), 1):
        r, all_rows = rows[str(i)], panel.collect()
        assert r.cut == cut and r.train_rows == sum(x.day + dt.timedelta(days=30) <= cut for x in all_rows)
        assert r.rows == sum(cut < x.day <= end for x in all_rows) and r.kept == (r.train_rows >= 400 and r.rows >= 40 and 0 < r.positives < r.rows)
        assert (r.auc is not None) == r.kept
    kept = [r for f, r in rows.items() if f != "pooled" and r.kept]
    assert kept and rows["pooled"].rows == sum(r.rows for r in kept) and rows["pooled"].auc > 0.85
    assert L.walk_forward(panel.limit(100), FEATURES, "day", 30).count() == 0


def test_group_folds_cover_every_entity_once(panel):
    rows = {r.fold: r for r in L.group_k_fold(panel, FEATURES, "customer").collect()}
    assert set(rows) == {"0", "1", "2", "3", "4", "mean"} and rows["mean"].rows == panel.count()
    assert rows["mean"].auc == pytest.approx(sum(rows[str(i)].auc for i in range(5)) / 5, abs=1e-6)
    sizes = {str(r.fold): r for r in L.fold_sizes(panel, "customer", 5).collect()}
    assert all(sizes[f].rows == rows[f].rows and sizes[f].positives == rows[f].positives for f in sizes)


def test_later_blocks_weigh_double(panel):
    rows = {r.block: r for r in L.weighted_blocks(panel, FEATURES, "day", 30).collect()}
    parts = [r for b, r in rows.items() if b != "weighted"]
    assert {r.weight for r in parts} <= {1.0, 2.0, 4.0, 8.0} and len(parts) >= 3
    assert rows["weighted"].auc == pytest.approx(sum(r.auc * r.weight for r in parts) / sum(r.weight for r in parts), abs=1e-5)


def test_permuted_rows(panel):
    """In each repeat one feature's values stand in another order, and nothing else moves."""
    n, out = panel.count(), L.permuted(panel, FEATURES, ["customer", "day"], 3).collect()
    assert len(out) == n * 3 * len(FEATURES)
    own = {(r.signal, r.weak, r.noise): r.y for r in panel.collect()}
    for f in FEATURES:
        for k in range(3):
            part = [r for r in out if r.feature == f and r["repeat"] == k]
            assert sorted(r[f] for r in part) == sorted(x[FEATURES.index(f)] for x in own)
            others = [g for g in FEATURES if g != f]
            assert sorted((*(r[g] for g in others), r.y) for r in part) == sorted((*(x[FEATURES.index(g)] for g in others), y) for x, y in own.items())
            assert sum((r.signal, r.weak, r.noise) in own for r in part) < n / 20
    orders = {k: [r.signal for r in out if r.feature == "signal" and r["repeat"] == k] for k in range(3)}
    assert orders[0] != orders[1]


def test_permutation_importance(panel):
    got = {r.feature: r for r in L.permutation_importance(panel, FEATURES, "day", 30).collect()}
    assert set(got) == set(FEATURES) and all(r.repeats == 5 for r in got.values())
    assert got["signal"].auc_drop > 0.2 and abs(got["noise"].auc_drop) < 0.05


def test_leak_audit_uses_all_folds_and_finds_memorised_entities(spark):
    """A feature that is the entity's own number tells its class to a model that saw the entity."""
    draw, rows = random.Random(3), []
    for e in range(40):
        y = draw.randint(0, 1)
        for j in range(20):
            rows.append((e, START + dt.timedelta(days=j), y, draw.gauss(0, 1), *[float(e == k) for k in range(39)]))
    names = ["noise", *[f"is_{k}" for k in range(39)]]
    df = spark.createDataFrame(rows, "customer long, day date, y int, " + ", ".join(f"{n} double" for n in names))
    got = {r.variant: r for r in L.leak_audit(df, names, "customer", 4).collect()}
    assert all(r.folds == 4 and r.rows == 800 for r in got.values())
    assert got["row_split"].auc > 0.95 and got["entity_split"].auc < 0.7
    assert got["without_noise"].features == len(names) - 1


def test_segments_have_eight_resamples(tables):
    from tradewright.operators import panels as P
    from tradewright.operators import star
    p = P.customer_profiles(tables.sales, tables.customers, star.mart_demand_customer_product(tables.sales_lines))
    got = L.segment_quality(p, P.PROFILE_FEATURES, ks=(3,)).first()
    assert got.k == 3 and -1 <= got.silhouette <= 1 and -1 <= got.stability <= 1
    assert p.filter(F.col("revenue") < 0).count() == 0
