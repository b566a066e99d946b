"""Similarity sums by a walk over baskets against every pair of customer and item."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tradewright.operators import recommend as Y
from tradewright.operators import walk

CUT = dt.date(2001, 3, 31)


def purchases(spark, seed=4, customers=60, items=90):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        for _ in range(rng.randint(1, 7)):
            rows.append((c, f"i{min(rng.randint(0, items), rng.randint(0, items)):03d}", rng.choice([dt.date(2000, 1, 5), dt.date(2000, 12, 1), dt.date(2001, 3, 31)])))
    rows += [(None, "i005", dt.date(2001, 1, 1)), (900, "lone", dt.date(2001, 1, 1)), (901, "old", dt.date(1999, 1, 1))]
    return rows, spark.createDataFrame(rows, "customer long, item string, date date")


def brute(rows):
    """(customer, item): (sum, maximum) of unseen catalogue items, and the buyers of the last year."""
    year = [r for r in rows if r[2] > dt.date(2000, 3, 31)]
    buyers = {}
    for c, i, _ in year:
        buyers.setdefault(i, set()).add(c)
    own, owners = {}, {}
    for c, i, _ in rows:
        if i in buyers:
            own.setdefault(c, set()).add(i)
            owners.setdefault(i, set()).add(c)
    out = {}
    for c in {r[0] for r in year}:
        basket = own[c] if c is not None else set()
        for j in set(buyers) - basket:
            near = [len((owners[i] & owners[j]) - {None}) / math.sqrt(len(owners[i]) * len(owners[j])) for i in basket]
            out[c, j] = (sum(near), max(near, default=0.0))
    return out, {i: len(b) for i, b in buyers.items()}


def test_walk_gives_every_unseen_item(spark, monkeypatch):
    monkeypatch.setattr(walk, "PIECE", 20)
    rows, df = purchases(spark)
    want, _ = brute(rows)
    items = Y.catalogue(df, F.lit(CUT))
    for walked in (True, False):
        got = Y.basket_scores(df, F.lit(CUT), items, walk=walked).collect()
        assert len(got) == len(want) and {(r.customer, r.item) for r in got} == set(want)
        for r in got:
            assert (r.knn_sum, r.knn_max) == pytest.approx(want[r.customer, r.item], abs=1e-12)


def test_walk_gives_the_best_and_the_asked(spark, monkeypatch):
    monkeypatch.setattr(walk, "PIECE", 20)
    rows, df = purchases(spark, 9)
    want, buyers = brute(rows)
    score = {key: round(s + 1e-3 * math.log1p(buyers[key[1]]), 9) for key, (s, _) in want.items()}
    items = Y.catalogue(df, F.lit(CUT))
    for k in (10,):
        got = {(r.customer, r.item): r.knn_sum for r in Y.basket_scores(df, F.lit(CUT), items, k, walk=True).collect()}
        for c in {c for c, _ in want}:
            best = sorted((-s, i) for (x, i), s in score.items() if x == c)[:k]
            assert all(got[c, i] == pytest.approx(want[c, i][0], abs=1e-12) for _, i in best)
    pairs = sorted((c, i) for c, i in want if c is not None)[::7]
    got = Y.basket_scores(df, F.lit(CUT), items, pairs=spark.createDataFrame(pairs, "customer long, item string"), walk=True).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.knn_sum, r.knn_max) == pytest.approx(want[r.customer, r.item], abs=1e-12)


def test_lists_of_a_wide_catalogue_make_no_cell_for_every_item(spark, monkeypatch):
    """Customers with few neighbours and many items are walked, not met with the whole catalogue."""
    rows = [(c, c * 10 + j, dt.date(2001, 1, 1)) for c in range(400) for j in range(11)]
    df = spark.createDataFrame(rows, "customer long, item long, date date")
    monkeypatch.setattr(Y, "_tile_scores", None)
    got = Y.knn_lists(df, F.lit(CUT), 5).collect()
    assert len(got) == 400 * 5
    first = {r.customer: r.item for r in got if r["rank"] == 1}
    assert first[7] == 61 and first[0] == 11                # the least of those that one neighbour alone owns


def test_listings_leave_in_small_batches_and_heavy_customers_are_worked_on_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    rows = [sorted(rng.choice(40, size=rng.integers(1, 12), replace=False).tolist()) for _ in range(50)]
    users = [[u for u, b in enumerate(rows) if i in b] for i in range(40)]

    monkeypatch.setattr(walk, "ROWS", 100)

    def scores(step):
        monkeypatch.setattr(walk, "STEP", step)
        n = len(rows)
        none = lambda kind, m=n: pa.nulls(m, pa.list_(kind))
        names = ["at", "customer", "items", "sizes", "users", "bonus", "names"]
        shelf = [pa.array([-2]), pa.nulls(1, pa.int64()), none(pa.int32(), 1), pa.array([[len(x) for x in users]], pa.list_(pa.int32())), none(pa.int32(), 1), pa.array([[0.1] * 40]), pa.array([list(range(40))])]
        asks = [pa.array([-1] * n), pa.array(range(n)), pa.array(rows, pa.list_(pa.int32())), none(pa.int32()), none(pa.int32()), none(pa.float64()), none(pa.int64())]
        tile = [pa.array([0]), pa.nulls(1, pa.int64()), pa.array([list(range(40))], pa.list_(pa.int32())), pa.array([[len(x) for x in users]], pa.list_(pa.int32())),
                pa.array([[u for x in users for u in x]], pa.list_(pa.int32())), none(pa.float64(), 1), none(pa.int64(), 1)]
        out = list(walk._walked(None, True, [0, 40])(iter([pa.RecordBatch.from_arrays(x, names) for x in (shelf, asks, tile)])))
        assert max(b.num_rows for b in out) <= 100 + 40
        return {(r["customer"], r["item"]): (r["knn_sum"], r["knn_max"]) for b in out for r in b.to_pylist()}
    whole, parts = scores(1 << 18), scores(1)
    assert set(whole) == set(parts) and len(whole) == 50 * 40 - sum(map(len, rows))
    assert all(parts[key] == pytest.approx(value, abs=1e-12) for key, value in whole.items())
