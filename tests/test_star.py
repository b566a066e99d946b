"""Deduplication and dimensions of the star schema on rows with nulls, ties and very many copies."""

import random

from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import star


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_copy_matches_a_plain_loop_and_moves_no_single_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, i]), rng.choice([None, "", "a", "b", f"x{i}"]), rng.choice([None, 0.0, -0.0, 1.5]), f"t{i % 7}") for i in range(300)]
    rows += rows[:40]
    want = {}
    for r in rows:
        k = (r[1], None if r[2] is None else r[2] + 0.0)
        low = tuple((x is not None, x) for x in (r[0], *r))
        if k not in want or low < want[k][0]:
            want[k] = (low, r)
    df = spark.createDataFrame(rows, "id int, k string, v double, t string")
    got = star.first_copy(df, [F.col("k"), F.col("v")], "id")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(r) for _, r in want.values())
    single = star.first_copy(df.filter("k like 'x%'").dropDuplicates(["k", "v"]), [F.col("k"), F.col("v")], "id")
    assert "min(" not in plan(single)


def test_lines_of_headers_without_copies_are_not_grouped(spark):
    rows = [(i, None if i % 5 == 0 else f"d{i % 40}", i % 3) for i in range(600)] + [(1000 + i, "hot", 1) for i in range(500)]
    heads = {f"d{i}": 2 for i in range(10)} | {"hot": 3, "d39": 1}
    df = spark.createDataFrame(rows, "id int, doc string, v int").repartition(5)
    groups = {}
    for i, d, v in sorted(rows):
        groups.setdefault((d, v), []).append(i)
    want = sorted(i for (d, _), ids in groups.items() for i in ids[:-(-len(ids) // heads.get(d, 1))])
    got = star.copies_kept(df, ["doc", "v"], "id", spark.createDataFrame(list(heads.items()), "doc string, copies int"), "doc")
    assert sorted(r.id for r in got.collect()) == want
    assert "Aggregate" not in plan(got) and "Join" not in plan(got)


def test_frames_are_built_when_read(spark):
    built = []
    frames = star.Frames({n: lambda n=n: built.append(n) or spark.range(3) for n in ("a", "b")})
    assert list(frames) == ["a", "b"] and not built
    assert frames["a"].count() == frames.kept()["a"].count() == 3 and built == ["a"]


def test_products_are_chosen_from_counts(spark):
    sold = spark.createDataFrame([("p", "x", "f"), ("p", "y", None), ("p", "y", "g"), ("p", None, "g"), ("q", None, None), ("", "z", "f"), (None, "z", "f")],
                                 "reference string, label string, family string")
    bought = spark.createDataFrame([("p", "lot"), ("r", "b"), ("r", "a"), ("s", None)], "reference string, label string")
    got = sorted(map(tuple, star.product_dimension(sold, bought).collect()))
    assert got == [("p", "y", "g", True, True), ("q", None, None, True, False), ("r", "a", None, False, True), ("s", None, None, False, True)]


def test_calendar_spans_all_columns(spark):
    a = spark.sql("select date'2020-01-03' d, date'1999-01-01' e union all select date'2020-01-05', date'2020-01-06'")
    b = spark.sql("select cast(null as date) d")
    assert [str(r.date) for r in star.calendar(a, b).orderBy("date").collect()] == ["2020-01-03", "2020-01-04", "2020-01-05", "2020-01-06"]


def test_dates_are_tried_only_where_their_separator_stands(spark):
    texts = ["1/2/2024", "2024-01-02", "2024-1-2", "13/2/2024", "2/30/2024", "x", "", None, " 1/2/2024", "1-2/2024", "2024/1/2", "-1/2/2024", "01/02/24", "1900-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(p)) for p in ("M/d/yyyy", "yyyy-M-d", "d/M/yyyy")]).cast("date")
    assert df.filter(~R.robust_date(F.col("t")).eqNullSafe(plain)).count() == 0
    assert "contains(" in plan(df.select(R.robust_date(F.col("t")))).lower()
