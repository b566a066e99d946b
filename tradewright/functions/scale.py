"""Building blocks that keep every task bounded.

Global orderings (running sums over all entities, ranks, exact quantiles) never use an
unpartitioned window over the data: values are first collapsed to one row per distinct
value, range-bucketed with `Bucketizer`, and only the bucket totals (a few hundred rows)
pass through a single ordered window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.session import cut_lineage

BUCKETS = 200


def scalar(df: DataFrame) -> Column:
    """A one-row, one-column frame as an uncorrelated scalar subquery."""
    return df.scalar()


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the tasks of a shuffle, for long work on each row: a file of one row group is one task otherwise."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def top_k_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
              rank: str = "rank") -> DataFrame:
    """Top k rows per key; the group limit is pushed before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def range_buckets(df: DataFrame, value: str, out: str = "_bucket", buckets: int = BUCKETS) -> DataFrame:
    """Monotone bucket number of a double column from approximate quantiles (bounded list)."""
    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.stat.approxQuantile(value, probs, 0.25 / buckets)))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=out).transform(df)


def running_totals(df: DataFrame, value: str, measures: Sequence[str], descending: bool = False) -> DataFrame:
    """Exclusive running totals of `measures` over rows ordered by a *distinct* numeric `value`.

    Adds `<m>_before` and `<m>_total`. Each window partition is one range bucket. The rows are checkpointed
    first, because they are read for the bucket bounds, the totals and the ranks.
    """
    b = range_buckets(cut_lineage(df).withColumn("_v", F.col(value).cast("double")), "_v")
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    inner_order = F.col("_v").desc() if descending else F.col("_v").asc()
    per_bucket = b.groupBy("_bucket").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = per_bucket.select("_bucket", *[
        c for m in measures for c in (
            F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_off"),
            F.sum(f"_{m}").over(whole).alias(f"{m}_total"))])
    local = Window.partitionBy("_bucket").orderBy(inner_order).rowsBetween(Window.unboundedPreceding, -1)
    out = b.join(F.broadcast(offsets), "_bucket")       # at most BUCKETS rows
    for m in measures:
        out = out.withColumn(f"{m}_before", F.col(f"_{m}_off") + F.coalesce(F.sum(m).over(local), F.lit(0)))
    return out.drop("_bucket", "_v", *[f"_{m}_off" for m in measures])


def distinct_values(df: DataFrame, value: str, keys: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (keys, value) with its frequency: ties, however many, become arithmetic."""
    return df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *extra)


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values of a column with the average rank of their ties."""
    ranked = running_totals(distinct_values(df.filter(F.col(value).isNotNull()), value), value, ["n"])
    return ranked.select(value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of one column, one row per probability.

    Works on the ranked distinct values, so no task ever holds the column.
    """
    ranked = running_totals(distinct_values(df.filter(F.col(value).isNotNull()), value), value, ["n"])
    wanted = df.sparkSession.createDataFrame([(float(p),) for p in probs], "_prob double")
    pos = F.col("_prob") * (F.col("n_total") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    inside = lambda k: (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))
    # a handful of probabilities, attached to every distinct value without a join
    exploded = ranked.withColumn("_prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    hits = exploded.filter(inside(lo) | inside(hi)).groupBy("_prob").agg(
        F.max(F.when(inside(lo), F.col(value))).alias("vlo"),
        F.max(F.when(inside(hi), F.col(value))).alias("vhi"),
        F.max(pos - lo).alias("frac"))
    return wanted.join(hits, "_prob", "left").select(
        F.col("_prob").alias("p"), (F.col("vlo") + (F.col("vhi") - F.col("vlo")) * F.col("frac")).alias("quantile"))


def weighted_median(value: Column | str, freq: Column | str) -> Column:
    """Exact median from (value, frequency) rows."""
    return F.percentile(value, F.lit(0.5), F.col(freq) if isinstance(freq, str) else freq)


def skew_join(left: DataFrame, right: DataFrame, key: str, salt_by: Sequence[str], how: str = "inner",
              salts: int = 16) -> DataFrame:
    """Equi-join for a key one value of which may hold a large share of `left`.

    `right` is repeated `salts` times; use it when `right` is unique (or nearly) per key.
    The salt is a hash of row columns, so a recomputed task sends every row to the same place.
    """
    l = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [key, "_salt"], how).drop("_salt")
