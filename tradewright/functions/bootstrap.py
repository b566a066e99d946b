"""Paired bootstrap intervals of the gap between two methods.

A unit's Poisson(1) weight in a replicate follows from a hash of the unit and the replicate's number, so a lost task counts the
same and nothing is drawn on the driver. A task fills a matrix of units by replicates for some hundred rows at a time and keeps
only sums by replicate; rows are never copied for each replicate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.session import ship_package

REPLICATES = 2000
ROWS_AT_ONCE = 500
ROWS_IN_CACHE = 64
PRIME = 2_147_483_647
STEP = 1_103_515_245
#: Poisson(1) distribution function at 0, 1, ...
CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def unit_code(unit: Column) -> Column:
    return F.conv(F.substring(F.md5(unit.cast("string")), 1, 8), 16, 10).cast("long") % PRIME


def _least(bound: float) -> int:
    """The smallest whole number whose quotient by `PRIME` reaches the bound, as doubles round it."""
    z = int(bound * PRIME) - 2
    while z / PRIME < bound:
        z += 1
    return z


BOUNDS = tuple(_least(b) for b in CDF)


def _reduce(z: np.ndarray, spare: np.ndarray) -> None:
    """Modulo the prime 2^31 - 1 in place, for 0 <= z < 2^62 + 2^31: high bits are added to low ones, which costs no division."""
    for _ in range(2):
        np.right_shift(z, 31, out=spare)
        np.bitwise_and(z, PRIME, out=z)
        np.add(z, spare, out=z)
    np.multiply(z >= PRIME, PRIME, out=spare)
    np.subtract(z, spare, out=z)


def weights(codes: np.ndarray, replicates: int) -> np.ndarray:
    """(units, replicates) weights: two squarings modulo a prime spread the sum of both numbers."""
    code = codes.astype(np.int64)[:, None] % PRIME
    rep = np.arange(1, replicates + 1, dtype=np.int64)[None, :]
    first, out = rep * STEP % PRIME, np.empty((len(codes), replicates))
    for at in range(0, len(codes), ROWS_IN_CACHE):
        own = code[at:at + ROWS_IN_CACHE]
        z = own + first
        spare = np.empty_like(z)
        np.subtract(z, np.multiply(z >= PRIME, PRIME, out=spare), out=z)
        for plus in (rep, own):
            np.multiply(z, z, out=z)
            np.add(z, plus, out=z)
            _reduce(z, spare)
        small, count = z.astype(np.int32), np.zeros(z.shape, np.int8)
        for bound in BOUNDS:
            count += (small >= bound).view(np.int8)
        out[at:at + ROWS_IN_CACHE] = count
    return out


def weight_sql(unit: str, rep: str) -> str:
    """The weight as SQL text over a unit and a replicate's number."""
    code = f"(CAST(concat('0x', substr(md5(CAST({unit} AS VARCHAR)), 1, 8)) AS BIGINT) % {PRIME})"
    z = f"(({code} + {rep} * {STEP}) % {PRIME})"
    z = f"(({z} * {z} + {rep}) % {PRIME})"
    z = f"(({z} * {z} + {code}) % {PRIME})"
    return f"list_sum(list_transform([{', '.join(map(repr, CDF))}], lambda b: CASE WHEN {z} / {float(PRIME)}::DOUBLE >= b THEN 1 ELSE 0 END))"


def _summed(measures: Sequence[str], replicates: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(measures), replicates))
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                rows = batch.iloc[at:at + ROWS_AT_ONCE]
                sums += rows[list(measures)].to_numpy(dtype=np.float64).T @ weights(rows["code"].to_numpy(), replicates)
        yield pd.DataFrame({"rep": np.arange(1, replicates + 1), **dict(zip(measures, sums, strict=True))})
    return run


def replicate_sums(per_unit: DataFrame, unit: str, measures: Sequence[str], replicates: int = REPLICATES) -> DataFrame:
    """(rep, measures): the weighted sums of each replicate over a table with one row for each unit; nulls count as zero."""
    ship_package(per_unit.sparkSession)
    rows = per_unit.select(unit_code(F.col(unit)).alias("code"), *[F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(m) for m in measures])
    parts = rows.mapInPandas(_summed(measures, replicates), "rep int, " + ", ".join(f"`{m}` double" for m in measures))
    return parts.groupBy("rep").agg(*[F.sum(m).alias(m) for m in measures])


def bootstrap_gap(per_unit: DataFrame, unit: str, a: str, b: str, base: str, replicates: int = REPLICATES) -> DataFrame:
    """95 % interval of (sum(a) - sum(b)) / sum(base), in percent, resampling units (already summed per unit).

    Absolute errors over totals give a WAPE gap, relative errors over their number a MAPE gap, list scores over one
    for each customer the gap of their means.
    """
    g = replicate_sums(per_unit, unit, [a, b, base], replicates)
    g = g.select(((F.col(a) - F.col(b)) / F.when(F.col(base) != 0, F.col(base)) * 100).alias("gap")).where("gap is not null")
    return g.agg(F.count(F.lit(1)).alias("replicates"), *[F.round(F.percentile("gap", F.lit(q)), 5).alias(n) for q, n in ((0.025, "low"), (0.5, "median"), (0.975, "high"))],
                 F.round(F.avg((F.col("gap") < 0).cast("double")) * 100, 4).alias("a_better_pct"))


def _ranked(replicates: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by (side, p) to runs of scores with their positives, negatives and pairs won within, for each replicate.

    The first and the last score of a task are runs of their own, marked `tie`, for other tasks may hold rows of them too;
    the scores between are one run.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rep = np.arange(1, replicates + 1)
        side, p, low, first, tie, total = None, None, None, True, None, None

        def row(low: float, tied: bool, sums: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"side": side, "low": low, "tie": tied, "rep": rep, "pos": sums[0], "neg": sums[1], "won": sums[2]})

        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                rows = batch.iloc[at:at + ROWS_AT_ONCE]
                w, y = weights(rows["code"].to_numpy(), replicates), rows["y"].to_numpy(dtype=np.float64)
                s, scores = rows["side"].to_numpy(), rows["p"].to_numpy(dtype=np.float64)
                starts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (scores[1:] != scores[:-1])])
                pos = np.add.reduceat(w * y[:, None], starts)
                neg = np.add.reduceat(w, starts) - pos                  # whole numbers
                for i, start in enumerate(starts):
                    if side != s[start]:
                        if side is not None:
                            yield row(p, True, tie)
                            if low is not None:
                                yield row(low, False, total)
                        side, p, low, first = s[start], scores[start], None, True
                        tie, total = np.zeros((3, replicates)), np.zeros((3, replicates))
                    elif p != scores[start]:
                        if first:
                            yield row(p, True, tie)
                        else:
                            # wins over all negatives below and half of those of the score
                            low = p if low is None else low
                            total[2] += tie[0] * (total[1] + tie[1] / 2)
                            total[:2] += tie[:2]
                        p, first, tie = scores[start], False, np.zeros((3, replicates))
                    tie[0] += pos[i]
                    tie[1] += neg[i]
        if side is not None:
            yield row(p, True, tie)
            if low is not None:
                yield row(low, False, total)
    return run


def replicate_aucs(df: DataFrame, unit: str, scores: Sequence[str], replicates: int = REPLICATES) -> DataFrame:
    """(side, rep, auc) of each score column over rows (y, unit): exact weighted AUC with ties at one half.

    Scores are dealt by range and each task keeps three sums a replicate; a run's positives also win over the negatives of
    all lower runs. A score that many rows share is dealt over several tasks, whose sums are joined before it is ranked.
    """
    ship_package(df.sparkSession)
    long = df.select("y", unit_code(F.col(unit)).alias("code"), F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).cast("double").alias("p")) for s in scores])).alias("s"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = long.select("code", "y", "s.side", "s.p").where("p is not null and y is not null").repartitionByRange(tasks, "side", "p", "code").sortWithinPartitions("side", "p")
    parts = rows.mapInPandas(_ranked(replicates), "side string, low double, tie boolean, rep int, pos double, neg double, won double")
    runs = parts.groupBy("side", "low", "rep").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), (F.sum("won") + F.when(F.max("tie"), F.sum("pos") * F.sum("neg") / 2).otherwise(0.0)).alias("won"))
    below = Window.partitionBy("side", "rep").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)             # three rows for each task at most
    met = runs.withColumn("under", F.coalesce(F.sum("neg").over(below), F.lit(0.0)))
    total = met.groupBy("side", "rep").agg(F.sum(F.col("won") + F.col("pos") * F.col("under")).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return total.where("pos > 0 and neg > 0").select("side", "rep", (F.col("won") / (F.col("pos") * F.col("neg"))).alias("auc"))


def bootstrap_auc_gap(df: DataFrame, unit: str, a: str, b: str, replicates: int = REPLICATES) -> DataFrame:
    """Interval of the AUC gap between two scores; replicates without both classes are left out."""
    auc = replicate_aucs(df, unit, [a, b], replicates)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("auc")))
    gap = auc.groupBy("rep").agg((side(a) - side(b)).alias("gap")).where("gap is not null")
    low = F.percentile("gap", F.lit(0.025))
    return gap.agg(F.count(F.lit(1)).alias("replicates"), F.round(low, 5).alias("low"), F.round(F.percentile("gap", F.lit(0.5)), 5).alias("median"),
                   F.round(F.percentile("gap", F.lit(0.975)), 5).alias("high"), (low > 0).alias("significant"))
