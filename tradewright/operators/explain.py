"""Per-row explanations of a linear score: contributions, reasons, counterfactuals and fidelity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.functions.scale import average_ranks


def moments(panel: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of means, deviations, and least and largest values as bounds."""
    return panel.agg(*[e for f in features for e in (F.avg(f).alias(f"mu_{f}"), F.stddev_pop(f).alias(f"sd_{f}"), F.min(f).alias(f"lo_{f}"), F.max(f).alias(f"hi_{f}"))])


def _z(f: str) -> Column:
    sd = F.col(f"sd_{f}")
    return F.when(sd > 0, (F.col(f) - F.col(f"mu_{f}")) / sd).otherwise(0.0)


def with_moments(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach the one-row statistics as constants."""
    return rows.withColumns({c: stats.select(c).scalar() for c in stats.columns})


def contributions(rows: DataFrame, stats: DataFrame, weights: dict[str, float], intercept: float = 0.0) -> DataFrame:
    """Adds `score` and `parts`: exact contributions weight x standardised value, largest first."""
    x = with_moments(rows, stats)
    parts = F.array(*[F.struct(F.lit(f).alias("feature"), (F.lit(w) * _z(f)).alias("part"), F.col(f).cast("double").alias("value")) for f, w in weights.items()])
    x = x.withColumn("parts", F.array_sort(parts, lambda a, b: F.when(F.abs(a["part"]) > F.abs(b["part"]), -1).when(F.abs(a["part"]) < F.abs(b["part"]), 1)
                                           .when(a["feature"] < b["feature"], -1).otherwise(1)))
    return x.withColumn("score", F.aggregate("parts", F.lit(float(intercept)), lambda s, p: s + p["part"]))


def reasons(explained: DataFrame, key: Sequence[str], k: int = 3) -> DataFrame:
    """The k strongest parts in the direction of the score and the strongest opposite one, with shares of the absolute total."""
    total = F.aggregate("parts", F.lit(0.0), lambda s, p: s + F.abs(p["part"]))
    same = F.filter("parts", lambda p: p["part"] * F.signum("score") > 0)
    other = F.filter("parts", lambda p: p["part"] * F.signum("score") < 0)
    x = explained.select(*key, "score", total.alias("total"), F.slice(same, 1, k).alias("same"), F.slice(other, 1, 1).alias("other"))
    x = x.select(*key, "score", "total", F.concat(F.transform("same", lambda p: F.struct(F.lit("for").alias("side"), p["feature"].alias("feature"), p["part"].alias("part"), p["value"].alias("value"))),
                                                  F.transform("other", lambda p: F.struct(F.lit("against").alias("side"), p["feature"].alias("feature"), p["part"].alias("part"), p["value"].alias("value")))).alias("r"))
    x = x.select(*key, "score", "total", F.posexplode("r").alias("pos", "r"))
    return x.select(*key, F.round("score", 6).alias("score"), (F.col("pos") + 1).alias("position"), "r.side", "r.feature", F.round("r.part", 6).alias("part"),
                    F.round(F.when(F.col("total") > 0, F.abs("r.part") / F.col("total") * 100), 4).alias("share_pct"))


def percentile_position(rows: DataFrame, panel: DataFrame, feature: str) -> DataFrame:
    """Share of the panel at or below each row's value."""
    n = panel.filter(F.col(feature).isNotNull()).agg(F.count(F.lit(1))).scalar()
    cnt = panel.groupBy(feature).agg(F.count(F.lit(1)).alias("_n"))
    r = average_ranks(panel, feature).join(cnt, feature).select(feature, ((F.col("avg_rank") + (F.col("_n") - 1) / 2.0) / n * 100).alias("pct"))
    return rows.join(r, feature, "left")


def threshold_reasons(rows: DataFrame, key: Sequence[str], rules: Sequence[tuple[str, str, float, float]], k: int = 3) -> DataFrame:
    """Rules crossed (variable, direction, threshold, weight), weight x (1 + relative gap), one per variable, strongest first."""
    made: dict[str, list[Column]] = {}
    for var, op, thr, w in rules:
        v = F.col(var)
        hit = v > thr if op == ">" else v < thr
        made.setdefault(var, []).append(F.when(hit, F.struct((F.lit(w) * (1 + F.abs(v - thr) / F.greatest(F.abs(F.lit(thr)), F.lit(1e-9)))).alias("strength"), F.lit(var).alias("variable"), F.lit(thr).alias("threshold"))))
    best = F.array(*[F.array_max(F.array(*hits)) for hits in made.values()])
    ordered = F.slice(F.reverse(F.array_sort(F.filter(best, lambda h: h.isNotNull()))), 1, k)
    return rows.select(*key, F.posexplode(ordered).alias("pos", "h")).select(*key, (F.col("pos") + 1).alias("position"), "h.variable", "h.threshold", F.round("h.strength", 6).alias("strength"))


def counterfactual(explained: DataFrame, key: Sequence[str], weights: dict[str, float], actionable: Sequence[str], target: float) -> DataFrame:
    """Smallest single change, in deviations, that brings a score above `target` down to it within observed values."""
    opts = []
    for f in actionable:
        sd, w = F.col(f"sd_{f}"), weights[f]
        new = F.col(f) + (F.lit(target) - F.col("score")) / F.lit(w) * sd
        ok = new.between(F.col(f"lo_{f}"), F.col(f"hi_{f}")) & (sd > 0)
        opts.append(F.when(ok, F.struct((F.abs(new - F.col(f)) / sd).alias("effort"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("from"), new.alias("to"))))
    best = F.array_min(F.filter(F.array(*opts), lambda o: o.isNotNull()))
    x = explained.filter(F.col("score") > target).select(*key, "score", best.alias("b"))
    return x.select(*key, F.round("score", 6).alias("score"), "b.feature", F.round("b.from", 4).alias("from_value"), F.round("b.to", 4).alias("to_value"), F.round("b.effort", 6).alias("effort"))


def deletion_fidelity(explained: DataFrame, k: int = 2) -> DataFrame:
    """Mean score change when the k strongest parts are neutralised, against k parts in a hashed order."""
    top = F.aggregate(F.slice("parts", 1, k), F.lit(0.0), lambda s, p: s + p["part"])
    mixed = F.array_sort("parts", lambda a, b: F.when(F.md5(a["feature"]) < F.md5(b["feature"]), -1).when(F.md5(a["feature"]) > F.md5(b["feature"]), 1).otherwise(0))
    rnd = F.aggregate(F.slice(mixed, 1, k), F.lit(0.0), lambda s, p: s + p["part"])
    return explained.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(top)).alias("t"), F.avg(F.abs(rnd)).alias("r")).select(
        "rows", F.round("t", 6).alias("top_change"), F.round("r", 6).alias("random_change"), (F.col("t") > F.col("r")).alias("faithful"))
