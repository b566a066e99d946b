"""Many-series demand forecasting on the dense (reference, month) table.

Every rule is a frame over the series' own partition, so all series and all origins are forecast in one
pass; intermittent-demand smoothing is a fold over an array of at most 24 months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.functions import rules as R
from tradewright.functions.bootstrap import bootstrap_gap
from tradewright.functions.scale import scalar
from tradewright.operators.panels import eligible
from tradewright.session import cut_lineage

RULES = ("zero", "last", "seasonal", "seasonal_growth", "seasonal_level", "mean_3", "mean_6", "mean_12", "median_3", "median_6", "median_12", "trend")


INTERMITTENT = tuple(f"{kind}_{tenth}" for tenth in (1, 2, 3) for kind in ("croston", "sba", "tsb"))
HORIZONS = (1, 2, 3)
VALIDATION, TEST = 12, 18          # origins on which a rule is chosen, and later ones on which it is reported
WINDOW = 24                        # months an intermittent rule looks back
REFERENCE_RULE, MIN_GAIN = "median_12", 2.0


def _series():
    return Window.partitionBy("reference").orderBy("m")


def _last(k: int):
    return _series().rowsBetween(-(k - 1), 0)


def _any_horizon() -> dict[str, Column]:
    """The simple rules that say the same for every horizon."""
    return {"zero": F.lit(0.0), "last": F.col("y"), **{f"mean_{k}": F.avg("y").over(_last(k)) for k in (3, 6, 12)},
            **{f"median_{k}": F.percentile("y", F.lit(0.5)).over(_last(k)) for k in (3, 6, 12)}}


def _at_horizon(h: int) -> dict[str, Column]:
    """The simple rules for h months ahead, with the demand of that month as `target`."""
    c, w = F.col, _series()
    season = F.coalesce(F.lag("y", 12 - h).over(w), c("y"))
    has = F.lag("y", 12 - h).over(w).isNotNull()
    rec, prev = F.avg("y").over(_last(12)), F.avg("y").over(w.rowsBetween(-23, -12))
    level = F.when(prev > 0, rec / prev).otherwise(1.0)
    r3, p3 = F.avg("y").over(_last(3)), F.avg("y").over(w.rowsBetween(-14, -12))
    n15 = F.count(F.lit(1)).over(w.rowsBetween(-14, 0)) >= 15
    clip = lambda x: F.least(F.greatest(x, F.lit(0.5)), F.lit(2.0))
    trend = F.regr_intercept("y", "t").over(_last(12)) + F.regr_slope("y", "t").over(_last(12)) * (c("t") + h)
    growth = F.when(n15, season * clip(F.when(p3 > 0, r3 / p3).otherwise(1.0)))
    return {"seasonal": season, "seasonal_growth": growth, "seasonal_level": F.when(has, season * clip(level)).otherwise(season),
            "trend": F.greatest(F.coalesce(trend, c("y")), F.lit(0.0)), "target": F.lead("y", h).over(w)}


def base_rules(demand: DataFrame, h: int = 1) -> DataFrame:
    """Every simple rule at every origin, wide, with the demand h months later as `target`."""
    return demand.withColumns({**_any_horizon(), **_at_horizon(h)})


def long_rules(wide: DataFrame, keys: Sequence[str], rules: Sequence[str] = RULES) -> DataFrame:
    pairs = ", ".join(f"'{r}', cast({r} as double)" for r in rules)
    return wide.selectExpr(*keys, f"stack({len(rules)}, {pairs}) as (rule, yhat)").filter("yhat is not null")


# ---------------------------------------------------------------- intermittent demand

def _croston(values: Column, alpha: float, variant: str) -> Column:
    """Fold of one series: size and interval (Croston, SBA) or size and probability (TSB) smoothed in time order."""
    occ = F.filter(values, lambda v: v > 0)
    n = F.size(values)
    if variant == "tsb":
        start = F.struct((F.size(occ) / n).cast("double").alias("p"), (F.aggregate(occ, F.lit(0.0), lambda s, v: s + v) / F.size(occ)).cast("double").alias("z"))
        step = lambda s, v: F.struct((s["p"] + alpha * (F.when(v > 0, 1.0).otherwise(0.0) - s["p"])).alias("p"),
                                     F.when(v > 0, s["z"] + alpha * (v - s["z"])).otherwise(s["z"]).alias("z"))
        out = F.aggregate(values, start, step, lambda s: s["p"] * s["z"])
    else:
        start = F.struct(F.lit(None).cast("double").alias("z"), F.lit(None).cast("double").alias("i"), F.lit(0.0).alias("gap"))
        first = lambda s: s["z"].isNull()
        step = lambda s, v: F.when(v > 0, F.struct(
            F.when(first(s), v).otherwise(s["z"] + alpha * (v - s["z"])).alias("z"),
            F.when(first(s), s["gap"] + 1).otherwise(s["i"] + alpha * (s["gap"] + 1 - s["i"])).alias("i"), F.lit(0.0).alias("gap"))).otherwise(
            F.struct(s["z"].alias("z"), s["i"].alias("i"), (s["gap"] + 1).alias("gap")))
        factor = 1 - alpha / 2 if variant == "sba" else 1.0
        out = F.aggregate(values, start, step, lambda s: s["z"] / F.greatest(s["i"], F.lit(1.0)) * factor)
    return F.when(F.size(occ) == 0, F.lit(0.0)).otherwise(out)


def recent_values(demand: DataFrame, months: int = 24) -> DataFrame:
    """The last months of each series as one ordered array (bounded length)."""
    cut = scalar(demand.agg(F.max("m"))) - months
    arr = F.transform(F.array_sort(F.collect_list(F.struct("m", "y"))), lambda x: x["y"])
    return demand.filter(F.col("m") > cut).groupBy("reference").agg(arr.alias("values"))


def intermittent_forecasts(demand: DataFrame, alphas: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    v = recent_values(demand)
    return v.select("reference", *[_croston(F.col("values"), a, k).alias(f"{k}_{int(a * 10)}") for a in alphas for k in ("croston", "sba", "tsb")])


# ---------------------------------------------------------------- scoring and choice

def rule_scores(demand: DataFrame, h: int = 1, last_origins: int = 12, rules: Sequence[str] = RULES) -> DataFrame:
    """Walk-forward error of every rule over the last origins, on eligible references."""
    hi = scalar(demand.agg(F.max("m")))
    e = eligible(base_rules(demand, h)).filter("eligible and target is not null").filter(F.col("m") > hi - h - last_origins)
    return X.error_block(long_rules(e, ["target as y"], rules), ["rule"])


def rules_at_origins(demand: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(reference, m, h, phase, y, one column for each rule) at the last eligible origins: 12 of validation, then 18 of test.

    y is the demand h months after the origin; horizons that end after the last month are left out. The intermittent
    rules fold the last 24 months of each origin, and only of these origins. All windows share one sorted partition of a reference's months.
    """
    hi = scalar(demand.agg(F.max("m")))
    ahead = {h: _at_horizon(h) for h in horizons}
    wide = eligible(demand.withColumns({**_any_horizon(), **{f"{n}_h{h}": x for h, by in ahead.items() for n, x in by.items()}, "past": F.collect_list("y").over(_last(WINDOW))}))
    near = wide.filter("eligible").filter((F.col("m") >= hi - VALIDATION - TEST) & (F.col("m") < hi))
    folded = near.withColumns({f"{kind}_{tenth}": _croston(F.col("past"), tenth / 10, kind) for kind, tenth in (r.split("_") for r in INTERMITTENT) for tenth in (int(tenth),)})
    each = F.array(*[F.struct(F.lit(h).alias("h"), *[F.col(f"{n}_h{h}").alias(n) for n in by]) for h, by in ahead.items()])
    own = [c for c in (*RULES, *INTERMITTENT) if c not in ahead[horizons[0]]]
    phase = F.when(F.col("m") >= hi - TEST, "test").otherwise("validation")
    rows = folded.select("reference", "m", phase.alias("phase"), *own, F.explode(each).alias("at")).select("reference", "m", "phase", *own, "at.*")
    return rows.filter("target is not null").withColumnRenamed("target", "y")


def walk_forward_scores(rows: DataFrame) -> DataFrame:
    """Errors of every rule by phase and horizon over `rules_at_origins`."""
    return X.error_block(long_rules(rows, ["phase", "h", "y"], (*RULES, *INTERMITTENT)), ["phase", "h", "rule"])


def chosen_rule(scores: DataFrame) -> DataFrame:
    """For each horizon the rule of least WAPE on the validation origins (ties: first by name), with its WAPE on the test origins."""
    on = lambda phase: F.max(F.when(F.col("phase") == phase, F.col("wape_pct")))
    both = scores.groupBy("h", "rule").agg(on("validation").alias("validation_wape_pct"), on("test").alias("test_wape_pct"))
    return both.filter("validation_wape_pct is not null").groupBy("h").agg(F.min(F.struct("validation_wape_pct", "rule", "test_wape_pct")).alias("b")).select(
        "h", "b.rule", "b.validation_wape_pct", "b.test_wape_pct")


def _against_reference(rows: DataFrame) -> DataFrame:
    """(reference, m, h, phase, y, role, rule, yhat): the reference rule and the rule chosen at one month, which then serves all horizons."""
    first = chosen_rule(walk_forward_scores(rows)).filter("h = 1").select(F.lit("chosen").alias("role"), "rule")
    roles = first.unionByName(rows.sparkSession.range(1).select(F.lit("reference").alias("role"), F.lit(REFERENCE_RULE).alias("rule")))
    return long_rules(rows, ["reference", "m", "h", "phase", "y"], (*RULES, *INTERMITTENT)).join(F.broadcast(roles), "rule")            # two rows


def protocol_report(rows: DataFrame) -> DataFrame:
    """WAPE at each horizon and over three months together, and bias at one month, by phase, of the chosen and the reference rule."""
    long = _against_reference(rows)
    e = F.abs(F.col("yhat") - F.col("y"))
    at = lambda h, x: F.sum(F.when(F.col("h") == h, x))
    one = long.groupBy("role", "rule", "phase").agg(*[F.round(R.pct(at(h, e), at(h, F.col("y"))), 6).alias(f"wape_h{h}") for h in HORIZONS],
                                                     F.round(R.pct(at(1, F.col("yhat") - F.col("y")), at(1, F.col("y"))), 6).alias("bias_h1"))
    cases = long.groupBy("role", "phase", "reference", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("yhat").alias("yhat")).filter(F.col("n") == len(HORIZONS))
    three = cases.groupBy("role", "phase").agg(F.round(R.pct(F.sum(e), F.sum("y")), 6).alias("wape_3_months"))
    return one.join(three, ["role", "phase"], "left")


def served_rule(rows: DataFrame) -> DataFrame:
    """The chosen rule serves only if it beats the reference rule on the test by `MIN_GAIN` points of WAPE at one month, with a 95 % interval above zero."""
    test = cut_lineage(_against_reference(rows.filter("h = 1")).filter("phase = 'test'"))
    e = F.abs(F.col("yhat") - F.col("y"))
    of = lambda role, x: F.sum(F.when(F.col("role") == role, x))
    units = test.groupBy("reference").agg(of("reference", e).alias("a"), of("chosen", e).alias("b"), of("reference", F.col("y")).alias("base"))
    gap = units.agg(F.round(R.pct(F.sum("a") - F.sum("b"), F.sum("base")), 6).alias("gain"))
    name = test.filter("role = 'chosen'").agg(F.max("rule").alias("rule"))
    ok = (F.col("gain") >= MIN_GAIN) & (F.col("low") > 0)
    return name.crossJoin(gap).crossJoin(bootstrap_gap(units, "reference", "a", "b", "base").select("replicates", "low", "high")).select(                  # one row each
        F.col("rule").alias("candidate"), "gain", "replicates", "low", "high", ok.alias("deployed"), F.when(ok, F.col("rule")).otherwise(REFERENCE_RULE).alias("served"))


def market_series(demand: DataFrame) -> DataFrame:
    """The whole market as one series (one row per month)."""
    return demand.groupBy("m", "t").agg(F.sum("y").alias("y")).withColumn("reference", F.lit("market"))


def market_rule_mape(demand: DataFrame, last_origins: int = 24) -> DataFrame:
    z = base_rules(market_series(demand)).filter("target > 0")
    hi = scalar(z.agg(F.max("m")))
    rows = long_rules(z.filter(F.col("m") > hi - last_origins), ["m", "target"], [r for r in RULES if r != "zero"]).filter("yhat > 0")
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("origins"), F.round(F.avg(F.abs(F.col("target") - F.col("yhat")) / F.col("target")) * 100, 6).alias("mape_pct"))


def _next(values: Column, rule: str) -> Column:
    tail = lambda k: F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), F.lit(k))
    if rule.startswith("mean_"):
        t = tail(int(rule[5:]))
        return F.aggregate(t, F.lit(0.0), lambda s, v: s + v) / F.size(t)
    if rule.startswith("median_"):
        t = F.array_sort(tail(int(rule[7:])))
        n = F.size(t)
        return (F.element_at(t, F.floor((n + 1) / 2).cast("int")) + F.element_at(t, F.ceil((n + 1) / 2).cast("int"))) / 2.0
    if rule == "seasonal":
        return F.coalesce(F.try_element_at(values, F.lit(-12)), F.element_at(values, -1))
    return F.element_at(values, -1)


def recursive_forecast(demand: DataFrame, rule: str, steps: int = 3) -> DataFrame:
    """Each step is appended to the history before the next; never negative."""
    v = recent_values(demand)
    for s in range(1, steps + 1):
        v = v.withColumn(f"step_{s}", F.greatest(_next(F.col("values"), rule), F.lit(0.0))).withColumn("values", F.concat("values", F.array(F.col(f"step_{s}"))))
    return v.select("reference", *[f"step_{s}" for s in range(1, steps + 1)])


def market_intervals(demand: DataFrame, rule: str = "median_12", steps: int = 3, last_origins: int = 24) -> DataFrame:
    """80 % and 50 % intervals from the quantiles of past relative errors, widened by the root of the step."""
    z = base_rules(market_series(demand))
    hi = scalar(z.agg(F.max("m")))
    e = z.filter((F.col("target") > 0) & (F.col(rule) > 0) & (F.col("m") > hi - 1 - last_origins)).agg(
        *[F.percentile((F.col("target") - F.col(rule)) / F.col(rule), F.lit(q)).alias(n) for q, n in ((0.1, "q10"), (0.25, "q25"), (0.75, "q75"), (0.9, "q90"))])
    f = recursive_forecast(market_series(demand), rule, steps).selectExpr(f"stack({steps}, " + ", ".join(f"{s}, step_{s}" for s in range(1, steps + 1)) + ") as (step, p)")
    x = f.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k")
    s = F.sqrt("step")
    lo = lambda q: F.round(F.greatest(F.lit(0.0), F.col("p") * (1 + F.col(q) * s)), 4)
    up = lambda q: F.round(F.col("p") * (1 + F.col(q) * s), 4)
    return x.select("step", F.round("p", 4).alias("forecast"), lo("q10").alias("low_80"), up("q90").alias("high_80"), lo("q25").alias("low_50"), up("q75").alias("high_50"))


# ---------------------------------------------------------------- classes and bounds

def demand_class(n_months: Column, n_active: Column, mean: Column, std: Column) -> Column:
    adi, cv2 = n_months / n_active, F.pow(std / mean, F.lit(2))
    return (F.when(n_active < 2, "insufficient").when(adi < 1.32, F.when(cv2 < 0.49, "smooth").otherwise("erratic"))
            .otherwise(F.when(cv2 < 0.49, "intermittent").otherwise("lumpy")))


def with_class(demand: DataFrame) -> DataFrame:
    """Class of the 24 months up to each origin."""
    w = Window.partitionBy("reference").orderBy("m").rowsBetween(-23, 0)
    nz = F.when(F.col("y") > 0, F.col("y"))
    return demand.withColumn("class", demand_class(F.count(F.lit(1)).over(w), F.count(nz).over(w), F.avg(nz).over(w), F.stddev_pop(nz).over(w)))


def class_sizes(demand: DataFrame) -> DataFrame:
    hi = scalar(demand.agg(F.max("m")))
    return with_class(demand).filter(F.col("m") == hi).groupBy("class").agg(F.count(F.lit(1)).alias("references"), F.round(F.sum("y"), 2).alias("qty"))


def _scored(demand: DataFrame, rule: str = "median_12") -> DataFrame:
    w = Window.partitionBy("reference").orderBy("m")
    r = with_class(eligible(base_rules(demand))).withColumns({
        "group": F.when(F.col("class") == "smooth", "smooth").otherwise("other"), "scale": F.greatest(F.avg("y").over(w.rowsBetween(-11, 0)), F.lit(0.5)),
        "next_3": F.when(F.count(F.lit(1)).over(w.rowsBetween(1, 3)) == 3, F.sum("y").over(w.rowsBetween(1, 3))), "yhat": F.col(rule)})
    return r.filter("eligible")


def conformal_bounds(demand: DataFrame, level: float = 0.8, split: int = 12) -> DataFrame:
    """Upper quantile of the scaled residual per group before the split, and its coverage after."""
    s = _scored(demand)
    hi = scalar(demand.agg(F.max("m")))
    e1, e3 = (F.col("target") - F.col("yhat")) / F.col("scale"), (F.col("next_3") - 3 * F.col("yhat")) / F.col("scale")
    rows = s.withColumn("after", F.col("m") > hi - split).select("group", "after", F.explode(F.create_map(F.lit("month_1"), e1, F.lit("next_3"), e3)).alias("horizon", "e")).filter("e is not null")
    q = rows.filter("not after").groupBy("group", "horizon").agg(F.percentile("e", F.lit(level)).alias("q"))
    return rows.filter("after").join(q, ["group", "horizon"]).groupBy("group", "horizon").agg(
        F.round(F.max("q"), 6).alias("bound"), F.count(F.lit(1)).alias("cases"), F.round(F.avg((F.col("e") <= F.col("q")).cast("int")), 6).alias("coverage"))


def serving_table(demand: DataFrame, labels: DataFrame, level: float = 0.8, split: int = 12) -> DataFrame:
    """Next three months, cumulative demand and its upper bound, per eligible reference at the last origin."""
    s = _scored(demand)
    hi = scalar(demand.agg(F.max("m")))
    q = s.filter((F.col("m") <= hi - split) & F.col("next_3").isNotNull()).groupBy("group").agg(
        F.percentile((F.col("next_3") - 3 * F.col("yhat")) / F.col("scale"), F.lit(level)).alias("q"))
    now = s.filter(F.col("m") == hi).join(F.broadcast(q), "group", "left").join(labels, "reference", "left")              # two groups
    cum = 3 * F.col("yhat")
    return now.select("reference", "label", F.round("yhat", 4).alias("monthly_forecast"), F.round(cum, 4).alias("next_3_months"),
                      F.round(F.greatest(cum + F.col("q") * F.col("scale"), cum), 4).alias("upper_bound"), F.col("group").alias("demand_group"), F.round("mean_12", 4).alias("mean_12"),
                      F.round("mean_3", 4).alias("mean_3"), F.col("y").alias("last_month"))


# ---------------------------------------------------------------- learned challenger and combinations

def challenger(features: DataFrame, names: Sequence[str], last_origins: int = 6, refresh: int = 3) -> DataFrame:
    """Boosted absolute-loss model on scale-normalised series, retrained every `refresh` origins on the past only."""
    f = cut_lineage(features.filter("target is not null").withColumn("scale", F.greatest("mean_12", F.lit(0.5))).fillna(0.0, list(names)))
    qty = {n for n in names if n.startswith(("lag_", "season_", "mean_", "median_", "std_", "max_12", "bought_"))}
    x = f.select("reference", "m", "target", "scale", "median_12", *[(F.col(n) / F.col("scale") if n in qty else F.col(n)).alias(f"x_{n}") for n in names]).withColumn("z", F.col("target") / F.col("scale"))
    hi, out = x.agg(F.max("m")).first()[0], None
    for start in range(hi - last_origins + 1, hi + 1, refresh):
        m = Pipeline(stages=[VectorAssembler(inputCols=[f"x_{n}" for n in names], outputCol="v", handleInvalid="keep"),
                             GBTRegressor(featuresCol="v", labelCol="z", lossType="absolute", maxDepth=4, maxIter=8, seed=42)]).fit(x.filter(F.col("m") < start))
        p = m.transform(x.filter(F.col("m").between(start, start + refresh - 1))).select(
            "reference", "m", F.col("target").alias("y"), "median_12", F.greatest(F.col("prediction") * F.col("scale"), F.lit(0.0)).alias("learned"))
        out = p if out is None else out.unionByName(p)
    return out


def challenger_scores(predictions: DataFrame) -> DataFrame:
    """Reference rule, learned model and their fixed half-half combination."""
    p = predictions.withColumn("half_half", 0.5 * F.col("median_12") + 0.5 * F.col("learned"))
    return X.error_block(long_rules(p, ["y"], ("median_12", "learned", "half_half")), ["rule"])


def quantile_rules(demand: DataFrame) -> DataFrame:
    """Quantile 55 % and 60 % of the last 12 months, class hybrid and row-wise median of members, against the median."""
    w = Window.partitionBy("reference").orderBy("m").rowsBetween(-11, 0)
    r = with_class(eligible(base_rules(demand))).withColumns({f"q{int(q * 100)}": F.percentile("y", F.lit(q)).over(w) for q in (0.55, 0.6)}).filter("eligible and target is not null")
    a, b, c = F.col("median_12"), F.col("mean_3"), F.col("mean_12")
    r = r.withColumns({"hybrid_by_class": F.when(F.col("class") == "smooth", a).otherwise(c), "member_median": F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)),
                       "half_median_mean": 0.5 * a + 0.5 * c})
    return X.error_block(long_rules(r, ["target as y"], ("median_12", "q55", "q60", "hybrid_by_class", "member_median", "half_median_mean")), ["rule"])


# ---------------------------------------------------------------- diagnostics

def _context(demand: DataFrame, a: str, b: str) -> DataFrame:
    """Two rules side by side with what was known at the origin and the type of the observed month."""
    c = F.col
    r = with_class(eligible(base_rules(demand))).filter("eligible and target is not null")
    level, y = F.greatest("median_12", "mean_12"), c("target")
    kind = F.when(y == 0, "zero").when(y < 0.5 * level, "dip").when((y > 2 * level) & (y > level + 3), "peak").otherwise("normal")
    return r.select("reference", "m", "class", y.alias("y"), c(a).alias("a"), c(b).alias("b"), F.abs(c(a) - y).alias("ea"), F.abs(c(b) - y).alias("eb"), kind.alias("type"))


def error_decomposition(demand: DataFrame, public: DataFrame, a: str = "median_12", b: str = "mean_3") -> DataFrame:
    """Share of volume and of each rule's error by observation type, class and clientele, stacked."""
    x = _context(demand, a, b).join(public, "reference", "left")
    w = Window.partitionBy("axis")                                               # a few rows per axis

    def by(axis, col):
        return x.groupBy(F.lit(axis).alias("axis"), col.alias("label")).agg(
            F.count(F.lit(1)).alias("observations"), F.sum("y").alias("y"), F.sum("ea").alias("ea"), F.sum("eb").alias("eb"), F.sum(F.col("a") - F.col("y")).alias("oa"))
    u = by("type", F.col("type")).unionByName(by("class", F.col("class"))).unionByName(by("clientele", F.when(F.col("public"), "public").otherwise("other")))
    return u.select("axis", "label", "observations", F.round(R.pct(F.col("y"), F.sum("y").over(w)), 6).alias("volume_pct"), F.round(R.pct(F.col("ea"), F.sum("ea").over(w)), 6).alias("error_a_pct"),
                    F.round(R.pct(F.col("eb"), F.sum("eb").over(w)), 6).alias("error_b_pct"), F.round("oa", 4).alias("over_forecast_a"))


def error_by_month(demand: DataFrame, a: str = "median_12", b: str = "mean_3") -> DataFrame:
    return _context(demand, a, b).groupBy("m").agg(
        F.count(F.lit(1)).alias("observations"), F.round(F.sum("y"), 4).alias("y"), F.round(R.pct(F.sum("ea"), F.sum("y")), 6).alias("wape_a"), F.round(R.pct(F.sum("eb"), F.sum("y")), 6).alias("wape_b"),
        F.round(R.pct(F.sum(F.col("a") - F.col("y")), F.sum("y")), 6).alias("bias_a"))


def costly_references(demand: DataFrame, k: int = 10, a: str = "median_12", b: str = "mean_3") -> DataFrame:
    g = _context(demand, a, b).groupBy("reference").agg(F.sum("y").alias("y"), F.sum("ea").alias("ea"), F.sum("eb").alias("eb"))
    ta, tb = scalar(g.agg(F.sum("ea"))), scalar(g.agg(F.sum("eb")))
    return g.orderBy(F.col("eb").desc(), "reference").limit(k).select("reference", F.round("y", 4).alias("y"), F.round(R.pct(F.col("ea"), ta), 6).alias("error_a_pct"), F.round(R.pct(F.col("eb"), tb), 6).alias("error_b_pct"))


def paired_duel(demand: DataFrame, a: str = "median_12", b: str = "mean_3") -> DataFrame:
    """Observation by observation: which rule is closer, beyond a tolerance of max(1, 5 % of the demand)."""
    x = _context(demand, a, b)
    gain, tol = F.col("ea") - F.col("eb"), F.greatest(F.lit(1.0), 0.05 * F.col("y"))
    return x.groupBy(F.when(gain > tol, "b_better").when(gain < -tol, "a_better").otherwise("similar").alias("outcome"), "type").agg(
        F.count(F.lit(1)).alias("observations"), F.round(F.sum(gain), 4).alias("error_avoided_by_b"))


def oracle_ceilings(demand: DataFrame) -> DataFrame:
    """Errors no rule could beat: median of neighbouring months (target excluded) and best constant per reference."""
    w = Window.partitionBy("reference").orderBy("m")
    near = lambda k: F.concat(F.collect_list("y").over(w.rowsBetween(-(k - 1), 0)), F.collect_list("y").over(w.rowsBetween(2, k + 1)))

    def med(arr):
        s, n = F.array_sort(arr), F.size(arr)
        return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.ceil((n + 1) / 2).cast("int"))) / 2.0
    r = eligible(base_rules(demand)).withColumns({"near_3": med(near(3)), "near_6": med(near(6))}).filter("eligible and target is not null")
    const = r.groupBy("reference").agg(F.percentile("target", F.lit(0.5)).alias("constant"))
    return X.error_block(long_rules(r.join(const, "reference"), ["target as y"], ("median_12", "near_3", "near_6", "constant")), ["rule"])


def peak_detector(demand: DataFrame, threshold: float = 1.3, a: str = "median_12", b: str = "mean_3") -> DataFrame:
    """Errors after a month whose market exceeded 1.3 times the median of the 12 before, against the other origins."""
    z = market_series(demand)
    w = Window.partitionBy("reference").orderBy("m").rowsBetween(-12, -1)
    flags = z.select("m", F.coalesce(F.col("y") > threshold * F.percentile("y", F.lit(0.5)).over(w), F.lit(False)).alias("peak"))
    x = _context(demand, a, b).join(F.broadcast(flags), "m")                     # one row per month
    return x.groupBy("peak").agg(F.countDistinct("m").alias("origins"), F.round(R.pct(F.sum("ea"), F.sum("y")), 6).alias("wape_a"), F.round(R.pct(F.sum("eb"), F.sum("y")), 6).alias("wape_b"),
                                 F.round(R.pct(F.sum(F.col("b") - F.col("y")), F.sum("y")), 6).alias("bias_b"))


def peak_neutralised(demand: DataFrame, rule: str = "mean_3") -> DataFrame:
    """Forecast of each origin with its own month replaced by the median of the 12 months before: what the peak added."""
    w = Window.partitionBy("reference").orderBy("m")
    k = int(rule.split("_")[1])
    normal = F.percentile("y", F.lit(0.5)).over(w.rowsBetween(-12, -1))
    r = eligible(base_rules(demand)).withColumn("normal", normal).filter("eligible and target is not null and normal is not null")
    alt = F.col(rule) + (F.col("normal") - F.col("y")) / F.least(F.lit(k), F.col("t") + 1)
    return r.groupBy("m").agg(F.round(F.sum(rule), 4).alias("observed"), F.round(F.sum(alt), 4).alias("neutralised"), F.round(F.sum("target"), 4).alias("actual"))
