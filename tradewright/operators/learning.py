"""Training protocols on Spark ML: splits, selection, calibration, scoring, registry."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.functions import rules as R
from tradewright.functions.bootstrap import unit_code
from tradewright.functions.scale import distinct_values, exact_quantiles, scalar
from tradewright.session import cut_lineage

SEED = 42
FITS_AT_ONCE = 4


# ---------------------------------------------------------------- estimators

def classifier(kind: str, features: Sequence[str], **params) -> Pipeline:
    raw = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    if kind == "logistic":
        est = LogisticRegression(featuresCol="x", labelCol="y", regParam=params.get("reg", 0.01), maxIter=50)
        return Pipeline(stages=[raw, StandardScaler(inputCol="raw", outputCol="x", withMean=True), est])
    return Pipeline(stages=[raw, GBTClassifier(featuresCol="raw", labelCol="y", maxDepth=params.get("depth", 3), maxIter=params.get("rounds", 10), stepSize=0.1, seed=SEED)])


# simplest first: ties within the parsimony margin go to the first
TRIALS = (("logistic", {"reg": 0.01}), ("logistic", {"reg": 0.1}), ("boosting", {"depth": 2, "rounds": 10}), ("boosting", {"depth": 3, "rounds": 10}))


def predict(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def _auc(df: DataFrame) -> float:
    return X.auc(df).first()["auc"]


# ---------------------------------------------------------------- splits

def date_quantile(df: DataFrame, day: str, q: float) -> DataFrame:
    """Exact date quantile from the few distinct dates and their counts."""
    n = F.datediff(day, F.lit("1970-01-01").cast("date"))
    h = df.groupBy(n.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return h.agg(F.floor(F.percentile("d", F.lit(q), F.col("n"))).cast("int").alias("d")).select(F.date_add(F.lit("1970-01-01").cast("date"), "d").alias("cut"))


def time_split(df: DataFrame, day: str, q: float, horizon_days: int) -> tuple[DataFrame, DataFrame]:
    """Train rows whose target is known before the cut, test rows after it; the margin between is dropped."""
    cut = scalar(date_quantile(df, day, q))
    return df.filter(F.date_add(day, horizon_days) <= cut), df.filter(F.col(day) > cut)


def split_summary(df: DataFrame, day: str, q: float, horizon_days: int) -> DataFrame:
    cut = scalar(date_quantile(df, day, q))
    known, after = F.date_add(day, horizon_days) <= cut, F.col(day) > cut
    return df.agg(R.count_where(known).alias("train_rows"), R.count_where(after).alias("test_rows"), R.count_where(~known & ~after).alias("leak_margin_rows")).select(
        cut.alias("cut"), "train_rows", "test_rows", "leak_margin_rows")


def group_fold(entity: Column, k: int) -> Column:
    return (unit_code(entity) % k).cast("int")


def fold_sizes(df: DataFrame, entity: str, k: int) -> DataFrame:
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    return per.groupBy(group_fold(F.col(entity), k).alias("fold")).agg(F.count(F.lit(1)).alias("entities"), F.sum("n").alias("rows"), F.sum("pos").alias("positives"))


def time_blocks(df: DataFrame, day: str, blocks: int) -> DataFrame:
    """Consecutive blocks of dates; block 0 only trains, block i is tested with weight 2^(i-1)."""
    d = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()                                                      # one row per observation date
    i = F.row_number().over(Window.orderBy(day)) - 1
    return d.select(day, F.floor(i * (blocks + 1) / F.count(F.lit(1)).over(w)).cast("int").alias("block"), "n")


def block_sizes(df: DataFrame, day: str, blocks: int) -> DataFrame:
    b = F.col("block")
    return time_blocks(df, day, blocks).groupBy("block").agg(F.sum("n").alias("rows")).select("block", "rows", F.when(b > 0, F.pow(F.lit(2.0), b - 1)).otherwise(0.0).alias("weight"))


# ---------------------------------------------------------------- training protocols

def select_classifier(panel: DataFrame, features: Sequence[str], day: str, horizon_days: int, max_gap: float = 0.10, parsimony: float = 0.01) -> DataFrame:
    """Trials judged inside the training period, then the chosen one measured once after the cut."""
    panel = cut_lineage(panel)
    train, test = time_split(panel, day, 0.75, horizon_days)
    inner, valid = time_split(train, day, 0.75, horizon_days)
    rows = []
    for i, (kind, params) in enumerate(TRIALS):
        m = classifier(kind, features, **params).fit(inner)
        a, b = _auc(predict(m, inner)), _auc(predict(m, valid))
        rows.append((i, kind, str(params), a, b, a - b < max_gap))
    ok = [r for r in rows if r[5]] or rows
    best = max(r[4] for r in ok)
    chosen = next(r for r in ok if best - r[4] <= parsimony)
    final = classifier(chosen[1], features, **TRIALS[chosen[0]][1]).fit(train)
    out = _auc(predict(final, test))
    return panel.sparkSession.createDataFrame([(*r[1:], r[0] == chosen[0], out if r[0] == chosen[0] else None) for r in rows],
                                              "candidate string, params string, auc_train double, auc_valid double, eligible boolean, chosen boolean, auc_out_of_period double")


def fit_all(panel: DataFrame, sets: Sequence[tuple[str, Column, Column, Sequence[str]]], kind: str = "logistic") -> DataFrame:
    """(name, y, p) of all test rows of each (name, train condition, test condition, features), from one model each.

    The fits run a few at a time over the same stored panel, and all predictions are scored together afterwards.
    """
    def one(job):
        name, train, test, features = job
        return predict(classifier(kind, features).fit(panel.filter(train)), panel.filter(test)).select(F.lit(name).alias("name"), "y", "p")
    return cut_lineage(reduce(DataFrame.unionByName, _each(one, sets)))


def _each(work: Callable, jobs: Sequence) -> list:
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(work, jobs))


def auc_by_name(scored: DataFrame) -> DataFrame:
    """(name, rows, positives, auc); names without both classes have no auc."""
    t = scored.groupBy("name", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    size = scored.groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.sum("y").alias("positives"))
    return size.join(X.grouped_auc(t, "name"), "name", "left")


def origins(panel: DataFrame, day: str, count: int = 4, share: float = 0.15, min_train: int = 400, min_test: int = 120) -> list[tuple]:
    """(cut, end of the test) of each origin; test parts hold `share` of the rows, the first follows what they leave.

    Dates are read off the running number of rows by date, so only one row for each date reaches the driver.
    """
    by_day = sorted(tuple(r) for r in panel.groupBy(day).agg(F.count(F.lit(1)).alias("n")).collect())          # one row for each date
    n = sum(x for _, x in by_day)
    if n < min_train + min_test:
        return []

    def date_at(i: int):
        for d, x in by_day:
            i -= x
            if i < 0:
                return d
        return by_day[-1][0]
    step = max(int(n * share), 1)
    first = max(min_train, int(n * (1 - count * share)))
    if first >= n - min_test:
        first = max(min_train, n - int(n * share) - min_test)
    at = [i for i in range(first, n, step) if i + min_test <= n][:count]
    return [(date_at(i), date_at(i + step - 1) if i + step < n else by_day[-1][0]) for i in at]


def walk_forward(panel: DataFrame, features: Sequence[str], day: str, horizon_days: int, count: int = 4, min_train: int = 400, min_test: int = 120, least: int = 40) -> DataFrame:
    """Several origins; every prediction comes from the past of its own cut, and predictions are pooled.

    An origin whose training part is under `min_train` rows, or whose test part is under `least` rows or of one class, is reported and not kept.
    """
    panel = cut_lineage(panel)
    spark, known = panel.sparkSession, []
    for i, (cut, end) in enumerate(origins(panel, day, count, min_train=min_train, min_test=min_test), 1):
        known.append((str(i), cut, F.date_add(day, horizon_days) <= F.lit(cut), (F.col(day) > F.lit(cut)) & (F.col(day) <= F.lit(end))))
    schema = "fold string, cut date, train_rows long, rows long, positives long, kept boolean"
    if not known:
        return spark.createDataFrame([], schema + ", auc double")
    one = panel.agg(*[x for i, (_, _, a, b) in enumerate(known) for x in (R.count_where(a).alias(f"a{i}"), R.count_where(b).alias(f"b{i}"), F.coalesce(F.sum(F.when(b, F.col("y"))), F.lit(0)).alias(f"p{i}"))]).first()
    rows = [(name, cut, one[f"a{i}"], one[f"b{i}"], int(one[f"p{i}"]), one[f"a{i}"] >= min_train and one[f"b{i}"] >= least and 0 < one[f"p{i}"] < one[f"b{i}"]) for i, (name, cut, _, _) in enumerate(known)]
    sets = [(name, a, b, features) for (name, _, a, b), r in zip(known, rows, strict=True) if r[5]]
    table = spark.createDataFrame(rows, schema)
    if not sets:
        return table.withColumn("auc", F.lit(None).cast("double"))
    pooled = fit_all(panel, sets)
    scores = auc_by_name(pooled.unionByName(pooled.withColumn("name", F.lit("pooled"))))
    total = scores.filter("name = 'pooled'").select(F.col("name").alias("fold"), F.lit(None).cast("date").alias("cut"), F.lit(None).cast("long").alias("train_rows"), "rows", "positives", F.lit(True).alias("kept"), "auc")
    return table.join(scores.select(F.col("name").alias("fold"), "auc"), "fold", "left").unionByName(total)


def group_k_fold(panel: DataFrame, features: Sequence[str], entity: str, k: int = 5) -> DataFrame:
    """AUC of each fold of entities under a model of the other folds, and their mean; a fold of one class has none."""
    p = cut_lineage(panel.withColumn("_fold", group_fold(F.col(entity), k)))
    s = auc_by_name(fit_all(p, [(str(i), F.col("_fold") != i, F.col("_fold") == i, features) for i in range(k)]))
    mean = s.agg(F.lit("mean").alias("name"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.round(F.avg("auc"), 6).alias("auc"))
    return s.unionByName(mean).withColumnRenamed("name", "fold")


def weighted_blocks(panel: DataFrame, features: Sequence[str], day: str, horizon_days: int, blocks: int = 4) -> DataFrame:
    """Each block of dates is tested under a model of what was known before its first day; the average weighs later blocks double."""
    b = time_blocks(panel, day, blocks)
    p = cut_lineage(panel.join(F.broadcast(b.select(day, "block")), day))                                       # one row for each date
    first = {r.block: r.first for r in b.groupBy("block").agg(F.min(day).alias("first")).collect()}             # few blocks
    known = {i: F.date_add(day, horizon_days) <= F.lit(first[i]) for i in first if i > 0}
    both = p.agg(*[F.count_distinct(F.when(x, F.col("y"))).alias(str(i)) for i, x in known.items()]).first() if known else {}
    sets = [(str(i), x, F.col("block") == i, features) for i, x in known.items() if both[str(i)] == 2]
    if not sets:
        return panel.sparkSession.createDataFrame([], "block string, rows long, positives long, auc double, weight double")
    s = auc_by_name(fit_all(p, sets)).withColumn("weight", F.pow(F.lit(2.0), F.col("name").cast("int") - 1))
    w = F.when(F.col("auc").isNotNull(), F.col("weight"))
    total = s.agg(F.lit("weighted").alias("name"), F.sum("rows").alias("rows"), F.sum("positives").alias("positives"), F.round(F.sum(F.col("auc") * w) / F.sum(w), 6).alias("auc"), F.sum(w).alias("weight"))
    return s.unionByName(total).withColumnRenamed("name", "block")


def isotonic_check(scores: DataFrame, k: int = 3) -> DataFrame:
    """Calibrate on pooled out-of-fold scores; Brier score before and after."""
    s = cut_lineage(scores.select("customer", "y", "p").withColumn("fold", group_fold(F.col("customer"), k)))
    parts = None
    for f in range(k):
        iso = IsotonicRegression(featuresCol="p", labelCol="y", predictionCol="q").fit(s.filter(F.col("fold") != f).select("p", F.col("y").cast("double").alias("y")))
        p = iso.transform(s.filter(F.col("fold") == f).select("y", "p"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.agg(F.count(F.lit(1)).alias("rows"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier_raw"), F.avg((F.col("q") - F.col("y")) ** 2).alias("brier_calibrated"))


def permuted(rows: DataFrame, features: Sequence[str], key: Sequence[str], repeats: int) -> DataFrame:
    """(feature, repeat, y, features): the rows once for each feature and repeat, with that feature's values re-dealt among them.

    In a repeat every row has one donor: the row at its place in an order by hash. One sort orders all repeats, and the copies are made
    after the join, so a row is shuffled once for each repeat and not for each feature.
    """
    u = lambda *x: F.pmod(F.xxhash64(*key, *x), F.lit(1 << 40)) / float(1 << 40)
    own = cut_lineage(rows.select(*key, "y", *features).withColumn("_at", u()))
    base = X.ordered_position(own, ["_at", *key]).select("position", "n_rows", "y", F.struct(*features).alias("own"))
    dealt = own.select(*key, F.struct(*features).alias("donor"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat")).withColumn("_at", F.col("repeat") + u(F.col("repeat")))
    donors = X.ordered_position(dealt, ["_at", *key]).select("repeat", (F.col("position") - F.col("repeat") * F.floor(F.col("n_rows") / repeats)).alias("position"), "donor")
    met = base.join(donors, "position")
    each = F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col("donor" if g == f else "own")[g].alias(g) for g in features]) for f in features])
    return met.select("repeat", "y", F.explode(each).alias("x")).select("repeat", "y", "x.*")


def permutation_importance(panel: DataFrame, features: Sequence[str], day: str, horizon_days: int, repeats: int = 5) -> DataFrame:
    """AUC lost after the cut when one feature is shuffled among the test rows: mean and spread over the repeats.

    All features and repeats are scored by one model in one stacked table.
    """
    panel = cut_lineage(panel)
    train, test = time_split(panel, day, 0.75, horizon_days)
    m = classifier("logistic", features).fit(train)
    ref = _auc(predict(m, test))
    scored = predict(m, permuted(test, features, ["customer", day], repeats)).select(F.concat_ws("|", "feature", "repeat").alias("name"), "y", "p")
    drop = F.lit(ref) - F.col("auc")
    return auc_by_name(scored).groupBy(F.element_at(F.split("name", r"\|"), 1).alias("feature")).agg(
        F.count(F.lit(1)).alias("repeats"), F.round(F.avg(drop), 6).alias("auc_drop"), F.round(F.stddev_pop(drop), 6).alias("spread"))


def leak_audit(panel: DataFrame, features: Sequence[str], entity: str, k: int = 5, without: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """The same model by entity folds and by row folds, all k of each: a gap means entities are memorised. Ablations drop features.

    `auc` is of all out-of-fold predictions together, `mean_auc` the mean of the folds'.
    """
    p = cut_lineage(panel.withColumns({"by_entity": group_fold(F.col(entity), k), "by_row": group_fold(F.concat_ws("|", *[F.col(x).cast("string") for x in panel.columns]), k)}))
    variants = [("entity_split", "by_entity", list(features)), ("row_split", "by_row", list(features))]
    variants += [("without_" + "_".join(gone), "by_entity", [f for f in features if f not in gone]) for gone in ([[f] for f in features[:1]] if without is None else without)]
    pooled = fit_all(p, [(f"{name}|{i}", F.col(fold) != i, F.col(fold) == i, feats) for name, fold, feats in variants for i in range(k)])
    variant = F.element_at(F.split("name", r"\|"), 1)
    folds = auc_by_name(pooled).groupBy(variant.alias("variant")).agg(F.count("auc").alias("folds"), F.round(F.avg("auc"), 6).alias("mean_auc"))
    whole = auc_by_name(pooled.withColumn("name", variant)).select(F.col("name").alias("variant"), "rows", "auc")
    size = p.sparkSession.createDataFrame([(name, len(feats)) for name, _, feats in variants], "variant string, features int")
    return size.join(folds, "variant").join(whole, "variant")


def cold_start(credit: DataFrame, cut: str) -> DataFrame:
    """Only customers first seen after the cut are tested; categories unseen in training get their own index."""
    first = credit.groupBy("customer").agg(F.min("date").alias("first"))
    c = cut_lineage(credit.join(first, "customer").select("customer", "date", "first", "y", "log_ttc", "month_no", "quarter", "weekday", "mode"))
    train, test = c.filter(F.col("date") <= cut), c.filter(F.col("first") > cut)
    idx = StringIndexer(inputCol="mode", outputCol="mode_ix", handleInvalid="keep", stringOrderType="alphabetAsc")
    feats = ["log_ttc", "month_no", "quarter", "weekday", "mode_ix"]
    m = Pipeline(stages=[idx, classifier("logistic", feats)]).fit(train)
    p = predict(m, test)
    return p.agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("customer").alias("customers"), F.avg("y").alias("positive_rate")).withColumn("auc", scalar(X.auc(p)))


def revenue_regression(panel: DataFrame, features: Sequence[str], day: str) -> DataFrame:
    """Ridge on the log target against boosted absolute loss and persistence, after the cut."""
    p = cut_lineage(panel.withColumn("ly", F.log1p("future_revenue")))
    train, test = time_split(p, day, 0.75, 92)
    va = VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep")
    ridge = Pipeline(stages=[va, StandardScaler(inputCol="raw", outputCol="x", withMean=True), LinearRegression(featuresCol="x", labelCol="ly", regParam=0.1, elasticNetParam=0.0)])
    boost = Pipeline(stages=[va, GBTRegressor(featuresCol="raw", labelCol="ly", lossType="absolute", maxDepth=3, maxIter=10, seed=SEED)])
    out = test.select(F.lit("persistence").alias("model"), F.col("future_revenue").alias("y"), F.col("rev_3m").alias("yhat"))
    for name, est in (("ridge_log", ridge), ("boosted_absolute", boost)):
        pred = est.fit(train).transform(test)
        out = out.unionByName(pred.select(F.lit(name).alias("model"), F.col("future_revenue").alias("y"), F.expm1(F.least("prediction", F.lit(25.0))).alias("yhat")))
    return X.error_block(out, ["model"])


def residual_columns(features: DataFrame, h: int = 1) -> DataFrame:
    """Median-of-three baseline and the signed-log residual to learn."""
    a, b, c = F.col("ma_3") * h, F.col("lag_12") * h, F.col("lag_1") * h
    med = F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))
    base = F.greatest(med, F.lit(0.0))
    r = F.col(f"y_h{h}") - F.col("baseline")
    return features.withColumn("baseline", base).withColumn("residual", F.signum(r) * F.log1p(F.abs(r)))


def residual_learning(features: DataFrame, names: Sequence[str], day: str) -> DataFrame:
    """Baseline plus learned residual, clipped on the way back, against the baseline alone."""
    d = cut_lineage(residual_columns(features).select(day, "y_h1", "baseline", "residual", *names))
    train, test = time_split(d, day, 0.75, 31)
    bound = scalar(train.agg(F.percentile_approx(F.abs("residual"), 0.99, 1000)))
    m = Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="raw", handleInvalid="keep"),
                         GBTRegressor(featuresCol="raw", labelCol="residual", maxDepth=3, maxIter=8, seed=SEED)]).fit(train)
    r = F.greatest(F.least(F.col("prediction"), bound), -bound)
    back = F.greatest(F.col("baseline") + F.signum(r) * F.expm1(F.abs(r)), F.lit(0.0))
    p = m.transform(test)
    rows = p.select(F.lit("baseline").alias("model"), F.col("y_h1").alias("y"), F.col("baseline").alias("yhat")).unionByName(
        p.select(F.lit("residual").alias("model"), F.col("y_h1").alias("y"), back.alias("yhat")))
    return X.error_block(rows, ["model"])


def expected_stakes(panel: DataFrame, current: DataFrame, features: Sequence[str], key: str, amount: str, k: int = 15) -> DataFrame:
    """Probability times amount at stake on the latest state of every entity, highest first."""
    m = classifier("logistic", features).fit(cut_lineage(panel))
    s = predict(m, current).withColumn("stake", F.col("p") * F.col(amount))
    return s.orderBy(F.col("stake").desc(), key).limit(k).select(key, F.round("p", 6).alias("probability"), F.round(amount, 2).alias("amount"), F.round("stake", 2).alias("stake"))


def open_quote_protocol(quotes: DataFrame, panel: DataFrame, max_age: int = 120) -> DataFrame:
    """Open quotes by recommended action, with the probability observed in their amount band."""
    band = lambda h: F.when(h < 5000, 0).when(h < 20000, 1).when(h < 100000, 2).otherwise(3)
    rate = panel.groupBy(band(F.col("ht")).alias("band")).agg(F.avg("y").alias("p"))
    age = F.datediff(scalar(quotes.agg(F.max("date"))), "date")
    o = quotes.filter(~F.col("converted")).withColumns({"band": band(F.col("ht")), "age": age}).filter(F.col("age") <= max_age).join(F.broadcast(rate), "band")   # four bands
    g = o.groupBy(R.quote_action(F.col("ht"), F.col("p")).alias("protocol"), "age").agg(F.count(F.lit(1)).alias("n"), F.sum("ht").alias("a"), F.sum(F.col("ht") * F.col("p")).alias("e"))
    return g.groupBy("protocol").agg(F.sum("n").alias("quotes"), F.round(F.sum("a"), 2).alias("amount"), F.round(F.sum("e"), 2).alias("expectation"),
                                     F.percentile("age", F.lit(0.5), F.col("n")).alias("median_age"))


# ---------------------------------------------------------------- segments

def _kmeans(features: Sequence[str], k: int, seed: int = SEED) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
                            KMeans(featuresCol="x", predictionCol="segment", k=k, seed=seed)])


def rand_index(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings from their contingency table."""
    t = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda n: n * (n - 1) / 2.0
    one = F.lit(1).alias("k")
    s = t.agg(F.sum(c2(F.col("n"))).alias("s"), F.sum("n").alias("n")).select(one, "*")
    ra = t.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("sa")).select(one, "sa")
    rb = t.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n"))).alias("sb")).select(one, "sb")
    e = F.col("sa") * F.col("sb") / c2(F.col("n"))
    return s.join(ra, "k").join(rb, "k").select(F.coalesce(F.try_divide(F.col("s") - e, (F.col("sa") + F.col("sb")) / 2.0 - e), F.lit(1.0)).alias("ari"))


def segment_quality(profiles: DataFrame, features: Sequence[str], ks: Sequence[int] = (3, 4, 5, 6), resamples: int = 8) -> DataFrame:
    """Silhouette and resample stability (median adjusted Rand index) per number of segments; resamples are fitted a few at a time."""
    p = cut_lineage(profiles)

    def whole(k):
        lab = cut_lineage(_kmeans(features, k).fit(p).transform(p).select("customer", F.col("segment").alias("s0"), "x"))
        return lab, ClusteringEvaluator(featuresCol="x", predictionCol="s0").evaluate(lab)

    def again(job):
        k, r = job
        part = p.filter(F.pmod(F.xxhash64("customer", F.lit(r)), F.lit(5)) != 0)          # four fifths, by hash
        other = _kmeans(features, k).fit(part).transform(part).select("customer", F.col("segment").alias("s1"))
        return rand_index(labels[k][0].select("customer", "s0").join(other, "customer"), "s0", "s1").first()["ari"]
    labels = dict(zip(ks, _each(whole, ks), strict=True))
    jobs = [(k, r) for k in ks for r in range(resamples)]
    aris = dict(zip(jobs, _each(again, jobs), strict=True))

    def median(v):
        v = sorted(v)
        return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
    return p.sparkSession.createDataFrame([(k, float(labels[k][1]), float(median([aris[k, r] for r in range(resamples)]))) for k in ks], "k int, silhouette double, stability double")


def segment_churn(profiles: DataFrame, churn: DataFrame, features: Sequence[str], k: int = 5) -> DataFrame:
    """Segments relabelled by mean revenue, crossed with the observed churn rate."""
    p = cut_lineage(profiles)
    s = _kmeans(features, k).fit(p).transform(p).select("customer", "segment", "revenue")
    order = s.groupBy("segment").agg(F.avg("revenue").alias("m"))
    rank = order.select("segment", F.row_number().over(Window.orderBy(F.col("m").desc())).alias("rank"))       # k rows
    per = churn.groupBy("customer").agg(F.avg("y").alias("rate"))
    return s.join(F.broadcast(rank), "segment").join(per, "customer", "left").groupBy("rank").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("revenue"), 2).alias("revenue"), F.round(F.avg("rate"), 6).alias("churn_rate"))


# ---------------------------------------------------------------- credit rule and leakage diagnostics

def _billed(sales: DataFrame) -> DataFrame:
    return sales.filter(~F.col("is_credit") & F.col("delay_days").isNotNull())


def credit_rule(sales: DataFrame, threshold: int = 60, min_history: int = 3) -> DataFrame:
    """Score 100 or 0 by the customer's own past norm, base rate when the history is too short."""
    c, s = F.col, _billed(sales)
    d = s.groupBy("customer", "date", "delay_days").agg(F.count(F.lit(1)).alias("n"), F.sum("ttc").alias("t"))
    w = Window.partitionBy("customer").orderBy(F.datediff("date", F.lit("1970-01-01").cast("date"))).rangeBetween(Window.unboundedPreceding, -1)
    h = d.withColumn("prior", F.coalesce(F.sum("n").over(w), F.lit(0)))
    norm = h.filter(c("prior") >= min_history).groupBy("customer", "delay_days").agg(F.sum("n").alias("n")).groupBy("customer").agg(
        F.percentile("delay_days", F.lit(0.5), c("n")).alias("norm"))
    per = d.groupBy("customer").agg(F.sum("t").alias("exposure"), F.sum("n").alias("documents"), (F.sum(c("n") * c("delay_days")) / F.sum("n")).alias("mean_delay"))
    base = scalar(s.agg(F.avg((c("delay_days") > threshold).cast("int")) * 100))
    known = c("norm").isNotNull()
    return per.join(norm, "customer", "left").select(
        "customer", F.when(known, F.when(c("norm") > threshold, 100.0).otherwise(0.0)).otherwise(base).alias("score"), "exposure", "documents", "mean_delay",
        F.when(known, "history_rule").otherwise("base_rate").alias("source"))


def rule_out_of_period(sales: DataFrame, cut: str, threshold: int = 60, min_history: int = 3) -> DataFrame:
    """Norms from documents up to the cut, judged on later documents."""
    s = _billed(sales)
    h = s.filter(F.col("date") <= F.lit(cut)).groupBy("customer", "delay_days").agg(F.count(F.lit(1)).alias("n"))
    norm = h.groupBy("customer").agg(F.percentile("delay_days", F.lit(0.5), F.col("n")).alias("p"), F.sum("n").alias("n")).filter(F.col("n") >= min_history)
    e = s.filter(F.col("date") > F.lit(cut)).join(norm, "customer").select((F.col("delay_days") > threshold).cast("int").alias("y"), "p")
    return e.agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg(((F.col("p") > threshold) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy")).withColumn(
        "auc", F.round(scalar(X.auc(e)), 6))


def delay_tautology(sales: DataFrame, min_n: int = 5) -> DataFrame:
    """Within-customer against global spread of the granted delay."""
    s = _billed(sales)
    per = s.groupBy("customer").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("delay_days").alias("s")).filter(F.col("n") >= min_n)
    return exact_quantiles(per, "s", [0.5]).select(F.round("quantile", 6).alias("median_within_std"), F.round(scalar(s.agg(F.stddev_samp("delay_days"))), 6).alias("global_std"))


def proxy_rates(sales: DataFrame, column: str, threshold: int = 60) -> DataFrame:
    """Target rate and median delay per value of a suspected proxy."""
    h = distinct_values(_billed(sales), "delay_days", [column])
    d = F.col("delay_days")
    return h.groupBy(F.col(column).alias("value")).agg(F.sum("n").alias("n"), (R.sum_where(F.col("n"), d > threshold) / F.sum("n")).alias("r"),
                                                       F.percentile("delay_days", F.lit(0.5), F.col("n")).alias("median_delay")).select(
        "value", "n", F.round(F.coalesce("r", F.lit(0.0)), 6).alias("target_rate"), "median_delay")


def delay_structure_drift(sales: DataFrame, months: int = 4) -> DataFrame:
    """Granted delays of the last months against the rest."""
    s = _billed(sales).withColumn("delay_days", F.col("delay_days").cast("double"))
    recent = F.col("date") >= F.add_months(F.trunc(scalar(s.agg(F.max("date"))), "month"), 1 - months)
    ref, cur = s.filter(~recent), s.filter(recent)
    short = (F.col("delay_days") <= 62).cast("int")
    v = X.psi(ref, cur, ["delay_days"]).select("psi")
    return v.select("psi", F.round(scalar(ref.agg(F.avg(short))), 6).alias("share_reference"), F.round(scalar(cur.agg(F.avg(short))), 6).alias("share_current"))


# ---------------------------------------------------------------- comparison and registry

def paired(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two methods side by side, with a flag telling whether every row was matched."""
    both = a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), list(keys))
    full = (scalar(a.agg(F.count(F.lit(1)))) == scalar(both.agg(F.count(F.lit(1))))) & (scalar(b.agg(F.count(F.lit(1)))) == scalar(both.agg(F.count(F.lit(1)))))
    return both.withColumn("full_coverage", full)


def registry_decision(metrics: DataFrame, reference: str, min_gain: float = 0.02) -> DataFrame:
    """Best challenger against the reference: served only when the gain is large enough."""
    c = F.col
    best = metrics.filter(c("candidate") != reference).groupBy("model").agg(F.max(F.struct("metric", "candidate")).alias("b"))
    ref = metrics.filter(c("candidate") == reference).select("model", c("metric").alias("reference"))
    gain = c("b.metric") - c("reference")
    return best.join(ref, "model").select("model", c("b.candidate").alias("candidate"), c("b.metric").alias("metric"), "reference", F.round(gain, 6).alias("gain"),
                                          (gain >= min_gain).alias("deployed"), F.when(gain >= min_gain, "beats the reference").otherwise("gain below the threshold").alias("reason"))


def degradation(history: DataFrame, order: str, limit: float = 0.10) -> DataFrame:
    """Relative change of each model's metric between successive trainings; a drop beyond the limit is flagged."""
    w = Window.partitionBy("model").orderBy(order)
    prev = F.lag("metric").over(w)
    change = (F.col("metric") - prev) / F.abs(prev)
    return history.select("model", order, F.round(change, 6).alias("change"), F.coalesce(change < -limit, F.lit(False)).alias("degraded"))
