"""Served models: one decision for each training, an append-only registry of decisions, and score tables that findings read.

A model is trained before a cut, measured after it and decided upon against the best reference. Only a model that is served gets a score
table. A version's score tables are written before its decisions are appended, so a lost job leaves the version before in place.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.functions import rules as R
from tradewright.operators.actions import Findings, finding
from tradewright.operators.learning import classifier, predict, time_split
from tradewright.session import cut_lineage

MIN_GAIN_AUC, DEGRADED = 0.02, 0.10
MIN_GAIN_REVENUE, MIN_SPEARMAN = 0.05, 0.70             # share of the reference's median error, rank agreement
FLAGGED = 0.5                      # probability from which a customer is named
NAMED = 15                         # customers a margin finding names
DECISION = "model string, candidate string, metric_name string, metric double, reference_name string, reference double, gain double, higher_is_better boolean, deployed boolean, reason string"
SCORES = ("entity", "customer", "probability", "amount", "stake")


class Trained(NamedTuple):
    """A one-row decision and, if the model is served, its scores (entity, customer, probability, amount, stake)."""
    decision: DataFrame
    scores: DataFrame | None


def decide(spark: SparkSession, model: str, candidate: str, metric_name: str, metric: float | None, reference_name: str | None, reference: float | None, min_gain: float,
           higher_is_better: bool = True, against: str | None = None) -> tuple[DataFrame, bool]:
    """Served only if it beats the reference by `min_gain` and nothing else speaks `against` it; what cannot be measured is refused."""
    gain = None if metric is None or reference is None else round((metric - reference) if higher_is_better else (reference - metric), 6)
    ok = gain is not None and gain >= min_gain and against is None
    reason = "not measurable" if gain is None else "gain below the threshold" if gain < min_gain else against or "beats the reference"
    return spark.createDataFrame([(model, candidate, metric_name, metric, reference_name, reference, gain, higher_is_better, ok, reason)], DECISION), ok


def latest(panel: DataFrame, entity: str, day: str) -> DataFrame:
    """The newest row of every entity."""
    w = Window.partitionBy(entity).orderBy(F.col(day).desc())
    return panel.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def train_classifier(model: str, panel: DataFrame, current: DataFrame, features: Sequence[str], baselines: dict[str, int], day: str, horizon_days: int, entity: str, amount: Column) -> Trained:
    """AUC after the cut against the best variable alone; a served model is refitted on the whole panel. stake = probability * amount."""
    spark, panel = panel.sparkSession, cut_lineage(panel.select(day, "y", *dict.fromkeys([*features, *baselines])))
    train, test = time_split(panel, day, 0.75, horizon_days)
    known = [df.agg(F.count_distinct("y")).first()[0] for df in (train, test)]
    auc = best = None
    if known == [2, 2]:
        auc = X.auc(predict(classifier("logistic", features).fit(train), test)).first()["auc"]
        best = X.one_variable_baselines(test, baselines).agg(F.max(F.struct("auc", "baseline")).alias("b")).first()["b"]
    decision, ok = decide(spark, model, "logistic", "auc", auc, best and best["baseline"], best and best["auc"], MIN_GAIN_AUC)
    if not ok:
        return Trained(decision, None)
    scored = predict(classifier("logistic", features).fit(panel), current)
    return Trained(decision, scored.select(F.col(entity).cast("string").alias("entity"), F.col("customer").cast("string").alias("customer"), F.col("p").alias("probability"), amount.alias("amount"),
                                           (F.col("p") * amount).alias("stake")))


def train_revenue(model: str, panel: DataFrame, current: DataFrame, features: Sequence[str], day: str, horizon_days: int, target: str, persistence: str) -> Trained:
    """Ridge on the log target against persistence, by the median absolute error after the cut: few customers would decide a mean. It must
    also rank as the customers turn out. amount is what was observed, stake what is expected; there is no probability.
    """
    spark, p = panel.sparkSession, cut_lineage(panel.select(day, target, *dict.fromkeys([persistence, *features])).withColumn("ly", F.log1p(target)))
    est = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="x", withMean=True),
                           LinearRegression(featuresCol="x", labelCol="ly", regParam=0.1, elasticNetParam=0.0)])
    train, test = time_split(p, day, 0.75, horizon_days)
    metric = reference = against = None
    min_gain = 0.0
    if train.limit(2).count() == 2 and not test.isEmpty():
        scored = cut_lineage(est.fit(train).transform(test).select(F.col(target).alias("y"), F.expm1("prediction").alias("yhat"), F.col(persistence).alias("kept")))
        error = lambda x: X.median_errors(scored.select("y", x.alias("yhat"))).first()["median_abs_error"]
        metric, reference = error(F.col("yhat")), error(F.col("kept"))
        rho = X.spearman(scored, "y", "yhat").first()["spearman"]
        min_gain = MIN_GAIN_REVENUE * reference
        against = None if (rho or 0.0) >= MIN_SPEARMAN else "does not rank the customers"
    decision, ok = decide(spark, model, "ridge_log", "median_abs_error", metric, persistence, reference, min_gain, higher_is_better=False, against=against)
    if not ok:
        return Trained(decision, None)
    expected = F.greatest(F.expm1("prediction"), F.lit(0.0))
    return Trained(decision, est.fit(p).transform(current).select(F.col("customer").cast("string").alias("entity"), F.col("customer").cast("string").alias("customer"),
                                                                  F.lit(None).cast("double").alias("probability"), F.col(persistence).alias("amount"), expected.alias("stake")))


# ---------------------------------------------------------------- registry

def history(spark: SparkSession, folder: str) -> DataFrame:
    """Every decision ever published, with its version; no rows before the first."""
    try:
        return spark.read.parquet(f"{folder}/decisions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], DECISION + ", version string, published_at timestamp")


def publish(spark: SparkSession, folder: str, version: str, trained: Sequence[Trained]) -> DataFrame:
    """Write the score tables of the served models, then append all decisions of the version; a version is published once."""
    if not history(spark, folder).filter(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is published already")
    decisions = reduce(DataFrame.unionByName, [t.decision for t in trained])
    for t in trained:
        if t.scores is not None:
            name = t.decision.first()["model"]
            t.scores.select(*SCORES).write.mode("overwrite").parquet(f"{folder}/scores/{name}/version={version}")
    stamped = decisions.withColumns({"version": F.lit(version), "published_at": F.current_timestamp()})
    stamped.coalesce(1).write.mode("append").parquet(f"{folder}/decisions")             # one row for each model
    return state(spark, folder)


def state(spark: SparkSession, folder: str, limit: float = DEGRADED) -> DataFrame:
    """The newest decision of every model, with the change of its metric since the one before; a fall beyond the limit is flagged."""
    w = Window.partitionBy("model").orderBy("published_at", "version")
    before = F.lag("metric").over(w)
    last = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("published_at"), F.desc("version")))
    change = F.when(before != 0, (F.col("metric") - before) / F.abs(before))
    rows = history(spark, folder).withColumns({"change": F.round(change, 6), "_r": last}).filter("_r = 1").drop("_r")
    worse = F.when(F.col("higher_is_better"), F.col("change") < -limit).otherwise(F.col("change") > limit)
    return rows.withColumn("degraded", F.coalesce(worse, F.lit(False)))


def served(spark: SparkSession, folder: str, model: str) -> DataFrame | None:
    """The score table of the newest version, or None if the newest decision refused the model or there is none."""
    row = state(spark, folder).filter(F.col("model") == model).first()
    if row is None or not row.deployed:
        return None
    return spark.read.parquet(f"{folder}/scores/{model}/version={row.version}")


# ---------------------------------------------------------------- findings from served scores

def top_movements(scores: DataFrame, n: int = 10) -> DataFrame:
    """(customer, observed_rank, expected_rank, observed, expected, movement) of customers in the top n observed or expected: `in`, `out` or `stays`."""
    def top(by, rank):
        rows = scores.select("customer", by).orderBy(F.col(by).desc_nulls_last(), "customer").limit(n)                    # n rows
        return rows.select("customer", F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), "customer")).alias(rank))
    both = top("amount", "observed_rank").join(top("stake", "expected_rank"), "customer", "full")
    move = F.when(F.col("observed_rank").isNull(), "in").when(F.col("expected_rank").isNull(), "out").otherwise("stays")
    return scores.join(F.broadcast(both), "customer").select("customer", "observed_rank", "expected_rank", F.col("amount").alias("observed"), F.col("stake").alias("expected"), move.alias("movement"))


def model_findings(tables: dict[str, DataFrame | None], names: DataFrame, severity: Column) -> list[Findings]:
    """A finding for each served model among churn, margin, quotes and revenue; a refused one has none."""
    who = names.select(F.col("customer").cast("string").alias("customer"), "customer_name")
    named = {m: s.join(who, "customer", "left") for m, s in tables.items() if s is not None}
    out = []
    if "churn" in named:
        out.append(finding(named["churn"].filter(F.col("probability") > FLAGGED), "retention", "customers likely to leave", severity, "customer", "customer_name", "stake"))
    if "margin" in named:
        first = named["margin"].orderBy(F.col("stake").desc(), "customer").limit(NAMED)
        out.append(finding(first, "profitability", "margin erosion expected", severity, "customer", "customer_name", "stake"))
    if "quotes" in named:
        out.append(finding(named["quotes"], "commercial", "open quotes to follow up", severity, "entity", "customer_name", "stake"))
    if "revenue" in named:
        moves = cut_lineage(top_movements(named["revenue"]).join(who, "customer", "left"))
        label = [F.lit("portfolio").alias("domain"), F.lit("movements in the top ten").alias("title")]
        leaving = moves.filter("movement = 'out'").select(*label, F.col("customer").alias("code"), F.col("customer_name").alias("name"), F.lit(0.0).alias("amount"))
        head = moves.agg(F.coalesce(R.sum_where(F.col("observed"), F.col("movement") == "in"), F.lit(0.0)).alias("amount"), R.count_where(F.col("movement") != "stays").alias("n_targets"),
                         F.when(R.count_where(F.col("movement") == "out") > 0, "medium").otherwise("low").alias("severity"))
        out.append(Findings(head.select(*label, "severity", "amount", "n_targets"), leaving))
    return out
