"""Evaluation metrics as Spark aggregations over (y, score) rows.

Rank-based metrics collapse rows to distinct scores first, so ties cost one row however many they
are, and use bucketed running totals instead of a global window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.bootstrap import bootstrap_auc_gap, bootstrap_gap  # noqa: F401
from tradewright.functions.scale import exact_quantiles, range_buckets, running_totals, scalar
from tradewright.session import cut_lineage


def score_table(df: DataFrame, y: str = "y", score: str = "p") -> DataFrame:
    """One row per distinct score with its positives and negatives."""
    return df.groupBy(score).agg(F.coalesce(R.sum_where(F.lit(1), F.col(y) == 1), F.lit(0)).alias("pos"),
                                 F.coalesce(R.sum_where(F.lit(1), F.col(y) != 1), F.lit(0)).alias("neg"))


def auc(df: DataFrame, y: str = "y", score: str = "p") -> DataFrame:
    """Tie-aware ROC area."""
    r = running_totals(score_table(df, y, score), score, ["pos", "neg"])
    num = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return r.agg(R.ratio(num, F.max("pos_total").cast("double") * F.max("neg_total")).alias("auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "p") -> DataFrame:
    r = running_totals(score_table(df, y, score), score, ["pos", "neg"], descending=True)
    tp = F.col("pos_before") + F.col("pos")
    return r.agg(R.ratio(F.sum(F.col("pos") * tp / (tp + F.col("neg_before") + F.col("neg"))), F.max("pos_total").cast("double")).alias("average_precision"))


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg(F.pow(F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) - F.col(y), F.lit(2))).alias("brier"))


def ranking_metrics(df: DataFrame) -> DataFrame:
    one = lambda d: d.withColumn("_k", F.lit(1))
    return one(auc(df)).join(one(average_precision(df)), "_k").join(one(brier(df)), "_k").select(
        F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"), F.round("brier", 6).alias("brier"))


def confusion_block(df: DataFrame, decision: Column, y: str = "y") -> DataFrame:
    """Counts and every derived score of a binary decision; degenerate denominators give zero."""
    t, d = F.col(y) == 1, F.coalesce(decision, F.lit(False))
    n = lambda cond: R.count_where(cond).cast("double")
    a = df.agg(n(t & d).alias("tp"), n(~t & d).alias("fp"), n(t & ~d).alias("fn"), n(~t & ~d).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn
    z = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    prec, rec, spec = z(tp, tp + fp), z(tp, tp + fn), z(tn, tn + fp)
    acc = z(tp + tn, total)
    pe = z((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), total * total)
    rate = z(tp + fn, total)
    vals = {"accuracy": acc, "balanced_accuracy": (rec + spec) / 2, "precision": prec, "recall": rec, "specificity": spec, "f1": z(2 * tp, 2 * tp + fp + fn),
            "mcc": z(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), "kappa": z(acc - pe, 1 - pe), "majority_accuracy": F.greatest(rate, 1 - rate)}
    return a.select(*[F.col(x).cast("long").alias(x) for x in ("tp", "fp", "fn", "tn")], *[F.round(v, 6).alias(k) for k, v in vals.items()])


def best_f1_threshold(df: DataFrame, y: str = "y", score: str = "p", points: int = 99) -> DataFrame:
    """F1-maximising threshold among `points` quantiles; the scores are counted per quantile interval in one pass."""
    probs = [0.01 + i * 0.98 / (points - 1) for i in range(points)]
    cuts = sorted({r["quantile"] for r in exact_quantiles(df, score, probs).collect()})       # at most 99 numbers
    splits = [float("-inf"), *cuts, float("inf")]
    b = Bucketizer(splits=splits, inputCol=score, outputCol="_b").transform(df.select(F.col(y).alias("y"), F.col(score).cast("double").alias(score)))
    g = b.groupBy("_b").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("_b").desc())                                                     # at most 100 rows
    above = g.select("_b", F.sum("pos").over(w).alias("tp"), F.sum("n").over(w).alias("k"), F.sum("pos").over(Window.partitionBy()).alias("P"))
    f1 = F.round(2.0 * F.col("tp") / (F.col("k") + F.col("P")), 12)
    best = above.filter("_b >= 1").withColumn("f1", f1).orderBy(F.col("f1").desc(), "_b").limit(1)
    values = F.array(*[F.lit(float(x)) for x in cuts])
    return best.select(F.round(F.element_at(values, F.col("_b").cast("int")), 6).alias("threshold"), F.round("f1", 6).alias("f1"))


def one_variable_baselines(df: DataFrame, directions: dict[str, int], y: str = "y") -> DataFrame:
    """AUC of each variable used alone in a direction fixed beforehand; all baselines in one pass."""
    pairs = ", ".join(f"'{v}', cast({'-' if s < 0 else ''}`{v}` as double)" for v, s in directions.items())
    long = df.selectExpr(f"`{y}` as y", f"stack({len(directions)}, {pairs}) as (baseline, p)").filter("p is not null")
    t = long.groupBy("baseline", "p").agg(F.sum(F.col("y")).alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    return grouped_auc(t, "baseline")


def grouped_auc(table: DataFrame, key: str, buckets: int = 200) -> DataFrame:
    """AUC per group from (key, p, pos, neg) rows: ranks within score buckets, offsets from bucket totals."""
    b = range_buckets(cut_lineage(table), "p", buckets=buckets)
    tot = b.groupBy(key, "_bucket").agg(F.sum("neg").alias("bn"))
    off = tot.withColumn("off", F.coalesce(F.sum("bn").over(Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bn")
    w = Window.partitionBy(key, "_bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    x = b.withColumn("loc", F.coalesce(F.sum("neg").over(w), F.lit(0))).join(off, [key, "_bucket"])
    return x.groupBy(key).agg((F.sum(F.col("pos") * (F.col("off") + F.col("loc") + F.col("neg") / 2.0)) / (F.sum("pos") * F.sum("neg"))).alias("auc")).select(
        key, F.round("auc", 6).alias("auc"))


# ---------------------------------------------------------------- calibration and top decile

def calibration(df: DataFrame, key: str, groups: int = 10) -> DataFrame:
    """Mean prediction against observed rate in rank groups of equal size (first n mod k groups one larger).

    Positions come from bucketed running counts over distinct (p, key) pairs.
    """
    v = df.select("y", "p", key).withColumn("n", F.lit(1))
    pos = ordered_position(v, ["p", key])
    n, i = F.col("n_rows"), F.col("position") - 1
    base, extra = F.floor(n / groups), n % groups
    cut = extra * (base + 1)
    grp = F.when(i < cut, F.floor(i / (base + 1))).otherwise(extra + F.floor((i - cut) / F.greatest(base, F.lit(1)))).cast("int") + 1
    return pos.withColumn("grp", grp).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), F.avg("p").alias("mp"), F.avg("y").alias("my"),
                                                         F.min("p").alias("lo"), F.max("p").alias("hi")).select(
        F.col("grp").alias("rank_group"), "n", "positives", F.round("mp", 6).alias("mean_predicted"), F.round("my", 6).alias("observed"), F.round("lo", 6).alias("low"), F.round("hi", 6).alias("high"))


def calibration_error(groups: DataFrame) -> DataFrame:
    gap = F.col("mean_predicted") - F.col("observed")
    return groups.agg((F.sum(F.abs(gap) * F.col("n")) / F.sum("n")).alias("e"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("b")).select(
        F.round("e", 5).alias("ece"), F.round("b", 5).alias("bias"))


def ordered_position(df: DataFrame, order: Sequence[str], descending: bool = False) -> DataFrame:
    """1-based position of every row in a total order led by a numeric column, without a global window."""
    lead = order[0]
    b = range_buckets(cut_lineage(df).withColumn("_v", F.col(lead).cast("double")), "_v")
    d = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    tot = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("bn"))
    off = tot.select("_bucket", F.coalesce(F.sum("bn").over(Window.orderBy(d("_bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                     F.sum("bn").over(Window.partitionBy()).alias("n_rows"))                     # at most a few hundred buckets
    w = Window.partitionBy("_bucket").orderBy(d(lead), *[F.col(c).asc() for c in order[1:]])
    return b.join(F.broadcast(off), "_bucket").withColumn("position", F.row_number().over(w) + F.col("_off")).drop("_bucket", "_v", "_off")


def top_decile(df: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """Precision, recall and lift at the score of the last row inside the top share (ties included)."""
    n = scalar(df.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1))))
    pos = ordered_position(df.select("y", "p", key), ["p", key], descending=True)
    cut = scalar(pos.filter(F.col("position") == n).agg(F.min("p")))
    base, hit = F.avg("y"), F.col("p") >= cut
    a = df.agg(R.count_where(hit).alias("flagged"), R.sum_where(F.col("y"), hit).alias("tp"), F.sum("y").alias("P"), base.alias("base"))
    prec = R.ratio(F.col("tp"), F.col("flagged"))
    return a.select("flagged", F.round(prec, 6).alias("precision"), F.round(R.ratio(F.col("tp"), F.col("P")), 6).alias("recall"), F.round(R.ratio(prec, F.col("base")), 6).alias("lift"))


# ---------------------------------------------------------------- errors

def error_block(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAPE on non-zero actuals, MAE, RMSE, WAPE and bias; per group when keys are given."""
    y, p = F.col("y"), F.col("yhat")
    e = F.abs(p - y)
    g = df.groupBy(*keys) if keys else df
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
                 F.round(R.pct(F.sum(e), F.sum(F.abs(y))), 6).alias("wape_pct"), F.round(R.pct(F.sum(p - y), F.sum(y)), 6).alias("bias_pct"),
                 F.round(F.avg(F.when(y != 0, e / F.abs(y))) * 100, 6).alias("mape_pct"))


def median_errors(df: DataFrame, floor: float = 1.0) -> DataFrame:
    """Exact median absolute and relative errors."""
    e = df.select(F.abs(F.col("yhat") - F.col("y")).alias("e"), F.when(F.col("y") > floor, F.abs(F.col("yhat") - F.col("y")) / F.col("y")).alias("r"))
    a, b = exact_quantiles(e, "e", [0.5]), exact_quantiles(e, "r", [0.5])
    return a.select("p", F.col("quantile").alias("a")).join(b.select("p", F.col("quantile").alias("b")), "p").select(
        F.round("a", 4).alias("median_abs_error"), F.round("b", 6).alias("median_rel_error"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    from tradewright.functions.scale import average_ranks
    ra, rb = average_ranks(df, a).withColumnRenamed("avg_rank", "_ra"), average_ranks(df, b).withColumnRenamed("avg_rank", "_rb")
    return df.join(ra, a).join(rb, b).agg(F.round(F.corr("_ra", "_rb"), 6).alias("spearman"))


def top_n_precision(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    t = df.orderBy(F.col("y").desc(), key).limit(n).select(key)
    p = df.orderBy(F.col("yhat").desc(), key).limit(n).select(key)
    return t.join(p, key).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("top_n_precision"))


def list_metrics(ranked: DataFrame, positives: DataFrame, k: int = 10) -> DataFrame:
    """HitRate, precision, recall, NDCG and MAP at k per customer, from (customer, item, rank) lists and (customer, item) positives."""
    c = F.col
    npos = positives.groupBy("customer").agg(F.count(F.lit(1)).alias("npos"))
    top = ranked.filter(c("rank") <= k).join(positives.withColumn("y", F.lit(1)), ["customer", "item"], "left").fillna(0, ["y"]).join(npos, "customer")
    w = Window.partitionBy("customer").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)    # k rows
    top = top.withColumns({"gain": c("y") / F.log2(c("rank") + 1), "prec": F.sum("y").over(w) / c("rank")})
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.max("npos"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return top.groupBy("customer").agg(
        F.max(c("y")).cast("double").alias("hit"), (F.sum("y") / F.lit(float(k))).alias("precision"), (F.sum("y") / F.max("npos")).alias("recall"),
        (F.sum("gain") / ideal).alias("ndcg"), (F.sum(c("prec") * c("y")) / F.least(F.max("npos"), F.lit(k))).alias("map"))


def list_summary(per_customer: DataFrame, shown: DataFrame, catalogue: DataFrame) -> DataFrame:
    cover = R.ratio(scalar(shown.agg(F.countDistinct("item"))), scalar(catalogue.agg(F.countDistinct("item"))))
    return per_customer.agg(F.count(F.lit(1)).alias("customers"), *[F.round(F.avg(m), 6).alias(m) for m in ("hit", "precision", "recall", "ndcg", "map")]).withColumn(
        "coverage", F.round(cover, 6))


# ---------------------------------------------------------------- drift

def psi(reference: DataFrame, current: DataFrame, features: Sequence[str], bins: int = 10, expected: Sequence[str] = ()) -> DataFrame:
    """Population stability per feature, bins from exact reference quantiles (at most bins + 1 numbers per feature)."""
    out = None
    for f in features:
        cuts = sorted({r["quantile"] for r in exact_quantiles(reference, f, [i / bins for i in range(bins + 1)]).collect()})
        if len(cuts) < 3:
            row = reference.limit(1).select(F.lit(f).alias("feature"), F.lit(0.0).alias("psi"))
        else:
            splits = [float("-inf"), *cuts[1:-1], float("inf")]
            both = reference.select(F.lit(1).alias("r"), F.col(f).cast("double").alias("v")).unionByName(current.select(F.lit(0).alias("r"), F.col(f).cast("double").alias("v")))
            g = Bucketizer(splits=splits, inputCol="v", outputCol="b", handleInvalid="skip").transform(both).groupBy("b").agg(
                R.count_where(F.col("r") == 1).alias("a"), R.count_where(F.col("r") == 0).alias("o"))
            whole = Window.partitionBy()                                                             # at most `bins` rows
            pa = F.greatest(F.col("a") / F.sum("a").over(whole), F.lit(1e-4))
            po = F.greatest(F.col("o") / F.sum("o").over(whole), F.lit(1e-4))
            row = g.select(((po - pa) * F.log(po / pa)).alias("x")).agg(F.sum("x").alias("psi")).select(F.lit(f).alias("feature"), "psi")
        out = row if out is None else out.unionByName(row)
    level = F.when(F.col("feature").isin(list(expected) or [""]), "expected").when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("high")
    return out.select("feature", F.round("psi", 6).alias("psi"), level.alias("level"))


def target_drift(reference: DataFrame, current: DataFrame, limit: float = 0.5) -> DataFrame:
    a = reference.agg(F.avg("y").alias("r")).withColumn("k", F.lit(1))
    b = current.agg(F.avg("y").alias("c")).withColumn("k", F.lit(1))
    d = F.abs(F.col("c") - F.col("r")) / F.col("r")
    return a.join(b, "k").select(F.round("r", 6).alias("reference_rate"), F.round("c", 6).alias("current_rate"), F.round(d, 6).alias("relative_drift"), (d > limit).alias("alert"))
