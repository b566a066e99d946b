"""Margin analyses over the monthly margin marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R

def whole():
    return Window.partitionBy()


def totals(margin: DataFrame, quality: DataFrame) -> DataFrame:
    """Gross margin, rate and exclusions; NULL when no usable cost exists on the scope."""
    a = margin.agg(F.sum("revenue").alias("r"), F.sum("cost").alias("k"), F.sum("margin").alias("m")).withColumn("one", F.lit(1))
    q = quality.select("excluded_lines", "billed_lines").withColumn("one", F.lit(1))
    ok = F.col("r") > 0
    rate = F.when(ok, R.pct(F.col("m"), F.col("r")))
    return a.join(q, "one").select(
        F.when(ok, "erp_cost").otherwise("unavailable").alias("source"), F.round(F.when(ok, F.col("r")), 1).alias("revenue"),
        F.round(F.when(ok, F.col("k")), 1).alias("cost"), F.round(F.when(ok, F.col("m")), 1).alias("margin"), F.round(rate, 6).alias("rate_pct"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), rate)), 6).alias("quality_score"), "excluded_lines",
        F.round(R.pct(F.col("excluded_lines"), F.col("billed_lines")), 6).alias("excluded_pct"))


def monthly_aligned(sales: DataFrame, margin: DataFrame) -> DataFrame:
    """Margin on the sales calendar, zero where a month has none."""
    months = sales.select(R.month_key(F.col("date")).alias("month")).distinct()
    m = margin.groupBy("month").agg(F.sum("margin").alias("m"))
    return months.join(m, "month", "left").select("month", F.round(F.coalesce("m", F.lit(0.0)), 4).alias("margin"))


def waterfall(margin: DataFrame) -> DataFrame:
    a = margin.agg(F.round(F.sum("revenue"), 1).alias("r"), F.round(F.sum("cost"), 1).alias("k"), F.round(F.sum("margin"), 1).alias("m"))
    return a.selectExpr("stack(3, 1, 'revenue', r, 'start', 2, 'cost', -k, 'negative', 3, 'margin', m, 'total') as (step_no, step, value, kind)")


def by_category(category: DataFrame) -> DataFrame:
    g = category.groupBy("category").agg(F.sum("revenue").alias("r"), F.sum("cost").alias("k"), F.sum("margin").alias("m"), F.sum("n_lines").alias("n_lines"))
    return g.select("category", F.round("r", 1).alias("revenue"), F.round("k", 1).alias("cost"), F.round("m", 1).alias("margin"),
                    F.round(R.pct(F.col("m"), F.col("r")), 6).alias("rate_pct"), F.round(R.pct(F.col("r"), F.sum("r").over(whole())), 6).alias("revenue_pct"),
                    F.round(R.pct(F.col("m"), F.sum("m").over(whole())), 6).alias("margin_pct"), "n_lines")


def carriers_and_losers(product: DataFrame, k: int = 15) -> DataFrame:
    """Largest profits and largest losses of one product aggregate."""
    c = product.groupBy("reference", "customer").agg(F.sum("revenue").alias("r"), F.sum("cost").alias("c"), F.sum("margin").alias("m"))
    g = c.groupBy("reference").agg(F.sum("r").alias("r"), F.sum("c").alias("c"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("n_customers"))
    total = g.agg(F.sum("m")).scalar()
    up = g.filter("m > 0").orderBy(F.col("m").desc(), "reference").limit(k).withColumn("side", F.lit("carrier"))
    down = g.filter("m < 0").orderBy(F.col("m").asc(), "reference").limit(k).withColumn("side", F.lit("loser"))
    return up.unionByName(down).select(
        "side", "reference", F.round("r", 4).alias("revenue"), F.round("c", 4).alias("cost"), F.round("m", 4).alias("margin"),
        F.round(R.pct(F.col("m"), F.col("r")), 6).alias("rate_pct"), "n_customers",
        F.when(F.col("side") == "carrier", F.round(R.pct(F.col("m"), total), 6)).alias("margin_share_pct"))


def trend(category: DataFrame) -> DataFrame:
    g = category.groupBy("month").agg(F.sum("revenue").alias("r"), F.sum("margin").alias("m"))
    return g.select("month", F.round("r", 2).alias("revenue"), F.round("m", 2).alias("margin"), F.round(R.pct(F.col("m"), F.col("r")), 6).alias("rate_pct"))


def year_completion(category: DataFrame, last_date) -> DataFrame:
    """Running year so far, same window of the year before, and the seasonal projection to year end."""
    year, upto = F.year(last_date), F.month(last_date)
    mon = F.substring("month", 6, 2).cast("int")
    prev = F.col("year") == year - 1
    a = category.filter(F.col("year") >= year - 1).agg(
        R.sum_where(F.col("margin"), F.col("year") == year).alias("now"), R.sum_where(F.col("revenue"), F.col("year") == year).alias("rev"),
        R.sum_where(F.col("margin"), prev & (mon <= upto)).alias("part"), R.sum_where(F.col("margin"), prev).alias("full"))
    share = R.ratio(F.col("part"), F.col("full"))
    return a.select(year.alias("year"), upto.alias("months_covered"), (upto < 12).alias("incomplete"), F.round("now", 1).alias("margin_to_date"),
                    F.round("rev", 1).alias("revenue_to_date"), F.round("part", 1).alias("same_window_before"), F.round("full", 1).alias("full_year_before"),
                    F.round(share * 100, 6).alias("share_reached_pct"), F.round(R.pct(F.col("now") - F.col("part"), F.col("part")), 6).alias("change_pct"),
                    F.round(F.when(share > 0.05, F.col("now") / share), 1).alias("projected_year_end"))


def limits(quality: DataFrame) -> DataFrame:
    return quality.select("excluded_lines", F.round(R.pct(F.col("excluded_lines"), F.col("billed_lines")), 6).alias("excluded_pct"),
                          F.round("excluded_amount", 1).alias("excluded_amount"), "free_lines", F.round("free_cost", 1).alias("free_cost"),
                          "return_lines", F.round("return_amount", 1).alias("return_amount"))
