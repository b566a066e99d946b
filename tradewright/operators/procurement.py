"""Supplier dependence, replenishment rhythm and threatened supply."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar

def whole():
    return Window.partitionBy()


def supplier_ranking(purchases: DataFrame, lines: DataFrame, suppliers: DataFrame, dependency_pct: float = 30.0) -> DataFrame:
    """Amount, documents, references, weighted delay, last purchase, share and dependency of every supplier."""
    t, d = F.col("ttc"), F.col("delay_days")
    a = purchases.groupBy("supplier").agg(F.sum(t).alias("m"), F.count(F.lit(1)).alias("documents"),
                                          R.ratio(F.sum(t * d), F.sum(t)).alias("delay"), F.max("date").alias("last_purchase"))
    refs = lines.groupBy("supplier", "reference").agg(F.lit(1).alias("one")).groupBy("supplier").agg(F.count(F.lit(1)).alias("n_references"))
    total = scalar(purchases.agg(F.sum("ttc")))
    share = R.pct(F.col("m"), total)
    return a.join(refs, "supplier", "left").join(suppliers, "supplier", "left").select(
        "supplier", "supplier_name", "country", F.round("m", 2).alias("amount"), F.round(share, 6).alias("share_pct"), "documents", "n_references",
        F.round("delay", 6).alias("obtained_delay"), "last_purchase", (share >= dependency_pct).alias("dependency"))


def purchases_by_country(purchases: DataFrame, suppliers: DataFrame, k: int = 8) -> DataFrame:
    per = purchases.groupBy("supplier").agg(F.sum("ttc").alias("m")).join(suppliers, "supplier", "left")
    g = per.groupBy(F.coalesce("country", F.lit("unknown")).alias("country")).agg(F.count(F.lit(1)).alias("suppliers"), F.sum("m").alias("m"))
    g = g.withColumn("share", R.pct(F.col("m"), F.sum("m").over(whole())))         # one row per country
    return g.orderBy(F.col("m").desc_nulls_last(), "country").limit(k).select(
        "country", "suppliers", F.round("m", 2).alias("amount"), F.round("share", 6).alias("share_pct"))


def supplier_concentration(purchases: DataFrame) -> DataFrame:
    """HHI over all balances, first and first three shares, and the dependency band."""
    g = purchases.groupBy("supplier").agg(F.sum("ttc").alias("m"))
    tot = g.agg(F.sum("m").alias("t"), F.sum(F.col("m") * F.col("m")).alias("q"), F.count(F.lit(1)).alias("suppliers"), F.max("m").alias("top"))
    three = scalar(g.orderBy(F.col("m").desc(), "supplier").limit(3).agg(F.sum("m")))
    top1 = R.pct(F.col("top"), F.col("t"))
    return tot.select("suppliers", F.round(F.col("q") * 10000 / (F.col("t") * F.col("t")), 6).alias("hhi"), F.round(top1, 6).alias("top1_pct"),
                      F.round(R.pct(three, F.col("t")), 6).alias("top3_pct"),
                      F.when(top1 >= 50, "critical").when(top1 >= 30, "high").when(top1 >= 15, "moderate").otherwise("low").alias("dependency"))


def single_source(lines: DataFrame) -> DataFrame:
    """References bought from one supplier only."""
    sr = lines.filter(F.col("reference").isNotNull()).groupBy("reference", "supplier").agg(
        F.sum("amount").alias("m"), F.max("date").alias("d"))
    g = sr.groupBy("reference").agg(F.count(F.lit(1)).alias("n_suppliers"), F.sum("m").alias("m"), F.max("d").alias("last_purchase"),
                                    F.min("supplier").alias("supplier"))
    return g.filter("n_suppliers = 1").select("reference", "supplier", F.round("m", 2).alias("amount"), "last_purchase")


def single_source_summary(lines: DataFrame) -> DataFrame:
    sr = lines.filter(F.col("reference").isNotNull()).groupBy("reference", "supplier").agg(F.sum("amount").alias("m"))
    g = sr.groupBy("reference").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("m"))
    one = F.col("n") == 1
    return g.agg(F.count(F.lit(1)).alias("references"), R.count_where(one).alias("single_source"), R.sum_where(F.col("m"), one).alias("m")).select(
        "references", "single_source", F.round(R.pct(F.col("single_source"), F.col("references")), 6).alias("share_pct"),
        F.round(F.coalesce("m", F.lit(0.0)), 2).alias("amount"))


def purchase_gaps(lines: DataFrame) -> DataFrame:
    """Days between successive distinct purchase dates of a reference (at most one row per day)."""
    days = lines.filter(F.col("reference").isNotNull()).groupBy("reference", "date").agg(F.lit(1).alias("one"))
    w = Window.partitionBy("reference").orderBy("date")
    return days.select("reference", "date", F.datediff("date", F.lag("date").over(w)).alias("gap")).filter("gap > 0")


def rhythm(lines: DataFrame) -> DataFrame:
    """Median and mean gap over all references: the gap histogram is tiny, so the median is exact and cheap."""
    h = purchase_gaps(lines).groupBy("reference", "gap").agg(F.count(F.lit(1)).alias("n"))
    v = h.groupBy("gap").agg(F.sum("n").alias("n"))
    refs = h.groupBy("reference").agg(F.lit(1).alias("one")).agg(F.count(F.lit(1)))
    return v.agg(F.percentile("gap", F.lit(0.5), F.col("n")).alias("median_gap"), (F.sum(F.col("gap") * F.col("n")) / F.sum("n")).alias("m"),
                 F.sum("n").alias("gaps")).select("median_gap", F.round("m", 6).alias("mean_gap"), "gaps", scalar(refs).alias("references"))


def overdue_replenishment(purchase_lines: DataFrame, sales_lines: DataFrame, labels: DataFrame, k: int = 12) -> DataFrame:
    """References still sold whose last purchase is older than their median gap, with last lot and usual supplier."""
    last_sale = scalar(sales_lines.agg(F.max("date")))
    last_buy = scalar(purchase_lines.agg(F.max("date")))
    sold = (sales_lines.groupBy("reference").agg(F.max("date").alias("last_sale")).filter(F.col("last_sale") >= F.add_months(last_sale, -12)))
    contract = F.upper("label").contains("CONTRAT") | F.upper("label").contains("MAINTENANCE")
    goods = labels.filter(~contract).select("reference", "label")
    pace = purchase_gaps(purchase_lines).groupBy("reference").agg(
        F.median("gap").alias("med"), F.count(F.lit(1)).alias("n_gaps"), F.max("date").alias("last_purchase")).filter("n_gaps >= 3 and med >= 7")
    bought = purchase_lines.filter("reference is not null")
    lot = bought.filter("qty > 0").groupBy("reference").agg(F.max(F.struct("date", "qty", "amount")).alias("lot"))
    usual = bought.groupBy("reference", "supplier").agg(F.count(F.lit(1)).alias("n")).groupBy("reference").agg(
        F.min_by("supplier", F.struct(-F.col("n"), F.col("supplier"))).alias("usual_supplier"))
    since = F.datediff(last_buy, "last_purchase")
    late = pace.join(sold, "reference").join(goods, "reference").filter(since > F.col("med"))
    late = late.join(lot, "reference", "left").join(usual, "reference", "left")
    return late.withColumn("r", since / F.col("med")).orderBy(F.col("r").desc_nulls_last(), "reference").limit(k).select(
        "reference", "label", F.col("med").alias("median_gap"), "n_gaps", "last_purchase", since.alias("days_since"), F.round("r", 6).alias("lateness"),
        "last_sale", F.col("lot.qty").alias("last_lot_qty"), F.round("lot.amount", 4).alias("last_lot_amount"), "usual_supplier")


def supply_threat(sales_lines: DataFrame, purchase_lines: DataFrame, margin: float = 1.5) -> DataFrame:
    """Per customer and product of the last 12 months: is its replenishment late beyond 1.5 times its rhythm?"""
    end_sale, end_buy = scalar(sales_lines.agg(F.max("date"))), scalar(purchase_lines.agg(F.max("date")))
    recent = sales_lines.filter((F.col("amount") > 0) & (F.col("date") >= F.add_months(end_sale, -12)))
    cm = recent.groupBy("customer", "reference", R.month_index(F.col("date")).alias("m")).agg(
        F.sum("qty").alias("q"), F.sum("amount").alias("r"), F.max("date").alias("d"))
    use = cm.groupBy("customer", "reference").agg(F.sum("q").alias("qty"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("active_months"),
                                                  F.max("d").alias("last_sale"))
    last = purchase_lines.groupBy("reference").agg(F.max("date").alias("last_purchase"))
    pace = purchase_gaps(purchase_lines).groupBy("reference").agg(F.median("gap").alias("med"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    supply = last.join(pace, "reference", "left").withColumn("since", F.datediff(end_buy, "last_purchase"))
    threatened = F.coalesce(F.col("since") > F.round("med") * margin, F.lit(False))
    return use.join(supply, "reference", "left").select(
        "customer", "reference", F.round("qty", 2).alias("qty"), F.round("r", 4).alias("revenue"), "active_months", "last_sale", "last_purchase",
        F.round("med").alias("rhythm"), F.col("since").alias("days_since"), threatened.alias("threatened"))


def supply_threat_by_customer(threat: DataFrame) -> DataFrame:
    g = threat.groupBy("customer").agg(F.count(F.lit(1)).alias("products"), F.sum("revenue").alias("r"), R.count_where(F.col("threatened")).alias("threatened_products"),
                                       F.coalesce(R.sum_where(F.col("revenue"), F.col("threatened")), F.lit(0.0)).alias("t"))
    return g.select("customer", "products", F.round("r", 4).alias("revenue"), "threatened_products", F.round("t", 4).alias("threatened_revenue"),
                    F.round(R.pct(F.col("t"), F.col("r")), 6).alias("threatened_pct"))


def open_proposals(proposals: DataFrame, orders: DataFrame) -> DataFrame:
    """Proposals whose reference carries no open or refused order."""
    handled = orders.filter(F.col("status").isin("to_validate", "validated", "ordered", "refused")).select("reference")
    return proposals.join(handled, "reference", "left_anti")


def order_loop(orders: DataFrame) -> DataFrame:
    """Counts by status, committed amount and delivery lead time of supplier orders (one row)."""
    lead = F.datediff("received", "ordered")
    done = (F.col("status") == "received") & lead.isNotNull()
    g = orders.groupBy("status", F.when(done, lead).alias("lead")).agg(F.count(F.lit(1)).alias("n"), F.sum("est_amount").alias("a"))
    n = F.col("n")
    return g.agg(F.sum("n").alias("orders"), *[F.coalesce(R.sum_where(n, F.col("status") == s), F.lit(0)).alias(s) for s in
                 ("to_validate", "validated", "ordered", "received", "refused")],
                 F.round(F.coalesce(R.sum_where(F.col("a"), F.col("status").isin("validated", "ordered")), F.lit(0.0)), 2).alias("committed"),
                 F.coalesce(R.sum_where(n, F.col("lead").isNotNull()), F.lit(0)).alias("receipts"), F.min("lead").alias("min_lead"),
                 F.percentile("lead", F.lit(0.5), F.col("n")).alias("median_lead"), F.max("lead").alias("max_lead"))
