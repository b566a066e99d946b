"""Canonical tables derived from the order-management parquet set.

Each property is a lazy plan; only the columns a query uses reach the parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Product-type codes and the ERP family each stands for.
FAMILY_OF_TYPE = {
    "ECONOMY": "REACTIF ECONOMY", "STANDARD": "REACTIF STANDARD", "MEDIUM": "EQUIPEMENT MEDIUM",
    "LARGE": "SERVICE LARGE", "PROMO": "HUILE PROMO", "SMALL": "SMALL",
}
# end of fixed values


def family(col):
    out = F.when(F.lit(False), F.lit(""))
    for code, name in FAMILY_OF_TYPE.items():
        out = out.when(col == code, name)
    return out


class Tables:
    """Canonical tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def sales(self) -> DataFrame:
        """One signed sales document."""
        key = F.col("o_orderkey")
        credit = key % 20 == 0
        day = F.to_date("o_orderdate")
        ttc = F.when(credit, -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
        delay = (key % 121).cast("int")
        return self.raw("orders").select(
            key.alias("ent_id"), key.cast("string").alias("piece_no"), F.col("o_custkey").alias("customer"),
            day.alias("date"), F.date_add(day, delay).alias("due"), (ttc / 1.19).alias("ht"), ttc.alias("ttc"),
            credit.alias("is_credit"), F.col("o_orderpriority").alias("mode"), F.year(day).alias("year"),
            delay.alias("delay_days"))

    @cached_property
    def customers(self) -> DataFrame:
        """Customer reference. Every seventh segment value stands in for a type of establishment."""
        kind = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", "HOPITAL ")
                .when(F.col("c_mktsegment") == "MACHINERY", "CLINIQUE ")
                .when(F.col("c_mktsegment") == "FURNITURE", "LABO ").otherwise(""))
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer"), F.concat(kind, F.col("c_name")).alias("customer_name"),
            F.col("c_mktsegment").alias("segment"))

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("reference"), F.col("p_name").alias("label"),
            family(F.col("p_type")).alias("family"), F.col("p_retailprice").alias("list_price"))

    @cached_property
    def sales_lines(self) -> DataFrame:
        """One invoice line with its document's customer and date and its product's cost."""
        sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
        heads = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("date"))
        lines = self.raw("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_partkey").alias("reference"),
            (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            (sign * F.col("l_quantity")).alias("qty"))
        return (lines.join(heads, "l_orderkey").join(self.products, "reference")
                .select(F.col("l_orderkey").alias("piece_no"), F.col("l_linenumber").alias("line_no"), "customer",
                        "reference", "label", "family", "date", "amount", "qty",
                        (F.col("qty") * F.col("list_price") * 0.6).alias("cost")))

    @cached_property
    def sales_line_facts(self) -> DataFrame:
        """Sales lines without product attributes (no product join)."""
        sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
        heads = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("date"))
        return (self.raw("lineitem").select(
            "l_orderkey", F.col("l_partkey").alias("reference"),
            (sign * F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"),
            (sign * F.col("l_quantity")).alias("qty")).join(heads, "l_orderkey")
            .select("customer", "reference", "date", "amount", "qty"))

    @cached_property
    def purchases(self) -> DataFrame:
        """One supplier document per received line."""
        credit = F.col("l_orderkey") % 25 == 0
        day = F.to_date("l_shipdate")
        net = F.col("l_extendedprice") * (1 - F.col("l_tax"))
        delay = (F.col("l_orderkey") % 91).cast("int")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("piece_no"), F.col("l_linenumber").alias("line_no"),
            F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("reference"), day.alias("date"),
            F.year(day).alias("year"), F.when(credit, -net).otherwise(net).alias("ttc"), credit.alias("is_credit"),
            delay.alias("delay_days"))

    @cached_property
    def purchase_lines(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("piece_no"), F.col("l_suppkey").alias("supplier"),
            F.col("l_partkey").alias("reference"), F.col("l_linestatus").alias("stock_flag"),
            F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("qty"),
            (F.col("l_extendedprice") * (1 - F.col("l_tax"))).alias("amount"))

    @cached_property
    def suppliers(self) -> DataFrame:
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
        return (self.raw("supplier").join(nations, "s_nationkey", "left")
                .select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("supplier_name"), "country"))

    @cached_property
    def quotes(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("quote_no"), F.col("o_custkey").alias("customer"),
            F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1.19).alias("ht"),
            F.col("o_totalprice").alias("ttc"), F.col("o_orderstatus").alias("state"),
            (F.col("o_orderstatus") == "F").alias("converted"))

    @cached_property
    def tasks(self) -> DataFrame:
        """Action-loop records: open, closed or overdue work per customer."""
        n = F.col("event_id")
        status = F.when(n % 3 == 0, "open").otherwise("closed")
        lead = (n % 240) / 24.0
        return self.raw("events").select(
            n.alias("task_id"), F.col("user_id").alias("customer"), F.col("event_type").alias("category"),
            F.col("value").alias("stake"), status.alias("status"),
            F.when(status == "closed", F.when(F.col("event_type") == "purchase", "won").otherwise("lost")).alias("result"),
            (F.col("event_type") == "purchase").cast("int").alias("won"), (n % 7).alias("assignee"),
            (n % 2 == 0).alias("automatic"), F.to_date("ts").alias("created"),
            F.when(status == "closed", F.date_add(F.to_date("ts"), F.ceil(lead).cast("int"))).alias("closed"),
            F.when(status == "closed", lead).alias("lead_days"))

    @cached_property
    def imported(self) -> DataFrame:
        """Scanned invoices: every document re-read with the usual reading errors and missing fields."""
        k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        number = (F.when(k % 5 == 0, F.concat(F.lit("FV-"), k.cast("string"))).when(k % 5 == 1, F.concat(F.lit("fv 000"), k.cast("string")))
                  .when(k % 5 == 2, F.concat(F.lit("X"), (k * 7).cast("string"))))
        ttc = F.round(F.col("o_totalprice") + (k % 9 - 4) * 250.0, 2)
        party = F.when(k % 2 == 0, F.col("o_custkey")).otherwise(k % 97)
        return self.raw("orders").select(
            k.alias("id"), number.alias("number"), F.when(k % 2 == 0, "sale").otherwise("purchase").alias("side"), party.alias("party"),
            F.when(k % 50 == 9, F.lit(None)).otherwise(F.date_add(day, (k % 7).cast("int"))).alias("date"),
            F.when(k % 3 != 0, F.date_add(day, 45)).alias("due"), ttc.alias("ttc"), F.when(k % 4 != 0, ttc - 1).alias("net"),
            F.when(k % 6 == 0, "matched").when(k % 11 == 0, "probable_duplicate").otherwise("unmatched").alias("recon_status"),
            F.when(k % 8 == 0, day).alias("settled"), F.sha2((k - F.when(k % 30 == 29, 1).otherwise(0)).cast("string"), 256).alias("file_sha256"))
