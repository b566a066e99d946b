"""Ingestion, star schema and quality queries over a text export derived from the whole tables."""

from __future__ import annotations

from collections import ChainMap
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import quality, star
from tradewright.plans.registry import register
from tradewright.sources import raw as rawsrc
from tradewright.sources import sinks

c = F.col


def _text_date(key, day):
    """Three spellings, as found in exports."""
    return (F.when(key % 3 == 0, F.date_format(day, "M/d/yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd"))
            .otherwise(F.concat(F.date_format(day, "M/d/yyyy"))))


def export(t) -> dict[str, DataFrame]:
    """Text frames with the defects of a real export: copies, blanks, mixed dates, shifted columns."""
    o, li = t.raw("orders"), t.raw("lineitem")
    k, day = c("o_orderkey"), F.to_date("o_orderdate")
    s = lambda x: x.cast("string")
    copies = F.explode(F.sequence(F.lit(0), F.when(k % 11 == 0, 1).otherwise(0))).alias("copy")
    heads = o.select("*", copies)
    signed = F.when(k % 20 == 0, -c("o_totalprice")).otherwise(c("o_totalprice"))
    sales = heads.select(
        s(k * 2 + c("copy")).alias("ENT_ID"), F.concat(F.lit(" FV-"), s(k), F.lit(" ")).alias("PIECENOFULL"),
        F.concat(F.lit("C"), s(c("o_custkey"))).alias("TIERS"), _text_date(k, day).alias("DATEPIECE"),
        F.date_format(F.date_add(day, (k % 121).cast("int")), "M/d/yyyy").alias("DATEECHEANCE"), s(signed).alias("MONTANTSIGNE_DEV"),
        s(c("o_totalprice") / 1.19).alias("HT_DEV"), s(c("o_totalprice")).alias("TTC_DEV"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, "virement  60JOURS").when(k % 4 == 2, "Virement 60 JOURS")
        .otherwise(c("o_orderpriority")).alias("MODEREGLLIBELLE"), F.lit("3").alias("NBREARTICLE"),
        F.when(k % 6 == 5, "NULL").otherwise(F.concat(F.lit("D"), s(k % 5))).alias("DEPOT"))
    lk = c("l_orderkey")
    n = F.when(lk % 11 == 0, 2).otherwise(1) * F.when(c("l_partkey") % 17 == 0, 2).otherwise(1)
    base = ((lk * 8 + c("l_linenumber")) * 1000003 + c("l_partkey") * 101 + c("l_suppkey")) * 4
    parts = t.products
    # copies are made after the joins, which then move each line once
    lines = (li.join(o.select(k.alias("l_orderkey"), "o_custkey", day.alias("day")), "l_orderkey")
             .join(parts.withColumnRenamed("reference", "l_partkey"), "l_partkey")
             .select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("copy")))
    sign = F.when(c("l_returnflag") == "R", -1).otherwise(1)
    sales_lines = lines.select(
        s(base + c("copy")).alias("MOUV_ID"), F.concat(F.lit("FV-"), s(lk)).alias("NUMEROFULL"), F.concat(F.lit("C"), s(c("o_custkey"))).alias("TIERS"),
        F.concat(F.lit("P"), s(c("l_partkey"))).alias("REFERENCE"), F.upper("label").alias("DESIGNATION"), c("family").alias("ARTICLE_LIBELLE_FAM_STAT1"),
        F.date_format("day", "M/d/yyyy").alias("DATEFACTURE"), s(sign * c("l_extendedprice")).alias("MONTANTSIGNE_DEV"),
        s(sign * c("l_quantity")).alias("QUANTITESIGNEE"), s(sign * c("l_quantity") * c("list_price")).alias("MTCRSIGNE"),
        F.when(lk % 997 == 1, "CULTURE").when(lk % 991 == 1, F.lit(None)).when(sign < 0, "1").otherwise("2").alias("SENS"))
    buy_no = F.concat(F.lit("FA-"), s(lk), F.lit("-"), s(c("l_linenumber")), F.lit("-"), s(c("l_partkey")))
    buy_day = F.when(lk % 499 == 1, "1/1/1900").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    sup = F.concat(F.lit("F"), s(c("l_suppkey")))
    purchases = li.select(
        s(base).alias("ENT_ID"), buy_no.alias("PIECENOFULL"), F.concat(F.lit("Supplier "), s(c("l_suppkey"))).alias("FOURNISSEURNOM"),
        sup.alias("CLE_FOURNISSEUR"), buy_day.alias("DATEPIECE"), F.date_format(F.date_add("l_shipdate", 60), "M/d/yyyy").alias("DATEECHEANCE"),
        s(c("l_extendedprice")).alias("MONTANTSIGNE_DEV"), s(c("l_extendedprice") * 0.81).alias("HT_DEV"), s(c("l_extendedprice")).alias("TTC_DEV"),
        s(c("l_extendedprice") * 0.19).alias("MONTANTTVAFOURNISSEUR_DEV"), F.lit("90JOURS").alias("MODEREGLLIBELLE"), F.lit("").alias("PIECEEXTERNE"))
    purchase_lines = li.select(
        s(base).alias("MOUV_ID"), buy_no.alias("NUMEROFULL"), sup.alias("CLE_FOURNISSEUR"), F.concat(F.lit("P"), s(c("l_partkey"))).alias("REFERENCE"),
        F.lit("lot").alias("DESIGNATION"), c("l_linestatus").alias("INDICMVTSTOCK"), buy_day.alias("DATEFACTURE"), s(c("l_quantity")).alias("QUANTITESIGNEE"),
        s(c("l_extendedprice")).alias("MONTANTSIGNE_DEV"))
    quotes = o.select("*", F.explode(F.sequence(F.lit(0), F.when(k % 13 == 0, 1).otherwise(0))).alias("copy")).select(
        s(k * 2 + c("copy")).alias("ENT_ID"), F.when(k % 101 == 1, "").otherwise(F.concat(F.lit("DV-"), s(k))).alias("PIECENOFULL"),
        F.concat(F.lit("C"), s(c("o_custkey"))).alias("TIERS"), F.date_format(day, "yyyy-MM-dd").alias("DATEPIECE"),
        s(c("o_totalprice")).alias("MONTANTSIGNE_DEV"), s(c("o_totalprice") / 1.19).alias("HT_DEV"), s(c("o_totalprice")).alias("TTC_DEV"),
        F.lit("x").alias("STATUS"), F.when(c("o_orderstatus") == "F", "8").when(c("o_orderstatus") == "O", "1").alias("ETATPIECE"))
    deliveries = o.filter("o_orderstatus = 'O'").select(F.concat(F.lit("C"), s(c("o_custkey"))).alias("ENT_CLIENT_CODE"),
                                                        F.date_format(day, "M/d/yyyy").alias("ENT_DATE"), F.lit("2").alias("ENT_NBR_ARTICLE"))
    ck = c("c_custkey")
    ref = (t.raw("customer").select("*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select(
        F.when(ck % 10 == 0, " ").otherwise(F.concat(F.lit("C"), s(ck))).alias("ENT_CLIENT_CODE"), F.when(c("i") == 2, F.lower("c_name")).otherwise(c("c_name")).alias("ENT_CLIENT_INTITULE"),
        F.lit("Tunis").alias("ENT_CLIENT_VILLE"), F.concat(F.lit("D"), s(ck % 4)).alias("ENT_DEPOT_CODE"),
        F.when(c("i") == 2, "alt").otherwise(F.concat(F.lit("Depot "), s(ck % 4))).alias("ENT_DEPOT_INTITULE")))
    sk = c("s_suppkey")
    sup_ref = t.raw("supplier").select(
        F.when(sk % 10 == 0, "").otherwise(F.concat(F.lit("F"), s(sk))).alias("CLE_FOURNISSEUR"), F.lit(" ").alias("TIERS"), c("s_name").alias("NOMFOURNISSEUR"),
        F.lit("NULL").alias("VILLE"), F.when(sk % 5 == 1, "NULL").otherwise("FR").alias("PAYSLIBELLE"))
    return {"sales_headers": sales, "sales_lines": sales_lines, "purchase_headers": purchases, "purchase_lines": purchase_lines,
            "quotes": quotes, "deliveries": deliveries, "customer_reference": ref, "suppliers": sup_ref}


def staged(t):
    return star.stage(export(t))


def built(t):
    stg = staged(t)
    fact = star.facts(stg)
    return stg, fact, star.dimensions(stg, fact).kept()


BASE = "((l_orderkey * 8 + l_linenumber) * 1000003 + l_partkey * 101 + l_suppkey) * 4"
V = {
    "xlines": f"""SELECT {BASE} + copy AS mouv_id, l_orderkey, l_partkey, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice
        ELSE l_extendedprice END AS amount, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty,
        CASE WHEN l_orderkey % 997 = 1 THEN false WHEN l_orderkey % 991 = 1 THEN NULL ELSE true END AS ok
        FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS copy)
        WHERE copy < (CASE WHEN l_orderkey % 11 = 0 THEN 2 ELSE 1 END) * (CASE WHEN l_partkey % 17 = 0 THEN 2 ELSE 1 END)""",
    "kept": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, amount, qty ORDER BY mouv_id) AS r,
        count(*) OVER (PARTITION BY l_orderkey, l_partkey, amount, qty) AS n FROM xlines)
        WHERE r <= ceil(n * 1.0 / CASE WHEN l_orderkey % 11 = 0 THEN 2 ELSE 1 END)""",
    "buydates": """SELECT CASE WHEN l_orderkey % 499 = 1 THEN DATE '1900-01-01' ELSE CAST(l_shipdate AS DATE) END AS d, l_suppkey,
        l_partkey FROM lineitem""",
}


def q(name, build, sql=None):
    register(name, build, sql, V)


# ------------------------------------------------------------ sources and sinks
q("a3_source_signature", lambda t: reduce(DataFrame.unionByName, [
    rawsrc.file_signature(t.raw(n), n) for n in ("orders", "lineitem", "customer", "part", "supplier")]).select("source", F.length("signature").alias("hash_length")),
  """SELECT unnest(['orders', 'lineitem', 'customer', 'part', 'supplier']) AS source, 64 AS hash_length""")
q("a4_data_fingerprint", lambda t: rawsrc.data_fingerprint(t.sales, t.sales_line_facts, t.purchases), """
  WITH s AS (SELECT concat_ws('|', (SELECT concat_ws('|', count(*), min(date), max(date), CAST(round(sum(ttc) * 100) AS BIGINT), count(DISTINCT customer)) FROM sales),
    (SELECT concat_ws('|', count(*), CAST(round(sum(amount)) AS BIGINT)) FROM lines), (SELECT concat_ws('|', count(*), CAST(round(sum(ttc)) AS BIGINT)) FROM purchases)) AS state)
  SELECT state, substr(sha256(state), 1, 16) AS fingerprint FROM s""")
q("a4_consumer_status", lambda t: rawsrc.consumer_status(
    rawsrc.data_fingerprint(t.sales, t.sales_line_facts, t.purchases).selectExpr(
        "stack(3, 'churn', fingerprint, 'margin', 'older', 'quotes', cast(null as string)) as (consumer, learned_fingerprint)"),
    rawsrc.data_fingerprint(t.sales, t.sales_line_facts, t.purchases)), """
  SELECT unnest(['churn', 'margin', 'quotes']) AS consumer, unnest(['fresh', 'stale', 'never']) AS status""")
q("a5_parquet_scan", lambda t: t.raw("lineitem").filter(c("l_quantity") > 45).select("l_orderkey", "l_quantity"),
  "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
q("a8_metrics_long", lambda t: sinks.metrics_long(t.sales.agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum("ttc"), 2).alias("revenue")), "sales"), """
  SELECT 'sales' AS report, 'documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM sales
  UNION ALL SELECT 'sales', 'revenue', round(sum(ttc), 2) FROM sales""")
q("a9_review_list", lambda t: sinks.review_list(t.sales_lines.groupBy("reference").agg(F.round(F.sum("amount"), 2).alias("value")), "value", "reference"), """
  SELECT reference, round(sum(amount), 2) AS value FROM lines GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 300""")

# ------------------------------------------------------------ typing and cleaning
q("b1_robust_date", lambda t: staged(t)["sales"].select("ent_id", "date"), """
  SELECT o_orderkey * 2 + copy AS ent_id, CAST(o_orderdate AS DATE) AS date FROM orders, (SELECT unnest([0, 1]) AS copy)
  WHERE copy = 0 OR o_orderkey % 11 = 0""")
q("b1_day_first_fallback", lambda t: t.raw("orders").select("o_orderkey", R.robust_date(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date")), """
  SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
    ELSE CAST(o_orderdate AS DATE) END AS date FROM orders""")
q("b2_due_date", lambda t: staged(t)["sales"].select("ent_id", "due"), """
  SELECT o_orderkey * 2 + copy AS ent_id, CASE WHEN year(due) BETWEEN 2000 AND 2035 THEN due END AS due FROM (SELECT *,
    CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 AS INTEGER) AS due FROM orders), (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR o_orderkey % 11 = 0""")
q("b3_b4_signed_amounts", lambda t: staged(t)["sales"].groupBy("sign").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c("ttc_abs") * c("sign")), 2).alias("total")), """
  SELECT CASE WHEN o_orderkey % 20 = 0 THEN -1 ELSE 1 END AS sign, sum(m) AS n, round(sum(m * o_totalprice * CASE WHEN o_orderkey % 20 = 0 THEN -1 ELSE 1 END), 2) AS total
  FROM (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS m FROM orders) GROUP BY 1""")
q("b5_clean_text", lambda t: staged(t)["sales"].groupBy("depot").agg(F.count(F.lit(1)).alias("n")), """
  SELECT CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE concat('D', o_orderkey % 5) END AS depot, sum(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END) AS n FROM orders GROUP BY 1""")
q("b6_payment_mode", lambda t: staged(t)["sales"].groupBy("mode_key", "mode_label").agg(F.count(F.lit(1)).alias("n")), """
  WITH m AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS n, CASE o_orderkey % 4 WHEN 0 THEN 'Non renseigné' WHEN 1 THEN 'virement 60 JOURS'
    WHEN 2 THEN 'Virement 60 JOURS' ELSE o_orderpriority END AS mode_label FROM orders)
  SELECT CASE mode_label WHEN 'Non renseigné' THEN 'NON RENSEIGNE' ELSE upper(mode_label) END AS mode_key, mode_label, sum(n) AS n FROM m GROUP BY 1, 2""")
q("b7_staging_lines", lambda t: staged(t)["sales_lines"].agg(F.count(F.lit(1)).alias("n"), F.count("date").alias("dated"), F.round(F.sum("amount"), 2).alias("amount"),
  F.round(F.sum("qty"), 2).alias("qty")), "SELECT count(*) AS n, count(*) AS dated, round(sum(amount), 2) AS amount, round(sum(qty), 2) AS qty FROM xlines")
q("b8_format_validity", lambda t: staged(t)["sales_lines"].groupBy("format_valid").agg(F.count(F.lit(1)).alias("n")),
  "SELECT ok AS format_valid, count(*) AS n FROM xlines GROUP BY 1")
q("b9_rejected_lines", lambda t: star.facts(staged(t))["sales_lines_rejected"].select("mouv_id", "amount"), "SELECT mouv_id, amount FROM kept WHERE ok = false")
q("b10_business_category", lambda t: t.sales_lines.groupBy(R.business_category(c("family")).alias("category")).agg(F.count(F.lit(1)).alias("n")), """
  SELECT CASE WHEN family LIKE 'REACTIF%' THEN 'reagent' WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment' WHEN family LIKE 'SERVICE%' THEN 'service'
    ELSE 'other' END AS category, count(*) AS n FROM lines GROUP BY 1""")
q("b11_usable_cost", lambda t: t.sales_lines.groupBy(R.usable_cost(c("cost") * F.when(c("reference") % 3 == 0, 9).otherwise(1), c("amount")).alias("usable"))
  .agg(F.count(F.lit(1)).alias("n")), """
  SELECT abs(cost * CASE WHEN reference % 3 = 0 THEN 9 ELSE 1 END) <= 5 * abs(amount) AS usable, count(*) AS n FROM lines GROUP BY 1""")
q("b12_family_scope", lambda t: t.products.filter(R.in_scope_family(c("family"))).groupBy("family").agg(F.count(F.lit(1)).alias("n")),
  "SELECT family, count(*) AS n FROM products WHERE family NOT LIKE 'HUILE%' GROUP BY 1")
q("b13_public_hospital", lambda t: t.customers.groupBy(R.is_public_hospital(c("customer_name")).alias("public")).agg(F.count(F.lit(1)).alias("n")),
  "SELECT c_mktsegment = 'HOUSEHOLD' AS public, count(*) AS n FROM customer GROUP BY 1")
q("b14_establishment_type", lambda t: t.customers.groupBy(R.establishment_type(c("customer_name")).alias("type")).agg(F.count(F.lit(1)).alias("n")), """
  SELECT CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'public_hospital' WHEN 'MACHINERY' THEN 'private_clinic' WHEN 'FURNITURE' THEN 'laboratory' ELSE 'other' END AS type,
    count(*) AS n FROM customer GROUP BY 1""")
def classed():
    return F.when(c("reference") % 5 == 0, F.concat(F.lit("joint "), c("label"))).when(c("reference") % 5 == 1, F.concat(F.lit("CONTRAT "), c("label"))) \
    .when(c("reference") % 5 == 2, F.concat(F.lit("kit tube "), c("label"))).otherwise(c("label"))
V["classed"] = """SELECT reference, list_price, label, CASE WHEN family LIKE 'REACTIF%' THEN CASE WHEN reference % 5 = 0 THEN 'part' ELSE 'consumable' END
    WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment' WHEN family LIKE 'SERVICE%' THEN 'service' WHEN reference % 5 = 0 THEN 'part' WHEN reference % 5 = 1 THEN 'service'
    ELSE 'consumable' END AS class, CASE WHEN family LIKE 'REACTIF%' THEN CASE WHEN reference % 5 = 0 THEN 'erp_refined' ELSE 'erp' END
    WHEN family LIKE 'EQUIPEMENT%' OR family LIKE 'SERVICE%' THEN 'erp' WHEN reference % 5 <= 2 THEN 'keyword' ELSE 'default' END AS origin FROM products"""
q("b15_product_class", lambda t: t.products.withColumn("label", classed()).select(
    "reference", R.product_class(c("label"), c("family")).alias("class"), R.product_class_origin(c("label"), c("family")).alias("origin"),
    R.is_perishable(c("label"), c("family")).alias("perishable")), "SELECT reference, class, origin, class = 'consumable' AS perishable FROM classed")
q("b16_service_flag", lambda t: t.products.withColumn("label", classed()).select("reference", (F.upper("label").rlike(R.SERVICE_WORDS) | (
    R.product_class(c("label"), c("family")) == "service")).alias("is_service")), """
  SELECT reference, class = 'service' OR reference % 5 = 1 AS is_service FROM classed""")
q("b17_b18_bands", lambda t: t.sales.groupBy(R.delay_band(c("delay_days")).alias("delay"), R.amount_band(c("ttc")).alias("amount")).agg(F.count(F.lit(1)).alias("n")), """
  SELECT CASE WHEN delay_days <= 0 THEN 'cash' WHEN delay_days <= 30 THEN '1-30' WHEN delay_days <= 60 THEN '31-60' WHEN delay_days <= 90 THEN '61-90' ELSE 'over 90' END AS delay,
    CASE WHEN ttc < 500 THEN '< 500' WHEN ttc < 1000 THEN '0.5-1K' WHEN ttc < 5000 THEN '1-5K' WHEN ttc < 10000 THEN '5-10K' WHEN ttc < 50000 THEN '10-50K' ELSE '50K +' END AS amount,
    count(*) AS n FROM sales GROUP BY 1, 2""")
q("b24_normal_name", lambda t: t.customers.select("customer", R.normal_name(F.concat(F.lit("Sté "), c("customer_name"), F.lit(" S.A.R.L"))).alias("name"),
  R.normal_name(c("customer_name"), False).alias("plain")), """
  SELECT customer, trim(regexp_replace(lower(customer_name), '[^a-z0-9]+', ' ', 'g')) AS name, trim(regexp_replace(lower(customer_name), '[^a-z0-9]+', ' ', 'g')) AS plain FROM customers""")
q("b25_normal_number", lambda t: t.raw("orders").select("o_orderkey", R.normal_number(F.concat(F.lit("00-"), F.lpad(c("o_orderkey").cast("string"), 9, "0"))).alias("number")),
  "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS number FROM orders")
q("b26_c1_presented_sales", lambda t: (lambda b: star.presented_sales(b[1]["sales"], b[2]["dim_customer"], b[2]["dim_mode"]))(built(t)).select(
    "ent_id", "customer", "customer_name", "year", "delay_days", F.round("ttc", 2).alias("ttc"), "mode"), """
  SELECT o_orderkey * 2 AS ent_id, concat('C', o_custkey) AS customer, CASE WHEN o_custkey % 10 = 0 THEN concat('C', o_custkey) ELSE c_name END AS customer_name,
    year(o_orderdate) AS year, CASE WHEN year(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 AS INTEGER)) BETWEEN 2000 AND 2035 THEN o_orderkey % 121 END AS delay_days,
    round(CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) AS ttc,
    CASE o_orderkey % 4 WHEN 0 THEN 'Non renseigné' WHEN 3 THEN o_orderpriority ELSE (SELECT CASE WHEN sum(m) FILTER (k = 2) >= sum(m) FILTER (k = 1) THEN 'Virement 60 JOURS'
      ELSE 'virement 60 JOURS' END FROM (SELECT o_orderkey % 4 AS k, CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS m FROM orders)) END AS mode
  FROM orders JOIN customer ON c_custkey = o_custkey""")

# ------------------------------------------------------------ deduplication
q("e1_sales_dedup", lambda t: star.facts(staged(t))["sales"].select("ent_id", "piece_no", F.round("ttc", 2).alias("ttc"), "is_credit"), """
  SELECT o_orderkey * 2 AS ent_id, concat('FV-', o_orderkey) AS piece_no, round(CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END, 2) AS ttc,
    o_orderkey % 20 = 0 AS is_credit FROM orders""")
q("e1_quotes_dedup", lambda t: star.facts(staged(t))["quotes"].groupBy("converted").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ttc"), 2).alias("ttc")), """
  SELECT o_orderstatus = 'F' AS converted, sum(CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 101 = 1 THEN 2 ELSE 1 END) AS n,
    round(sum(o_totalprice * CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 101 = 1 THEN 2 ELSE 1 END), 2) AS ttc FROM orders GROUP BY 1""")
q("e1_purchases_dedup", lambda t: star.facts(staged(t))["purchases"].groupBy("supplier_code").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("ttc"), 2).alias("ttc")),
  "SELECT concat('F', l_suppkey) AS supplier_code, count(*) AS n, round(sum(l_extendedprice), 2) AS ttc FROM lineitem GROUP BY 1")
q("e2_copies_aware_lines", lambda t: star.facts(staged(t))["sales_lines"].select("mouv_id", "amount"), "SELECT mouv_id, amount FROM kept WHERE ok IS DISTINCT FROM false")
q("e3_duplicate_groups", lambda t: star.duplicate_groups(t.raw("lineitem"), ["l_orderkey", "l_linenumber"], "l_extendedprice"), """
  WITH g AS (SELECT count(*) AS n, sum(l_extendedprice) AS v FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  SELECT count(*) AS groups, sum(n - 1) AS extra_rows, round(sum(v / n * (n - 1)), 2) AS extra_amount FROM g""")
q("e4_most_frequent_label", lambda t: star.most_frequent(t.sales.withColumn("mode", c("mode")), "customer", "mode"), """
  SELECT customer, mode FROM (SELECT customer, mode, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, mode) AS r FROM sales GROUP BY 1, 2) WHERE r = 1""")
q("e5_group_mode", lambda t: t.sales.groupBy("customer").agg(F.expr("mode() within group (order by mode)").alias("mode")), """
  SELECT customer, mode FROM (SELECT customer, mode, row_number() OVER (PARTITION BY customer ORDER BY count(*) DESC, mode) AS r FROM sales GROUP BY 1, 2) WHERE r = 1""")
q("e6_dominant_family", lambda t: star.most_frequent(t.sales_lines.withColumn("label", F.upper(F.trim("label"))), "label", "family", F.abs("amount")), """
  SELECT label, family FROM (SELECT upper(trim(label)) AS label, family, row_number() OVER (PARTITION BY upper(trim(label)) ORDER BY sum(abs(amount)) DESC, family) AS r
    FROM lines GROUP BY 1, 2) WHERE r = 1""")
q("e7_label_reference_attachment", lambda t: star.most_frequent(t.sales_lines, "label", "reference", c("qty")), """
  SELECT label, reference FROM (SELECT label, reference, row_number() OVER (PARTITION BY label ORDER BY sum(qty) DESC, reference) AS r FROM lines GROUP BY 1, 2) WHERE r = 1""")
q("e8_representative", lambda t: t.sales_lines.groupBy("reference").agg(F.min("label").alias("label")), "SELECT reference, min(label) AS label FROM lines GROUP BY 1")

# ------------------------------------------------------------ dimensions
q("c2_dim_product", lambda t: built(t)[2]["dim_product"], """
  WITH s AS (SELECT l_partkey, family, upper(label) AS label FROM kept JOIN products ON reference = l_partkey WHERE ok IS DISTINCT FROM false GROUP BY 1, 2, 3),
       b AS (SELECT DISTINCT l_partkey FROM lineitem)
  SELECT concat('P', b.l_partkey) AS reference, coalesce(label, 'lot') AS label, family, s.l_partkey IS NOT NULL AS sold, true AS bought
  FROM b LEFT JOIN s USING (l_partkey)""")
q("c4_dim_customer", lambda t: built(t)[2]["dim_customer"], """
  SELECT concat('C', c_custkey) AS code, c_name AS name, 'Tunis' AS city, 'erp' AS origin FROM customer WHERE c_custkey % 10 <> 0
  UNION ALL SELECT DISTINCT concat('C', o_custkey), concat('C', o_custkey), NULL, 'inferred' FROM orders WHERE o_custkey % 10 = 0""")
q("c4_dim_supplier", lambda t: built(t)[2]["dim_supplier"], """
  SELECT concat('F', s_suppkey) AS code, NULL::VARCHAR AS party_code, s_name AS name, NULL::VARCHAR AS city, CASE WHEN s_suppkey % 5 <> 1 THEN 'FR' END AS country, 'erp' AS origin
  FROM supplier WHERE s_suppkey % 10 <> 0
  UNION ALL SELECT DISTINCT concat('F', l_suppkey), NULL, concat('Supplier ', l_suppkey), NULL, NULL, 'inferred' FROM lineitem WHERE l_suppkey % 10 = 0""")
q("c4_dim_depot", lambda t: built(t)[2]["dim_depot"], """
  SELECT concat('D', i) AS code, concat('Depot ', i) AS label, 'erp' AS origin FROM range(0, 4) r(i) UNION ALL SELECT 'D4', 'D4', 'inferred'""")
q("h1_distinct_parties", lambda t: (lambda fact: fact["sales"].select("customer").union(fact["quotes"].select("customer")).union(
    fact["deliveries"].select("customer")).distinct())(star.facts(staged(t))), "SELECT DISTINCT concat('C', o_custkey) AS customer FROM orders")
q("s8_dim_date", lambda t: built(t)[2]["dim_date"], """
  WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(o_orderdate AS DATE) + CAST(o_orderkey % 121 AS INTEGER) FROM orders
      UNION ALL SELECT d FROM buydates UNION ALL SELECT CAST(l_shipdate AS DATE) + 60 FROM lineitem),
  e AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS date FROM d WHERE year(d) BETWEEN 2000 AND 2035)
  SELECT date, year(date) AS year, month(date) AS month, quarter(date) AS quarter, dayofweek(date) AS dow, strftime(date, '%Y-%m') AS month_key,
    weekofyear(date) AS iso_week, dayofweek(date) IN (0, 6) AS weekend FROM e""")

# ------------------------------------------------------------ marts
q("d1_mart_sales_product", lambda t: star.mart_sales_product(t.sales_lines).withColumn("revenue", F.round("revenue", 4)), """
  SELECT label, year(date) AS year, round(sum(amount), 4) AS revenue, sum(qty) AS qty, count(*) FILTER (amount >= 0) AS n_lines, count(*) FILTER (amount < 0) AS n_returns FROM lines GROUP BY 1, 2""")
q("d2_mart_sales_family", lambda t: star.mart_sales_family(t.sales_lines).withColumn("revenue", F.round("revenue", 2)), """
  SELECT family, year(date) AS year, round(sum(amount), 2) AS revenue, sum(qty) AS qty FROM lines WHERE NOT regexp_matches(upper(family), 'HUILE') GROUP BY 1, 2""")
q("d3_mart_demand_customer_product", lambda t: star.mart_demand_customer_product(t.sales_lines).withColumn("revenue", F.round("revenue", 4)), """
  SELECT customer, label, sum(qty) AS qty, round(sum(amount), 4) AS revenue, count(DISTINCT year(date)) AS n_years FROM lines GROUP BY 1, 2 HAVING sum(qty) > 0""")


def _rounded(df, digits=4):
    return df.withColumns({x: F.round(x, digits) for x in ("revenue", "cost", "margin")})


M = """round(sum(amount), 4) AS revenue, round(sum(cost), 4) AS cost, round(sum(amount) - sum(cost), 4) AS margin, count(*) FILTER (amount >= 0) AS n_lines"""
W = "FROM lines WHERE amount <> 0 AND abs(cost) <= 5 * abs(amount)"
q("d4_mart_margin_customer_month", lambda t: _rounded(star.mart_margin_customer_month(t.sales_lines)), f"""
  SELECT customer, year(date) AS year, strftime(date, '%Y-%m') AS month, {M}, count(*) FILTER (amount < 0) AS n_returns {W} GROUP BY 1, 2, 3""")
q("d5_mart_margin_quality", lambda t: star.mart_margin_quality(t.sales_lines.withColumn("cost", c("cost") * F.when(c("reference") % 7 == 0, 40).otherwise(1)))
  .withColumns({x: F.round(x, 1) for x in ("return_amount", "excluded_amount", "free_cost")}), """
  WITH l AS (SELECT amount AS a, cost * CASE WHEN reference % 7 = 0 THEN 40 ELSE 1 END AS k FROM lines)
  SELECT count(*) FILTER (a <> 0 AND abs(k) > 5 * abs(a)) AS excluded_lines, count(*) FILTER (a > 0) AS billed_lines, count(*) FILTER (a < 0) AS return_lines,
    round(coalesce(sum(a) FILTER (a < 0), 0), 1) AS return_amount, round(coalesce(sum(a) FILTER (a <> 0 AND abs(k) > 5 * abs(a)), 0), 1) AS excluded_amount,
    count(*) FILTER (a = 0 AND k > 0) AS free_lines, round(coalesce(sum(k) FILTER (a = 0 AND k > 0), 0), 1) AS free_cost FROM l""")
q("d6_mart_margin_category_month", lambda t: _rounded(star.mart_margin_category_month(t.sales_lines)), f"""
  SELECT customer, CASE WHEN family LIKE 'REACTIF%' THEN 'reagent' WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment' WHEN family LIKE 'SERVICE%' THEN 'service' ELSE 'other' END AS category,
    year(date) AS year, strftime(date, '%Y-%m') AS month, {M} {W} GROUP BY 1, 2, 3, 4""")
q("d7_mart_margin_product", lambda t: _rounded(star.mart_margin_product(t.sales_lines)), f"""
  SELECT reference, customer, year(date) AS year, strftime(date, '%Y-%m') AS month, min(label) AS label, min(CASE WHEN family LIKE 'REACTIF%' THEN 'reagent'
    WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment' WHEN family LIKE 'SERVICE%' THEN 'service' ELSE 'other' END) AS category, {M}, sum(qty) AS qty {W} GROUP BY 1, 2, 3, 4""")

# ------------------------------------------------------------ warehouse checks
U = lambda frames: reduce(DataFrame.unionByName, frames).select("check", "value", "status")
q("q1_q6_rule_effects", lambda t: U(quality.effect_checks(*built(t))), """
  WITH h AS (SELECT sum(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END) AS n, count(*) AS k, count(*) FILTER (o_orderkey % 20 = 0) AS cr,
      round(sum(CASE WHEN o_orderkey % 20 = 0 THEN -o_totalprice ELSE o_totalprice END), 2) AS s, count(DISTINCT o_custkey) FILTER (o_custkey % 10 = 0) AS inf FROM orders),
  r AS (SELECT count(*) AS n FROM kept WHERE ok = false)
  SELECT u.check, CAST(u.value AS DOUBLE) AS value, CASE WHEN u.check = 'sales_lines_rejected' AND u.value > 0 THEN 'alert' ELSE 'ok' END AS status
  FROM h, r, LATERAL (SELECT unnest(['sales_lines_without_reference', 'sales_lines_rejected', 'sales:headers_read', 'sales:unreadable', 'sales:duplicates_removed', 'sales:credits',
    'sales:total_ttc', 'customers:inferred']) AS "check", unnest([0::DOUBLE, r.n, h.n, 0, h.n - h.k, h.cr, h.s, h.inf]) AS value) u""")
q("q2_volumes", lambda t: U(quality.volume_checks(star.facts(staged(t)))), """
  SELECT concat('volume:', unnest(['sales', 'sales_lines', 'purchases', 'purchase_lines', 'quotes', 'deliveries'])) AS "check", 0.0::DOUBLE AS value, 'ok' AS status""")
q("q3_unique_keys", lambda t: U(quality.uniqueness_checks(built(t)[2])), """
  SELECT concat('unique:', unnest(['dim_customer.code', 'dim_product.reference', 'dim_supplier.code', 'dim_depot.code', 'dim_mode.key', 'dim_date.date'])) AS "check",
    0.0::DOUBLE AS value, 'ok' AS status""")
q("q4_c5_referential_integrity", lambda t: (lambda b: U(quality.reference_checks(b[1], ChainMap(
    {"dim_customer": star.present(b[0]["reference"], "code").select("code").distinct()}, b[2]))))(built(t)), """
  WITH v AS (SELECT (SELECT count(*) FROM orders WHERE o_custkey % 10 = 0) AS s, (SELECT count(*) FROM kept JOIN orders ON o_orderkey = l_orderkey
      WHERE o_custkey % 10 = 0 AND ok IS DISTINCT FROM false) AS l, (SELECT sum(CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 101 = 1 THEN 2 ELSE 1 END) FROM orders
      WHERE o_custkey % 10 = 0) AS q, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 = 0) AS d)
  SELECT concat('reference:', u.c) AS "check", CAST(u.value AS DOUBLE) AS value, CASE WHEN u.value > 0 THEN 'error' ELSE 'ok' END AS status FROM v, LATERAL (SELECT
    unnest(['sales.customer', 'sales.mode_key', 'sales.depot', 'sales_lines.customer', 'sales_lines.reference', 'purchases.supplier_code', 'purchase_lines.reference',
      'purchase_lines.supplier_code', 'quotes.customer', 'deliveries.customer']) AS c, unnest([s, 0, 0, l, 0, 0, 0, 0, q, d]) AS value) u""")
q("q5_calendar", lambda t: (lambda b: U(quality.calendar_checks(b[1], b[2]["dim_date"])))(built(t)), """
  WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d, * FROM orders), v AS (SELECT (SELECT count(*) FROM o WHERE d < DATE '2000-01-01') AS s,
    (SELECT count(*) FROM kept JOIN o ON o_orderkey = l_orderkey WHERE d < DATE '2000-01-01' AND ok IS DISTINCT FROM false) AS l,
    (SELECT count(*) FROM buydates WHERE d < DATE '2000-01-01') AS p, (SELECT sum(CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 101 = 1 THEN 2 ELSE 1 END) FROM o
      WHERE d < DATE '2000-01-01') AS q, (SELECT count(*) FROM o WHERE o_orderstatus = 'O' AND d < DATE '2000-01-01') AS dl)
  SELECT concat('calendar:', u.c, '.date') AS "check", CAST(u.value AS DOUBLE) AS value, CASE WHEN u.value > 0 THEN 'alert' ELSE 'ok' END AS status FROM v, LATERAL (SELECT
    unnest(['sales', 'sales_lines', 'purchases', 'purchase_lines', 'quotes', 'deliveries']) AS c, unnest([s, l, p, p, q, dl]) AS value) u""")

# ------------------------------------------------------------ identities, bounds, continuity
V["margin"] = f"SELECT customer, strftime(date, '%Y-%m') AS month, sum(amount) AS revenue, sum(cost) AS cost {W} GROUP BY 1, 2"
q("q7_identities", lambda t: quality.identities(t.sales, t.purchases, star.mart_margin_customer_month(t.sales_lines)), """
  SELECT 'sales.net' AS "check", round(sum(ttc), 1) AS "left", round(sum(ttc), 1) AS "right", true AS holds FROM sales
  UNION ALL SELECT 'sales.partition', count(*), count(*), true FROM sales UNION ALL SELECT 'purchases.net', round(sum(ttc), 1), round(sum(ttc), 1), true FROM purchases
  UNION ALL SELECT 'margin.definition', round(sum(revenue) - sum(cost), 1), round(sum(revenue) - sum(cost), 1), true FROM margin""")
q("q8_plausibility", lambda t: quality.plausibility(quality.dashboard_measures(t.sales, t.purchases, star.mart_margin_customer_month(t.sales_lines))), """
  WITH h AS (SELECT sum(ttc) AS r FROM sales GROUP BY customer HAVING r > 0), m AS (
    SELECT 'credit_rate_pct' AS metric, -sum(ttc) FILTER (is_credit) * 100 / sum(ttc) FILTER (NOT is_credit) AS v, 0.0 AS lo, 15.0 AS hi FROM sales
    UNION ALL SELECT 'margin_rate_pct', (sum(revenue) - sum(cost)) * 100 / sum(revenue), 0, 80 FROM margin
    UNION ALL SELECT 'ttc_ht_ratio', sum(ttc) FILTER (NOT is_credit) / sum(ht) FILTER (NOT is_credit), 1.0, 1.3 FROM sales
    UNION ALL SELECT 'hhi', sum(r * r) * 10000 / (sum(r) * sum(r)), 0.0001, 10000 FROM h
    UNION ALL SELECT 'mean_granted_delay', avg(delay_days) FILTER (NOT is_credit), -10, 400 FROM sales
    UNION ALL SELECT 'mean_obtained_delay', avg(delay_days) FILTER (NOT is_credit), -10, 400 FROM purchases
    UNION ALL SELECT 'mean_basket', sum(ttc) / count(*) FILTER (NOT is_credit), 0, 1000000 FROM sales)
  SELECT metric, round(v, 6) AS value, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high, CASE WHEN v BETWEEN lo AND hi THEN 'ok' ELSE 'alert' END AS status FROM m""")
q("q9_sign_rules", lambda t: quality.sign_rules(t.sales, t.sales_line_facts), """
  SELECT unnest(['negative_sale', 'no_return_line', 'negative_ageing_band']) AS rule, 0 AS violations""")
q("q10_header_line_reconciliation", lambda t: quality.header_line_reconciliation(t.sales, t.sales_line_facts), """
  WITH h AS (SELECT sum(ht) AS h, sum(ttc) AS tt FROM sales), l AS (SELECT sum(amount) AS l FROM lines)
  SELECT round(h, 1) AS header_ht, round(l, 1) AS line_total, round(abs(l - h) / abs(h) * 100, 6) AS gap_pct, abs(l - h) / abs(h) * 100 > 15 AS gap_alert,
    l > tt * 1.05 AS lines_exceed_invoices FROM h, l""")
q("q11_implausible_values", lambda t: quality.implausible_values(t.sales, t.sales_lines, t.raw("lineitem").join(
    t.raw("orders").select(c("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("date")), "l_orderkey")
    .select("date", F.to_date("l_shipdate").alias("due"))), """
  SELECT 'unit_price' AS rule, count(*) FILTER (pu > 5000000 OR pu < 0.001) AS n FROM (SELECT sum(amount) / sum(qty) AS pu FROM lines WHERE qty > 0 AND amount > 0 GROUP BY label)
  UNION ALL SELECT 'ttc_below_ht', count(*) FILTER (abs(ttc) < abs(ht) - 0.01) FROM sales
  UNION ALL SELECT 'due_before_issue', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate < o_orderdate""")
q("q12_c6_missing_months", lambda t: quality.missing_months(t.sales.filter(F.month("date") != 7)), """
  SELECT make_date(y, 7, 1) AS month FROM (SELECT unnest(range(1995, 2002)) AS y)""")
q("q12_f4_yearly_collapse", lambda t: quality.yearly_collapse(t.sales.filter((c("year") != 1997) | (F.month("date") < 4))), """
  WITH y AS (SELECT year, sum(ttc) AS r FROM sales WHERE NOT is_credit AND (year <> 1997 OR month(date) < 4) GROUP BY 1), x AS (
    SELECT *, lag(r) OVER (ORDER BY year) AS p, sum(r) OVER () AS t, max(year) OVER () AS last FROM y)
  SELECT year, round(r, 2) AS revenue, round((r - p) * 100 / p, 6) AS change_pct,
    coalesce(year <> last AND r / t >= 0.02 AND p / t >= 0.02 AND (r - p) * 100 / p < -60, false) AS collapse, year <> last AND r / t >= 0.02 AS full_year FROM x""")
q("q13_verdict", lambda t: quality.verdict(quality.warehouse_checks(*built(t))), """
  SELECT 0 AS errors, CASE WHEN (SELECT count(*) FROM kept WHERE ok = false) > 0 THEN 7 ELSE 6 END AS alerts, 36 AS checks, 'alert' AS verdict""")

# ------------------------------------------------------------ profiling
q("q14_column_profile", lambda t: quality.column_profile(t.raw("orders").withColumn("void", F.lit(None).cast("string"))), """
  WITH n AS (SELECT count(*) AS n FROM orders), p AS (
    SELECT 'o_orderkey' AS "column", count(DISTINCT o_orderkey) AS d, 'numeric' AS k FROM orders UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey), 'numeric' FROM orders
    UNION ALL SELECT 'o_orderstatus', count(DISTINCT o_orderstatus), 'string' FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice), 'numeric' FROM orders
    UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate), 'date' FROM orders UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), 'string' FROM orders
    UNION ALL SELECT 'void', 0, 'empty')
  SELECT "column", n AS rows, CASE WHEN k = 'empty' THEN n ELSE 0 END AS missing, CASE WHEN k = 'empty' THEN 1.0 ELSE 0.0 END AS missing_rate, d AS distinct,
    k AS inferred_type, d <= 1 AS constant FROM p, n""")
q("q14_top_values", lambda t: quality.top_values(t.raw("orders").select("o_orderstatus", "o_orderpriority", "o_custkey")), """
  WITH v AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2)
  SELECT "column", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank, value, n FROM v QUALIFY rank <= 5""")
q("q14_table_profile", lambda t: quality.table_profile(t.raw("events").select("user_id", "event_type")), """
  SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicate_rows FROM events""")
q("q15_candidate_keys", lambda t: quality.candidate_keys(t.raw("orders").withColumn("pair_key", F.col("o_orderkey") % 10007)),
  """WITH n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS a, count(DISTINCT o_totalprice) AS b, count(DISTINCT o_orderkey % 10007) AS p,
       count(DISTINCT (o_totalprice, o_orderkey % 10007)) AS bp FROM orders),
  k AS (SELECT 'o_orderkey' AS candidate_key, 'single' AS kind, a = n AS ok FROM n UNION ALL SELECT 'o_totalprice', 'single', b = n FROM n
    UNION ALL SELECT 'o_orderkey + o_totalprice', 'pair', b >= 0.4 * n FROM n UNION ALL SELECT 'o_orderkey + pair_key', 'pair', p >= 0.4 * n FROM n
    UNION ALL SELECT 'o_totalprice + pair_key', 'pair', bp = n AND b >= 0.4 * n AND p >= 0.4 * n FROM n)
  SELECT candidate_key, kind FROM k WHERE ok""")
q("q15_inclusion", lambda t: quality.inclusion(t.raw("orders"), "o_custkey", t.raw("customer"), "c_custkey"), """
  WITH a AS (SELECT DISTINCT o_custkey AS v FROM orders), b AS (SELECT DISTINCT c_custkey AS v FROM customer), x AS (SELECT count(*) AS n FROM a JOIN b USING (v))
  SELECT 'o_custkey / c_custkey' AS columns, (SELECT count(*) FROM a) AS left_values, (SELECT count(*) FROM b) AS right_values, n AS common,
    round(n / (SELECT count(*) FROM a), 6) AS left_ratio, round(n / (SELECT count(*) FROM b), 6) AS right_ratio FROM x""")
q("q16_class_coverage", lambda t: quality.class_coverage(t.products.withColumn("label", classed()), "list_price"), """
  WITH g AS (SELECT class, origin, count(*) AS n, sum(list_price) AS v FROM classed GROUP BY 1, 2)
  SELECT class, origin, n AS "references", round(v, 2) AS value, round(n * 100.0 / sum(n) OVER (), 6) AS references_pct, round(v * 100 / sum(v) OVER (), 6) AS value_pct FROM g""")
q("q17_reader_accuracy", lambda t: quality.reader_accuracy(t.raw("orders").select(
    c("o_orderpriority").alias("reader"), F.to_json(F.struct(c("o_orderkey").cast("string").alias("number"), c("o_totalprice").cast("string").alias("total"))).alias("read_json"),
    F.when(c("o_orderkey") % 5 == 0, F.lit('{"total": "1"}')).when(c("o_orderkey") % 7 == 0, F.lit('{"number": "2", "total": "3"}')).otherwise(F.lit("{}")).alias("corrections_json"))), """
  WITH f AS (SELECT o_orderpriority AS reader, 'number' AS field, o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AS bad FROM orders
    UNION ALL SELECT o_orderpriority, 'total', o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 FROM orders)
  SELECT reader, field, count(*) AS n, count(*) FILTER (bad) AS corrected, round((1 - count(*) FILTER (bad) / count(*)) * 100, 6) AS accuracy_pct FROM f GROUP BY 1, 2""")
