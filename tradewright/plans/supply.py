"""Procurement and stock queries (p1..p24, c3, c14, c21, c23)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import procurement as pro
from tradewright.operators import star, stock
from tradewright.plans.registry import register

c = F.col
GAPS = """SELECT * FROM (SELECT reference, date, datediff('day', lag(date) OVER (PARTITION BY reference ORDER BY date), date) AS gap
        FROM (SELECT DISTINCT reference, date FROM purchase_lines)) WHERE gap > 0"""
V = {
    "gaps": GAPS,
    "buys": """SELECT p.*, CASE WHEN stock_flag = 'O' AND p.reference % 9 = 0 THEN concat('contrat ', label, ' ', p.reference) ELSE concat(label, ' ', p.reference) END AS label,
        FROM purchase_lines p JOIN products USING (reference)""",
    "outs": "SELECT * REPLACE (concat(label, ' ', reference) AS label) FROM lines",
    "chosen": """SELECT stock_flag AS f FROM buys GROUP BY 1 HAVING count(*) >= 50 ORDER BY round(count(*) FILTER (regexp_matches(label, '(?i)\\bcontrat\\b')) * 100.0 / count(*), 2), 1 LIMIT 1""",
    "flow": """SELECT coalesce(a.key, v.key) AS key, coalesce(al, vl) AS product, family, coalesce(qi, 0) AS qty_in, coalesce(qo, 0) AS qty_out, coalesce(qi, 0) - coalesce(qo, 0) AS position,
        coalesce(ai, 0) AS amount_in, coalesce(ao, 0) AS amount_out, CASE WHEN qi > 0 THEN ai / qi END AS unit_cost, last_purchase, last_sale, coalesce(am, 0) AS active_months,
        CASE WHEN am > 0 THEN qo / am END AS monthly_use, qi IS NOT NULL AND qo IS NOT NULL AS matched,
        coalesce(al, vl) LIKE 'contrat%' OR coalesce(family LIKE 'SERVICE%', false) AS is_service
        FROM (SELECT upper(label) AS key, min(label) AS al, sum(qty) AS qi, sum(amount) AS ai, max(date) AS last_purchase FROM buys, chosen WHERE stock_flag = f GROUP BY 1) a
        FULL OUTER JOIN (SELECT upper(label) AS key, min(label) AS vl, min(family) AS family, sum(qty) AS qo, sum(amount) AS ao, max(date) AS last_sale,
          count(DISTINCT strftime(date, '%Y-%m')) AS am FROM outs WHERE qty > 0 GROUP BY 1) v ON a.key = v.key""",
    "months": """SELECT key, product, unit_cost, m AS month, coalesce(qi, 0) AS qty_in, coalesce(qo, 0) AS qty_out, sum(coalesce(qi, 0)) OVER w AS cum_in, sum(coalesce(qo, 0)) OVER w AS cum_out,
        sum(coalesce(qi, 0) - coalesce(qo, 0)) OVER w AS position, row_number() OVER (PARTITION BY key ORDER BY m) AS month_rank
        FROM (SELECT key, product, unit_cost, m FROM flow, (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS m FROM (
            SELECT least((SELECT date_trunc('month', min(date)) FROM buys, chosen WHERE stock_flag = f), (SELECT date_trunc('month', min(date)) FROM outs WHERE qty > 0)) AS lo,
              greatest((SELECT date_trunc('month', max(date)) FROM buys, chosen WHERE stock_flag = f), (SELECT date_trunc('month', max(date)) FROM outs WHERE qty > 0)) AS hi))
          WHERE matched AND NOT is_service) g
        LEFT JOIN (SELECT upper(label) AS key, CAST(date_trunc('month', date) AS DATE) AS m, sum(qty) AS qi FROM buys, chosen WHERE stock_flag = f GROUP BY 1, 2) USING (key, m)
        LEFT JOIN (SELECT upper(label) AS key, CAST(date_trunc('month', date) AS DATE) AS m, sum(qty) AS qo FROM outs WHERE qty > 0 GROUP BY 1, 2) USING (key, m)
        WINDOW w AS (PARTITION BY key ORDER BY m ROWS UNBOUNDED PRECEDING)""",
    "snap0": """SELECT reference, concat(label, ' #', reference) AS product, family, greatest(coalesce(sum(-qty) FILTER (qty < 0), 0) / 20 - 5, 0) AS stock,
        coalesce(sum(qty) FILTER (qty > 0), 0) / 2400 AS daily_demand, max(list_price) * 0.6 AS unit_cost FROM products LEFT JOIN (SELECT reference, qty FROM lines) USING (reference) GROUP BY 1, 2, 3""",
    "snap": """SELECT *, daily_demand * 45 AS reorder_point, daily_demand * 15 AS safety, daily_demand * 90 AS target, stock * unit_cost AS value, 45 AS lead_days,
        DATE '2001-08-01' + CAST(reference * 37 % 400 AS INTEGER) AS expiry, CASE WHEN stock <= 0 THEN 'stockout' WHEN stock <= daily_demand * 45 THEN 'to_order'
        WHEN stock > daily_demand * 90 THEN 'overstock' ELSE 'healthy' END AS situation FROM snap0""",
    "po": """SELECT l_partkey AS reference, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN 'to_validate' WHEN 1 THEN 'validated' WHEN 2 THEN 'ordered' WHEN 3 THEN 'received' ELSE 'refused' END AS status,
        l_extendedprice AS est_amount, CAST(l_shipdate AS DATE) AS ordered, CASE WHEN (l_orderkey + l_linenumber) % 5 = 3 THEN CAST(l_shipdate AS DATE) + CAST(l_orderkey % 37 AS INTEGER) END AS received
        FROM lineitem WHERE l_quantity = 50""",
    "owned": """SELECT CASE WHEN customer % 2 = 0 THEN CAST(customer AS VARCHAR) ELSE customer_name END AS owner, r * 0.72 AS value,
        CASE CAST(q AS BIGINT) % 4 WHEN 0 THEN 'stockout' WHEN 1 THEN 'overstock' WHEN 2 THEN 'to_order' ELSE 'healthy' END AS situation
        FROM (SELECT customer, label, sum(qty) AS q, sum(amount) AS r FROM lines GROUP BY 1, 2 HAVING sum(qty) > 0) JOIN customers USING (customer)""",
    "future": """SELECT * FROM (SELECT concat(label, ' #', reference) AS product, month, sum(q) OVER w AS future_qty, count(*) OVER w AS n FROM (
        SELECT reference, label, CAST(date_trunc('month', date) AS DATE) AS month, sum(qty) AS q FROM lines WHERE qty > 0 GROUP BY 1, 2, 3)
        WINDOW w AS (PARTITION BY reference ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE n = 3""",
}


def q(name, build, sql):
    register(name, build, sql, V)


def buys(t):
    """Purchase lines with a product label; part of the pending ones are maintenance contracts."""
    label = F.concat_ws(" ", "label", c("reference").cast("string"))
    service = (c("stock_flag") == "O") & (c("reference") % 9 == 0)
    return t.purchase_lines.join(t.products.select("reference", "label"), "reference").withColumn(
        "label", F.when(service, F.concat(F.lit("contrat "), label)).otherwise(label))


def outs(t):
    return t.sales_lines.withColumn("label", F.concat_ws(" ", "label", c("reference").cast("string")))


def flow(t):
    return stock.stock_flow(buys(t), outs(t))


def with_opening(t):
    """Flow with an opening stock of twice the quantity bought."""
    return flow(t).withColumn("position", c("position") + 2 * c("qty_in"))


def snapshot(t):
    """Inventory snapshot read from returns and sales of each product."""
    per = t.sales_line_facts.groupBy("reference").agg(R.sum_where(-c("qty"), c("qty") < 0).alias("back"), R.sum_where(c("qty"), c("qty") > 0).alias("sold"))
    s = t.products.join(per, "reference", "left").select(
        "reference", F.concat(c("label"), F.lit(" #"), c("reference").cast("string")).alias("product"), "family",
        F.greatest(F.coalesce("back", F.lit(0.0)) / 20 - 5, F.lit(0.0)).alias("stock"), (F.coalesce("sold", F.lit(0.0)) / 2400).alias("daily_demand"),
        (c("list_price") * 0.6).alias("unit_cost"))
    d = c("daily_demand")
    return s.withColumns({"reorder_point": d * 45, "safety": d * 15, "target": d * 90, "value": c("stock") * c("unit_cost"), "lead_days": F.lit(45),
                          "expiry": F.date_add(F.lit("2001-08-01").cast("date"), (c("reference") * 37 % 400).cast("int")),
                          "situation": F.when(c("stock") <= 0, "stockout").when(c("stock") <= d * 45, "to_order").when(c("stock") > d * 90, "overstock").otherwise("healthy")})


def purchase_orders(t):
    k = (c("l_orderkey") + c("l_linenumber")) % 5
    day = F.to_date("l_shipdate")
    return t.raw("lineitem").filter("l_quantity = 50").select(
        c("l_partkey").alias("reference"), F.when(k == 0, "to_validate").when(k == 1, "validated").when(k == 2, "ordered").when(k == 3, "received").otherwise("refused").alias("status"),
        c("l_extendedprice").alias("est_amount"), day.alias("ordered"), F.when(k == 3, F.date_add(day, (c("l_orderkey") % 37).cast("int"))).alias("received"))


def today(t):
    return t.sales.agg(F.max("date")).scalar()


# ------------------------------------------------------------ suppliers
q("p1_supplier_ranking", lambda t: pro.supplier_ranking(t.purchases, t.purchase_lines, t.suppliers, 1.0), """
  WITH a AS (SELECT supplier, sum(ttc) AS m, count(*) AS documents, sum(ttc * delay_days) / sum(ttc) AS d, max(date) AS last_purchase FROM purchases GROUP BY 1),
  r AS (SELECT supplier, count(DISTINCT reference) AS n_references FROM purchase_lines GROUP BY 1)
  SELECT supplier, supplier_name, country, round(m, 2) AS amount, round(m * 100 / (SELECT sum(ttc) FROM purchases), 6) AS share_pct, documents, n_references, round(d, 6) AS obtained_delay,
    last_purchase, m * 100 / (SELECT sum(ttc) FROM purchases) >= 1 AS dependency FROM a LEFT JOIN r USING (supplier) LEFT JOIN suppliers USING (supplier)""")
q("p2_purchases_by_country", lambda t: pro.purchases_by_country(t.purchases, t.suppliers), """
  WITH g AS (SELECT coalesce(country, 'unknown') AS country, count(DISTINCT supplier) AS suppliers, sum(ttc) AS m FROM purchases LEFT JOIN suppliers USING (supplier) GROUP BY 1)
  SELECT country, suppliers, round(m, 2) AS amount, round(m * 100 / (SELECT sum(m) FROM g), 6) AS share_pct FROM g ORDER BY m DESC, country LIMIT 8""")
q("p3_supplier_concentration", lambda t: pro.supplier_concentration(t.purchases), """
  WITH g AS (SELECT supplier, sum(ttc) AS m FROM purchases GROUP BY 1), s AS (SELECT sum(m) AS t FROM g)
  SELECT count(*) AS suppliers, round(sum(m * m) * 10000 / (max(t) * max(t)), 6) AS hhi, round(max(m) * 100 / max(t), 6) AS top1_pct,
    round((SELECT sum(m) FROM (SELECT m FROM g ORDER BY m DESC LIMIT 3)) * 100 / max(t), 6) AS top3_pct,
    CASE WHEN max(m) * 100 / max(t) >= 50 THEN 'critical' WHEN max(m) * 100 / max(t) >= 30 THEN 'high' WHEN max(m) * 100 / max(t) >= 15 THEN 'moderate' ELSE 'low' END AS dependency FROM g, s""")
RARE = "reference % 50 < 49 OR supplier < 7"
q("p4_single_source", lambda t: pro.single_source(t.purchase_lines.withColumn("supplier", F.when(c("reference") % 3 == 0, c("reference") % 10).otherwise(c("supplier")))), """
  SELECT reference, min(s) AS supplier, round(sum(amount), 2) AS amount, max(date) AS last_purchase FROM (SELECT *, CASE WHEN reference % 3 = 0 THEN reference % 10 ELSE supplier END AS s FROM purchase_lines)
  GROUP BY 1 HAVING count(DISTINCT s) = 1""")
q("p4_single_source_summary", lambda t: pro.single_source_summary(t.purchase_lines.withColumn("supplier", F.when(c("reference") % 3 == 0, c("reference") % 10).otherwise(c("supplier")))), """
  WITH g AS (SELECT reference, count(DISTINCT CASE WHEN reference % 3 = 0 THEN reference % 10 ELSE supplier END) AS n, sum(amount) AS m FROM purchase_lines GROUP BY 1)
  SELECT count(*) AS "references", count(*) FILTER (n = 1) AS single_source, round(count(*) FILTER (n = 1) * 100.0 / count(*), 6) AS share_pct, round(sum(m) FILTER (n = 1), 2) AS amount FROM g""")
q("p5_f3_replenishment_rhythm", lambda t: pro.rhythm(t.purchase_lines), """
  SELECT median(gap) AS median_gap, round(avg(gap), 6) AS mean_gap, count(*) AS gaps, count(DISTINCT reference) AS "references" FROM gaps""")
q("p6_c9_c10_overdue_replenishment", lambda t: pro.overdue_replenishment(t.purchase_lines, t.sales_line_facts, t.products), """
  WITH fin AS (SELECT max(date) AS d FROM purchase_lines), sold AS (SELECT reference, max(date) AS last_sale FROM lines GROUP BY 1 HAVING max(date) >= (SELECT max(date) FROM lines) - INTERVAL 12 MONTH),
  r AS (SELECT reference, median(gap) AS med, count(*) AS n_gaps, max(date) AS last_purchase FROM gaps GROUP BY 1 HAVING count(*) >= 3 AND median(gap) >= 7),
  lot AS (SELECT reference, qty, amount FROM purchase_lines QUALIFY row_number() OVER (PARTITION BY reference ORDER BY date DESC, qty DESC, amount DESC) = 1),
  us AS (SELECT reference, supplier FROM purchase_lines GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY reference ORDER BY count(*) DESC, supplier) = 1)
  SELECT r.reference, label, med AS median_gap, n_gaps, last_purchase, datediff('day', last_purchase, d) AS days_since, round(datediff('day', last_purchase, d) / med, 6) AS lateness, last_sale,
    lot.qty AS last_lot_qty, round(lot.amount, 4) AS last_lot_amount, us.supplier AS usual_supplier
  FROM r JOIN sold USING (reference) JOIN products USING (reference) LEFT JOIN lot USING (reference) LEFT JOIN us USING (reference), fin
  WHERE datediff('day', last_purchase, d) > med ORDER BY datediff('day', last_purchase, d) / med DESC, r.reference LIMIT 12""")
THREAT = """WITH u AS (SELECT customer, reference, sum(qty) AS qty, sum(amount) AS r, count(DISTINCT strftime(date, '%Y-%m')) AS active_months, max(date) AS last_sale FROM lines
    WHERE amount > 0 AND date >= (SELECT max(date) FROM lines) - INTERVAL 12 MONTH GROUP BY 1, 2),
  a AS (SELECT reference, max(date) AS last_purchase FROM purchase_lines GROUP BY 1), y AS (SELECT reference, round(median(gap)) AS rhythm FROM gaps GROUP BY 1 HAVING count(*) >= 3),
  x AS (SELECT *, datediff('day', last_purchase, (SELECT max(date) FROM purchase_lines)) AS days_since FROM u LEFT JOIN a USING (reference) LEFT JOIN y USING (reference))"""
q("p7_supply_threat", lambda t: pro.supply_threat(t.sales_line_facts, t.purchase_lines), THREAT + """
  SELECT customer, reference, round(qty, 2) AS qty, round(r, 4) AS revenue, active_months, last_sale, last_purchase, rhythm, days_since, coalesce(days_since > rhythm * 1.5, false) AS threatened FROM x""")
q("p7_supply_threat_by_customer", lambda t: pro.supply_threat_by_customer(pro.supply_threat(t.sales_line_facts, t.purchase_lines)), THREAT + """
  , y2 AS (SELECT customer, round(r, 4) AS r, coalesce(days_since > rhythm * 1.5, false) AS th FROM x)
  SELECT customer, count(*) AS products, round(sum(r), 4) AS revenue, count(*) FILTER (th) AS threatened_products, round(coalesce(sum(r) FILTER (th), 0), 4) AS threatened_revenue,
    round(coalesce(sum(r) FILTER (th), 0) * 100 / sum(r), 6) AS threatened_pct FROM y2 GROUP BY 1""")

# ------------------------------------------------------------ stock flow
q("p9_movement_flags", lambda t: stock.movement_flags(buys(t)), """
  SELECT stock_flag AS flag, count(*) AS lines, count(*) FILTER (label LIKE 'contrat%') AS services, count(DISTINCT label) AS labels,
    round(count(*) FILTER (label LIKE 'contrat%') * 100.0 / count(*), 2) AS service_pct FROM buys GROUP BY 1""")
q("p9_movement_flag", lambda t: stock.movement_flag(buys(t)), "SELECT f AS flag FROM chosen")
q("p10_c3_stock_flow", lambda t: flow(t).withColumns({x: F.round(c(x) + 1e-9, 6) for x in ("amount_in", "amount_out", "unit_cost", "monthly_use")}), """
  SELECT * REPLACE (round(amount_in + 1e-9, 6) AS amount_in, round(amount_out + 1e-9, 6) AS amount_out, round(unit_cost + 1e-9, 6) AS unit_cost, round(monthly_use + 1e-9, 6) AS monthly_use) FROM flow""")
q("p11_flow_summary", lambda t: stock.flow_summary(flow(t)), """
  SELECT count(*) AS products, count(*) FILTER (matched) AS matched, count(*) FILTER (is_service) AS services, count(*) FILTER (position > 0 AND NOT is_service) AS positive,
    count(*) FILTER (position < 0 AND NOT is_service) AS negative, round(sum(position * unit_cost) FILTER (position > 0 AND NOT is_service), 2) AS immobilised_value,
    round(sum(qty_out) FILTER (matched), 2) AS matched_volume, round(sum(qty_out), 2) AS volume,
    count(*) FILTER (position > 0 AND NOT is_service AND monthly_use > 0 AND position > 24 * monthly_use) AS over_two_years FROM flow""")
q("p11_top_immobilised", lambda t: stock.top_immobilised(flow(t)), """
  SELECT product, round(position, 2) AS position, round(position * unit_cost, 2) AS value, round(monthly_use, 6) AS monthly_use, round(position / monthly_use, 6) AS cover_months FROM flow f
  WHERE f.position > 0 AND NOT is_service AND unit_cost IS NOT NULL AND f.monthly_use > 0 ORDER BY f.position * unit_cost DESC, key LIMIT 12""")
q("p8_position_coverage", lambda t: stock.coverage_summary(flow(t)), """
  SELECT count(*) AS products, count(*) FILTER (matched) AS matched, count(*) FILTER (position < 0) AS negative, count(*) FILTER (monthly_use > 0) AS with_use,
    min(last_purchase) AS first_purchase, max(last_purchase) AS last_purchase, round(count(*) FILTER (matched) * 100.0 / count(*), 6) AS matched_pct FROM flow WHERE NOT is_service""")
MD = "year({0}) * 12 + month({0})"
q("p12_stockouts", lambda t: stock.stockouts(flow(t)), f"""
  WITH x AS (SELECT *, position / monthly_use AS cover, (SELECT {MD.format('max(last_sale)')} FROM flow) AS now FROM flow)
  SELECT product, round(position, 2) AS position, round(monthly_use, 6) AS monthly_use, CASE WHEN cover >= 0 THEN round(cover, 6) END AS cover_months,
    now - ({MD.format('last_purchase')}) AS months_without_purchase, round(unit_cost, 6) AS unit_cost, round(greatest(x.monthly_use * 3 - greatest(x.position, 0), 0), 4) AS suggested_qty,
    CASE WHEN cover < 0 THEN 'probable_stockout' WHEN cover < 1 THEN 'critical' ELSE 'to_order' END AS severity
  FROM x WHERE NOT is_service AND x.monthly_use > 0 AND last_purchase IS NOT NULL AND last_sale IS NOT NULL AND now - ({MD.format('last_sale')}) <= 3 AND cover < 2""")
OBS = """WITH f2 AS (SELECT * REPLACE (position + 2 * qty_in AS position) FROM flow), o AS (SELECT *, position / monthly_use AS cover FROM f2 WHERE NOT is_service AND position > 0 AND monthly_use > 0 AND unit_cost IS NOT NULL
    AND coalesce(family, '') NOT LIKE 'EQUIPEMENT%' AND coalesce(family, '') NOT LIKE 'SERVICE%' AND position / monthly_use >= 12)"""
q("p13_obsolescence", lambda t: stock.obsolescence_list(with_opening(t)), OBS + """
  , x AS (SELECT *, greatest(position - monthly_use * CASE WHEN cover >= 24 THEN 24 ELSE 12 END, 0) AS e FROM o)
  SELECT product, round(position, 2) AS position, round(monthly_use, 6) AS monthly_use, round(cover, 6) AS cover_months, round(e, 4) AS excess_qty, round(e * unit_cost, 2) AS loss,
    CASE WHEN cover >= 24 THEN 'near_certain_loss' ELSE 'slow_rotation' END AS severity FROM x WHERE e * unit_cost >= 100""")
q("p14_h3_threshold_sensitivity", lambda t: stock.threshold_sensitivity(with_opening(t)), OBS + """
  , x AS (SELECT *, greatest(position - monthly_use * t, 0) * unit_cost AS loss FROM o, (SELECT unnest([18, 24, 30, 36]) AS t) WHERE cover >= t),
  k AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY loss DESC, key) AS r FROM x WHERE loss >= 100), ref AS (SELECT key FROM k WHERE t = 24 AND r <= 10)
  SELECT t AS threshold, count(*) AS products, round(sum(loss), 2) AS loss, count(*) FILTER (r <= 10 AND key IN (SELECT key FROM ref)) AS common_with_served,
    round(count(*) FILTER (r <= 10 AND key IN (SELECT key FROM ref)) * 100.0 / (SELECT count(*) FROM ref), 6) AS common_pct FROM k GROUP BY 1""")
q("p15_c8_f6_monthly_positions", lambda t: stock.monthly_positions(buys(t), outs(t)).select(
    "key", "month", F.round(c("unit_cost") + 1e-9, 6).alias("unit_cost"), "qty_in", "qty_out", "cum_in", "cum_out", "position", "month_rank"), """
  SELECT key, month, round(unit_cost + 1e-9, 6) AS unit_cost, qty_in, qty_out, cum_in, cum_out, position, month_rank FROM months WHERE cum_in > 0""")

# ------------------------------------------------------------ snapshot
q("p16_snapshot_kpis", lambda t: stock.snapshot_kpis(snapshot(t)), """
  WITH a AS (SELECT count(*) AS products, sum(value) AS v, sum(stock * daily_demand) / sum(daily_demand) AS cv, count(*) FILTER (stock <= reorder_point AND target - stock >= 1) AS to_order,
    count(*) FILTER (stock < safety AND daily_demand > 0) AS below_safety, count(*) FILTER (stock <= 0 AND daily_demand > 0) AS stockouts, count(*) FILTER (stock <= 0 AND daily_demand <= 0) AS dormant,
    count(*) FILTER (stock > target) AS overstock, sum(value) FILTER (stock > target) AS ov, sum(daily_demand * 365 * unit_cost) AS y FROM snap)
  SELECT products, round(v, 2) AS value, round(cv, 6) AS weighted_cover, to_order, below_safety, stockouts, dormant, overstock, round(ov, 2) AS overstock_value, round(y / v, 6) AS rotation,
    round(365 / (y / v), 4) AS stock_days, round((products - below_safety) * 100.0 / products, 6) AS service_rate_pct FROM a""")
q("p17_g6_reorder_alerts", lambda t: stock.reorder_alerts(snapshot(t)), """
  WITH x AS (SELECT *, round(greatest(0, target - stock), 6) AS order_qty, round(CASE WHEN daily_demand > 0 THEN greatest(0, (stock - safety) / daily_demand) END, 6) AS days_left,
    round(greatest(0, target - stock) * unit_cost, 4) AS order_value FROM snap WHERE stock <= reorder_point AND target - stock >= 1)
  SELECT product, family, order_qty, days_left, order_value, lead_days FROM x ORDER BY days_left NULLS FIRST, order_value DESC, product LIMIT 12""")
EXP = """WITH e AS (SELECT *, datediff('day', (SELECT max(date) FROM sales), expiry) AS days_left FROM snap),
  x AS (SELECT *, greatest(0, stock - daily_demand * days_left) AS lost_qty, greatest(0, stock - daily_demand * days_left) * unit_cost AS loss FROM e WHERE days_left > 0)"""
q("p17_expiry_alerts", lambda t: stock.expiry_alerts(snapshot(t), today(t)), EXP + """
  SELECT product, family, expiry, days_left, round(lost_qty, 6) AS lost_qty, round(loss, 6) AS loss FROM x WHERE x.lost_qty > 0 ORDER BY x.loss DESC, product LIMIT 12""")
q("p17_expiry_loss", lambda t: stock.expiry_loss(snapshot(t), today(t)).agg(F.round(F.sum("loss"), 2).alias("expected_loss")), EXP + " SELECT round(sum(loss), 2) AS expected_loss FROM x")
q("p17_snapshot_groups", lambda t: stock.snapshot_groups(snapshot(t)), """
  SELECT 'family' AS axis, family AS label, count(*) AS products, round(sum(value), 4) AS value, round(avg(CASE WHEN daily_demand > 0 THEN stock / daily_demand END), 6) AS mean_cover FROM snap GROUP BY 2
  UNION ALL SELECT 'situation', situation, count(*), round(sum(value), 4), round(avg(CASE WHEN daily_demand > 0 THEN stock / daily_demand END), 6) FROM snap GROUP BY 2""")
q("p17_top_overstock", lambda t: stock.top_overstock(snapshot(t)),
  "SELECT product, round(value, 4) AS value FROM snap s WHERE stock > target ORDER BY s.value DESC, product LIMIT 8")


def owned(t):
    d = star.mart_demand_customer_product(t.sales_lines).join(t.customers, "customer")
    k = c("qty").cast("long") % 4
    return d.select(F.when(c("customer") % 2 == 0, c("customer").cast("string")).otherwise(c("customer_name")).alias("owner"), (c("revenue") * 0.72).alias("value"),
                    F.when(k == 0, "stockout").when(k == 1, "overstock").when(k == 2, "to_order").otherwise("healthy").alias("situation"))


q("p18_c14_customer_exposure", lambda t: stock.customer_exposure(owned(t), t.customers), """
  WITH g AS (SELECT owner, count(*) AS products, sum(value) AS v, count(*) FILTER (situation = 'stockout') AS stockout, count(*) FILTER (situation = 'overstock') AS overstock,
    count(*) FILTER (situation = 'to_order') AS to_order, count(*) FILTER (situation = 'healthy') AS healthy, coalesce(sum(value) FILTER (situation = 'overstock'), 0) AS ov FROM owned GROUP BY 1 HAVING count(*) >= 3)
  SELECT owner, max(customer_name) AS customer_name, max(products) AS products, round(max(v), 6) AS value, max(stockout) AS stockout, max(overstock) AS overstock, max(to_order) AS to_order, max(healthy) AS healthy,
    max(stockout + overstock + to_order) AS at_risk, round(max(ov), 6) AS overstock_value, round(max(healthy * 100.0 / products), 6) AS healthy_pct, max(stockout + overstock + to_order) = 0 AS no_risk
  FROM g JOIN customers ON CAST(customer AS VARCHAR) = owner OR customer_name = owner GROUP BY 1""")
q("p19_annual_demand", lambda t: stock.annual_demand(star.mart_sales_product(outs(t))).withColumns({x: F.round(x, 4) for x in ("mean_qty", "std_qty", "unit_price")}), """
  WITH y AS (SELECT label, year(date) AS year, sum(qty) AS q, sum(amount) AS r FROM outs GROUP BY 1, 2 HAVING sum(qty) > 0)
  SELECT label, sum(q) AS qty, round(avg(q), 4) AS mean_qty, round(coalesce(stddev_samp(q), 0), 4) AS std_qty, count(*) AS n_years, max(year) AS last_year, round(sum(r) / sum(q), 4) AS unit_price
  FROM y GROUP BY 1 HAVING avg(q) >= 1""")
q("p20_customer_product_demand", lambda t: stock.customer_product_demand(star.mart_demand_customer_product(t.sales_lines), t.customers), """
  SELECT customer, customer_name, label, qty, round(r, 4) AS revenue, n_years, round(r / qty + 1e-9, 6) AS unit_price FROM (SELECT customer, label, sum(qty) AS qty, sum(amount) AS r,
    count(DISTINCT year(date)) AS n_years FROM lines GROUP BY 1, 2 HAVING sum(qty) > 0) JOIN customers USING (customer)""")


def future_demand(t):
    m = t.sales_lines.filter("qty > 0").groupBy("reference", "label", F.trunc("date", "month").alias("month")).agg(F.sum("qty").alias("q"))
    w = Window.partitionBy("reference").orderBy("month").rowsBetween(1, 3)
    return m.select(F.concat(c("label"), F.lit(" #"), c("reference").cast("string")).alias("product"), "month",
                    F.sum("q").over(w).alias("future_qty"), F.count(F.lit(1)).over(w).alias("n")).filter("n = 3").drop("n")


RISK = """WITH j AS (SELECT f.*, stock, unit_cost, value, datediff('day', (SELECT max(date) FROM sales), expiry) AS days FROM future f JOIN snap USING (product)),
  x AS (SELECT *, days <= 120 AND stock > future_qty AND stock > 0 AS e, future_qty > stock AS o, future_qty < stock * 0.5 AS s FROM j),
  lab AS (SELECT product, month, stock, future_qty, CASE WHEN e THEN 'expiry' WHEN o THEN 'stockout' WHEN s THEN 'overstock' ELSE 'none' END AS risk_type, CAST(o OR e OR s AS INTEGER) AS y,
    CASE WHEN e THEN greatest(0, stock - future_qty) * unit_cost WHEN o THEN greatest(0, future_qty - stock) * unit_cost ELSE value * 0.15 END AS exposure FROM x)"""
q("p21_c23_risk_labels", lambda t: stock.risk_labels(future_demand(t), snapshot(t), today(t)).withColumns({"stock": F.round("stock", 4), "exposure": F.round("exposure", 3)}),
  RISK + " SELECT * REPLACE (round(stock, 4) AS stock, round(exposure, 3) AS exposure) FROM lab")
q("p22_b18_risk_rollup", lambda t: stock.risk_rollup(stock.risk_labels(future_demand(t), snapshot(t), today(t)).withColumn("p", c("future_qty") % 101 / 100)), RISK + """
  , z AS (SELECT *, future_qty % 101 / 100 * exposure AS impact, CASE WHEN future_qty % 101 / 100 * 100 >= 80 THEN 'critical' WHEN future_qty % 101 / 100 * 100 >= 60 THEN 'high'
    WHEN future_qty % 101 / 100 * 100 >= 35 THEN 'medium' ELSE 'low' END AS band FROM lab)
  SELECT 'band' AS axis, band AS label, count(*) AS products, round(sum(impact), 2) AS impact FROM z GROUP BY 2 UNION ALL SELECT 'risk_type', risk_type, count(*), round(sum(impact), 2) FROM z GROUP BY 2""")
q("p23_order_loop", lambda t: pro.order_loop(purchase_orders(t)), """
  SELECT count(*) AS orders, count(*) FILTER (status = 'to_validate') AS to_validate, count(*) FILTER (status = 'validated') AS validated, count(*) FILTER (status = 'ordered') AS ordered,
    count(*) FILTER (status = 'received') AS received, count(*) FILTER (status = 'refused') AS refused, round(sum(est_amount) FILTER (status IN ('validated', 'ordered')), 2) AS committed,
    count(received) AS receipts, min(datediff('day', po.ordered, po.received)) AS min_lead, median(datediff('day', po.ordered, po.received)) AS median_lead, max(datediff('day', po.ordered, po.received)) AS max_lead FROM po""")
q("c21_open_proposals", lambda t: pro.open_proposals(pro.overdue_replenishment(t.purchase_lines, t.sales_line_facts, t.products, 1000000), purchase_orders(t)).select("reference", "median_gap", "days_since"), """
  WITH fin AS (SELECT max(date) AS d FROM purchase_lines), sold AS (SELECT reference FROM lines GROUP BY 1 HAVING max(date) >= (SELECT max(date) FROM lines) - INTERVAL 12 MONTH),
  r AS (SELECT reference, median(gap) AS med, max(date) AS last FROM gaps GROUP BY 1 HAVING count(*) >= 3 AND median(gap) >= 7)
  SELECT reference, med AS median_gap, datediff('day', last, d) AS days_since FROM r JOIN sold USING (reference), fin WHERE datediff('day', last, d) > med
    AND reference NOT IN (SELECT reference FROM po WHERE status <> 'received')""")
q("p24_policy_parameters", lambda t: stock.policy_parameters(stock.annual_demand(star.mart_sales_product(outs(t))).join(
    outs(t).groupBy("label").agg(F.min("family").alias("family")), "label"), F.split("family", " ")[0]).select(
        "label", "kind", *[F.round(c(x) + 1e-9, 6).alias(x) for x in ("daily_demand", "daily_sigma", "safety", "reorder_point", "target", "unit_cost")]), """
  WITH y AS (SELECT label, min(family) AS f, year(date) AS year, sum(qty) AS q, sum(amount) AS r FROM outs GROUP BY 1, 3 HAVING sum(qty) > 0),
  d AS (SELECT label, avg(q) / 365 AS dd, coalesce(stddev_samp(q), 0) / 365 AS sd, count(*) AS n, sum(r) / sum(q) AS pu, CASE split_part(min(f), ' ', 1) WHEN 'REACTIF' THEN 'REACTIF'
      WHEN 'EQUIPEMENT' THEN 'EQUIPEMENT' ELSE 'DEFAULT' END AS kind FROM y GROUP BY 1 HAVING avg(q) >= 1),
  p AS (SELECT *, greatest(CASE WHEN n > 1 THEN sd ELSE dd * 0.35 END, dd * 0.15) AS sg, CASE kind WHEN 'REACTIF' THEN 45 WHEN 'EQUIPEMENT' THEN 75 ELSE 40 END AS l,
      CASE kind WHEN 'EQUIPEMENT' THEN 90 ELSE 60 END AS cv FROM d)
  SELECT label, kind, round(dd + 1e-9, 6) AS daily_demand, round(sg + 1e-9, 6) AS daily_sigma, round(1.65 * sg * sqrt(l) + 1e-9, 6) AS safety, round(dd * l + 1.65 * sg * sqrt(l) + 1e-9, 6) AS reorder_point,
    round(dd * l + 1.65 * sg * sqrt(l) + dd * cv + 1e-9, 6) AS target, round(greatest(pu, 0) * 0.72 + 1e-9, 6) AS unit_cost FROM p""")
