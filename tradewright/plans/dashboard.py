"""Dashboard queries (indicator IDs k1..k40) with their SQL checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import kpi
from tradewright.operators import star
from tradewright.plans.registry import register

V = {
    "bounds": """SELECT max(date) AS fin, CAST(max(date) - INTERVAL 12 MONTH AS DATE) + 1 AS deb,
        CAST(CAST(max(date) - INTERVAL 12 MONTH AS DATE) + 1 - INTERVAL 12 MONTH AS DATE) AS cdeb,
        CAST(max(date) - INTERVAL 12 MONTH AS DATE) AS cfin FROM sales""",
    "cur": "SELECT s.* FROM sales s, bounds WHERE date BETWEEN deb AND fin",
    "curbuy": "SELECT p.* FROM purchases p, bounds WHERE date BETWEEN deb AND fin",
    "recent": "SELECT * FROM cur WHERE due >= (SELECT max(due) FROM cur) - INTERVAL 6 MONTH",
    "curline": "SELECT l.* FROM lines l, bounds WHERE date BETWEEN deb AND fin",
}


def cur(t):
    return kpi.scope(t.sales)


def curbuy(t):
    return kpi.within(t.purchases, kpi.reference_period(t.sales))


def q(name, build, sql):
    register(name, build, sql, V)


q("b22_reference_period", lambda t: kpi.reference_period(t.sales),
  "SELECT fin AS \"end\", deb AS start, cdeb AS cmp_start, cfin AS cmp_end FROM bounds")
q("k1_headline", lambda t: kpi.headline(cur(t)), """
  SELECT round(sum(ttc), 2) AS revenue_ttc, round(sum(ht), 2) AS revenue_ht, count(*) FILTER (NOT is_credit) AS invoices,
    count(*) FILTER (is_credit) AS credits, round(sum(-ttc) FILTER (is_credit) * 100.0 / sum(ttc), 6) AS credit_rate_pct,
    count(DISTINCT customer) AS customers, round(sum(ttc) / count(*) FILTER (NOT is_credit), 4) AS mean_basket,
    round(avg(delay_days) FILTER (NOT is_credit), 6) AS mean_delay_days FROM cur""")
q("k2_monthly_revenue", lambda t: kpi.monthly_revenue(t.sales), """
  WITH m AS (SELECT strftime(date, '%Y-%m') AS month, sum(ttc) AS r FROM sales GROUP BY 1),
       l AS (SELECT *, lag(r) OVER (ORDER BY month) AS p FROM m)
  SELECT month, round(r, 2) AS revenue, round((r - p) * 100 / p, 6) AS growth_pct,
    CASE WHEN p IS NULL THEN 'stable' WHEN r >= p THEN 'up' ELSE 'down' END AS trend FROM l""")
q("k3_yearly_revenue", lambda t: kpi.yearly_revenue(t.sales),
  "SELECT year, round(sum(ttc), 2) AS revenue FROM sales GROUP BY year")
q("k4_trailing_growth", lambda t: kpi.trailing_growth(t.sales), """
  WITH m AS (SELECT max(date) AS mx FROM sales), a AS (
    SELECT sum(ttc) FILTER (date > mx - INTERVAL 12 MONTH) AS t,
           sum(ttc) FILTER (date <= mx - INTERVAL 12 MONTH AND date > mx - INTERVAL 24 MONTH) AS p FROM sales, m)
  SELECT round(t, 2) AS trailing_12m, round(p, 2) AS prior_12m, round((t - p) * 100 / p, 6) AS growth_pct FROM a""")
q("k5_period_comparison", lambda t: kpi.period_comparison(t.sales), """
  WITH a AS (SELECT sum(ttc) FILTER (date BETWEEN deb AND fin) AS c, sum(ttc) FILTER (date BETWEEN cdeb AND cfin) AS p,
    count(DISTINCT customer) FILTER (date BETWEEN deb AND fin) AS customers,
    count(DISTINCT customer) FILTER (date BETWEEN cdeb AND cfin) AS customers_before FROM sales, bounds)
  SELECT round(c, 2) AS revenue, round(p, 2) AS revenue_before, customers, customers_before,
    round((c - p) * 100 / p, 6) AS change_pct FROM a""")
q("k6_year_over_year", lambda t: kpi.year_over_year(t.sales), """
  WITH y AS (SELECT max(year) AS cy, max(year) FILTER (year < (SELECT max(year) FROM sales)) AS py FROM sales)
  SELECT month(date) AS month_no, round(sum(ttc) FILTER (year = cy), 2) AS current,
    round(sum(ttc) FILTER (year = py), 2) AS previous FROM sales, y GROUP BY 1""")
q("k7_seasonality", lambda t: kpi.seasonality(t.sales), """
  SELECT month(date) AS month_no, round(sum(ttc) / count(DISTINCT year), 3) AS mean_revenue FROM sales GROUP BY 1""")
q("k8_delay_counters", lambda t: kpi.delay_counters(cur(t)), """
  WITH a AS (SELECT count(*) FILTER (delay_days > 30) AS over_30, count(*) FILTER (delay_days > 60) AS over_60,
    count(*) FILTER (delay_days > 90) AS over_90, count(delay_days) AS n, sum(ttc) FILTER (delay_days > 60) AS a60,
    sum(ttc) FILTER (delay_days > 90) AS a90 FROM cur WHERE NOT is_credit)
  SELECT over_30, over_60, over_90, round(over_60 * 100.0 / n, 6) AS share_over_60_pct,
    round(a60, 2) AS amount_over_60, round(a90, 2) AS amount_over_90 FROM a""")
q("k9_recent_exposure", lambda t: kpi.recent_exposure(cur(t)), """
  SELECT round(sum(ttc) FILTER (delay_days > 60), 2) AS exposure, round(sum(ttc) FILTER (delay_days > 90), 2) AS critical,
    count(*) FILTER (delay_days > 60) AS documents, strftime(max(due), '%Y-%m') AS reference_month FROM recent""")
q("k10_customers_to_chase", lambda t: kpi.customers_to_chase(cur(t), t.customers), """
  SELECT customer, customer_name, round(m, 2) AS amount, documents FROM (
    SELECT customer, sum(ttc) FILTER (delay_days > 60) AS m, count(*) FILTER (delay_days > 60) AS documents
    FROM recent GROUP BY customer HAVING m > 0 ORDER BY m DESC, customer LIMIT 10) LEFT JOIN customers USING (customer)""")
q("k11_delay_ageing", lambda t: kpi.delay_ageing(cur(t)), """
  SELECT CASE WHEN delay_days <= 0 THEN 'cash' WHEN delay_days <= 30 THEN '1-30' WHEN delay_days <= 60 THEN '31-60'
    WHEN delay_days <= 90 THEN '61-90' ELSE 'over 90' END AS band, round(sum(ttc), 2) AS amount, count(*) AS documents
  FROM cur WHERE NOT is_credit AND delay_days IS NOT NULL GROUP BY 1""")
q("k12_top_customers", lambda t: kpi.top_customers(cur(t), t.customers), """
  WITH g AS (SELECT customer, sum(ttc) AS r, count(*) FILTER (NOT is_credit) AS invoices, count(*) FILTER (is_credit) AS credits,
    sum(ttc) FILTER (NOT is_credit AND delay_days > 30) AS risk FROM cur GROUP BY customer),
  k AS (SELECT *, row_number() OVER (ORDER BY r DESC, customer) AS rank FROM g)
  SELECT rank, customer, customer_name, round(r, 2) AS revenue, invoices, credits,
    round(r * 100 / (SELECT sum(ttc) FROM cur), 6) AS share_pct, round(risk, 2) AS risk_amount
  FROM k LEFT JOIN customers USING (customer) WHERE rank <= 10""")
q("k13_loyal_customers", lambda t: kpi.loyal_customers(cur(t), t.customers), """
  WITH g AS (SELECT customer, max(customer_name) AS customer_name, sum(ttc) AS r, count(*) FILTER (NOT is_credit) AS invoices,
    count(DISTINCT strftime(date, '%Y-%m')) FILTER (NOT is_credit) AS active_months,
    strftime(min(date) FILTER (NOT is_credit), '%Y-%m') AS first_month,
    strftime(max(date) FILTER (NOT is_credit), '%Y-%m') AS last_month
    FROM cur JOIN customers USING (customer)
    WHERE customer_name NOT ILIKE '%passager%' AND customer_name NOT ILIKE '%comptant%' AND customer_name NOT ILIKE '%divers%'
      AND customer_name NOT ILIKE '%espèce%' GROUP BY customer HAVING count(*) >= 2)
  SELECT customer, customer_name, round(r, 2) AS revenue, invoices, active_months, first_month, last_month FROM g
  ORDER BY active_months DESC, invoices DESC, r DESC, customer LIMIT 8""")
q("k14_disengaging_customers", lambda t: kpi.disengaging_customers(t.sales, t.customers), """
  WITH ref AS (SELECT max(date) AS md FROM sales), g AS (
    SELECT customer, max(customer_name) AS customer_name, max(date) AS last, count(DISTINCT strftime(date, '%Y-%m')) AS active_months,
      coalesce(sum(ttc) FILTER (date >= md - 90), 0) AS recent,
      coalesce(sum(ttc) FILTER (date >= md - 180 AND date < md - 90), 0) AS before
    FROM sales JOIN customers USING (customer), ref GROUP BY customer)
  SELECT customer, customer_name, strftime(last, '%Y-%m') AS last_month, active_months, round(recent, 2) AS recent,
    round(before, 2) AS before, datediff('day', last, (SELECT md FROM ref)) AS idle_days,
    round((1 - recent / before) * 100, 6) AS drop_pct FROM g
  WHERE active_months >= 6 AND before > 0 AND recent < before * 0.4 ORDER BY g.before - g.recent DESC, customer LIMIT 8""")
q("k15_customers_for_80pct", lambda t: kpi.entities_for_share(cur(t)), """
  WITH s AS (SELECT customer, sum(ttc) AS r FROM cur GROUP BY 1), k AS (SELECT sum(r) OVER () AS tot,
    sum(r) OVER (ORDER BY r DESC) AS cum, row_number() OVER (ORDER BY r DESC) AS rn, count(*) OVER () AS n FROM s WHERE r > 0)
  SELECT min(rn) FILTER (cum >= 0.8::DOUBLE * tot) AS customers_for_80pct, max(n) AS customers FROM k""")
q("k16_concentration", lambda t: kpi.concentration(cur(t), "customer").select(F.lit("customers").alias("side"), "hhi", "entities")
  .unionByName(kpi.concentration(curbuy(t), "supplier").select(F.lit("suppliers").alias("side"), "hhi", "entities")), """
  WITH c AS (SELECT customer, sum(ttc) AS r FROM cur GROUP BY 1 HAVING r > 0),
       p AS (SELECT supplier, sum(ttc) AS r FROM curbuy GROUP BY 1 HAVING r > 0)
  SELECT 'customers' AS side, round(sum(power(r / (SELECT sum(r) FROM c) * 100, 2)), 6) AS hhi, count(*) AS entities FROM c
  UNION ALL SELECT 'suppliers', round(sum(power(r / (SELECT sum(r) FROM p) * 100, 2)), 6), count(*) FROM p""")
q("k17_pareto_curve", lambda t: kpi.pareto_curve(cur(t)), """
  WITH s AS (SELECT customer, sum(ttc) AS r FROM cur GROUP BY 1 HAVING sum(ttc) > 0), k AS (
    SELECT row_number() OVER (ORDER BY r DESC) AS rn, count(*) OVER () AS n, sum(r) OVER () AS tot,
      sum(r) OVER (ORDER BY r DESC) AS cum FROM s), p AS (
    SELECT CAST(round(rn * 100.0 / n) AS INTEGER) AS pct_customers, round(max(cum / tot * 100), 6) AS pct_revenue FROM k GROUP BY 1)
  SELECT * FROM p WHERE pct_customers % 5 = 0""")
q("k18_mode_mix", lambda t: kpi.mode_mix(cur(t)),
  "SELECT mode, round(sum(ttc), 2) AS amount, count(*) AS documents FROM cur GROUP BY mode ORDER BY sum(ttc) DESC, mode LIMIT 8")
q("k19_due_schedule", lambda t: kpi.due_schedule(t.sales), """
  SELECT strftime(due, '%Y-%m') AS month, round(sum(ttc), 2) AS amount FROM sales GROUP BY 1 ORDER BY 1 DESC LIMIT 18""")
q("k20_amount_distribution", lambda t: kpi.amount_distribution(cur(t)), """
  SELECT CASE WHEN ttc < 500 THEN '< 500' WHEN ttc < 1000 THEN '0.5-1K' WHEN ttc < 5000 THEN '1-5K' WHEN ttc < 10000 THEN '5-10K'
    WHEN ttc < 50000 THEN '10-50K' ELSE '50K +' END AS band, count(*) AS documents FROM cur GROUP BY 1""")
q("k21_purchases_headline", lambda t: kpi.purchases_headline(curbuy(t)), """
  SELECT round(sum(ttc), 2) AS purchases_ttc, count(*) FILTER (NOT is_credit) AS invoices, count(*) FILTER (is_credit) AS credits,
    count(DISTINCT supplier) AS suppliers, round(avg(delay_days) FILTER (NOT is_credit), 6) AS mean_delay_days FROM curbuy""")


def _days(t):
    p = kpi.reference_period(t.sales)
    return p.select(F.datediff("end", "start") + 1).scalar()


q("k22_granted_vs_obtained", lambda t: kpi.granted_vs_obtained(cur(t), curbuy(t), _days(t)), """
  WITH g AS (SELECT avg(delay_days) AS a, sum(ttc * delay_days) / sum(ttc) AS w, count(*) AS n, sum(ttc) AS t FROM cur WHERE NOT is_credit),
       o AS (SELECT avg(delay_days) AS a, sum(ttc * delay_days) / sum(ttc) AS w, count(*) AS n, sum(ttc) AS t FROM curbuy WHERE NOT is_credit)
  SELECT round(g.a, 6) AS granted_simple, round(g.w, 6) AS granted_weighted, round(o.a, 6) AS obtained_simple,
    round(o.w, 6) AS obtained_weighted, g.n AS granted_documents, o.n AS obtained_documents, round(g.t, 2) AS granted_amount,
    round(o.t, 1) AS obtained_amount, round(g.w - o.w, 6) AS gap_days,
    CASE WHEN g.w > o.w THEN 'positive' WHEN g.w < o.w THEN 'negative' ELSE 'zero' END AS gap_sign,
    round(g.t / (fin - deb + 1) * (g.w - o.w), 2) AS cycle_cash FROM g, o, bounds""")
q("k22_delay_band_shares", lambda t: kpi.delay_band_shares(cur(t)), """
  WITH b AS (SELECT CASE WHEN delay_days <= 0 THEN 'cash' WHEN delay_days <= 30 THEN '1-30' WHEN delay_days <= 60 THEN '31-60'
    WHEN delay_days <= 90 THEN '61-90' ELSE 'over 90' END AS band, sum(ttc) AS a, count(*) AS documents
    FROM cur WHERE NOT is_credit GROUP BY 1)
  SELECT band, documents, round(a, 2) AS amount, round(a * 100 / sum(a) OVER (), 6) AS share_pct,
    band IN ('61-90', 'over 90') AS beyond_60 FROM b""")
q("k23_top_suppliers", lambda t: kpi.top_suppliers(curbuy(t), t.suppliers), """
  WITH g AS (SELECT supplier, sum(ttc) AS m FROM curbuy GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY m DESC, supplier) AS rank FROM g)
  SELECT rank, supplier, supplier_name, round(m, 2) AS amount, round(m * 100 / (SELECT sum(ttc) FROM curbuy), 6) AS share_pct
  FROM k LEFT JOIN suppliers USING (supplier) WHERE rank <= 8""")
q("k24_sales_vs_purchases", lambda t: kpi.sales_vs_purchases(t.sales, t.purchases), """
  WITH s AS (SELECT strftime(date, '%Y-%m') AS month, round(sum(ttc), 2) AS sales FROM sales GROUP BY 1),
       p AS (SELECT strftime(date, '%Y-%m') AS month, round(sum(ttc), 2) AS p FROM purchases GROUP BY 1)
  SELECT month, sales, coalesce(p, 0.0) AS purchases FROM s LEFT JOIN p USING (month)""")
q("k28_quote_headline", lambda t: kpi.quote_headline(t.quotes), """
  SELECT count(*) AS quotes, round(sum(ttc), 2) AS amount, count(DISTINCT customer) AS customers,
    count(*) FILTER (converted) AS converted, round(count(*) FILTER (converted) * 100.0 / count(*), 6) AS conversion_pct FROM quotes""")
q("k29_funnel", lambda t: kpi.funnel(t.quotes, t.sales), """
  SELECT 1 AS step_no, 'quotes' AS step, count(*) AS value FROM quotes
  UNION ALL SELECT 2, 'converted quotes', count(*) FILTER (converted) FROM quotes
  UNION ALL SELECT 3, 'invoiced customers', count(DISTINCT customer) FROM sales""")
q("k30_top_products", lambda t: kpi.top_products(kpi.within(t.sales_lines, kpi.reference_period(t.sales))), """
  WITH g AS (SELECT label, sum(amount) AS r, sum(qty) AS q FROM curline WHERE label <> '' GROUP BY 1)
  SELECT row_number() OVER (ORDER BY r DESC, label) AS rank, label, round(r, 2) AS revenue, round(q, 2) AS qty
  FROM g ORDER BY r DESC, label LIMIT 10""")
q("k30_top_families", lambda t: kpi.top_families(kpi.within(t.sales_lines, kpi.reference_period(t.sales))), """
  WITH g AS (SELECT family, sum(amount) AS r FROM curline WHERE family <> '' AND NOT regexp_matches(upper(family),
    '(^_)|PEINTURE|LITHOGRAPH|CHEVALET|PINCEAU|BROSSE|AQUARELLE|HUILE') GROUP BY 1)
  SELECT row_number() OVER (ORDER BY r DESC, family) AS rank, family, round(r, 2) AS revenue FROM g ORDER BY r DESC, family LIMIT 6""")
q("k30_top_products_from_mart",
  lambda t: kpi.top_products(kpi.product_source(star.mart_sales_product(t.sales_lines), t.sales_lines, R.Filters(years=(1998, 1999)))), """
  WITH g AS (SELECT label, sum(amount) AS r, sum(qty) AS q FROM lines WHERE year(date) IN (1998, 1999) GROUP BY 1)
  SELECT row_number() OVER (ORDER BY r DESC, label) AS rank, label, round(r, 2) AS revenue, round(q, 2) AS qty
  FROM g ORDER BY r DESC, label LIMIT 10""")
q("k31_customers_at_risk", lambda t: kpi.customers_to_chase(cur(t), t.customers, 8, recent=False), """
  SELECT customer, customer_name, round(m, 2) AS amount, documents FROM (
    SELECT customer, sum(ttc) FILTER (delay_days > 60) AS m, count(*) FILTER (delay_days > 60) AS documents
    FROM cur GROUP BY customer HAVING m > 0 ORDER BY m DESC, customer LIMIT 8) LEFT JOIN customers USING (customer)""")
q("k33_anomaly_counters", lambda t: kpi.anomaly_counters(cur(t)), """
  WITH h AS (SELECT sum(ttc) AS r FROM cur GROUP BY customer HAVING r > 0)
  SELECT 'long_delay' AS anomaly, count(*) FILTER (NOT is_credit AND delay_days > 90) AS n FROM cur
  UNION ALL SELECT 'watch_delay', count(*) FILTER (NOT is_credit AND delay_days > 30 AND delay_days <= 90) FROM cur
  UNION ALL SELECT 'negative', count(*) FILTER (ttc < 0) FROM cur UNION ALL SELECT 'zero', count(*) FILTER (ttc = 0) FROM cur
  UNION ALL SELECT 'concentrated', CAST(sum(r * r) * 10000 / (sum(r) * sum(r)) > 2500 AS BIGINT) FROM h""")
q("k34_cash_cycle", lambda t: kpi.cash_cycle(cur(t), curbuy(t)), """
  SELECT round((SELECT avg(delay_days) FROM cur WHERE NOT is_credit) - avg(delay_days), 6) AS cash_conversion_cycle
  FROM curbuy WHERE NOT is_credit""")
q("k35_filter_options", lambda t: kpi.filter_options(t.sales, t.customers), """
  SELECT DISTINCT 'year' AS option, CAST(year AS VARCHAR) AS value FROM sales
  UNION ALL SELECT DISTINCT 'mode', mode FROM sales
  UNION ALL SELECT 'customer', customer_name FROM (SELECT customer FROM sales GROUP BY 1 ORDER BY sum(ttc) DESC, customer LIMIT 400)
    LEFT JOIN customers USING (customer)
  UNION ALL SELECT 'max_amount', printf('%.2f', max(ttc)) FROM sales""")
q("k36_annual_revenue", lambda t: kpi.annual_revenue(t.sales), """
  SELECT round(coalesce(sum(ttc), 0), 2) AS annual_revenue FROM sales WHERE NOT is_credit
    AND date >= (SELECT max(date) FROM sales) - INTERVAL 12 MONTH""")
q("k37_booked_public_share", lambda t: kpi.booked_public_share(t.sales, t.customers, due_years=(1995, 2035)), """
  WITH b AS (SELECT ttc, customer_name FROM sales LEFT JOIN customers USING (customer) WHERE NOT is_credit AND due >= date
    AND year(due) * 12 + month(due) - 1 = (SELECT max(year(date) * 12 + month(date) - 1) FROM sales) + 1)
  SELECT round(sum(ttc), 2) AS booked, round(coalesce(sum(ttc) FILTER (customer_name LIKE '%HOPITAL%'), 0) * 100 / sum(ttc), 6)
    AS public_share_pct FROM b""")
q("k38_public_recovery", lambda t: kpi.public_recovery(cur(t), t.customers), """
  WITH p AS (SELECT customer, customer_name, sum(ttc) FILTER (delay_days > 60) AS e60, sum(ttc) FILTER (delay_days > 90) AS e90,
      count(*) FILTER (delay_days > 60) AS n60, customer_name LIKE '%HOPITAL%' AS pub
    FROM recent LEFT JOIN customers USING (customer) GROUP BY 1, 2),
  d AS (SELECT 'debtor' AS line, customer_name AS label, round(e60, 2) AS amount FROM p WHERE pub AND e60 > 0 ORDER BY e60 DESC, customer LIMIT 3)
  SELECT 'exposure' AS line, '' AS label, round(sum(e60), 2) AS amount FROM p
  UNION ALL SELECT 'public', '', round(sum(e60) FILTER (pub), 2) FROM p UNION ALL SELECT 'critical', '', round(sum(e90) FILTER (pub), 2) FROM p
  UNION ALL SELECT 'customers', '', CAST(count(*) FILTER (pub AND n60 > 0) AS DOUBLE) FROM p UNION ALL SELECT * FROM d""")
q("k39_customer_totals", lambda t: kpi.customer_totals(t.sales, t.customers), """
  SELECT customer, customer_name, revenue, documents, last_date FROM (SELECT customer, round(sum(ttc), 2) AS revenue, count(*) AS documents,
    max(date) AS last_date FROM sales GROUP BY 1 ORDER BY sum(ttc) DESC, customer LIMIT 100) LEFT JOIN customers USING (customer)""")
q("k39_customer_invoices", lambda t: kpi.customer_invoices(t.sales, kpi.largest_customer(t.sales).scalar()), """
  SELECT piece_no, date, due, round(ttc, 2) AS ttc, is_credit, delay_days FROM sales WHERE customer = (SELECT customer FROM sales GROUP BY 1 ORDER BY sum(ttc) DESC, customer LIMIT 1) ORDER BY date DESC, ent_id LIMIT 50""")

# ------------------------------------------------------------ filters
CHOSEN = R.Filters(years=(1997, 1998), start=dt.date(1997, 3, 1), end=dt.date(1998, 11, 30), modes=("1-URGENT", "5-LOW"),
                   min_amount=1000.0, max_amount=300000.0, delay_level="over_30", loyalty="regular")
q("b19_dashboard_filter", lambda t: kpi.headline(kpi.scope(t.sales, R.Filters(
    years=CHOSEN.years, start=CHOSEN.start, end=CHOSEN.end, modes=CHOSEN.modes, min_amount=1000.0, max_amount=300000.0,
    delay_level="over_30"))).select("revenue_ttc", "invoices", "customers"), """
  SELECT round(sum(ttc), 2) AS revenue_ttc, count(*) FILTER (NOT is_credit) AS invoices, count(DISTINCT customer) AS customers
  FROM sales WHERE year IN (1997, 1998) AND date BETWEEN DATE '1997-03-01' AND DATE '1998-11-30' AND mode IN ('1-URGENT', '5-LOW')
    AND ttc BETWEEN 1000 AND 300000 AND delay_days > 30""")
q("b20_month_filter", lambda t: star.mart_margin_customer_month(t.sales_lines).filter(CHOSEN.month_predicate())
  .groupBy("month").agg(F.round(F.sum("margin"), 2).alias("margin")), """
  SELECT strftime(date, '%Y-%m') AS month, round(sum(amount) - sum(cost), 2) AS margin FROM lines
  WHERE amount <> 0 AND abs(cost) <= 5 * abs(amount) AND year(date) IN (1997, 1998)
    AND strftime(date, '%Y-%m') BETWEEN '1997-03' AND '1998-11' GROUP BY 1""")
q("b21_loyalty_segment", lambda t: kpi.scope(t.sales, CHOSEN).groupBy("customer").agg(
    F.count(F.lit(1)).alias("documents"), F.round(F.sum("ttc"), 2).alias("revenue")), """
  WITH f AS (SELECT * FROM sales WHERE year IN (1997, 1998) AND date BETWEEN DATE '1997-03-01' AND DATE '1998-11-30'
    AND mode IN ('1-URGENT', '5-LOW') AND ttc BETWEEN 1000 AND 300000 AND delay_days > 30)
  SELECT customer, count(*) AS documents, round(sum(ttc), 2) AS revenue FROM f GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5""")
q("b28_severity", lambda t: cur(t).groupBy("customer").agg(R.sum_where(F.col("ttc"), F.col("delay_days") > 60).alias("s"))
  .select("customer", R.severity(F.coalesce("s", F.lit(0.0)) * 20, kpi.annual_revenue(t.sales).scalar()).alias("severity")), """
  WITH y AS (SELECT sum(ttc) AS r FROM sales WHERE NOT is_credit AND date >= (SELECT max(date) FROM sales) - INTERVAL 12 MONTH),
  s AS (SELECT customer, coalesce(sum(ttc) FILTER (delay_days > 60), 0) * 20 AS s FROM cur GROUP BY 1)
  SELECT customer, CASE WHEN s <= 0 THEN 'low' WHEN s / (SELECT round(r, 2) FROM y) >= 0.05 THEN 'high' ELSE 'medium' END AS severity FROM s""")
