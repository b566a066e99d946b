"""Margin queries (m1..m6, k25..k27)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewright.operators import kpi, margin, star
from tradewright.plans.registry import register

W = "WHERE amount <> 0 AND abs(cost) <= 5 * abs(amount)"
V = {
    "bounds": """SELECT max(date) AS fin, CAST(max(date) - INTERVAL 12 MONTH AS DATE) + 1 AS deb FROM sales""",
    "costed": f"""SELECT *, strftime(date, '%Y-%m') AS month, year(date) AS year, CASE WHEN family LIKE 'REACTIF%' THEN 'reagent' WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment'
        WHEN family LIKE 'SERVICE%' THEN 'service' ELSE 'other' END AS category FROM lines {W}""",
    "curmonth": "SELECT c.* FROM costed c, bounds WHERE month BETWEEN strftime(deb, '%Y-%m') AND strftime(fin, '%Y-%m')",
}


def q(name, build, sql):
    register(name, build, sql, V)


def _month_scope(t, mart):
    p = kpi.reference_period(t.sales)
    lo, hi = p.select(F.date_format("start", "yyyy-MM")).scalar(), p.select(F.date_format("end", "yyyy-MM")).scalar()
    return mart.filter(F.col("month").between(lo, hi))


def cat(t):
    return star.mart_margin_category_month(t.sales_lines)


q("k25_margin_totals", lambda t: margin.totals(_month_scope(t, star.mart_margin_customer_month(t.sales_lines)), star.mart_margin_quality(t.sales_lines)), """
  WITH a AS (SELECT sum(amount) AS r, sum(cost) AS k FROM curmonth), e AS (SELECT count(*) FILTER (amount <> 0 AND abs(cost) > 5 * abs(amount)) AS x,
    count(*) FILTER (amount > 0) AS b FROM lines)
  SELECT 'erp_cost' AS source, round(r, 1) AS revenue, round(k, 1) AS cost, round(r - k, 1) AS margin, round((r - k) * 100 / r, 6) AS rate_pct,
    round(greatest(0, least(100, (r - k) * 100 / r)), 6) AS quality_score, x AS excluded_lines, round(x * 100.0 / b, 6) AS excluded_pct FROM a, e""")
q("k26_monthly_margin", lambda t: margin.monthly_aligned(t.sales, star.mart_margin_customer_month(t.sales_lines)), """
  SELECT month, round(coalesce(m, 0), 4) AS margin FROM (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM sales)
  LEFT JOIN (SELECT month, sum(amount) - sum(cost) AS m FROM costed GROUP BY 1) USING (month)""")
q("k27_m6_waterfall", lambda t: margin.waterfall(cat(t)), """
  SELECT 1 AS step_no, 'revenue' AS step, round(sum(amount), 1) AS value, 'start' AS kind FROM costed UNION ALL SELECT 2, 'cost', -round(sum(cost), 1), 'negative' FROM costed
  UNION ALL SELECT 3, 'margin', round(sum(amount) - sum(cost), 1), 'total' FROM costed""")
q("m1_margin_by_category", lambda t: margin.by_category(_month_scope(t, cat(t))), """
  WITH g AS (SELECT category, sum(amount) AS r, sum(cost) AS k, sum(amount) - sum(cost) AS m, count(*) FILTER (amount >= 0) AS n_lines FROM curmonth GROUP BY 1)
  SELECT category, round(r, 1) AS revenue, round(k, 1) AS cost, round(m, 1) AS margin, round(m * 100 / r, 6) AS rate_pct, round(r * 100 / sum(r) OVER (), 6) AS revenue_pct,
    round(m * 100 / sum(m) OVER (), 6) AS margin_pct, n_lines FROM g""")
q("m2_g4_carriers_and_losers", lambda t: margin.carriers_and_losers(star.mart_margin_product(t.sales_lines)), """
  WITH g AS (SELECT reference, sum(amount) AS r, sum(cost) AS c, sum(amount) - sum(cost) AS m, count(DISTINCT customer) AS n_customers FROM costed GROUP BY 1),
  x AS (SELECT 'carrier' AS side, *, row_number() OVER (ORDER BY m DESC, reference) AS k FROM g WHERE m > 0 UNION ALL
        SELECT 'loser', *, row_number() OVER (ORDER BY m, reference) FROM g WHERE m < 0)
  SELECT side, reference, round(r, 4) AS revenue, round(c, 4) AS cost, round(m, 4) AS margin, round(m * 100 / r, 6) AS rate_pct, n_customers,
    CASE WHEN side = 'carrier' THEN round(m * 100 / (SELECT sum(m) FROM g), 6) END AS margin_share_pct FROM x WHERE k <= 15""")
q("m3_margin_trend", lambda t: margin.trend(cat(t)), """
  SELECT month, round(sum(amount), 2) AS revenue, round(sum(amount) - sum(cost), 2) AS margin, round((sum(amount) - sum(cost)) * 100 / sum(amount), 6) AS rate_pct FROM costed GROUP BY 1""")
q("m4_year_completion", lambda t: margin.year_completion(cat(t), t.sales.agg(F.max("date")).scalar()), """
  WITH d AS (SELECT year(max(date)) AS y, month(max(date)) AS n FROM sales), a AS (SELECT sum(amount - cost) FILTER (year = y) AS now, sum(amount) FILTER (year = y) AS rev,
    sum(amount - cost) FILTER (year = y - 1 AND month(date) <= n) AS part, sum(amount - cost) FILTER (year = y - 1) AS ful FROM costed, d)
  SELECT y AS year, n AS months_covered, n < 12 AS incomplete, round(now, 1) AS margin_to_date, round(rev, 1) AS revenue_to_date, round(part, 1) AS same_window_before,
    round(ful, 1) AS full_year_before, round(part / ful * 100, 6) AS share_reached_pct, round((now - part) * 100 / part, 6) AS change_pct,
    round(CASE WHEN part / ful > 0.05 THEN now / (part / ful) END, 1) AS projected_year_end FROM a, d""")
q("m5_margin_limits", lambda t: margin.limits(star.mart_margin_quality(t.sales_lines.withColumn("cost", F.col("cost") * F.when(F.col("reference") % 7 == 0, 40).otherwise(1)))), """
  WITH l AS (SELECT amount AS a, cost * CASE WHEN reference % 7 = 0 THEN 40 ELSE 1 END AS k FROM lines)
  SELECT count(*) FILTER (a <> 0 AND abs(k) > 5 * abs(a)) AS excluded_lines, round(count(*) FILTER (a <> 0 AND abs(k) > 5 * abs(a)) * 100.0 / count(*) FILTER (a > 0), 6) AS excluded_pct,
    round(coalesce(sum(a) FILTER (a <> 0 AND abs(k) > 5 * abs(a)), 0), 1) AS excluded_amount, count(*) FILTER (a = 0 AND k > 0) AS free_lines,
    round(coalesce(sum(k) FILTER (a = 0 AND k > 0), 0), 1) AS free_cost, count(*) FILTER (a < 0) AS return_lines, round(coalesce(sum(a) FILTER (a < 0), 0), 1) AS return_amount FROM l""")
