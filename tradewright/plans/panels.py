"""Feature-panel queries (t1..t12, f*, c8, c12, c13, d11..d14) with SQL checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import panels as P
from tradewright.operators import star, stock
from tradewright.plans.registry import register
from tradewright.plans.supply import V as SUPPLY
from tradewright.plans.supply import buys, outs

c = F.col
START = "1995-01-01"
MONTHS = "SELECT CAST(unnest(generate_series((SELECT date_trunc('month', min(date)) FROM lines), (SELECT date_trunc('month', max(date)) FROM lines), INTERVAL 1 MONTH)) AS DATE) AS month"
V = {
    **SUPPLY,
    "days": """SELECT customer, date, count(*) AS n, sum(ttc) AS ttc FROM sales WHERE NOT is_credit GROUP BY 1, 2""",
    "dgap": """SELECT *, avg(gap) OVER w AS gm, stddev_pop(gap) OVER w AS gs, avg(ttc) OVER w AS bk FROM (SELECT *, datediff('day', lag(date) OVER (PARTITION BY customer ORDER BY date), date) AS gap FROM days)
        WINDOW w AS (PARTITION BY customer ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "churn": """SELECT o.customer, t AS obs_date, datediff('day', ld, t)::DOUBLE AS recency_days, datediff('day', fd, t)::DOUBLE AS age_days, f3::DOUBLE AS freq_3m, f6::DOUBLE AS freq_6m, f12::DOUBLE AS freq_12m,
        r3 AS rev_3m, r6 AS rev_6m, r12 AS rev_12m, ln(1 + greatest(r12, 0)) AS log_rev_12m, CASE WHEN rp > 0 THEN least(r3 / rp, 10) WHEN r3 > 0 THEN 2 ELSE 0 END AS revenue_trend,
        CASE WHEN np > 0 THEN least(f3 / np, 10) WHEN f3 > 0 THEN 2 ELSE 0 END AS frequency_trend, coalesce(gm, 365) AS gap_mean, coalesce(gs, 0) AS gap_std,
        CASE WHEN coalesce(gm, 365) > 0 THEN datediff('day', ld, t) / coalesce(gm, 365) ELSE 0 END AS recency_gap_ratio, bk AS mean_basket, month(t)::DOUBLE AS month_no, CAST(nx = 0 AS INTEGER) AS y
        FROM (SELECT d.customer, t, max(date) FILTER (date <= t) AS ld, min(date) FILTER (date <= t) AS fd, count(*) FILTER (date <= t AND date > t - 90) AS f3, count(*) FILTER (date <= t AND date > t - 180) AS f6,
            count(*) FILTER (date <= t AND date > t - 360) AS f12, coalesce(sum(ttc) FILTER (date <= t AND date > t - 90), 0) AS r3, coalesce(sum(ttc) FILTER (date <= t AND date > t - 180), 0) AS r6,
            coalesce(sum(ttc) FILTER (date <= t AND date > t - 360), 0) AS r12, coalesce(sum(ttc) FILTER (date <= t - 90 AND date > t - 180), 0) AS rp, count(*) FILTER (date <= t - 90 AND date > t - 180) AS np,
            count(*) FILTER (date <= t AND date > t - 365) AS na, count(*) FILTER (date > t AND date <= t + 90) AS nx
          FROM days d, (SELECT last_day(CAST(unnest(generate_series(DATE '1996-01-01', (SELECT max(date) - 90 FROM days), INTERVAL 1 MONTH)) AS DATE)) AS t) WHERE t <= (SELECT max(date) - 90 FROM days) GROUP BY 1, 2) o
        JOIN dgap g ON g.customer = o.customer AND g.date = ld WHERE ld IS NOT NULL AND na >= 2""",
    "cm": """SELECT customer, CAST(date_trunc('month', date) AS DATE) AS month, sum(amount) AS amount, sum(cost) AS cost, count(*) AS n_lines, count(DISTINCT cat) AS n_families,
        sum(CASE WHEN cat = 'equipment' THEN abs(amount) ELSE 0 END) AS m_equipment, sum(CASE WHEN cat = 'reagent' THEN abs(amount) ELSE 0 END) AS m_reagent,
        sum(CASE WHEN cat = 'service' THEN abs(amount) ELSE 0 END) AS m_service, sum(abs(amount)) AS m_abs FROM (SELECT *, CASE WHEN family LIKE 'REACTIF%' THEN 'reagent' WHEN family LIKE 'EQUIPEMENT%' THEN 'equipment'
          WHEN family LIKE 'SERVICE%' THEN 'service' ELSE 'other' END AS cat FROM lines) GROUP BY 1, 2""",
    "dense": f"""SELECT g.customer, g.month, coalesce(amount, 0) AS amount, coalesce(cost, 0) AS cost, coalesce(n_lines, 0) AS n_lines, coalesce(n_families, 0) AS n_families, coalesce(m_equipment, 0) AS m_equipment,
        coalesce(m_reagent, 0) AS m_reagent, coalesce(m_service, 0) AS m_service, coalesce(m_abs, 0) AS m_abs, md, row_number() OVER (PARTITION BY g.customer ORDER BY g.month) AS rank,
        abs(coalesce(amount, 0)) > 1e-6 AS active, greatest(coalesce(amount, 0), 0) AS pos
        FROM (SELECT customer, month FROM (SELECT DISTINCT customer FROM cm), ({MONTHS})) g LEFT JOIN cm USING (customer, month)
        LEFT JOIN (SELECT customer, CAST(date_trunc('month', date) AS DATE) AS month, median(delay_days) AS md FROM sales WHERE NOT is_credit GROUP BY 1, 2) d USING (customer, month)""",
}
ROLLS = ", ".join(f"w{n} AS (PARTITION BY {{k}} ORDER BY month ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (1, 3, 6, 12))
RUN = "wr AS (PARTITION BY {k} ORDER BY month ROWS UNBOUNDED PRECEDING)"


def q(name, build, sql=None):
    register(name, build, sql, V)


def rnd(df, feats, digits=6):
    return df.withColumns({f: F.round(c(f) + 1e-9, digits) for f in feats})


def rsql(feats, digits=6):
    return ", ".join(f"round({f} + 1e-9, {digits}) AS {f}" for f in feats)


def churn(t):
    return P.churn_panel(P.customer_days(t.sales), START)


q("t1_c13_f13_churn_panel", lambda t: rnd(churn(t), P.CHURN_FEATURES), f"SELECT customer, obs_date, {rsql(P.CHURN_FEATURES)}, y FROM churn")

V["mp"] = f"""SELECT *, margin_3m_pct - margin_12m_pct AS margin_trend, share_equipment_3m - eq12 AS equipment_shift, coalesce(CASE WHEN count(margin_3m_pct) OVER w12 >= 3 THEN stddev_samp(margin_3m_pct) OVER w12 END, 0) AS margin_volatility,
    CASE WHEN nf = 3 AND abs(fa) > 1e-6 THEN (fa - fc) / fa * 100 END AS future_margin_pct FROM (SELECT customer, month, rank, active,
    {", ".join(f"CASE WHEN abs(sum(amount) OVER w{n}) > 1e-6 THEN (sum(amount) OVER w{n} - sum(cost) OVER w{n}) / sum(amount) OVER w{n} * 100 ELSE 0 END AS margin_{n}m_pct" for n in (3, 6, 12))},
    {", ".join(f"CASE WHEN sum(m_abs) OVER w3 > 1e-6 THEN sum(m_{k}) OVER w3 / sum(m_abs) OVER w3 * 100 ELSE 0 END AS share_{k}_3m" for k in ("equipment", "reagent", "service"))},
    CASE WHEN sum(m_abs) OVER w12 > 1e-6 THEN sum(m_equipment) OVER w12 / sum(m_abs) OVER w12 * 100 ELSE 0 END AS eq12, max(n_families) OVER w3 AS n_families_3m, ln(1 + greatest(sum(amount) OVER w12, 0)) AS log_rev_12m,
    sum(n_lines) OVER w12 AS n_lines_12m, CASE WHEN sum(n_lines) OVER w12 > 0 THEN sum(amount) OVER w12 / sum(n_lines) OVER w12 ELSE 0 END AS mean_basket,
    coalesce(rank - max(CASE WHEN active THEN rank END) OVER wr, rank) * 30 AS recency_days, rank AS age_months, sum(amount) OVER w3 / (sum(amount) OVER w12 / 4 + 1e-6) AS revenue_trend,
    coalesce(last_value(md IGNORE NULLS) OVER wr, 0) AS median_delay_ff, month(month) AS month_no, sum(amount) OVER wf AS fa, sum(cost) OVER wf AS fc, count(*) OVER wf AS nf FROM dense
    WINDOW {ROLLS.format(k="customer")}, {RUN.format(k="customer")}, wf AS (PARTITION BY customer ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    WINDOW w12 AS (PARTITION BY customer ORDER BY month ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""
MF = [f for f in P.MARGIN_FEATURES if f != "margin_volatility"]


def margin_panel(t):
    return P.margin_panel(P.customer_months(t.sales_lines), P.monthly_delays(t.sales))


q("t2_c8_f7_f8_f9_margin_panel", lambda t: rnd(rnd(margin_panel(t), [*MF, "future_margin_pct"], 4), ["margin_volatility"], 2), f"""
  SELECT customer, month, {rsql([*MF, "future_margin_pct"], 4)}, {rsql(["margin_volatility"], 2)} FROM mp WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_margin_pct IS NOT NULL""")
q("t2_d15_low_margin_threshold", lambda t: margin_panel(t).filter(c("month") < "2000-01-01").agg(F.round(F.percentile("future_margin_pct", F.lit(0.2)), 6).alias("low_margin_pct")), """
  SELECT round(quantile_cont(future_margin_pct, 0.2), 6) AS low_margin_pct FROM mp WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_margin_pct IS NOT NULL AND month < DATE '2000-01-01'""")

V["rp"] = f"""SELECT *, rev_3m / (rev_12m / 4 + 1e-6) AS revenue_trend, CASE WHEN n_lines_12m > 0 THEN rev_12m / n_lines_12m ELSE 0 END AS mean_basket,
    least(greatest(coalesce(CASE WHEN lag(rev_12m, 12) OVER o > 1e-6 THEN rev_12m / lag(rev_12m, 12) OVER o END, 1), 0), 10) AS annual_growth, {", ".join(f"ln(1 + rev_{n}m) AS log_rev_{n}m" for n in (1, 3, 6, 12))},
    CASE WHEN nf = 3 THEN fr END AS future_revenue FROM (SELECT customer, month, rank, active, {", ".join(f"sum(pos) OVER w{n} AS rev_{n}m" for n in (1, 3, 6, 12))}, sum(n_lines) OVER w3 AS n_lines_3m, sum(n_lines) OVER w12 AS n_lines_12m,
    coalesce(CASE WHEN count(pos) OVER w12 >= 3 THEN stddev_samp(pos) OVER w12 END, 0) AS revenue_volatility, sum(CAST(active AS INTEGER)) OVER w12 AS active_months_12m,
    coalesce(rank - max(CASE WHEN active THEN rank END) OVER wr, rank) * 30 AS recency_days, rank AS age_months, max(n_families) OVER w3 AS n_families_3m,
    CASE WHEN sum(m_abs) OVER w3 > 1e-6 THEN sum(m_equipment) OVER w3 / sum(m_abs) OVER w3 * 100 ELSE 0 END AS share_equipment_3m, coalesce(last_value(md IGNORE NULLS) OVER wr, 0) AS median_delay_ff, month(month) AS month_no,
    sum(pos) OVER wf AS fr, count(*) OVER wf AS nf FROM dense WINDOW {ROLLS.format(k="customer")}, {RUN.format(k="customer")}, wf AS (PARTITION BY customer ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))
    WINDOW o AS (PARTITION BY customer ORDER BY month)"""
RF = [f for f in P.REVENUE_FEATURES if f != "revenue_volatility"]


def revenue_panel(t):
    return P.revenue_panel(P.customer_months(t.sales_lines), P.monthly_delays(t.sales))


q("t3_f12_revenue_panel", lambda t: rnd(rnd(revenue_panel(t).drop("rev_1m", "rev_3m", "rev_12m"), [*RF, "future_revenue"], 4), ["revenue_volatility"], 2), f"""
  SELECT customer, month, {rsql([*RF, "future_revenue"], 4)}, {rsql(["revenue_volatility"], 2)} FROM rp WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_revenue IS NOT NULL""")

# ------------------------------------------------------------ quotes and credit
V["qp"] = """SELECT q.customer, q.quote_no, q.date, CAST(q.converted AS INTEGER) AS y, ln(1 + greatest(q.ht, 0)) AS log_ht, month(q.date) AS month_no, quarter(q.date) AS quarter, isodow(q.date) - 1 AS weekday,
    coalesce(o.qm, 0) AS earlier_quotes_month, CASE WHEN i.n > 0 THEN 1 ELSE 0 END AS is_customer, coalesce(datediff('day', i.f, q.date), 0) AS age_days, coalesce(i.n12, 0) AS invoices_12m,
    ln(1 + greatest(coalesce(i.r12, 0), 0)) AS log_rev_12m, coalesce(datediff('day', i.l, q.date), 0) AS recency_days, coalesce(i.b, 0) AS mean_basket, CASE WHEN m.a > 0 THEN (m.a - m.k) / m.a * 100 ELSE 0 END AS margin_pct,
    coalesce(i.d, 0) AS median_delay, coalesce(o.q12, 0) AS quotes_12m, coalesce(o.cv, -1) AS past_conversion, ln(1 + greatest(coalesce(o.h, 0), 0)) AS log_usual_quote, q.ht / (coalesce(o.h, 0) + 1e-6) AS ratio_usual,
    q.ht / (coalesce(i.b, 0) + 1e-6) AS ratio_basket, q.ht / (coalesce(i.r12, 0) + 1e-6) AS ratio_rev_12m
    FROM quotes q LEFT JOIN (SELECT a.quote_no, count(*) AS n, min(s.date) AS f, max(s.date) AS l, avg(s.ttc) AS b, median(s.delay_days) AS d, count(*) FILTER (s.date >= a.date - 365) AS n12,
        sum(s.ttc) FILTER (s.date >= a.date - 365) AS r12 FROM quotes a JOIN sales s ON s.customer = a.customer AND s.date < a.date AND NOT s.is_credit GROUP BY 1) i USING (quote_no)
    LEFT JOIN (SELECT a.quote_no, count(*) FILTER (s.date >= a.date - 365) AS q12, avg(CAST(s.converted AS INTEGER)) AS cv, avg(s.ht) AS h, count(*) FILTER (date_trunc('month', s.date) = date_trunc('month', a.date)) AS qm
        FROM quotes a JOIN quotes s ON s.customer = a.customer AND s.date < a.date GROUP BY 1) o USING (quote_no)
    LEFT JOIN (SELECT a.quote_no, sum(s.amount) AS a, sum(s.cost) AS k FROM quotes a JOIN cm s ON s.customer = a.customer AND s.month < a.date GROUP BY 1) m USING (quote_no)
    WHERE q.ht > 0 AND q.date <= (SELECT max(date) FROM quotes) - INTERVAL 6 MONTH"""


def quote_panel(t):
    return P.quote_panel(t.quotes, t.sales, t.sales_lines)


RATIOS = ["ratio_usual", "ratio_basket", "ratio_rev_12m"]
QF = [f for f in P.QUOTE_FEATURES if f not in RATIOS]
q("t4_c12_s13_quote_panel", lambda t: rnd(rnd(quote_panel(t).drop("ht"), QF, 4), RATIOS, 3).withColumns({r: F.when(c(r) < 1e6, c(r)) for r in RATIOS}), f"""
  SELECT customer, quote_no, date, y, {rsql(QF, 4)}, {", ".join(f"CASE WHEN {r} < 1e6 THEN round({r} + 1e-9, 3) END AS {r}" for r in RATIOS)} FROM qp""")
q("t5_quote_maturation", lambda t: P.quote_maturation(t.quotes), """
  WITH m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, count(*) FILTER (converted) AS v FROM quotes GROUP BY 1 HAVING count(*) >= 5)
  SELECT month, n, round(v * 100.0 / n, 6) AS rate_pct, month > (SELECT max(month) FROM m) - INTERVAL 6 MONTH AS censored FROM m""")
q("t6_conversion_by_band", lambda t: P.conversion_by_band(t.quotes), """
  WITH b AS (SELECT *, CASE WHEN date > (SELECT max(date) FROM quotes) - INTERVAL 6 MONTH THEN 'too recent' WHEN ht < 5000 THEN 'under 5K' WHEN ht < 20000 THEN '5-20K' WHEN ht < 100000 THEN '20-100K' ELSE 'over 100K' END AS band FROM quotes)
  SELECT band, count(*) AS n, CASE WHEN band <> 'too recent' THEN count(*) FILTER (converted) END AS signed, CASE WHEN band <> 'too recent' THEN round(count(*) FILTER (converted) * 100.0 / count(*), 6) END AS rate_pct,
    round(sum(ht), 2) AS amount FROM b GROUP BY 1""")
q("t7_f10_credit_panel", lambda t: rnd(P.credit_panel(t.sales).drop("mode", "ttc"), ["log_ttc", "prior_mean"]), """
  SELECT s.customer, s.ent_id, s.date, s.delay_days, CAST(s.delay_days > 60 AS INTEGER) AS y, month(s.date) AS month_no, quarter(s.date) AS quarter, isodow(s.date) - 1 AS weekday, s.year, round(ln(1 + greatest(s.ttc, 0)) + 1e-9, 6) AS log_ttc,
    coalesce(p.n, 0) AS prior_n, p.md AS prior_median, round(p.av + 1e-9, 6) AS prior_mean FROM sales s LEFT JOIN (SELECT a.ent_id, count(*) AS n, median(b.delay_days) AS md, avg(b.delay_days) AS av FROM sales a JOIN sales b
      ON a.customer = b.customer AND b.date < a.date AND NOT b.is_credit GROUP BY 1) p USING (ent_id) WHERE NOT s.is_credit""")

# ------------------------------------------------------------ products


def positions(t):
    return stock.monthly_positions(buys(t), outs(t))


V["pos0"] = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY month) AS rank, qty_in > 0 AS buy, CAST(qty_out > 0 AS INTEGER) AS sold FROM months WHERE cum_in > 0"
V["rep"] = f"""SELECT *, use_3m / (use_12m + 1e-6) AS use_trend, sd12 / (use_12m + 1e-6) AS use_volatility, since_buy / (mean_gap + 1e-6) AS wait_ratio, position / (use_3m + 1e-6) AS cover_months, position / (mean_lot + 1e-6) AS lot_ratio
    FROM (SELECT key, month, rank, position, qty_out AS use_1m, {", ".join(f"avg(qty_out) OVER w{n} AS use_{n}m" for n in (3, 6, 12))}, avg(sold) OVER w12 AS active_share_12m, sum(CAST(buy AS INTEGER)) OVER w12 AS buys_12m,
    coalesce(rank - max(CASE WHEN buy THEN rank END) OVER wr, rank) AS since_buy, coalesce(rank - max(CASE WHEN sold = 1 THEN rank END) OVER wr, rank) AS since_sale, rank / greatest(sum(CAST(buy AS INTEGER)) OVER wr, 1) AS mean_gap,
    coalesce(avg(CASE WHEN buy THEN qty_in END) OVER wr, 0) AS mean_lot, coalesce(position - lag(position, 3) OVER wr, 0) AS position_change_3m, ln(1 + greatest(coalesce(unit_cost, 0), 0)) AS log_unit_cost, month(month) AS month_no,
    CASE WHEN count(*) OVER w12 >= 3 THEN stddev_samp(qty_out) OVER w12 ELSE 0 END AS sd12, CASE WHEN count(*) OVER wf = 3 THEN CAST(sum(CAST(buy AS INTEGER)) OVER wf > 0 AS INTEGER) END AS y FROM pos0
    WINDOW {ROLLS.format(k="key")}, {RUN.format(k="key")}, wf AS (PARTITION BY key ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""
PF = [f for f in P.REPLENISHMENT_FEATURES if f not in ("cover_months", "lot_ratio", "use_trend", "use_volatility")]
q("t8_f10_replenishment_panel", lambda t: rnd(P.replenishment_panel(positions(t)).drop("cover_months", "lot_ratio"), [*PF, "use_trend", "use_volatility"], 4), f"""
  SELECT key, month, {rsql([*PF, "use_trend", "use_volatility"], 4)}, y FROM rep WHERE rank >= 12 AND y IS NOT NULL""")
V["mix"] = """SELECT key, month, count(*) AS n_customers, sum(a) AS amount, sum(k) AS cost, sum(b * b) / (sum(b) * sum(b)) AS hhi, max(b) / sum(b) AS top_share FROM (SELECT upper(label) AS key,
    CAST(date_trunc('month', date) AS DATE) AS month, customer, sum(amount) AS a, sum(cost) AS k, sum(abs(amount)) AS b FROM outs WHERE qty > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2"""
q("d11_d12_buyer_mix", lambda t: rnd(P.buyer_mix(outs(t)), ["amount", "cost", "hhi", "top_share"]), f"SELECT key, month, n_customers, {rsql(['amount', 'cost', 'hhi', 'top_share'])} FROM mix")
V["eol"] = f"""SELECT *, use_3m / (use_12m + 1e-6) AS use_trend, sd12 / (use_12m + 1e-6) AS use_volatility, 1 - customers_3m / (customers_12m + 1e-6) AS customer_erosion, price_3m / (price_12m + 1e-6) AS price_drift FROM (
    SELECT *, coalesce(last_value(p3 IGNORE NULLS) OVER wr, 0) AS price_3m, coalesce(last_value(p12 IGNORE NULLS) OVER wr, 0) AS price_12m FROM (SELECT key, month, rank, qty_out AS use_1m,
    {", ".join(f"avg(qty_out) OVER w{n} AS use_{n}m" for n in (3, 6, 12))}, sum(sold) OVER w12 AS active_months_12m, coalesce(rank - max(CASE WHEN sold = 1 THEN rank END) OVER wr, rank) AS since_sale,
    coalesce(rank - max(CASE WHEN buy THEN rank END) OVER wr, rank) AS since_buy, rank AS age_months, max(nc) OVER w12 AS customers_12m, max(nc) OVER w3 AS customers_3m, coalesce(last_value(hhi IGNORE NULLS) OVER wr, 1) AS hhi_ff,
    coalesce(last_value(top_share IGNORE NULLS) OVER wr, 1) AS top_share_ff, avg(nc) OVER w6 AS mean_customers_6m, avg(price) OVER w3 AS p3, avg(price) OVER w12 AS p12,
    CASE WHEN count(price) OVER w12 >= 3 THEN stddev_samp(price) OVER w12 ELSE 0 END AS price_volatility, (amount - cost) / (abs(amount) + 1e-6) AS relative_margin, month(month) AS month_no,
    ln(1 + greatest(position, 0) * greatest(coalesce(unit_cost, 0), 0)) AS log_stock_value, CASE WHEN count(*) OVER w12 >= 3 THEN stddev_samp(qty_out) OVER w12 ELSE 0 END AS sd12,
    CASE WHEN count(*) OVER wf = 6 THEN CAST(sum(sold) OVER wf = 0 AS INTEGER) END AS y, sum(sold) OVER w3 >= 2 AS alive FROM (SELECT p.*, coalesce(n_customers, 0) AS nc, coalesce(amount, 0) AS amount, coalesce(cost, 0) AS cost, hhi, top_share,
      CASE WHEN qty_out > 0 THEN coalesce(amount, 0) / (qty_out + 1e-6) END AS price FROM pos0 p LEFT JOIN mix USING (key, month)) WINDOW {ROLLS.format(k="key")}, {RUN.format(k="key")},
    wf AS (PARTITION BY key ORDER BY month ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WINDOW {RUN.format(k="key")})"""
q("t9_end_of_life_panel", lambda t: rnd(P.end_of_life_panel(positions(t), P.buyer_mix(outs(t))), P.END_OF_LIFE_FEATURES, 3), f"""
  SELECT key, month, {rsql(P.END_OF_LIFE_FEATURES, 3)}, y FROM eol WHERE alive AND rank >= 12 AND y IS NOT NULL""")
V["dagg"] = """SELECT product, month, sum(q) AS qty, sum(a) AS revenue, count(*) AS nc, sum(CASE WHEN segment = 'HOUSEHOLD' THEN q ELSE 0 END) / sum(q) AS pp, sum(CASE WHEN segment = 'FURNITURE' THEN q ELSE 0 END) / sum(q) AS pl,
    sum(q * q) * 10000 / (sum(q) * sum(q)) AS hh FROM (SELECT reference AS product, CAST(date_trunc('month', date) AS DATE) AS month, customer, sum(qty) AS q, sum(amount) AS a FROM lines WHERE qty > 0 GROUP BY 1, 2, 3)
    JOIN customers USING (customer) GROUP BY 1, 2"""
V["dgrid"] = """SELECT g.product, g.month, coalesce(qty, 0) AS qty, coalesce(revenue, 0) AS revenue, coalesce(nc, 0) AS nc, coalesce(last_value(pp IGNORE NULLS) OVER w, 0) AS pp, coalesce(last_value(pl IGNORE NULLS) OVER w, 0) AS pl,
    coalesce(last_value(hh IGNORE NULLS) OVER w, 0) AS hh FROM (SELECT product, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM dagg GROUP BY 1 HAVING count(*) >= 12) g
    LEFT JOIN dagg USING (product, month) WINDOW w AS (PARTITION BY g.product ORDER BY g.month ROWS UNBOUNDED PRECEDING)"""
V["dfeat"] = f"""SELECT product, month, qty, {", ".join(f"lag(qty, {k}) OVER o AS lag_{k}" for k in (1, 2, 3, 6, 12))}, {", ".join(f"avg(qty) OVER p{k} AS ma_{k}" for k in (3, 6, 12))},
    {", ".join(f"CASE WHEN count(qty) OVER p{k} >= 2 THEN stddev_samp(qty) OVER p{k} END AS std_{k}" for k in (3, 6))}, month(month) AS month_no, quarter(month) AS quarter, lag(nc) OVER o AS n_customers, lag(pp) OVER o AS share_public,
    lag(pl) OVER o AS share_lab, lag(hh) OVER o AS hhi, row_number() OVER o - 1 AS age, sum(CAST(qty > 0 AS INTEGER)) OVER pr AS active_months, lag(CASE WHEN qty <> 0 THEN revenue / qty END) OVER o AS price,
    {", ".join(f"CASE WHEN count(*) OVER f{k} = {k} THEN sum(qty) OVER f{k} END AS y_h{k}" for k in (1, 2, 3))} FROM dgrid WINDOW o AS (PARTITION BY product ORDER BY month),
    pr AS (PARTITION BY product ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {", ".join(f"p{k} AS (PARTITION BY product ORDER BY month ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (3, 6, 12))},
    {", ".join(f"f{k} AS (PARTITION BY product ORDER BY month ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING)" for k in (1, 2, 3))}"""
V["dfull"] = """SELECT *, ma_3 / nullif(ma_12, 0) AS ratio_3_12, ma_3 - lag(ma_3, 3) OVER o AS trend_3m, active_months / nullif(age, 0) AS activity_rate, price / lag(price, 3) OVER o - 1 AS price_change FROM dfeat
    WINDOW o AS (PARTITION BY product ORDER BY month)"""
q("t10_d13_f11_demand_features", lambda t: rnd(P.demand_features(t.sales_lines, t.customers), P.DEMAND_FEATURES, 4), f"""
  SELECT product, month, qty, {", ".join(f"round(coalesce({f}, 0)::DOUBLE + 1e-9, 4) AS {f}" for f in P.DEMAND_FEATURES)}, y_h1, y_h2, y_h3 FROM dfull WHERE y_h1 IS NOT NULL""")

# ------------------------------------------------------------ reference demand
MI = "year({0}) * 12 + month({0}) - 1"
V["refper"] = f"""SELECT reference, {MI.format('date')} AS m, customer, segment, sum(qty) AS q0, greatest(sum(qty), 0) AS q, sum(amount) AS a FROM lines JOIN customers USING (customer) WHERE family LIKE 'REACTIF%' GROUP BY 1, 2, 3, 4"""
V["refagg"] = """SELECT reference, m, greatest(sum(q0), 0) AS y, sum(a) AS amount, sum(CASE WHEN segment = 'HOUSEHOLD' THEN q ELSE 0 END) AS q_public_hospital, sum(CASE WHEN segment = 'MACHINERY' THEN q ELSE 0 END) AS q_private_clinic,
    sum(CASE WHEN segment = 'FURNITURE' THEN q ELSE 0 END) AS q_laboratory, sum(CASE WHEN segment NOT IN ('HOUSEHOLD', 'MACHINERY', 'FURNITURE') THEN q ELSE 0 END) AS q_other,
    CASE WHEN sum(q) > 0 THEN sum(q * q) / (sum(q) * sum(q)) END AS hhi, count(*) FILTER (q > 0) AS n_customers FROM refper GROUP BY 1, 2"""
V["refgrid"] = """SELECT g.reference, g.m, coalesce(y, 0) AS y, coalesce(amount, 0) AS amount, coalesce(q_public_hospital, 0) AS q_public_hospital, coalesce(q_private_clinic, 0) AS q_private_clinic, coalesce(q_laboratory, 0) AS q_laboratory,
    coalesce(q_other, 0) AS q_other, hhi, coalesce(n_customers, 0) AS n_customers, g.m - (SELECT min(m) FROM refagg) AS t FROM (SELECT reference, unnest(generate_series((SELECT min(m) FROM refagg), (SELECT max(m) - 1 FROM refagg))) AS m
    FROM (SELECT DISTINCT reference FROM refagg WHERE m <= (SELECT max(m) - 1 FROM refagg))) g LEFT JOIN refagg USING (reference, m)"""
V["refflow"] = f"""SELECT b.reference, b.m, sum(qty) AS qty_in FROM (SELECT reference, {MI.format('date')} AS m, qty FROM purchase_lines) b GROUP BY 1, 2"""
_W = {k: f"w{k} AS (PARTITION BY reference ORDER BY m ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (3, 6, 12, 24)}
_TOT = "(" + " + ".join(f"sum(q_{k}) OVER w12" for k in P.REFERENCE_TYPES) + ")"
V["refpos"] = f"""SELECT reference, {MI.format('month')} AS m, sum(position) AS position FROM months JOIN (SELECT key, arg_min(reference, (-q, reference)) AS reference FROM (
    SELECT upper(trim(label)) AS key, reference, sum(qty) AS q FROM outs GROUP BY 1, 2) GROUP BY 1) USING (key) WHERE cum_in > 0 GROUP BY 1, 2"""
V["reffeat"] = f"""SELECT reference, m, position, {", ".join(f"lag(y, {k}) OVER o AS lag_{k}" for k in range(12))}, lag(y, 11) OVER o AS season_1, lag(y, 23) OVER o AS season_2,
    {", ".join(f"avg(y) OVER w{k} AS mean_{k}, median(y) OVER w{k} AS median_{k}" for k in (3, 6, 12, 24))}, stddev_pop(y) OVER w12 AS std_12, max(y) OVER w12 AS max_12, avg(CAST(y = 0 AS INTEGER)) OVER w12 AS zero_share_12,
    coalesce(avg(y) OVER wp, 0) AS mean_12_before, coalesce(t - last_value(CASE WHEN y > 0 THEN t END IGNORE NULLS) OVER wr, t + 1) AS since_sale, coalesce(t + 1 - min(CASE WHEN y > 0 THEN t END) OVER wr, 0) AS age,
    count(CASE WHEN y > 0 THEN 1 END) OVER w24 AS active_24, count(*) OVER w24 / nullif(count(CASE WHEN y > 0 THEN 1 END) OVER w24, 0) AS adi,
    CASE WHEN count(CASE WHEN y > 0 THEN 1 END) OVER w24 > 1 THEN var_pop(CASE WHEN y > 0 THEN y END) OVER w24 / pow(avg(CASE WHEN y > 0 THEN y END) OVER w24, 2) END AS cv2,
    {", ".join(f"CASE WHEN {_TOT} > 0 THEN sum(q_{k}) OVER w12 / {_TOT} END AS share_{k}" for k in P.REFERENCE_TYPES)}, avg(hhi) OVER w12 AS hhi_12, max(n_customers) OVER w12 AS max_customers_12,
    CASE WHEN sum(y) OVER w12 > 0 THEN sum(amount) OVER w12 / sum(y) OVER w12 END AS price_12, sum(coalesce(qty_in, 0)) OVER w3 AS bought_3, sum(coalesce(qty_in, 0)) OVER w12 AS bought_12,
    count(CASE WHEN y > 0 THEN 1 END) OVER w24 >= 6 AND count(CASE WHEN y > 0 THEN 1 END) OVER w12 >= 1 AS eligible, lead(y, 1) OVER o AS target
    FROM refgrid LEFT JOIN refflow USING (reference, m) LEFT JOIN refpos USING (reference, m) WINDOW o AS (PARTITION BY reference ORDER BY m), {", ".join(_W.values())}, wp AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING),
    wr AS (PARTITION BY reference ORDER BY m ROWS UNBOUNDED PRECEDING)"""
V["refmarket"] = """SELECT m, mk AS market_last, lag(mk, 11) OVER (ORDER BY m) AS market_year_ago, avg(mk) OVER (ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS market_mean_12 FROM (SELECT m, sum(y) AS mk FROM refgrid GROUP BY 1)"""


def ref_demand(t):
    return P.reference_demand(t.sales_lines, t.customers)


def ref_flows(t):
    bought = t.purchase_lines.groupBy("reference", R.month_index(c("date")).alias("m")).agg(F.sum("qty").alias("qty_in"))
    return bought.join(P.reference_positions(positions(t), outs(t)), ["reference", "m"], "full")


XF = [f for f in P.REFERENCE_FEATURES if f != "growth_12"]
q("t11_reference_features", lambda t: rnd(P.reference_features(ref_demand(t), ref_flows(t)), [*XF, "growth_12"], 4).drop("h", "target_month"), f"""
  SELECT reference, m, {rsql(XF, 4)}, round(CASE WHEN mean_12_before > 0 THEN mean_12 / mean_12_before END + 1e-9, 4) AS growth_12, target FROM reffeat JOIN refmarket USING (m) WHERE eligible""")
V["rbuy"] = "SELECT reference, customer, m, q FROM refper WHERE q > 0"
q("t11_customer_signals", lambda t: rnd(P.customer_signals(t.sales_lines, t.quotes), ["expected_repurchase", "quote_activity", "quoted_amount_3m"], 3), f"""
  WITH v AS (SELECT reference, customer, m + k AS m, sum(q) AS v FROM rbuy, (SELECT unnest(range(12)) AS k) GROUP BY 1, 2, 3), qm AS (SELECT customer, {MI.format('date')} AS qm, sum(ht) AS ht FROM quotes GROUP BY 1, 2),
  lo AS (SELECT min(m) AS lo FROM rbuy), p AS (SELECT customer, qm + k AS m, coalesce(sum(ht) FILTER (k <= 2), 0) AS recent, coalesce(sum(ht) FILTER (k >= 3), 0) AS before FROM qm, (SELECT unnest(range(15)) AS k) GROUP BY 1, 2),
  x AS (SELECT v.*, coalesce(recent, 0) AS recent, coalesce(CASE WHEN m - lo - 2 > 0 THEN before / least(12, m - lo - 2) * 3 END, 0) AS usual FROM v LEFT JOIN p USING (customer, m), lo),
  s AS (SELECT reference, m, sum(v * least(CASE WHEN usual > 0 THEN recent / usual WHEN recent > 0 THEN 2 ELSE 1 END, 5)) / sum(v) AS qa, sum(v * recent) / sum(v) AS qq FROM x GROUP BY 1, 2),
  o AS (SELECT DISTINCT reference, customer, m + k AS o FROM rbuy, (SELECT unnest([10, 11, 12]) AS k)), w AS (SELECT o.reference, o.o AS m, o.customer, sum(q) FILTER (b.m BETWEEN o.o - 12 AND o.o - 10) AS th,
    coalesce(sum(q) FILTER (b.m BETWEEN o.o - 9 AND o.o), 0) AS si FROM o JOIN rbuy b ON b.reference = o.reference AND b.customer = o.customer GROUP BY 1, 2, 3), a AS (SELECT reference, m, sum(th) AS er FROM w WHERE si = 0 GROUP BY 1, 2)
  SELECT reference, m, round(coalesce(er, 0) + 1e-9, 3) AS expected_repurchase, round(coalesce(qa, 0) + 1e-9, 3) AS quote_activity, round(coalesce(qq, 0) + 1e-9, 3) AS quoted_amount_3m FROM s FULL JOIN a USING (reference, m)""")

# ------------------------------------------------------------ profiles and elementary windows
q("t12_customer_profiles", lambda t: rnd(P.customer_profiles(t.sales, t.customers, star.mart_demand_customer_product(t.sales_lines)).drop("revenue"), P.PROFILE_FEATURES), f"""
  WITH b AS (SELECT customer, count(*) AS n, sum(ttc) AS t, min(date) AS f, max(date) AS l, count(DISTINCT strftime(date, '%Y-%m')) AS am FROM sales WHERE NOT is_credit GROUP BY 1 HAVING count(*) >= 3 AND sum(ttc) > 0),
  v AS (SELECT customer, count(*) AS nf FROM (SELECT customer, label FROM lines GROUP BY 1, 2 HAVING sum(qty) > 0) GROUP BY 1), r AS (SELECT max(date) AS md FROM sales),
  x AS (SELECT b.*, nf, datediff('day', l, md) AS rd, greatest(({MI.format('md')}) - ({MI.format('f')}), 1) AS ag FROM b JOIN customers USING (customer) LEFT JOIN v USING (customer), r)
  SELECT customer, round(ln(1 + t) + 1e-9, 6) AS log_revenue, round(ln(1 + n) + 1e-9, 6) AS log_frequency, rd::DOUBLE AS recency_days, round(least(am / ag, 1) + 1e-9, 6) AS regularity, round(ln(1 + t / n) + 1e-9, 6) AS log_basket,
    ag::DOUBLE AS age_months, round(ln(1 + coalesce(nf, 1)) + 1e-9, 6) AS log_variety FROM x""")
q("f14_latest_row_per_customer", lambda t: t.sales.groupBy("customer").agg(F.max_by(F.struct("date", "ttc"), F.struct("date", "ent_id")).alias("r")).select("customer", "r.date", F.round("r.ttc", 2).alias("ttc")), """
  SELECT customer, date, round(ttc, 2) AS ttc FROM sales QUALIFY row_number() OVER (PARTITION BY customer ORDER BY date DESC, ent_id DESC) = 1""")
q("f1_f2_rank_and_count", lambda t: t.sales.groupBy("customer", R.month_key(c("date")).alias("month")).agg(F.sum("ttc").alias("v")).select(
    "customer", "month", F.row_number().over(Window.partitionBy("customer").orderBy(c("v").desc(), "month")).alias("month_rank"), F.count(F.lit(1)).over(Window.partitionBy("customer")).alias("n_months")), """
  WITH m AS (SELECT customer, strftime(date, '%Y-%m') AS month, sum(ttc) AS v FROM sales GROUP BY 1, 2)
  SELECT customer, month, row_number() OVER (PARTITION BY customer ORDER BY v DESC, month) AS month_rank, count(*) OVER (PARTITION BY customer) AS n_months FROM m""")
q("d8_d9_conditional_aggregates", lambda t: t.sales.groupBy("mode").agg(F.expr("sum(ttc) filter (where delay_days > 60)").alias("s"), F.expr("count(distinct customer) filter (where is_credit)").alias("credited_customers")).select(
    "mode", F.round("s", 2).alias("late_amount"), "credited_customers"), """
  SELECT mode, round(sum(ttc) FILTER (delay_days > 60), 2) AS late_amount, count(DISTINCT customer) FILTER (is_credit) AS credited_customers FROM sales GROUP BY 1""")
q("d14_group_by_all", lambda t: t.spark.sql("SELECT customer, trunc(date, 'month') AS month, count(*) AS n, round(sum(ht), 4) AS ht FROM {q} GROUP BY ALL", q=t.quotes), """
  SELECT customer, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n, round(sum(ht), 4) AS ht FROM quotes GROUP BY 1, 2""")
q("s10_seasonal_encodings", lambda t: t.sales.select("ent_id", F.round(F.sin(F.month("date") * 2 * F.pi() / 12), 6).alias("sin_month"), F.round(F.cos(F.month("date") * 2 * F.pi() / 12), 6).alias("cos_month"),
  F.round(F.signum("ttc") * F.log1p(F.abs("ttc")), 6).alias("signed_log"), F.round(F.expm1(F.log1p(F.abs("ttc"))), 2).alias("back")), """
  SELECT ent_id, round(sin(month(date) * 2 * pi() / 12), 6) AS sin_month, round(cos(month(date) * 2 * pi() / 12), 6) AS cos_month, round(sign(ttc) * ln(1 + abs(ttc)), 6) AS signed_log, round(abs(ttc), 2) AS back FROM sales""")
q("s5_s6_s7_date_functions", lambda t: t.sales.select("ent_id", (F.dayofweek("date") - 1).alias("dow"), F.weekday("date").alias("weekday"), F.quarter("date").alias("quarter"), F.weekofyear("date").alias("iso_week"),
  (R.month_index(c("due")) - R.month_index(c("date"))).alias("months_apart"), F.add_months("date", -6).alias("half_year_before"), F.trunc("date", "month").alias("month")), f"""
  SELECT ent_id, dayofweek(date) AS dow, isodow(date) - 1 AS weekday, quarter(date) AS quarter, weekofyear(date) AS iso_week, datediff('month', date, due) AS months_apart, CAST(date - INTERVAL 6 MONTH AS DATE) AS half_year_before,
    CAST(date_trunc('month', date) AS DATE) AS month FROM sales""")
