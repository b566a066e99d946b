"""Receivable, scenario and cash queries (r1..r10, k40)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.operators import receivables as rec
from tradewright.plans.registry import register

c = F.col
YEARS = (1995, 2035)
MI = "year({0}) * 12 + month({0}) - 1"
V = {
    "book": f"""SELECT {MI.format('date')} AS issue, {MI.format('due')} AS due_m, sum(ttc) AS amount, count(*) AS documents FROM sales WHERE NOT is_credit AND due >= date GROUP BY 1, 2""",
    "tot": "SELECT due_m, sum(amount) AS total FROM book GROUP BY 1",
    "mat": """SELECT h, origin, origin + h AS due_m, coalesce((SELECT sum(amount) FROM book b WHERE b.due_m = g.origin + hh.h AND b.issue <= g.origin), 0) AS booked, total,
        CASE WHEN total > 0 THEN coalesce((SELECT sum(amount) FROM book b WHERE b.due_m = g.origin + hh.h AND b.issue <= g.origin), 0) / total END AS rate
        FROM (SELECT unnest(generate_series((SELECT min(due_m) FROM book), (SELECT max(issue) FROM book))) AS origin) g, (SELECT unnest([1, 2]) AS h) hh
        LEFT JOIN tot ON tot.due_m = origin + h""",
    "fc": """SELECT *, CASE WHEN n >= 3 THEN med END AS maturity, CASE WHEN n >= 3 AND med >= 0.5 THEN 'multiplicative' WHEN rem IS NOT NULL THEN 'additive' END AS method,
        CASE WHEN n >= 3 AND med >= 0.5 THEN booked / med ELSE booked + rem END AS forecast FROM (SELECT m.*,
          (SELECT count(rate) FROM mat x WHERE x.h = m.h AND x.origin <= m.origin - m.h) AS n, (SELECT median(rate) FROM mat x WHERE x.h = m.h AND x.origin <= m.origin - m.h) AS med,
          (SELECT median(total - booked) FROM mat x WHERE x.h = m.h AND x.total > 0 AND x.origin BETWEEN m.origin - m.h - 5 AND m.origin - m.h) AS rem FROM mat m)""",
    "monthly": f"""SELECT mode, {MI.format('due')} AS m, sum(ttc) AS amount, count(*) AS n FROM sales GROUP BY 1, 2""",
    "holes": f"""SELECT m, sum(amount) AS amount, CAST(sum(n) AS BIGINT) AS n FROM monthly WHERE m NOT BETWEEN 1996 * 12 + 2 AND 1996 * 12 + 5 AND m % 17 <> 3 GROUP BY 1""",
}


def q(name, build, sql=None):
    register(name, build, sql, V)


def book(t):
    return rec.due_book(t.sales, YEARS)


def monthly(t):
    return t.sales.groupBy("mode", R.month_index(c("due")).alias("m")).agg(F.sum("ttc").alias("amount"), F.count(F.lit(1)).alias("n"))


OVERDUE = """WITH ref AS (SELECT max(due) AS d, max(date) AS a FROM sales), act AS (SELECT customer, max(date) AS last_order FROM sales WHERE NOT is_credit GROUP BY 1),
  e AS (SELECT customer, sum(ttc) AS m, count(*) AS documents, min(due) AS oldest_due, coalesce(sum(ttc) FILTER (due < d - 90), 0) AS m90 FROM sales, ref
    WHERE NOT is_credit AND due < d AND due >= d - INTERVAL 18 MONTH GROUP BY 1 HAVING sum(ttc) > 0),
  o AS (SELECT customer, customer_name, round(m, 2) AS overdue, round(m90, 2) AS overdue_90, documents, oldest_due, datediff('day', oldest_due, d) AS age_days, last_order,
    datediff('day', last_order, a) AS silence_days, CASE WHEN datediff('day', last_order, a) <= 90 THEN 'probably_settled' WHEN m90 > 0 THEN 'check_first' ELSE 'to_check' END AS situation
    FROM e JOIN customers USING (customer) LEFT JOIN act USING (customer), ref)"""
q("r1_overdue_receivables", lambda t: rec.overdue_receivables(t.sales, t.customers), OVERDUE + " SELECT * FROM o")
q("r1_overdue_totals", lambda t: rec.overdue_totals(rec.overdue_receivables(t.sales, t.customers)),
  OVERDUE + " SELECT situation, count(*) AS customers, round(sum(overdue), 2) AS amount FROM o GROUP BY 1")
q("r2_payment_scenarios", lambda t: rec.payment_scenarios(t.sales), """
  WITH s AS (SELECT unnest(['optimistic', 'central', 'pessimistic']) AS scenario, unnest([0, 30, 75]) AS late, unnest([5.0, 20.0, 35.0])::DOUBLE AS share), r AS (SELECT max(date) AS ref, avg(delay_days) AS g FROM sales),
  x AS (SELECT scenario, late, share, max(g) AS g, coalesce(sum(ttc) FILTER (due > ref - late AND due <= ref), 0) AS a, count(*) FILTER (due > ref - late AND due <= ref) AS n,
    sum(ttc) FILTER (due > ref) AS nd FROM sales, s, r GROUP BY 1, 2, 3)
  SELECT scenario, late AS late_days, share AS late_share_pct, round(g, 6) AS granted_delay, round(g + late * share / 100, 6) AS simulated_dso, round(late * share / 100, 6) AS extra_days,
    round(a * share / 100, 4) AS outstanding, CAST(round(n * share / 100) AS BIGINT) AS documents, round(nd, 2) AS not_due,
    round(max(g + late * share / 100) OVER () - min(g + late * share / 100) OVER (), 6) AS dso_range FROM x""")
q("r3_due_book", lambda t: rec.maturity(book(t)).select("h", "origin", F.round("booked", 2).alias("booked"), F.round("total", 2).alias("total"), F.round("rate", 6).alias("rate")),
  "SELECT h, origin, round(booked, 2) AS booked, round(total, 2) AS total, round(rate, 6) AS rate FROM mat")
q("r4_book_forecast", lambda t: rec.book_forecast(book(t)).select("h", "origin", F.round("maturity", 6).alias("maturity"), "method", F.round("forecast", 4).alias("forecast")), 
  "SELECT h, origin, round(maturity, 6) AS maturity, method, round(forecast, 4) AS forecast FROM fc")
q("r5_book_evaluation", lambda t: rec.book_evaluation(book(t)).select("h", "share_long_enough", "refused", "origins", "mape", "last_month_mape", "seasonal_12_mape", "mean_3_mape", "median_6_mape"), """
  WITH e AS (SELECT max(issue) - 1 AS fin FROM book), x AS (SELECT fc.h, origin, total, forecast,
      (SELECT total FROM tot WHERE due_m <= origin ORDER BY due_m DESC LIMIT 1) AS l1, (SELECT total FROM tot WHERE due_m = origin + fc.h - 12) AS s12,
      (SELECT avg(total) FROM (SELECT total FROM tot WHERE due_m <= origin ORDER BY due_m DESC LIMIT 3)) AS m3,
      (SELECT median(total) FROM (SELECT total FROM tot WHERE due_m <= origin ORDER BY due_m DESC LIMIT 6)) AS m6
    FROM fc, e WHERE total > 0 AND forecast IS NOT NULL AND origin + fc.h <= fin AND origin > fin - fc.h - 12)
  SELECT h, round((SELECT sum(documents) FILTER (due_m - issue >= h) / sum(documents) FROM book), 6) AS share_long_enough, false AS refused, count(*) AS origins,
    round(avg(abs(forecast - total) / total * 100), 6) AS mape, round(avg(abs(l1 - total) / total * 100), 6) AS last_month_mape, round(avg(abs(s12 - total) / total * 100), 6) AS seasonal_12_mape,
    round(avg(abs(m3 - total) / total * 100), 6) AS mean_3_mape, round(avg(abs(m6 - total) / total * 100), 6) AS median_6_mape FROM x GROUP BY h""")
q("r6_clean_series", lambda t: rec.clean_series(monthly(t).filter((~c("m").between(1996 * 12 + 2, 1996 * 12 + 5)) & (c("m") % 17 != 3)).groupBy("m").agg(
    F.sum("amount").alias("amount"), F.sum("n").alias("n"))).select("m", F.round("value", 2).alias("value"), "interpolated"), """
  WITH h AS (SELECT *, lag(m) OVER (ORDER BY m) AS p FROM holes), c AS (SELECT * FROM holes WHERE m >= (SELECT coalesce(max(m) FILTER (m - p > 3), min(m)) FROM h)),
  g AS (SELECT unnest(generate_series((SELECT min(m) FROM c), (SELECT max(m) FROM c))) AS m), f AS (SELECT g.m, amount, coalesce(n, 0) AS n,
    (SELECT max(m) FROM c WHERE c.m <= g.m) AS pm, (SELECT min(m) FROM c WHERE c.m >= g.m) AS nm FROM g LEFT JOIN c USING (m))
  SELECT f.m, round(coalesce(f.amount, a.amount + (b.amount - a.amount) * (f.m - pm) / (nm - pm)), 2) AS value, f.amount IS NULL AS interpolated FROM f JOIN c a ON a.m = pm JOIN c b ON b.m = nm
  WHERE f.m <= greatest((SELECT max(m) FROM f WHERE n >= 0.4 * (SELECT median(n) FROM c)), (SELECT min(m) FROM c) + 23)""")
q("r7_damped_forecast", lambda t: rec.damped_seasonal_forecast(rec.clean_series(monthly(t), ["mode"]), "mode").select("mode", "h", "m", F.round("forecast", 0).alias("forecast"), F.round("lower", 0).alias("lower"),
  F.round("upper", 0).alias("upper")), """
  WITH k AS (SELECT *, (SELECT median(n) FROM monthly y WHERE y.mode = x.mode) AS md FROM monthly x), s AS (SELECT mode, m, amount FROM k x WHERE m <= (SELECT max(m) FROM k y WHERE y.mode = x.mode AND n >= 0.4 * md)),
  l AS (SELECT *, ln(1 + greatest(amount, 0)) AS g FROM s), z AS (SELECT *, (g - avg(g) OVER w) / stddev_pop(g) OVER w AS z, avg(g) OVER w AS mu, stddev_pop(g) OVER w AS sd,
    row_number() OVER (PARTITION BY mode ORDER BY m DESC) AS rn FROM l WINDOW w AS (PARTITION BY mode)),
  y AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY m) - 1 AS x FROM z WHERE rn <= 30), f AS (SELECT mode, regr_slope(z, x) AS a, regr_intercept(z, x) AS b, max(m) AS la, max(mu) AS mu, max(sd) AS sd FROM y GROUP BY 1),
  d AS (SELECT y.mode, x, x % 12 AS s, z - (a * x + b) AS e FROM y JOIN f USING (mode)), r AS (SELECT mode, s, avg(e) AS r FROM d GROUP BY 1, 2), q AS (SELECT mode, s, r - avg(r) OVER (PARTITION BY mode) AS q FROM r),
  v AS (SELECT mode, least(stddev_pop(e - q), 0.30) AS v FROM d JOIN q USING (mode, s) GROUP BY 1), p AS (SELECT f.mode, h, la + h AS m, sd, mu, v, a * 29 + b + q + a * 0.85 * (1 - pow(0.85, h)) / 0.15 AS zh
    FROM f CROSS JOIN (SELECT unnest(range(1, 7)) AS h) JOIN q ON q.mode = f.mode AND q.s = (29 + h) % 12 JOIN v ON v.mode = f.mode), i AS (SELECT *, exp(zh * sd + mu) - 1 AS c FROM p)
  SELECT mode, h, m, round(greatest(0, c), 0) AS forecast, round(greatest(0, least(exp((zh - 1.96 * v) * sd + mu) - 1, 0.6 * c)), 0) AS lower, round(greatest(c, least(exp((zh + 1.96 * v) * sd + mu) - 1, 1.7 * c)), 0) AS upper FROM i""")
q("r9_linear_projection", lambda t: rec.linear_projection(t.sales.groupBy("customer", R.month_index(c("date")).alias("m")).agg(F.sum("ttc").alias("value")), "customer").select(
    "customer", "h", "m", F.round(c("forecast") + 1e-6, 2).alias("forecast")), f"""
  WITH s AS (SELECT customer, {MI.format('date')} AS m, sum(ttc) AS v FROM sales GROUP BY 1, 2), x AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY m DESC) AS rn FROM s),
  y AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY m) - 1 AS i FROM x WHERE rn <= 12),
  f AS (SELECT customer, regr_slope(v, i) AS a, regr_intercept(v, i) AS b, count(*) AS n, max(m) AS la FROM y GROUP BY 1 HAVING count(*) >= 3)
  SELECT customer, h, la + h AS m, round(greatest(0, a * (n - 1 + h) + b) + 1e-6, 2) AS forecast FROM f, (SELECT unnest([1, 2, 3]) AS h)""")
AS_OF = dt.date(1999, 6, 30)


def schedule(t):
    s = t.sales.select(c("customer").alias("party"), "delay_days")
    p = t.purchases.select(c("supplier").alias("party"), "delay_days")
    return rec.imported_schedule(t.imported, s, p, AS_OF)


SCHED = """WITH sp AS (SELECT customer AS party, CAST(round(median(delay_days)) AS INTEGER) AS d FROM sales GROUP BY 1), pp AS (SELECT supplier AS party, CAST(round(median(delay_days)) AS INTEGER) AS d FROM purchases GROUP BY 1),
  x AS (SELECT i.*, CASE WHEN side = 'sale' THEN sp.d ELSE pp.d END AS pd, CASE WHEN side = 'sale' THEN (SELECT CAST(round(median(delay_days)) AS INTEGER) FROM sales)
    ELSE (SELECT CAST(round(median(delay_days)) AS INTEGER) FROM purchases) END AS gd FROM imported i LEFT JOIN sp ON sp.party = i.party LEFT JOIN pp ON pp.party = i.party
    WHERE settled IS NULL AND recon_status NOT IN ('matched', 'probable_duplicate')),
  y AS (SELECT *, coalesce(due, coalesce(date, DATE '1999-06-30') + coalesce(pd, gd)) AS u FROM x),
  sch AS (SELECT id, side, party, u AS due, CASE WHEN due IS NOT NULL THEN 'read' ELSE concat(CASE WHEN pd IS NOT NULL THEN 'party_delay' ELSE 'mean_delay' END, CASE WHEN date IS NULL THEN '_undated' ELSE '' END) END AS source,
    round(coalesce(net, ttc), 3) AS amount, CASE WHEN u < DATE '1999-06-30' THEN 'late' ELSE 'upcoming' END AS status, greatest(0, datediff('day', u, DATE '1999-06-30')) AS days_late FROM y)"""
q("r8_imported_schedule", schedule, SCHED + " SELECT * FROM sch")
q("r8_schedule_by_month", lambda t: rec.schedule_by_month(schedule(t)), SCHED + """
  SELECT CASE WHEN status = 'late' THEN 'late' ELSE strftime(due, '%Y-%m') END AS period, round(coalesce(sum(amount) FILTER (side = 'sale'), 0), 2) AS cash_in,
    round(coalesce(sum(amount) FILTER (side = 'purchase'), 0), 2) AS cash_out, round(coalesce(sum(amount) FILTER (side = 'sale'), 0) - coalesce(sum(amount) FILTER (side = 'purchase'), 0), 2) AS balance,
    count(*) AS documents, count(*) FILTER (source <> 'read') AS deduced FROM sch GROUP BY 1""")
q("d10_median_delay_by_party", lambda t: t.sales.groupBy("customer").agg(F.median("delay_days").alias("median_delay")),
  "SELECT customer, median(delay_days) AS median_delay FROM sales GROUP BY 1")
q("k40_imported_latest", lambda t: t.imported.filter("side = 'sale'").orderBy(c("date").desc_nulls_last(), c("number").asc_nulls_last(), "id").limit(50).select("id", "number", "party", "date", "ttc", "net"), """
  SELECT id, number, party, date, ttc, net FROM imported WHERE side = 'sale' ORDER BY date DESC NULLS LAST, number NULLS LAST, id LIMIT 50""")
q("r10_maturity_dispersion", lambda t: rec.maturity_dispersion(book(t)), """
  SELECT count(*) AS origins, round(quantile_cont(rate, 0.25), 6) AS q25, round(median(rate), 6) AS median, round(quantile_cont(rate, 0.75), 6) AS q75, round(avg(rate), 6) AS mean,
    round(stddev_pop(rate), 6) AS std, round(min(rate), 6) AS low, round(max(rate), 6) AS high FROM mat WHERE h = 1 AND rate IS NOT NULL""")
q("r10_maturity_by_month", lambda t: rec.maturity_by_month(book(t)),
  "SELECT CAST(due_m % 12 + 1 AS INTEGER) AS month_no, count(*) AS origins, round(median(rate), 6) AS median_rate FROM mat WHERE h = 1 AND rate IS NOT NULL GROUP BY 1")
q("r10_maturity_estimators", lambda t: rec.maturity_estimators(book(t)), """
  WITH m AS (SELECT *, row_number() OVER (ORDER BY origin) AS i FROM mat WHERE h = 1 AND rate IS NOT NULL), x AS (SELECT rate, (SELECT median(rate) FROM m y WHERE y.i < m.i) AS g,
    (SELECT CASE WHEN count(*) >= 2 THEN median(rate) END FROM m y WHERE y.i < m.i AND y.due_m % 12 = m.due_m % 12) AS s, (SELECT median(rate) FROM m y WHERE y.i BETWEEN m.i - 6 AND m.i - 1) AS six FROM m WHERE i > 12)
  SELECT round(avg(abs(g - rate)), 6) AS global_error, round(avg(abs(coalesce(s, g) - rate)), 6) AS same_month_error, round(avg(abs(six - rate)), 6) AS last_six_error FROM x""")
q("r10_maturity_correlation", lambda t: rec.maturity_correlation(book(t)), """
  WITH m AS (SELECT round(rate, 9) AS rate, (SELECT avg(total) FROM tot WHERE tot.due_m BETWEEN origin - 2 AND origin) AS level FROM mat WHERE h = 1 AND rate IS NOT NULL AND origin IN (SELECT due_m FROM tot)),
  r AS (SELECT rank() OVER (ORDER BY rate) + (count(*) OVER (PARTITION BY rate) - 1) / 2.0 AS a, rank() OVER (ORDER BY level) + (count(*) OVER (PARTITION BY level) - 1) / 2.0 AS b FROM m)
  SELECT round(corr(a, b), 6) AS spearman_level FROM r""")
q("r10_delay_in_months", lambda t: rec.delay_in_months(book(t)), """
  WITH g AS (SELECT due_m - issue AS months, sum(documents) AS documents FROM book GROUP BY 1)
  SELECT months, CAST(documents AS BIGINT) AS documents, round(documents * 100.0 / sum(documents) OVER (), 6) AS share_pct, round(sum(documents) OVER (ORDER BY months) * 100.0 / sum(documents) OVER (), 6) AS cumulative_pct FROM g""")
q("r10_month_composition", lambda t: rec.month_composition(book(t)), "SELECT due_m, issue, due_m - issue AS delay_months, documents, round(amount, 2) AS amount FROM book")
q("r10_start_period_effect", lambda t: rec.start_period_effect(book(t), [1995 * 12, 1998 * 12, 2000 * 12]), """
  SELECT start, count(*) AS origins, round(median(rate), 6) AS median_rate FROM mat, (SELECT unnest([23940, 23976, 24000]) AS start) WHERE h = 1 AND rate IS NOT NULL AND origin >= start GROUP BY 1""")
