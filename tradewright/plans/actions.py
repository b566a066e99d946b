"""Finding, dispatch and action-loop queries (a10, a11, c22, d16, n11..n20)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewright.operators import actions as A
from tradewright.operators import kpi
from tradewright.operators import panels as P
from tradewright.operators import procurement as pro
from tradewright.operators import receivables as rec
from tradewright.operators import serving as S
from tradewright.operators import star, stock
from tradewright.plans import panels as pp
from tradewright.plans.registry import register
from tradewright.plans.supply import V as SUPPLY
from tradewright.plans.supply import with_opening
from tradewright.session import shared_folder

c = F.col
V = {
    **SUPPLY,
    "annual": "SELECT sum(ttc) AS y FROM sales WHERE NOT is_credit AND date >= (SELECT max(date) FROM sales) - INTERVAL 12 MONTH",
    "t_rec": """SELECT customer AS code, customer_name AS name, round(m, 2) AS amount FROM (SELECT customer, sum(ttc) AS m FROM sales, (SELECT max(due) AS d FROM sales) WHERE NOT is_credit AND due < d AND due >= d - INTERVAL 18 MONTH
        GROUP BY 1 HAVING sum(ttc) > 0) JOIN customers USING (customer)""",
    "t_ret": """SELECT customer AS code, customer_name AS name, before - recent AS amount FROM (SELECT customer, count(DISTINCT strftime(date, '%Y-%m')) AS am, round(coalesce(sum(ttc) FILTER (date >= md - 90), 0), 2) AS recent,
        round(coalesce(sum(ttc) FILTER (date >= md - 180 AND date < md - 90), 0), 2) AS before FROM sales, (SELECT max(date) AS md FROM sales) GROUP BY 1) JOIN customers USING (customer) WHERE am >= 6 AND before > 0 AND recent < before * 0.4""",
    "t_com": "SELECT customer AS code, customer_name AS name, amount FROM (SELECT customer, round(sum(ht), 4) AS amount FROM quotes WHERE NOT converted GROUP BY 1) JOIN customers USING (customer)",
    "found": " UNION ALL ".join(f"""SELECT '{d}' AS domain, '{t}' AS title, CASE WHEN a <= 0 THEN 'low' WHEN a / (SELECT round(y, 2) FROM annual) >= 0.05 THEN 'high' ELSE 'medium' END AS severity, a AS amount, n AS n_targets, l AS targets
        FROM (SELECT sum(amount) AS a, count(*) AS n, list({{'code': code, 'name': name, 'amount': amount}} ORDER BY amount DESC, CAST(code AS VARCHAR)) AS l FROM {v})""" for d, t, v in (
        ("recovery", "overdue receivables", "t_rec"), ("retention", "disengaging customers", "t_ret"), ("commercial", "open quotes", "t_com"))),
    "arb": """SELECT *, row_number() OVER (ORDER BY stake DESC, title) AS rank FROM (SELECT *, CASE domain WHEN 'recovery' THEN 0.15::DOUBLE WHEN 'retention' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS share,
        amount * CASE domain WHEN 'recovery' THEN 0.15::DOUBLE WHEN 'retention' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END AS stake FROM found)""",
    "multi": """SELECT name, count(*) AS n_domains, string_agg(domain, ',' ORDER BY domain) AS domains, round(sum(a), 2) AS amount FROM (SELECT upper(trim(t.name)) AS name, domain, sum(t.amount) AS a
        FROM (SELECT domain, unnest(targets) AS t FROM found) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) >= 2""",
}


def q(name, build, sql=None):
    register(name, build, sql, V)


def findings(t):
    """Findings of three domains over the whole tables."""
    annual = kpi.annual_revenue(t.sales).scalar()
    sev = A.stake_severity(annual)
    late = rec.overdue_receivables(t.sales, t.customers)
    away = kpi.disengaging_customers(t.sales, t.customers, 1000000).withColumn("loss", c("before") - c("recent"))
    quotes = A.open_quotes_by_customer(t.quotes).join(t.customers, "customer")
    return A.all_findings([
        A.finding(late, "recovery", "overdue receivables", sev, "customer", "customer_name", "overdue"),
        A.finding(away, "retention", "disengaging customers", sev, "customer", "customer_name", "loss"),
        A.finding(quotes, "commercial", "open quotes", sev, "customer", "customer_name", "amount")])


def today(t):
    return t.tasks.agg(F.max("created")).scalar()


q("n19_n20_findings", lambda t: A.ordered_findings(findings(t)), """
  SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, f.amount DESC, title) AS position, domain, title, severity, round(f.amount, 2) AS amount, n_targets FROM found f""")
q("n20_cash_finding", lambda t: A.cash_finding(t.sales, t.purchases), """
  WITH g AS (SELECT (SELECT avg(delay_days) FROM sales WHERE NOT is_credit) - (SELECT avg(delay_days) FROM purchases WHERE NOT is_credit) AS g), r AS (SELECT sum(ttc) AS r FROM sales WHERE date > (SELECT max(date) FROM sales) - INTERVAL 12 MONTH)
  SELECT round(g, 6) AS gap_days, round(r, 2) AS trailing_revenue, round(g / 365 * r, 2) AS working_capital FROM g, r""")
q("n20_stock_and_supplier_findings", lambda t: A.ordered_findings(A.all_findings([
    A.finding(stock.obsolescence(with_opening(t)), "stock", "obsolete stock", A.stake_severity(kpi.annual_revenue(t.sales).scalar()), "key", "product", "loss"),
    A.finding(pro.supplier_ranking(t.purchases, t.purchase_lines, t.suppliers, 1.1).filter("dependency"), "procurement", "supplier dependency", A.stake_severity(kpi.annual_revenue(t.sales).scalar()), "supplier", "supplier_name", "amount")])), """
  WITH o AS (SELECT greatest(p - monthly_use * CASE WHEN p / monthly_use >= 24 THEN 24 ELSE 12 END, 0) * unit_cost AS a FROM (SELECT *, position + 2 * qty_in AS p FROM flow) WHERE NOT is_service AND p > 0 AND monthly_use > 0 AND unit_cost IS NOT NULL
    AND coalesce(family, '') NOT LIKE 'EQUIPEMENT%' AND coalesce(family, '') NOT LIKE 'SERVICE%' AND p / monthly_use >= 12), s AS (SELECT round(sum(ttc), 2) AS a FROM purchases GROUP BY supplier HAVING sum(ttc) * 100 / (SELECT sum(ttc) FROM purchases) >= 1.1),
  u AS (SELECT 'stock' AS domain, 'obsolete stock' AS title, sum(a) AS a, count(*) AS n FROM o WHERE a >= 100 UNION ALL SELECT 'procurement', 'supplier dependency', sum(a), count(*) FROM s),
  v AS (SELECT *, CASE WHEN a <= 0 THEN 'low' WHEN a / (SELECT round(y, 2) FROM annual) >= 0.05 THEN 'high' ELSE 'medium' END AS severity FROM u WHERE n > 0)
  SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END, a DESC, title) AS position, domain, title, severity, round(a, 2) AS amount, n AS n_targets FROM v""")
q("n12_arbitration", lambda t: A.arbitrate(findings(t)).select("rank", "domain", "title", "severity", "share", F.round("stake", 2).alias("stake")), "SELECT rank, domain, title, severity, share, round(a.stake, 2) AS stake FROM arb a")
q("n12_multi_domain_customers", lambda t: A.multi_domain_customers(findings(t)), "SELECT * FROM multi")
q("n13_open_quotes_by_customer", lambda t: A.open_quotes_by_customer(t.quotes), """
  WITH o AS (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY date DESC, quote_no) AS r FROM quotes WHERE NOT converted)
  SELECT customer, count(*) AS open_quotes, round(sum(ht), 4) AS amount, string_agg(CAST(quote_no AS VARCHAR), ', ' ORDER BY r) AS quotes FROM o GROUP BY 1""")
q("n11_stakes", lambda t: A.stakes(stake_items(t)), "WITH {I} SELECT item, customer, round(sum(amount), 4) AS identified, round(sum(amount) * CASE item WHEN 'open_quotes' THEN 0.15 WHEN 'overdue' THEN 0.3 ELSE 0.2 END, 8) AS recoverable FROM i WHERE amount > 0 GROUP BY 1, 2".replace(
    "{I}", "i AS (SELECT 'open_quotes' AS item, code AS customer, amount::DOUBLE AS amount FROM t_com UNION ALL SELECT 'overdue', code, amount FROM t_rec UNION ALL SELECT 'churn', code, amount FROM t_ret)"))
q("n11_stake_totals", lambda t: A.stake_totals(A.stakes(stake_items(t))), """
  WITH i AS (SELECT 'open_quotes' AS item, code AS customer, amount::DOUBLE AS amount FROM t_com UNION ALL SELECT 'overdue', code, amount FROM t_rec UNION ALL SELECT 'churn', code, amount FROM t_ret),
  s AS (SELECT item, customer, round(sum(amount), 4) AS a, round(sum(amount) * CASE item WHEN 'open_quotes' THEN 0.15 WHEN 'overdue' THEN 0.3 ELSE 0.2 END, 8) AS r FROM i WHERE amount > 0 GROUP BY 1, 2),
  g AS (SELECT item, count(*) AS customers, sum(a) AS a, sum(r) AS r FROM s GROUP BY 1)
  SELECT item, customers, round(a, 2) AS identified, round(r, 2) AS recoverable FROM g UNION ALL SELECT 'total', sum(customers)::BIGINT, round(sum(a), 2), round(sum(r), 2) FROM g""")


def stake_items(t):
    item = lambda df, n, k, a: df.select(F.lit(n).alias("item"), c(k).alias("customer"), c(a).alias("amount"))
    away = kpi.disengaging_customers(t.sales, t.customers, 1000000).withColumn("loss", c("before") - c("recent"))
    return item(A.open_quotes_by_customer(t.quotes), "open_quotes", "customer", "amount").unionByName(
        item(rec.overdue_receivables(t.sales, t.customers), "overdue", "customer", "overdue")).unionByName(item(away, "churn", "customer", "loss"))


PLAN = """WITH tg AS (SELECT rank, title, domain, severity, share, upper(trim(targets[i].name)) AS name, targets[i].amount * share AS a, i FROM arb, (SELECT unnest(range(1, (SELECT max(n_targets) FROM found) + 1)) AS i) WHERE i <= len(targets) AND severity IN ('critical', 'high', 'medium')),
  f AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY i) AS pos FROM tg WHERE name NOT IN (SELECT name FROM multi)),
  u AS (SELECT 0 AS tier, 0 AS r, 0 AS pos, concat('account review: ', name) AS origin, split_part(domains, ',', 1) AS domain, 'high' AS severity, amount AS a, name FROM multi
    UNION ALL SELECT 1, rank, pos, concat(title, ': ', name), domain, severity, a, name FROM f WHERE pos <= 3),
  pl AS (SELECT row_number() OVER (ORDER BY tier, r, pos, a DESC, name) AS position, origin, domain, CASE domain WHEN 'recovery' THEN 'collector' WHEN 'commercial' THEN 'sales' WHEN 'retention' THEN 'sales' ELSE 'manager' END AS job, severity,
    round(a, 2) AS amount FROM u QUALIFY position <= 12)"""
q("n14_dispatch_plan", lambda t: A.dispatch_plan(findings(t)), PLAN + " SELECT * FROM pl")


def task_origins(t):
    """Tasks with the origin they answer, as recorded by the application."""
    return t.tasks.select(F.concat(c("category"), F.lit(":"), c("customer").cast("string")).alias("origin"), "status", "closed")


q("c22_screened_proposals", lambda t: A.screen_proposals(t.tasks.filter("automatic").select(F.concat(c("category"), F.lit(":"), (c("customer") * 2).cast("string")).alias("origin")).distinct(), task_origins(t), today(t)), """
  WITH p AS (SELECT DISTINCT concat(category, ':', customer * 2) AS origin FROM tasks WHERE automatic), o AS (SELECT DISTINCT concat(category, ':', customer) AS origin FROM tasks WHERE status = 'open'),
  r AS (SELECT DISTINCT concat(category, ':', customer) AS origin FROM tasks WHERE status = 'closed' AND closed >= (SELECT max(created) FROM tasks) - 14)
  SELECT origin, CASE WHEN origin IN (SELECT origin FROM o) THEN 'already_open' WHEN origin IN (SELECT origin FROM r) THEN 'recent' ELSE 'create' END AS outcome FROM p""")
q("n15_assignment", lambda t: A.assign(A.dispatch_plan(findings(t)).select("position", "job"), t.tasks.groupBy("assignee").agg(F.count(F.lit(1)).alias("n")).select(
    c("assignee").alias("employee"), F.when(c("assignee") % 2 == 0, "sales").otherwise("collector").alias("job"), (c("n") % 11).cast("int").alias("load"))), PLAN + """
  , e AS (SELECT assignee AS employee, CASE WHEN assignee % 2 = 0 THEN 'sales' ELSE 'collector' END AS job, CAST(count(*) % 11 AS INTEGER) AS load FROM tasks GROUP BY 1), s AS (SELECT employee, job, unnest(range(load, 10)) AS level FROM e),
  k AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY level, employee) AS k FROM s), p AS (SELECT position, job, row_number() OVER (PARTITION BY job ORDER BY position) AS k FROM pl)
  SELECT position, p.job, employee, CASE WHEN employee IS NULL THEN 'team saturated' ELSE 'least loaded' END AS reason FROM p LEFT JOIN k ON k.job = p.job AND k.k = p.k""")
q("n16_loop_impact", lambda t: A.loop_impact(t.tasks, today(t)), """
  SELECT count(*) AS tasks, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'open' AND datediff('day', created, (SELECT max(created) FROM tasks)) > 7) AS late, count(*) FILTER (status = 'closed') AS closed,
    round(sum(stake) FILTER (status = 'open'), 2) AS at_stake, round(sum(stake) FILTER (result = 'won'), 2) AS won_amount, round(count(*) FILTER (result = 'won') * 100.0 / count(*) FILTER (status = 'closed'), 6) AS success_pct,
    round(avg(lead_days), 6) AS mean_lead_days FROM tasks""")
q("d16_loop_rollups", lambda t: A.loop_rollups(t.tasks), """
  WITH u AS (SELECT 'result' AS axis, result AS label, * FROM tasks WHERE status = 'closed' UNION ALL SELECT 'month', strftime(closed, '%Y-%m'), * FROM tasks WHERE result = 'won' UNION ALL SELECT 'origin', category, * FROM tasks)
  SELECT axis, label, count(*) AS tasks, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (result = 'won') AS won, round(coalesce(sum(stake) FILTER (result = 'won'), 0), 2) AS won_amount FROM u GROUP BY 1, 2""")
q("a10_task_export", lambda t: A.task_export(t.tasks), """
  SELECT task_id, customer, category, stake, status, result, CAST(coalesce(result = 'won', false) AS INTEGER) AS won_flag, CASE WHEN result = 'won' THEN stake END AS amount_won, CAST(automatic AS INTEGER) AS auto, round(greatest(lead_days, 0), 3) AS lead_days,
    created, closed FROM tasks""")
q("n16_export_summary", lambda t: A.export_summary(A.task_export(t.tasks)), """
  SELECT category, count(*) AS tasks, count(*) FILTER (status = 'closed') AS closed, count(*) FILTER (result = 'won') AS won, round(coalesce(sum(stake) FILTER (result = 'won'), 0), 2) AS won_amount,
    round(avg(round(greatest(lead_days, 0), 3)), 6) AS mean_lead_days FROM tasks GROUP BY 1""")
q("n17_open_workload", lambda t: A.open_workload(t.tasks), "SELECT assignee, count(*) AS load FROM tasks WHERE status = 'open' GROUP BY 1")
q("n17_latest_open_task", lambda t: A.latest_open_task(t.tasks), """
  SELECT customer, category, task_id, created FROM tasks WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY customer, category ORDER BY created DESC, task_id DESC) = 1""")
q("a11_customer_score_table", lambda t: star.mart_margin_customer_month(t.sales_lines).groupBy("customer").agg(F.max_by("margin", "month").alias("m"), F.max("month").alias("last_month")).select(
    "customer", "last_month", F.round("m", 4).alias("last_margin")), """
  WITH m AS (SELECT customer, strftime(date, '%Y-%m') AS month, sum(amount) - sum(cost) AS m FROM lines WHERE amount <> 0 AND abs(cost) <= 5 * abs(amount) GROUP BY 1, 2)
  SELECT customer, max(month) AS last_month, round(arg_max(m, month), 4) AS last_margin FROM m GROUP BY 1""")


# ------------------------------------------------------------ served models (no SQL equivalent: learned)
def churn_model(t):
    now = P.churn_panel(P.customer_days(t.sales), pp.START, for_scoring=True)
    return S.train_classifier("churn", pp.churn(t), now, P.CHURN_FEATURES, {"recency_days": 1, "recency_gap_ratio": 1, "freq_12m": -1, "revenue_trend": -1}, "obs_date", 90, "customer", c("rev_12m"))


def margin_model(t):
    months, delays = P.customer_months(t.sales_lines), P.monthly_delays(t.sales)
    panel = P.margin_panel(months, delays)
    low = panel.agg(F.percentile("future_margin_pct", F.lit(0.2))).scalar()
    now = S.latest(P.margin_panel(months, delays, for_scoring=True), "customer", "month")
    return S.train_classifier("margin", panel.withColumn("y", (c("future_margin_pct") < low).cast("int")), now, P.MARGIN_FEATURES, {"margin_3m_pct": -1, "margin_12m_pct": -1}, "month", 92, "customer",
                              F.expm1("log_rev_12m") * c("margin_12m_pct") / 100.0)


def quote_model(t):
    every = P.quote_panel(t.quotes, t.sales, t.sales_lines, for_scoring=True)
    still_open = every.filter((c("date") > F.add_months(t.quotes.agg(F.max("date")).scalar(), -6)) & (c("y") == 0))
    return S.train_classifier("quotes", pp.quote_panel(t), still_open, P.QUOTE_FEATURES, {"past_conversion": 1, "log_ht": -1}, "date", 183, "quote_no", c("ht"))


def revenue_model(t):
    months, delays = P.customer_months(t.sales_lines), P.monthly_delays(t.sales)
    now = S.latest(P.revenue_panel(months, delays, 12, for_scoring=True), "customer", "month")
    return S.train_revenue("revenue", P.revenue_panel(months, delays, 12), now, P.REVENUE_FEATURES, "month", 366, "future_revenue", "rev_12m")


def published(t, *models):
    """The folder of a registry that holds one version of the models."""
    folder = f"{shared_folder(t.spark)}/registry-{uuid.uuid4().hex[:12]}"
    S.publish(t.spark, folder, "1", [m(t) for m in models])
    return folder


def served_tables(t):
    folder = published(t, churn_model, margin_model, quote_model, revenue_model)
    return {m: S.served(t.spark, folder, m) for m in ("churn", "margin", "quotes", "revenue")}


q("l17_served_registry", lambda t: S.state(t.spark, published(t, churn_model, margin_model, quote_model, revenue_model)).drop("published_at"))
q("n19_model_findings", lambda t: A.ordered_findings(A.all_findings([*S.model_findings(served_tables(t), t.customers, A.stake_severity(kpi.annual_revenue(t.sales).scalar())), findings(t)])))
