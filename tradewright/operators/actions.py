"""Findings, their arbitration, dispatch to people and the measured outcome of the loop."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar, top_k_per

# Short-term recoverable share by nature of a finding, stake by severity when no amount exists, severity order.
NATURE_SHARE = {"cash": 0.15, "recovery": 0.15, "retention": 0.20, "stock": 0.10, "procurement": 0.05, "commercial": 0.10, "profitability": 0.20, "model_quality": 0.0}
DEFAULT_SHARE = 0.10
SEVERITY_STAKE = {"critical": 5e5, "high": 2e5, "medium": 5e4, "low": 1e4}
CONVERSION = {"open_quotes": 0.15, "overdue": 0.30, "churn": 0.20, "margin": 0.25}
JOB_OF_DOMAIN = (("recovery", "collector"), ("commercial", "sales"), ("retention", "sales"), ("stock", "logistics"), ("procurement", "logistics"))
PER_FINDING, PER_RUN, LOAD_CAP, COOLDOWN_DAYS = 3, 12, 10, 14
DELEGATED = ("critical", "high", "medium")
# end of fixed values


def _lookup(col: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(F.lit(default))


# ---------------------------------------------------------------- building findings

class Findings(NamedTuple):
    """Findings (domain, title, severity, amount, n_targets) and all their targets (domain, title, code, name, amount)."""
    heads: DataFrame
    targets: DataFrame


def finding(targets: DataFrame, domain: str, title: str, severity: Column, key: str, name: str, amount: str) -> Findings:
    """One finding from its target rows; every target stays."""
    label = [F.lit(domain).alias("domain"), F.lit(title).alias("title")]
    head = targets.agg(F.coalesce(F.sum(amount), F.lit(0.0)).alias("amount"), F.count(F.lit(1)).alias("n_targets"))
    rows = targets.select(*label, F.col(key).cast("string").alias("code"), F.col(name).cast("string").alias("name"), F.col(amount).alias("amount"))
    return Findings(head.select(*label, severity.alias("severity"), "amount", "n_targets"), rows)


def stake_severity(annual: Column) -> Column:
    return R.severity(F.col("amount"), annual)


def all_findings(parts: Sequence[Findings]) -> Findings:
    both = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return Findings(both([p.heads for p in parts]).filter("n_targets > 0"), both([p.targets for p in parts]))


def cash_finding(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Working capital financed by the cycle: days of gap over 365 times the trailing revenue."""
    billed = ~F.col("is_credit")
    gap = scalar(sales.filter(billed).agg(F.avg("delay_days"))) - scalar(purchases.filter(billed).agg(F.avg("delay_days")))
    last = scalar(sales.agg(F.max("date")))
    rev = sales.filter(F.col("date") > F.add_months(last, -12)).agg(F.sum("ttc").alias("revenue"))
    return rev.select(F.round(gap, 6).alias("gap_days"), F.round("revenue", 2).alias("trailing_revenue"), F.round(gap / 365 * F.col("revenue"), 2).alias("working_capital"))


def ordered_findings(findings: Findings) -> DataFrame:
    rank = _lookup(F.col("severity"), {"critical": 0, "high": 1, "medium": 2, "low": 3}, 4)
    w = Window.orderBy("s", F.col("amount").desc(), "title")                     # a few dozen findings
    return findings.heads.withColumn("s", rank).select(F.row_number().over(w).alias("position"), "domain", "title", "severity", F.round("amount", 2).alias("amount"), "n_targets")


# ---------------------------------------------------------------- stakes and arbitration

def stakes(items: DataFrame, conversion: dict[str, float] = CONVERSION) -> DataFrame:
    """Identified and recoverable amount per item and customer under the declared conversion rates."""
    rate = _lookup(F.col("item"), conversion, 0.0)
    return items.filter("amount > 0").groupBy("item", "customer").agg(F.sum("amount").alias("a")).select(
        "item", "customer", F.round("a", 4).alias("identified"), F.round(F.col("a") * rate, 8).alias("recoverable"))


def stake_totals(s: DataFrame) -> DataFrame:
    """Per item and overall; the total is the sum of the items."""
    g = s.groupBy("item").agg(F.count(F.lit(1)).alias("customers"), F.sum("identified").alias("i"), F.sum("recoverable").alias("r"))
    t = g.agg(F.lit("total").alias("item"), F.sum("customers").alias("customers"), F.sum("i").alias("i"), F.sum("r").alias("r"))
    return g.unionByName(t).select("item", "customers", F.round("i", 2).alias("identified"), F.round("r", 2).alias("recoverable"))


def arbitrate(findings: Findings) -> DataFrame:
    """Rank findings on one scale: amount times the recoverable share of their nature, severity stake when no amount."""
    share = _lookup(F.col("domain"), NATURE_SHARE, DEFAULT_SHARE)
    stake = F.when(F.col("domain") == "model_quality", 0.0).when(F.col("amount") > 0, F.col("amount") * share).otherwise(_lookup(F.col("severity"), SEVERITY_STAKE, 1e4))
    w = Window.orderBy(F.col("stake").desc(), "title")                           # a few dozen findings
    return findings.heads.withColumns({"share": share, "stake": stake}).withColumn("rank", F.row_number().over(w))


def multi_domain_customers(findings: Findings) -> DataFrame:
    """Names flagged in at least two domains, with the cumulated amount over all targets."""
    t = findings.targets.filter(F.length(F.trim("name")) >= 3)
    d = t.groupBy(F.upper(F.trim("name")).alias("name"), "domain").agg(F.sum("amount").alias("a"))
    return d.groupBy("name").agg(F.count(F.lit(1)).alias("n_domains"), F.array_sort(F.collect_set("domain")).alias("ds"), F.sum("a").alias("a")).filter("n_domains >= 2").select(
        "name", "n_domains", F.array_join("ds", ",").alias("domains"), F.round("a", 2).alias("amount"))


def open_quotes_by_customer(quotes: DataFrame) -> DataFrame:
    """One line per customer from its open quotes: their count, amount and numbers, latest first."""
    o = quotes.filter(~F.col("converted"))
    held = F.array_sort(F.collect_list(F.struct(F.datediff(F.lit("2100-01-01").cast("date"), "date").alias("age"), "quote_no")))
    g = o.groupBy("customer").agg(F.count(F.lit(1)).alias("open_quotes"), F.sum("ht").alias("h"), held.alias("q"))
    return g.select("customer", "open_quotes", F.round("h", 4).alias("amount"), F.array_join(F.transform("q", lambda x: x["quote_no"].cast("string")), ", ").alias("quotes"))


# ---------------------------------------------------------------- dispatch

def dispatch_plan(findings: Findings, per_finding: int = PER_FINDING, per_run: int = PER_RUN) -> DataFrame:
    """Proposals in order: customers flagged in several domains first, then ranked findings target by target, under the caps."""
    c, ranked = F.col, arbitrate(findings)
    multi = multi_domain_customers(findings)
    first = multi.select(F.lit(0).alias("tier"), F.lit(0).alias("r"), F.lit(0).alias("pos"), F.concat(F.lit("account review: "), c("name")).alias("origin"), F.element_at(F.split("domains", ","), 1).alias("domain"),
                         F.lit("high").alias("severity"), c("amount"), c("name"))
    live = ranked.filter(c("severity").isin(*DELEGATED) & (c("domain") != "model_quality"))
    share = F.when(c("amount") > 0, c("share")).otherwise(F.lit(1.0))
    targets = findings.targets.select("domain", "title", F.upper(F.trim("name")).alias("name"), c("amount").alias("ta"), "code").join(
        F.broadcast(live.select("rank", "title", "domain", "severity", share.alias("sh"))), ["domain", "title"]).select(
        "rank", "title", "domain", "severity", "name", "ta", "code", (c("ta") * c("sh")).alias("a")).join(multi.select("name"), "name", "left_anti")      # a few dozen findings
    rest = top_k_per(targets, ["rank"], [c("ta").desc(), c("code").asc()], per_finding, "pos").select(
        F.lit(1).alias("tier"), c("rank").alias("r"), "pos", F.concat("title", F.lit(": "), c("name")).alias("origin"), "domain", "severity", c("a").alias("amount"), "name")
    u = first.unionByName(rest)
    top = u.orderBy("tier", "r", "pos", c("amount").desc(), "name").limit(per_run)
    w = Window.orderBy("tier", "r", "pos", c("amount").desc(), "name")           # at most `per_run` rows
    return top.select(F.row_number().over(w).alias("position"), "origin", "domain", _lookup(c("domain"), dict(JOB_OF_DOMAIN), "manager").alias("job"), "severity", F.round("amount", 2).alias("amount"))


def screen_proposals(proposals: DataFrame, tasks: DataFrame, today: Column, cooldown: int = COOLDOWN_DAYS) -> DataFrame:
    """Outcome of each proposal: already open, handled within the cool-down, or to create. `tasks`: origin, status, closed."""
    open_ = tasks.filter("status = 'open'").groupBy("origin").agg(F.lit(True).alias("is_open"))
    recent = tasks.filter((F.col("status") == "closed") & (F.col("closed") >= F.date_sub(today, cooldown))).groupBy("origin").agg(F.lit(True).alias("is_recent"))
    x = proposals.join(open_, "origin", "left").join(recent, "origin", "left")
    return x.select(*proposals.columns, F.when(F.col("is_open"), "already_open").when(F.col("is_recent"), "recent").otherwise("create").alias("outcome"))


def assign(proposals: DataFrame, employees: DataFrame, cap: int = LOAD_CAP) -> DataFrame:
    """Least-loaded assignment per job: the k-th proposal takes the k-th free slot, slots ordered by load then seniority.

    `employees`: employee, job, load. `proposals`: position, job.
    """
    slots = employees.filter(F.col("load") < cap).select("employee", "job", F.explode(F.sequence(F.col("load"), F.lit(cap - 1))).alias("level"))
    slots = slots.withColumn("k", F.row_number().over(Window.partitionBy("job").orderBy("level", "employee"))).select("job", "k", "employee")
    p = proposals.withColumn("k", F.row_number().over(Window.partitionBy("job").orderBy("position")))
    return p.join(slots, ["job", "k"], "left").drop("k").withColumn("reason", F.when(F.col("employee").isNull(), "team saturated").otherwise("least loaded"))


# ---------------------------------------------------------------- measured loop

def loop_impact(tasks: DataFrame, today: Column, late_after: int = 7) -> DataFrame:
    """Open, late and closed work, amounts won, success rate and mean lead time."""
    o, d, w = F.col("status") == "open", F.col("status") == "closed", F.col("result") == "won"
    a = tasks.agg(F.count(F.lit(1)).alias("tasks"), R.count_where(o).alias("open"), R.count_where(o & (F.datediff(today, "created") > late_after)).alias("late"), R.count_where(d).alias("closed"),
                  R.count_where(w).alias("n_won"), R.sum_where(F.col("stake"), o).alias("s"), F.coalesce(R.sum_where(F.col("stake"), w), F.lit(0.0)).alias("g"), F.avg("lead_days").alias("l"))
    return a.select("tasks", "open", "late", "closed", F.round("s", 2).alias("at_stake"), F.round("g", 2).alias("won_amount"), F.round(R.pct(F.col("n_won"), F.col("closed")), 6).alias("success_pct"), F.round("l", 6).alias("mean_lead_days"))


def loop_rollups(tasks: DataFrame) -> DataFrame:
    """By result, by month won and by origin, stacked."""
    t = F.col("stake")
    done, won = F.col("status") == "closed", F.col("result") == "won"

    def g(df, axis, label):
        return df.groupBy(F.lit(axis).alias("axis"), label.alias("label")).agg(F.count(F.lit(1)).alias("tasks"), R.count_where(done).alias("closed"), R.count_where(won).alias("won"),
                                                                              F.round(F.coalesce(R.sum_where(t, won), F.lit(0.0)), 2).alias("won_amount"))
    return (g(tasks.filter(done), "result", F.coalesce("result", F.lit("other"))).unionByName(g(tasks.filter(won), "month", R.month_key(F.col("closed"))))
            .unionByName(g(tasks, "origin", F.col("category"))))


def task_export(tasks: DataFrame) -> DataFrame:
    """Operational tasks as warehouse rows: derived won flag, amount won and lead time."""
    won = F.coalesce(F.col("result").isin("won", "partial"), F.lit(False))
    return tasks.select("task_id", "customer", "category", "stake", "status", "result", won.cast("int").alias("won_flag"), F.when(won, F.col("stake")).alias("amount_won"),
                        F.col("automatic").cast("int").alias("auto"), F.round(F.greatest("lead_days", F.lit(0.0)), 3).alias("lead_days"), "created", "closed")


def export_summary(exported: DataFrame) -> DataFrame:
    return exported.groupBy("category").agg(F.count(F.lit(1)).alias("tasks"), R.count_where(F.col("status") == "closed").alias("closed"), F.sum("won_flag").alias("won"),
                                            F.round(F.coalesce(F.sum("amount_won"), F.lit(0.0)), 2).alias("won_amount"), F.round(F.avg("lead_days"), 6).alias("mean_lead_days"))


def open_workload(tasks: DataFrame) -> DataFrame:
    return tasks.filter("status = 'open'").groupBy("assignee").agg(F.count(F.lit(1)).alias("load"))


def latest_open_task(tasks: DataFrame) -> DataFrame:
    """Latest open task of each customer alert."""
    return tasks.filter("status = 'open'").groupBy("customer", "category").agg(F.max(F.struct("created", "task_id")).alias("r")).select("customer", "category", "r.task_id", "r.created")
