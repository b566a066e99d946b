"""Overdue receivables, payment scenarios, due-date book and cash forecasts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import average_ranks, scalar

def billed() -> Column:
    return ~F.col("is_credit")


# ---------------------------------------------------------------- overdue

def overdue_receivables(sales: DataFrame, names: DataFrame, months: int = 18, silence_days: int = 90) -> DataFrame:
    """Documents past due over the window, by customer, with silence since the last document issued."""
    due_ref, issue_ref = scalar(sales.agg(F.max("due"))), scalar(sales.agg(F.max("date")))
    due = F.col("due")
    late = sales.filter(billed() & (due < due_ref) & (due >= F.add_months(due_ref, -months)))
    e = late.groupBy("customer").agg(F.sum("ttc").alias("m"), F.count(F.lit(1)).alias("documents"), F.min("due").alias("oldest_due"),
                                     F.coalesce(R.sum_where(F.col("ttc"), due < F.date_sub(due_ref, 90)), F.lit(0.0)).alias("m90")).filter("m > 0")
    act = sales.filter(billed()).groupBy("customer").agg(F.max("date").alias("last_order"))
    n = names.filter(~F.col("customer_name").ilike("%passager%") & ~F.col("customer_name").ilike("%comptant%"))
    silence = F.datediff(issue_ref, "last_order")
    active = silence <= silence_days
    return e.join(n, "customer").join(act, "customer", "left").select(
        "customer", "customer_name", F.round("m", 2).alias("overdue"), F.round("m90", 2).alias("overdue_90"), "documents", "oldest_due",
        F.datediff(due_ref, "oldest_due").alias("age_days"), "last_order", silence.alias("silence_days"),
        F.when(active, "probably_settled").when(F.col("m90") > 0, "check_first").otherwise("to_check").alias("situation"))


def overdue_totals(overdue: DataFrame) -> DataFrame:
    return overdue.groupBy("situation").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("overdue"), 2).alias("amount"))


# Declared payment hypotheses (name, mean lateness in days, share of documents late in percent).
SCENARIOS = (("optimistic", 0, 5.0), ("central", 30, 20.0), ("pessimistic", 75, 35.0))
# end of fixed values


def payment_scenarios(sales: DataFrame, scenarios: Sequence[tuple[str, int, float]] = SCENARIOS, as_of: Column | None = None) -> DataFrame:
    """Simulated collection delay and outstanding amount per hypothesis; one pass over the documents."""
    ref = as_of if as_of is not None else scalar(sales.agg(F.max("date")))
    due, t = F.col("due"), F.col("ttc")
    aggs = [F.avg("delay_days").alias("granted"), R.sum_where(t, due > ref).alias("not_due")]
    for i, (_, late, _s) in enumerate(scenarios):
        hit = (due > F.date_sub(ref, late)) & (due <= ref)
        aggs += [F.coalesce(R.sum_where(t, hit), F.lit(0.0)).alias(f"a{i}"), R.count_where(hit).alias(f"n{i}")]
    one = sales.filter(due.isNotNull()).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(late).alias("late_days"), F.lit(share).alias("late_share_pct"),
                              F.col(f"a{i}").alias("a"), F.col(f"n{i}").alias("n")) for i, (n, late, share) in enumerate(scenarios)])
    x = one.select("granted", "not_due", F.explode(rows).alias("s")).select("granted", "not_due", "s.*")
    extra, w = F.col("late_days") * F.col("late_share_pct") / 100.0, Window.partitionBy()      # one row per scenario
    out = x.withColumns({"dso": F.col("granted") + extra, "outstanding": F.col("a") * F.col("late_share_pct") / 100.0})
    return out.select("scenario", "late_days", "late_share_pct", F.round("granted", 6).alias("granted_delay"), F.round("dso", 6).alias("simulated_dso"),
                      F.round(extra, 6).alias("extra_days"), F.round("outstanding", 4).alias("outstanding"),
                      F.round(F.col("n") * F.col("late_share_pct") / 100.0).cast("long").alias("documents"), F.round("not_due", 2).alias("not_due"),
                      F.round(F.max("dso").over(w) - F.min("dso").over(w), 6).alias("dso_range"))


# ---------------------------------------------------------------- due-date book

def due_book(sales: DataFrame, years=(2016, 2035)) -> DataFrame:
    """(issue month, due month) cells: at most months squared rows, whatever the volume."""
    d, e = F.col("date"), F.col("due")
    ok = sales.filter(billed() & d.isNotNull() & e.isNotNull() & F.year(e).between(*years) & (e >= d))
    return ok.groupBy(R.month_index(d).alias("issue"), R.month_index(e).alias("due_m")).agg(F.sum("ttc").alias("amount"), F.count(F.lit(1)).alias("documents"))


def maturity(book: DataFrame, horizons: Sequence[int] = (1, 2)) -> DataFrame:
    """Per horizon and origin: amount already booked for origin + h, its final total and their ratio."""
    months = book.agg(F.min("due_m").alias("lo"), F.max("issue").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("origin"))
    grid = months.withColumn("h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("due_m", F.col("origin") + F.col("h"))
    total = book.groupBy("due_m").agg(F.sum("amount").alias("total"))
    cell = grid.join(book, "due_m", "left").groupBy("h", "origin", "due_m").agg(
        F.coalesce(R.sum_where(F.col("amount"), F.col("issue") <= F.col("origin")), F.lit(0.0)).alias("booked"))
    j = cell.join(total, "due_m", "left")
    return j.withColumn("rate", F.when(F.col("total") > 0, F.col("booked") / F.col("total")))


def book_forecast(book: DataFrame, horizons: Sequence[int] = (1, 2), threshold: float = 0.5, recent: int = 6) -> DataFrame:
    """Booked amount over median past maturity when high enough, else booked plus median recent remainder."""
    out = None
    for h in horizons:
        m = maturity(book, [h])
        rest = F.when(F.col("total") > 0, F.col("total") - F.col("booked"))
        w = Window.partitionBy("h").orderBy("origin")                             # one row per month
        known, last = w.rowsBetween(Window.unboundedPreceding, -h), w.rowsBetween(-h - recent + 1, -h)
        x = m.withColumn("rest", rest).withColumns({
            "n": F.count("rate").over(known), "med": F.percentile("rate", F.lit(0.5)).over(known), "rem": F.percentile("rest", F.lit(0.5)).over(last)})
        rate = F.when(F.col("n") >= 3, F.col("med"))
        mult = F.coalesce(rate >= threshold, F.lit(False))
        x = x.withColumns({"maturity": rate, "method": F.when(mult, "multiplicative").when(F.col("rem").isNotNull(), "additive"),
                           "forecast": F.when(mult, F.col("booked") / rate).otherwise(F.col("booked") + F.col("rem"))})
        x = x.select("h", "origin", "due_m", "booked", "total", "maturity", "method", "forecast")
        out = x if out is None else out.unionByName(x)
    return out


def naive_rules(book: DataFrame) -> DataFrame:
    """Last, mean of three and median of six positive months known at each origin, plus the monthly series itself."""
    z = book.groupBy("due_m").agg(F.sum("amount").alias("z")).filter("z > 0")
    w = Window.partitionBy(F.lit(0)).orderBy("due_m")                             # one row per month
    return z.select("due_m", "z", F.avg("z").over(w.rowsBetween(-2, 0)).alias("mean_3"),
                    F.percentile("z", F.lit(0.5)).over(w.rowsBetween(-5, 0)).alias("median_6"))


def book_evaluation(book: DataFrame, horizons: Sequence[int] = (1, 2), n_test: int = 12, min_share: float = 0.05) -> DataFrame:
    """Walk-forward errors of the book against naive rules; a horizon too few documents reach is refused."""
    end = scalar(book.agg(F.max("issue"))) - 1
    z = naive_rules(book)
    dense = book.agg(F.min("due_m").alias("lo"), F.max("due_m").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("due_m")).join(z, "due_m", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("due_m").rowsBetween(Window.unboundedPreceding, 0)
    known = dense.select(F.col("due_m").alias("origin"), *[F.last(c, ignorenulls=True).over(w).alias(n) for c, n in (
        ("z", "last_month"), ("mean_3", "mean_3"), ("median_6", "median_6"))])
    season = z.select(F.col("due_m").alias("_s"), F.col("z").alias("seasonal_12"))
    f = book_forecast(book, horizons).filter((F.col("total") > 0) & F.col("forecast").isNotNull() & (F.col("origin") + F.col("h") <= end))
    f = f.filter(F.col("origin") > end - F.col("h") - n_test).join(known, "origin", "left")
    f = f.join(season, F.col("due_m") - 12 == F.col("_s"), "left")
    err = lambda c: F.abs(F.col(c) - F.col("total")) / F.col("total") * 100
    share = book.agg(*[(R.sum_where(F.col("documents"), F.col("due_m") - F.col("issue") >= h) / F.sum("documents")).alias(f"s{h}") for h in horizons])
    shares = share.selectExpr(f"stack({len(horizons)}, " + ", ".join(f"{h}, s{h}" for h in horizons) + ") as (h, share)")
    g = f.groupBy("h").agg(F.count(F.lit(1)).alias("origins"), F.avg(err("forecast")).alias("mape"), F.avg(F.abs(F.col("forecast") - F.col("total"))).alias("mae"),
                           F.sqrt(F.avg((F.col("forecast") - F.col("total")) ** 2)).alias("rmse"),
                           *[F.avg(err(b)).alias(f"{b}_mape") for b in ("last_month", "seasonal_12", "mean_3", "median_6")])
    rules = ("mape", "last_month_mape", "seasonal_12_mape", "mean_3_mape", "median_6_mape")
    j = shares.join(g, "h", "left")
    refused = F.coalesce(F.col("share") < min_share, F.lit(True))
    return j.select("h", F.round("share", 6).alias("share_long_enough"), refused.alias("refused"), F.when(~refused, F.col("origins")).alias("origins"),
                    *[F.round(F.when(~refused, F.col(c)), 6).alias(c) for c in rules], F.round(F.when(~refused, F.col("mae")), 2).alias("mae"),
                    F.round(F.when(~refused, F.col("rmse")), 2).alias("rmse"),
                    F.round(F.when(~refused, F.least(*rules[1:]) - F.col("mape")), 6).alias("gain_points"))


def maturity_dispersion(book: DataFrame, h: int = 1) -> DataFrame:
    return maturity(book, [h]).filter(F.col("rate").isNotNull()).agg(
        F.count(F.lit(1)).alias("origins"), *[F.round(F.percentile("rate", F.lit(p)), 6).alias(n) for p, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))],
        F.round(F.avg("rate"), 6).alias("mean"), F.round(F.stddev_pop("rate"), 6).alias("std"), F.round(F.min("rate"), 6).alias("low"), F.round(F.max("rate"), 6).alias("high"))


def maturity_by_month(book: DataFrame, h: int = 1) -> DataFrame:
    return maturity(book, [h]).filter(F.col("rate").isNotNull()).groupBy((F.col("due_m") % 12 + 1).cast("int").alias("month_no")).agg(
        F.count(F.lit(1)).alias("origins"), F.round(F.percentile("rate", F.lit(0.5)), 6).alias("median_rate"))


def maturity_estimators(book: DataFrame, h: int = 1, warmup: int = 12) -> DataFrame:
    """Walk-forward error of three estimates of the maturity rate: global, same calendar month, last six."""
    m = maturity(book, [h]).filter(F.col("rate").isNotNull()).withColumn("mo", F.col("due_m") % 12)
    w, s = Window.partitionBy("h").orderBy("origin"), Window.partitionBy("h", "mo").orderBy("origin")
    med = lambda win: F.percentile("rate", F.lit(0.5)).over(win)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    same = s.rowsBetween(Window.unboundedPreceding, -1)
    x = m.withColumns({"i": F.row_number().over(w), "g": med(past), "six": med(w.rowsBetween(-6, -1)),
                       "same": F.when(F.count("rate").over(same) >= 2, med(same))})
    e = lambda c: F.round(F.avg(F.abs(c - F.col("rate"))), 6)
    return x.filter(F.col("i") > warmup).agg(e(F.col("g")).alias("global_error"), e(F.coalesce("same", "g")).alias("same_month_error"), e(F.col("six")).alias("last_six_error"))


def maturity_correlation(book: DataFrame, h: int = 1) -> DataFrame:
    """Spearman correlation of the maturity rate with the recent level."""
    z = book.groupBy("due_m").agg(F.sum("amount").alias("z"))
    w = Window.partitionBy(F.lit(0)).orderBy("due_m").rangeBetween(-2, 0)
    level = z.select(F.col("due_m").alias("origin"), F.avg(F.when(F.col("z") > 0, F.col("z"))).over(w).alias("level"))
    m = maturity(book, [h]).filter(F.col("rate").isNotNull()).withColumn("rate", F.round("rate", 9)).join(level, "origin").filter("level is not null")
    a = average_ranks(m, "rate").withColumnRenamed("avg_rank", "ra")
    b = average_ranks(m, "level").withColumnRenamed("avg_rank", "rb")
    return m.join(a, "rate").join(b, "level").agg(F.round(F.corr("ra", "rb"), 6).alias("spearman_level"))


def delay_in_months(book: DataFrame) -> DataFrame:
    g = book.groupBy((F.col("due_m") - F.col("issue")).alias("months")).agg(F.sum("documents").alias("documents"))
    w = Window.partitionBy()                                                     # one row per delay in months
    share = R.pct(F.col("documents"), F.sum("documents").over(w))
    run = Window.orderBy("months").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("months", "documents", F.round(share, 6).alias("share_pct"),
                    F.round(R.pct(F.sum("documents").over(run), F.sum("documents").over(w)), 6).alias("cumulative_pct"))


def month_composition(book: DataFrame) -> DataFrame:
    """Issue months behind each due month."""
    return book.select("due_m", "issue", (F.col("due_m") - F.col("issue")).alias("delay_months"), "documents", F.round("amount", 2).alias("amount"))


def start_period_effect(book: DataFrame, starts: Sequence[int], h: int = 1) -> DataFrame:
    """Median maturity when only origins from a given month on are used."""
    m = maturity(book, [h]).filter(F.col("rate").isNotNull()).withColumn("start", F.explode(F.array(*[F.lit(s) for s in starts])))
    return m.filter("origin >= start").groupBy("start").agg(F.count(F.lit(1)).alias("origins"), F.round(F.percentile("rate", F.lit(0.5)), 6).alias("median_rate"))


# ---------------------------------------------------------------- monthly series and projections

def clean_series(monthly: DataFrame, keys: Sequence[str] = (), long_gap: int = 3, min_len: int = 24, tail_share: float = 0.4) -> DataFrame:
    """Monthly series (keys, m, amount, n) cut before its last long hole, short holes interpolated, truncated tail dropped.

    Every window is partitioned by series and holds one row per month.
    """
    keys = list(keys) or ["_all"]
    base = monthly if "_all" not in keys else monthly.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("m")
    prev = F.lag("m").over(w)
    start = F.max(F.when(F.col("m") - prev > long_gap, F.col("m"))).over(Window.partitionBy(*keys))
    cut = base.withColumn("_start", start).filter(F.col("_start").isNull() | (F.col("m") >= F.col("_start"))).drop("_start")
    med = cut.filter("n > 0").groupBy(*keys).agg(F.median("n").alias("_med"), F.min("m").alias("_lo"), F.max("m").alias("_hi"))
    grid = med.select(*keys, "_med", "_lo", F.explode(F.sequence("_lo", "_hi")).alias("m"))
    full = grid.join(cut, [*keys, "m"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    has = F.when(F.col("amount").isNotNull(), F.col("m"))
    x = full.withColumns({"pm": F.last(has, True).over(back), "pv": F.last("amount", True).over(back),
                          "nm": F.first(has, True).over(ahead), "nv": F.first("amount", True).over(ahead)})
    filled = F.coalesce("amount", F.col("pv") + (F.col("nv") - F.col("pv")) * (F.col("m") - F.col("pm")) / (F.col("nm") - F.col("pm")))
    x = x.withColumn("value", filled)
    last_ok = F.max(F.when(F.col("n") >= tail_share * F.col("_med"), F.col("m"))).over(Window.partitionBy(*keys))
    x = x.withColumn("_keep", F.greatest(F.coalesce(last_ok, F.col("_lo")), F.col("_lo") + min_len - 1)).filter("m <= _keep")
    return x.select(*[k for k in keys if k != "_all"], "m", "value", F.col("amount").isNull().alias("interpolated"))


def damped_seasonal_forecast(series: DataFrame, key: str, horizon: int = 6, window: int = 30, season: int = 12, damping: float = 0.85) -> DataFrame:
    """Damped-trend seasonal projection with bands, for every series at once.

    Works on standardised log1p values: trend by regression on the last `window` months, additive
    seasonal means of the detrended values, damped slope ahead.
    """
    k = Window.partitionBy(key)
    logs = series.select(key, "m", F.log1p(F.greatest("value", F.lit(0.0))).alias("g"))
    z = logs.withColumns({"mu": F.avg("g").over(k), "sd": F.stddev_pop("g").over(k), "rn": F.row_number().over(k.orderBy(F.col("m").desc()))})
    z = z.withColumn("sd", F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).withColumn("z", (F.col("g") - F.col("mu")) / F.col("sd")).filter(F.col("rn") <= window)
    z = z.withColumn("x", F.row_number().over(k.orderBy("m")) - 1)
    fit = z.groupBy(key).agg(F.regr_slope("z", "x").alias("a"), F.regr_intercept("z", "x").alias("b"), F.count(F.lit(1)).alias("w"),
                             F.max("m").alias("last"), F.max("mu").alias("mu"), F.max("sd").alias("sd"))
    d = z.select(key, "x", "z").join(fit, key).withColumns({"s": F.col("x") % season, "det": F.col("z") - (F.col("a") * F.col("x") + F.col("b"))})
    raw = d.groupBy(key, "s").agg(F.when(F.max("w") >= season, F.avg("det")).otherwise(0.0).alias("raw"))
    seas = raw.withColumn("seas", F.when(F.count(F.lit(1)).over(k) >= season, F.col("raw") - F.avg("raw").over(k)).otherwise(F.lit(0.0))).select(key, "s", "seas")
    sigma = d.join(seas, [key, "s"]).groupBy(key).agg(F.least(F.coalesce(F.stddev_pop(F.col("det") - F.col("seas")), F.lit(0.0)), F.lit(0.30)).alias("sigma"))
    ahead = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("s", ((F.col("w") - 1 + F.col("h")) % season).cast("int"))
    damp = damping * (1 - F.pow(F.lit(damping), F.col("h"))) / (1 - damping)
    zh = F.col("a") * (F.col("w") - 1) + F.col("b") + F.col("a") * damp + F.coalesce("seas", F.lit(0.0))
    inv = lambda v: F.expm1(v * F.col("sd") + F.col("mu"))
    p = ahead.join(seas, [key, "s"], "left").join(sigma, key).withColumn("zh", zh).withColumn("c", inv(F.col("zh")))
    lo = F.greatest(F.lit(0.0), F.least(inv(F.col("zh") - 1.96 * F.col("sigma")), 0.6 * F.col("c")))
    hi = F.greatest(F.col("c"), F.least(inv(F.col("zh") + 1.96 * F.col("sigma")), 1.7 * F.col("c")))
    return p.select(key, "h", (F.col("last") + F.col("h")).alias("m"), F.round(F.greatest(F.lit(0.0), F.col("c")), 2).alias("forecast"),
                    F.round(lo, 2).alias("lower"), F.round(hi, 2).alias("upper"))


def linear_projection(monthly: DataFrame, key: str, horizon: int = 3, points: int = 12) -> DataFrame:
    """Least squares on the last twelve months of each series, never below zero."""
    k = Window.partitionBy(key)
    x = monthly.withColumn("rn", F.row_number().over(k.orderBy(F.col("m").desc()))).filter(F.col("rn") <= points)
    x = x.withColumn("x", F.row_number().over(k.orderBy("m")) - 1)
    fit = x.groupBy(key).agg(F.regr_slope("value", "x").alias("a"), F.regr_intercept("value", "x").alias("b"), F.count(F.lit(1)).alias("n"), F.max("m").alias("last")).filter("n >= 3")
    return fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        key, "h", (F.col("last") + F.col("h")).alias("m"), F.greatest(F.lit(0.0), F.col("a") * (F.col("n") - 1 + F.col("h")) + F.col("b")).alias("forecast"))


# ---------------------------------------------------------------- imported invoices

def imported_schedule(imported: DataFrame, sale_delays: DataFrame, purchase_delays: DataFrame, as_of: date, default_days: int = 30) -> DataFrame:
    """Due date read, else the party's median delay, else the side's, else thirty days.

    `*_delays` hold (party, delay_days); delays outside 0..365 are ignored.
    """
    open_ = imported.filter(F.col("settled").isNull() & ~F.coalesce("recon_status", F.lit("unmatched")).isin("matched", "probable_duplicate"))

    def medians(df, side):
        h = df.filter(F.col("delay_days").between(0, 365)).groupBy("party", "delay_days").agg(F.count(F.lit(1)).alias("n"))
        per = h.groupBy("party").agg(F.round(F.percentile("delay_days", F.lit(0.5), F.col("n"))).cast("int").alias("party_days"))
        glob = scalar(h.groupBy("delay_days").agg(F.sum("n").alias("n")).agg(F.round(F.percentile("delay_days", F.lit(0.5), F.col("n"))).cast("int")))
        return per.withColumn("side", F.lit(side)), glob
    s, gs = medians(sale_delays, "sale")
    p, gp = medians(purchase_delays, "purchase")
    x = open_.join(s.unionByName(p), ["party", "side"], "left")
    days = F.coalesce("party_days", F.nullif(F.when(F.col("side") == "sale", gs).otherwise(gp), F.lit(0)), F.lit(default_days))
    today = F.lit(as_of)
    due = F.coalesce("due", F.date_add(F.coalesce("date", today), days))
    src = F.concat(F.when(F.col("party_days").isNotNull(), "party_delay").otherwise("mean_delay"), F.when(F.col("date").isNull(), "_undated").otherwise(""))
    x = x.withColumns({"due_used": due, "source": F.when(F.col("due").isNotNull(), "read").otherwise(src)})
    return x.select("id", "side", "party", F.col("due_used").alias("due"), "source", F.round(F.coalesce("net", "ttc", F.lit(0.0)), 3).alias("amount"),
                    F.when(F.col("due_used") < today, "late").otherwise("upcoming").alias("status"), F.greatest(F.lit(0), F.datediff(today, "due_used")).alias("days_late"))


def schedule_by_month(schedule: DataFrame) -> DataFrame:
    a, out = F.col("amount"), F.col("side") == "purchase"
    g = schedule.groupBy(F.when(F.col("status") == "late", "late").otherwise(R.month_key(F.col("due"))).alias("period")).agg(
        F.coalesce(R.sum_where(a, out), F.lit(0.0)).alias("o"), F.coalesce(R.sum_where(a, ~out), F.lit(0.0)).alias("i"), F.count(F.lit(1)).alias("documents"),
        R.count_where(F.col("source") != "read").alias("deduced"))
    return g.select("period", F.round("i", 2).alias("cash_in"), F.round("o", 2).alias("cash_out"), F.round(F.col("i") - F.col("o"), 2).alias("balance"), "documents", "deduced")
