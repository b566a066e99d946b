"""Point-in-time feature panels.

Facts are first reduced to (entity, day) or (entity, month), with map-side combine, so every window
partition is bounded by the calendar whatever the volume of one entity. Features look back, targets
look forward, and both are frames of the same sorted partition: no row-by-row range join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar

EPS = 1e-6
PAST = Window.unboundedPreceding


def _day(col) -> Column:
    return F.datediff(col, F.lit("1970-01-01").cast("date"))


def month_grid(keys: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Every month between two bounds for each entity (one row per entity in, months out)."""
    return keys.withColumns({"_lo": lo, "_hi": hi}).withColumn("month", F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 month")))).drop("_lo", "_hi")


def roll(col: Column, w, n: int, fn=F.sum) -> Column:
    return fn(col).over(w.rowsBetween(-(n - 1), 0))


def rolling_std(col: Column, w, n: int, min_obs: int = 3) -> Column:
    """Sample deviation of the last n rows, zero under `min_obs` observations."""
    win = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col).over(win) >= min_obs, F.stddev_samp(col).over(win)).otherwise(F.lit(0.0))


def future(col: Column, w, h: int, fn=F.sum) -> Column:
    """Aggregate of the next h rows, NULL unless all of them are observed."""
    win = w.rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(win) == h, fn(col).over(win))


def since_last(flag: Column, rank: Column, w) -> Column:
    """Rows since the flag was last true; the rank itself when it never was."""
    last = F.last(F.when(flag, rank), ignorenulls=True).over(w.rowsBetween(PAST, 0))
    return F.coalesce(rank - last, rank)


# ---------------------------------------------------------------- churn

def customer_days(sales: DataFrame) -> DataFrame:
    return sales.filter(~F.col("is_credit")).groupBy("customer", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("ttc").alias("ttc"))


def churn_panel(days: DataFrame, start, horizon: int = 90, active_days: int = 365, min_days: int = 2, last_n: int = 20,
                for_scoring: bool = False) -> DataFrame:
    """Customer x month-end: 16 backward features and "no order within the horizon".

    With `for_scoring`, the single observation date is the last day of data and there is no target.
    """
    d = days.filter(F.col("date") >= F.lit(start)).withColumn("day", _day(F.col("date")))
    end = scalar(d.agg(F.max("date")))
    own = Window.partitionBy("customer").orderBy("day")
    tail = own.rowsBetween(-(last_n - 1), 0)
    ev = d.withColumn("gap", F.col("day") - F.lag("day").over(own)).withColumns({
        "gap_mean": F.avg("gap").over(tail), "gap_std": F.stddev_pop("gap").over(tail), "basket": F.avg("ttc").over(tail)})
    ev = ev.select("customer", "day", F.lit(0).alias("obs"), "ttc", F.col("day").alias("ev_day"), "gap_mean", "gap_std", "basket")
    who = d.groupBy("customer").agg(F.lit(1).alias("_")).drop("_")
    if for_scoring:
        grid = who.withColumn("t", end)
    else:
        first = F.add_months(F.trunc(F.date_add(F.lit(start).cast("date"), active_days), "month"), 0)
        months = F.sequence(first, F.trunc(F.date_sub(end, horizon), "month"), F.expr("interval 1 month"))
        grid = who.withColumn("_m", F.explode(months)).select("customer", F.last_day("_m").alias("t")).filter(F.col("t") <= F.date_sub(end, horizon))
    null = lambda n, t: F.lit(None).cast(t).alias(n)
    obs = grid.select("customer", _day(F.col("t")).alias("day"), F.lit(1).alias("obs"), null("ttc", "double"), null("ev_day", "int"),
                      null("gap_mean", "double"), null("gap_std", "double"), null("basket", "double"))
    u = ev.unionByName(obs)
    upto = Window.partitionBy("customer").orderBy("day", "obs").rowsBetween(PAST, 0)
    rng = Window.partitionBy("customer").orderBy("day")
    back = lambda a, b=0: rng.rangeBetween(-a + 1, -b)
    n_in = lambda w: F.count("ev_day").over(w)
    s_in = lambda w: F.coalesce(F.sum("ttc").over(w), F.lit(0.0))
    x = u.withColumns({
        "last": F.max("ev_day").over(upto), "first": F.min("ev_day").over(upto), "g": F.last("gap_mean", True).over(upto),
        "s": F.last("gap_std", True).over(upto), "b": F.last("basket", True).over(upto), "freq_3m": n_in(back(90)), "freq_6m": n_in(back(180)),
        "freq_12m": n_in(back(360)), "rev_3m": s_in(back(90)), "rev_6m": s_in(back(180)), "rev_12m": s_in(back(360)), "n_prev": n_in(back(180, 90)),
        "r_prev": s_in(back(180, 90)), "n_active": n_in(back(active_days)), "n_next": n_in(rng.rangeBetween(1, horizon))})
    x = x.filter((F.col("obs") == 1) & F.col("last").isNotNull() & (F.col("n_active") >= min_days))
    clip = lambda num, den: F.when(den > 0, F.least(F.greatest(num / den, F.lit(0.0)), F.lit(10.0))).when(num > 0, 2.0).otherwise(0.0)
    gap = F.coalesce("g", F.lit(float(active_days)))
    rec = (F.col("day") - F.col("last")).cast("double")
    t = F.date_add(F.lit("1970-01-01").cast("date"), F.col("day"))
    cols = ["customer", t.alias("obs_date"), rec.alias("recency_days"), (F.col("day") - F.col("first")).cast("double").alias("age_days"),
            *[F.col(f"freq_{k}m").cast("double").alias(f"freq_{k}m") for k in (3, 6, 12)], "rev_3m", "rev_6m", "rev_12m",
            F.log1p(F.greatest("rev_12m", F.lit(0.0))).alias("log_rev_12m"), clip(F.col("rev_3m"), F.col("r_prev")).alias("revenue_trend"),
            clip(F.col("freq_3m"), F.col("n_prev")).alias("frequency_trend"), gap.alias("gap_mean"), F.coalesce("s", F.lit(0.0)).alias("gap_std"),
            F.when(gap > 0, rec / gap).otherwise(0.0).alias("recency_gap_ratio"), F.col("b").alias("mean_basket"), F.month(t).cast("double").alias("month_no")]
    return x.select(*cols) if for_scoring else x.select(*cols, (F.col("n_next") == 0).cast("int").alias("y"))


CHURN_FEATURES = ["recency_days", "age_days", "freq_3m", "freq_6m", "freq_12m", "rev_3m", "rev_6m", "rev_12m", "log_rev_12m", "revenue_trend",
                  "frequency_trend", "gap_mean", "gap_std", "recency_gap_ratio", "mean_basket", "month_no"]


# ---------------------------------------------------------------- customer x month

def customer_months(lines: DataFrame) -> DataFrame:
    """Amounts, cost and category mix per customer and month."""
    a, cat = F.col("amount"), R.business_category(F.col("family"))
    fine = lines.filter(a.isNotNull()).groupBy("customer", F.trunc("date", "month").alias("month"), cat.alias("cat")).agg(
        F.sum(a).alias("a"), F.sum("cost").alias("k"), F.count(F.lit(1)).alias("n"), F.sum(F.abs(a)).alias("b"))
    of = lambda c: F.coalesce(R.sum_where(F.col("b"), F.col("cat") == c), F.lit(0.0))
    return fine.groupBy("customer", "month").agg(
        F.sum("a").alias("amount"), F.sum("k").alias("cost"), F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_families"),
        of("equipment").alias("m_equipment"), of("reagent").alias("m_reagent"), of("service").alias("m_service"), F.sum("b").alias("m_abs"))


def monthly_delays(sales: DataFrame) -> DataFrame:
    h = sales.filter(~F.col("is_credit") & F.col("delay_days").isNotNull()).groupBy(
        "customer", F.trunc("date", "month").alias("month"), "delay_days").agg(F.count(F.lit(1)).alias("n"))
    return h.groupBy("customer", "month").agg(F.percentile("delay_days", F.lit(0.5), F.col("n")).alias("median_delay"))


def _dense_customers(monthly: DataFrame, delays: DataFrame) -> DataFrame:
    lo, hi = scalar(monthly.agg(F.min("month"))), scalar(monthly.agg(F.max("month")))
    who = monthly.groupBy("customer").agg(F.lit(1).alias("_")).drop("_")
    g = month_grid(who, lo, hi).join(monthly, ["customer", "month"], "left").join(delays, ["customer", "month"], "left")
    return g.fillna(0.0, ["amount", "cost", "m_equipment", "m_reagent", "m_service", "m_abs"]).fillna(0, ["n_lines", "n_families"])


def _share(num: Column, den: Column) -> Column:
    return F.when(den > EPS, num / den * 100.0).otherwise(0.0)


def margin_panel(monthly: DataFrame, delays: DataFrame, horizon: int = 3, min_lines: int = 3, min_months: int = 12, for_scoring: bool = False) -> DataFrame:
    """Customer x month: 18 margin, mix and activity features and the future margin rate."""
    w = Window.partitionBy("customer").orderBy("month")
    c, d = F.col, _dense_customers(monthly, delays)
    d = d.withColumns({"rank": F.row_number().over(w), "active": F.abs("amount") > EPS})
    rate = lambda n: F.when(F.abs(roll(c("amount"), w, n)) > EPS, (roll(c("amount"), w, n) - roll(c("cost"), w, n)) / roll(c("amount"), w, n) * 100.0).otherwise(0.0)
    d = d.withColumns({f"margin_{n}m_pct": rate(n) for n in (3, 6, 12)})
    r12, n12 = roll(c("amount"), w, 12), roll(c("n_lines"), w, 12)
    d = d.withColumns({
        "margin_trend": c("margin_3m_pct") - c("margin_12m_pct"), "margin_volatility": rolling_std(c("margin_3m_pct"), w, 12),
        **{f"share_{k}_3m": _share(roll(c(f"m_{k}"), w, 3), roll(c("m_abs"), w, 3)) for k in ("equipment", "reagent", "service")},
        "eq12": _share(roll(c("m_equipment"), w, 12), roll(c("m_abs"), w, 12)), "n_families_3m": roll(c("n_families"), w, 3, F.max),
        "log_rev_12m": F.log1p(F.greatest(r12, F.lit(0.0))), "n_lines_12m": n12, "mean_basket": F.when(n12 > 0, r12 / n12).otherwise(0.0),
        "recency_days": since_last(c("active"), c("rank"), w) * 30.0, "revenue_trend": roll(c("amount"), w, 3) / (r12 / 4.0 + EPS),
        "median_delay_ff": F.coalesce(F.last("median_delay", True).over(w.rowsBetween(PAST, 0)), F.lit(0.0)),
        "month_no": F.month("month").cast("double"), "fa": future(c("amount"), w, horizon), "fc": future(c("cost"), w, horizon)})
    d = d.withColumns({"equipment_shift": c("share_equipment_3m") - c("eq12"), "age_months": c("rank").cast("double"),
                       "future_margin_pct": F.when(F.abs("fa") > EPS, (c("fa") - c("fc")) / c("fa") * 100.0)})
    d = d.filter((c("n_lines_12m") >= min_lines) & (c("rank") >= min_months) & c("active"))
    keep = d if for_scoring else d.filter(c("future_margin_pct").isNotNull())
    return keep.select("customer", "month", *MARGIN_FEATURES, "future_margin_pct")


MARGIN_FEATURES = ["margin_3m_pct", "margin_6m_pct", "margin_12m_pct", "margin_trend", "margin_volatility", "share_equipment_3m", "share_reagent_3m",
                   "share_service_3m", "equipment_shift", "n_families_3m", "log_rev_12m", "n_lines_12m", "mean_basket", "recency_days", "age_months",
                   "revenue_trend", "median_delay_ff", "month_no"]


def revenue_panel(monthly: DataFrame, delays: DataFrame, horizon: int = 3, min_lines: int = 3, min_months: int = 12, for_scoring: bool = False) -> DataFrame:
    """Customer x month: 17 features and the revenue of the next `horizon` months."""
    w = Window.partitionBy("customer").orderBy("month")
    c, d = F.col, _dense_customers(monthly, delays)
    d = d.withColumns({"rank": F.row_number().over(w), "active": F.abs("amount") > EPS, "pos": F.greatest("amount", F.lit(0.0))})
    d = d.withColumns({f"rev_{n}m": roll(c("pos"), w, n) for n in (1, 3, 6, 12)})
    prev = F.lag("rev_12m", 12).over(w)
    n12 = roll(c("n_lines"), w, 12)
    d = d.withColumns({
        **{f"log_rev_{n}m": F.log1p(f"rev_{n}m") for n in (1, 3, 6, 12)}, "n_lines_3m": roll(c("n_lines"), w, 3), "n_lines_12m": n12,
        "mean_basket": F.when(n12 > 0, c("rev_12m") / n12).otherwise(0.0), "revenue_trend": c("rev_3m") / (c("rev_12m") / 4.0 + EPS),
        "annual_growth": F.least(F.greatest(F.coalesce(F.when(prev > EPS, c("rev_12m") / prev), F.lit(1.0)), F.lit(0.0)), F.lit(10.0)),
        "revenue_volatility": rolling_std(c("pos"), w, 12), "active_months_12m": roll(c("active").cast("int"), w, 12).cast("double"),
        "recency_days": since_last(c("active"), c("rank"), w) * 30.0, "age_months": c("rank").cast("double"), "n_families_3m": roll(c("n_families"), w, 3, F.max),
        "share_equipment_3m": _share(roll(c("m_equipment"), w, 3), roll(c("m_abs"), w, 3)),
        "median_delay_ff": F.coalesce(F.last("median_delay", True).over(w.rowsBetween(PAST, 0)), F.lit(0.0)),
        "month_no": F.month("month").cast("double"), "future_revenue": future(c("pos"), w, horizon)})
    d = d.filter((c("n_lines_12m") >= min_lines) & (c("rank") >= min_months) & c("active"))
    keep = d if for_scoring else d.filter(c("future_revenue").isNotNull())
    return keep.select("customer", "month", *REVENUE_FEATURES, "rev_1m", "rev_3m", "rev_12m", "future_revenue")


REVENUE_FEATURES = ["log_rev_1m", "log_rev_3m", "log_rev_6m", "log_rev_12m", "n_lines_3m", "n_lines_12m", "mean_basket", "revenue_trend", "annual_growth",
                    "revenue_volatility", "active_months_12m", "recency_days", "age_months", "n_families_3m", "share_equipment_3m", "median_delay_ff", "month_no"]


# ---------------------------------------------------------------- quotes

def quote_panel(quotes: DataFrame, sales: DataFrame, lines: DataFrame, maturation: int = 6, for_scoring: bool = False) -> DataFrame:
    """One row per quote, 19 features from strictly earlier days; the last months are right-censored and dropped.

    Invoices, granted delays, monthly margins and quotes are reduced to (customer, day) and stacked; every
    history is then a range frame ending the day before.
    """
    c = F.col
    q = quotes.filter("ht > 0").withColumn("day", _day(c("date")))
    kinds = {"q_n": "bigint", "q_conv": "bigint", "q_ht": "double", "i_n": "bigint", "i_ttc": "double", "delay": "int", "delay_n": "bigint",
             "m_amount": "double", "m_cost": "double"}

    def part(df, **vals):
        return df.select("customer", "day", *[vals.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])
    qd = q.groupBy("customer", "day").agg(F.count(F.lit(1)).alias("n"), R.count_where(c("converted")).alias("v"), F.sum("ht").alias("h"))
    inv = sales.filter(~c("is_credit")).withColumn("day", _day(c("date")))
    ivd = inv.groupBy("customer", "day").agg(F.count(F.lit(1)).alias("n"), F.sum("ttc").alias("t"))
    dl = inv.filter(c("delay_days").isNotNull()).groupBy("customer", "day", "delay_days").agg(F.count(F.lit(1)).alias("n"))
    mg = lines.groupBy("customer", _day(F.trunc("date", "month")).alias("day")).agg(F.sum("amount").alias("a"), F.sum("cost").alias("k"))
    u = reduce(DataFrame.unionByName, [part(qd, q_n=c("n"), q_conv=c("v"), q_ht=c("h")), part(ivd, i_n=c("n"), i_ttc=c("t")),
                                       part(dl, delay=c("delay_days"), delay_n=c("n")), part(mg, m_amount=c("a"), m_cost=c("k"))])
    own = Window.partitionBy("customer").orderBy("day")
    past, year = own.rangeBetween(PAST, -1), own.rangeBetween(-365, -1)
    mon = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), c("day")), "yyyy-MM")
    u = u.withColumn("mon", mon)
    month = Window.partitionBy("customer", "mon").orderBy("day").rangeBetween(PAST, -1)
    s = lambda x, w: F.sum(x).over(w)
    inv_day = F.when(c("i_n").isNotNull(), c("day"))
    h = u.withColumns({
        "first": F.min(inv_day).over(past), "last": F.max(inv_day).over(past), "n_inv": s("i_n", past), "t_inv": s("i_ttc", past), "n_12": s("i_n", year),
        "t_12": s("i_ttc", year), "delay_med": F.percentile("delay", F.lit(0.5), F.coalesce("delay_n", F.lit(0))).over(past), "ma": s("m_amount", past),
        "mc": s("m_cost", past), "qn": s("q_n", past), "qv": s("q_conv", past), "qh": s("q_ht", past), "q12": s("q_n", year), "qm": s("q_n", month)})
    h = h.filter(c("q_n").isNotNull()).drop(*kinds, "mon")
    x = q.join(h, ["customer", "day"])
    z = lambda col: F.coalesce(col, F.lit(0.0)).cast("double")
    basket, r12 = z(c("t_inv") / c("n_inv")), z(c("t_12"))
    usual = z(c("qh") / c("qn"))
    dt = c("date")
    out = x.select(
        "customer", "quote_no", "date", c("converted").cast("int").alias("y"), F.log1p(F.greatest("ht", F.lit(0.0))).alias("log_ht"),
        F.month(dt).cast("double").alias("month_no"), F.quarter(dt).cast("double").alias("quarter"), F.weekday(dt).cast("double").alias("weekday"),
        z(c("qm")).alias("earlier_quotes_month"), F.when(c("n_inv") > 0, 1.0).otherwise(0.0).alias("is_customer"), z(c("day") - c("first")).alias("age_days"),
        z(c("n_12")).alias("invoices_12m"), F.log1p(F.greatest(r12, F.lit(0.0))).alias("log_rev_12m"), z(c("day") - c("last")).alias("recency_days"),
        basket.alias("mean_basket"), F.when(c("ma") > 0, (c("ma") - c("mc")) / c("ma") * 100).otherwise(0.0).alias("margin_pct"), z(c("delay_med")).alias("median_delay"),
        z(c("q12")).alias("quotes_12m"), F.coalesce(c("qv") / c("qn"), F.lit(-1.0)).alias("past_conversion"), F.log1p(F.greatest(usual, F.lit(0.0))).alias("log_usual_quote"),
        (c("ht") / (usual + EPS)).alias("ratio_usual"), (c("ht") / (basket + EPS)).alias("ratio_basket"), (c("ht") / (r12 + EPS)).alias("ratio_rev_12m"), "ht")
    if for_scoring:
        return out
    return out.filter(c("date") <= F.add_months(scalar(quotes.agg(F.max("date"))), -maturation))


QUOTE_FEATURES = ["log_ht", "month_no", "quarter", "weekday", "earlier_quotes_month", "is_customer", "age_days", "invoices_12m", "log_rev_12m", "recency_days",
                  "mean_basket", "margin_pct", "median_delay", "quotes_12m", "past_conversion", "log_usual_quote", "ratio_usual", "ratio_basket", "ratio_rev_12m"]


def quote_maturation(quotes: DataFrame, maturation: int = 6, min_n: int = 5) -> DataFrame:
    """Conversion by issue month, with the censored months flagged."""
    m = quotes.groupBy(F.trunc("date", "month").alias("month")).agg(F.count(F.lit(1)).alias("n"), R.count_where(F.col("converted")).alias("v")).filter(F.col("n") >= min_n)
    last = F.max("month").over(Window.partitionBy())                              # one row per month
    return m.select("month", "n", F.round(R.pct(F.col("v"), F.col("n")), 6).alias("rate_pct"), (F.col("month") > F.add_months(last, -maturation)).alias("censored"))


def conversion_by_band(quotes: DataFrame, maturation: int = 6) -> DataFrame:
    """Observed conversion by amount band on matured quotes; recent ones are counted apart."""
    h = F.col("ht")
    recent = F.col("date") > F.add_months(scalar(quotes.agg(F.max("date"))), -maturation)
    band = (F.when(recent, "too recent").when(h < 5000, "under 5K").when(h < 20000, "5-20K").when(h < 100000, "20-100K").otherwise("over 100K"))
    return quotes.filter("ht > 0").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), R.count_where(F.col("converted")).alias("v"), F.sum("ht").alias("a")).select(
        "band", "n", F.when(F.col("band") != "too recent", F.col("v")).alias("signed"),
        F.when(F.col("band") != "too recent", F.round(R.pct(F.col("v"), F.col("n")), 6)).alias("rate_pct"), F.round("a", 2).alias("amount"))


# ---------------------------------------------------------------- credit terms

def credit_panel(sales: DataFrame, threshold: int = 60) -> DataFrame:
    """Invoices with calendar features and the customer's earlier granted delays (strictly earlier days)."""
    c = F.col
    s = sales.filter(~c("is_credit") & c("delay_days").isNotNull()).withColumn("day", _day(c("date")))
    h = s.groupBy("customer", "day", "delay_days").agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("customer").orderBy("day").rangeBetween(PAST, -1)
    f = h.withColumns({"prior_n": F.coalesce(F.sum("n").over(past), F.lit(0)), "ps": F.sum(c("n") * c("delay_days")).over(past),
                       "prior_median": F.percentile("delay_days", F.lit(0.5), c("n")).over(past)})
    f = f.groupBy("customer", "day").agg(F.max("prior_n").alias("prior_n"), F.max("ps").alias("ps"), F.max("prior_median").alias("prior_median"))
    d = c("date")
    return s.join(f, ["customer", "day"]).select(
        "customer", "ent_id", "date", "delay_days", (c("delay_days") > threshold).cast("int").alias("y"), F.month(d).alias("month_no"), F.quarter(d).alias("quarter"),
        F.weekday(d).alias("weekday"), "year", F.log1p(F.greatest("ttc", F.lit(0.0))).alias("log_ttc"), "ttc", "mode", "prior_n", "prior_median",
        (c("ps") / c("prior_n")).alias("prior_mean"))


# ---------------------------------------------------------------- product x month

def replenishment_panel(positions: DataFrame, horizon: int = 3, min_months: int = 12, for_scoring: bool = False) -> DataFrame:
    """Product x month: 20 features and "bought within three months"."""
    c, w = F.col, Window.partitionBy("key").orderBy("month")
    run = w.rowsBetween(PAST, 0)
    d = positions.withColumns({"rank": F.row_number().over(w), "buy": c("qty_in") > 0, "out": c("qty_out")})
    d = d.withColumns({"use_1m": c("out"), **{f"use_{n}m": roll(c("out"), w, n, F.avg) for n in (3, 6, 12)},
                       "active_share_12m": roll((c("out") > 0).cast("double"), w, 12, F.avg), "buys_12m": roll(c("buy").cast("int"), w, 12).cast("double"),
                       "since_buy": since_last(c("buy"), c("rank"), w).cast("double"), "since_sale": since_last(c("out") > 0, c("rank"), w).cast("double"),
                       "mean_gap": c("rank") / F.greatest(F.sum(c("buy").cast("int")).over(run), F.lit(1)),
                       "mean_lot": F.coalesce(F.avg(F.when(c("buy"), c("qty_in"))).over(run), F.lit(0.0)),
                       "position_change_3m": F.coalesce(c("position") - F.lag("position", 3).over(w), F.lit(0.0)),
                       "log_unit_cost": F.log1p(F.greatest(F.coalesce("unit_cost", F.lit(0.0)), F.lit(0.0))), "month_no": F.month("month").cast("double"),
                       "std12": rolling_std(c("out"), w, 12), "next": future(c("buy").cast("int"), w, horizon)})
    d = d.withColumns({"use_trend": c("use_3m") / (c("use_12m") + EPS), "use_volatility": c("std12") / (c("use_12m") + EPS), "wait_ratio": c("since_buy") / (c("mean_gap") + EPS),
                       "cover_months": c("position") / (c("use_3m") + EPS), "lot_ratio": c("position") / (c("mean_lot") + EPS), "y": (c("next") > 0).cast("int")})
    d = d.filter(c("rank") >= min_months)
    keep = d if for_scoring else d.filter(c("y").isNotNull())
    return keep.select("key", "month", *REPLENISHMENT_FEATURES, "y")


REPLENISHMENT_FEATURES = ["use_1m", "use_3m", "use_6m", "use_12m", "use_trend", "use_volatility", "active_share_12m", "position_change_3m", "since_buy", "since_sale",
                          "buys_12m", "mean_gap", "wait_ratio", "mean_lot", "position", "cover_months", "lot_ratio", "log_unit_cost", "month_no", "rank"]


def buyer_mix(lines: DataFrame) -> DataFrame:
    """Buyers, amounts, Herfindahl index and first buyer's share per product and month."""
    cm = lines.filter("trim(label) <> '' and qty > 0").groupBy(F.upper(F.trim("label")).alias("key"), F.trunc("date", "month").alias("month"), "customer").agg(
        F.sum("amount").alias("a"), F.sum("cost").alias("k"), F.sum(F.abs("amount")).alias("b"))
    g = cm.groupBy("key", "month").agg(F.count(F.lit(1)).alias("n_customers"), F.sum("a").alias("amount"), F.sum("k").alias("cost"), F.sum("b").alias("b"),
                                       F.sum(F.col("b") * F.col("b")).alias("bb"), F.max("b").alias("bm"))
    b = F.nullif("b", F.lit(0.0))
    return g.select("key", "month", "n_customers", "amount", "cost", (F.col("bb") / (b * b)).alias("hhi"), (F.col("bm") / b).alias("top_share"))


def end_of_life_panel(positions: DataFrame, mix: DataFrame, horizon: int = 6, alive_window: int = 3, alive_min: int = 2, min_months: int = 12,
                      for_scoring: bool = False) -> DataFrame:
    """Product x month: 22 features and "no sale within six months", on products still alive."""
    c, w = F.col, Window.partitionBy("key").orderBy("month")
    run = w.rowsBetween(PAST, 0)
    d = positions.join(mix, ["key", "month"], "left").fillna(0.0, ["amount", "cost"]).fillna(0, ["n_customers"])
    d = d.withColumns({"rank": F.row_number().over(w), "out": c("qty_out"), "sold": (c("qty_out") > 0).cast("int"),
                       "price": F.when(c("qty_out") > 0, c("amount") / (c("qty_out") + EPS))})
    ff = lambda x: F.last(x, True).over(run)
    d = d.withColumns({
        "use_1m": c("out"), **{f"use_{n}m": roll(c("out"), w, n, F.avg) for n in (3, 6, 12)}, "active_months_12m": roll(c("sold"), w, 12).cast("double"),
        "since_sale": since_last(c("sold") == 1, c("rank"), w).cast("double"), "since_buy": since_last(c("qty_in") > 0, c("rank"), w).cast("double"),
        "age_months": c("rank").cast("double"), "customers_12m": roll(c("n_customers"), w, 12, F.max).cast("double"), "customers_3m": roll(c("n_customers"), w, 3, F.max).cast("double"),
        "hhi_ff": F.coalesce(ff("hhi"), F.lit(1.0)), "top_share_ff": F.coalesce(ff("top_share"), F.lit(1.0)), "mean_customers_6m": roll(c("n_customers"), w, 6, F.avg),
        "p3": roll(c("price"), w, 3, F.avg), "p12": roll(c("price"), w, 12, F.avg), "price_volatility": rolling_std(c("price"), w, 12),
        "relative_margin": (c("amount") - c("cost")) / (F.abs("amount") + EPS), "month_no": F.month("month").cast("double"),
        "log_stock_value": F.log1p(F.greatest("position", F.lit(0.0)) * F.greatest(F.coalesce("unit_cost", F.lit(0.0)), F.lit(0.0))),
        "std12": rolling_std(c("out"), w, 12), "next": future(c("sold"), w, horizon), "alive": roll(c("sold"), w, alive_window) >= alive_min})
    d = d.withColumns({"price_3m": F.coalesce(ff("p3"), F.lit(0.0)), "price_12m": F.coalesce(ff("p12"), F.lit(0.0))})
    d = d.withColumns({"use_trend": c("use_3m") / (c("use_12m") + EPS), "use_volatility": c("std12") / (c("use_12m") + EPS),
                       "customer_erosion": 1.0 - c("customers_3m") / (c("customers_12m") + EPS), "price_drift": c("price_3m") / (c("price_12m") + EPS),
                       "y": (c("next") == 0).cast("int")})
    d = d.filter(c("alive") & (c("rank") >= min_months))
    keep = d if for_scoring else d.filter(c("y").isNotNull())
    return keep.select("key", "month", *END_OF_LIFE_FEATURES, "y")


END_OF_LIFE_FEATURES = ["use_1m", "use_3m", "use_6m", "use_12m", "use_trend", "use_volatility", "active_months_12m", "since_sale", "since_buy", "age_months",
                        "customers_12m", "customers_3m", "customer_erosion", "hhi_ff", "top_share_ff", "mean_customers_6m", "price_3m", "price_drift",
                        "price_volatility", "relative_margin", "month_no", "log_stock_value"]


def demand_features(lines: DataFrame, names: DataFrame, min_months: int = 12) -> DataFrame:
    """Product x month demand with lags, means, clientele and price features, and the next 1-3 months as targets."""
    c = F.col
    per = lines.filter("qty > 0").groupBy(c("reference").alias("product"), F.trunc("date", "month").alias("month"), "customer").agg(F.sum("qty").alias("q"), F.sum("amount").alias("a"))
    per = per.join(names.select("customer", R.establishment_type(c("customer_name")).alias("type")), "customer", "left")
    of = lambda k: F.coalesce(R.sum_where(c("q"), c("type") == k), F.lit(0.0)) / F.sum("q")
    agg = per.groupBy("product", "month").agg(
        F.sum("q").alias("qty"), F.sum("a").alias("revenue"), F.count(F.lit(1)).alias("nc"), of("public_hospital").alias("pp"), of("laboratory").alias("pl"),
        (F.sum(c("q") * c("q")) * 10000.0 / (F.sum("q") * F.sum("q"))).alias("hh"))
    span = agg.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.min("month").alias("lo"), F.max("month").alias("hi")).filter(c("n") >= min_months)
    g = span.select("product", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month")).join(agg, ["product", "month"], "left")
    w = Window.partitionBy("product").orderBy("month")
    run = w.rowsBetween(PAST, 0)
    fill = {x: F.coalesce(F.last(x, True).over(run), F.lit(0.0)) for x in ("pp", "pl", "hh")}
    g = g.withColumns({"qty": F.coalesce("qty", F.lit(0.0)), "revenue": F.coalesce("revenue", F.lit(0.0)), "nc": F.coalesce("nc", F.lit(0)), **fill})
    prior = lambda n: w.rowsBetween(-n, -1)
    g = g.withColumns({
        **{f"lag_{k}": F.lag("qty", k).over(w) for k in (1, 2, 3, 6, 12)}, **{f"ma_{k}": F.avg("qty").over(prior(k)) for k in (3, 6, 12)},
        **{f"std_{k}": F.when(F.count("qty").over(prior(k)) >= 2, F.stddev_samp("qty").over(prior(k))) for k in (3, 6)},
        "age": F.row_number().over(w) - 1, "n_customers": F.lag("nc").over(w), "share_public": F.lag("pp").over(w), "share_lab": F.lag("pl").over(w),
        "hhi": F.lag("hh").over(w), "active_months": F.sum((c("qty") > 0).cast("int")).over(w.rowsBetween(PAST, -1)),
        "price": F.lag(F.when(c("qty") != 0, c("revenue") / c("qty"))).over(w),
        "y_h1": future(c("qty"), w, 1), "y_h2": future(c("qty"), w, 2), "y_h3": future(c("qty"), w, 3)})
    g = g.withColumns({"ratio_3_12": c("ma_3") / F.nullif("ma_12", F.lit(0.0)), "trend_3m": c("ma_3") - F.lag("ma_3", 3).over(w), "month_no": F.month("month"),
                       "quarter": F.quarter("month"), "activity_rate": c("active_months") / F.nullif("age", F.lit(0)), "price_change": c("price") / F.lag("price", 3).over(w) - 1})
    feats = [F.coalesce(c(x).cast("double"), F.lit(0.0)).alias(x) for x in DEMAND_FEATURES]
    return g.filter(c("y_h1").isNotNull()).select("product", "month", "qty", *feats, "y_h1", "y_h2", "y_h3")


DEMAND_FEATURES = ["lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "ma_3", "ma_6", "ma_12", "std_3", "std_6", "ratio_3_12", "trend_3m", "month_no", "quarter",
                   "n_customers", "share_public", "share_lab", "hhi", "age", "active_months", "activity_rate", "price", "price_change"]


# ---------------------------------------------------------------- reference demand (dense long panel)

def reference_demand(lines: DataFrame, names: DataFrame, family: str = "REACTIF%", drop_last: bool = True) -> DataFrame:
    """Dense reference x month demand of one family: quantity (never negative), amount, clientele and concentration."""
    c = F.col
    per = lines.filter(c("family").like(family) & c("reference").isNotNull()).groupBy("reference", R.month_index(c("date")).alias("m"), "customer").agg(
        F.sum("qty").alias("q0"), F.sum("amount").alias("a"))
    per = per.join(names.select("customer", R.establishment_type(c("customer_name"), with_pharmacy=False).alias("type")), "customer", "left").withColumn("q", F.greatest("q0", F.lit(0.0)))
    of = lambda k: F.coalesce(R.sum_where(c("q"), c("type") == k), F.lit(0.0)).alias(f"q_{k}")
    agg = per.groupBy("reference", "m").agg(
        F.greatest(F.sum("q0"), F.lit(0.0)).alias("y"), F.sum("a").alias("amount"), *[of(k) for k in REFERENCE_TYPES],
        F.when(F.sum("q") > 0, F.sum(c("q") * c("q")) / (F.sum("q") * F.sum("q"))).alias("hhi"), R.count_where(c("q") > 0).alias("n_customers"))
    lo, hi = scalar(agg.agg(F.min("m"))), scalar(agg.agg(F.max("m") - (1 if drop_last else 0)))
    refs = agg.filter(c("m") <= hi).groupBy("reference").agg(F.lit(1).alias("_")).drop("_").withColumns({"_lo": lo, "_hi": hi})
    g = refs.select("reference", F.explode(F.sequence("_lo", "_hi")).alias("m")).join(agg, ["reference", "m"], "left")
    return g.fillna(0.0, ["y", "amount", *[f"q_{k}" for k in REFERENCE_TYPES]]).fillna(0, ["n_customers"]).withColumn("t", c("m") - lo)


REFERENCE_TYPES = ("public_hospital", "private_clinic", "laboratory", "other")


def eligible(demand: DataFrame, min_active_24: int = 6) -> DataFrame:
    """Origins at which a reference is forecast: six active months of 24 and one of the last 12."""
    w = Window.partitionBy("reference").orderBy("m")
    pos = (F.col("y") > 0).cast("int")
    return demand.filter("y is not null").withColumn("eligible", (roll(pos, w, 24) >= min_active_24) & (roll(pos, w, 12) >= 1))


def reference_positions(positions: DataFrame, lines: DataFrame) -> DataFrame:
    """(reference, m, position): month-end stock of the designations that were sold most under each reference; no row where none has a position."""
    key = F.upper(F.trim("label")).alias("key")
    sold = lines.groupBy(key, "reference").agg(F.sum("qty").alias("q"))
    owner = sold.groupBy("key").agg(F.min_by("reference", F.struct((-F.col("q")).alias("q"), F.col("reference"))).alias("reference"))
    return positions.join(owner, "key").groupBy("reference", R.month_index(F.col("month")).alias("m")).agg(F.sum("position").alias("position"))


def reference_features(demand: DataFrame, flows: DataFrame, h: int = 1) -> DataFrame:
    """About fifty strictly retrospective variables per (reference, origin month), and the demand h months later.

    `flows` holds (reference, m, qty_in, position).
    """
    c, w = F.col, Window.partitionBy("reference").orderBy("m")
    market = demand.groupBy("m").agg(F.sum("y").alias("mk"))                      # one row per month
    mw = Window.partitionBy(F.lit(0)).orderBy("m")
    market = market.select("m", c("mk").alias("market_last"), F.lag("mk", 12 - h).over(mw).alias("market_year_ago"), roll(c("mk"), mw, 12, F.avg).alias("market_mean_12"))
    d = eligible(demand).join(flows, ["reference", "m"], "left").withColumn("qty_in", F.coalesce("qty_in", F.lit(0.0)))
    rank = c("t") + 1
    nz = F.when(c("y") > 0, c("y"))
    n24, len24 = F.count(nz).over(w.rowsBetween(-23, 0)), F.count(F.lit(1)).over(w.rowsBetween(-23, 0))
    prev = w.rowsBetween(-23, -12)
    med = lambda k: F.percentile("y", F.lit(0.5)).over(w.rowsBetween(-(k - 1), 0))
    q12 = roll(c("y"), w, 12)
    last_t, first_t = F.last(F.when(c("y") > 0, c("t")), True).over(w.rowsBetween(PAST, 0)), F.min(F.when(c("y") > 0, c("t"))).over(w.rowsBetween(PAST, 0))
    cols = {f"lag_{k}": F.lag("y", k).over(w) for k in range(12)}
    cols |= {"season_1": F.lag("y", 12 - h).over(w), "season_2": F.lag("y", 24 - h).over(w)}
    cols |= {f"mean_{k}": roll(c("y"), w, k, F.avg) for k in (3, 6, 12, 24)} | {f"median_{k}": med(k) for k in (3, 6, 12, 24)}
    cols |= {"std_12": roll(c("y"), w, 12, F.stddev_pop), "max_12": roll(c("y"), w, 12, F.max), "zero_share_12": roll((c("y") == 0).cast("double"), w, 12, F.avg),
             "mean_12_before": F.coalesce(F.avg("y").over(prev), F.lit(0.0)), "since_sale": F.coalesce(c("t") - last_t, rank).cast("double"),
             "age": F.coalesce(rank - first_t, F.lit(0)).cast("double"), "active_24": n24.cast("double"), "adi": F.when(n24 > 0, len24 / n24),
             "cv2": F.when(n24 > 1, F.var_pop(nz).over(w.rowsBetween(-23, 0)) / F.pow(F.avg(nz).over(w.rowsBetween(-23, 0)), F.lit(2))),
             "hhi_12": roll(c("hhi"), w, 12, F.avg), "max_customers_12": roll(c("n_customers"), w, 12, F.max).cast("double"),
             "price_12": F.when(q12 > 0, roll(c("amount"), w, 12) / q12), "bought_3": roll(c("qty_in"), w, 3), "bought_12": roll(c("qty_in"), w, 12),
             "target": F.lead("y", h).over(w)}
    tot = reduce(lambda a, b: a + b, [roll(c(f"q_{k}"), w, 12) for k in REFERENCE_TYPES])
    cols |= {f"share_{k}": F.when(tot > 0, roll(c(f"q_{k}"), w, 12) / tot) for k in REFERENCE_TYPES}
    d = d.withColumns(cols).withColumn("growth_12", F.when(c("mean_12_before") > 0, c("mean_12") / c("mean_12_before"))).filter("eligible").join(F.broadcast(market), "m")
    return d.select("reference", "m", *REFERENCE_FEATURES, ((c("m") + h) % 12 + 1).cast("double").alias("target_month"), F.lit(h).alias("h"), "target")


REFERENCE_FEATURES = [*[f"lag_{k}" for k in range(12)], "season_1", "season_2", *[f"{s}_{k}" for k in (3, 6, 12, 24) for s in ("mean", "median")], "std_12", "max_12",
                      "zero_share_12", "mean_12_before", "growth_12", "since_sale", "age", "active_24", "adi", "cv2", *[f"share_{k}" for k in REFERENCE_TYPES], "hhi_12",
                      "max_customers_12", "price_12", "bought_3", "bought_12", "position", "market_last", "market_year_ago", "market_mean_12"]


def customer_signals(lines: DataFrame, quotes: DataFrame, h: int = 1, family: str = "REACTIF%") -> DataFrame:
    """Signals built per customer and brought back to the reference: expected repurchase and quote activity.

    Works on the sparse (reference, customer, month) purchases; no dense couple grid.
    """
    c = F.col
    buy = lines.filter(c("family").like(family)).groupBy("reference", "customer", R.month_index(c("date")).alias("m")).agg(F.greatest(F.sum("qty"), F.lit(0.0)).alias("q")).filter("q > 0")
    pair = Window.partitionBy("reference", "customer").orderBy("m")
    probes = buy.select("reference", "customer", F.explode(F.sequence(c("m") + 11 - h, c("m") + 13 - h)).alias("m")).distinct().select("*", F.lit(None).cast("double").alias("q"), F.lit(1).alias("probe"))
    u = buy.withColumn("probe", F.lit(0)).unionByName(probes).withColumns({
        "then": F.sum("q").over(pair.rangeBetween(-(13 - h), -(11 - h))), "since": F.coalesce(F.sum("q").over(pair.rangeBetween(-(10 - h), 0)), F.lit(0.0))})
    again = u.filter((c("probe") == 1) & (c("since") == 0)).groupBy("reference", "m").agg(F.sum("then").alias("expected_repurchase"))
    v12 = buy.select("reference", "customer", "q", F.explode(F.sequence(c("m"), c("m") + 11)).alias("m")).groupBy("reference", "customer", "m").agg(F.sum("q").alias("v"))
    tot = v12.groupBy("reference", "m").agg(F.sum("v").alias("tv"))
    qm = quotes.groupBy("customer", R.month_index(c("date")).alias("m")).agg(F.sum("ht").alias("ht"))
    lo = scalar(buy.agg(F.min("m")))
    pulse = qm.select("customer", "ht", c("m").alias("qm"), F.explode(F.sequence(c("m"), c("m") + 14)).alias("m")).groupBy("customer", "m").agg(
        R.sum_where(c("ht"), c("m") - c("qm") <= 2).alias("recent"), R.sum_where(c("ht"), c("m") - c("qm") >= 3).alias("before"))
    x = v12.join(pulse, ["customer", "m"], "left").fillna(0.0, ["recent", "before"])
    months = F.least(F.lit(12), F.greatest(c("m") - lo - 2, F.lit(0)))
    usual = F.when(months > 0, c("before") / months * 3).otherwise(0.0)
    rel = F.least(F.when(usual > 0, c("recent") / usual).when(c("recent") > 0, 2.0).otherwise(1.0), F.lit(5.0))
    s = x.withColumn("rel", rel).groupBy("reference", "m").agg(F.sum(c("v") * c("rel")).alias("a"), F.sum(c("v") * c("recent")).alias("b"))
    return tot.join(s, ["reference", "m"]).join(again, ["reference", "m"], "full_outer").select(
        "reference", "m", F.coalesce("expected_repurchase", F.lit(0.0)).alias("expected_repurchase"), F.coalesce(c("a") / c("tv"), F.lit(0.0)).alias("quote_activity"),
        F.coalesce(c("b") / c("tv"), F.lit(0.0)).alias("quoted_amount_3m"))


# ---------------------------------------------------------------- profiles

def customer_profiles(sales: DataFrame, names: DataFrame, demand: DataFrame, min_documents: int = 3) -> DataFrame:
    """Seven behavioural variables per customer (recency, frequency, amount, regularity, variety)."""
    c, ref = F.col, scalar(sales.agg(F.max("date")))
    m = sales.filter(~c("is_credit")).groupBy("customer", R.month_index(c("date")).alias("m")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ttc").alias("t"), F.min("date").alias("a"), F.max("date").alias("z"))
    b = m.groupBy("customer").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.min("a").alias("first"), F.max("z").alias("last"), F.count(F.lit(1)).alias("am"))
    b = b.filter((c("n") >= min_documents) & (c("t") > 0))
    ok = names.filter(reduce(lambda x, y: x & y, [~c("customer_name").ilike(p) for p in ("%passager%", "%comptant%", "%divers%")]))
    var = demand.groupBy("customer").agg(F.count(F.lit(1)).alias("nf"))
    x = b.join(ok.select("customer"), "customer").join(var, "customer", "left")
    age = F.greatest(R.month_index(ref) - R.month_index(c("first")), F.lit(1))
    return x.select("customer", F.log1p("t").alias("log_revenue"), F.log1p("n").alias("log_frequency"), F.datediff(ref, "last").cast("double").alias("recency_days"),
                    F.least(c("am") / age, F.lit(1.0)).alias("regularity"), F.log1p(c("t") / c("n")).alias("log_basket"), age.cast("double").alias("age_months"),
                    F.log1p(F.greatest(F.coalesce("nf", F.lit(1)), F.lit(1))).alias("log_variety"), c("t").alias("revenue"))


PROFILE_FEATURES = ["log_revenue", "log_frequency", "recency_days", "regularity", "log_basket", "age_months", "log_variety"]
