"""Dashboard indicators. Each function maps frames to one small result frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import distinct_values, running_totals, scalar

def billed() -> Column:
    return ~F.col("is_credit")
WALK_IN_NAMES = ("%passager%", "%comptant%", "%divers%")


def ranked_top(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Global top k, ranked. Only k rows reach the ordered window."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


# ---------------------------------------------------------------- reference period

def reference_period(sales: DataFrame, code: str = "12m") -> DataFrame:
    """Start/end and the same window one year earlier, anchored on the last document date."""
    end = F.max("date")
    start = F.date_add(F.add_months(end, -12), 1) if code == "12m" else F.trunc(end, "year")
    bounds = sales.agg(end.alias("end"), start.alias("start"))
    return bounds.select("start", "end", F.add_months("start", -12).alias("cmp_start"),
                         F.add_months("end", -12).alias("cmp_end"))


def within(df: DataFrame, period: DataFrame, start: str = "start", end: str = "end", day: str = "date") -> DataFrame:
    return df.filter(F.col(day).between(scalar(period.select(start)), scalar(period.select(end))))


def scope(sales: DataFrame, filters: R.Filters | None = None) -> DataFrame:
    """Filtered documents, on the reference period unless dates or years were chosen."""
    f = filters or R.Filters()
    kept = sales.filter(f.predicate())
    if not (f.years or f.start or f.end or f.period == "all"):
        kept = within(kept, reference_period(sales, f.period))
    return R.loyalty_segment(kept, f.loyalty)


# ---------------------------------------------------------------- headline

def headline(sales: DataFrame) -> DataFrame:
    a = sales.agg(
        F.sum("ttc").alias("ttc"), F.sum("ht").alias("ht"), R.count_where(billed()).alias("invoices"),
        R.count_where(F.col("is_credit")).alias("credits"),
        R.sum_where(-F.col("ttc"), F.col("is_credit")).alias("credit_amount"),
        F.countDistinct("customer").alias("customers"),
        F.avg(F.when(billed(), F.col("delay_days"))).alias("mean_delay"))
    return a.select(
        F.round("ttc", 2).alias("revenue_ttc"), F.round("ht", 2).alias("revenue_ht"), "invoices", "credits",
        F.round(R.pct(F.col("credit_amount"), F.col("ttc")), 6).alias("credit_rate_pct"), "customers",
        F.round(R.ratio(F.col("ttc"), F.col("invoices")), 4).alias("mean_basket"),
        F.round("mean_delay", 6).alias("mean_delay_days"))


def monthly_revenue(sales: DataFrame) -> DataFrame:
    """Monthly revenue with growth and trend against the previous month."""
    m = sales.groupBy(R.month_key(F.col("date")).alias("month")).agg(F.sum("ttc").alias("r"))
    prev = F.lag("r").over(Window.orderBy("month"))          # one row per calendar month
    return m.select("month", F.round("r", 2).alias("revenue"),
                    F.round(R.pct(F.col("r") - prev, prev), 6).alias("growth_pct"),
                    F.when(prev.isNull(), "stable").when(F.col("r") >= prev, "up").otherwise("down").alias("trend"))


def yearly_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("year").agg(F.round(F.sum("ttc"), 2).alias("revenue"))


def trailing_growth(sales: DataFrame) -> DataFrame:
    last = scalar(sales.agg(F.max("date")))
    d, cut1, cut2 = F.col("date"), F.add_months(last, -12), F.add_months(last, -24)
    a = sales.filter(d > cut2).agg(R.sum_where(F.col("ttc"), d > cut1).alias("t"),
                                   R.sum_where(F.col("ttc"), d <= cut1).alias("p"))
    return a.select(F.round("t", 2).alias("trailing_12m"), F.round("p", 2).alias("prior_12m"),
                    F.round(R.pct(F.col("t") - F.col("p"), F.col("p")), 6).alias("growth_pct"))


def period_comparison(sales: DataFrame, code: str = "12m") -> DataFrame:
    """Reference period against the same-length period one year earlier, in one scan."""
    p = reference_period(sales, code)
    col = {c: scalar(p.select(c)) for c in ("start", "end", "cmp_start", "cmp_end")}
    cur = F.col("date").between(col["start"], col["end"])
    cmp = F.col("date").between(col["cmp_start"], col["cmp_end"])
    a = sales.agg(R.sum_where(F.col("ttc"), cur).alias("c"), R.sum_where(F.col("ttc"), cmp).alias("p"),
                  F.countDistinct(F.when(cur, F.col("customer"))).alias("customers"),
                  F.countDistinct(F.when(cmp, F.col("customer"))).alias("customers_before"))
    return a.select(F.round("c", 2).alias("revenue"), F.round("p", 2).alias("revenue_before"), "customers",
                    "customers_before", F.round(R.pct(F.col("c") - F.col("p"), F.col("p")), 6).alias("change_pct"))


def year_over_year(sales: DataFrame) -> DataFrame:
    """Calendar month: last year present against the year present before it."""
    cur = scalar(sales.agg(F.max("year")))
    prev = scalar(sales.filter(F.col("year") < scalar(sales.agg(F.max("year")))).agg(F.max("year")))
    return (sales.groupBy(F.month("date").alias("month_no"))
            .agg(F.round(R.sum_where(F.col("ttc"), F.col("year") == cur), 2).alias("current"),
                 F.round(R.sum_where(F.col("ttc"), F.col("year") == prev), 2).alias("previous")))


def seasonality(sales: DataFrame) -> DataFrame:
    """Two-step on the (month, year) grain, so the distinct count costs no row expansion."""
    my = sales.groupBy(F.month("date").alias("month_no"), "year").agg(F.sum("ttc").alias("r"))
    return my.groupBy("month_no").agg(F.round(F.sum("r") / F.count(F.lit(1)), 3).alias("mean_revenue"))


# ---------------------------------------------------------------- granted delays

def delay_counters(sales: DataFrame) -> DataFrame:
    d, t = F.col("delay_days"), F.col("ttc")
    a = sales.filter(billed()).agg(
        *[R.count_where(d > k).alias(f"over_{k}") for k in (30, 60, 90)],
        R.count_where(d.isNotNull()).alias("with_delay"),
        R.sum_where(t, d > 60).alias("a60"), R.sum_where(t, d > 90).alias("a90"))
    return a.select("over_30", "over_60", "over_90",
                    F.round(R.pct(F.col("over_60"), F.col("with_delay")), 6).alias("share_over_60_pct"),
                    F.round("a60", 2).alias("amount_over_60"), F.round("a90", 2).alias("amount_over_90"))


def _recently_due(sales: DataFrame) -> DataFrame:
    return sales.filter(F.col("due") >= F.add_months(scalar(sales.agg(F.max("due"))), -6))


def recent_exposure(sales: DataFrame) -> DataFrame:
    d, t = F.col("delay_days"), F.col("ttc")
    return _recently_due(sales).agg(
        F.round(R.sum_where(t, d > 60), 2).alias("exposure"), F.round(R.sum_where(t, d > 90), 2).alias("critical"),
        R.count_where(d > 60).alias("documents"), R.month_key(F.max("due")).alias("reference_month"))


def customers_to_chase(sales: DataFrame, names: DataFrame, k: int = 10, recent: bool = True) -> DataFrame:
    rows = _recently_due(sales) if recent else sales
    late = F.col("delay_days") > 60
    g = (rows.groupBy("customer").agg(R.sum_where(F.col("ttc"), late).alias("m"), R.count_where(late).alias("documents"))
         .filter("m > 0").orderBy(F.col("m").desc_nulls_last(), "customer").limit(k))
    return g.join(names, "customer", "left").select("customer", "customer_name", F.round("m", 2).alias("amount"), "documents")


def delay_ageing(sales: DataFrame) -> DataFrame:
    return (sales.filter(billed() & F.col("delay_days").isNotNull())
            .groupBy(R.delay_band(F.col("delay_days")).alias("band"))
            .agg(F.round(F.sum("ttc"), 2).alias("amount"), F.count(F.lit(1)).alias("documents")))


def granted_vs_obtained(sales: DataFrame, purchases: DataFrame, days: Column) -> DataFrame:
    """Simple and amount-weighted mean delays on both sides, gap and financed cash."""
    def side(df, label):
        t, d = F.col("ttc"), F.col("delay_days")
        return df.filter(billed() & d.isNotNull()).agg(
            F.avg(d).alias(f"{label}_simple"), R.ratio(F.sum(t * d), F.sum(t)).alias(f"{label}_weighted"),
            F.count(F.lit(1)).alias(f"{label}_documents"), F.sum(t).alias(f"{label}_amount"))
    g, o = side(sales, "granted"), side(purchases, "obtained")
    both = g.select(F.lit(1).alias("one"), "*").join(o.select(F.lit(1).alias("one"), "*"), "one").drop("one")
    gap = F.col("granted_weighted") - F.col("obtained_weighted")
    return both.select(
        *[F.round(f"{s}_{m}", 6).alias(f"{s}_{m}") for s in ("granted", "obtained") for m in ("simple", "weighted")],
        "granted_documents", "obtained_documents", F.round("granted_amount", 2).alias("granted_amount"),
        F.round("obtained_amount", 1).alias("obtained_amount"), F.round(gap, 6).alias("gap_days"),
        F.when(gap > 0, "positive").when(gap < 0, "negative").otherwise("zero").alias("gap_sign"),
        F.round(F.col("granted_amount") / days * gap, 2).alias("cycle_cash"))


def delay_band_shares(sales: DataFrame) -> DataFrame:
    bands = (sales.filter(billed() & F.col("delay_days").isNotNull())
             .groupBy(R.delay_band(F.col("delay_days")).alias("band"))
             .agg(F.sum("ttc").alias("a"), F.count(F.lit(1)).alias("documents")))
    total = F.sum("a").over(Window.partitionBy())             # five bands
    return bands.select("band", "documents", F.round("a", 2).alias("amount"), F.round(R.pct(F.col("a"), total), 6).alias("share_pct"),
                        F.col("band").isin("61-90", "over 90").alias("beyond_60"))


# ---------------------------------------------------------------- customers

def top_customers(sales: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    g = sales.groupBy("customer").agg(
        F.sum("ttc").alias("r"), R.count_where(billed()).alias("invoices"), R.count_where(F.col("is_credit")).alias("credits"),
        R.sum_where(F.col("ttc"), billed() & (F.col("delay_days") > 30)).alias("risk"))
    total = scalar(sales.agg(F.sum("ttc")))
    top = ranked_top(g, [F.col("r").desc_nulls_last(), F.col("customer").asc()], k)
    return top.join(names, "customer", "left").select(
        "rank", "customer", "customer_name", F.round("r", 2).alias("revenue"), "invoices", "credits",
        F.round(R.pct(F.col("r"), total), 6).alias("share_pct"), F.round("risk", 2).alias("risk_amount"))


def loyal_customers(sales: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    m = R.month_key(F.col("date"))
    # (customer, month) first: the distinct-month count becomes a plain count
    cm = sales.groupBy("customer", m.alias("m")).agg(
        F.sum("ttc").alias("r"), F.count(F.lit(1)).alias("docs"), R.count_where(billed()).alias("inv"))
    g = (cm.groupBy("customer").agg(
        F.sum("r").alias("r"), F.sum("docs").alias("docs"), F.sum("inv").alias("invoices"),
        R.count_where(F.col("inv") > 0).alias("active_months"),
        F.min(F.when(F.col("inv") > 0, F.col("m"))).alias("first_month"),
        F.max(F.when(F.col("inv") > 0, F.col("m"))).alias("last_month")).filter("docs >= 2")
        .join(_regular_names(names, (*WALK_IN_NAMES, "%espèce%")), "customer"))
    order = [F.col("active_months").desc(), F.col("invoices").desc(), F.col("r").desc_nulls_last(), F.col("customer").asc()]
    return g.orderBy(*order).limit(k).select("customer", "customer_name", F.round("r", 2).alias("revenue"), "invoices",
                                             "active_months", "first_month", "last_month")


def _regular_names(names: DataFrame, patterns) -> DataFrame:
    n = names.filter(F.col("customer_name").isNotNull())
    for p in patterns:
        n = n.filter(~F.col("customer_name").ilike(p))
    return n


def disengaging_customers(sales: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    """Last 90 days under 40 % of the previous 90, among customers with at least six active months."""
    last = scalar(sales.agg(F.max("date")))
    d = F.col("date")
    cm = sales.groupBy("customer", R.month_key(d).alias("m")).agg(
        F.max("date").alias("last"), R.sum_where(F.col("ttc"), d >= F.date_sub(last, 90)).alias("a"),
        R.sum_where(F.col("ttc"), (d >= F.date_sub(last, 180)) & (d < F.date_sub(last, 90))).alias("b"))
    g = cm.groupBy("customer").agg(F.count(F.lit(1)).alias("active_months"), F.max("last").alias("last"),
                                   F.coalesce(F.sum("a"), F.lit(0.0)).alias("recent"),
                                   F.coalesce(F.sum("b"), F.lit(0.0)).alias("before"))
    g = g.filter((F.col("active_months") >= 6) & (F.col("before") > 0) & (F.col("recent") < F.col("before") * 0.4))
    g = g.join(_regular_names(names, WALK_IN_NAMES), "customer")
    return g.orderBy((F.col("before") - F.col("recent")).desc_nulls_last(), "customer").limit(k).select(
        "customer", "customer_name", R.month_key(F.col("last")).alias("last_month"), "active_months",
        F.round("recent", 2).alias("recent"), F.round("before", 2).alias("before"),
        F.datediff(last, "last").alias("idle_days"), F.round((1 - F.col("recent") / F.col("before")) * 100, 6).alias("drop_pct"))


def positive_balances(df: DataFrame, entity: str, total: str = "ttc") -> DataFrame:
    return df.groupBy(entity).agg(F.sum(total).alias("r")).filter("r > 0")


def concentration(df: DataFrame, entity: str, total: str = "ttc") -> DataFrame:
    """HHI over positive balances; 10000 is a monopoly."""
    return positive_balances(df, entity, total).agg(
        F.round(F.sum(F.col("r") * F.col("r")) * 10000.0 / (F.sum("r") * F.sum("r")), 6).alias("hhi"),
        F.count(F.lit(1)).alias("entities"))


def _cumulative(df: DataFrame, entity: str) -> DataFrame:
    """Distinct balances in descending order with inclusive cumulative revenue (peers included)."""
    v = distinct_values(positive_balances(df, entity), "r").withColumn("amt", F.col("r") * F.col("n"))
    run = running_totals(v, "r", ["n", "amt"], descending=True)
    return run.withColumn("cum", F.col("amt_before") + F.col("amt"))


def entities_for_share(df: DataFrame, entity: str = "customer", share: float = 0.8) -> DataFrame:
    return _cumulative(df, entity).agg(
        F.min(F.when(F.col("cum") >= share * F.col("amt_total"), F.col("n_before") + 1)).alias("customers_for_80pct"),
        F.max("n_total").alias("customers"))


def pareto_curve(df: DataFrame, entity: str = "customer", step: int = 5) -> DataFrame:
    """Percent of entities against cumulative revenue share, every `step` percent."""
    c, n = _cumulative(df, entity), F.col("n_total")
    lo, hi = F.col("n_before") + 1, F.col("n_before") + F.col("n")
    p = F.explode(F.sequence(F.floor(lo * 100.0 / n), F.floor(hi * 100.0 / n) + 1)).alias("pct")
    e = c.select("*", lo.alias("lo"), hi.alias("hi"), p)
    first, last = F.ceil((F.col("pct") - 0.5) * n / 100.0), F.ceil((F.col("pct") + 0.5) * n / 100.0) - 1
    hit = e.filter((F.greatest("lo", first) <= F.least("hi", last)) & (F.col("pct") % step == 0))
    return hit.groupBy(F.col("pct").cast("int").alias("pct_customers")).agg(
        F.round(F.max(F.col("cum") / F.col("amt_total") * 100), 6).alias("pct_revenue"))


def risk_ranking(scores: DataFrame, names: DataFrame, k: int = 10) -> DataFrame:
    """Score share times exposure, highest first."""
    s = scores.withColumn("priority", F.col("score") / 100.0 * F.col("exposure"))
    top = ranked_top(s, [F.col("priority").desc_nulls_last(), F.col("customer").asc()], k)
    return top.join(names, "customer", "left").select(
        "rank", "customer", "customer_name", F.round("score", 4).alias("score"), F.round("exposure", 2).alias("exposure"),
        F.round("priority", 2).alias("priority"))


def risk_totals(scores: DataFrame) -> DataFrame:
    return scores.agg(R.count_where(F.col("score") > 70).alias("high_risk_customers"),
                      F.round(F.sum(F.col("score") / 100.0 * F.col("exposure")), 2).alias("weighted_exposure"))


# ---------------------------------------------------------------- mixes and schedules

def mode_mix(sales: DataFrame, k: int = 8) -> DataFrame:
    label = F.coalesce(F.nullif(F.col("mode"), F.lit("")), F.lit("Non renseigné"))
    g = sales.groupBy(label.alias("mode")).agg(F.sum("ttc").alias("a"), F.count(F.lit(1)).alias("documents"))
    return g.orderBy(F.col("a").desc_nulls_last(), "mode").limit(k).select("mode", F.round("a", 2).alias("amount"), "documents")


def due_schedule(sales: DataFrame, k: int = 18) -> DataFrame:
    g = (sales.filter(F.col("due").isNotNull()).groupBy(R.month_key(F.col("due")).alias("month"))
         .agg(F.round(F.sum("ttc"), 2).alias("amount")))
    return g.orderBy(F.col("month").desc()).limit(k)


def amount_distribution(sales: DataFrame) -> DataFrame:
    return sales.groupBy(R.amount_band(F.col("ttc")).alias("band")).agg(F.count(F.lit(1)).alias("documents"))


# ---------------------------------------------------------------- purchases

def purchases_headline(purchases: DataFrame) -> DataFrame:
    return purchases.agg(
        F.round(F.sum("ttc"), 2).alias("purchases_ttc"), R.count_where(billed()).alias("invoices"),
        R.count_where(F.col("is_credit")).alias("credits"), F.countDistinct("supplier").alias("suppliers"),
        F.round(F.avg(F.when(billed(), F.col("delay_days"))), 6).alias("mean_delay_days"))


def top_suppliers(purchases: DataFrame, suppliers: DataFrame, k: int = 8) -> DataFrame:
    g = purchases.groupBy("supplier").agg(F.sum("ttc").alias("m"))
    total = scalar(purchases.agg(F.sum("ttc")))
    top = ranked_top(g, [F.col("m").desc_nulls_last(), F.col("supplier").asc()], k)
    return top.join(suppliers, "supplier", "left").select(
        "rank", "supplier", "supplier_name", F.round("m", 2).alias("amount"), F.round(R.pct(F.col("m"), total), 6).alias("share_pct"))


def sales_vs_purchases(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    s = sales.groupBy(R.month_key(F.col("date")).alias("month")).agg(F.round(F.sum("ttc"), 2).alias("sales"))
    p = purchases.groupBy(R.month_key(F.col("date")).alias("month")).agg(F.round(F.sum("ttc"), 2).alias("p"))
    return s.join(p, "month", "left").select("month", "sales", F.coalesce("p", F.lit(0.0)).alias("purchases"))


def cash_cycle(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    granted = scalar(sales.filter(billed()).agg(F.avg("delay_days")))
    return purchases.filter(billed()).agg(F.avg("delay_days").alias("obtained")).select(
        F.round(granted - F.col("obtained"), 6).alias("cash_conversion_cycle"))


# ---------------------------------------------------------------- quotes, products

def quote_headline(quotes: DataFrame) -> DataFrame:
    return quotes.agg(
        F.count(F.lit(1)).alias("quotes"), F.round(F.sum("ttc"), 2).alias("amount"), F.countDistinct("customer").alias("customers"),
        R.count_where(F.col("converted")).alias("converted"),
        F.round(R.pct(R.count_where(F.col("converted")), F.count(F.lit(1))), 6).alias("conversion_pct"))


def funnel(quotes: DataFrame, sales: DataFrame) -> DataFrame:
    """Quotes, converted quotes, invoiced customers."""
    q = quotes.agg(F.count(F.lit(1)).alias("quotes"), R.count_where(F.col("converted")).alias("converted"))
    steps = q.selectExpr("stack(2, 1, 'quotes', quotes, 2, 'converted quotes', converted) as (step_no, step, value)")
    inv = sales.agg(F.countDistinct("customer").alias("value")).select(
        F.lit(3).alias("step_no"), F.lit("invoiced customers").alias("step"), "value")
    return steps.unionByName(inv)


def top_products(lines: DataFrame, k: int = 10) -> DataFrame:
    g = (lines.filter(F.col("label").isNotNull() & (F.col("label") != "")).groupBy("label")
         .agg(F.sum("amount").alias("r"), F.sum("qty").alias("qty")))
    return ranked_top(g, [F.col("r").desc_nulls_last(), F.col("label").asc()], k).select(
        "rank", "label", F.round("r", 2).alias("revenue"), F.round("qty", 2).alias("qty"))


def top_families(lines: DataFrame, k: int = 6) -> DataFrame:
    g = lines.filter(R.in_scope_family(F.col("family"))).groupBy("family").agg(F.sum("amount").alias("r"))
    return ranked_top(g, [F.col("r").desc_nulls_last(), F.col("family").asc()], k).select(
        "rank", "family", F.round("r", 2).alias("revenue"))


def product_source(mart: DataFrame, lines: DataFrame, filters: R.Filters) -> DataFrame:
    """Yearly mart when only years are filtered, line level when dates are."""
    if filters.start or filters.end:
        return lines.filter(filters.predicate(mode=None, total=None, delay=None))
    years = F.col("year").isin(list(filters.years)) if filters.years else F.lit(True)
    return mart.filter(years).withColumnRenamed("revenue", "amount")


# ---------------------------------------------------------------- checks and options

def anomaly_counters(sales: DataFrame) -> DataFrame:
    """Counts behind the dashboard's anomaly messages, one row per kind."""
    d = F.col("delay_days")
    a = sales.agg(R.count_where(billed() & (d > 90)).alias("long_delay"),
                  R.count_where(billed() & (d > 30) & (d <= 90)).alias("watch_delay"),
                  R.count_where(F.col("ttc") < 0).alias("negative"), R.count_where(F.col("ttc") == 0).alias("zero"))
    rows = a.selectExpr("stack(4, 'long_delay', long_delay, 'watch_delay', watch_delay, 'negative', negative, "
                        "'zero', zero) as (anomaly, n)")
    hhi = concentration(sales, "customer").select(F.lit("concentrated").alias("anomaly"), (F.col("hhi") > 2500).cast("long").alias("n"))
    return rows.unionByName(hhi)


def filter_options(sales: DataFrame, names: DataFrame, k: int = 400) -> DataFrame:
    """Values offered by the filter panel: years, modes, top customers and the amount bound."""
    years = sales.select(F.lit("year").alias("option"), F.col("year").cast("string").alias("value")).distinct()
    modes = sales.filter("mode is not null and mode <> ''").select(F.lit("mode").alias("option"), F.col("mode").alias("value")).distinct()
    top = (sales.groupBy("customer").agg(F.sum("ttc").alias("r"))
           .orderBy(F.col("r").desc_nulls_last(), "customer").limit(k).join(names, "customer", "left")
           .select(F.lit("customer").alias("option"), F.coalesce("customer_name", F.col("customer").cast("string")).alias("value")))
    bound = sales.agg(F.max("ttc").alias("m")).select(
        F.lit("max_amount").alias("option"), F.format_string("%.2f", "m").alias("value"))
    return years.unionByName(modes).unionByName(top).unionByName(bound)


def annual_revenue(sales: DataFrame) -> DataFrame:
    last = scalar(sales.agg(F.max("date")))
    return (sales.filter(billed() & (F.col("date") >= F.add_months(last, -12)))
            .agg(F.round(F.coalesce(F.sum("ttc"), F.lit(0.0)), 2).alias("annual_revenue")))


def booked_public_share(sales: DataFrame, names: DataFrame, ahead: int = 1, due_years=(2016, 2035)) -> DataFrame:
    """Public establishments' share of receivables already booked for the month `ahead` of the last issue month."""
    origin = scalar(sales.agg(F.max(R.month_index(F.col("date")))))
    d, e = F.col("date"), F.col("due")
    booked = sales.filter(billed() & F.year(e).between(*due_years) & (e >= d) & (R.month_index(d) <= origin)
                          & (R.month_index(e) == origin + ahead))
    per = booked.groupBy("customer").agg(F.sum("ttc").alias("a")).join(names, "customer", "left")
    return per.agg(F.round(F.sum("a"), 2).alias("booked"), F.round(
        R.pct(F.coalesce(R.sum_where(F.col("a"), R.is_public_hospital(F.col("customer_name"))), F.lit(0.0)), F.sum("a")), 6)
        .alias("public_share_pct"))


def public_recovery(sales: DataFrame, names: DataFrame, k: int = 3) -> DataFrame:
    """Recent long-term exposure on public establishments and the largest debtors among them."""
    d = F.col("delay_days")
    per = (_recently_due(sales).groupBy("customer").agg(
        R.sum_where(F.col("ttc"), d > 60).alias("e60"), R.sum_where(F.col("ttc"), d > 90).alias("e90"),
        R.count_where(d > 60).alias("n60")).join(names, "customer", "left")
        .withColumn("public", R.is_public_hospital(F.col("customer_name"))))
    pub = F.col("public")
    tot = per.agg(F.sum("e60").alias("x"), R.sum_where(F.col("e60"), pub).alias("p"), R.sum_where(F.col("e90"), pub).alias("c"),
                  R.count_where(pub & (F.col("n60") > 0)).alias("customers"))
    top = (per.filter(pub & (F.col("e60") > 0)).orderBy(F.col("e60").desc(), "customer").limit(k)
           .select(F.lit("debtor").alias("line"), F.col("customer_name").alias("label"), F.round("e60", 2).alias("amount")))
    lines = tot.selectExpr("stack(4, 'exposure', '', round(x, 2), 'public', '', round(p, 2), 'critical', '', round(c, 2), "
                           "'customers', '', cast(customers as double)) as (line, label, amount)")
    return lines.unionByName(top)


def largest_customer(sales: DataFrame) -> DataFrame:
    return sales.groupBy("customer").agg(F.sum("ttc").alias("r")).orderBy(F.col("r").desc(), "customer").limit(1).select("customer")


def customer_invoices(sales: DataFrame, customer, k: int = 50) -> DataFrame:
    return (sales.filter(F.col("customer") == customer).orderBy(F.col("date").desc(), "ent_id").limit(k)
            .select("piece_no", "date", "due", F.round("ttc", 2).alias("ttc"), "is_credit", "delay_days"))


def customer_totals(sales: DataFrame, names: DataFrame, k: int = 100) -> DataFrame:
    g = sales.groupBy("customer").agg(F.sum("ttc").alias("r"), F.count(F.lit(1)).alias("documents"), F.max("date").alias("last_date"))
    return (g.orderBy(F.col("r").desc_nulls_last(), "customer").limit(k).join(names, "customer", "left")
            .select("customer", "customer_name", F.round("r", 2).alias("revenue"), "documents", "last_date"))
