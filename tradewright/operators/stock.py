"""Stock reconstructed from flows, historical positions and inventory-snapshot indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar, top_k_per

# ---------------------------------------------------------------- flows


def movement_flags(purchase_lines: DataFrame) -> DataFrame:
    """Share of service labels per value of the stock-movement indicator."""
    flag = F.coalesce(F.nullif(F.trim("stock_flag"), F.lit("")), F.lit("(empty)"))
    g = purchase_lines.filter("label <> ''").groupBy(flag.alias("flag"), "label").agg(F.count(F.lit(1)).alias("n"))
    s = g.groupBy("flag").agg(F.sum("n").alias("lines"), F.coalesce(R.sum_where(F.col("n"), F.col("label").rlike(R.SERVICE_LABEL)), F.lit(0)).alias("services"),
                              F.count(F.lit(1)).alias("labels"))
    return s.select("flag", "lines", "services", "labels", F.round(R.pct(F.col("services"), F.greatest("lines", F.lit(1))), 2).alias("service_pct"))


def movement_flag(purchase_lines: DataFrame, min_lines: int = 50) -> DataFrame:
    """The indicator value that really moves stock: the one with the lowest share of services."""
    ok = movement_flags(purchase_lines).filter((F.col("lines") >= min_lines) & (F.col("flag") != "(empty)"))
    return ok.orderBy("service_pct", "flag").limit(1).select("flag")


def purchase_flow(purchase_lines: DataFrame) -> DataFrame:
    moving = F.trim("stock_flag") == scalar(movement_flag(purchase_lines))
    return purchase_lines.filter((F.col("label") != "") & moving & F.col("qty").isNotNull()).withColumn("key", F.upper("label"))


def sales_flow(sales_lines: DataFrame) -> DataFrame:
    return sales_lines.filter((F.trim("label") != "") & (F.col("qty") > 0)).withColumn("key", F.upper(F.trim("label")))


def stock_flow(purchase_lines: DataFrame, sales_lines: DataFrame) -> DataFrame:
    """Quantities in and out, position, unit cost and monthly use per product."""
    a = purchase_flow(purchase_lines).groupBy("key").agg(
        F.min("label").alias("a_label"), F.sum("qty").alias("qi"), F.sum("amount").alias("ai"), F.max("date").alias("last_purchase"))
    vm = sales_flow(sales_lines).groupBy("key", R.month_index(F.col("date")).alias("m")).agg(
        F.min("label").alias("l"), F.min("family").alias("f"), F.sum("qty").alias("q"), F.sum("amount").alias("a"), F.max("date").alias("d"))
    v = vm.groupBy("key").agg(F.min("l").alias("v_label"), F.min("f").alias("family"), F.sum("q").alias("qo"), F.sum("a").alias("ao"),
                              F.max("d").alias("last_sale"), F.count(F.lit(1)).alias("am"))
    z = F.lit(0.0)
    j = a.join(v, "key", "full_outer")
    product = F.coalesce("a_label", "v_label")
    service = F.upper(product).rlike(R.SERVICE_WORDS) | (R.product_class(product, F.col("family")) == "service")
    return j.select("key", product.alias("product"), "family", F.coalesce("qi", z).alias("qty_in"), F.coalesce("qo", z).alias("qty_out"),
                    (F.coalesce("qi", z) - F.coalesce("qo", z)).alias("position"), F.coalesce("ai", z).alias("amount_in"),
                    F.coalesce("ao", z).alias("amount_out"), F.when(F.col("qi") > 0, F.col("ai") / F.col("qi")).alias("unit_cost"),
                    "last_purchase", "last_sale", F.coalesce("am", F.lit(0)).alias("active_months"),
                    F.when(F.col("am") > 0, F.col("qo") / F.col("am")).alias("monthly_use"),
                    (F.col("qi").isNotNull() & F.col("qo").isNotNull()).alias("matched"), service.alias("is_service"))


def flow_summary(flow: DataFrame) -> DataFrame:
    p, s = F.col("position"), F.col("is_service")
    held = (p > 0) & ~s
    slow = held & (F.col("monthly_use") > 0) & (p > 24 * F.col("monthly_use"))
    return flow.agg(F.count(F.lit(1)).alias("products"), R.count_where(F.col("matched")).alias("matched"), R.count_where(s).alias("services"),
                    R.count_where(held).alias("positive"), R.count_where((p < 0) & ~s).alias("negative"),
                    F.round(R.sum_where(p * F.col("unit_cost"), held), 2).alias("immobilised_value"),
                    F.round(R.sum_where(F.col("qty_out"), F.col("matched")), 2).alias("matched_volume"), F.round(F.sum("qty_out"), 2).alias("volume"),
                    R.count_where(slow).alias("over_two_years"))


def top_immobilised(flow: DataFrame, k: int = 12) -> DataFrame:
    ok = flow.filter((F.col("position") > 0) & ~F.col("is_service") & F.col("unit_cost").isNotNull() & (F.col("monthly_use") > 0))
    v = F.col("position") * F.col("unit_cost")
    return ok.orderBy(v.desc_nulls_last(), "key").limit(k).select(
        "product", F.round("position", 2).alias("position"), F.round(v, 2).alias("value"), F.round("monthly_use", 6).alias("monthly_use"),
        F.round(F.col("position") / F.col("monthly_use"), 6).alias("cover_months"))


def coverage_summary(flow: DataFrame) -> DataFrame:
    return flow.filter(~F.col("is_service")).agg(
        F.count(F.lit(1)).alias("products"), R.count_where(F.col("matched")).alias("matched"), R.count_where(F.col("position") < 0).alias("negative"),
        R.count_where(F.col("monthly_use") > 0).alias("with_use"), F.min("last_purchase").alias("first_purchase"), F.max("last_purchase").alias("last_purchase"),
        F.round(R.pct(R.count_where(F.col("matched")), F.count(F.lit(1))), 6).alias("matched_pct"))


def stockouts(flow: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Products still sold with less than `threshold` months of cover."""
    now = R.month_index(scalar(flow.agg(F.max("last_sale"))))
    cover = F.col("position") / F.col("monthly_use")
    live = flow.filter(~F.col("is_service") & (F.col("monthly_use") > 0) & F.col("last_purchase").isNotNull()
                       & (now - R.month_index(F.col("last_sale")) <= 3)).withColumn("cover", cover).filter(F.col("cover") < threshold)
    want = F.greatest(F.col("monthly_use") * 3 - F.greatest("position", F.lit(0.0)), F.lit(0.0))
    return live.select("product", F.round("position", 2).alias("position"), F.round("monthly_use", 6).alias("monthly_use"),
                       F.when(F.col("cover") >= 0, F.round("cover", 6)).alias("cover_months"),
                       (now - R.month_index(F.col("last_purchase"))).alias("months_without_purchase"), F.round("unit_cost", 6).alias("unit_cost"),
                       F.round(want, 4).alias("suggested_qty"),
                       F.when(F.col("cover") < 0, "probable_stockout").when(F.col("cover") < 1, "critical").otherwise("to_order").alias("severity"))


def obsolescence(flow: DataFrame, certain: Column | int = 24, probable: int = 12, floor: float = 100.0) -> DataFrame:
    """Perishables that will not be used up in time: excess quantity and probable loss."""
    certain = F.lit(certain) if isinstance(certain, int) else certain
    p, u = F.col("position"), F.col("monthly_use")
    months = p / u
    ok = flow.filter(~F.col("is_service") & (p > 0) & (u > 0) & F.col("unit_cost").isNotNull() & (months >= probable)
                     & R.is_perishable(F.col("product"), F.col("family")))
    sure = months >= certain
    excess = F.greatest(p - u * F.when(sure, certain).otherwise(F.lit(probable)), F.lit(0.0))
    return ok.withColumns({"cover_months": months, "excess_qty": excess, "loss": excess * F.col("unit_cost"),
                           "severity": F.when(sure, "near_certain_loss").otherwise("slow_rotation")}).filter(F.col("loss") >= floor)


def obsolescence_list(flow: DataFrame) -> DataFrame:
    return obsolescence(flow).select("product", F.round("position", 2).alias("position"), F.round("monthly_use", 6).alias("monthly_use"),
                                     F.round("cover_months", 6).alias("cover_months"), F.round("excess_qty", 4).alias("excess_qty"),
                                     F.round("loss", 2).alias("loss"), "severity")


def threshold_sensitivity(flow: DataFrame, thresholds=(18, 24, 30, 36), served: int = 24, k: int = 10) -> DataFrame:
    """Certain loss under other thresholds, and how many of the served top ten stay in the list."""
    grid = flow.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    sure = obsolescence(grid, F.col("threshold")).filter("severity = 'near_certain_loss'")
    total = sure.groupBy("threshold").agg(F.count(F.lit(1)).alias("products"), F.round(F.sum("loss"), 2).alias("loss"))
    top = top_k_per(sure, ["threshold"], [F.col("loss").desc(), F.col("key").asc()], k).select("threshold", "key")
    ref = top.filter(F.col("threshold") == served).select("key")
    common = top.join(ref, "key", "left_semi").groupBy("threshold").agg(F.count(F.lit(1)).alias("common"))
    n_ref = scalar(ref.agg(F.count(F.lit(1))))
    return total.join(common, "threshold", "left").select(
        "threshold", "products", "loss", F.coalesce("common", F.lit(0)).alias("common_with_served"),
        F.round(R.pct(F.coalesce("common", F.lit(0)), n_ref), 6).alias("common_pct"))


def monthly_positions(purchase_lines: DataFrame, sales_lines: DataFrame) -> DataFrame:
    """Dense product x month positions after the first purchase, for matched physical products."""
    month = R.month_start(F.col("date")).alias("month")
    a = purchase_flow(purchase_lines).groupBy("key", month).agg(F.sum("qty").alias("qi"), F.sum("amount").alias("ai"))
    v = sales_flow(sales_lines).groupBy("key", month).agg(F.sum("qty").alias("qo"), F.sum("amount").alias("ao"))
    flow = stock_flow(purchase_lines, sales_lines).filter(F.col("matched") & ~F.col("is_service")).select("key", "product", "unit_cost")
    span = a.select("month").union(v.select("month")).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    lo, hi = scalar(span.select("lo")), scalar(span.select("hi"))
    grid = flow.withColumns({"_lo": lo, "_hi": hi}).select("key", "product", "unit_cost", F.explode(
        F.sequence("_lo", "_hi", F.expr("interval 1 month"))).alias("month"))
    z = F.lit(0.0)
    j = grid.join(a, ["key", "month"], "left").join(v, ["key", "month"], "left").select(
        "key", "product", "unit_cost", "month", F.coalesce("qi", z).alias("qty_in"), F.coalesce("qo", z).alias("qty_out"),
        F.coalesce("ai", z).alias("amount_in"), F.coalesce("ao", z).alias("amount_out"))
    w = Window.partitionBy("key").orderBy("month")                               # at most one row per calendar month
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return j.withColumns({"cum_in": F.sum("qty_in").over(run), "cum_out": F.sum("qty_out").over(run),
                          "position": F.sum(F.col("qty_in") - F.col("qty_out")).over(run), "month_rank": F.row_number().over(w)}).filter("cum_in > 0")


# ---------------------------------------------------------------- demand statistics and policy
# Lead time (days), cover (days), shelf life (months) by family kind.
FAMILY_POLICY = (("REACTIF", 45, 60, 18, True), ("EQUIPEMENT", 75, 90, 0, False), ("CONSOMMABLE", 30, 45, 24, True), ("DEFAULT", 40, 60, 18, True))
Z_95 = 1.65
COST_SHARE = 0.72
# end of fixed values


def annual_demand(mart: DataFrame) -> DataFrame:
    """Mean, spread and last year of annual demand per product."""
    y = mart.filter("label is not null and qty > 0").groupBy("label", "year").agg(F.sum("qty").alias("q"), F.sum("revenue").alias("r"))
    g = y.groupBy("label").agg(F.sum("q").alias("qty"), F.avg("q").alias("mean_qty"), F.coalesce(F.stddev_samp("q"), F.lit(0.0)).alias("std_qty"),
                               F.count(F.lit(1)).alias("n_years"), F.max("year").alias("last_year"), R.ratio(F.sum("r"), F.sum("q")).alias("unit_price"))
    return g.filter("mean_qty >= 1")


def customer_product_demand(mart: DataFrame, names: DataFrame) -> DataFrame:
    n = names.filter("customer_name is not null and trim(customer_name) <> ''").groupBy("customer").agg(F.max("customer_name").alias("customer_name"))
    return mart.filter("qty > 0 and trim(label) <> ''").join(n, "customer").select(
        "customer", "customer_name", "label", "qty", F.round("revenue", 4).alias("revenue"), "n_years", F.round(R.ratio(F.col("revenue"), F.col("qty")) + 1e-9, 6).alias("unit_price"))


def policy_parameters(demand: DataFrame, kind: Column) -> DataFrame:
    """Daily demand and sigma, safety stock, reorder point and target level, with parameters by family kind."""
    params = demand.sparkSession.createDataFrame(list(FAMILY_POLICY), "kind string, lead_days int, cover_days int, shelf_months int, perishable boolean")
    day = F.col("mean_qty") / 365.0
    sigma = F.greatest(F.when(F.col("n_years") > 1, F.col("std_qty") / 365.0).otherwise(day * 0.35), day * 0.15)
    d = demand.withColumn("kind", F.when(kind.isin("REACTIF", "EQUIPEMENT", "CONSOMMABLE"), kind).otherwise("DEFAULT"))
    d = d.join(F.broadcast(params), "kind").withColumns({"daily_demand": day, "daily_sigma": sigma})   # four-row table
    d = d.withColumn("safety", Z_95 * F.col("daily_sigma") * F.sqrt("lead_days")).withColumn(
        "reorder_point", F.col("daily_demand") * F.col("lead_days") + F.col("safety"))
    return d.withColumns({"target": F.col("reorder_point") + F.col("daily_demand") * F.col("cover_days"),
                          "unit_cost": F.greatest(F.coalesce("unit_price", F.lit(0.0)), F.lit(0.0)) * COST_SHARE})


# ---------------------------------------------------------------- inventory snapshot

def snapshot_kpis(snap: DataFrame) -> DataFrame:
    s, d, t = F.col("stock"), F.col("daily_demand"), F.col("target")
    over = s > t
    a = snap.agg(F.count(F.lit(1)).alias("products"), F.sum("value").alias("v"), R.ratio(F.sum(s * d), F.sum(d)).alias("cover"),
                 R.count_where((s <= F.col("reorder_point")) & (t - s >= 1)).alias("to_order"), R.count_where((s < F.col("safety")) & (d > 0)).alias("below_safety"),
                 R.count_where((s <= 0) & (d > 0)).alias("stockouts"), R.count_where((s <= 0) & (d <= 0)).alias("dormant"), R.count_where(over).alias("overstock"),
                 R.sum_where(F.col("value"), over).alias("ov"), F.sum(d * 365 * F.col("unit_cost")).alias("annual"))
    rot = F.when(F.col("v") > 0, F.col("annual") / F.col("v")).otherwise(0.0)
    return a.select("products", F.round("v", 2).alias("value"), F.round("cover", 6).alias("weighted_cover"), "to_order", "below_safety", "stockouts", "dormant",
                    "overstock", F.round("ov", 2).alias("overstock_value"), F.round(rot, 6).alias("rotation"), F.round(R.ratio(F.lit(365.0), rot), 4).alias("stock_days"),
                    F.round(R.pct(F.col("products") - F.col("below_safety"), F.col("products")), 6).alias("service_rate_pct"))


def reorder_alerts(snap: DataFrame, k: int = 12) -> DataFrame:
    gap = F.greatest(F.lit(0.0), F.col("target") - F.col("stock"))
    left = F.when(F.col("daily_demand") > 0, F.greatest(F.lit(0.0), (F.col("stock") - F.col("safety")) / F.col("daily_demand")))
    ok = snap.filter((F.col("stock") <= F.col("reorder_point")) & (F.col("target") - F.col("stock") >= 1)).withColumns(
        {"days_left": F.round(left, 6), "order_value": F.round(gap * F.col("unit_cost"), 4), "order_qty": F.round(gap, 6)})
    return ok.orderBy(F.col("days_left").asc_nulls_first(), F.col("order_value").desc(), "product").limit(k).select(
        "product", "family", "order_qty", "days_left", "order_value", "lead_days")


def expiry_loss(snap: DataFrame, today: Column) -> DataFrame:
    """Quantity and value left over at expiry at the current pace."""
    left = F.datediff("expiry", today)
    lost = F.greatest(F.lit(0.0), F.col("stock") - F.col("daily_demand") * F.col("days_left"))
    return snap.filter(F.col("expiry").isNotNull()).withColumn("days_left", left).filter("days_left > 0").withColumns(
        {"lost_qty": lost, "loss": lost * F.col("unit_cost")})


def expiry_alerts(snap: DataFrame, today: Column, k: int = 12) -> DataFrame:
    e = expiry_loss(snap, today).filter("lost_qty > 0")
    return e.orderBy(F.col("loss").desc(), "product").limit(k).select("product", "family", "expiry", "days_left", F.round("lost_qty", 6).alias("lost_qty"), F.round("loss", 6).alias("loss"))


def snapshot_groups(snap: DataFrame) -> DataFrame:
    """By family and by situation, stacked."""
    cover = F.when(F.col("daily_demand") > 0, F.col("stock") / F.col("daily_demand"))

    def by(col):
        return snap.groupBy(F.lit(col).alias("axis"), F.col(col).alias("label")).agg(
            F.count(F.lit(1)).alias("products"), F.round(F.sum("value"), 4).alias("value"), F.round(F.avg(cover), 6).alias("mean_cover"))
    return by("family").unionByName(by("situation"))


def top_overstock(snap: DataFrame, k: int = 8) -> DataFrame:
    return snap.filter("stock > target").orderBy(F.col("value").desc(), "product").limit(k).select("product", F.round("value", 4).alias("value"))


def customer_exposure(snap: DataFrame, customers: DataFrame, min_products: int = 3) -> DataFrame:
    """Customers ranked by the state of their stock; the owner column holds a code or a name.

    The either-or match is two equality joins on pre-aggregated owners, never a disjunctive join.
    """
    def n(s):
        return R.count_where(F.col("situation") == s).alias(s)
    g = snap.groupBy("owner").agg(F.count(F.lit(1)).alias("products"), F.sum("value").alias("v"), n("stockout"), n("overstock"), n("to_order"), n("healthy"),
                                  F.coalesce(R.sum_where(F.col("value"), F.col("situation") == "overstock"), F.lit(0.0)).alias("ov")).filter(F.col("products") >= min_products)
    by_code = customers.select(F.col("customer").cast("string").alias("owner"), F.col("customer_name").alias("n1"))
    by_name = customers.groupBy(F.col("customer_name").alias("owner")).agg(F.max("customer_name").alias("n2"))
    risk = F.col("stockout") + F.col("overstock") + F.col("to_order")
    return g.join(by_code, "owner", "left").join(by_name, "owner", "left").select(
        "owner", F.coalesce("n1", "n2", "owner").alias("customer_name"), "products", F.round("v", 6).alias("value"), "stockout", "overstock", "to_order", "healthy",
        risk.alias("at_risk"), F.round("ov", 6).alias("overstock_value"), F.round(R.pct(F.col("healthy"), F.col("products")), 6).alias("healthy_pct"), (risk == 0).alias("no_risk"))


# ---------------------------------------------------------------- forward-looking labels

def risk_labels(history: DataFrame, snap: DataFrame, today: Column) -> DataFrame:
    """Stock-out, expiry and overstock labels from the future demand of each product-month."""
    s = snap.groupBy("product").agg(F.sum("stock").alias("stock"), F.avg("unit_cost").alias("unit_cost"), F.sum("value").alias("value"), F.min("expiry").alias("expiry"))
    j = history.join(s, "product").filter("future_qty is not null").withColumn("days", F.coalesce(F.datediff("expiry", today), F.lit(9999)))
    fut, st = F.col("future_qty"), F.col("stock")
    out, exp, over = fut > st, (F.col("days") <= 120) & (st > fut) & (st > 0), fut < st * 0.5
    kind = F.when(exp, "expiry").when(out, "stockout").when(over, "overstock").otherwise("none")
    stake = (F.when(exp, F.greatest(F.lit(0.0), st - fut) * F.col("unit_cost")).when(out, F.greatest(F.lit(0.0), fut - st) * F.col("unit_cost"))
             .otherwise(F.col("value") * 0.15))
    return j.select("product", "month", "stock", "future_qty", kind.alias("risk_type"), (out | exp | over).cast("int").alias("y"), stake.alias("exposure"))


def risk_band(score: Column) -> Column:
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


def risk_rollup(scored: DataFrame) -> DataFrame:
    """Impact by risk band and by type, stacked."""
    s = scored.withColumns({"impact": F.col("p") * F.col("exposure"), "band": risk_band(F.col("p") * 100)})

    def by(col):
        return s.groupBy(F.lit(col).alias("axis"), F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("products"), F.round(F.sum("impact"), 2).alias("impact"))
    return by("band").unionByName(by("risk_type"))
