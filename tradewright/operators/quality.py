"""Integrity, plausibility and profiling. A check is one row: check, level, value, status, description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar, top_k_per

FACTS = ("sales", "sales_lines", "purchases", "purchase_lines", "quotes", "deliveries")
DIM_KEYS = {"dim_customer": "code", "dim_product": "reference", "dim_supplier": "code", "dim_depot": "code",
            "dim_mode": "key", "dim_date": "date"}
REFERENCES = (("sales", "customer", "dim_customer"), ("sales", "mode_key", "dim_mode"), ("sales", "depot", "dim_depot"),
              ("sales_lines", "customer", "dim_customer"), ("sales_lines", "reference", "dim_product"),
              ("purchases", "supplier_code", "dim_supplier"), ("purchase_lines", "reference", "dim_product"),
              ("purchase_lines", "supplier_code", "dim_supplier"), ("quotes", "customer", "dim_customer"),
              ("deliveries", "customer", "dim_customer"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def check_row(df: DataFrame, name: str, level: str, value: Column, text: str) -> DataFrame:
    """One check from a global aggregate; errors and alerts pass when the value is zero."""
    v = F.coalesce(value.cast("double"), F.lit(0.0))
    return df.agg(v.alias("value")).select(
        F.lit(name).alias("check"), F.lit(level).alias("level"), "value",
        F.when((F.lit(level) == "info") | (F.col("value") == 0), "ok").otherwise(level).alias("status"),
        F.lit(text).alias("description"))


def volume_checks(fact: dict[str, DataFrame]) -> list[DataFrame]:
    return [check_row(fact[f], f"volume:{f}", "error", (F.count(F.lit(1)) == 0).cast("int"), f"{f} must not be empty") for f in FACTS]


def uniqueness_checks(dims: dict[str, DataFrame]) -> list[DataFrame]:
    return [check_row(dims[d].groupBy(k).count().filter("count > 1"), f"unique:{d}.{k}", "error", F.count(F.lit(1)),
                      f"values of {d}.{k} present more than once") for d, k in DIM_KEYS.items()]


def orphans(fact: DataFrame, col: str, dim: DataFrame, key: str) -> DataFrame:
    """Fact rows whose reference is missing, counted per value before the anti join."""
    used = fact.filter(F.col(col).isNotNull() & (F.col(col).cast("string") != "")).groupBy(F.col(col).alias(key)).agg(
        F.count(F.lit(1)).alias("n"))
    return used.join(dim.select(key), key, "left_anti")


def reference_checks(fact: dict[str, DataFrame], dims: dict[str, DataFrame]) -> list[DataFrame]:
    return [check_row(orphans(fact[f], c, dims[d], DIM_KEYS[d]), f"reference:{f}.{c}", "error", F.sum("n"),
                      f"rows of {f} whose {c} is absent from {d}") for f, c, d in REFERENCES]


def calendar_checks(fact: dict[str, DataFrame], dim_date: DataFrame) -> list[DataFrame]:
    return [check_row(orphans(fact[f], "date", dim_date, "date"), f"calendar:{f}.date", "alert", F.sum("n"),
                      f"rows of {f} dated outside the calendar") for f in FACTS]


def effect_checks(stg: dict[str, DataFrame], fact: dict[str, DataFrame], dims: dict[str, DataFrame]) -> list[DataFrame]:
    """What the rules did, so that gaps with the source can be read."""
    lines, heads, sales = fact["sales_lines"], stg["sales"], fact["sales"]
    n = F.count(F.lit(1))
    unreadable = F.col("date").isNull() | F.col("ttc_abs").isNull()
    kept = scalar(sales.agg(n))
    return [
        check_row(lines, "sales_lines_without_reference", "alert",
                  R.count_where(F.coalesce(F.col("reference"), F.lit("")) == ""), "sales lines attached to no product"),
        check_row(fact["sales_lines_rejected"], "sales_lines_rejected", "alert", n, "sales lines set aside for shifted columns"),
        check_row(heads, "sales:headers_read", "info", n, "sales headers read from the source"),
        check_row(heads, "sales:unreadable", "info", R.count_where(unreadable), "headers without readable date or amount"),
        check_row(heads.filter(~unreadable), "sales:duplicates_removed", "info", n - kept, "documents exported several times"),
        check_row(sales, "sales:credits", "info", R.count_where(F.col("is_credit")), "credit notes, deducted from revenue"),
        check_row(sales, "sales:total_ttc", "info", F.round(F.sum("ttc"), 2), "revenue net of credit notes"),
        check_row(dims["dim_customer"].filter("origin = 'inferred'"), "customers:inferred", "info", n,
                  "customers present in facts only"),
    ]


def warehouse_checks(stg, fact, dims) -> DataFrame:
    return _union(volume_checks(fact) + uniqueness_checks(dims) + reference_checks(fact, dims)
                  + calendar_checks(fact, dims["dim_date"]) + effect_checks(stg, fact, dims))


# ---------------------------------------------------------------- accounting identities and bounds

def identities(sales: DataFrame, purchases: DataFrame, margin: DataFrame, eps: float = 1.0) -> DataFrame:
    """Equalities that hold by construction, one row each."""
    billed = ~F.col("is_credit")

    def net(df, name):
        return df.agg(F.sum("ttc").alias("left"), (R.sum_where(F.col("ttc"), billed)
                      + F.coalesce(R.sum_where(F.col("ttc"), F.col("is_credit")), F.lit(0.0))).alias("right")) \
            .select(F.lit(name).alias("check"), "left", "right", F.lit(eps).alias("eps"))
    rows = sales.agg(F.count(F.lit(1)).cast("double").alias("left"),
                     (R.count_where(billed) + R.count_where(F.col("is_credit"))).cast("double").alias("right")) \
        .select(F.lit("sales.partition").alias("check"), "left", "right", F.lit(0.0).alias("eps"))
    m = margin.agg(F.sum("margin").alias("left"), (F.sum("revenue") - F.sum("cost")).alias("right")) \
        .select(F.lit("margin.definition").alias("check"), "left", "right", F.lit(eps).alias("eps"))
    gap = F.abs(F.col("left") - F.col("right"))
    return _union([net(sales, "sales.net"), rows, net(purchases, "purchases.net"), m]).select(
        "check", F.round("left", 1).alias("left"), F.round("right", 1).alias("right"), (gap <= F.col("eps")).alias("holds"))


# Plausible ranges of published indicators.
BOUNDS = (("credit_rate_pct", 0.0, 15.0), ("margin_rate_pct", 0.0, 80.0), ("ttc_ht_ratio", 1.0, 1.3), ("hhi", 0.0001, 10000.0),
          ("mean_granted_delay", -10.0, 400.0), ("mean_obtained_delay", -10.0, 400.0), ("mean_basket", 0.0, 1000000.0))
# end of fixed values


def plausibility(measures: DataFrame) -> DataFrame:
    """(metric, value) rows against the bounds table; an absent value is an alert."""
    bounds = measures.sparkSession.createDataFrame(list(BOUNDS), "metric string, low double, high double")
    eps = 1e-9 * F.greatest(F.lit(1.0), F.abs("low"), F.abs("high"))
    inside = F.col("value").between(F.col("low") - eps, F.col("high") + eps)
    return F.broadcast(bounds).join(measures, "metric", "left").select(
        "metric", F.round("value", 6).alias("value"), "low", "high", F.when(inside, "ok").otherwise("alert").alias("status"))


def dashboard_measures(sales: DataFrame, purchases: DataFrame, margin: DataFrame) -> DataFrame:
    t, billed, credit = F.col("ttc"), ~F.col("is_credit"), F.col("is_credit")
    s = sales.agg(R.pct(-R.sum_where(t, credit), R.sum_where(t, billed)).alias("credit_rate_pct"),
                  R.ratio(R.sum_where(t, billed), R.sum_where(F.col("ht"), billed)).alias("ttc_ht_ratio"),
                  F.avg(F.when(billed, F.col("delay_days"))).alias("mean_granted_delay"),
                  R.ratio(F.sum(t), R.count_where(billed)).alias("mean_basket"))
    p = purchases.agg(F.avg(F.when(billed, F.col("delay_days"))).alias("mean_obtained_delay"))
    m = margin.agg(R.pct(F.sum("margin"), F.sum("revenue")).alias("margin_rate_pct"))
    pos = sales.groupBy("customer").agg(F.sum("ttc").alias("r")).filter("r > 0")
    h = pos.agg((F.sum(F.col("r") * F.col("r")) * 10000 / (F.sum("r") * F.sum("r"))).alias("hhi"))

    def long(df):
        return df.selectExpr(f"stack({len(df.columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in df.columns)
                             + ") as (metric, value)")
    return _union([long(x) for x in (s, p, m, h)])


def sign_rules(sales: DataFrame, lines: DataFrame) -> DataFrame:
    a = sales.agg(R.count_where((F.col("ttc") < 0) & ~F.col("is_credit")).alias("v")).select(F.lit("negative_sale").alias("rule"), "v")
    b = lines.agg((R.count_where(F.col("amount") < 0) == 0).cast("long").alias("v")).select(F.lit("no_return_line").alias("rule"), "v")
    bands = (sales.filter(~F.col("is_credit")).groupBy(R.delay_band(F.col("delay_days")).alias("band"))
             .agg(F.sum("ttc").alias("t")).agg(R.count_where(F.col("t") < 0).alias("v"))
             .select(F.lit("negative_ageing_band").alias("rule"), "v"))
    return _union([a, b, bands]).select("rule", F.col("v").alias("violations"))


def header_line_reconciliation(sales: DataFrame, lines: DataFrame) -> DataFrame:
    """Header and line totals side by side, with the two tolerance rules."""
    h = sales.agg(F.sum("ht").alias("header_ht"), F.sum("ttc").alias("header_ttc")).withColumn("one", F.lit(1))
    both = lines.agg(F.sum("amount").alias("line_total")).withColumn("one", F.lit(1)).join(h, "one")
    gap = F.abs(F.col("line_total") - F.col("header_ht")) / F.greatest(F.abs("header_ht"), F.lit(1e-9)) * 100
    return both.select(F.round("header_ht", 1).alias("header_ht"), F.round("line_total", 1).alias("line_total"),
                       F.round(gap, 6).alias("gap_pct"), (gap > 15).alias("gap_alert"),
                       (F.col("line_total") > F.col("header_ttc") * 1.05).alias("lines_exceed_invoices"))


def implausible_values(sales: DataFrame, lines: DataFrame, due: DataFrame) -> DataFrame:
    """Unit price out of range, total under its net amount, due date before issue."""
    pu = F.try_divide(F.col("a"), F.col("q"))
    prices = (lines.filter("qty > 0 and amount > 0 and label <> ''").groupBy("label").agg(F.sum("amount").alias("a"), F.sum("qty").alias("q"))
              .agg(R.count_where((pu > 5000000) | (pu < 0.001)).alias("n")).select(F.lit("unit_price").alias("rule"), "n"))
    vat = sales.agg(R.count_where(F.abs("ttc") < F.abs("ht") - 0.01).alias("n")).select(F.lit("ttc_below_ht").alias("rule"), "n")
    early = due.agg(R.count_where(F.col("due") < F.col("date")).alias("n")).select(F.lit("due_before_issue").alias("rule"), "n")
    return _union([prices, vat, early])


def missing_months(df: DataFrame) -> DataFrame:
    """Calendar months without any row, between the first and the last."""
    months = df.filter(F.col("date").isNotNull()).select(R.month_start(F.col("date")).alias("month")).distinct()
    span = months.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    return grid.join(months, "month", "left_anti")


def yearly_collapse(sales: DataFrame, drop_pct: float = -60.0, floor: float = 0.02) -> DataFrame:
    """Year-on-year change with collapse alert; the running year and residual years are exempt."""
    y = sales.filter(~F.col("is_credit")).groupBy("year").agg(F.sum("ttc").alias("r"))
    w, whole = Window.orderBy("year"), Window.partitionBy()                     # one row per year
    x = y.select("year", "r", F.lag("r").over(w).alias("p"), F.sum("r").over(whole).alias("t"), F.max("year").over(whole).alias("last"))
    running, small = F.col("year") == F.col("last"), F.col("r") / F.col("t") < floor
    change = R.pct(F.col("r") - F.col("p"), F.col("p"))
    return x.select("year", F.round("r", 2).alias("revenue"), F.round(change, 6).alias("change_pct"),
                    F.coalesce(~running & ~small & (F.col("p") / F.col("t") >= floor) & (change < drop_pct), F.lit(False)).alias("collapse"),
                    (~running & ~small).alias("full_year"))


def verdict(levels: DataFrame) -> DataFrame:
    """Roll-up of check statuses: any error, else any alert, else ok."""
    e, a = R.count_where(F.col("status") == "error"), R.count_where(F.col("status") == "alert")
    return levels.agg(e.alias("errors"), a.alias("alerts"), F.count(F.lit(1)).alias("checks")).select(
        "errors", "alerts", "checks", F.when(F.col("errors") > 0, "error").when(F.col("alerts") > 0, "alert").otherwise("ok").alias("verdict"))


# ---------------------------------------------------------------- profiling

def _values(df: DataFrame) -> DataFrame:
    """(column, trimmed text value) rows, reduced to distinct values with their counts."""
    cols = df.columns
    pairs = ", ".join(f"'{c}', trim(cast(`{c}` as string))" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {pairs}) as (column, value)").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_profile(df: DataFrame) -> DataFrame:
    """Rows, missing rate, distinct count, inferred type and constant/empty flags of every column."""
    v = F.col("value")
    filled = v.isNotNull() & (v != "")
    is_num = F.regexp_replace(v, ",", "").try_cast("double").isNotNull()
    is_day = v.try_cast("date").isNotNull() & v.rlike("[-/]")
    p = _values(df).groupBy("column").agg(
        F.sum("n").alias("rows"), F.coalesce(R.sum_where(F.col("n"), ~filled | v.isNull()), F.lit(0)).alias("missing"),
        R.count_where(filled).alias("distinct"), R.count_where(filled & is_num).alias("_num"), R.count_where(filled & is_day).alias("_day"))
    kind = (F.when(F.col("distinct") == 0, "empty").when(F.col("_day") == F.col("distinct"), "date")
            .when(F.col("_num") == F.col("distinct"), "numeric").otherwise("string"))
    return p.select("column", "rows", "missing", F.round(R.ratio(F.col("missing"), F.col("rows")), 6).alias("missing_rate"), "distinct",
                    kind.alias("inferred_type"), (F.col("distinct") <= 1).alias("constant"))


def top_values(df: DataFrame, k: int = 5) -> DataFrame:
    filled = _values(df).filter("value is not null and value <> ''")
    return top_k_per(filled, ["column"], [F.col("n").desc(), F.col("value").asc()], k).select("column", "rank", "value", "n")


def table_profile(df: DataFrame) -> DataFrame:
    """Rows and rows repeated in full; copies are counted by a grouped aggregate."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("rows"), (F.sum("_n") - F.count(F.lit(1))).alias("duplicate_rows"))


def candidate_keys(df: DataFrame, floor: float = 0.4) -> DataFrame:
    """Columns, then pairs of high-cardinality columns, whose values identify every row."""
    cols = df.columns
    single = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(c)).alias(f"d_{c}") for c in cols],
                    *[F.count(c).alias(f"c_{c}") for c in cols]).first()
    n = single["n"]
    rows = [(c, "single") for c in cols if single[f"d_{c}"] == n == single[f"c_{c}"]]
    wide = [c for c in cols if n and single[f"d_{c}"] / n >= floor]
    pairs = [(a, b) for i, a in enumerate(wide) for b in wide[i + 1:]]
    if pairs:
        counts = df.agg(*[F.count_distinct(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        rows += [(f"{a} + {b}", "pair") for i, (a, b) in enumerate(pairs) if counts[f"p{i}"] == n]
    return df.sparkSession.createDataFrame(rows, "candidate_key string, kind string")


def inclusion(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """Share of each side's distinct values found on the other."""
    a = left.select(F.trim(F.col(left_col).cast("string")).alias("v")).filter("v is not null").distinct().withColumn("l", F.lit(1))
    b = right.select(F.trim(F.col(right_col).cast("string")).alias("v")).filter("v is not null").distinct().withColumn("r", F.lit(1))
    return a.join(b, "v", "full_outer").agg(
        F.count("l").alias("left_values"), F.count("r").alias("right_values"),
        R.count_where(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("common")).select(
        F.lit(f"{left_col} / {right_col}").alias("columns"), "left_values", "right_values", "common",
        F.round(R.ratio(F.col("common"), F.col("left_values")), 6).alias("left_ratio"),
        F.round(R.ratio(F.col("common"), F.col("right_values")), 6).alias("right_ratio"))


def class_coverage(products: DataFrame, value: str) -> DataFrame:
    """Share of products and of value per class and per origin of the class."""
    c = products.select(R.product_class(F.col("label"), F.col("family")).alias("class"),
                        R.product_class_origin(F.col("label"), F.col("family")).alias("origin"), F.col(value).alias("v"))
    g = c.groupBy("class", "origin").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
    w = Window.partitionBy()                                                     # at most classes x origins rows
    return g.select("class", "origin", F.col("n").alias("references"), F.round("v", 2).alias("value"),
                    F.round(R.pct(F.col("n"), F.sum("n").over(w)), 6).alias("references_pct"),
                    F.round(R.pct(F.col("v"), F.sum("v").over(w)), 6).alias("value_pct"))


def reader_accuracy(reviewed: DataFrame) -> DataFrame:
    """Field accuracy per reader from JSON of values read and of fields corrected."""
    m = "map<string,string>"
    fields = reviewed.select("reader", F.explode(F.from_json("read_json", m)).alias("field", "value"),
                             F.map_keys(F.from_json("corrections_json", m)).alias("fixed"))
    seen = fields.filter(F.col("value").isNotNull())
    return seen.groupBy("reader", "field").agg(
        F.count(F.lit(1)).alias("n"), R.count_where(F.array_contains("fixed", F.col("field"))).alias("corrected")).select(
        "reader", "field", "n", "corrected", F.round((1 - F.col("corrected") / F.col("n")) * 100, 6).alias("accuracy_pct"))
