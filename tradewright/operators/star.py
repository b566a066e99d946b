"""Conformed star schema: staging, facts, dimensions, marts and presentation views."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.scale import scalar
from tradewright.session import stored


class Frames(Mapping):
    """Named frames, each built when first asked for, so that a caller pays only for those it reads."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def kept(self) -> Frames:
        """The same frames, each stored when first asked for: for small ones read many times."""
        return Frames({n: lambda n=n: stored(self[n], n) for n in self})

# ---------------------------------------------------------------- staging (text in, typed out)


def stage(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Typed staging frames, one projection per source role; no business rule, no row lost."""
    c, t = F.col, F.trim

    def text(name):
        return t(c(name))

    def money(name):
        return R.amount(c(name))

    big = lambda name: c(name).try_cast("bigint")
    return {
        "sales": raw["sales_headers"].select(
            big("ENT_ID").alias("ent_id"), text("PIECENOFULL").alias("piece_no"), text("TIERS").alias("customer"),
            c("DATEPIECE").alias("raw_date"), R.robust_date(c("DATEPIECE")).alias("date"),
            R.due_date(c("DATEECHEANCE")).alias("due"), R.accounting_sign(c("MONTANTSIGNE_DEV")).alias("sign"),
            money("HT_DEV").alias("ht_abs"), money("TTC_DEV").alias("ttc_abs"),
            R.mode_key(c("MODEREGLLIBELLE")).alias("mode_key"), R.mode_label(c("MODEREGLLIBELLE")).alias("mode_label"),
            money("NBREARTICLE").alias("n_items"), R.clean_text(c("DEPOT")).alias("depot")),
        "sales_lines": raw["sales_lines"].select(
            big("MOUV_ID").alias("mouv_id"), text("NUMEROFULL").alias("piece_no"), text("TIERS").alias("customer"),
            text("REFERENCE").alias("reference"), text("DESIGNATION").alias("label"),
            text("ARTICLE_LIBELLE_FAM_STAT1").alias("family"), R.robust_date(c("DATEFACTURE")).alias("date"),
            money("MONTANTSIGNE_DEV").alias("amount"), money("QUANTITESIGNEE").alias("qty"), money("MTCRSIGNE").alias("cost"),
            R.format_valid(c("SENS")).alias("format_valid")),
        "purchases": raw["purchase_headers"].select(
            big("ENT_ID").alias("ent_id"), text("PIECENOFULL").alias("piece_no"), text("FOURNISSEURNOM").alias("supplier"),
            text("CLE_FOURNISSEUR").alias("supplier_code"), R.robust_date(c("DATEPIECE")).alias("date"),
            R.due_date(c("DATEECHEANCE")).alias("due"), R.accounting_sign(c("MONTANTSIGNE_DEV")).alias("sign"),
            money("HT_DEV").alias("ht_abs"), money("TTC_DEV").alias("ttc_abs"),
            money("MONTANTTVAFOURNISSEUR_DEV").alias("vat_abs"), text("MODEREGLLIBELLE").alias("mode"),
            F.nullif(text("PIECEEXTERNE"), F.lit("")).alias("external_no")),
        "purchase_lines": raw["purchase_lines"].select(
            big("MOUV_ID").alias("mouv_id"), text("NUMEROFULL").alias("piece_no"), text("CLE_FOURNISSEUR").alias("supplier_code"),
            text("REFERENCE").alias("reference"), text("DESIGNATION").alias("label"), text("INDICMVTSTOCK").alias("stock_flag"),
            R.robust_date(c("DATEFACTURE")).alias("date"), money("QUANTITESIGNEE").alias("qty"),
            money("MONTANTSIGNE_DEV").alias("amount")),
        "quotes": raw["quotes"].select(
            c("ENT_ID").alias("raw_ent_id"), big("ENT_ID").alias("ent_id"), text("PIECENOFULL").alias("piece_no"),
            text("TIERS").alias("customer"), c("DATEPIECE").alias("raw_date"), c("TTC_DEV").alias("raw_ttc"),
            R.robust_date(c("DATEPIECE")).alias("date"), R.accounting_sign(c("MONTANTSIGNE_DEV")).alias("sign"),
            money("HT_DEV").alias("ht_abs"), money("TTC_DEV").alias("ttc_abs"), text("STATUS").alias("status"),
            c("ETATPIECE").alias("state")),
        "deliveries": raw["deliveries"].select(
            text("ENT_CLIENT_CODE").alias("customer"), R.robust_date(c("ENT_DATE")).alias("date"),
            money("ENT_NBR_ARTICLE").alias("n_items")),
        "reference": raw["customer_reference"].select(
            text("ENT_CLIENT_CODE").alias("code"), text("ENT_CLIENT_INTITULE").alias("name"),
            text("ENT_CLIENT_VILLE").alias("city"), text("ENT_DEPOT_CODE").alias("depot_code"),
            text("ENT_DEPOT_INTITULE").alias("depot_label")),
        "suppliers": raw["suppliers"].select(
            text("CLE_FOURNISSEUR").alias("code"), R.clean_text(c("TIERS")).alias("party_code"),
            R.clean_text(c("NOMFOURNISSEUR")).alias("name"), R.clean_text(c("VILLE")).alias("city"),
            R.clean_text(c("PAYSLIBELLE")).alias("country")),
    }


# ---------------------------------------------------------------- deduplication

def document_key(piece: Column, technical_id: Column) -> Column:
    """Business number, or the technical id when the number is missing, so such rows never merge."""
    return F.when(piece.isNull() | (piece == ""), F.concat(F.lit("#"), technical_id.cast("string"))).otherwise(piece)


def first_copy(df: DataFrame, key: list[Column], order: str) -> DataFrame:
    """Lowest-id copy of each business key.

    Hashes of the keys are counted first: a row whose hash stands once has no copy and is not moved. The others
    go through a grouped minimum, which combines before the shuffle, so a key with very many copies costs one row
    per task instead of one huge window partition.
    """
    cols = df.columns
    names = [f"_k{i}" for i in range(len(key))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(key, names)]).withColumn("_h", F.xxhash64(*names))
    again = stored(keyed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_h"), "repeated-keys")
    if again.isEmpty():
        return df
    copies = keyed.join(again, "_h", "left_semi").select(F.struct(F.col(order).alias("_o"), *cols).alias("_row"), *names)
    first = copies.groupBy(*names).agg(F.min("_row").alias("_row")).select(*[F.col("_row")[c].alias(c) for c in cols])
    return keyed.join(again, "_h", "left_anti").select(*cols).unionByName(stored(first, "first-copies"))


def copies_kept(df: DataFrame, same: list[str], order: str, header_copies: DataFrame, doc: str) -> DataFrame:
    """Keep the first ceil(copies / header copies) of each group of identical lines.

    The lines are stored once with the copies of their header. Those of a header without copies are all kept and
    not grouped.
    """
    heads = stored(header_copies.filter("copies <> 1").withColumnRenamed("copies", "_h"), "header-copies")
    lines = stored(df.join(heads, doc, "left"), "lines")
    once = F.col("_h").isNull()
    return lines.filter(once).select(*df.columns).unionByName(stored(_first_copies(lines, ~once, same, order), "lines-of-copies").select(*df.columns))


def _first_copies(lines: DataFrame, copied: Column, same: list[str], order: str) -> DataFrame:
    """The first ceil(lines / _h) of each group of identical lines, among the copied ones.

    Groups keeping a single line (nearly all) are reduced with a grouped minimum. The rest are ranked
    in chunks of `order`, with per-chunk counts as offsets, so no group is ever ranked in one task.
    """
    df = lines.filter(copied)
    g = df.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.max("_h").alias("_copies"))
    g = g.withColumn("_keep", F.ceil(F.col("_n") / F.col("_copies")))
    null_safe = [F.col(f"l.{s}").eqNullSafe(F.col(f"g.{s}")) for s in same]
    whole = F.col("_keep") >= F.col("_n")
    tagged = df.alias("l").join(g.alias("g"), null_safe).select("l.*", "_n", "_keep", "_first", whole.alias("_whole"))
    simple = tagged.filter(F.col("_whole") | (F.col("_keep") == 1)).filter(
        F.col("_whole") | (F.col(order) == F.col("_first")))
    lo, hi = scalar(lines.agg(F.min(order))), scalar(lines.agg(F.max(order)))
    chunk_no = F.floor((F.col(order) - lo) / (hi - lo + 1) * 64).cast("int")
    part = tagged.filter(~F.col("_whole") & (F.col("_keep") > 1)).withColumn("_bucket", chunk_no)
    chunk = part.groupBy(*same, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*same).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    chunk = chunk.withColumn("_off", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    local = Window.partitionBy(*same, "_bucket").orderBy(order)
    ranked = part.withColumn("_r", F.row_number().over(local)).alias("p").join(
        chunk.alias("c"), [F.col(f"p.{s}").eqNullSafe(F.col(f"c.{s}")) for s in [*same, "_bucket"]]).select("p.*", "c._off")
    many = ranked.filter(F.col("_r") + F.col("_off") <= F.col("_keep"))
    return simple.select(*lines.columns).unionByName(many.select(*lines.columns))


def duplicate_groups(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """Audit of repeated keys: groups, rows beyond the first, and their amount."""
    g = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("v")).filter("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("extra_rows"),
                 F.round(F.sum(F.col("v") / F.col("n") * (F.col("n") - 1)), 2).alias("extra_amount"))


# ---------------------------------------------------------------- facts

def facts(stg: Mapping[str, DataFrame]) -> Frames:
    """Fact frames, built when read; what deduplication finds is stored once for all who read them."""
    c = F.col

    def signed():
        return [(c("ht_abs") * c("sign")).alias("ht"), (c("ttc_abs") * c("sign")).alias("ttc")]

    def sales():
        readable = stg["sales"].filter(c("date").isNotNull() & c("ttc_abs").isNotNull())
        first = first_copy(readable, [document_key(c("piece_no"), c("ent_id")), c("customer"), c("date"), c("ttc_abs")], "ent_id")
        return first.select("ent_id", "piece_no", "customer", "date", "due", *signed(), (c("sign") < 0).alias("is_credit"),
                            "mode_key", "n_items", "depot")

    def kept():
        dup = (stg["sales"].filter(c("ttc_abs").isNotNull() & (c("piece_no") != "")).groupBy("piece_no", "customer", "raw_date", "ttc_abs")
               .agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
               .groupBy("piece_no").agg(F.max("copies").alias("copies")))
        return copies_kept(stg["sales_lines"], ["piece_no", "customer", "date", "reference", "amount", "qty"], "mouv_id", dup, "piece_no")

    def purchases():
        buys = first_copy(stg["purchases"].filter(c("date").isNotNull()),
                          [document_key(c("piece_no"), c("ent_id")), c("supplier_code"), c("date"), c("ttc_abs")], "ent_id")
        return buys.select("ent_id", "piece_no", "supplier", "supplier_code", "date", "due", *signed(),
                           (c("sign") < 0).alias("is_credit"), "mode", (c("vat_abs") * c("sign")).alias("vat"), "external_no")

    def quotes():
        first = first_copy(stg["quotes"].filter(c("date").isNotNull()),
                           [F.when(c("piece_no") == "", c("raw_ent_id")).otherwise(c("piece_no")), c("customer"), c("raw_date"),
                            c("raw_ttc")], "ent_id")
        return first.select("customer", "piece_no", "date", *signed(), "status", "state",
                            F.coalesce(c("state") == "8", F.lit(False)).alias("converted"))

    lines = Frames({"kept": kept})
    return Frames({
        "sales": sales,
        "sales_lines": lambda: lines["kept"].filter(F.coalesce(c("format_valid"), F.lit(True))),
        "sales_lines_rejected": lambda: lines["kept"].filter(~c("format_valid")),
        "purchases": purchases,
        "purchase_lines": lambda: stg["purchase_lines"],
        "quotes": quotes,
        "deliveries": lambda: stg["deliveries"],
    })


# ---------------------------------------------------------------- dimensions

def most_frequent(df: DataFrame, key: str, label: str, by: Column | None = None) -> DataFrame:
    """Most frequent (or heaviest) non-null label per key; ties go to the first in alphabetical order."""
    weight = F.count(F.lit(1)) if by is None else F.sum(by)
    g = df.filter(F.col(label).isNotNull()).groupBy(key, label).agg(weight.alias("_w"))
    return g.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_w"), F.col(label))).alias(label))


def present(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def inferred(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Members referenced by facts but absent from the reference table."""
    return present(seen, key).join(known, key, "left_anti")


def product_dimension(sold: DataFrame, bought: DataFrame) -> DataFrame:
    """Lines are counted once by reference, label and family; labels and families are chosen from the counts."""
    n = F.count(F.lit(1)).alias("_n")
    s = stored(present(sold, "reference").groupBy("reference", "label", "family").agg(n), "sold-labels")
    b = stored(present(bought, "reference").groupBy("reference", "label").agg(n), "bought-labels")
    left = most_frequent(s, "reference", "label", F.col("_n")).join(most_frequent(s, "reference", "family", F.col("_n")), "reference", "full_outer")
    left = s.select("reference").distinct().join(left, "reference", "left").withColumn("sold", F.lit(True))
    right = most_frequent(b, "reference", "label", F.col("_n")).withColumnRenamed("label", "bought_label")
    right = b.select("reference").distinct().join(right, "reference", "left").withColumn("bought", F.lit(True))
    return left.join(right, "reference", "full_outer").select(
        "reference", F.coalesce("label", "bought_label").alias("label"), "family",
        F.coalesce("sold", F.lit(False)).alias("sold"), F.coalesce("bought", F.lit(False)).alias("bought"))


def calendar(*dates: DataFrame, low: int = 2000, high: int = 2035) -> DataFrame:
    """Continuous daily calendar over plausible fact dates (one row per day, so bounded); each frame is read once for all its columns."""
    def bounds(d):
        plausible = [F.when(F.year(x).between(low, high), F.col(x)) for x in d.columns]
        return d.agg(F.least(*[F.min(x) for x in plausible], F.lit(None)).alias("lo"), F.greatest(*[F.max(x) for x in plausible], F.lit(None)).alias("hi"))
    per = [bounds(d) for d in dates]
    span = per[0]
    for p in per[1:]:
        span = span.unionByName(p)
    days = span.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("date"))
    d = F.col("date")
    return days.select("date", F.year(d).alias("year"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
                       R.sunday_zero(d).alias("dow"), R.month_key(d).alias("month_key"), F.weekofyear(d).alias("iso_week"),
                       R.sunday_zero(d).isin(0, 6).alias("weekend"))


def dimensions(stg: Mapping[str, DataFrame], fact: Mapping[str, DataFrame], imported: DataFrame | None = None) -> Frames:
    """Dimension frames, built when read."""
    c, lit, f = F.col, F.lit, fact

    def none(name):
        return lit(None).cast("string").alias(name)

    def customers():
        ref = present(stg["reference"], "code")
        known = ref.select("code").distinct()
        erp = (known.join(most_frequent(ref, "code", "name"), "code", "left").join(most_frequent(ref, "code", "city"), "code", "left")
               .withColumn("origin", lit("erp")))
        if imported is not None:
            new = inferred(known, imported.filter(F.coalesce(c("side"), lit("sale")) == "sale").select(
                c("customer_code").alias("code"), "customer_name"), "code")
            erp = erp.unionByName(new.groupBy("code").agg(F.max("customer_name").alias("name")).select(
                "code", "name", none("city"), lit("imported").alias("origin")))
        seen = f["sales"].select(c("customer").alias("code"))
        for other in ("sales_lines", "quotes", "deliveries"):
            seen = seen.union(f[other].select("customer"))
        extra = inferred(erp.select("code"), seen.distinct(), "code").select(
            "code", c("code").alias("name"), none("city"), lit("inferred").alias("origin"))
        return erp.unionByName(extra)

    def suppliers():
        sup = present(stg["suppliers"], "code").groupBy("code").agg(*[F.min(x).alias(x) for x in ("party_code", "name", "city", "country")])
        seen = f["purchases"].select(c("supplier_code").alias("code"), c("supplier").alias("name")).unionByName(
            f["purchase_lines"].select(c("supplier_code").alias("code"), none("name")))
        extra = inferred(sup.select("code"), seen.groupBy("code").agg(F.max("name").alias("name")), "code").select(
            "code", none("party_code"), "name", none("city"), none("country"), lit("inferred").alias("origin"))
        return sup.withColumn("origin", lit("erp")).unionByName(extra)

    def depots():
        known = present(stg["reference"], "depot_code").select(c("depot_code").alias("code"), c("depot_label").alias("label"))
        dep = known.select("code").distinct().join(most_frequent(known, "code", "label"), "code", "left").withColumn("origin", lit("erp"))
        extra = inferred(dep.select("code"), f["sales"].select(c("depot").alias("code")).distinct(), "code").select(
            "code", c("code").alias("label"), lit("inferred").alias("origin"))
        return dep.unionByName(extra)

    def modes():
        return most_frequent(stg["sales"], "mode_key", "mode_label").select(c("mode_key").alias("key"), c("mode_label").alias("label"))

    def days():
        return calendar(f["sales"].select("date", "due"), f["sales_lines"].select("date"), f["purchases"].select("date", "due"),
                        f["purchase_lines"].select("date"), f["quotes"].select("date"), f["deliveries"].select("date"))

    return Frames({"dim_customer": customers, "dim_product": lambda: product_dimension(f["sales_lines"], f["purchase_lines"]),
                   "dim_supplier": suppliers, "dim_depot": depots, "dim_mode": modes, "dim_date": days})


# ---------------------------------------------------------------- marts

def mart_sales_product(lines: DataFrame) -> DataFrame:
    return (lines.filter(F.col("label").isNotNull() & (F.col("label") != "")).groupBy("label", F.year("date").alias("year"))
            .agg(F.sum("amount").alias("revenue"), F.sum("qty").alias("qty"), R.count_where(F.col("amount") >= 0).alias("n_lines"),
                 R.count_where(F.col("amount") < 0).alias("n_returns")))


def mart_sales_family(lines: DataFrame) -> DataFrame:
    return (lines.filter(R.in_scope_family(F.col("family"))).groupBy("family", F.year("date").alias("year"))
            .agg(F.sum("amount").alias("revenue"), F.sum("qty").alias("qty")))


def mart_demand_customer_product(lines: DataFrame) -> DataFrame:
    """Net demand; the (customer, product, year) pre-step turns the distinct count into a count."""
    kept = present(lines.filter(F.col("customer").isNotNull()), "label")
    y = kept.groupBy("customer", "label", F.year("date").alias("y")).agg(F.sum("qty").alias("q"), F.sum("amount").alias("r"))
    return (y.groupBy("customer", "label").agg(F.sum("q").alias("qty"), F.sum("r").alias("revenue"), F.count("y").alias("n_years"))
            .filter("qty > 0"))


def costed_lines(lines: DataFrame) -> DataFrame:
    a, k = F.col("amount"), F.col("cost")
    return lines.filter(F.col("customer").isNotNull() & a.isNotNull() & (a != 0) & R.usable_cost(k, a))


def _margin_measures():
    return [F.sum("amount").alias("revenue"), F.sum("cost").alias("cost"), (F.sum("amount") - F.sum("cost")).alias("margin"),
            R.count_where(F.col("amount") >= 0).alias("n_lines"), R.count_where(F.col("amount") < 0).alias("n_returns")]


def mart_margin_customer_month(lines: DataFrame) -> DataFrame:
    d = F.col("date")
    return costed_lines(lines).groupBy("customer", F.year(d).alias("year"), R.month_key(d).alias("month")).agg(*_margin_measures())


def mart_margin_category_month(lines: DataFrame) -> DataFrame:
    d = F.col("date")
    return (costed_lines(lines).groupBy("customer", R.business_category(F.col("family")).alias("category"), F.year(d).alias("year"),
                                        R.month_key(d).alias("month")).agg(*_margin_measures()).drop("n_returns"))


def mart_margin_product(lines: DataFrame) -> DataFrame:
    """Reference x customer x month, with the most frequent label and category of the group."""
    d, key = F.col("date"), ["reference", "customer", "year", "month"]
    c = costed_lines(lines).filter(F.col("reference").isNotNull()).withColumns(
        {"year": F.year(d), "month": R.month_key(d), "category": R.business_category(F.col("family"))})
    fine = c.groupBy(*key, "label", "category").agg(F.sum("amount").alias("revenue"), F.sum("cost").alias("cost"),
                                                   F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n"),
                                                   R.count_where(F.col("amount") >= 0).alias("n_lines"))
    return fine.groupBy(*key).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"),
        F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("category"),
        F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), (F.sum("revenue") - F.sum("cost")).alias("margin"),
        F.sum("qty").alias("qty"), F.sum("n_lines").alias("n_lines"))


def mart_margin_quality(lines: DataFrame) -> DataFrame:
    a, k = F.col("amount"), F.col("cost")
    bad, free = (a != 0) & (F.abs(k) > 5 * F.abs(a)), (a == 0) & (k > 0)
    zero = F.lit(0.0)
    return lines.agg(R.count_where(bad).alias("excluded_lines"), R.count_where(a > 0).alias("billed_lines"),
                     R.count_where(a < 0).alias("return_lines"), F.coalesce(R.sum_where(a, a < 0), zero).alias("return_amount"),
                     F.coalesce(R.sum_where(a, bad), zero).alias("excluded_amount"), R.count_where(free).alias("free_lines"),
                     F.coalesce(R.sum_where(k, free), zero).alias("free_cost"))


def marts(lines: DataFrame) -> dict[str, DataFrame]:
    return {"mart_sales_product": mart_sales_product(lines), "mart_sales_family": mart_sales_family(lines),
            "mart_demand_customer_product": mart_demand_customer_product(lines),
            "mart_margin_customer_month": mart_margin_customer_month(lines), "mart_margin_quality": mart_margin_quality(lines),
            "mart_margin_category_month": mart_margin_category_month(lines), "mart_margin_product": mart_margin_product(lines)}


# ---------------------------------------------------------------- presentation

def presented_sales(sales: DataFrame, dim_customer: DataFrame, dim_mode: DataFrame) -> DataFrame:
    """Sales with mode label, delay in days and customer name (code when unnamed); one dimension row per code."""
    c = F.col
    names = dim_customer.groupBy(c("code").alias("customer")).agg(F.max("name").alias("n"))
    modes = dim_mode.select(c("key").alias("mode_key"), c("label").alias("mode_label"))
    out = sales.join(modes, "mode_key", "left").join(names, "customer", "left")
    return out.select("ent_id", "piece_no", "customer", "date", "due", "ht", "ttc", "is_credit",
                      F.coalesce("mode_label", F.lit("Non renseigné")).alias("mode"), "n_items", F.year("date").alias("year"),
                      F.datediff("due", "date").alias("delay_days"),
                      F.coalesce(F.nullif("n", F.lit("")), c("customer")).alias("customer_name"))


def presented_purchases(purchases: DataFrame) -> DataFrame:
    return purchases.withColumns({"year": F.year("date"), "delay_days": F.datediff("due", "date")})
