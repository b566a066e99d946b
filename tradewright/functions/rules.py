"""Typing, cleaning and classification rules. Every rule is a built-in Column expression."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------- typing

def robust_date(col: Column) -> Column:
    """US month/day/year first, then ISO, then day/month/year; unreadable gives NULL.

    A pattern is tried only on texts that hold its separator: a failed reading costs many times a good one.
    """
    readings = [F.when(F.contains(col, F.lit(p.strip("dMy")[0])), F.try_to_timestamp(col, F.lit(p))) for p in ("M/d/yyyy", "yyyy-M-d", "d/M/yyyy")]
    return F.coalesce(*readings).cast("date")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def due_date(col: Column) -> Column:
    d = robust_date(col)
    return F.when(F.year(d).between(2000, 2035), d)


def amount(col: Column) -> Column:
    return col.try_cast("double")


def accounting_sign(signed: Column) -> Column:
    return F.when(amount(signed) < 0, F.lit(-1)).otherwise(F.lit(1))


def clean_text(col: Column) -> Column:
    t = F.trim(col)
    return F.when(~F.upper(t).isin("", "NULL"), t)


def _tidy_mode(col: Column) -> Column:
    one_space = F.regexp_replace(F.trim(col), r"\s+", " ")
    return F.regexp_replace(one_space, r"([0-9])(JOURS)", "$1 $2")


def _blank(col: Column) -> Column:
    return col.isNull() | F.upper(F.trim(col)).isin("", "NULL")


def mode_key(col: Column) -> Column:
    return F.when(_blank(col), F.lit("NON RENSEIGNE")).otherwise(F.upper(_tidy_mode(col)))


def mode_label(col: Column) -> Column:
    return F.when(_blank(col), F.lit("Non renseigné")).otherwise(_tidy_mode(col))


def format_valid(col: Column) -> Column:
    """Direction 1 (return) or 2 (sale); NULL stays NULL, meaning "not proven wrong"."""
    return F.trim(col).isin("1", "2")


# ---------------------------------------------------------------- time

def month_start(col: Column) -> Column:
    return F.trunc(col, "month")


def month_key(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def month_index(col: Column) -> Column:
    """Absolute month number; differences count month boundaries."""
    return F.year(col) * 12 + F.month(col) - 1


def sunday_zero(col: Column) -> Column:
    return F.dayofweek(col) - 1


# ---------------------------------------------------------------- arithmetic

def ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def pct(num: Column, den: Column) -> Column:
    return ratio(num * 100.0, den)


def sum_where(value: Column, cond: Column) -> Column:
    return F.sum(F.when(cond, value))


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


# ---------------------------------------------------------------- classes
# They must equal the published rules for the classes to agree.
PUBLIC_HOSPITAL_WORDS = ("C.H.U", "CHU", "HOPITAL", "HÔPITAL", "HOSPITAL",
                         "MILITAIRE", "INSTITUT", "CENTRE HOSPITALIER")
CLINIC_WORDS = ("CLINIQUE", "POLYCLINIQUE")
LABORATORY_WORDS = ("LABO", "LABORATOIRE", "ANALYSE", "BIOLOG")
PHARMACY_WORDS = ("PHARMACIE", "PHARMA")
OUT_OF_SCOPE_FAMILIES = "(^_)|PEINTURE|LITHOGRAPH|CHEVALET|PINCEAU|BROSSE|AQUARELLE|HUILE"
SERVICE_WORDS = ("(CONTRAT|MAINTENANCE|FORMATION|INSTALLATION|PRESTATION|FRAIS|TRANSPORT|"
                 "LOCATION|ABONNEMENT)")
SERVICE_LABEL = (r"(?i)\b(CONTRAT|MAINTENANCE|FORMATION|INSTALLATION|DEPLACEMENT|"
                 r"MAIN\s*D.?\s*OEUVRE|PRESTATION|FRAIS|TRANSPORT|LOCATION|ABONNEMENT|"
                 r"ETALONNAGE|QUALIFICATION|HOTLINE|ASSISTANCE)\b")
PART_LABEL = (r"(?i)\b(SEALS?|JOINT|UPGRADE|P\.?M\.?\s|PIECE|SPARE|TUBULURE|TUBING|FILTRE|FILTER|"
              r"CABLE|BATTERIE|LAMPE|CARTE\s+ELECTRO|ADAPTAT|SERINGUE\s+METAL|POMPE|VANNE|COURROIE|"
              r"FUSIBLE|CAPOT|SUPPORT\s+METAL|ECRAN|CLAVIER|ALIMENTATION\s+ELECT)")
EQUIPMENT_LABEL = (r"(?i)\b(AUTOMATE|ANALYZER|ANALYSEUR|SYSTEM|SYSTEME|INSTRUMENT|APPAREIL|MODULE|"
                   r"STATION|IMPRIMANTE|LECTEUR|CENTRIFUG|MICROSCOPE|ORDINATEUR|PC\b|AGITATEUR|ETUVE|"
                   r"BAIN\s+MARIE|CONGELATEUR|REFRIGERATEUR|INCUBATEUR|THERMOCYCLEUR|SPECTRO)")
CONSUMABLE_LABEL = (r"(?i)\b(REACTIF|REAGENT|TEST|TESTS|CONTROLE|CONTRÔLE|CALIBRA|QCV|DILLUANT|DILUANT|"
                    r"SOLUTION|GEL|SERUM|ANTISERUM|PANEL|KIT\s+DE\s+DOSAGE|CARTOUCHE|BANDELETTE|STRIP|"
                    r"MILIEU|GELOSE|AGAR|TUBE|CUVETTE|EMBOUT|CONE|PIPETTE|LAME|LAMELLE|POCHE|"
                    r"ANTIBIOGRAMME|VIDAS\s+[A-Z])")
FAMILY_CLASS_EXACT = {
    "REACTIF": "consumable", "REACTIFS": "consumable",
    "CONSOMMABLE": "consumable", "CONSOMMABLES": "consumable",
    "EQUIPEMENT": "equipment", "EQUIPEMENTS": "equipment",
    "INSTRUMENT": "equipment", "APPAREIL": "equipment",
    "PRESTATION": "service",
    "PIECE": "part", "PIECES": "part", "PIECE DETACHEE": "part", "PIECES DETACHEES": "part",
}
FAMILY_CLASS_PREFIX = (
    ("SERVICE", "service"), ("PRESTATION", "service"), ("CONTRAT", "service"),
    ("MAINTENANCE", "service"), ("REACTIF", "consumable"), ("CONSOMMABLE", "consumable"),
    ("EQUIPEMENT", "equipment"), ("PIECE", "part"),
)
DELAY_BANDS = ("cash", "1-30", "31-60", "61-90", "over 90")
AMOUNT_BANDS = ((500, "< 500"), (1000, "0.5-1K"), (5000, "1-5K"), (10000, "5-10K"), (50000, "10-50K"))
# end of fixed values


def contains_any(col: Column, words) -> Column:
    return reduce(or_, [F.upper(col).contains(w) for w in words])


def is_public_hospital(name: Column) -> Column:
    return F.coalesce(contains_any(name, PUBLIC_HOSPITAL_WORDS), F.lit(False))


def establishment_type(name: Column, with_pharmacy: bool = True) -> Column:
    out = (F.when(contains_any(name, PUBLIC_HOSPITAL_WORDS), "public_hospital")
           .when(contains_any(name, CLINIC_WORDS), "private_clinic")
           .when(contains_any(name, LABORATORY_WORDS), "laboratory"))
    if with_pharmacy:
        out = out.when(contains_any(name, PHARMACY_WORDS), "pharmacy")
    return out.otherwise("other")


def business_category(family: Column) -> Column:
    f = F.upper(F.trim(family))
    return (F.when(f.startswith("REACTIF"), "reagent")
            .when(f.startswith("EQUIPEMENT"), "equipment")
            .when(f.startswith("SERVICE") | f.startswith("PRESTATION"), "service")
            .otherwise("other"))


def usable_cost(cost: Column, revenue: Column) -> Column:
    return cost.isNotNull() & (F.abs(cost) <= 5 * F.abs(revenue))


def in_scope_family(family: Column) -> Column:
    return family.isNotNull() & (family != "") & ~F.upper(family).rlike(OUT_OF_SCOPE_FAMILIES)


def _family_class(family: Column) -> Column:
    f = F.upper(F.trim(family))
    out = F.when(F.lit(False), F.lit(""))
    for cls in ("consumable", "equipment", "service", "part"):
        out = out.when(f.isin([k for k, v in FAMILY_CLASS_EXACT.items() if v == cls]), cls)
    for prefix, cls in FAMILY_CLASS_PREFIX:
        out = out.when(f.startswith(prefix), cls)
    return out


def product_class(label: Column, family: Column) -> Column:
    """ERP family decides, a part label refines a consumable, label keywords are the fallback."""
    p, erp = F.trim(F.coalesce(label, F.lit(""))), _family_class(family)
    return (F.when((erp == "consumable") & p.rlike(PART_LABEL), "part")
            .when(erp.isNotNull(), erp)
            .when((p == "") | p.rlike(SERVICE_LABEL), "service")
            .when(p.rlike(PART_LABEL), "part")
            .when(p.rlike(EQUIPMENT_LABEL), "equipment")
            .otherwise("consumable"))


def product_class_origin(label: Column, family: Column) -> Column:
    p, erp = F.trim(F.coalesce(label, F.lit(""))), _family_class(family)
    keyword = reduce(or_, [p.rlike(r) for r in (SERVICE_LABEL, PART_LABEL, EQUIPMENT_LABEL, CONSUMABLE_LABEL)])
    return (F.when((erp == "consumable") & p.rlike(PART_LABEL), "erp_refined")
            .when(erp.isNotNull(), "erp")
            .when((p != "") & keyword, "keyword")
            .otherwise("default"))


def is_perishable(label: Column, family: Column) -> Column:
    return product_class(label, family) == "consumable"


def delay_band(delay: Column) -> Column:
    return (F.when(delay <= 0, DELAY_BANDS[0]).when(delay <= 30, DELAY_BANDS[1])
            .when(delay <= 60, DELAY_BANDS[2]).when(delay <= 90, DELAY_BANDS[3])
            .when(delay > 90, DELAY_BANDS[4]))


def amount_band(ttc: Column) -> Column:
    out = F.when(ttc < AMOUNT_BANDS[0][0], AMOUNT_BANDS[0][1])
    for limit, label in AMOUNT_BANDS[1:]:
        out = out.when(ttc < limit, label)
    return out.otherwise("50K +")


def quote_action(quote_amount: Column, probability: Column,
                 large: float = 20_000.0, likely: float = 0.25) -> Column:
    big, probable = quote_amount >= large, probability >= likely
    return (F.when(big & probable, "call").when(big, "tender_follow_up")
            .when(probable, "batch_reminder").otherwise("leave"))


def severity(stake: Column, annual_revenue: Column, high_share: float = 0.05) -> Column:
    unknown = annual_revenue.isNull() | (annual_revenue == 0) | (stake <= 0)
    return (F.when(unknown, "low")
            .when(ratio(stake, annual_revenue) >= high_share, "high").otherwise("medium"))


# ---------------------------------------------------------------- names and numbers
# Legal forms dropped from company names.
LEGAL_FORMS = r"\b(s\.?a\.?r\.?l|s\.?a|suarl|sarl|ste|societe|company|co|ltd|inc|group|groupe)\b"
# end of fixed values
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold_accents(col: Column) -> Column:
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), _ACCENTED, _PLAIN)


def normal_name(col: Column, drop_legal_forms: bool = True) -> Column:
    s = fold_accents(col)
    if drop_legal_forms:
        s = F.regexp_replace(s, LEGAL_FORMS, " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def normal_number(col: Column) -> Column:
    bare = F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), "[^A-Z0-9]", "")
    return F.ltrim(bare, F.lit("0"))


# ---------------------------------------------------------------- dashboard filters

@dataclass(frozen=True)
class Filters:
    """Dashboard filter set. Values are bound as literals, never spliced into text."""

    years: tuple[int, ...] = ()
    start: date | None = None
    end: date | None = None
    customers: tuple = ()
    modes: tuple[str, ...] = ()
    min_amount: float | None = None
    max_amount: float | None = None
    delay_level: str | None = None          # on_time | over_30 | over_90
    loyalty: str | None = None              # loyal | regular | occasional
    period: str = "12m"                     # 12m | year | all

    def predicate(self, day: str = "date", customer: str | None = "customer", mode: str | None = "mode",
                  total: str | None = "ttc", delay: str | None = "delay_days") -> Column:
        """Row predicate; pass None for a column the table does not carry."""
        d, terms = F.col(day), [F.lit(True)]
        if self.years:
            terms.append(F.year(d).isin(list(self.years)))
        if self.start:
            terms.append(d >= F.lit(self.start))
        if self.end:
            terms.append(d <= F.lit(self.end))
        if self.customers and customer:
            terms.append(F.col(customer).isin(list(self.customers)))
        if self.modes and mode:
            terms.append(F.col(mode).isin(list(self.modes)))
        if self.min_amount is not None and total:
            terms.append(F.col(total) >= self.min_amount)
        if self.max_amount is not None and total:
            terms.append(F.col(total) <= self.max_amount)
        if self.delay_level and delay:
            terms.append({"on_time": F.col(delay) <= 0, "over_30": F.col(delay) > 30,
                          "over_90": F.col(delay) > 90}[self.delay_level])
        return reduce(and_, terms)

    def month_predicate(self, month: str = "month", customer: str | None = "customer") -> Column:
        """Same filter on a 'yyyy-MM' month column (monthly tables)."""
        terms = [F.lit(True)]
        if self.years:
            terms.append(F.substring(month, 1, 4).cast("int").isin(list(self.years)))
        if self.start:
            terms.append(F.col(month) >= self.start.strftime("%Y-%m"))
        if self.end:
            terms.append(F.col(month) <= self.end.strftime("%Y-%m"))
        if self.customers and customer:
            terms.append(F.col(customer).isin(list(self.customers)))
        return reduce(and_, terms)


def loyalty_segment(df: DataFrame, segment: str | None, customer: str = "customer") -> DataFrame:
    """Keep customers whose document count falls in the segment."""
    if not segment:
        return df
    n = F.col("_n_docs")
    keep = {"loyal": n > 5, "regular": n.between(2, 5), "occasional": n == 1}[segment]
    members = df.groupBy(customer).agg(F.count(F.lit(1)).alias("_n_docs")).filter(keep).select(customer)
    return df.join(members, customer, "left_semi")
