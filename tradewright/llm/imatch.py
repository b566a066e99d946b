"""I-Match fingerprints: hashes of the terms within a band of document frequency, over randomised subsets of that lexicon.

A document's terms within the band are sorted by hash and hashed once whole and once for each of `FAMILIES` parts into which
the lexicon is dealt at random. A family numbers its terms by their hashes; its subsets are the terms below a power of two, each
half of the one above. Of these nested subsets the smallest that holds a term of the document is hashed, so a text of thirty
terms and one of twenty thousand are both described by a few terms for each family. Where two texts differ in no term
of that subset they have the same hash: families agree in about the share of terms that the texts have in common.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import carried, lower_ascii, text_or_empty
from tradewright.session import stored

#: A term counts if between 1 in RAREST and 1 in COMMONEST of all documents hold it.
RAREST, COMMONEST = 1000, 8
FAMILIES, DIGITS, WIDTH = 8, 4, 16
PARTS = 1 + FAMILIES
NO_TERM = "0" * WIDTH
#: A lexicon of up to this many terms is handed to the tasks; a larger one is joined, with the same result.
HANDED = 50_000
NOT_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text: runs of digits, ASCII letters and characters beyond ASCII, A-Z as a-z."""
    return F.array_remove(F.array_distinct(F.split(lower_ascii(text), NOT_TERM)), "")


def band_lexicon(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST) -> DataFrame:
    """(term) held by at least 1 in `rarest` and at most 1 in `commonest` of all rows."""
    counts = docs.select(F.explode(terms_of(text_or_empty())).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = docs.agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.where((F.col("n") * rarest >= total) & (F.col("n") * commonest <= total)).select("term")


class Band:
    """Keeps of an array of terms those of a lexicon, all of them if none is in it."""

    def __init__(self, lexicon: DataFrame, handed: int = HANDED) -> None:
        self.lexicon = stored(lexicon, "lexicon")
        size = self.lexicon.count()
        self.slots = 0 if size > handed else max(16, size // 2)
        if self.slots:
            slots: list[list[str]] = [[] for _ in range(self.slots)]
            for row in self.lexicon.select(self._slot(F.col("term")).alias("slot"), "term").collect():          # at most `handed` terms
                slots[row.slot].append(row.term)
            self.table = F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<array<string>>")      # folded to a literal once

    def _slot(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.slots))

    def keep(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """`df` with the terms of its column `text` that are in the band."""
        df = df.withColumn(out, terms_of(F.col(text)))
        if self.slots:
            inside = F.filter(out, lambda t: F.array_contains(F.element_at(self.table, (self._slot(t) + 1).cast("int")), t))
            return df.withColumn("__tw_in", inside).withColumn(out, F.when(F.size("__tw_in") > 0, F.col("__tw_in")).otherwise(F.col(out))).drop("__tw_in")
        # equal texts have equal terms, so a text is looked up under its hash
        df = df.withColumn("__tw_1", F.xxhash64(text)).withColumn("__tw_2", F.xxhash64(F.lit(11), F.col(text)))
        met = (df.select("__tw_1", "__tw_2", F.explode(out).alias("term")).distinct().join(self.lexicon, "term")
               .groupBy(F.col("__tw_1").alias("__tw_3"), F.col("__tw_2").alias("__tw_4")).agg(F.collect_set("term").alias("__tw_in")))
        joined = df.join(met, (F.col("__tw_1") == F.col("__tw_3")) & (F.col("__tw_2") == F.col("__tw_4")), "left")
        return joined.withColumn(out, F.coalesce("__tw_in", out)).drop("__tw_1", "__tw_2", "__tw_3", "__tw_4", "__tw_in")


def _hash(prefix: Column, keyed: Column | str) -> Column:
    return F.substring(F.md5(F.concat(prefix, F.array_join(keyed, " ")).cast("binary")), 1, WIDTH)


def _subset_bound(lowest: Column) -> Column:
    """The largest hexadecimal number with as many binary digits as the given one."""
    rest = F.ltrim(lowest, F.lit("0"))
    first = F.translate(F.substring(rest, 1, 1), "245689abcde", "3777fffffff")
    return F.concat(F.repeat(F.lit("0"), F.lit(DIGITS) - F.length(rest)), first, F.repeat(F.lit("f"), F.length(rest) - 1))


def _hashed(df: DataFrame, terms: str, out: str) -> DataFrame:
    """The array of terms gives way to the fingerprint `out`. A term's key is its family's digit, the rest of its hash and the term."""
    key = lambda t: F.concat(F.translate(F.substring(F.md5(t.cast("binary")), 1, 1), "89abcdef", "01234567"), F.substring(F.md5(t.cast("binary")), 2, 31), t)
    starts = lambda f: lambda k: k.startswith(str(f))
    within = lambda f: lambda k: k < F.col(f"__tw_to{f}")
    plain = [F.col(f"`{c}`") for c in df.columns if c not in (terms, out)]
    df = df.select(*plain, F.sort_array(F.transform(terms, key)).alias("__tw_held"))
    df = df.select(*plain, _hash(F.lit(""), "__tw_held").alias("__tw_all"), F.size("__tw_held").alias("__tw_n"),
                   *[F.filter("__tw_held", starts(f)).alias(f"__tw_of{f}") for f in range(FAMILIES)])
    # the next letter after f closes the numbers up to the bound
    bounds = [F.concat(F.lit(str(f)), _subset_bound(F.substring(F.get(f"__tw_of{f}", F.lit(0)), 2, DIGITS)), F.lit("g")) for f in range(FAMILIES)]
    df = df.select("*", *[to.alias(f"__tw_to{f}") for f, to in enumerate(bounds)])
    parts = [F.coalesce(_hash(F.col(f"__tw_to{f}"), F.filter(f"__tw_of{f}", within(f))), F.lit(NO_TERM)) for f in range(FAMILIES)]
    return df.select(*plain, F.when(F.col("__tw_n") == 0, NO_TERM * PARTS).otherwise(F.concat("__tw_all", *parts)).alias(out))


def fingerprint(df: DataFrame, band: Band, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """`df` with the fingerprint of a text column: `PARTS` hashes of `WIDTH` hexadecimal digits, whole lexicon first, then by family.

    Only terms of the band count; a text without any is hashed over all its terms. Null and texts without a term have
    the fingerprint of no term. The fingerprint depends on the text alone, so equal texts have equal ones. An empty table
    gives no rows; other columns are carried along.
    """
    filled = df.withColumn("__tw_text", text_or_empty(text))
    return _hashed(band.keep(filled, "__tw_text", "__tw_terms"), "__tw_terms", out).drop("__tw_text")


def likeness(a: Column, b: Column) -> Column:
    """The share of the hashes on which two fingerprints agree, of those over a term of either; 1 if neither has a term."""
    part = lambda c, i: F.substr(c, i * WIDTH + 1, F.lit(WIDTH))
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    held = F.filter(every, lambda i: (part(a, i) != NO_TERM) | (part(b, i) != NO_TERM))
    agree = F.filter(every, lambda i: (part(a, i) != NO_TERM) & (part(a, i) == part(b, i)))
    return F.when(F.size(held) == 0, 1.0).otherwise(F.size(agree).cast("double") / F.greatest(F.size(held), F.lit(1)))


def with_next(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Each row with columns of the row that follows by ascending doc_id (null last), the first row following the last.

    Rows of one doc_id stand in the order of their texts' hashes. Rows are dealt into bins of neighbouring ids, an
    id with many rows into several; the first row of a bin visits the bin before it, so no order runs over all rows.
    """
    n_bins = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(1e300))
    cuts = docs.select(place.alias("place")).stat.approxQuantile("place", [i / n_bins for i in range(1, n_bins)], 0.25 / n_bins)
    bounds = F.lit(cuts).cast("array<double>")
    below, upto = F.size(F.filter(bounds, lambda c: c < F.col("__tw_place"))), F.size(F.filter(bounds, lambda c: c <= F.col("__tw_place")))
    share = F.col("__tw_h").cast("double") / F.lit(2.0 ** 64) + 0.5
    placed = (docs.withColumn("__tw_place", place).withColumn("__tw_h", F.xxhash64(text_or_empty()))
              .withColumn("__tw_below", below).withColumn("__tw_upto", upto)
              .withColumn("__tw_bin", F.least(F.col("__tw_upto"), F.col("__tw_below") + F.floor((F.col("__tw_upto") - F.col("__tw_below") + 1) * share)).cast("int"))
              .drop("__tw_below", "__tw_upto", "__tw_place"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("__tw_h"))
    firsts = placed.groupBy("__tw_bin").agg(F.min(key).alias("first"))
    before = Window.orderBy("__tw_bin")                                          # one row for each bin
    firsts = firsts.select(F.col("first.doc_id").alias("__tw_first"), F.col("first.__tw_h").alias("__tw_first_h"),
                           F.coalesce(F.lag("__tw_bin").over(before), F.last("__tw_bin").over(before.rowsBetween(0, Window.unboundedFollowing))).alias("__tw_to"))
    known = placed.join(F.broadcast(stored(firsts, "bin-firsts")), F.col("doc_id").eqNullSafe(F.col("__tw_first")) & (F.col("__tw_h") == F.col("__tw_first_h")), "left")
    own = F.struct(F.col("__tw_bin").alias("bin"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("__tw_to").alias("bin"), F.lit(True).alias("guest"))
    sent = known.select(*docs.columns, "__tw_h", F.explode(F.when(F.col("__tw_to").isNull(), F.array(own)).otherwise(F.array(own, visit))).alias("__tw_at"))
    w = Window.partitionBy("__tw_at.bin").orderBy("__tw_at.guest", F.asc_nulls_last("doc_id"), "__tw_h")
    led = sent.select(*docs.columns, "__tw_at", *[F.lead(c).over(w).alias(name) for c, name in columns.items()])
    return led.where(~F.col("__tw_at.guest")).drop("__tw_at")


def edited_copies(docs: DataFrame, rarest: int = RAREST, commonest: int = COMMONEST, handed: int = HANDED) -> DataFrame:
    """The documents with `n_chars`, `fingerprint`, `edited_text`, `edited_fingerprint`, `near_edited` and `near_next`.

    The edited text is the first ceil(n_chars / 2) code points and then the first floor(n_chars / 2), or all, of the text of the next
    document in ascending doc_id; the first follows the last. Null texts count as empty. A null doc_id comes last, and rows of one
    doc_id follow each other by a hash of their texts, so of equal rows each but the last has its twin as the next. A single row
    is its own next. An empty table gives no rows; extra columns are carried along, but one named like a result gives way to it.
    """
    made = ("n_chars", "fingerprint", "edited_text", "edited_fingerprint", "near_edited", "near_next")
    if not docs.take(1):
        empty = {"n_chars": "long", "near_edited": "double", "near_next": "double"}
        return docs.select(*carried(docs, *made), *[F.lit(None).cast(empty.get(c, "string")).alias(c) for c in made]).where("false")
    band = Band(band_lexicon(docs, rarest, commonest), handed)
    own = fingerprint(docs.select(*carried(docs, *made)), band, "text", "__tw_own").withColumn("__tw_own", F.unhex("__tw_own"))
    led = with_next(own, {"text": "__tw_next_text", "__tw_own": "__tw_next"})
    n = F.length(text_or_empty())
    cut = (led.withColumn("n_chars", n.cast("long"))
           .withColumn("edited_text", F.concat(F.substr(text_or_empty(), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substr(text_or_empty("__tw_next_text"), F.lit(1), F.floor(n / 2).cast("int"))))
           .drop("__tw_next_text"))
    seen = (fingerprint(cut, band, "edited_text", "edited_fingerprint")
            .withColumn("fingerprint", F.lower(F.hex("__tw_own"))).withColumn("__tw_next", F.lower(F.hex("__tw_next"))))
    return seen.select(*carried(docs, *made), "n_chars", "fingerprint", "edited_text", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("__tw_next")).alias("near_next"))
