"""Near-duplicate documents by a signature-coordinate inverted join.

A document's MinHash signature has `COORDINATES` values; the document is posted under each (coordinate, value). Documents
above the similarity threshold agree in at least `MATCHES` coordinates but for about one pair in a million that stands
exactly on it. Counting collisions over whole lists is avoided in two ways that lose nothing:

* prefix: with the postings of every document in one global order, rarest first, two documents that agree in
  `MATCHES` coordinates share one of the first COORDINATES - MATCHES + 1 of both, so only those are joined;
* skip: in a list, documents that are already known to be connected are not compared again. Lists are first joined
  with their smallest member (a star per list, linear in its length), and only what is then still in different components
  is compared pair by pair, the coordinates that agree being counted inside the join condition.

Every link is confirmed on the full shingle sets. Exact copies are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import carried, components
from tradewright.llm.shingles import chunks, mixed, shingles
from tradewright.session import cut_lineage, ship_package, stored

COORDINATES, MATCHES = 32, 16
SHINGLE = 5
BITS = 2048
PERCENT = 85


def _coordinates(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, s1, s2, signature, bits): size, two sums over the set that identify it, MinHash values, parities."""
    a, b = _coordinates(COORDINATES)
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            sets = shingles(data, offsets, SHINGLE)
            sizes = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            full = np.flatnonzero(sizes)
            begin = np.concatenate([[0], np.cumsum(sizes[full])])[:-1].astype(np.int64)
            s1, s2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            low = np.zeros((len(sets), COORDINATES), np.uint64)
            if len(full):
                s1[full] = np.add.reduceat(flat, begin)
                s2[full] = np.add.reduceat(mixed(flat + np.uint64(0x632BE59BD9B4E019)), begin)
                for k in range(COORDINATES):
                    x = flat * a[k] + b[k]
                    low[full, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), begin)
            place = np.repeat(np.arange(len(sets)), sizes) * BITS + (flat >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
            odd = np.packbits((np.bincount(place, minlength=len(sets) * BITS) & 1).astype(np.uint8)).view(np.int64)
            listed = lambda values, n: pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n), pa.array(values))
            signature, bits = listed(low.reshape(-1).view(np.int64), COORDINATES), listed(odd, BITS // 64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), signature, bits],
                                             ["doc_id", "n_shingles", "s1", "s2", "signature", "bits"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, shingle hashes)."""
    for batch in batches:
        for first, data, offsets in chunks(batch.column(1)):
            sets = shingles(data, offsets, SHINGLE)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                                             ["doc_id", "shingles"])


def _agreeing(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda same: same))


def _may_be_near(x: str, y: str, percent: int) -> Column:
    """No pair that is linked fails this but by its MinHash values: sizes, then differing parities, then agreeing coordinates."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    differing = F.aggregate(F.zip_with(f"{x}.bits", f"{y}.bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, d: total + d)
    return ((100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differing <= (100 - percent) * (n + m))
            & (_agreeing(f"{x}.signature", f"{y}.signature") >= MATCHES))


class _Links:
    """Confirms candidate pairs on full sets and keeps the components of what it confirmed."""

    def __init__(self, docs: DataFrame, percent: int) -> None:
        self.docs, self.percent = docs, percent
        self.edges: DataFrame | None = None
        self.known: DataFrame | None = None
        self.comp: DataFrame | None = None

    def _with_sets(self, pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        if self.known is not None:
            needed = needed.join(self.known, needed.cid == self.known.doc_id, "left_anti")
        text = self.docs.select("doc_id", "text").join(needed, self.docs.doc_id == needed.cid, "left_semi")
        fresh = stored(text.mapInArrow(_sets, "doc_id long, shingles array<long>"), "shingle-sets")
        self.known = fresh if self.known is None else self.known.union(fresh)
        left = self.known.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
        right = self.known.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
        return pairs.join(left, "a").join(right, "b")

    def confirm(self, pairs: DataFrame) -> None:
        both = self._with_sets(pairs)
        shared = F.size(F.array_intersect("left", "right"))
        found = both.where(100 * shared >= self.percent * (F.size("left") + F.size("right") - shared)).select("a", "b")
        found = stored(found, "near-edges")
        self.edges = found if self.edges is None else self.edges.union(found)
        self.comp = components(self.edges)

    def label(self, postings: DataFrame) -> DataFrame:
        """The postings with the component of their document, in lists that still hold two components or more."""
        named = postings.join(self.comp, postings.cid == self.comp.node, "left").drop("node").withColumn("comp", F.coalesce("comp", "cid"))
        named = cut_lineage(named)
        open_lists = named.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
        return cut_lineage(named.join(open_lists, "token", "left_semi"))


def _star(postings: DataFrame, percent: int) -> DataFrame:
    """Each list's documents with the smallest of its members."""
    hubs = postings.groupBy("token").agg(F.min_by(F.struct("cid", "n_shingles", "signature", "bits"), F.col("cid")).alias("hub")).select("token", "hub.*")
    l, r = postings.alias("l"), hubs.alias("r")
    met = l.join(r, (F.col("l.token") == F.col("r.token")) & (F.col("l.cid") != F.col("r.cid")) & _may_be_near("l", "r", percent))
    return met.select(F.col("r.cid").alias("a"), F.col("l.cid").alias("b")).distinct()


def _rest(postings: DataFrame, percent: int) -> DataFrame:
    """Every pair of a list that is still in two components and may be near, each once."""
    l, r = postings.alias("l"), postings.alias("r")
    near = ((F.col("l.token") == F.col("r.token")) & (F.col("l.cid") < F.col("r.cid")) & (F.col("l.comp") != F.col("r.comp")) & _may_be_near("l", "r", percent))
    return l.join(r, near).select(F.col("l.cid").alias("a"), F.col("r.cid").alias("b")).distinct()


def _postings(classes: DataFrame) -> DataFrame:
    """(token, cid, n_shingles, signature, bits): the prefix postings whose list has two documents or more.

    A value posted by one document only comes first in the order and joins with nothing; so a document with fewer than
    `MATCHES` shared values has no partner, and of m shared values the rarest m - MATCHES + 1 are its prefix.
    """
    tokens = classes.select("cid", F.posexplode("signature").alias("k", "value")).select("cid", F.xxhash64("k", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = (tokens.join(shared, "token").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))     # COORDINATES values at most
              .where(F.size("held") >= MATCHES))
    prefix = ranked.select("cid", F.explode(F.slice("held", 1, F.size("held") - (MATCHES - 1))).alias("p")).select("cid", F.col("p.token").alias("token"))
    return prefix.join(classes.select("cid", "n_shingles", "signature", "bits"), "cid")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept), a row for each row of `docs`.

    Documents whose sets of 5-word shingles have 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable, class_id the smallest of those with the same set. Null or wordless texts have an empty set and
    link with nothing. Rows with a null doc_id link with nothing and are kept, with a null component. A repeated row
    has its twin's component. An empty table gives no rows; only doc_id and text are read.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = stored(docs.mapInArrow(_signed, "doc_id long, n_shingles long, s1 long, s2 long, signature array<long>, bits array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    ids = cut_lineage(usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("cid")))
    first = usable.join(ids.withColumnsRenamed({"s1": "t1", "s2": "t2"}), (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("doc_id") == F.col("cid")))
    classes = first.select("cid", "n_shingles", "signature", "bits").dropDuplicates(["cid"])
    postings = stored(_postings(classes), "postings")
    links = _Links(docs, percent)
    links.confirm(stored(_star(postings, percent), "pairs"))
    links.confirm(stored(_rest(links.label(postings), percent), "pairs"))
    named = (signed.join(ids.withColumnsRenamed({"s1": "t1", "s2": "t2"}), (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2")) & (F.col("n_shingles") > 0), "left")
             .join(links.comp, F.col("cid") == F.col("node"), "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "cid", "doc_id"))
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("cid", "doc_id")).alias("class_id"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without those that have a near-duplicate of smaller doc_id; of repeated rows one stays."""
    gone = near_duplicates(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*carried(docs))
    known, unknown = left.where(F.col("doc_id").isNotNull()), left.where(F.col("doc_id").isNull())
    return known.unionByName(unknown)
