"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks. A block is a bit matrix: a document is a column, a Bloom position a row (a slice). A term
that occurs tf times sets `PROBES` positions for each threshold in `STEPS` that tf reaches, so the AND of a threshold's slices
marks every document that may hold the term so often, and some that do not. For a query the weighted slices give
each document an upper bound of its score. The documents with the largest bounds are scored first, on their texts; the worst of
the best `k` is a floor, and then every other document whose bound reaches the floor is scored too. What is left
out is provably below the floor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewright.session import ship_package, stored

K = 10
#: Documents scored first for each query, those of the largest bounds.
FIRST = 32
STEPS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 4096)
PROBES, BITS_PER_KEY = 3, 10
BLOCK_DOCS, BLOCK_CHARS = 1024, 4 << 20
#: Query terms that meet the index in one pass; further queries take further passes.
TERMS_AT_ONCE = 20_000
#: Candidate rows up to which they are handed to the tasks that read the texts; more are joined.
HANDED = 100_000
_IS_TERM = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes((b + 32 if 65 <= b < 91 else b) if b in _IS_TERM else 32 for b in range(256))
_MASK = (1 << 64) - 1
INDEX = "doc_ids array<long>, versions array<long>, lengths array<long>, width int, slices binary, terms array<binary>, dfs array<long>"


def terms_of(text: str | None) -> list[bytes]:
    """All terms of a text in order: runs of digits, ASCII letters and characters beyond ASCII, A-Z as a-z, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_hash(term: bytes) -> int:
    return int.from_bytes(blake2b(term, digest_size=8).digest(), "little")


class _Hashes(dict):
    """Hashes of the terms a task has met; emptied when large."""

    def __missing__(self, term: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[term] = value = term_hash(term)
        return value


def _positions(hashes: np.ndarray, step: int, width: int) -> np.ndarray:
    """(PROBES, n) slice numbers of a term at a threshold."""
    mixed = hashes ^ np.uint64((step * 0x9E3779B97F4A7C15) & _MASK)
    out = np.empty((PROBES, len(hashes)), np.int64)
    for i in range(PROBES):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out[i] = ((mixed >> np.uint64(32)) % np.uint64(width)).astype(np.int64)
    return out


def _block(docs: list[tuple[int | None, int, list[bytes]]], hashes: _Hashes) -> pa.RecordBatch:
    """One block of (doc_id, version, terms)."""
    lengths = np.array([len(t) for _, _, t in docs], np.int64)
    flat = np.fromiter((hashes[t] for _, _, terms in docs for t in terms), np.uint64, int(lengths.sum()))
    names: dict[bytes, None] = dict.fromkeys(t for _, _, terms in docs for t in terms)
    vocabulary, at = np.unique(flat, return_inverse=True)
    cell, tf = np.unique(np.repeat(np.arange(len(docs)), lengths) * max(1, len(vocabulary)) + at, return_counts=True)
    doc, term = cell // max(1, len(vocabulary)), cell % max(1, len(vocabulary))
    keys = np.zeros(len(docs), np.int64)
    for step in STEPS:
        keys += np.bincount(doc[tf >= step], minlength=len(docs))
    width = int(max(64, BITS_PER_KEY * keys.max(initial=1)))
    bits = np.zeros((width, -(-len(docs) // 8) * 8), np.uint8)
    for step in STEPS:
        held = tf >= step
        if held.any():
            bits[_positions(vocabulary[term[held]], step, width), doc[held]] = 1
    held_by: dict[bytes, int] = dict.fromkeys(names, 0)
    for _, _, terms in docs:
        for t in set(terms):
            held_by[t] += 1
    values = [[[d for d, _, _ in docs]], [[v for _, v, _ in docs]], [lengths.tolist()], [width], [np.packbits(bits, axis=1).tobytes()], [list(held_by)], [list(held_by.values())]]
    kinds = [pa.list_(pa.int64())] * 3 + [pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], INDEX.replace(",", "").split()[::2])


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, version, text) to blocks of documents of like length."""
    hashes = _Hashes()
    for batch in batches:
        ids, versions, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        order = np.argsort(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), kind="stable")
        held, chars = [], 0
        for i in order:
            text = texts[int(i)].as_py() or ""
            if held and (len(held) >= BLOCK_DOCS or chars + len(text) > BLOCK_CHARS):
                yield _block(held, hashes)
                held, chars = [], 0
            held.append((ids[i], versions[i], terms_of(text)))
            chars += len(text)
        if held:
            yield _block(held, hashes)


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks of all documents, stored. Each document is in one block, whole, whatever its length; null text has no term."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), _version(), F.col("text"))
    return stored(rows.mapInArrow(_index, INDEX), "bitsliced-index")


def _version() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("version")


def _weight(df: Column, n: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((2 * n + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def length_norm(n: int, docs: int, words: int) -> int:
    return 25 + (75 * n * docs) // words


class Queries:
    """A bounded number of queries: for each its terms with repeats times weight."""

    def __init__(self, rows: list[tuple[int, bytes, int]], docs: int, words: int) -> None:
        self.docs, self.words = docs, words
        self.by_item: dict[int, list[tuple[bytes, int]]] = {}
        for item, term, weight in rows:
            self.by_item.setdefault(item, []).append((term, weight))
        self.items = sorted(self.by_item)


class _Bounds:
    """Upper bounds of the scores of a block's documents, for all queries at once."""

    def __init__(self, q: Queries) -> None:
        self.q = q
        terms = sorted({t for wanted in q.by_item.values() for t, _ in wanted})
        at = {t: i for i, t in enumerate(terms)}
        self.hashes = np.array([term_hash(t) for t in terms], np.uint64)
        self.wanted = [(np.array([at[t] for t, _ in q.by_item[i]]), np.array([w for _, w in q.by_item[i]], np.float64)) for i in q.items]

    def of(self, lengths: np.ndarray, width: int, slices: bytes) -> np.ndarray:
        """(queries, documents), in double precision and rounded up."""
        n = len(lengths)
        matrix = np.frombuffer(slices, np.uint8).reshape(width, -1)
        norm = 24 + np.floor(75.0 * lengths * self.q.docs / self.q.words)             # at most the integer norm
        factor = np.zeros((len(self.hashes), n), np.float64)
        alive = np.arange(len(self.hashes))
        for at, step in enumerate(STEPS):
            rows = _positions(self.hashes[alive], step, width)
            marks = matrix[rows[0]]
            for i in range(1, PROBES):
                marks = marks & matrix[rows[i]]
            some = marks.any(axis=1)
            alive, marks = alive[some], marks[some]
            if not len(alive):
                break
            seen = np.unpackbits(marks, axis=1, count=n).astype(bool)
            highest = np.maximum(np.minimum(lengths, STEPS[at + 1] - 1 if at + 1 < len(STEPS) else lengths), 1)
            most = 1e9 * highest / (1000.0 * highest + 8 * norm)
            factor[alive] = np.where(seen & ((factor[alive] > 0) | (at == 0)), most, factor[alive])
        return np.stack([weight @ factor[terms] for terms, weight in self.wanted]) * (1 + 1e-9)


def _candidates(q: Queries, floors: dict[int, int] | None, first: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Without floors the documents of the `first` largest bounds of a task for each query, else all whose bound reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _Bounds(q)
        best: list[list[tuple[float, int | None, int]]] = [[] for _ in q.items]
        low = np.array([max(1, (floors or {}).get(item, 1)) for item in q.items], np.float64)
        for batch in batches:
            for row in batch.to_pylist():
                ids, versions = row["doc_ids"], row["versions"]
                bound = bounds.of(np.array(row["lengths"], np.int64), row["width"], row["slices"])
                if floors is None:
                    for i, of in enumerate(np.argsort(-bound, axis=1, kind="stable")[:, :first]):
                        more = [(float(bound[i, j]), ids[j], versions[j]) for j in of if bound[i, j] > 0 and (len(best[i]) < first or bound[i, j] > best[i][-1][0])]
                        best[i] = sorted(best[i] + more, key=lambda r: -r[0])[:first]
                else:
                    of, doc = np.nonzero(bound >= low[:, None])
                    if len(of):
                        yield _rows([q.items[i] for i in of], [ids[j] for j in doc], [versions[j] for j in doc], bound[of, doc].tolist())
        flat = [(q.items[i], d, v, b) for i, rows in enumerate(best) for b, d, v in rows]
        if flat:
            yield _rows(*map(list, zip(*flat, strict=True)))
    return run


CANDIDATE = "item_id long, doc_id long, version long, bound double"


def _rows(items: list, ids: list, versions: list, bounds: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((items, ids, versions, bounds), kinds, strict=True)], ["item_id", "doc_id", "version", "bound"])


def exact_score(counts: dict[bytes, int], n: int, wanted: list[tuple[bytes, int]], docs: int, words: int) -> int:
    m = length_norm(n, docs, words)
    return sum(weight * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 8 * m)) for t, weight in wanted if t in counts)


def _scored(q: Queries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, text, items in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                terms, counts = terms_of(text.as_py()), {}
                for t in terms:
                    counts[t] = counts.get(t, 0) + 1
                for item in items.as_py():
                    out[0].append(item)
                    out[1].append(doc.as_py())
                    out[2].append(exact_score(counts, len(terms), q.by_item[item], q.docs, q.words))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["item_id", "doc_id", "score"])
    return run


def _score(docs: DataFrame, q: Queries, wanted: DataFrame) -> DataFrame:
    """(item_id, doc_id, score) of (item_id, doc_id, version) rows, on the whole texts."""
    held = wanted.groupBy(F.col("doc_id").alias("__tw_doc"), F.col("version").alias("__tw_version")).agg(F.collect_set("item_id").alias("items"))
    held = stored(held, "wanted-documents")
    if held.count() <= HANDED:
        held = F.broadcast(held)
    rows = docs.select(F.col("doc_id").cast("long"), _version(), "text")
    met = rows.join(held, F.col("doc_id").eqNullSafe(F.col("__tw_doc")) & (F.col("version") == F.col("__tw_version")))
    return met.select("doc_id", "text", "items").mapInArrow(_scored(q), "item_id long, doc_id long, score long").where("score > 0")


def _top(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _query_blocks(terms: DataFrame) -> list[tuple[int, int]]:
    """Ranges of item numbers of at most `TERMS_AT_ONCE` rows each (an item with more stands alone); only block bounds reach the driver."""
    sizes = terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("item_id"))                             # one row for each query
    cut = sizes.select("item_id", F.floor((before - 1) / TERMS_AT_ONCE).alias("part")).groupBy("part").agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi"))
    return [(r.lo, r.hi) for r in cut.orderBy("part").collect()]


def search(docs: DataFrame, items: DataFrame, k: int = K, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` documents of the highest score above 0 for each item, equal scores by ascending doc_id.

    A term of the item counts as often as the item holds it, with weight w = floor(1000 * ln((2N + 2) / (2 df + 1))); a document's part
    is w * ((1000000000 tf) div (1000 tf + 8 m)), m = 25 + (75 n N) div L. Texts are read whole; null texts have no term. A null doc_id
    comes last among equal scores and rows that repeat a document are ranked each. Rows that repeat an item_id are one item with the terms
    of all; items with a null id or without a term have no result. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    stats = index.select(F.explode("lengths").alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not stats["words"]:
        return empty
    asked = items.where("item_id is not null").select(F.col("item_id").cast("long"), "text").mapInArrow(_item_terms, "item_id long, term binary")
    asked = asked.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    frequency = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    weighed = stored(asked.join(frequency, "term").select("item_id", "term", "times", _weight(F.col("df"), F.lit(stats["docs"]).cast("long")).alias("weight")), "query-terms")
    out = None
    signatures = index.select("doc_ids", "versions", "lengths", "width", "slices")
    by_bound = Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id", "version")
    for lo, hi in _query_blocks(weighed):
        rows = [(r.item_id, bytes(r.term), r.times * r.weight) for r in weighed.where(F.col("item_id").between(lo, hi)).collect()]
        q = Queries(rows, int(stats["docs"]), int(stats["words"]))
        leading = signatures.mapInArrow(_candidates(q, None, first), CANDIDATE).withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= first)
        best = _top(_score(docs, q, stored(leading, "leading-documents")), k)
        floors = {r.item_id: r.score for r in best.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect()}
        reached = stored(signatures.mapInArrow(_candidates(q, floors, first), CANDIDATE), "bounded-documents")
        found = _top(_score(docs, q, reached), k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return empty if out is None else out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(item, t) for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t in terms_of(text.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])
