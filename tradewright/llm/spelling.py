"""Spelling variants: words at one inserted, deleted or replaced code point, found by pairs of trie nodes.

Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie, and nodes are numbered. A word that is
read up to position i and again from i + 1 gives the pair (prefix node, suffix node) of a skipped position; a word cut at i
gives the pair of an inserted position. Two words have one replaced code point if they share a skipped pair, and one
inserted or deleted code point if a skipped pair of the longer is a cut of the shorter. A pair of nodes holds at most one cut
word and one skipping word for each code point, so no group of words is ever large.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import global_rank
from tradewright.session import cut_lineage, ship_package, stored

LEAST_CHARS, LEAST_TIMES, LEAST_RATIO = 5, 3, 2
SLIP = 97
#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000
_LETTERS = set(range(65, 91)) | set(range(97, 123)) | set(range(0xC0, 0x100))
_TABLE = bytes((b + 32 if 65 <= b < 91 else b) if b in _LETTERS else 32 for b in range(256))


def runs_of(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, a byte for each code point."""
    return (text or "").encode("latin-1", "replace").translate(_TABLE).split()


def slipped(doc: str, run: bytes) -> bytes:
    """The run as the document has it: for one (document, run) in `SLIP` a code point is missing."""
    h = zlib.crc32(f"{doc}:{run.decode('latin-1')}".encode())
    at = h % len(run)
    return run if h % SLIP else run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (word, n) of words of `LEAST_CHARS` code points or more, by task."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            name = "" if doc is None else str(doc)
            start = zlib.crc32(f"{name}:".encode())
            for run, n in Counter(runs_of(text.as_py())).items():
                if len(run) >= LEAST_CHARS:
                    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
                    if h % SLIP == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < LEAST_CHARS:
                            continue
                    held[run] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    if held:
        yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the distinct words of at least `LEAST_CHARS` code points and `LEAST_TIMES` occurrences in all documents."""
    ship_package(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_TIMES)


def _folds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every prefix, the empty one first: sums of mixed (code point, position) pairs."""
    key = codes.astype(np.uint64) + np.arange(1, len(codes) + 1, dtype=np.uint64) * np.uint64(0x100000001B3)
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        x = key * np.uint64(salt)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x ^ (x >> np.uint64(31)), dtype=np.uint64)]))
    return sums[0], sums[1]


_NODE = "word_id long, at int, reversed boolean, depth int, h1 long, h2 long"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word_id, word) to the nodes of its prefixes and suffixes; `at` code points stand before the cut."""
    for batch in batches:
        ids, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for first in range(0, len(ids), 2000):
            cols: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, word in zip(ids[first:first + 2000], words[first:first + 2000], strict=True):
                codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
                n = len(codes) + 1
                for back in (False, True):
                    one, two = _folds(codes[::-1] if back else codes)
                    depth = np.arange(n, dtype=np.int32)
                    for col, values in zip(cols, (np.full(n, i), n - 1 - depth if back else depth, np.full(n, back), depth, one.view(np.int64), two.view(np.int64)), strict=True):
                        col.append(values)
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), k) for c, k in zip(cols, kinds, strict=True)], _NODE.replace(",", "").split()[::2])


def numbered_cuts(words: DataFrame) -> DataFrame:
    """(word_id, at, prefix, suffix): the node numbers on both sides of every cut of a (word_id, word) table."""
    nodes = stored(words.select("word_id", "word").mapInArrow(_nodes, _NODE), "trie-nodes")
    key = ["reversed", "depth", "h1", "h2"]
    numbers = global_rank(nodes.select(*key).distinct(), key).withColumnRenamed("rank", "node")
    placed = nodes.join(numbers, key).groupBy("word_id", "at").agg(F.max(F.when(~F.col("reversed"), F.col("node"))).alias("prefix"), F.max(F.when(F.col("reversed"), F.col("node"))).alias("suffix"))
    return stored(placed, "trie-cuts")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): numbers of words of a (word_id, word) table that differ by exactly one code point, each pair both ways."""
    cuts = numbered_cuts(words)
    before, after = cuts.alias("x"), cuts.alias("y")
    skipped = stored(before.join(after, (F.col("x.word_id") == F.col("y.word_id")) & (F.col("x.at") + 1 == F.col("y.at")))
                     .select("x.word_id", "x.at", "x.prefix", "y.suffix"), "trie-skips")
    l, r = skipped.alias("l"), skipped.alias("r")
    replaced = l.join(r, (F.col("l.prefix") == F.col("r.prefix")) & (F.col("l.suffix") == F.col("r.suffix")) & (F.col("l.word_id") != F.col("r.word_id")))
    r = cuts.alias("r")
    dropped = l.join(r, (F.col("l.prefix") == F.col("r.prefix")) & (F.col("l.suffix") == F.col("r.suffix")))
    longer = dropped.select(F.col("l.word_id").alias("a"), F.col("r.word_id").alias("b")).distinct()             # one of equal neighbours may be the skipped one
    return replaced.select(F.col("l.word_id").alias("a"), F.col("r.word_id").alias("b")).union(longer).union(longer.select("b", "a"))


def _checked(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs with words and counts, those kept that differ by one code point: node numbers stand for 128-bit hashes."""
    a = words.select(F.col("word_id").alias("a"), F.col("word").alias("word"), F.col("n").alias("n"))
    b = words.select(F.col("word_id").alias("b"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(a, "a").join(b, "b")
    return both.where((F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word along `form`; jumps double until nothing changes, counts at least double on the way so it ends."""
    jumps = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = jumps.select(F.col("word").alias("mid"), F.col("root").alias("beyond"))
        step = cut_lineage(jumps.join(further, jumps.root == further.mid, "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        jumps = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return jumps


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the documents.

    Words and their slips are those of `word_counts`; a null text has none and a null doc_id is written as the empty text. Of the words that
    differ by exactly one inserted, deleted or replaced code point, the most frequent one (ties: smallest in code-point order) is the
    form if it is at least `LEAST_RATIO` times as frequent. root follows forms to the last and is the word itself without one. Rows that
    repeat a document count again. An empty table gives no rows; only doc_id and text are read; words of any length are compared.
    """
    counts = stored(word_counts(docs), "word-counts")
    words = stored(global_rank(counts, ["word"]).withColumnRenamed("rank", "word_id"), "words")
    near = stored(_checked(near_pairs(words), words).select("word", "n", "near", "near_n"), "near-words")
    best = near.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best"))
    enough = -F.col("best.order") >= LEAST_RATIO * F.col("n")
    named = stored(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), "forms")
    roots = _roots(named.where("form is not null"))
    return (words.select("word", "n").join(named, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
