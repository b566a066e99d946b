"""Byte-level BPE with given ranks, in Arrow batches.

A task cuts each text into words by the public pattern and joins, in each word, the leftmost adjacent pair of lowest rank until none
is left: a queue of pairs, so a word costs its length times a logarithm, however long it is. A Python worker keeps the ids of words
it has met, `KEPT` at most, and begins anew when they are full; no table of words is counted, shuffled or sent. Bytes stand as characters
U+0000 to U+00FF for decoding, which joins the pieces of the ids in built-in functions.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import carried, text_or_empty
from tradewright.session import ship_package

RANKS = "byte_bpe_50k.tiktoken"
KEPT = 400_000          # words a worker keeps
LONGEST = 256           # characters of a word that is kept
#: White space by Unicode's White_Space property, as a character class; Python's own class holds U+001C to U+001F too.
SPACES = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def spelled_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    """The public pattern with its white space spelled out."""
    return (pattern.replace(r"[^\s", f"[^{SPACES}").replace(r"(?!\S)", f"(?![^{SPACES}])").replace(r"\s+", f"[{SPACES}]+"))


def ascii_pattern(pattern: str) -> str:
    """The spelled pattern for texts of ASCII alone, where it cuts alike: all its classes are ranges, so the plain `re` can run it."""
    return pattern.replace(SPACES, r"\t-\r ").replace(r"[^\t-\r \p{L}\p{N}]", r"[^\t-\r A-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """The pieces of one rank file as a literal, read on the driver."""

    def __init__(self, path: str | None = None) -> None:
        ranks = _ranks(path or public_tokenizers.path(RANKS))
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        self.pieces = F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word of bytes. A part is known by its first byte; `ends` and `before` are its end and the part before it."""
    n = len(raw)
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(ranks[raw[i:i + 2]], i, i + 2) for i in range(n - 1) if raw[i:i + 2] in ranks]
    heapq.heapify(queue)
    while queue:
        _, at, end = heapq.heappop(queue)
        # a pair that no longer stands as it was queued: its left part is gone, or one of the two has grown
        if ends[at] < 0 or ends[at] >= end or ends[ends[at]] != end:
            continue
        ends[ends[at]], ends[at] = -1, end
        if end < n:
            before[end] = at
            rank = ranks.get(raw[at:ends[end]])
            if rank is not None:
                heapq.heappush(queue, (rank, at, ends[end]))
        if at:
            left = before[at]
            rank = ranks.get(raw[left:end])
            if rank is not None:
                heapq.heappush(queue, (rank, left, end))
    return [ranks[raw[i:e]] for i, e in enumerate(ends) if e > 0]


class Words(dict):
    """Ids by word; what is missing is worked out, and kept while there is room."""

    def __init__(self, ranks: dict[bytes, int], most: int) -> None:
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else merged(raw, self.ranks)
        if self.most and len(word) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=4)
def _words(path: str, most: int) -> Words:
    """One for a worker, whatever number of tasks it runs."""
    return Words(_ranks(path), most)


def _encoded(path: str, pattern: str, most: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, cut, cut_ascii = _words(path, most), regex.compile(pattern).findall, re.compile(ascii_pattern(pattern)).findall
        for texts in batches:
            ids = []
            for t in texts:
                text = t.as_py().decode("utf-8", "replace")
                words = cut_ascii(text) if text.isascii() else cut(text)
                ids.append(np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
    return run


def encode(docs: DataFrame, path: str | None = None, most: int = KEPT) -> DataFrame:
    """The documents with `ids` (array<int>) added, as the tiktoken library encodes ordinary text by the same ranks.

    A null or empty text has no ids. Rows stay as they are, repeated or not; an empty table gives no rows, and a
    column named `ids` gives way.
    """
    ship_package(docs.sparkSession)
    run = F.arrow_udf(_encoded(path or public_tokenizers.path(RANKS), spelled_pattern(), most), "array<int>")
    return docs.select(*carried(docs, "ids"), run(text_or_empty().cast("binary")).alias("ids"))


def decode(ids: Column, codec: Codec) -> Column:
    """The bytes (binary) of an array of ids."""
    return F.encode(F.array_join(F.transform(ids, lambda i: F.get(codec.pieces, i)), ""), "ISO-8859-1")


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to rows with `ids`."""
    codec = Codec(path)
    return encoded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256),
                                "decoded_sha256": F.sha2(decode(F.col("ids"), codec), 256)})
