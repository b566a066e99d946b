"""Language identification by rank-order profiles of character n-grams.

A profile is the ranked list of the most frequent 1- to 3-grams of a language; a document is given the language whose profile
has the least out-of-place distance to the ranks of its own most frequent n-grams. An n-gram is one number of three
code points, so grams are counted by sorting numbers, for long texts in bounded blocks that share no gram. Profiles
come from all learning documents: tasks count, Spark sums, and only `PROFILE` grams for each language reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewright.llm.common import crc_remainder
from tradewright.session import ship_package

PROFILE = 300
BLOCK = 1 << 20
NARROW = 1024
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _places(text: str) -> np.ndarray:
    """The lower-cased text's code points, every run of other characters than letters being one 0, with a 0 at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_is_letter()[points], points, 0)
    edge = points == 0
    keep = np.ones(len(points), bool)
    keep[1:] = ~(edge[1:] & edge[:-1])
    p = np.concatenate([[0], points[keep], [0]])
    if len(p) > 2 and p[1] == 0:
        p = p[1:]
    if len(p) > 2 and p[-2] == 0:
        p = p[:-1]
    return p


def _block_grams(p: np.ndarray, at: int, to: int, bits: int) -> np.ndarray:
    """The n-grams of the places `at` to `to`: single letters there, pairs that begin and triples whose middle stands there.

    So a gram belongs to one block only, wherever blocks end. Places of few bits make 32-bit numbers, which sort faster.
    """
    q = p[max(at - 1, 0):to + 1]
    lead = at - max(at - 1, 0)
    own = q[lead:lead + to - at]
    two = (own[:len(q) - lead - 1] << bits) | q[lead + 1:]
    middle = own[1 - lead:len(q) - lead - 1]                         # neither the first nor the last place of the text
    three = (q[:len(middle)] << (2 * bits)) | (middle << bits) | q[2:2 + len(middle)]
    return np.concatenate([middle[middle > 0], two, three[middle > 0]])


def _wide(codes: np.ndarray, narrow: bool) -> np.ndarray:
    """Numbers of 10-bit places as numbers of 21-bit places."""
    c = codes.astype(np.int64)
    return c if not narrow else ((c >> 20) << 42) | (((c >> 10) & 1023) << 21) | (c & 1023)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams (1 to 3 letters, a word's edge counting as one at either end) and their counts."""
    p = _places(text)
    if len(p) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    narrow = int(p.max()) < NARROW
    p = p.astype(np.int32 if narrow else np.int64)
    parts = []
    for at in range(0, len(p), BLOCK):
        u, c = np.unique(_block_grams(p, at, min(at + BLOCK, len(p)), 10 if narrow else 21), return_counts=True)
        parts.append((_wide(u, narrow), c))
    if len(parts) == 1:
        return parts[0]
    u, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return u, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(text: str, most: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, ties to the smaller number."""
    u, c = counted(text)
    if len(u) > most:
        least = np.partition(c, len(c) - most)[len(c) - most]
        near = c >= least
        u, c = u[near], c[near]
    return u[np.lexsort((u, -c))][:most]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed within a batch."""
    for batch in batches:
        by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size: dict[str, int] = {}
        out: list[tuple[str, np.ndarray, np.ndarray]] = []

        def fold(lang: str) -> tuple[np.ndarray, np.ndarray]:
            u, inverse = np.unique(np.concatenate([p[0] for p in by[lang]]), return_inverse=True)
            return u, np.bincount(inverse, np.concatenate([p[1] for p in by[lang]])).astype(np.int64)

        for lang, text in zip(batch.column(0), batch.column(1)):
            key = lang.as_py()
            u, c = counted(text.as_py() or "")
            by.setdefault(key, []).append((u, c))
            size[key] = size.get(key, 0) + len(u)
            if size[key] > BLOCK:
                by[key] = [fold(key)]
                size[key] = 0
        for key in by:
            u, n = fold(key)
            out.append((key, u, n))
        for key, u, n in out:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(u), pa.string()), pa.array(u), pa.array(n)], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, most: int = PROFILE) -> dict[str, list[int]]:
    """The ranked n-grams of each language, from rows with a text and a language; of fixed length for each language."""
    ship_package(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = rows.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("lang", "gram", "rank")
    out: dict[str, list[int]] = {}
    for r in sorted(top.collect()):
        out.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {lang: [g for _, g in sorted(held)] for lang, held in out.items()}


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """(doc_id, held_out or whatever stands beside the text, lang_pred, score) for rows with a `text` column last.

    score is 1 less the distance over the largest possible one. `und` with score 0 stands for a null text, a text
    without a letter, or no learned language. Ties go to the smaller language name. Texts of any length count whole.
    """
    ship_package(docs.sparkSession)
    langs = sorted(profiles)
    codes = np.array(sorted({g for held in profiles.values() for g in held}), np.int64)
    place = np.full((len(codes) + 1, max(1, len(langs))), PROFILE, np.int32)       # last row: in no profile
    for k, lang in enumerate(langs):
        place[np.searchsorted(codes, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(batch.num_columns - 1):
                own = ranked(text.as_py() or "") if langs else np.zeros(0, np.int64)
                if not len(own):
                    names.append("und")
                    scores.append(0.0)
                    continue
                at = np.searchsorted(codes, own)
                at[(at >= len(codes))] = 0
                at = np.where(codes[at] == own, at, len(codes))
                own_place = np.arange(len(own))[:, None]
                held = place[at]
                far = np.where(held == PROFILE, PROFILE, np.abs(held - own_place)).sum(axis=0)
                k = int(far.argmin())
                names.append(langs[k])
                scores.append(1.0 - float(far[k]) / (PROFILE * len(own)))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(predict, f"{fields}, lang_pred string, score double")


def held_out_languages(docs: DataFrame) -> DataFrame:
    """Every document's predicted language; learned from those whose crc32 of the id, modulo 3, is not 1.

    A row for each row: repeated rows are learned from and predicted each. Null ids are held in neither part's remainder, so
    held_out is null and they are not learned from; texts or languages that are null are not learned from either. Frequencies
    that tie are ranked by the gram's number, distances that tie go to the smaller name. Other columns are
    not read. An empty table gives no rows.
    """
    held = crc_remainder("doc_id", 3) == 1
    profiles = learn_profiles(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles)
