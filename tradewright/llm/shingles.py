"""Word and shingle hashes of whole texts, computed on the bytes of an Arrow batch with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240501))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text stands alone. Null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row, hash) of every word; A-Z count as a-z, rows also end words."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    is_word = IS_WORD[data]
    opens, closes = is_word.copy(), is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes[:-1] &= ~is_word[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[firsts] |= is_word[firsts]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    closes[lasts] |= is_word[lasts]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.broadcast_to(BASE, n)]), dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[FOLD[data]] * power[:n], dtype=np.uint64, out=total[1:])
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.broadcast_to(INVERSE, n)]), dtype=np.uint64)
    value = (total[ends] - total[starts]) * back[starts]
    return starts, ends, row, mixed(value ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word n-grams; of all its words as one if it has fewer."""
    _, _, row, h = words(data, offsets)
    n_rows = len(offsets) - 1
    multipliers = [mixed(np.array([1000 + k], np.uint64))[0] | np.uint64(1) for k in range(size)]
    count = max(0, len(h) - size + 1)
    grams = np.zeros(count, np.uint64)
    for k in range(size):
        grams = mixed(grams + h[k:k + count] * multipliers[k])
    same = row[:count] == row[size - 1:size - 1 + count]
    grams, gram_row = grams[same], row[:count][same]
    bounds = np.searchsorted(gram_row, np.arange(n_rows + 1))
    word_bounds = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    for i in range(n_rows):
        if bounds[i] < bounds[i + 1]:
            out.append(np.unique(grams[bounds[i]:bounds[i + 1]]))
        elif word_bounds[i] < word_bounds[i + 1]:
            few = np.array([len(h[word_bounds[i]:word_bounds[i + 1]])], np.uint64)
            for x in h[word_bounds[i]:word_bounds[i + 1]]:
                few = mixed(few * np.uint64(0x9FB21C651E98DF25) + x)
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
