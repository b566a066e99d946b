"""Fingerprints, ranked search and spelling variants against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import UP
from tests.llm.conftest import LONG, ROWS
from tradewright.llm import bitsliced, imatch, spelling

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(UP))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def fingerprint(text, lexicon):
    mine = set(terms(text)) & lexicon or set(terms(text))
    if not mine:
        return "0" * 16 * 9
    keyed = sorted(str(int(md5(t)[0], 16) % 8) + md5(t)[1:] + t for t in mine)
    out = [md5(" ".join(keyed))[:16]]
    for f in range(8):
        own = [k for k in keyed if k[0] == str(f)]
        top = (1 << min([int(k[1:5], 16) for k in own], default=0).bit_length()) - 1
        out.append(md5(f"{f}{top:04x}g" + " ".join(k for k in own if int(k[1:5], 16) <= top))[:16] if own else "0" * 16)
    return "".join(out)


def like(a, b):
    parts = [(a[i:i + 16], b[i:i + 16]) for i in range(0, len(a), 16)]
    held = [x for x in parts if x != ("0" * 16, "0" * 16)]
    return sum(x == y for x, y in held) / len(held) if held else 1.0


def edited(rows, rarest, commonest):
    """Sorted (doc_id, n_chars, edited text, prints, likeness) of (doc_id, text) rows with distinct ids."""
    held = Counter(t for _, text in rows for t in set(terms(text)))
    lexicon = {t for t, n in held.items() if n * rarest >= len(rows) and n * commonest <= len(rows)}
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = (fingerprint(x, lexicon) for x in (text, changed, after))
        out.append((str(doc), len(text), changed, a, b, like(a, b), like(a, c)))
    return out


def got_edits(df):
    return sorted((str(r.doc_id), r.n_chars, r.edited_text, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in df.collect())


def test_fingerprints(odd, none):
    single = odd.dropDuplicates(["doc_id"])
    want = sorted(edited([(r[0], r[1]) for r in {r[0]: r for r in ROWS}.values()], 4, 2))
    for handed in (50_000, 0):
        out = imatch.edited_copies(single, 4, 2, handed)
        assert got_edits(out) == want and "kept_text" in out.columns
    assert imatch.edited_copies(none).count() == 0
    assert imatch.edited_copies(none).columns == imatch.edited_copies(odd).columns


def test_fingerprints_of_repeated_rows(spark, odd):
    rows = imatch.edited_copies(odd).where("doc_id = 8").collect()
    assert len(rows) == 2 and len({r.fingerprint for r in rows}) == 1
    assert sorted(r.edited_text[4:] for r in rows) == sorted([ROWS[7][1][:3], ROWS[10][1][:3]])      # one has its twin next, one document 9
    clash = spark.createDataFrame([(1, "one two three four", "x", "y")], "doc_id long, text string, fingerprint string, n_chars string")
    only = imatch.edited_copies(clash).first()
    assert only.edited_text == "one two tone two t"[:18] and only.near_next == 1.0 and only.n_chars == 18


def test_fingerprints_order_many_rows(spark, docs):
    """Every bin hands its first row on, ids with many rows and null ids included."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} {'x' * (i % 5)}") for i in range(400)]
    out = imatch.with_next(spark.createDataFrame(rows, "doc_id long, text string"), {"doc_id": "next_id", "text": "next_text"}).collect()
    assert len(out) == 400 and len({r.next_text for r in out}) == 400
    after = {r.text: r.next_text for r in out}
    at, chain = out[0].text, []
    for _ in range(400):
        chain.append(at)
        at = after[at]
    assert at == chain[0] and len(set(chain)) == 400                                              # one ring
    ids = dict((t, d) for d, t in rows)
    turns = [ids[t] for t in chain]
    falls = sum(1 for a, b in zip(turns, turns[1:] + turns[:1], strict=True) if (a is None, a or 0) > (b is None, b or 0))
    assert falls == 1


def test_fingerprints_tell_copies(docs):
    out = imatch.edited_copies(docs).select("near_edited", "near_next").agg(F.avg("near_edited").alias("e"), F.avg("near_next").alias("n")).first()
    assert out.e > out.n + 0.1


def ranked(rows, items, k=10):
    held = [(doc, Counter(terms(text))) for doc, text in rows]
    full = [c for _, c in held if c]
    docs, words = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    asked = defaultdict(list)
    for item, text in items:
        if item is not None:
            asked[item] += terms(text)
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, c in held:
            m = 25 + (75 * sum(c.values()) * docs) // words
            score = sum(math.floor(1000 * math.log((2 * docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            scores += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(map(str, out))


ITEMS = [(1, "a shared LINE of text", 1), (2, None, 2), (3, "", 3), (4, "nowhere-to-be-found", 4), (5, "fox fox fox dog long1 long2 long976", 5), (None, "fox", 6), (6, "日本語 two", 7), (7, "two", 8), (7, "one", 9),
         (8, LONG[:5000], 10)]


def test_ranked_search(spark, odd, none, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string, score long")
    want = ranked([(r[0], r[1]) for r in ROWS], [r[:2] for r in ITEMS])
    out = lambda df: sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())
    assert out(bitsliced.search(odd, items)) == want
    assert bitsliced.search(none, items).count() == 0 and bitsliced.search(odd, items.where("false")).count() == 0
    assert bitsliced.search(odd.withColumn("text", F.lit(None).cast("string")), items).count() == 0
    real = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [(i, real[i][1][:400]) for i in range(0, 60, 4)]
    wanted = spark.createDataFrame(asked, "item_id long, text string")
    best = ranked(real, asked)
    # small blocks, a few first documents, several passes over the index, and texts joined
    monkeypatch.setattr(bitsliced, "TERMS_AT_ONCE", 200)
    monkeypatch.setattr(bitsliced, "HANDED", 0)
    assert out(bitsliced.search(docs, wanted, first=3)) == best


def test_bounds_are_upper_bounds():
    texts = ["a b c " * 7 + "d", "a", "b b b c", "e " * 5000 + "a", "zz"]
    block = bitsliced._block([(i, i, bitsliced.terms_of(t)) for i, t in enumerate(texts)], bitsliced._Hashes()).to_pylist()[0]
    q = bitsliced.Queries([(1, b"a", 900), (1, b"e", 4000), (2, b"b", 10), (2, b"nope", 50)], 5, sum(block["lengths"]))
    import numpy as np
    bound = bitsliced._Bounds(q).of(np.array(block["lengths"]), block["width"], block["slices"])
    for i, item in enumerate(q.items):
        for j, text in enumerate(texts):
            counts = Counter(bitsliced.terms_of(text))
            assert bound[i, j] >= bitsliced.exact_score(counts, sum(counts.values()), q.by_item[item], q.docs, q.words)


def spelled(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += len(run) >= 5
    n = {w: c for w, c in n.items() if c >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(close[w]), n.get(form[w])))
    return sorted(map(str, out))


def test_spelling_variants(spark, odd, none, docs):
    out = lambda df: sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())
    assert out(spelling.variants(odd)) == spelled([(r[0], r[1]) for r in ROWS])
    assert spelling.variants(none).count() == 0
    run = "kettle " * 12 + "ketle ketle ketle kettel kettel kettel kettles kettles kettles kettles kettles kettles cattle cattle cattle battle battle battle éclair éclair éclair éclairs éclairs éclairs eclair eclair eclair "
    hard = [(1, run), (None, "aaaaa aaaaa aaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaa aaaaaaa aaaaaaa aaaaaaa"), (2, ("q" * 30_000 + " ") * 3), (3, ("q" * 30_001 + " ") * 9), (4, "DÉJÀ×vu déjà×vu DéjÀ×vu Ωmega Ωmega ŁŁŁkettle"), (4, run), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, "x", 3) for r in hard], "doc_id long, text string, word string, n int")
    assert out(spelling.variants(df)) == spelled(hard)
    some = docs.where("doc_id < 60")
    assert out(spelling.variants(some)) == spelled([(r.doc_id, r.text) for r in some.collect()])


def test_slips_take_one_code_point():
    runs = [f"wörd{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(676)]
    changed = [(r, spelling.slipped("12", r.encode("latin-1")).decode("latin-1")) for r in runs]
    for run, has in changed:
        h = zlib.crc32(f"12:{run}".encode())
        assert has == (run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:])
    assert any(a != b for a, b in changed)
    assert pytest.approx(sum(a != b for a, b in changed), abs=8) == 676 / 97
