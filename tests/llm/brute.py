"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from itertools import product

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, fold=True):
    return WORD.findall((text or "").translate(UP) if fold else (text or ""))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def mix(rows, weights=(3, 1, 2), epochs=2):
    """{source: target} by repeated clamping; rows are (doc_id, text, source)."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), {s for s in order if not sizes[s]}
    while True:
        left = budget - sum(epochs * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        target = {s: epochs * sizes[s] if s in full else left * weight[s] / total for s in order}
        over = {s for s in order if s not in full and target[s] > epochs * sizes[s]}
        if not over:
            return sizes, target
        full |= over


def lines(rows, least=10):
    """{row number: (n_lines, n_dropped, kept text)} of (doc_id, text)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(UP)
    owners = {}
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                if len(key(line)) >= least:
                    owners.setdefault(key(line), set()).add(doc)
    out = {}
    for i, (doc, text) in enumerate(rows):
        parts = (text or "").split("\n")
        kept = [x for x in parts if doc is None or len(key(x)) < least or min(owners[key(x)]) == doc]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows, percent=85):
    """{doc_id: smallest doc_id reachable} of (doc_id, text)."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                up[q] = p
    return {d: top(d) for d, _ in sets}


def statistics(text):
    w = words(text, fold=False)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered))


def encoding():
    import public_tokenizers as p
    import tiktoken
    with open(p.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def repair_cost(roles):
    """Least cost over all ways to relabel, merge and insert, by trying every one; roles are names or None."""
    from tradewright.llm.chat import END_COST, STEPS, role_number
    best = None
    for states in product((1, 2, 3), repeat=len(roles)):
        at, total = 0, 0
        for role, q in zip(roles, states):
            step = STEPS[role_number(role)].get((at, q))
            if step is None:
                break
            total, at = total + step[0], q
        else:
            total += END_COST[at]
            best = total if best is None else min(best, total)
    return best


def grams(text):
    """{number: count} of single letters, and of pairs and triples in which a run of other characters counts as one edge."""
    marks = [0]
    for ch in (text or "").lower():
        if ch.isalpha():
            marks.append(ord(ch))
        elif marks[-1]:
            marks.append(0)
    if marks[-1]:
        marks.append(0)
    out = {}
    for i, m in enumerate(marks):
        own = ([(m,)] if m else []) + ([tuple(marks[i:i + 2])] if i + 1 < len(marks) else []) + ([tuple(marks[i - 1:i + 2])] if m else [])
        for g in own:
            number = 0
            for x in g:
                number = (number << 21) | x
            out[number] = out.get(number, 0) + 1
    return out


def _by_rank(counts, most):
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def ranks(text, most):
    return _by_rank(grams(text), most)


def profiles(rows, most):
    sums = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            for g, n in grams(text).items():
                held = sums.setdefault(lang, {})
                held[g] = held.get(g, 0) + n
    return {lang: _by_rank(held, most) for lang, held in sums.items() if held}


def language(text, known, most):
    own = ranks(text, most)
    if not own or not known:
        return "und", 0.0
    far = {}
    for lang, held in known.items():
        place = {g: i for i, g in enumerate(held)}
        far[lang] = sum(abs(place[g] - i) if g in place else most for i, g in enumerate(own))
    best = min(sorted(far), key=lambda lang: far[lang])
    return best, round(1 - far[best] / (most * len(own)), 9)
