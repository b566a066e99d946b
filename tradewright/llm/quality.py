"""Quality rules: whole-text statistics and a learned decision list, in built-in functions only.

Sequential covering: a rule grows by the threshold condition of the best information gain on
one half of the labelled rows, is pruned from its end on the other half, and is kept if it is precise there; the rows it covers
leave, and the next rule is grown. A rule that is not precise is set aside with the feature and side it began with, and
growing goes on. Rules become one ordered conditional expression. The driver sees only counts by
(feature, bin, label).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.functions.rules import let
from tradewright.llm.common import carried, text_or_empty, words_of
from tradewright.session import cut_lineage, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BINS = 64
MAX_RULES, MAX_CONDITIONS = 8, 3
MIN_PRECISION, MIN_SUPPORT = 0.95, 8         # on held-out rows
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_chars_all")


def _windows(words: Column) -> Column:
    """A hash of each run of `WINDOW` words, a power of two: hashes of neighbouring runs are joined until they are long enough, so a word is hashed once."""
    def joined(hashes: Column, width: int) -> Column:
        if width == WINDOW:
            return F.slice(hashes, 1, F.greatest(F.size(hashes) - (WINDOW - 1), F.lit(0)))
        return let(F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + width))), lambda longer: joined(longer, 2 * width))
    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: joined(hashes, 1))


def _repeat_words(windows: str) -> Column:
    """Words in windows whose hash occurs twice or more; the windows are ranked by (hash, place), so cost is n log n."""
    w = F.col(windows)
    ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = lambda a: F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))
    same = F.zip_with(ranked, rest(ranked), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    twice = F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    marked = F.zip_with(ranked, twice, lambda a, d: F.struct(a["i"].alias("i"), d.alias("d")))
    places = F.sort_array(F.transform(F.filter(marked, lambda z: z["d"] & z["i"].isNotNull()), lambda z: z["i"]))
    steps = F.zip_with(places, rest(places), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    return F.aggregate(steps, F.lit(0), lambda total, s: total + s)


def statistics(docs: DataFrame) -> DataFrame:
    """The documents with the counts of `COUNTS` (long) added; a null text counts as empty."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    with_words = docs.select(*carried(docs, *COUNTS), words_of(F.col("text")).alias("__tw_words"), lines.alias("__tw_lines"))
    n = F.size("__tw_words")
    bare = F.array_join("__tw_words", "")
    cut = with_words.withColumns({"__tw_windows": _windows(F.col("__tw_words")), "__tw_bare": bare})
    without = lambda kind: F.length("__tw_bare") - F.length(F.regexp_replace("__tw_bare", f"[{kind}]+", ""))
    repeats = F.size(F.array_distinct("__tw_windows")) < F.size("__tw_windows")
    counts = {
        "n_words": n, "word_chars": F.length("__tw_bare"), "n_symbols": without(SYMBOLS),
        "n_dup_lines": F.size("__tw_lines") - F.size(F.array_distinct("__tw_lines")), "n_repeat_words": F.when(repeats, _repeat_words("__tw_windows")).otherwise(0),
        "n_lines": F.size("__tw_lines"), "n_distinct_words": F.size(F.array_distinct("__tw_words")),
        "n_digits": without("0-9"), "n_upper": without("A-Z"), "n_chars_all": F.length(F.coalesce(F.col("text"), F.lit("")))}
    return cut.select(*carried(docs, *COUNTS), *[c.cast("long").alias(k) for k, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Scale-free features over the counts."""
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", "n_lines"))
    return {"words": F.col("n_words").cast("double"), "mean_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
            "dup_lines": F.col("n_dup_lines") / lines, "repeat_words": F.col("n_repeat_words") / words, "distinct_words": F.col("n_distinct_words") / words,
            "digits": F.col("n_digits") / chars, "upper": F.col("n_upper") / chars, "words_per_line": F.col("n_words") / lines}


@dataclass(frozen=True)
class Condition:
    """feature >= value, or feature < value; `cut` is the place of the value among the feature's cuts."""
    feature: str
    above: bool
    cut: int
    value: float

    def over_bins(self, place: dict[str, int]) -> Column:
        b = F.col("bins")[place[self.feature]]
        return b > self.cut if self.above else b <= self.cut

    def over_values(self) -> Column:
        x = features()[self.feature]
        return x >= F.lit(self.value) if self.above else x < F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.value:.6g}"


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _counts(placed: DataFrame) -> dict[tuple[int, int], list[int]]:
    """Rejected and kept rows by (feature, bin), from rows placed once for each feature."""
    out: dict[tuple[int, int], list[int]] = {}
    for r in placed.groupBy("f", "bin").agg(F.sum(F.col("bad") * F.col("n")).alias("p"), F.sum("n").alias("n")).collect():        # features x bins at most
        out[(r.f, r.bin)] = [int(r.p), int(r.n - r.p)]
    return out


def _bin(x: Column, cuts: list[float]) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c <= x))


def _grow(placed: DataFrame, first: dict[tuple[int, int], list[int]], cuts: dict[str, list[float]], place: dict[str, int], refused: set[tuple[str, bool]]) -> list[Condition]:
    """A conjunction that begins with none of the refused (feature, side); `first` holds the counts of all rows."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS:
        by = _counts(placed.where(_all([c.over_bins(place) for c in rule]))) if rule else first
        p0, n0 = (sum(v[i] for (f, _), v in by.items() if f == 0) for i in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, values in cuts.items():
            low = [0, 0]
            for k, value in enumerate(values):
                low = [x + y for x, y in zip(low, by.get((place[f], k), (0, 0)))]           # bad and good rows below the value
                for above, (p, n) in ((False, low), (True, (p0 - low[0], n0 - low[1]))):
                    if not rule and (f, above) in refused:
                        continue
                    got = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                    if got > gain:
                        best, gain = Condition(f, above, k, value), got
        if best is None:
            break
        rule.append(best)
    return rule


def _precision(rows: DataFrame, rule: list[Condition], place: dict[str, int]) -> tuple[int, int]:
    r = rows.where(_all([c.over_bins(place) for c in rule])).agg(F.coalesce(F.sum(F.col("bad") * F.col("n")), F.lit(0)).alias("p"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return int(r.p), int(r.n - r.p)


def learn_rules(counted: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """An ordered list of conjunctions that reject; `counted` has doc_id and the counts, `labels` has doc_id and quality (0: reject).

    Labels that are null, or of ids not present, are not used; without labels of both kinds there are no rules.
    """
    own = features()
    place = {f: i for i, f in enumerate(own)}
    seen = (counted.where(~base_failed()).join(labels.where("quality in (0, 1)").select("doc_id", F.col("quality").alias("__tw_q")), "doc_id")
            .select((1 - F.col("__tw_q")).cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("held"), *[c.alias(f) for f, c in own.items()]))
    seen = cut_lineage(seen)
    probs = [i / BINS for i in range(BINS + 1)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    # cuts from the rows of each label: where most rows share one value, all quantiles of the whole may pass over what the rest hold
    by_label = seen.groupBy("bad").agg(*[F.percentile_approx(f, probs, 10000).alias(f) for f in own]).collect()                 # two rows
    if len(by_label) < 2 or any(row[f] is None for row in by_label for f in own):
        return []
    cuts = {f: sorted({x for row in by_label for x in row[f]}) for f in own}
    # bin k holds the values from cut k-1 up to, not including, cut k
    bins = [_bin(F.col(f), cuts[f]) for f in own]
    # equal rows are one row with their number; those to grow on are placed by (feature, bin) once, and every count reads these
    rows = cut_lineage(seen.select("bad", "held", F.array(*bins).alias("bins")).groupBy("bad", "held", "bins").agg(F.count(F.lit(1)).alias("n")))
    placed = cut_lineage(rows.where(~F.col("held")).select("bad", "n", "bins", F.posexplode("bins").alias("f", "bin")))
    uncovered = lambda part, known: part.where(~_any([_all([c.over_bins(place) for c in r]) for r in known]))
    rules: list[list[Condition]] = []
    refused: set[tuple[str, bool]] = set()
    # counted over all rows once: a refusal leaves them as they are, a rule takes away what it covers
    first = _counts(placed)
    # bounded: MAX_RULES rules and a refusal for each feature and side, small jobs over the labelled rows
    while len(rules) < MAX_RULES:
        left, held = uncovered(placed, rules), uncovered(rows.where("held"), rules)
        if _precision(held, [], place)[0] < MIN_SUPPORT:
            break                                                     # no rule could prove itself on what is left
        rule = _grow(left, first, cuts, place, refused)
        if not rule:
            break
        scored = []
        for size in range(len(rule), 0, -1):
            p, n = _precision(held, rule[:size], place)
            scored.append(((p - n) / (p + n) if p + n else -1.0, -size, p, n))
        value, size, p, n = max(scored)
        if p < MIN_SUPPORT or p < MIN_PRECISION * (p + n):
            refused.add((rule[0].feature, rule[0].above))
        else:
            rule = rule[:-size]
            gone = _counts(left.where(_all([c.over_bins(place) for c in rule])))
            first = {k: [n - g for n, g in zip(v, gone.get(k, (0, 0)))] for k, v in first.items()}
            rules.append(rule)
    return rules


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The number of the first rule that fits (from 1), 0 if none does: an ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        fits = _all([c.over_values() for c in rule])
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(counted: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """Adds base_failed, rule (0: none fits) and kept."""
    return counted.withColumns({"base_failed": base_failed(), "rule": verdict(rules)}).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document without its text, with its counts, base_failed, rule and kept; the rules are learned from `labels`.

    A null or empty text has no words and fails the base rules. Rows that repeat a doc_id are judged each by its text, and learn from each label
    of that id; a null doc_id has no label. Without usable labels only the base rules reject. An empty table gives no rows.
    """
    counted = stored(statistics(docs).drop("text"), "quality-counts")
    return judge(counted, learn_rules(counted, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, all columns as they were, that the base rules and the learned rules let pass."""
    # stored before the filter: pushed below, it would compute the counts anew inside its condition
    counted = stored(statistics(docs.select(F.struct(*carried(docs)).alias("__tw_row"), "doc_id", "text")).drop("text"), "quality-counts")
    return judge(counted, learn_rules(counted, labels)).where("kept").select("__tw_row.*")
