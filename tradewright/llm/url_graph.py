"""URL filter: rules first, then trust and distrust carried over the link graph of hosts, in built-in functions only.

Trust is a personalised PageRank from hosts whose pages rules allow; distrust the same over reversed links from
hosts whose pages rules block. A seed's weight is the share of its pages that rules decide so; a host without links
onward keeps its score, so a host that no link touches scores its own share, and in a set of hosts that link to each
other the mean score is the mean share. These scores are split among a host's neighbours, so beside them stand two
that are not: a host's distrust is the mean of its own share and, by its links, of the hosts it links to; its trust the same over
the hosts that link to it. A host whose distrust exceeds its trust by `THRESHOLD` in either pair is blocked, however many link alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewright.llm.common import carried, lower_ascii
from tradewright.session import cut_lineage, stored

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DAMPING = 0.7
ROUNDS = 30
TOLERANCE = 1e-4
THRESHOLD = 0.5
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, null if none does: its host or a subdomain, and a path that starts with its path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _of_rule(rule: Column, rules: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, verdict in rules:
        out = F.when(rule == name, F.lit(verdict)).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, with the number of pages' links; relative links stay on their host."""
    out = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    out = out.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): personalised PageRank along (src, dst, n) from seeds (host, weight).

    Each round sends a host's score along its links in proportion to n. Every round is checkpointed; one number of it
    reaches the driver, and the rounds end when no score moves by more than `TOLERANCE`.
    """
    if links.limit(1).count() == 0:
        return seeds.groupBy("host").agg(F.sum("weight").alias("score"))
    base = cut_lineage(seeds.groupBy("host").agg((F.sum("weight") * (1 - damping)).alias("base")))
    ends = links.select(F.col("dst").alias("src")).union(seeds.select("host")).distinct().join(links.select("src"), "src", "left_anti")
    links = links.select("src", "dst", "n").union(ends.select("src", F.col("src").alias("dst"), F.lit(1).cast("long")))
    out_links = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = cut_lineage(links.join(out_links, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    return _settled(base, shares.select("src", "dst", (F.col("share") * damping).alias("share")), base.select("host", F.col("base").alias("score")), rounds)


def _settled(base: DataFrame, shares: DataFrame, score: DataFrame, rounds: int) -> DataFrame:
    """(host, score): base (host, base) and what each dst gets of the scores of src by (src, dst, share), until no score moves by more than `TOLERANCE`."""
    for _ in range(rounds):
        sent = shares.join(score, shares.src == score.host).select(F.col("dst").alias("host"), (F.col("score") * F.col("share")).alias("next"), F.lit(0.0).alias("old"))
        # summed, not joined: estimated sizes of joined rounds multiply until planning stands still
        rows = sent.unionByName(base.select("host", F.col("base").alias("next"), F.lit(0.0).alias("old"))).unionByName(score.select("host", F.lit(0.0).alias("next"), F.col("score").alias("old")))
        step = cut_lineage(rows.groupBy("host").agg(F.sum("next").alias("score"), F.sum("old").alias("old")).select("host", "score", F.abs(F.col("score") - F.col("old")).alias("moved")))
        score = step.select("host", "score")
        if (step.agg(F.max("moved")).first()[0] or 0.0) <= TOLERANCE:
            break
    return score


def averaged(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, score): each host's own weight of seeds (host, weight), and by `damping` the mean score of the hosts it links to along (src, dst, n).

    A host without links keeps its weight. A score does not depend on how many hosts link to the same ones; it never leaves the range of the
    weights, so each round moves it by `damping` times the last move at most. Rounds are checkpointed and end as those of `propagate`.
    """
    out_links = links.groupBy("src").agg(F.sum("n").alias("total"))
    shares = cut_lineage(links.join(out_links, "src").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total") * damping).alias("share")))
    own = seeds.groupBy("host").agg(F.sum("weight").alias("weight"))
    own = cut_lineage(own.join(out_links, own.host == out_links.src, "full").select(F.coalesce("host", "src").alias("host"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.col("src").isNotNull().alias("links")))
    base = own.select("host", F.when(F.col("links"), F.col("weight") * (1 - damping)).otherwise(F.col("weight")).alias("base"))
    return _settled(base, shares, own.select("host", F.col("weight").alias("score")), rounds)


def judge_pages(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """The pages without html, with host, path, rule, trust, distrust and verdict added.

    A null url or one without :// has an empty host and path, fits no rule and is allowed, as is a host that no
    score reaches. Null html has no links. Repeated rows are judged alike and count each; an empty table gives no
    rows. Columns named like a result give way to it.
    """
    made = ("host", "path", "rule", "trust", "distrust", "verdict")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.drop("html").select(*carried(pages.drop("html"), *made), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = parsed.select("host", _of_rule(F.col("rule"), rules).alias("said")).where("host <> ''")
    seeds = cut_lineage(said.groupBy("host").agg((F.count_if(F.col("said") == "allow") / F.count(F.lit(1))).alias("good"), (F.count_if(F.col("said") == "block") / F.count(F.lit(1))).alias("bad")))
    links = stored(host_links(pages), "host-links")
    trust = propagate(links, seeds.where("good > 0").select("host", F.col("good").alias("weight"))).select(F.col("host").alias("__tw_host"), F.col("score").alias("__tw_trust"))
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds.where("bad > 0").select("host", F.col("bad").alias("weight"))).select(F.col("host").alias("__tw_host"), F.col("score").alias("__tw_distrust"))
    scores = trust.join(distrust, "__tw_host", "full")
    if links.limit(1).count():
        near_good = averaged(back, seeds.select("host", F.col("good").alias("weight"))).select(F.col("host").alias("__tw_host"), F.col("score").alias("__tw_near_good"))
        near_bad = averaged(links, seeds.select("host", F.col("bad").alias("weight"))).select(F.col("host").alias("__tw_host"), F.col("score").alias("__tw_near_bad"))
        near = near_good.join(near_bad, "__tw_host", "full").select("__tw_host", (F.coalesce("__tw_near_bad", F.lit(0.0)) - F.coalesce("__tw_near_good", F.lit(0.0))).alias("__tw_near"))
        scores = scores.join(near, "__tw_host", "full")
    else:
        scores = scores.withColumn("__tw_near", F.lit(0.0))
    # few columns for each page; a host with very many pages is split by the adaptive skew join
    joined = parsed.join(scores, parsed.host == scores["__tw_host"], "left").withColumns(
        {"trust": F.coalesce("__tw_trust", F.lit(0.0)), "distrust": F.coalesce("__tw_distrust", F.lit(0.0))}).drop("__tw_host", "__tw_trust", "__tw_distrust")
    apart = F.greatest(F.col("distrust") - F.col("trust"), F.coalesce("__tw_near", F.lit(0.0)))
    method = F.when(apart > THRESHOLD, "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce(_of_rule(F.col("rule"), rules), method)).drop("__tw_near")
