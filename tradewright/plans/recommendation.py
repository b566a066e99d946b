"""Recommendation and explanation queries (c18, c19, t13, x10, y1..y8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.operators import explain as E
from tradewright.operators import panels as P
from tradewright.operators import recommend as Y
from tradewright.plans import evaluation as ev
from tradewright.plans import panels as pp
from tradewright.plans.registry import register
from tradewright.session import stored

c = F.col
CUT = "2001-03-31"
V = {
    **pp.V,
    "bought": """SELECT customer, reference AS item, date, amount, family, type FROM (SELECT customer, reference, date, sum(amount) AS amount, min(family) AS family FROM lines WHERE amount > 0 AND family NOT LIKE 'SERVICE%' GROUP BY 1, 2, 3)
        JOIN (SELECT customer, CASE segment WHEN 'HOUSEHOLD' THEN 'public_hospital' WHEN 'MACHINERY' THEN 'private_clinic' WHEN 'FURNITURE' THEN 'laboratory' ELSE 'other' END AS type FROM customers) USING (customer)""",
    "past": f"SELECT * FROM bought WHERE date <= DATE '{CUT}'",
    "l12": f"SELECT * FROM past WHERE date > DATE '2000-03-31'",
    "own": "SELECT DISTINCT customer, item FROM past WHERE item IN (SELECT item FROM l12)",
    "sim": """SELECT a.item, b.item AS other, count(*) AS n_common, count(*) / sqrt(max(na) * max(nb)) AS similarity FROM own a JOIN own b ON a.customer = b.customer AND a.item <> b.item
        JOIN (SELECT item, count(*) AS na FROM own GROUP BY 1) x ON x.item = a.item JOIN (SELECT item, count(*) AS nb FROM own GROUP BY 1) z ON z.item = b.item GROUP BY 1, 2""",
    "near": """SELECT o.customer, s.other AS item, sum(similarity) AS knn_sum, max(similarity) AS knn_max FROM own o JOIN sim s ON s.item = o.item WHERE o.customer IN (SELECT customer FROM l12)
        AND NOT EXISTS (SELECT 1 FROM own w WHERE w.customer = o.customer AND w.item = s.other) GROUP BY 1, 2""",
    "pop": "SELECT item, count(DISTINCT customer) AS buyers FROM l12 GROUP BY 1",
    "popt": "SELECT type, item, count(DISTINCT customer) AS bt FROM l12 GROUP BY 1, 2",
    "adopt": f"""SELECT DISTINCT customer, item FROM bought WHERE date > DATE '{CUT}' AND date <= DATE '2001-06-30' AND item IN (SELECT item FROM l12) AND customer IN (SELECT customer FROM l12)
        AND NOT EXISTS (SELECT 1 FROM past p WHERE p.customer = bought.customer AND p.item = bought.item)""",
    "cand": """SELECT a.customer, pop.item, coalesce(knn_sum, 0) AS knn_sum, coalesce(knn_max, 0) AS knn_max FROM (SELECT DISTINCT customer FROM l12) a CROSS JOIN pop LEFT JOIN near ON near.customer = a.customer AND near.item = pop.item
        WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.customer = a.customer AND w.item = pop.item)""",
    "knn": """SELECT customer, item, score, row_number() OVER (PARTITION BY customer ORDER BY score DESC, item) AS rank FROM (SELECT customer, item, round(knn_sum + 1e-3 * ln(1 + buyers), 9) AS score FROM cand JOIN pop USING (item)) QUALIFY rank <= 10""",
    "places": "SELECT item, row_number() OVER (ORDER BY buyers DESC, item) - 1 AS place, count(*) OVER () AS n FROM pop",
    "walk": """SELECT customer, wish, step, (CAST('0x' || substr(md5(CAST(customer AS VARCHAR)), 1, 8) AS BIGINT) + step * CASE WHEN n % 7919 = 0 THEN 1 ELSE 7919 END) % n AS place FROM (
        SELECT customer, wish, n, unnest(range(0, least(wish + taken, n))) AS step FROM (SELECT customer, 10 * count(*) AS wish, count(*) + any_value(n_own) AS taken FROM adopt JOIN (SELECT customer, count(*) AS n_own FROM own GROUP BY 1) USING (customer) GROUP BY 1),
          (SELECT count(*) AS n FROM pop))""",
    "dealt": """SELECT customer, item FROM walk JOIN places USING (place) WHERE NOT EXISTS (SELECT 1 FROM own w WHERE w.customer = walk.customer AND w.item = places.item)
        AND NOT EXISTS (SELECT 1 FROM adopt w WHERE w.customer = walk.customer AND w.item = places.item) QUALIFY row_number() OVER (PARTITION BY customer ORDER BY step) <= wish""",
    "popular": """SELECT customer, item, buyers, row_number() OVER (PARTITION BY customer ORDER BY buyers DESC, item) AS rank FROM (SELECT DISTINCT customer FROM l12) a, pop
        WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.customer = a.customer AND p.item = pop.item) QUALIFY rank <= 10""",
}


def q(name, build, sql=None):
    register(name, build, sql, V)


def bought(t):
    """The purchases, worked out once for all that a query reads of them."""
    if not hasattr(t, "purchases_once"):
        t.purchases_once = stored(Y.purchases(t.sales_lines, t.customers), "purchases")
    return t.purchases_once


def cut(day=CUT):
    return F.lit(day).cast("date")


q("c18_similar_items", lambda t: Y.similar_items(bought(t)), """
  WITH o AS (SELECT DISTINCT customer, item FROM bought), n AS (SELECT item, count(*) AS n FROM o GROUP BY 1), s AS (SELECT a.item, b.item AS other, count(*) AS n_common FROM o a JOIN o b ON a.customer = b.customer AND a.item <> b.item GROUP BY 1, 2),
  z AS (SELECT s.item, other, n_common, n_common / sqrt(x.n * y.n) AS similarity FROM s JOIN n x ON x.item = s.item JOIN n y ON y.item = s.other)
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY round(z.similarity, 9) DESC, other) AS rank, other, n_common, round(z.similarity, 6) AS similarity FROM z QUALIFY rank <= 10""")
q("c19_unseen_candidates", lambda t: Y.knn_candidates(bought(t), cut()).select("customer", "item", F.round("knn_sum", 6).alias("knn_sum"), F.round("knn_max", 6).alias("knn_max")),
  "SELECT customer, item, round(knn_sum, 6) AS knn_sum, round(knn_max, 6) AS knn_max FROM cand")
q("y1_cutoff_dates", lambda t: Y.cutoff_dates(bought(t)), """
  WITH b AS (SELECT max(date) AS mx, min(date) AS mn FROM bought), k AS (SELECT CASE WHEN mx = last_day(mx) THEN mx ELSE last_day(CAST(mx - INTERVAL 1 MONTH AS DATE)) END AS done, CAST(date_trunc('month', mn) + INTERVAL 15 MONTH AS DATE) AS lo FROM b),
  h AS (SELECT last_day(CAST(done - INTERVAL 3 MONTH AS DATE)) AS hi, lo FROM k)
  SELECT last_day(CAST(hi - to_months(3 * i) AS DATE)) AS cutoff FROM h, (SELECT unnest(range(60)) AS i) WHERE last_day(CAST(hi - to_months(3 * i) AS DATE)) >= lo""")
q("y2_popular_unseen", lambda t: Y.popular_unseen(bought(t), cut()), "SELECT customer, item, rank, buyers FROM popular")
q("y2_popular_unseen_by_type", lambda t: Y.popular_unseen(bought(t), cut(), by_type=True), """
  SELECT customer, item, row_number() OVER (PARTITION BY customer ORDER BY bt DESC, item) AS rank, bt AS buyers FROM (SELECT DISTINCT customer, type FROM l12) a JOIN popt USING (type)
  WHERE NOT EXISTS (SELECT 1 FROM past p WHERE p.customer = a.customer AND p.item = popt.item) QUALIFY rank <= 10""")
q("y2_g3_item_knn_lists", lambda t: Y.knn_lists(bought(t), cut()).select("customer", "item", "rank", F.round("score", 6).alias("score")), "SELECT customer, item, rank, round(score, 6) AS score FROM knn")
LM = """, n AS (SELECT customer, count(*) AS np FROM adopt GROUP BY 1), t AS (SELECT l.*, CASE WHEN a.item IS NULL THEN 0 ELSE 1 END AS y, np FROM l LEFT JOIN adopt a USING (customer, item) JOIN n USING (customer)),
  p AS (SELECT *, sum(y) OVER (PARTITION BY customer ORDER BY rank) / rank AS pr FROM t),
  g AS (SELECT customer, max(y)::DOUBLE AS hit, sum(y) / 10.0 AS precision, sum(y) / max(np) AS recall, sum(y / log2(rank + 1)) / list_sum(list_transform(range(1, least(max(np), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg,
    sum(pr * y) / least(max(np), 10) AS map FROM p GROUP BY 1)
  SELECT count(*) AS customers, round(avg(hit), 6) AS hit, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(map), 6) AS map,
    round((SELECT count(DISTINCT item) FROM l) / (SELECT count(*) FROM pop), 6) AS coverage FROM g"""


def _summary(t, lists):
    b = bought(t)
    return X.list_summary(X.list_metrics(lists, Y.adoptions(b, cut())), lists, Y.popularity(b, cut()))


q("x10_f15_knn_list_metrics", lambda t: _summary(t, Y.knn_lists(bought(t), cut())), "WITH l AS (SELECT customer, item, rank FROM knn)" + LM)
q("x10_popularity_list_metrics", lambda t: _summary(t, Y.popular_unseen(bought(t), cut())), "WITH l AS (SELECT customer, item, rank FROM popular)" + LM)
NDCG = """SELECT l.customer, sum(CASE WHEN a.item IS NULL THEN 0 ELSE 1 / log2(rank + 1) END) / list_sum(list_transform(range(1, least(max(np), 10) + 1), lambda i: 1 / log2(i + 1))) AS v FROM {0} l LEFT JOIN adopt a USING (customer, item)
  JOIN (SELECT customer, count(*) AS np FROM adopt GROUP BY 1) n ON n.customer = l.customer GROUP BY 1"""


def ndcg_pairs(t):
    """NDCG of the similarity lists and of the popularity lists, a row for each adopting customer."""
    b = bought(t)
    adopted = Y.adoptions(b, cut())
    a, p = (X.list_metrics(lists, adopted).select("customer", c("ndcg").alias(name)) for lists, name in ((Y.knn_lists(b, cut()), "a"), (Y.popular_unseen(b, cut()), "b")))
    return a.join(p, "customer", "full").fillna(0.0).withColumn("base", F.lit(1))


q("x5_bootstrap_ndcg_gap", lambda t: X.bootstrap_gap(ndcg_pairs(t), "customer", "a", "b", "base"), f"""
  WITH u AS (SELECT customer, coalesce(x.v, 0) AS a, coalesce(y.v, 0) AS b, 1 AS base FROM ({NDCG.format('knn')}) x FULL JOIN ({NDCG.format('popular')}) y USING (customer)), {ev.RESAMPLED}""")
q("t13_recommendation_examples", lambda t: pp.rnd(Y.examples(bought(t), cut()), Y.EXAMPLE_FEATURES), f"""
  WITH e AS (SELECT cand.*, y FROM cand JOIN (SELECT customer, item, 1 AS y FROM adopt UNION ALL SELECT customer, item, 0 FROM dealt) USING (customer, item)),
  b3 AS (SELECT item, count(DISTINCT customer) AS b3 FROM l12 WHERE date > DATE '2000-12-31' GROUP BY 1), pr AS (SELECT item, sum(amount) AS pr FROM l12 GROUP BY 1), fi AS (SELECT item, min(date) AS fd, min(family) AS family FROM bought GROUP BY 1),
  nt AS (SELECT type, count(DISTINCT customer) AS nt FROM l12 GROUP BY 1), ow AS (SELECT customer, count(*) AS n_own FROM own GROUP BY 1), fa AS (SELECT customer, family, count(*) AS nf FROM own JOIN fi USING (item) GROUP BY 1, 2),
  cu AS (SELECT customer, min(type) AS type, max(date) AS ld FROM past GROUP BY 1), cr AS (SELECT customer, sum(amount) AS cr, count(DISTINCT date_trunc('month', date)) AS am FROM l12 GROUP BY 1)
  SELECT customer, item, y, {pp.rsql([])}round(ln(1 + buyers) + 1e-9, 6) AS log_buyers_12m, round(ln(1 + coalesce(b3, 0)) + 1e-9, 6) AS log_buyers_3m, round(ln(1 + coalesce(b3, 0) * 4) - ln(1 + buyers) + 1e-9, 6) AS trend,
    round(ln(1 + coalesce(bt, 0)) + 1e-9, 6) AS log_buyers_type, round(coalesce(bt, 0) / nt + 1e-9, 6) AS share_type, round(knn_sum + 1e-9, 6) AS knn_sum, round(knn_max + 1e-9, 6) AS knn_max,
    round(datediff('day', fd, DATE '{CUT}') / 365.0::DOUBLE + 1e-9, 6) AS item_age_years, round(ln(1 + pr) + 1e-9, 6) AS log_item_revenue, round(ln(1 + n_own) + 1e-9, 6) AS log_owned, round(ln(1 + cr) + 1e-9, 6) AS log_customer_revenue,
    round(am / 12.0::DOUBLE + 1e-9, 6) AS active_share, round(datediff('day', ld, DATE '{CUT}') / 365.0::DOUBLE + 1e-9, 6) AS recency_years, round(coalesce(nf, 0) / n_own + 1e-9, 6) AS family_share,
    round(CASE WHEN nf > 0 THEN 1.0 ELSE 0.0 END + 1e-9, 6)::DOUBLE AS family_known
  FROM e JOIN cu USING (customer) JOIN cr USING (customer) JOIN ow USING (customer) JOIN fi USING (item) JOIN pr USING (item) JOIN pop USING (item) LEFT JOIN b3 USING (item) LEFT JOIN popt USING (type, item) JOIN nt USING (type)
  LEFT JOIN fa USING (customer, family)""")
q("y3_learned_ranker", lambda t: _summary(t, Y.learned_lists(bought(t), cut("2000-12-31"), cut())))
q("y3_boosted_ranker", lambda t: _summary(t, Y.learned_lists(bought(t), cut("2000-12-31"), cut(), kind="boosted")))
q("y4_recommendation_table", lambda t: Y.recommendation_table(bought(t), Y.knn_lists(bought(t), cut()), cut()), """
  WITH sp AS (SELECT item, round(median(a) + 1e-7::DOUBLE, 4) AS median_yearly_spend FROM (SELECT item, customer, sum(amount) AS a FROM l12 GROUP BY 1, 2) GROUP BY 1)
  SELECT k.customer, rank, item, median_yearly_spend, buyers AS item_buyers, round(coalesce(bt, 0) * 100.0 / nt, 6) AS type_adoption_pct FROM knn k JOIN (SELECT customer, min(type) AS type FROM bought GROUP BY 1) USING (customer) JOIN pop USING (item) JOIN sp USING (item)
  LEFT JOIN popt USING (type, item) JOIN (SELECT type, count(DISTINCT customer) AS nt FROM l12 GROUP BY 1) USING (type)""")
q("y4_potential", lambda t: Y.potential(Y.recommendation_table(bought(t), Y.knn_lists(bought(t), cut()), cut())), """
  WITH sp AS (SELECT item, round(median(a) + 1e-7::DOUBLE, 4) AS s FROM (SELECT item, customer, sum(amount) AS a FROM l12 GROUP BY 1, 2) GROUP BY 1) SELECT customer, round(sum(s), 2) AS potential FROM knn JOIN sp USING (item) WHERE rank <= 3 GROUP BY 1""")

# ------------------------------------------------------------ explanations
WEIGHTS = {"recency_days": 0.8, "freq_12m": -0.6, "log_rev_12m": -0.4, "recency_gap_ratio": 0.5, "gap_std": 0.1}
KEY = ["customer", "obs_date"]
ZS = {f: f"(round({f} + 1e-9, 6) - avg(round({f} + 1e-9, 6)) OVER ()) / stddev_pop(round({f} + 1e-9, 6)) OVER ()" for f in WEIGHTS}
V["parts"] = "SELECT customer, obs_date, " + ", ".join(f"round({f} + 1e-9, 6) AS {f}, {w}::DOUBLE * {ZS[f]} AS c_{f}, stddev_pop(round({f} + 1e-9, 6)) OVER () AS sd_{f}, min(round({f} + 1e-9, 6)) OVER () AS lo_{f}, max(round({f} + 1e-9, 6)) OVER () AS hi_{f}" for f, w in WEIGHTS.items()) + " FROM churn"
V["xpl"] = "SELECT *, " + " + ".join(f"c_{f}" for f in WEIGHTS) + " AS score, " + " + ".join(f"abs(c_{f})" for f in WEIGHTS) + " AS total FROM parts"
V["plong"] = "SELECT customer, obs_date, score, total, unnest([" + ", ".join(f"'{f}'" for f in WEIGHTS) + "]) AS feature, unnest([" + ", ".join(f"c_{f}" for f in WEIGHTS) + "]) AS part FROM xpl"


def explained(t):
    p = pp.rnd(pp.churn(t), list(WEIGHTS))
    return E.contributions(p, E.moments(p, list(WEIGHTS)), WEIGHTS)


q("y5_linear_contributions", lambda t: E.reasons(explained(t), KEY), """
  WITH s AS (SELECT *, CASE WHEN part * score > 0 THEN 'for' ELSE 'against' END AS side FROM plong WHERE part * score <> 0), k AS (SELECT *, row_number() OVER (PARTITION BY customer, obs_date, side ORDER BY abs(part) DESC, feature) AS r FROM s),
  f AS (SELECT *, row_number() OVER (PARTITION BY customer, obs_date ORDER BY side DESC, r) AS position FROM k WHERE r <= CASE WHEN side = 'for' THEN 3 ELSE 1 END)
  SELECT customer, obs_date, round(score, 6) AS score, position, side, feature, round(part, 6) AS part, round(abs(f.part) / total * 100, 4) AS share_pct FROM f""")
q("y5_percentile_position", lambda t: E.percentile_position(pp.churn(t).select(*KEY, "recency_days"), pp.churn(t), "recency_days").select(*KEY, F.round("pct", 6).alias("pct")), """
  SELECT customer, obs_date, round(count(*) OVER (ORDER BY recency_days) * 100.0::DOUBLE / count(*) OVER (), 6) AS pct FROM churn""")
RULES = [("recency_days", ">", 120.0, 2.0), ("recency_days", ">", 300.0, 3.0), ("freq_12m", "<", 4.0, 1.5), ("revenue_trend", "<", 0.5, 1.0)]
q("y6_threshold_reasons", lambda t: E.threshold_reasons(pp.rnd(pp.churn(t), ["revenue_trend"]), KEY, RULES), """
  WITH h AS (SELECT customer, obs_date, unnest(['recency_days', 'recency_days', 'freq_12m', 'revenue_trend']) AS variable, unnest([120.0, 300.0, 4.0, 0.5])::DOUBLE AS threshold,
    unnest([CASE WHEN recency_days > 120 THEN 2 * (1 + abs(recency_days - 120) / 120) END, CASE WHEN recency_days > 300 THEN 3 * (1 + abs(recency_days - 300) / 300) END, CASE WHEN freq_12m < 4 THEN 1.5::DOUBLE * (1 + abs(freq_12m - 4) / 4) END,
      CASE WHEN round(revenue_trend + 1e-9, 6) < 0.5 THEN 1 + abs(round(revenue_trend + 1e-9, 6) - 0.5::DOUBLE) / 0.5::DOUBLE END]) AS strength FROM churn),
  b AS (SELECT customer, obs_date, variable, max(strength) AS strength, arg_max(threshold, strength) AS threshold FROM h WHERE strength IS NOT NULL GROUP BY 1, 2, 3)
  SELECT customer, obs_date, row_number() OVER (PARTITION BY customer, obs_date ORDER BY b.strength DESC, variable DESC) AS position, variable, threshold, round(b.strength, 6) AS strength FROM b QUALIFY position <= 3""")
ACT = ["recency_days", "freq_12m", "gap_std"]
q("y7_counterfactual", lambda t: E.counterfactual(explained(t), KEY, WEIGHTS, ACT, 0.5), """
  WITH o AS (SELECT customer, obs_date, score, """ + "unnest([" + ", ".join(f"'{f}'" for f in ACT) + "]) AS feature, unnest([" + ", ".join(ACT) + "]) AS v, unnest([" + ", ".join(f"{f} + (0.5 - score) / {WEIGHTS[f]}::DOUBLE * sd_{f}" for f in ACT)
  + "]) AS n, unnest([" + ", ".join(f"sd_{f}" for f in ACT) + "]) AS sd, unnest([" + ", ".join(f"lo_{f}" for f in ACT) + "]) AS lo, unnest([" + ", ".join(f"hi_{f}" for f in ACT) + """]) AS hi FROM xpl WHERE score > 0.5),
  k AS (SELECT *, abs(n - v) / sd AS e, row_number() OVER (PARTITION BY customer, obs_date ORDER BY abs(n - v) / sd, feature) AS r FROM o WHERE n BETWEEN lo AND hi)
  SELECT x.customer, x.obs_date, round(x.score, 6) AS score, feature, round(v, 4) AS from_value, round(n, 4) AS to_value, round(e, 6) AS effort FROM (SELECT * FROM xpl WHERE score > 0.5) x LEFT JOIN (SELECT * FROM k WHERE r = 1) k
    ON k.customer = x.customer AND k.obs_date = x.obs_date""")
q("y8_deletion_fidelity", lambda t: E.deletion_fidelity(explained(t)), """
  WITH k AS (SELECT *, row_number() OVER (PARTITION BY customer, obs_date ORDER BY abs(part) DESC, feature) AS a, row_number() OVER (PARTITION BY customer, obs_date ORDER BY md5(feature)) AS b FROM plong),
  s AS (SELECT customer, obs_date, abs(sum(part) FILTER (a <= 2)) AS t, abs(sum(part) FILTER (b <= 2)) AS r FROM k GROUP BY 1, 2)
  SELECT count(*) AS rows, round(avg(t), 6) AS top_change, round(avg(r), 6) AS random_change, avg(t) > avg(r) AS faithful FROM s""")
