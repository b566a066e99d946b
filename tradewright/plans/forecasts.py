"""Demand-forecast queries (g7..g18) with SQL checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewright.functions import rules as R
from tradewright.functions.bootstrap import weight_sql
from tradewright.operators import forecasting as G
from tradewright.operators import panels as P
from tradewright.plans import panels as pp
from tradewright.plans.registry import register
from tradewright.session import cut_lineage

c = F.col


def _w(k):
    return f"w{k} AS (PARTITION BY reference ORDER BY m ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def rules_sql(src, h=1):
    return f"""SELECT *, 0.0::DOUBLE AS zero, y AS last, s AS seasonal, CASE WHEN n15 >= 15 THEN s * least(greatest(CASE WHEN p3 > 0 THEN mean_3 / p3 ELSE 1 END, 0.5), 2) END AS seasonal_growth,
        CASE WHEN has THEN s * least(greatest(CASE WHEN pv > 0 THEN mean_12 / pv ELSE 1 END, 0.5), 2) ELSE s END AS seasonal_level, greatest(coalesce(ri + rs * (t + {h}), y), 0) AS trend FROM (
      SELECT reference, m, t, y, coalesce(lag(y, {12 - h}) OVER o, y) AS s, lag(y, {12 - h}) OVER o IS NOT NULL AS has, {", ".join(f"avg(y) OVER w{k} AS mean_{k}, median(y) OVER w{k} AS median_{k}" for k in (3, 6, 12))},
        avg(y) OVER wp AS pv, avg(y) OVER wq AS p3, count(*) OVER w15 AS n15, regr_intercept(y, t) OVER w12 AS ri, regr_slope(y, t) OVER w12 AS rs, lead(y, {h}) OVER o AS target,
        count(CASE WHEN y > 0 THEN 1 END) OVER w24 >= 6 AND count(CASE WHEN y > 0 THEN 1 END) OVER w12 >= 1 AS eligible, count(*) OVER w24 AS n24, count(CASE WHEN y > 0 THEN 1 END) OVER w24 AS a24,
        avg(CASE WHEN y > 0 THEN y END) OVER w24 AS m24, stddev_pop(CASE WHEN y > 0 THEN y END) OVER w24 AS s24, CASE WHEN count(*) OVER wf = 3 THEN sum(y) OVER wf END AS next_3, list(y) OVER w24 AS v
      FROM {src} WINDOW o AS (PARTITION BY reference ORDER BY m), {", ".join(_w(k) for k in (3, 6, 12, 15, 24))}, wp AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 23 PRECEDING AND 12 PRECEDING),
        wq AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 14 PRECEDING AND 12 PRECEDING), wf AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))"""


CLASS = "CASE WHEN a24 < 2 THEN 'insufficient' WHEN n24 / a24 < 1.32 THEN CASE WHEN pow(s24 / m24, 2) < 0.49 THEN 'smooth' ELSE 'erratic' END WHEN pow(s24 / m24, 2) < 0.49 THEN 'intermittent' ELSE 'lumpy' END"
V = {**pp.V, "rules": rules_sql("refgrid"), "mkt": "SELECT 'market' AS reference, m, t, sum(y) AS y FROM refgrid GROUP BY 2, 3", "mrules": rules_sql("mkt"),
     "ctx": f"""SELECT *, {CLASS} AS class, abs(median_12 - target) AS ea, abs(mean_3 - target) AS eb, CASE WHEN target = 0 THEN 'zero' WHEN target < 0.5 * greatest(median_12, mean_12) THEN 'dip'
        WHEN target > 2 * greatest(median_12, mean_12) AND target > greatest(median_12, mean_12) + 3 THEN 'peak' ELSE 'normal' END AS type FROM rules WHERE eligible AND target IS NOT NULL"""}
ERR = """count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg(pow(yhat - y, 2))), 6) AS rmse, round(sum(abs(yhat - y)) * 100 / sum(abs(y)), 6) AS wape_pct, round(sum(yhat - y) * 100 / sum(y), 6) AS bias_pct,
    round(avg(CASE WHEN y <> 0 THEN abs(yhat - y) / abs(y) END) * 100, 6) AS mape_pct"""
LONG = "unnest([" + ", ".join(f"'{r}'" for r in G.RULES) + "]) AS rule, unnest([" + ", ".join(f"{r}::DOUBLE" for r in G.RULES) + "]) AS yhat"


def q(name, build, sql=None):
    register(name, build, sql, V)


def dem(t):
    return pp.ref_demand(t)


q("g7_base_rules", lambda t: pp.rnd(G.base_rules(dem(t)).filter("target is not null").select("reference", "m", *G.RULES, "target"), [r for r in G.RULES if r != "zero"], 4), f"""
  SELECT reference, m, zero, {pp.rsql([r for r in G.RULES if r != "zero"], 4)}, target FROM rules WHERE target IS NOT NULL""")
_NZ = "list_filter(v, lambda x: x > 0)"
_SM = "list_sum(list_transform({z}, lambda x, i: x * CASE WHEN i = 1 THEN pow(1 - {a}, len({z}) - 1) ELSE {a} * pow(1 - {a}, len({z}) - i) END))"
_TZ = "pow(1 - {a}, k) * list_avg(nz) + list_sum(list_transform(nz, lambda x, i: x * {a} * pow(1 - {a}, k - i)))"
_TP = "pow(1 - {a}, len(v)) * k / len(v) + list_sum(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN {a} * pow(1 - {a}, len(v) - i) ELSE 0 END))"
q("g8_intermittent_demand", lambda t: pp.rnd(G.intermittent_forecasts(dem(t)), [f"{k}_{a}" for a in (1, 2, 3) for k in ("croston", "sba", "tsb")]), f"""
  WITH a AS (SELECT reference, list(y ORDER BY m) AS v FROM refgrid WHERE m > (SELECT max(m) FROM refgrid) - 24 GROUP BY 1), b AS (SELECT *, {_NZ} AS nz, list_filter(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL) AS p FROM a),
  d AS (SELECT *, len(nz) AS k, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - p[i - 1] END) AS g FROM b)
  SELECT reference, {", ".join(f"round(CASE WHEN k = 0 THEN 0 ELSE {_SM.format(z='nz', a=f'0.{i}::DOUBLE')} / greatest({_SM.format(z='g', a=f'0.{i}::DOUBLE')}, 1) * {1.0 if n == 'croston' else 1 - i / 20} END + 1e-9, 6) AS {n}_{i}" for i in (1, 2, 3) for n in ('croston', 'sba'))},
    {", ".join(f"round(CASE WHEN k = 0 THEN 0 ELSE ({_TZ.format(a=f'0.{i}::DOUBLE')}) * ({_TP.format(a=f'0.{i}::DOUBLE')}) END + 1e-9, 6) AS tsb_{i}" for i in (1, 2, 3))} FROM d""")
SCORES = f"""WITH l AS (SELECT target AS y, {LONG} FROM rules WHERE eligible AND target IS NOT NULL AND m > (SELECT max(m) FROM refgrid) - 13), s AS (SELECT rule, {ERR} FROM l WHERE yhat IS NOT NULL GROUP BY 1)"""
q("g9_rule_scores", lambda t: G.rule_scores(dem(t)), SCORES + " SELECT * FROM s")
_ALL = (*G.RULES, *G.INTERMITTENT)
_SMOOTHED = ", ".join(f"CASE WHEN k = 0 THEN 0 ELSE {_SM.format(z='nz', a=f'0.{i}::DOUBLE')} / greatest({_SM.format(z='g', a=f'0.{i}::DOUBLE')}, 1) * {1.0 if n == 'croston' else 1 - i / 20} END AS {n}_{i}" for i in (1, 2, 3) for n in ("croston", "sba"))
_TSB = ", ".join(f"CASE WHEN k = 0 THEN 0 ELSE ({_TZ.format(a=f'0.{i}::DOUBLE')}) * ({_TP.format(a=f'0.{i}::DOUBLE')}) END AS tsb_{i}" for i in (1, 2, 3))
V["walk"] = f"""WITH a AS ({" UNION ALL ".join(f"SELECT {h} AS h, * FROM ({rules_sql('refgrid', h)})" for h in G.HORIZONS)}), hi AS (SELECT max(m) AS hi FROM refgrid),
  e AS (SELECT a.*, CASE WHEN m >= hi - 18 THEN 'test' ELSE 'validation' END AS phase, {_NZ} AS nz, list_filter(list_transform(v, lambda x, i: CASE WHEN x > 0 THEN i END), lambda x: x IS NOT NULL) AS p FROM a, hi
    WHERE eligible AND target IS NOT NULL AND m >= hi - 30),
  d AS (SELECT *, len(nz) AS k, list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - p[i - 1] END) AS g FROM e), w AS (SELECT *, {_SMOOTHED}, {_TSB} FROM d),
  l AS (SELECT reference, m, h, phase, target AS y, unnest([{", ".join(f"'{r}'" for r in _ALL)}]) AS rule, unnest([{", ".join(f"{r}::DOUBLE" for r in _ALL)}]) AS yhat FROM w)
  SELECT * FROM l WHERE yhat IS NOT NULL"""
V["wscores"] = f"SELECT phase, h, rule, {ERR} FROM walk GROUP BY ALL"
V["wchoice"] = """SELECT a.h, a.rule, a.wape_pct AS validation_wape_pct, b.wape_pct AS test_wape_pct FROM wscores a LEFT JOIN wscores b ON b.phase = 'test' AND a.h = b.h AND a.rule = b.rule
  WHERE a.phase = 'validation' QUALIFY row_number() OVER (PARTITION BY a.h ORDER BY a.wape_pct, a.rule) = 1"""
V["wroles"] = f"SELECT 'chosen' AS role, rule FROM wchoice WHERE h = 1 UNION ALL SELECT 'reference', '{G.REFERENCE_RULE}'"


def walk(t):
    return cut_lineage(G.rules_at_origins(dem(t)))


q("g9_walk_forward_scores", lambda t: G.walk_forward_scores(G.rules_at_origins(dem(t))), "SELECT * FROM wscores")
q("g9_chosen_rule", lambda t: G.chosen_rule(G.walk_forward_scores(G.rules_at_origins(dem(t)))), "SELECT * FROM wchoice")
q("g9_protocol_report", lambda t: G.protocol_report(walk(t)), """
  WITH l AS (SELECT * FROM walk JOIN wroles USING (rule)), c AS (SELECT role, phase, reference, m, sum(y) AS y, sum(yhat) AS yhat FROM l GROUP BY ALL HAVING count(*) = 3),
  s AS (SELECT role, phase, round(sum(abs(yhat - y)) * 100 / sum(y), 6) AS wape_3_months FROM c GROUP BY ALL),
  o AS (SELECT role, rule, phase, """ + ", ".join(f"round(sum(abs(yhat - y)) FILTER (h = {h}) * 100 / sum(y) FILTER (h = {h}), 6) AS wape_h{h}" for h in G.HORIZONS) + """,
    round(sum(yhat - y) FILTER (h = 1) * 100 / sum(y) FILTER (h = 1), 6) AS bias_h1 FROM l GROUP BY ALL)
  SELECT o.*, wape_3_months FROM o LEFT JOIN s USING (role, phase)""")
q("g9_served_rule", lambda t: G.served_rule(walk(t)), f"""
  WITH l AS (SELECT * FROM walk JOIN wroles USING (rule) WHERE phase = 'test' AND h = 1), u AS (SELECT reference, sum(abs(yhat - y)) FILTER (role = 'reference') AS a, sum(abs(yhat - y)) FILTER (role = 'chosen') AS b,
    sum(y) FILTER (role = 'reference') AS base FROM l GROUP BY 1),
  r AS (SELECT u.*, rep, {weight_sql("reference", "rep")} AS w FROM u, (SELECT unnest(range(1, 2001)) AS rep)), g AS (SELECT (sum(w * a) - sum(w * b)) / sum(w * base) * 100 AS gap FROM r GROUP BY rep),
  i AS (SELECT count(*) AS replicates, round(quantile_cont(gap, 0.025), 5) AS low, round(quantile_cont(gap, 0.975), 5) AS high FROM g),
  o AS (SELECT round((sum(a) - sum(b)) * 100 / sum(base), 6) AS gain FROM u), c AS (SELECT rule FROM wroles WHERE role = 'chosen')
  SELECT rule AS candidate, gain, replicates, low, high, gain >= {G.MIN_GAIN} AND low > 0 AS deployed, CASE WHEN gain >= {G.MIN_GAIN} AND low > 0 THEN rule ELSE '{G.REFERENCE_RULE}' END AS served FROM c, o, i""")
q("g9_market_rule_mape", lambda t: G.market_rule_mape(dem(t)), f"""
  WITH l AS (SELECT m, target, {LONG} FROM mrules WHERE target > 0 AND m > (SELECT max(m) FROM mrules WHERE target > 0) - 24)
  SELECT rule, count(*) AS origins, round(avg(abs(target - yhat) / target) * 100, 6) AS mape_pct FROM l WHERE yhat > 0 AND rule <> 'zero' GROUP BY 1""")
q("g10_recursive_forecast", lambda t: pp.rnd(G.recursive_forecast(dem(t), "mean_3"), ["step_1", "step_2", "step_3"]), """
  WITH a AS (SELECT reference, list(y ORDER BY m) AS v FROM refgrid WHERE m > (SELECT max(m) FROM refgrid) - 24 GROUP BY 1), s AS (SELECT *, (v[-1] + v[-2] + v[-3]) / 3 AS a FROM a), u AS (SELECT *, (v[-1] + v[-2] + a) / 3 AS b FROM s)
  SELECT reference, round(a + 1e-9, 6) AS step_1, round(b + 1e-9, 6) AS step_2, round((v[-1] + a + b) / 3 + 1e-9, 6) AS step_3 FROM u""")
q("g11_market_intervals", lambda t: G.market_intervals(dem(t), "mean_3"), """
  WITH e AS (SELECT quantile_cont((target - mean_3) / mean_3, [0.1, 0.25, 0.75, 0.9]) AS q FROM mrules WHERE target > 0 AND mean_3 > 0 AND m > (SELECT max(m) FROM mrules) - 25),
  v AS (SELECT list(y ORDER BY m) AS v FROM mkt), s AS (SELECT *, (v[-1] + v[-2] + v[-3]) / 3 AS a FROM v), u AS (SELECT *, (v[-1] + v[-2] + a) / 3 AS b FROM s), f AS (SELECT unnest([1, 2, 3]) AS step, unnest([a, b, (v[-1] + a + b) / 3]) AS p FROM u)
  SELECT step, round(p, 4) AS forecast, round(greatest(0, p * (1 + q[1] * sqrt(step))), 4) AS low_80, round(p * (1 + q[4] * sqrt(step)), 4) AS high_80, round(greatest(0, p * (1 + q[2] * sqrt(step))), 4) AS low_50,
    round(p * (1 + q[3] * sqrt(step)), 4) AS high_50 FROM f, e""")
SC = f"""WITH s AS (SELECT *, CASE WHEN {CLASS} = 'smooth' THEN 'smooth' ELSE 'other' END AS grp, greatest(mean_12, 0.5) AS sc, m > (SELECT max(m) FROM refgrid) - 12 AS after FROM rules WHERE eligible)"""
q("g12_conformal_bounds", lambda t: G.conformal_bounds(dem(t)), SC + """
  , r AS (SELECT grp, after, unnest(['month_1', 'next_3']) AS horizon, unnest([(target - median_12) / sc, (next_3 - 3 * median_12) / sc]) AS e FROM s), k AS (SELECT grp, horizon, quantile_cont(e, 0.8) AS q FROM r WHERE NOT after AND e IS NOT NULL GROUP BY 1, 2)
  SELECT grp AS "group", horizon, round(max(q), 6) AS bound, count(*) AS cases, round(avg(CAST(e <= q AS INTEGER)), 6) AS coverage FROM r JOIN k USING (grp, horizon) WHERE after AND e IS NOT NULL GROUP BY 1, 2""")
q("g13_demand_classes", lambda t: G.class_sizes(dem(t)), f"SELECT {CLASS} AS class, count(*) AS \"references\", round(sum(y), 2) AS qty FROM rules WHERE m = (SELECT max(m) FROM refgrid) GROUP BY 1")
q("g15_serving_table", lambda t: G.serving_table(dem(t), t.products.select("reference", "label")), SC + """
  , k AS (SELECT grp, quantile_cont((next_3 - 3 * median_12) / sc, 0.8) AS q FROM s WHERE NOT after AND next_3 IS NOT NULL GROUP BY 1)
  SELECT reference, label, round(median_12, 4) AS monthly_forecast, round(3 * median_12, 4) AS next_3_months, round(greatest(3 * median_12 + q * sc, 3 * median_12), 4) AS upper_bound, grp AS demand_group, round(mean_12, 4) AS mean_12,
    round(mean_3, 4) AS mean_3, y AS last_month FROM s LEFT JOIN k USING (grp) LEFT JOIN products USING (reference) WHERE m = (SELECT max(m) FROM refgrid)""")
q("g14_g18_learned_challenger", lambda t: G.challenger_scores(G.challenger(P.reference_features(dem(t), pp.ref_flows(t)), [f for f in P.REFERENCE_FEATURES if f != "position"])))
q("g18_quantile_rules", lambda t: G.quantile_rules(dem(t)), f"""
  WITH w AS (SELECT reference, m, quantile_cont(y, 0.55) OVER w AS q55, quantile_cont(y, 0.6) OVER w AS q60 FROM refgrid WINDOW w AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
  l AS (SELECT target AS y, unnest(['median_12', 'q55', 'q60', 'hybrid_by_class', 'member_median', 'half_median_mean']) AS rule, unnest([median_12, q55, q60, CASE WHEN class = 'smooth' THEN median_12 ELSE mean_12 END,
    list_median([median_12, mean_3, mean_12]), 0.5 * median_12 + 0.5 * mean_12]) AS yhat FROM ctx JOIN w USING (reference, m)) SELECT rule, {ERR} FROM l GROUP BY 1""")


def public_refs(t):
    """References with more than half of their volume in public hospitals."""
    d = dem(t).groupBy("reference").agg(F.sum("q_public_hospital").alias("p"), F.sum(F.col("q_public_hospital") + c("q_private_clinic") + c("q_laboratory") + c("q_other")).alias("a"))
    return d.select("reference", (c("p") / F.greatest("a", F.lit(1e-9)) > 0.5).alias("public"))


q("g16_error_decomposition", lambda t: G.error_decomposition(dem(t), public_refs(t)), """
  WITH p AS (SELECT reference, sum(q_public_hospital) / greatest(sum(q_public_hospital + q_private_clinic + q_laboratory + q_other), 1e-9) > 0.5 AS pub FROM refgrid GROUP BY 1), x AS (SELECT ctx.*, pub FROM ctx LEFT JOIN p USING (reference)),
  u AS (SELECT unnest(['type', 'class', 'clientele']) AS axis, unnest([type, class, CASE WHEN pub THEN 'public' ELSE 'other' END]) AS label, target, ea, eb, median_12 FROM x),
  g AS (SELECT axis, label, count(*) AS observations, sum(target) AS y, sum(ea) AS ea, sum(eb) AS eb, sum(median_12 - target) AS oa FROM u GROUP BY 1, 2)
  SELECT axis, label, observations, round(y * 100 / sum(y) OVER w, 6) AS volume_pct, round(ea * 100 / sum(ea) OVER w, 6) AS error_a_pct, round(eb * 100 / sum(eb) OVER w, 6) AS error_b_pct, round(oa, 4) AS over_forecast_a FROM g
  WINDOW w AS (PARTITION BY axis)""")
q("g16_error_by_month", lambda t: G.error_by_month(dem(t)), """
  SELECT m, count(*) AS observations, round(sum(target), 4) AS y, round(sum(ea) * 100 / nullif(sum(target), 0), 6) AS wape_a, round(sum(eb) * 100 / nullif(sum(target), 0), 6) AS wape_b, round(sum(median_12 - target) * 100 / nullif(sum(target), 0), 6) AS bias_a FROM ctx GROUP BY 1""")
q("g16_costly_references", lambda t: G.costly_references(dem(t)), """
  WITH g AS (SELECT reference, sum(target) AS y, sum(ea) AS ea, sum(eb) AS eb FROM ctx GROUP BY 1), k AS (SELECT *, ea * 100 / sum(ea) OVER () AS pa, eb * 100 / sum(eb) OVER () AS pb FROM g)
  SELECT reference, round(k.y, 4) AS y, round(pa, 6) AS error_a_pct, round(pb, 6) AS error_b_pct FROM k ORDER BY eb DESC, reference LIMIT 10""")
q("g16_paired_duel", lambda t: G.paired_duel(dem(t)), """
  SELECT CASE WHEN ea - eb > greatest(1, 0.05 * target) THEN 'b_better' WHEN ea - eb < -greatest(1, 0.05 * target) THEN 'a_better' ELSE 'similar' END AS outcome, type, count(*) AS observations, round(sum(ea - eb), 4) AS error_avoided_by_b FROM ctx GROUP BY 1, 2""")
q("g16_oracle_ceilings", lambda t: G.oracle_ceilings(dem(t)), f"""
  WITH n AS (SELECT reference, m, list_median(list_concat(list(y) OVER a3, coalesce(list(y) OVER b3, []))) AS near_3, list_median(list_concat(list(y) OVER a6, coalesce(list(y) OVER b6, []))) AS near_6 FROM refgrid
    WINDOW a3 AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), b3 AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 2 FOLLOWING AND 4 FOLLOWING),
      a6 AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b6 AS (PARTITION BY reference ORDER BY m ROWS BETWEEN 2 FOLLOWING AND 7 FOLLOWING)),
  k AS (SELECT reference, median(target) AS cst FROM ctx GROUP BY 1), l AS (SELECT target AS y, unnest(['median_12', 'near_3', 'near_6', 'constant']) AS rule, unnest([median_12, near_3, near_6, cst]) AS yhat FROM ctx JOIN n USING (reference, m) JOIN k USING (reference))
  SELECT rule, {ERR} FROM l GROUP BY 1""")
q("g17_peak_detector", lambda t: G.peak_detector(dem(t)), """
  WITH f AS (SELECT m, coalesce(y > 1.3 * median(y) OVER (ORDER BY m ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), false) AS peak FROM mkt)
  SELECT peak, count(DISTINCT m) AS origins, round(sum(ea) * 100 / sum(target), 6) AS wape_a, round(sum(eb) * 100 / sum(target), 6) AS wape_b, round(sum(mean_3 - target) * 100 / sum(target), 6) AS bias_b FROM ctx JOIN f USING (m) GROUP BY 1""")
q("g17_peak_neutralised", lambda t: G.peak_neutralised(dem(t)), """
  WITH n AS (SELECT reference, m, median(y) OVER (PARTITION BY reference ORDER BY m ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS nm FROM refgrid)
  SELECT m, round(sum(mean_3), 4) AS observed, round(sum(mean_3 + (nm - y) / least(3, t + 1)), 4) AS neutralised, round(sum(target), 4) AS actual FROM ctx JOIN n USING (reference, m) WHERE nm IS NOT NULL GROUP BY 1""")
