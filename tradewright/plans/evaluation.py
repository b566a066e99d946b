"""Metric, drift and learning-protocol queries (x1..x12, l*, c20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.functions.bootstrap import weight_sql
from tradewright.functions import rules as R
from tradewright.operators import learning as L
from tradewright.operators import panels as P
from tradewright.operators import receivables as rec
from tradewright.operators import kpi, star
from tradewright.plans import panels as pp
from tradewright.plans.registry import register

c = F.col
V = {
    **pp.V,
    "pr": "SELECT customer, obs_date, y, recency_days / (recency_days + 200) AS p, 1 / (1 + freq_12m) AS p2 FROM churn",
    "fr": "SELECT customer, month, rev_3m AS yhat, future_revenue AS y FROM rp WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_revenue IS NOT NULL",
}


def q(name, build, sql=None):
    register(name, build, sql, V)


def scored(t):
    """Churn panel scored by recency, with frequency as the competing score."""
    return pp.churn(t).select("customer", "obs_date", "y", (c("recency_days") / (c("recency_days") + 200)).alias("p"), (1 / (1 + c("freq_12m"))).alias("p2"),
                              F.concat_ws("@", "customer", "obs_date").alias("id"))


def forecasts(t):
    """Revenue panel with the persistence forecast."""
    return pp.revenue_panel(t).select("customer", "month", c("rev_3m").alias("yhat"), c("future_revenue").alias("y"), F.concat_ws("@", "customer", "month").alias("id"))


RANKED = "WITH g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM pr GROUP BY 1), a AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(pos + neg) OVER (ORDER BY p DESC) AS k FROM g)"
q("x1_ranking_metrics", lambda t: X.ranking_metrics(scored(t)), RANKED + """
  SELECT round(sum(pos * (nb + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc, round(sum(pos * tp / k) / sum(pos), 6) AS average_precision, (SELECT round(avg(pow(p - y, 2)), 6) FROM pr) AS brier FROM a""")
q("x2_confusion_block", lambda t: X.confusion_block(scored(t), c("p") >= 0.5), """
  WITH k AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND p >= 0.5)::DOUBLE AS fp, count(*) FILTER (y = 1 AND p < 0.5)::DOUBLE AS fn, count(*) FILTER (y = 0 AND p < 0.5)::DOUBLE AS tn FROM pr),
  m AS (SELECT *, tp + fp + fn + tn AS n, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tp + fp + fn + tn, 2) AS pe FROM k)
  SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / n, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc,
    round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round(greatest((tp + fn) / n, 1 - (tp + fn) / n), 6) AS majority_accuracy FROM m""")
PROBS = "[" + ", ".join(repr(0.01 + i * 0.98 / 98) for i in range(99)) + "]"
q("x3_best_f1_threshold", lambda t: X.best_f1_threshold(scored(t)), """
  WITH q AS (SELECT DISTINCT unnest(quantile_cont(p, PROBS)) AS t FROM pr),
  f AS (SELECT t, round(2.0 * count(*) FILTER (p >= t AND y = 1) / (count(*) FILTER (p >= t) + sum(y)), 12) AS f1 FROM pr, q GROUP BY 1) SELECT round(t, 6) AS threshold, round(f.f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, t LIMIT 1""".replace("PROBS", PROBS))
DIRECTIONS = {"recency_days": 1, "recency_gap_ratio": 1, "freq_12m": -1, "revenue_trend": -1}
q("x4_one_variable_baselines", lambda t: X.one_variable_baselines(rounded_churn(t), DIRECTIONS), """
  WITH l AS (SELECT y, unnest(['recency_days', 'recency_gap_ratio', 'freq_12m', 'revenue_trend']) AS baseline, unnest([recency_days, round(recency_gap_ratio + 1e-9, 6), -freq_12m, -round(revenue_trend + 1e-9, 6)]) AS p FROM churn),
  r AS (SELECT *, rank() OVER (PARTITION BY baseline ORDER BY p) + (count(*) OVER (PARTITION BY baseline, p) - 1) / 2.0 AS rk FROM l)
  SELECT baseline, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1""")


def rounded_churn(t):
    return pp.rnd(pp.churn(t), ["recency_gap_ratio", "revenue_trend"])


W = weight_sql("customer", "rep")
INTERVAL = """SELECT count(*) AS replicates, round(quantile_cont(gap, 0.025), 5) AS low, round(median(gap), 5) AS median, round(quantile_cont(gap, 0.975), 5) AS high,
  round(avg(CAST(gap < 0 AS INTEGER)) * 100, 4) AS a_better_pct FROM g"""
RESAMPLED = f"""r AS (SELECT u.*, rep, {W} AS w FROM u, (SELECT unnest(range(1, 2001)) AS rep)), g AS (SELECT (sum(w * a) - sum(w * b)) / sum(w * base) * 100 AS gap FROM r GROUP BY rep) {INTERVAL}"""
q("x5_bootstrap_wape_gap", lambda t: X.bootstrap_gap(pp.revenue_panel(t).groupBy("customer").agg(
    F.sum(F.abs(c("rev_3m") - c("future_revenue"))).alias("a"), F.sum(F.abs(c("rev_12m") / 4 - c("future_revenue"))).alias("b"), F.sum("future_revenue").alias("base")), "customer", "a", "b", "base"), f"""
  WITH u AS (SELECT customer, sum(abs(rev_3m - future_revenue)) AS a, sum(abs(rev_12m / 4 - future_revenue)) AS b, sum(future_revenue) AS base FROM rp WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_revenue IS NOT NULL GROUP BY 1), {RESAMPLED}""")


def relative_errors(t):
    p = pp.revenue_panel(t).filter("future_revenue > 0")
    off = lambda x: F.abs(x - c("future_revenue")) / c("future_revenue")
    return p.groupBy("customer").agg(F.sum(off(c("rev_3m"))).alias("a"), F.sum(off(c("rev_12m") / 4)).alias("b"), F.count(F.lit(1)).alias("base"))


q("x5_bootstrap_mape_gap", lambda t: X.bootstrap_gap(relative_errors(t), "customer", "a", "b", "base"), f"""
  WITH u AS (SELECT customer, sum(abs(rev_3m - future_revenue) / future_revenue) AS a, sum(abs(rev_12m / 4 - future_revenue) / future_revenue) AS b, count(*) AS base FROM rp
    WHERE n_lines_12m >= 3 AND rank >= 12 AND active AND future_revenue > 0 GROUP BY 1), {RESAMPLED}""")
# two thousand weighted rankings are too much for SQL over whole tables: tests hold the replicates against sorted pairs
q("x5_bootstrap_auc_gap", lambda t: X.bootstrap_auc_gap(scored(t), "customer", "p", "p2"))
q("x6_calibration", lambda t: X.calibration(scored(t), "id"), """
  WITH o AS (SELECT *, row_number() OVER (ORDER BY p, concat(customer, '@', obs_date)) - 1 AS i, count(*) OVER () AS n FROM pr), g AS (SELECT *, n // 10 AS b, n % 10 AS e FROM o)
  SELECT CAST(CASE WHEN i < e * (b + 1) THEN i // (b + 1) ELSE e + (i - e * (b + 1)) // b END + 1 AS INTEGER) AS rank_group, count(*) AS n, sum(y) AS positives, round(avg(p), 6) AS mean_predicted, round(avg(y), 6) AS observed,
    round(min(p), 6) AS low, round(max(p), 6) AS high FROM g GROUP BY 1""")
q("x6_calibration_error", lambda t: X.calibration_error(X.calibration(scored(t), "id")), """
  WITH o AS (SELECT *, row_number() OVER (ORDER BY p, concat(customer, '@', obs_date)) - 1 AS i, count(*) OVER () AS n FROM pr), g AS (SELECT *, n // 10 AS b, n % 10 AS e FROM o),
  h AS (SELECT CASE WHEN i < e * (b + 1) THEN i // (b + 1) ELSE e + (i - e * (b + 1)) // b END AS k, count(*) AS n, round(avg(p), 6) AS mp, round(avg(y), 6) AS my FROM g GROUP BY 1)
  SELECT round(sum(abs(mp - my) * n) / sum(n), 5) AS ece, round(sum((mp - my) * n) / sum(n), 5) AS bias FROM h""")
q("x7_g5_top_decile", lambda t: X.top_decile(scored(t), "id"), """
  WITH s AS (SELECT min(p) AS s FROM (SELECT p, row_number() OVER (ORDER BY p DESC, concat(customer, '@', obs_date)) AS r FROM pr) WHERE r = (SELECT greatest(CAST(floor(count(*) * 0.1) AS BIGINT), 1) FROM pr))
  SELECT count(*) FILTER (p >= s) AS flagged, round(sum(y) FILTER (p >= s) / count(*) FILTER (p >= s), 6) AS precision, round(sum(y) FILTER (p >= s) / sum(y), 6) AS recall,
    round(sum(y) FILTER (p >= s) / count(*) FILTER (p >= s) / avg(y), 6) AS lift FROM pr, s""")
q("x8_error_block", lambda t: X.error_block(forecasts(t)), """
  SELECT count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg(pow(yhat - y, 2))), 6) AS rmse, round(sum(abs(yhat - y)) * 100 / sum(abs(y)), 6) AS wape_pct, round(sum(yhat - y) * 100 / sum(y), 6) AS bias_pct,
    round(avg(CASE WHEN y <> 0 THEN abs(yhat - y) / abs(y) END) * 100, 6) AS mape_pct FROM fr""")
q("x8_median_errors", lambda t: X.median_errors(forecasts(t)), """
  SELECT round(median(abs(yhat - y)), 4) AS median_abs_error, round(median(CASE WHEN y > 1 THEN abs(yhat - y) / y END), 6) AS median_rel_error FROM fr""")
q("x9_spearman", lambda t: X.spearman(forecasts(t).withColumns({"y": F.round("y", 4), "yhat": F.round("yhat", 4)}), "y", "yhat"), """
  WITH r AS (SELECT rank() OVER (ORDER BY round(y, 4)) + (count(*) OVER (PARTITION BY round(y, 4)) - 1) / 2.0 AS a, rank() OVER (ORDER BY round(yhat, 4)) + (count(*) OVER (PARTITION BY round(yhat, 4)) - 1) / 2.0 AS b FROM fr)
  SELECT round(corr(a, b), 6) AS spearman FROM r""")
q("x9_h3_top_n_precision", lambda t: X.top_n_precision(forecasts(t), "id", 50), """
  WITH a AS (SELECT concat(customer, '@', month) AS id FROM fr ORDER BY y DESC, id LIMIT 50), b AS (SELECT concat(customer, '@', month) AS id FROM fr ORDER BY yhat DESC, id LIMIT 50)
  SELECT count(*) / 50.0::DOUBLE AS top_n_precision FROM a JOIN b USING (id)""")


def _halves(t):
    p = pp.rnd(pp.churn(t), P.CHURN_FEATURES)
    return p.filter(c("obs_date") <= "1999-12-31"), p.filter(c("obs_date") > "1999-12-31")


PSI = ["recency_days", "rev_12m", "gap_mean"]
q("x11_psi", lambda t: X.psi(*_halves(t), PSI, expected=["gap_mean"]), """
  WITH l AS (SELECT obs_date <= DATE '1999-12-31' AS r, unnest(['recency_days', 'rev_12m', 'gap_mean']) AS feature, unnest([recency_days, round(rev_12m + 1e-9, 6), round(gap_mean + 1e-9, 6)]) AS v FROM churn),
  d AS (SELECT DISTINCT feature, unnest(q) AS cut FROM (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM l WHERE r GROUP BY feature)),
  b AS (SELECT l.feature, l.r, (SELECT count(*) FROM d WHERE d.feature = l.feature AND d.cut <= l.v) AS b FROM l), g AS (SELECT feature, b, count(*) FILTER (r) AS a, count(*) FILTER (NOT r) AS o FROM b GROUP BY 1, 2),
  s AS (SELECT feature, greatest(a / sum(a) OVER w, 1e-4) AS pa, greatest(o / sum(o) OVER w, 1e-4) AS po FROM g WINDOW w AS (PARTITION BY feature))
  SELECT feature, round(sum((po - pa) * ln(po / pa)), 6) AS psi, CASE WHEN feature = 'gap_mean' THEN 'expected' WHEN sum((po - pa) * ln(po / pa)) < 0.1 THEN 'stable' WHEN sum((po - pa) * ln(po / pa)) < 0.25 THEN 'moderate' ELSE 'high' END AS level
  FROM s GROUP BY 1""")
q("x11_target_drift", lambda t: X.target_drift(*_halves(t)), """
  WITH a AS (SELECT avg(y) FILTER (obs_date <= DATE '1999-12-31') AS r, avg(y) FILTER (obs_date > DATE '1999-12-31') AS c FROM churn)
  SELECT round(r, 6) AS reference_rate, round(c, 6) AS current_rate, round(abs(c - r) / r, 6) AS relative_drift, abs(c - r) / r > 0.5 AS alert FROM a""")
q("x12_delay_structure_drift", lambda t: L.delay_structure_drift(t.sales), """
  WITH s AS (SELECT delay_days::DOUBLE AS v, date >= date_trunc('month', (SELECT max(date) FROM sales WHERE NOT is_credit)) - INTERVAL 3 MONTH AS cur FROM sales WHERE NOT is_credit),
  d AS (SELECT DISTINCT unnest(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cut FROM s WHERE NOT cur), b AS (SELECT cur, (SELECT count(*) FROM d WHERE cut <= v) AS b FROM s),
  g AS (SELECT b, count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS o FROM b GROUP BY 1), x AS (SELECT greatest(a / sum(a) OVER (), 1e-4) AS pa, greatest(o / sum(o) OVER (), 1e-4) AS po FROM g)
  SELECT round((SELECT sum((po - pa) * ln(po / pa)) FROM x), 6) AS psi, round(avg(CAST(v <= 62 AS INTEGER)) FILTER (NOT cur), 6) AS share_reference, round(avg(CAST(v <= 62 AS INTEGER)) FILTER (cur), 6) AS share_current FROM s""")
q("c20_paired_full_coverage", lambda t: L.paired(forecasts(t).select("customer", "month", c("yhat").alias("v")), forecasts(t).select("customer", "month", (c("yhat") * 1.1).alias("v")), ["customer", "month"]).agg(
    F.count(F.lit(1)).alias("pairs"), F.max("full_coverage").alias("full_coverage")), "SELECT count(*) AS pairs, true AS full_coverage FROM fr")

# ------------------------------------------------------------ rules, splits and registry
q("l12_credit_rule_scores", lambda t: L.credit_rule(t.sales).select("customer", F.round("score", 4).alias("score"), F.round("exposure", 2).alias("exposure"), "documents", F.round("mean_delay", 6).alias("mean_delay"), "source"), """
  WITH s AS (SELECT * FROM sales WHERE NOT is_credit), g AS (SELECT customer, sum(ttc) AS e, count(*) AS n, avg(delay_days) AS d, median(delay_days) FILTER (k > 3) AS m FROM (SELECT s.*,
      (SELECT count(*) FROM s b WHERE b.customer = s.customer AND b.date < s.date) + 1 AS k FROM s) GROUP BY 1)
  SELECT customer, round(CASE WHEN m IS NOT NULL THEN CASE WHEN m > 60 THEN 100 ELSE 0 END ELSE (SELECT avg(CAST(delay_days > 60 AS INTEGER)) * 100 FROM s) END, 4) AS score, round(e, 2) AS exposure, n AS documents, round(d, 6) AS mean_delay,
    CASE WHEN m IS NOT NULL THEN 'history_rule' ELSE 'base_rate' END AS source FROM g""")
q("k32_risk_ranking", lambda t: kpi.risk_ranking(L.credit_rule(t.sales), t.customers).select("rank", "score"), None)
q("k32_risk_totals", lambda t: kpi.risk_totals(L.credit_rule(t.sales)), """
  WITH s AS (SELECT * FROM sales WHERE NOT is_credit), g AS (SELECT customer, sum(ttc) AS e, median(delay_days) FILTER (k > 3) AS m FROM (SELECT s.*, (SELECT count(*) FROM s b WHERE b.customer = s.customer AND b.date < s.date) + 1 AS k FROM s) GROUP BY 1),
  x AS (SELECT e, CASE WHEN m IS NOT NULL THEN CASE WHEN m > 60 THEN 100 ELSE 0 END ELSE (SELECT avg(CAST(delay_days > 60 AS INTEGER)) * 100 FROM s) END AS sc FROM g)
  SELECT count(*) FILTER (sc > 70) AS high_risk_customers, round(sum(sc / 100 * e), 2) AS weighted_exposure FROM x""")
q("l12_rule_out_of_period", lambda t: L.rule_out_of_period(t.sales, "2000-01-01"), """
  WITH n AS (SELECT customer, median(delay_days) AS m FROM sales WHERE NOT is_credit AND date <= DATE '2000-01-01' GROUP BY 1 HAVING count(*) >= 3), e AS (SELECT CAST(delay_days > 60 AS INTEGER) AS y, m AS p FROM sales JOIN n USING (customer)
    WHERE NOT is_credit AND date > DATE '2000-01-01'), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM e)
  SELECT count(*) AS documents, round((sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc, round(avg(CAST((p > 60) = (y = 1) AS INTEGER)), 6) AS accuracy FROM r""")
q("l13_delay_tautology", lambda t: L.delay_tautology(t.sales), """
  WITH g AS (SELECT customer, stddev_samp(delay_days) AS s FROM sales WHERE NOT is_credit GROUP BY 1 HAVING count(*) >= 5)
  SELECT round(median(s), 6) AS median_within_std, (SELECT round(stddev_samp(delay_days), 6) FROM sales WHERE NOT is_credit) AS global_std FROM g""")
q("l13_proxy_variable", lambda t: L.proxy_rates(t.sales, "mode"), """
  SELECT mode AS value, count(*) AS n, round(avg(CAST(delay_days > 60 AS INTEGER)), 6) AS target_rate, median(delay_days) AS median_delay FROM sales WHERE NOT is_credit GROUP BY 1""")
q("l4_time_split", lambda t: L.split_summary(pp.churn(t), "obs_date", 0.75, 90), """
  WITH d AS (SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(datediff('day', DATE '1970-01-01', obs_date), 0.75)) AS INTEGER) AS cut FROM churn)
  SELECT cut, count(*) FILTER (obs_date + 90 <= cut) AS train_rows, count(*) FILTER (obs_date > cut) AS test_rows, count(*) FILTER (obs_date <= cut AND obs_date + 90 > cut) AS leak_margin_rows FROM churn, d GROUP BY 1""")
q("l7_expanding_blocks", lambda t: L.block_sizes(pp.churn(t).select("customer", "obs_date"), "obs_date", 4), """
  WITH m AS (SELECT obs_date, count(*) AS n FROM churn GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY obs_date) - 1 AS i, count(*) OVER () AS k FROM m)
  SELECT CAST(i * 5 // k AS INTEGER) AS block, sum(n)::BIGINT AS "rows", CASE WHEN i * 5 // k > 0 THEN pow(2, i * 5 // k - 1) ELSE 0 END AS weight FROM r GROUP BY 1, 3""")
q("l17_champion_challenger", lambda t: L.registry_decision(X.one_variable_baselines(rounded_churn(t), DIRECTIONS).select(
    F.lit("churn").alias("model"), c("baseline").alias("candidate"), c("auc").alias("metric")), "recency_days"), """
  WITH l AS (SELECT y, unnest(['recency_days', 'recency_gap_ratio', 'freq_12m', 'revenue_trend']) AS b, unnest([recency_days, round(recency_gap_ratio + 1e-9, 6), -freq_12m, -round(revenue_trend + 1e-9, 6)]) AS p FROM churn),
  r AS (SELECT *, rank() OVER (PARTITION BY b ORDER BY p) + (count(*) OVER (PARTITION BY b, p) - 1) / 2.0 AS rk FROM l), a AS (SELECT b, round((sum(rk * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc FROM r GROUP BY 1),
  best AS (SELECT arg_max(b, (auc, b)) AS b, max(auc) AS auc FROM a WHERE b <> 'recency_days'), ref AS (SELECT auc AS r FROM a WHERE b = 'recency_days')
  SELECT 'churn' AS model, b AS candidate, auc AS metric, r AS reference, round(auc - r, 6) AS gain, auc - r >= 0.02 AS deployed, CASE WHEN auc - r >= 0.02 THEN 'beats the reference' ELSE 'gain below the threshold' END AS reason FROM best, ref""")
q("l17_degradation_alert", lambda t: L.degradation(t.sales.groupBy("year").agg(F.avg("ttc").alias("metric")).select(F.lit("basket").alias("model"), "year", "metric"), "year"), """
  WITH m AS (SELECT year, avg(ttc) AS v FROM sales GROUP BY 1), l AS (SELECT *, lag(v) OVER (ORDER BY year) AS b FROM m)
  SELECT 'basket' AS model, year, round((v - b) / abs(b), 6) AS change, coalesce((v - b) / abs(b) < -0.1, false) AS degraded FROM l""")

# ------------------------------------------------------------ learning (no SQL equivalent)
q("l1_l3_l4_churn_model_selection", lambda t: L.select_classifier(pp.churn(t), P.CHURN_FEATURES, "obs_date", 90))
q("l5_walk_forward", lambda t: L.walk_forward(pp.churn(t), P.CHURN_FEATURES, "obs_date", 90))
q("l6_group_folds", lambda t: L.fold_sizes(pp.churn(t), "customer", 5), """
  SELECT CAST(CAST(concat('0x', substr(md5(CAST(customer AS VARCHAR)), 1, 8)) AS BIGINT) % 2147483647 % 5 AS INTEGER) AS fold, count(DISTINCT customer) AS entities, count(*) AS "rows", sum(y)::BIGINT AS positives FROM churn GROUP BY 1""")
q("l6_group_fold_auc", lambda t: L.group_k_fold(pp.churn(t), P.CHURN_FEATURES, "customer"))
q("l7_weighted_blocks", lambda t: L.weighted_blocks(pp.churn(t), P.CHURN_FEATURES, "obs_date", 90))
q("l8_isotonic_calibration", lambda t: L.isotonic_check(scored(t)))
q("l9_segments", lambda t: L.segment_quality(P.customer_profiles(t.sales, t.customers, star.mart_demand_customer_product(t.sales_lines)), P.PROFILE_FEATURES))
q("l11_segment_churn", lambda t: L.segment_churn(P.customer_profiles(t.sales, t.customers, star.mart_demand_customer_product(t.sales_lines)), pp.churn(t), P.PROFILE_FEATURES))
q("l2_revenue_regression", lambda t: L.revenue_regression(pp.revenue_panel(t), P.REVENUE_FEATURES, "month"))
q("l14_churn_stakes", lambda t: L.expected_stakes(pp.churn(t), P.churn_panel(P.customer_days(t.sales), pp.START, for_scoring=True), P.CHURN_FEATURES, "customer", "rev_12m"))
q("l15_b27_open_quote_protocol", lambda t: L.open_quote_protocol(t.quotes, pp.quote_panel(t)), """
  WITH b AS (SELECT CASE WHEN ht < 5000 THEN 0 WHEN ht < 20000 THEN 1 WHEN ht < 100000 THEN 2 ELSE 3 END AS band, avg(y) AS p FROM (SELECT exp(log_ht) - 1 AS ht, y FROM qp) GROUP BY 1),
  o AS (SELECT q.*, (SELECT max(date) FROM quotes) AS md FROM quotes q WHERE NOT converted), x AS (SELECT ht, p, datediff('day', date, md) AS age FROM o JOIN b ON band = CASE WHEN ht < 5000 THEN 0 WHEN ht < 20000 THEN 1 WHEN ht < 100000 THEN 2 ELSE 3 END
    WHERE datediff('day', date, md) <= 120)
  SELECT CASE WHEN ht >= 20000 AND p >= 0.25 THEN 'call' WHEN ht >= 20000 THEN 'tender_follow_up' WHEN p >= 0.25 THEN 'batch_reminder' ELSE 'leave' END AS protocol, count(*) AS quotes, round(sum(ht), 2) AS amount,
    round(sum(ht * p), 2) AS expectation, median(age) AS median_age FROM x GROUP BY 1""")
q("l18_permutation_importance", lambda t: L.permutation_importance(pp.churn(t), P.CHURN_FEATURES, "obs_date", 90))
q("l19_leak_audit", lambda t: L.leak_audit(pp.churn(t), P.CHURN_FEATURES, "customer"))
q("l20_cold_start", lambda t: L.cold_start(P.credit_panel(t.sales), "1996-01-01"))
q("l16_residual_learning", lambda t: L.residual_learning(P.demand_features(t.sales_lines, t.customers), P.DEMAND_FEATURES, "month"))
q("l16_residual_transform", lambda t: L.residual_columns(P.demand_features(t.sales_lines, t.customers)).select("product", "month", F.round("baseline", 4).alias("baseline"), F.round("residual", 6).alias("residual")), """
  SELECT product, month, round(greatest(list_median([coalesce(ma_3, 0), coalesce(lag_12, 0), coalesce(lag_1, 0)]), 0), 4) AS baseline,
    round(sign(y_h1 - greatest(list_median([coalesce(ma_3, 0), coalesce(lag_12, 0), coalesce(lag_1, 0)]), 0)) * ln(1 + abs(y_h1 - greatest(list_median([coalesce(ma_3, 0), coalesce(lag_12, 0), coalesce(lag_1, 0)]), 0))), 6) AS residual
  FROM dfull WHERE y_h1 IS NOT NULL""")
