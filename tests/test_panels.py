"""Panels look back only: changing the future must not move a feature, and targets must agree with raw data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tradewright.operators import panels as P

CUT = dt.date(2000, 1, 1)


def later(df, column, factor=7.0):
    return df.withColumn(column, F.when(F.col("date") > CUT, F.col(column) * factor).otherwise(F.col(column)))


def same(a, b, keys, features):
    left = {tuple(r[k] for k in keys): [r[f] for f in features] for r in a.collect()}
    right = {tuple(r[k] for k in keys): [r[f] for f in features] for r in b.collect()}
    assert left and set(left) == set(right)
    for k, v in left.items():
        assert v == pytest.approx(right[k], rel=1e-9, nan_ok=True), k


def test_churn_features_ignore_the_future(tables):
    def panel(s):
        return P.churn_panel(P.customer_days(s), "1995-01-01").filter(F.col("obs_date") <= CUT)
    same(panel(tables.sales), panel(later(tables.sales, "ttc")), ["customer", "obs_date"], P.CHURN_FEATURES)


def test_revenue_and_margin_features_ignore_the_future(tables):
    delays = P.monthly_delays(tables.sales)
    for build, feats in ((P.revenue_panel, P.REVENUE_FEATURES), (P.margin_panel, P.MARGIN_FEATURES)):
        def panel(lines, build=build):
            return build(P.customer_months(lines), delays, for_scoring=True).filter(F.col("month") < CUT)
        same(panel(tables.sales_lines), panel(later(tables.sales_lines, "amount")), ["customer", "month"], feats)


def test_quote_features_ignore_the_future(tables):
    def panel(q):
        return P.quote_panel(q, tables.sales, tables.sales_lines).filter(F.col("date") <= CUT)
    same(panel(tables.quotes), panel(later(tables.quotes, "ht")), ["customer", "quote_no"], [f for f in P.QUOTE_FEATURES])


def test_churn_target_against_raw_dates(tables):
    days = P.customer_days(tables.sales)
    rows = P.churn_panel(days, "1995-01-01").select("customer", "obs_date", "y").collect()
    seen = {}
    for r in days.select("customer", "date").collect():
        seen.setdefault(r.customer, []).append(r.date)
    end = max(max(v) for v in seen.values())
    for r in rows:
        assert r.obs_date + dt.timedelta(days=90) <= end
        assert r.y == int(not any(r.obs_date < d <= r.obs_date + dt.timedelta(days=90) for d in seen[r.customer]))


def test_truncated_horizons_are_excluded(tables):
    m = P.customer_months(tables.sales_lines)
    panel = P.revenue_panel(m, P.monthly_delays(tables.sales), horizon=3)
    assert panel.agg(F.max("month")).first()[0] <= m.agg(F.add_months(F.max("month"), -3)).first()[0]
