"""Named queries beside their SQL check on the small tables; the whole set runs with tests/check.py."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect
from tests.conftest import DATA

SAMPLE = ["k1_headline", "k12_top_customers", "k17_pareto_curve", "k22_granted_vs_obtained", "b21_loyalty_segment", "e2_copies_aware_lines", "d7_mart_margin_product", "q7_identities",
          "q14_column_profile", "m2_g4_carriers_and_losers", "p6_c9_c10_overdue_replenishment", "p10_c3_stock_flow", "p14_h3_threshold_sensitivity", "r4_book_forecast", "r8_imported_schedule",
          "t4_c12_s13_quote_panel", "t7_f10_credit_panel", "x1_ranking_metrics", "x6_calibration", "l12_credit_rule_scores", "g8_intermittent_demand", "c18_similar_items",
          "x10_f15_knn_list_metrics", "y5_linear_contributions", "n2_reconciliation_status", "n9_tfidf_search", "n14_dispatch_plan"]


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    diff, _ = compare(entry.queries()[name](spark, DATA), con, entry.oracle_sql()[name])
    assert diff is None


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_period_and_margin_identities(tables):
    from tradewright.operators import margin, star
    cat, prod = star.mart_margin_category_month(tables.sales_lines), star.mart_margin_product(tables.sales_lines)
    a = cat.groupBy().sum("margin").first()[0]
    assert a == pytest.approx(prod.groupBy().sum("margin").first()[0])
    w = {r.step: r.value for r in margin.waterfall(cat).collect()}
    assert w["revenue"] + w["cost"] == pytest.approx(w["margin"], abs=0.5)
