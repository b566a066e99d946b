"""A tiny export with one instance of every defect goes through the whole build."""

import csv
import datetime as dt

import pytest

from tradewright.plans import warehouse
from tradewright.sources import raw

ROWS = {
    "sales_headers": [
        ("1", "FV-001", "CP001", "1/15/2024", "2/14/2024", "1190", "1000", "1190", "Virement 60 JOURS", "2", "DP"),
        ("2", "FV-001", "CP001", "1/15/2024", "2/14/2024", "1190", "1000", "1190", "Virement 60 JOURS", "2", "DP"),
        ("3", "AV-001", "CP001", "1/20/2024", "", "-119", "100", "119", "Virement 60 JOURS", "1", "DP"),
        ("4", "FV-002", "CP999", "2/10/2024", "3/1/2024", "2380", "2000", "2380", "virement  60JOURS", "1", "XX"),
        ("5", "FV-003", "CP002", "no date", "", "500", "420", "500", "", "1", "DP")],
    "sales_lines": [
        ("10", "FV-001", "CP001", "R1", "Reactif A", "REACTIF", "1/15/2024", "600", "6", "300", "2"),
        ("11", "FV-001", "CP001", "R1", "Reactif A", "REACTIF", "1/15/2024", "600", "6", "300", "2"),
        ("12", "FV-001", "CP001", "R2", "Panel", "EQUIPEMENT", "1/15/2024", "400", "4", "5000", "2"),
        ("13", "AV-001", "CP001", "R1", "Reactif A", "REACTIF", "1/20/2024", "-100", "-1", "-50", "1"),
        ("14", "FV-002", "CP999", "R3", "Divers", "SERVICE SAV", "2/10/2024", "2000", "10", "1200", "2"),
        ("15", "FV-002", "CP999", "R3", "Divers", "SERVICE SAV", "2/10/2024", "99", "1", "1", "CULTURE")],
    "purchase_headers": [("1", "FA-1", "Four Un", "F1", "1/10/2024", "2/10/2024", "1190", "1000", "1190", "190", "Cheque", "BX-77")],
    "purchase_lines": [("1", "FA-1", "F1", "R1", "Reactif A", "1", "1/10/2024", "20", "800"), ("2", "FA-2", "F9", "R4", "Autre", "1", "1/1/1900", "1", "50")],
    "quotes": [("1", "DV-1", "CP001", "1/2/2024", "700", "600", "700", "x", "8"), ("2", "DV-2", "CP003", "1/3/2024", "900", "800", "900", "x", "")],
    "deliveries": [("CP001", "1/14/2024", "3")],
    "customer_reference": [("CP001", "Clinique A", "Tunis", "DP", "Depot principal"), ("CP002", "Labo B", "Sfax", "DP", "Depot principal")],
    "suppliers": [("F1", "T1", "Four Un", "Paris", "NULL")],
}


def write(folder, rows=ROWS):
    for role, (name, cols) in raw.ROLES.items():
        with open(folder / name, "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f)
            w.writerow(cols)
            w.writerows(rows[role])


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    src, out = tmp_path_factory.mktemp("src"), str(tmp_path_factory.mktemp("out"))
    write(src)
    with open(src / raw.ROLES["deliveries"][0], "a") as f:
        f.write("CP001,1/15/2024,3,shifted,columns\n")
    checks = warehouse.build(spark, raw.read_all(spark, str(src)), out, "b1")
    return spark, src, out, {r["check"]: r for r in checks.collect()}


def get(built, name):
    return warehouse.table(built[0], built[2], name).collect()


def test_sales_are_signed_and_deduplicated(built):
    got = {r.piece_no: (r.ttc, r.is_credit) for r in get(built, "sales")}
    assert got == {"FV-001": (1190.0, False), "AV-001": (-119.0, True), "FV-002": (2380.0, False)}


def test_lines_keep_legitimate_copies_and_reject_shifted_ones(built):
    assert sorted(r.mouv_id for r in get(built, "sales_lines")) == [10, 12, 13, 14]
    assert [r.mouv_id for r in get(built, "sales_lines_rejected")] == [15]


def test_dimensions(built):
    assert {r.code: r.origin for r in get(built, "dim_customer")} == {"CP001": "erp", "CP002": "erp", "CP999": "inferred", "CP003": "inferred"}
    assert {r.code: (r.origin, r.country) for r in get(built, "dim_supplier")} == {"F1": ("erp", None), "F9": ("inferred", None)}
    assert {r.code: r.origin for r in get(built, "dim_depot")} == {"DP": "erp", "XX": "inferred"}
    labels = {r.key: r.label for r in get(built, "dim_mode")}
    assert labels["VIREMENT 60 JOURS"] == "Virement 60 JOURS"
    days = sorted(r.date for r in get(built, "dim_date"))
    assert days[0] == dt.date(2024, 1, 2) and days[-1] == dt.date(2024, 3, 1) and len(days) == 60


def test_quotes_and_margin(built):
    assert {r.piece_no: r.converted for r in get(built, "quotes")} == {"DV-1": True, "DV-2": False}
    m = [r for r in get(built, "mart_margin_customer_month") if r.customer == "CP001"]
    assert (m[0].revenue, m[0].cost, m[0].margin) == (500.0, 250.0, 250.0)
    assert get(built, "mart_margin_quality")[0].excluded_lines == 1


def test_checks(built):
    checks = built[3]
    assert not [c for c in checks.values() if c.status == "error"]
    assert checks["calendar:purchase_lines.date"].value == 1
    assert checks["sales:duplicates_removed"].value == 1 and checks["sales:total_ttc"].value == 3451.0


def test_malformed_lines_are_dropped_and_countable(built):
    spark, src = built[0], str(built[1])
    assert raw.read_role(spark, src, "deliveries").count() == 1
    kept = raw.read_role(spark, src, "deliveries", keep_malformed=True).cache()
    assert kept.filter("_corrupt_record is not null").count() == 1


def test_failed_check_leaves_the_published_build(built, tmp_path):
    spark, out = built[0], built[2]
    write(tmp_path, {**ROWS, "deliveries": []})
    with pytest.raises(warehouse.BuildRefused):
        warehouse.build(spark, raw.read_all(spark, str(tmp_path)), out, "b2")
    assert warehouse.published(spark, out) == "b1"


def test_views_and_signatures(built):
    spark, src, out, _ = built
    warehouse.register_views(spark, out)
    r = spark.sql("select customer_name, delay_days, mode from sales where piece_no = 'FV-001'").first()
    assert tuple(r) == ("Clinique A", 30, "Virement 60 JOURS")
    sig = raw.file_signature(spark.read.csv(str(src / raw.ROLES["quotes"][0]), header=True), "quotes")
    assert [x.stale for x in raw.is_stale(sig, sig).collect()] == [False]
