"""Single-operator checks against hand-computed values and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tradewright.functions import metrics as X
from tradewright.functions import scale
from tradewright.operators import forecasting as G
from tradewright.operators import learning as L
from tradewright.operators import receivables as rec
from tradewright.operators import reconcile as N
from tradewright.operators import recommend as Y
from tradewright.operators import star
from tradewright.operators import text as T


def test_running_totals_and_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    vals = [float(rng.choice([1, 2, 2, 2, 3, 5, 8, rng.randint(0, 500)])) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    run = {r.v: (r.n_before, r.n_total) for r in scale.running_totals(scale.distinct_values(df, "v"), "v", ["n"]).collect()}
    for v, (before, total) in run.items():
        assert before == sum(x < v for x in vals) and total == len(vals)
    s = sorted(vals)
    for r in scale.exact_quantiles(df, "v", [0.0, 0.1, 0.5, 0.93, 1.0]).collect():
        pos = r.p * (len(s) - 1)
        lo = int(pos)
        hi = min(lo + 1, len(s) - 1)
        assert r.quantile == pytest.approx(s[lo] + (s[hi] - s[lo]) * (pos - lo))


def test_auc_with_ties(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.4), (0, 0.1), (1, 0.8)]
    df = spark.createDataFrame(data, "y int, p double")
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert X.auc(df).first()["auc"] == pytest.approx(want)


def test_wape_and_bias(spark):
    r = X.error_block(spark.createDataFrame([(10.0, 20.0), (0.0, 0.0), (30.0, 30.0)], "y double, yhat double")).first()
    assert (r.wape_pct, r.bias_pct) == (25.0, 25.0)


@pytest.mark.parametrize("factor,sign", [(0.5, -1), (2.0, 1)])
def test_calibration_bias_direction(spark, factor, sign):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        p = rng.random() * 0.4
        rows.append((int(rng.random() < p), min(1.0, p * factor), i))
    e = X.calibration_error(X.calibration(spark.createDataFrame(rows, "y int, p double, id int"), "id")).first()
    assert e.bias * sign > 0.02


def test_bootstrap_gap_sign(spark):
    rows = [(i, 1.0 + i % 3, 2.0 + i % 3, 10.0) for i in range(200)]
    r = X.bootstrap_gap(spark.createDataFrame(rows, "u int, a double, b double, base double"), "u", "a", "b", "base", 50).first()
    assert r.high < 0 and r.a_better_pct == 100.0


def test_intermittent_rules(spark):
    y = [0, 0, 6, 0, 0, 0, 6, 0, 0, 6]
    d = spark.createDataFrame([("r", i, i, float(v)) for i, v in enumerate(y)], "reference string, m int, t int, y double")
    r = G.intermittent_forecasts(d, (0.1,)).first()
    size, gap = 6.0, 3.0
    for g in (4, 3):
        gap += 0.1 * (g - gap)
    assert r.croston_1 == pytest.approx(size / gap) and r.sba_1 == pytest.approx(size / gap * 0.95)
    prob, z = 0.3, 6.0
    for v in y:
        prob += 0.1 * ((v > 0) - prob)
    assert r.tsb_1 == pytest.approx(prob * z)


def test_forecast_rules(spark):
    d = spark.createDataFrame([("a", i, i, float(i + 1)) for i in range(24)], "reference string, m int, t int, y double")
    r = G.base_rules(d).filter("m = 23").first()
    assert (r.seasonal, r.mean_3, r.median_12, r.last) == (13.0, 23.0, 18.5, 24.0)
    assert r.trend == pytest.approx(25.0)
    assert G.recursive_forecast(d, "mean_3").first()["step_1"] == 23.0


def test_due_date_fallback_chain(spark):
    imp = spark.createDataFrame([(1, "sale", 1, dt.date(2026, 9, 1), dt.date(2026, 9, 10), 100.0, None, None, None), (2, "sale", 1, dt.date(2026, 9, 1), None, 100.0, 90.0, None, None),
                                 (3, "sale", 9, dt.date(2026, 9, 1), None, 50.0, None, None, None), (4, "purchase", 5, None, None, 10.0, None, None, None),
                                 (5, "sale", 1, None, None, 10.0, None, "matched", None)],
                                "id int, side string, party int, date date, due date, ttc double, net double, recon_status string, settled date")
    s = spark.createDataFrame([(1, 60), (1, 60), (1, 90)], "party int, delay_days int")
    p = spark.createDataFrame([(5, 45), (5, 45), (5, -300)], "party int, delay_days int")
    got = {r.id: r for r in rec.imported_schedule(imp, s, p, dt.date(2026, 9, 21)).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].source == "read" and got[1].days_late == 11
    assert got[2].due == dt.date(2026, 10, 31) and got[2].source == "party_delay" and got[2].amount == 90.0
    assert got[3].source == "mean_delay" and got[3].due == dt.date(2026, 10, 31)
    assert got[4].source == "party_delay_undated" and got[4].due == dt.date(2026, 11, 5)


def test_reconciliation_decision_table(spark):
    d = dt.date
    ledger = spark.createDataFrame([
        (1, "F-1", "S1", "Alpha Diag", d(2026, 1, 10), 500.0), (2, "F-2", "S1", "Alpha Diag", d(2026, 1, 12), 700.0), (3, "F-2", "S1", "Alpha Diag", d(2026, 1, 12), 700.0),
        (4, "F-3", "S2", "Beta Med", d(2026, 2, 1), 300.0), (5, "F-3", "S2", "Beta Med", d(2026, 2, 1), 200.0), (6, None, "S3", "Gamma Lab", d(2026, 2, 5), 1000.0),
        (7, None, "S3", "Gamma Lab", d(2026, 2, 7), 1000.0), (8, None, "S4", "Delta", d(2026, 3, 1), 2000.0)], "piece int, number string, party string, name string, date date, ttc double")
    inv = spark.createDataFrame([
        (1, "f1", 500.0, d(2026, 1, 10), "Alpha Diag"), (2, "F 2", 700.0, d(2026, 1, 12), "Alpha"), (3, "f 3", 500.0, d(2026, 2, 1), "Beta Med"), (4, "F-1", 900.0, d(2026, 1, 10), "Alpha Diag"),
        (5, "Z9", 1000.0, d(2026, 2, 5), "Gamma Lab"), (6, "Z8", 2005.0, d(2026, 3, 1), "Delta"), (7, "Z7", 77.0, d(2026, 1, 1), "Nobody"), (8, "Z6", 50.0, d(2027, 1, 1), "Alpha Diag"),
        (9, "", None, None, "x"), (10, "Z5", 2000.0, d(2026, 3, 1), "Omega")], "id int, number string, ttc double, date date, name string")
    got = {r.id: r.status for r in N.decide(inv, N.candidates(inv, ledger), ledger).collect()}
    assert got == {1: "matched", 2: "probable_duplicate", 3: "matched", 4: "gap", 5: "probable_duplicate", 6: "gap", 7: "not_found", 8: "out_of_period", 9: "no_amount", 10: "not_found"}


def test_amount_buckets_cover_the_tolerance(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        x = 10 ** rng.uniform(0, 6)
        tol = max(1.0, x * 0.01)
        rows.append((x, max(0.01, x + rng.uniform(-tol, tol))))
    df = spark.createDataFrame(rows, "x double, y double")
    gap = F.abs(N.amount_bucket(F.col("x")) - N.amount_bucket(F.col("y")))
    assert df.agg(F.max(gap)).first()[0] <= 1


def test_item_similarity_matches_brute_force(spark):
    rng = random.Random(2)
    pairs = {(c, f"i{rng.randint(0, 30)}") for c in range(700) for _ in range(6)} | {(999, f"i{j}") for j in range(31)}
    df = spark.createDataFrame(sorted(pairs), "customer int, item string")
    got = {(r.item, r.other): (r.n_common, r.similarity) for r in Y.item_similarity(df).collect()}
    buyers = {}
    for c, i in pairs:
        buyers.setdefault(i, set()).add(c)
    for a in buyers:
        for b in buyers:
            n = len(buyers[a] & buyers[b])
            if a != b and n:
                assert got[a, b] == (n, pytest.approx(n / (len(buyers[a]) * len(buyers[b])) ** 0.5))


def test_line_copies_follow_header_copies(spark):
    rows = [(i, "A", 1) for i in range(1, 5)] + [(10, "B", 1), (11, "B", 1), (12, "B", 2)] + [(20 + i, "C", 3) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, doc string, v int")
    heads = spark.createDataFrame([("A", 2), ("C", 2)], "doc string, copies int")
    kept = sorted(r.id for r in star.copies_kept(df, ["doc", "v"], "id", heads, "doc").collect())
    assert kept == [1, 2, 10, 11, 12, 20, 21, 22]


def test_chunks_match_a_plain_loop(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        paras = ["".join(rng.choice("abc  d") for _ in range(rng.choice([5, 60, 240, 499, 500, 501, 1300]))) for _ in range(rng.randint(1, 6))]
        texts.append("\n\n".join(paras))

    def plain(text, size=500, overlap=50):
        import re
        text = re.sub(r"[ \t]+", " ", text)
        out, buff = [], ""
        for p in [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]:
            if len(buff) + len(p) + 1 <= size:
                buff = f"{buff}\n{p}".strip()
                continue
            if buff:
                out.append(buff)
            buff = ""
            if len(p) > size:
                out += [p[s:s + size] for s in range(0, len(p), size - overlap)]
            else:
                buff = p
        return [c for c in out + [buff] if len(c.strip()) > 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in T.chunks(df, "doc_id").orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    for i, t in enumerate(texts):
        if len(t.strip()) > 30:
            assert got.get(i, []) == plain(t)


def test_adjusted_rand_index(spark):
    same = spark.createDataFrame([(0, 5), (0, 5), (1, 7), (1, 7)], "a int, b int")
    assert L.rand_index(same, "a", "b").first()["ari"] == pytest.approx(1.0)
    mixed = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert L.rand_index(mixed, "a", "b").first()["ari"] < 0.0


def test_paired_methods_report_missing_rows(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert not L.paired(a, a.filter("k = 1"), ["k"]).first()["full_coverage"]


def test_invoice_text(spark):
    text = "FACTURE N° F-2026-118\nDate : 12 mars 2026\nTotal HT : 1 234,500\nTVA 19 % : 234,555\nTotal TTC : 1 469,055\nNet à payer : 1 470,055 DT"
    r = N.extract_fields(spark.createDataFrame([(1, text)], "id int, text string")).first()
    assert (r.number, r.date, r.ht, r.vat, r.ttc, r.net, r.currency) == ("F-2026-118", dt.date(2026, 3, 12), 1234.5, 234.555, 1469.055, 1470.055, "TND")
    bad = text.replace("1 469,055", "1 969,055")
    assert N.extract_fields(spark.createDataFrame([(1, bad)], "id int, text string")).first().ttc == 1469.055


def test_text_search_moves_no_weights_of_other_terms(spark):
    """The same rows as by the whole index, also for repeated, missing and empty keys and texts; texts are shuffled by key alone."""
    from tradewright.operators import text as T
    rows = [(1, "alpha beta gamma"), (1, "alpha delta"), (2, "beta beta gamma"), (None, "alpha beta"), (None, "gamma"), (3, ""), (4, None), (5, "omega psi chi")]
    docs, asked = spark.createDataFrame(rows, "doc int, text string"), spark.createDataFrame([(7, "alpha beta"), (8, "gamma unknown"), (9, None)], "item int, text string")
    got = T.text_search(docs, ["doc"], "text", asked, "item", "text", floor=0.0)
    index, idf = T.tfidf_index(docs, ["doc"], "text")
    want = T.tfidf_search(index, idf, asked, "item", "text", ["doc"], floor=0.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
