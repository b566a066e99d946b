"""The registered queries beside their SQL, and the pipeline beside plain Python."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.check import compare, connect
from tests.conftest import DATA
from tests.llm import brute
from tradewright.llm import mixing, queries, quality
from tradewright.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    diff, n = compare(entry.queries()[name](spark, DATA), connect(DATA), entry.oracle_sql()[name])
    assert diff is None and n > 0


def test_one_query_for_each_operator():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names


def test_pipeline(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    labels = table(spark, DATA, "labels")
    rows = [(r.doc_id, r.text) for r in quality.keep_good(docs, labels).select("doc_id", "text").collect()]
    assert set(d for d, t in rows) <= {r.doc_id for r in docs.collect() if brute.statistics(r.text)[0] >= 20}
    rows = [(d, v[2]) for (d, _), v in zip(rows, brute.lines(rows).values())]
    comp = brute.components(rows, corpus_pipeline.NEAR)
    rows = [(d, t) for d, t in rows if comp[d] == d]
    source = {r.doc_id: r.source for r in docs.collect()}
    mixed = mixing.mix(spark.createDataFrame([(d, t, source[d]) for d, t in rows], "doc_id long, text string, source string")).collect()
    taken = {r.doc_id: r.repeats for r in mixed if r.repeats}
    assert set(got) == set(taken)
    coder, text = brute.encoding(), dict(rows)
    for d, r in got.items():
        assert r.ids == coder.encode_ordinary(text[d]) and r.decoded_sha256 == brute.sha(text[d])
    assert len(corpus_pipeline.STAGES) == 5


def test_near_copy_stage_takes_copies_from_0_8_on(spark):
    """Pairs of similarity 0.80 to 0.85 lose one document in the stage; op5 keeps to 0.85."""
    rows, alike = [], {}
    for i in range(30):
        words = [f"t{i}w{k}" for k in range(400)]
        cut = 8 + i                                                      # words cut from the end: shingles stay a part of the whole
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:400 - 2 * cut]))]
        alike[i] = 100 * (396 - 2 * cut) >= corpus_pipeline.NEAR * 396
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()}
    assert kept == {2 * i for i in alike} | {2 * i + 1 for i, near in alike.items() if not near}
    at_85 = brute.components(rows, 85)
    between = [i for i, near in alike.items() if near and at_85[2 * i + 1] == 2 * i + 1]
    assert len(between) > 5 and all(2 * i + 1 not in kept for i in between)


def test_every_stage_on_an_empty_table(spark):
    docs = table(spark, DATA, "documents").where("false")
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, DATA)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
