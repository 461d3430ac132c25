"""The registered queries of the operators: SQL where there is some, rows and
columns for the others, and each stage of the pipeline."""

import pytest

import corpus_pipeline
from papyra.llm import queries
from tests.oracle_compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    assert compare(spark, SF, [name], verbose=False)[name].startswith("ok")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs_over_its_table(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_stages_keep_their_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert 200 >= counts[0] == counts[1] >= counts[2] > 100
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[3]


def test_copies_of_the_mix_are_numbered_and_encoded_apart(spark):
    rows = [(i, " ".join(f"word{(i * j) % 97}" for j in range(40)), "en", f"s{i % 3}", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as copy")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    by_doc = {}
    for r in mixed.collect():
        by_doc.setdefault(r.doc_id, []).append(r.copy)
    assert all(sorted(c) == list(range(1, len(c) + 1)) for c in by_doc.values())
    twice = {i for i, c in by_doc.items() if len(c) == 2}
    ids = {}
    for r in corpus_pipeline.encode_pieces(spark, mixed, SF).collect():
        ids.setdefault(r.doc_id, set()).add(tuple(r.ids))
    assert twice and all(len(ids[i]) == 2 for i in twice)


def test_toxic_stage_drops_what_op8_predicts(spark):
    from papyra.llm import toxicity
    sf = "/root/testdata/sf0.1"  # the smaller ones have no score between 0.3 and 0.5
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.judged(toxicity.score(docs, toxicity.fit(docs, labels, "toxic")), 4, 2, 0.3).collect()
    kept = {r.doc_id for r in corpus_pipeline.filter_toxic(spark, docs, sf).select("doc_id").collect()}
    assert kept == {r.doc_id for r in scored if not r.predicted}
    assert any(0.3 <= r.score < 0.5 for r in scored)
