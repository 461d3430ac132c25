"""Upsert rules with hand-made batches."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.operators import upsert as U
from papyra.schemas import PAPER_SCHEMA

T0 = dt.datetime(2024, 1, 1)


def _batch(spark, rows):
    """rows: (seq, id, title, authors, categories, doi)"""
    data = [(i, t, "abs", a, c, c[0] if c else "", T0, T0, "pdf", "abs", None, None, doi, seq)
            for seq, i, t, a, c, doi in rows]
    schema = T.StructType(PAPER_SCHEMA.fields + [T.StructField("seq", T.LongType())])
    return spark.createDataFrame(data, schema)


def _apply(spark, tables, rows, ts):
    return U.apply_batch(tables, _batch(spark, rows), F.lit(ts).cast("timestamp_ntz"))


def test_upsert_rules(spark):
    t = U.empty_tables(spark)
    t = _apply(spark, t, [(1, "p1", "old", ["x", "y"], ["cs.CL"], "10.1/a"),
                          (2, "p2", "two", ["y"], ["cs.LG"], None)], "2024-02-01")
    t = {k: v.cache() for k, v in t.items()}
    # second batch: p1 twice (last seq wins), authors re-ordered and one removed, doi -> NULL;
    # p1v2 is a separate paper
    t2 = _apply(spark, t, [(10, "p1", "new", ["z", "x"], ["cs.AI"], None),
                           (5, "p1", "mid", ["y", "x"], ["cs.CL"], "10.1/b"),
                           (7, "p1v2", "v2", ["x", "x"], ["cs.CL"], None)], "2024-03-01")
    papers = {r.arxiv_id: r for r in t2["papers"].collect()}
    assert papers["p1"].title == "new" and papers["p1"].doi is None
    assert papers["p1"].ingested_at == dt.datetime(2024, 2, 1)          # first ingest kept
    assert papers["p1v2"].ingested_at == dt.datetime(2024, 3, 1)
    assert set(papers) == {"p1", "p2", "p1v2"}
    authors = {r.name: r.author_id for r in t2["authors"].collect()}
    assert set(authors) == {"x", "y", "z"}
    assert len(set(authors.values())) == 3
    assert authors["x"] < authors["y"] < authors["z"]                  # increasing by first appearance
    pa = {(r.paper_id, r.author_id): r.author_order for r in t2["paper_authors"].collect()}
    # links accumulate; existing (p1, x)=0 and (p1, y)=1 keep their first order
    assert pa[("p1", authors["x"])] == 0 and pa[("p1", authors["y"])] == 1
    assert pa[("p1", authors["z"])] == 0                                # new link: first position seen
    # a name listed twice keeps its first position
    assert pa[("p1v2", authors["x"])] == 0
    cats = {r.code for r in t2["categories"].collect()}
    assert cats == {"cs.CL", "cs.LG", "cs.AI"}
    pc = {(r.paper_id, r.category_code) for r in t2["paper_categories"].collect()}
    assert ("p1", "cs.CL") in pc and ("p1", "cs.AI") in pc              # every batch row contributes


def test_counts_second_arrival_is_update(spark):
    cur = _batch(spark, [(1, "a", "t", [], [], None)]).drop("seq")
    inc = _batch(spark, [(2, "a", "t", [], [], None), (3, "b", "t", [], [], None),
                         (4, "b", "t", [], [], None)])
    r = U.upsert_counts(cur, inc).collect()[0]
    assert (r.new_count, r.updated_count) == (1, 2)


def test_upsert_twice_equals_once(spark):
    t = U.empty_tables(spark)
    rows = [(1, "p1", "t", ["a", "b"], ["c1"], None), (2, "p2", "u", ["b"], ["c2"], None)]
    once = {k: v.cache() for k, v in _apply(spark, t, rows, "2024-02-01").items()}
    twice = _apply(spark, once, rows, "2024-03-01")
    for name in ("authors", "paper_authors", "categories", "paper_categories"):
        assert sorted(once[name].collect()) == sorted(twice[name].collect()), name
    assert sorted(r.ingested_at for r in twice["papers"].collect()) == [dt.datetime(2024, 2, 1)] * 2


def test_vector_upsert_quarantine(spark):
    cur = spark.createDataFrame([("p1", "m", [1.0, 2.0], 2, T0)],
                                "paper_id string, model string, embedding array<float>, dim int, created_at timestamp_ntz")
    inc = spark.createDataFrame([("p1", "m", [3.0, 4.0], 1), ("p1", "m", [float("nan"), 1.0], 2),
                                 ("p2", "m", [1.0], 3), ("p3", "m", None, 4), ("p4", "m", [5.0, 6.0], 5)],
                                "paper_id string, model string, embedding array<float>, seq long")
    nxt, rej = U.upsert_embeddings(cur, inc, F.lit("2024-05-01").cast("timestamp_ntz"))
    got = {r.paper_id: r for r in nxt.collect()}
    assert got["p1"].embedding == [3.0, 4.0] and got["p1"].created_at == dt.datetime(2024, 5, 1)
    assert set(got) == {"p1", "p4"}
    assert rej.count() == 3


def test_cascade_delete(spark):
    t = _apply(spark, U.empty_tables(spark), [(1, "p1", "t", ["a"], ["c"], None),
                                              (2, "p2", "t", ["a"], ["c"], None)], "2024-02-01")
    t["paper_embeddings"] = spark.createDataFrame(
        [("p1", "m", [1.0], 1, T0), ("p2", "m", [1.0], 1, T0)],
        "paper_id string, model string, embedding array<float>, dim int, created_at timestamp_ntz")
    ids = spark.createDataFrame([("p1",)], "arxiv_id string")
    after = U.cascade_delete(t, ids)
    assert [r.arxiv_id for r in after["papers"].collect()] == ["p2"]
    for name in ("paper_authors", "paper_categories", "paper_embeddings"):
        assert {r.paper_id for r in after[name].collect()} == {"p2"}
    assert after["authors"].count() == 1 and after["categories"].count() == 1
    both = U.cascade_delete(U.cascade_delete(t, t["authors"], "authors"), t["categories"], "categories")
    assert [both[n].count() for n in ("papers", "authors", "paper_authors", "categories", "paper_categories", "paper_embeddings")] == [2, 0, 0, 0, 0, 2]
    assert U.orphans(t["paper_embeddings"], after["papers"]).count() == 1


def test_author_ids_follow_first_appearance_whatever_the_seq(spark):
    """Arrival numbers of far partitions neither overflow nor leave gaps."""
    far = 16384 << 33
    rows = [("p1", far + 1, ["B", "A"]), ("p2", 3, ["C", "A"]), ("p3", far, ["D"] * 70000 + ["E"])]
    inc = spark.createDataFrame(rows, "arxiv_id string, seq long, authors array<string>")
    cur = spark.createDataFrame([(7, "C")], "author_id long, name string")
    got = {r.name: r.author_id for r in U.upsert_authors(cur, inc).collect()}
    assert got == {"C": 7, "A": 8, "D": 9, "E": 10, "B": 11}


def test_one_dimension_per_new_model(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    cur = spark.createDataFrame([("p1", "old", [1.0, 2.0], 2, t0)],
                                "paper_id string, model string, embedding array<float>, dim int, created_at timestamp_ntz")
    inc = spark.createDataFrame([("p1", "new", [1.0, 2.0, 3.0], 5), ("p2", "new", [1.0, 2.0], 6), ("p3", "old", [1.0], 7)],
                                "paper_id string, model string, embedding array<float>, seq long")
    nxt, rejects = U.upsert_embeddings(cur, inc, F.lit("2024-02-01").cast("timestamp_ntz"))
    assert {(r.paper_id, r.model, r.dim) for r in nxt.collect()} == {("p1", "old", 2), ("p1", "new", 3)}
    assert {r.paper_id for r in rejects.collect()} == {"p2", "p3"}
