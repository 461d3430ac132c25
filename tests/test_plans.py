"""Physical plan shapes that matter at scale."""

import os

from pyspark.sql import functions as F

from papyra.operators import lookup as LK
from papyra.operators import ranking as R
from papyra.operators import vectors as V
from papyra.sources import testbed as TB

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_embedding_is_left_anti(spark):
    p = LK.papers_missing_embedding(TB.papers(spark, SF), TB.paper_embeddings(spark, SF), "m2")
    assert "LeftAnti" in plan(p)


def test_top_k_uses_window_group_limit(spark):
    df = spark.createDataFrame([(0, "a", 0.1)], "question_id long, paper_id string, score double")
    p = df._jdf.queryExecution().optimizedPlan().toString()
    p = R.top_k(df, 5, ["question_id"], "score", "paper_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in p


def test_model_filter_prunes_partitions(spark, tmp_dir):
    out = os.path.join(tmp_dir, "pe")
    TB.paper_embeddings(spark, SF).write.partitionBy("model").parquet(out)
    pe = spark.read.parquet(out)
    txt = plan(V.vectors_of(pe, "m2"))
    assert "PartitionFilters: [isnotnull(model" in txt and "m2" in txt
    assert "ReadSchema: struct<paper_id:string,embedding:array<float>>" in txt


def test_pushed_filter_and_pruned_columns(spark):
    o = TB.table(spark, SF, "orders").where(F.col("o_orderkey") < 100).select("o_orderkey")
    txt = plan(o)
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in txt
    assert "ReadSchema: struct<o_orderkey:bigint>" in txt


def test_store_reads_only_one_models_files(spark, tmp_dir):
    from papyra.sources.store import BatchStore
    store = BatchStore(spark, os.path.join(tmp_dir, "store"))
    store.write("paper_embeddings", TB.paper_embeddings(spark, SF), "f", 0)
    assert store.rows("paper_embeddings").count() == 0
    store.commit("f", 0)
    pe = store.tables()["paper_embeddings"]
    assert pe.count() == TB.paper_embeddings(spark, SF).count()
    # before the join with the commit markers: what the scan of one model reads
    raw = spark.read.option("basePath", f"{store.root}/paper_embeddings").parquet(f"{store.root}/paper_embeddings")
    files = raw.where("model = 'm2'").select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert files and all("model=m2" in r.f for r in files)
    txt = plan(store.rows("paper_embeddings").where("model = 'm2'"))
    assert "PartitionFilters: [isnotnull(model" in txt


def test_hybrid_makes_no_pair_table(spark):
    from papyra.operators import hybrid as H
    h = H.search_hybrid(TB.papers(spark, SF), TB.paper_embeddings(spark, SF), TB.questions(spark, SF), "m1")
    txt = plan(h)
    assert txt.count("FlatMapCoGroupsInArrow") >= 2
    assert "CartesianProduct" not in txt and "BroadcastNestedLoopJoin" not in txt


def test_pair_sampler_keeps_partial_limit(spark):
    from papyra.operators import diagnostics as D
    p = D.sample_pairs(V.vectors_of(TB.paper_embeddings(spark, SF), "m1"))
    txt = plan(p)
    assert "WindowGroupLimit" in txt and "SinglePartition" not in txt
    rows = p.collect()
    assert len(rows) == D.SAMPLE_PAIRS and all(r.id_a != r.id_b for r in rows)


def test_exemplars_shuffle_no_vector(spark):
    from papyra.operators import diagnostics as D
    out = D.category_exemplars(TB.papers(spark, SF), V.vectors_of(TB.paper_embeddings(spark, SF), "m1"), "cs.", "math.AG")
    txt = out._jdf.queryExecution().optimizedPlan().toString()
    # the two vectors meet in an aggregate behind a join with two broadcast ids
    assert "strategy=broadcast" in txt and txt.index("Aggregate") < txt.index("strategy=broadcast")
    out.collect()
