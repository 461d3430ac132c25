"""Pluggable encoder and incremental embedding."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from papyra.operators import embed as EM


class CountingEncoder:
    """A stand-in model: [length, mode flag]."""

    def encode(self, texts, mode="document"):
        return np.array([[len(t or ""), 1.0 if mode == "query" else 0.0] for t in texts], dtype=np.float32)


def test_custom_encoder_and_mode(spark):
    df = spark.createDataFrame([("a", "xyz"), ("b", "")], "id string, text string")
    doc = {r.id: r.embedding for r in EM.encode(df, "text", "id", CountingEncoder).collect()}
    qry = {r.id: r.embedding for r in EM.encode(df, "text", "id", CountingEncoder, mode="query").collect()}
    assert doc == {"a": [3.0, 0.0], "b": [0.0, 0.0]}
    assert qry == {"a": [3.0, 1.0], "b": [0.0, 1.0]}


def test_hashing_encoder_rules():
    enc = EM.HashingEncoder()
    v = enc.encode(["abc abc", "ABC", None, " ".join(["tok"] * 600)])
    assert v.shape == (4, 64)
    assert np.count_nonzero(v[0]) == 1 and abs(v[0]).sum() == 2.0   # same token twice
    assert np.array_equal(v[1] * 2, v[0])                            # lower-cased
    assert not v[2].any()
    assert abs(v[3]).sum() == 512                                    # cut at 512 tokens
    # 'abc' -> md5 prefix 2416005272: index 2416005272 % 64, sign by parity of // 64
    h = 2416005272
    assert v[1][h % 64] == (1.0 if (h // 64) % 2 == 0 else -1.0)


def test_embed_missing_is_rerunnable(spark):
    t0 = dt.datetime(2024, 1, 1)
    papers = spark.createDataFrame([("p1", "T1", "A1"), ("p2", "T2", "A2")], "arxiv_id string, title string, abstract string")
    emb = spark.createDataFrame([("p1", "other", [1.0, 2.0], 2, t0)],
                                "paper_id string, model string, embedding array<float>, dim int, created_at timestamp_ntz")
    ts = F.lit("2024-02-01").cast("timestamp_ntz")
    once = EM.embed_missing(papers, emb, "hash", ts).cache()
    assert once.where("model = 'hash'").count() == 2 and once.count() == 3
    twice = EM.embed_missing(papers, once, "hash", F.lit("2024-03-01").cast("timestamp_ntz"))
    assert sorted(twice.collect()) == sorted(once.collect())   # nothing left to embed
