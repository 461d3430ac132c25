"""Distributed encoding of texts into vectors, and incremental embedding.

``encode`` runs any pluggable encoder inside tasks via ``mapInArrow``: the
encoder is built once per task (a model would be loaded once, not per row)
and sees Arrow batches cut to pieces of some ``SLICE_BYTES`` of text, so what a task
holds follows neither the number of rows in a batch nor their length.

The bundled encoder is signed feature hashing, a stand-in with no model
weights: tokens are lower-cased ASCII alphanumeric runs, truncated to the
first MAX_TOKENS; each token t with h = int(md5(t)[:8], 16) adds
(+1 if (h // dim) is even else -1) at index h % dim.
"""

from __future__ import annotations

import hashlib
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions.arrow_tokens import byte_slices, give_back, runs
from papyra.functions.text import document_text
from papyra.operators import lookup, upsert
from papyra.session import checkpoint_dir

MAX_TOKENS = 512   # fixed: encoder input is cut to this many tokens
HASH_DIM = 64
MOST_REMEMBERED = 1 << 16  # tokens whose slot an encoder keeps


class HashingEncoder:
    """Signed feature hashing of word tokens (document and query modes are
    the same function here; a real model would switch adapters)."""

    def __init__(self, dim: int = HASH_DIM, max_tokens: int = MAX_TOKENS):
        self.dim = dim
        self.max_tokens = max_tokens
        self._cache: dict[str, int] = {}

    def _slot(self, tok: str) -> int:
        """The token's index, or that and ``dim`` more where it counts as -1."""
        hit = self._cache.get(tok)
        if hit is None:
            h = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16)
            hit = h % self.dim + (h // self.dim) % 2 * self.dim
            if len(self._cache) >= MOST_REMEMBERED:
                self._cache.clear()
            self._cache[tok] = hit
        return hit

    def encode(self, texts: list, mode: str = "document") -> np.ndarray:
        out = np.empty((len(texts), self.dim), dtype=np.float32)
        lowered = pa.array([None if t is None else t.lower() for t in texts], pa.large_string())
        for first, n in byte_slices(lowered):
            row, words = runs(lowered.slice(first, n))
            keep = np.arange(len(row)) - np.searchsorted(row, row) < self.max_tokens
            row, coded = row[keep], words.filter(pa.array(keep)).dictionary_encode()
            slots = np.fromiter(map(self._slot, coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            at = row * (2 * self.dim) + slots[coded.indices.to_numpy(zero_copy_only=False)]
            count = np.bincount(at, minlength=n * 2 * self.dim).reshape(n, 2, self.dim)
            out[first:first + n] = count[:, 0] - count[:, 1]
        return out


def encode(df: DataFrame, text_col: str, id_col: str,
           encoder_factory: Callable[[], object] = HashingEncoder, mode: str = "document") -> DataFrame:
    """(id, embedding array<float>) for every row of ``df``, next to where it is read:
    one encoder a task, pieces of Arrow batches, no shuffle."""
    from papyra.session import ship_package
    ship_package(df.sparkSession)

    def fn(batches):
        enc = encoder_factory()
        try:
            for rb in batches:
                for at, n in byte_slices(rb.column(1)):
                    vecs = np.asarray(enc.encode(rb.column(1).slice(at, n).to_pylist(), mode=mode), dtype=np.float32)
                    dim = vecs.shape[1] if vecs.ndim == 2 else 0
                    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, dtype=np.int32))
                    emb = pa.ListArray.from_arrays(offsets, pa.array(vecs.ravel(), pa.float32()))
                    yield pa.RecordBatch.from_arrays([rb.column(0).slice(at, n), emb], names=[id_col, "embedding"])
        finally:
            give_back()

    schema = f"{id_col} string, embedding array<float>"
    return df.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(fn, schema)


def embed_missing(papers: DataFrame, paper_embeddings: DataFrame, model: str, batch_ts,
                  encoder_factory: Callable[[], object] = HashingEncoder) -> DataFrame:
    """Encode only papers without a vector of ``model`` and upsert them.
    Re-running on the result adds nothing (the anti join is empty)."""
    return embed_missing_checked(papers, paper_embeddings, model, batch_ts, encoder_factory)[0]


def embed_missing_checked(papers: DataFrame, paper_embeddings: DataFrame, model: str, batch_ts,
                          encoder_factory: Callable[[], object] = HashingEncoder) -> tuple[DataFrame, DataFrame]:
    """As ``embed_missing``, with the vectors that the encoder got wrong and why.
    The new vectors are checkpointed, as the checks read them several times: every
    paper is encoded once."""
    checkpoint_dir(papers.sparkSession)
    todo = lookup.papers_missing_embedding(papers, paper_embeddings, model)
    texts = todo.select("arxiv_id", document_text("title", "abstract").alias("text"))
    vecs = encode(texts, "text", "arxiv_id", encoder_factory)
    incoming = vecs.select(F.col("arxiv_id").alias("paper_id"), F.lit(model).alias("model"), "embedding",
                           F.lit(0).cast("long").alias("seq")).checkpoint()
    return upsert.upsert_embeddings(paper_embeddings, incoming, batch_ts)
