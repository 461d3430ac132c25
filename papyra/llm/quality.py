"""Quality classifier: supervised subword embeddings."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.labelled import sample
from papyra.llm.words import IS_WHITE, U64, as_texts, bounds, slices, text_bytes, word_hashes

BITS = 15
REPEATED = 0  # bucket of a word that equals the one before it


class Model(NamedTuple):
    """``vectors`` (bucket x dim), softmax ``out`` (dim x 2) and ``bias`` (2)."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray


def buckets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the features: whole words, repeats of the word before,
    and 3- and 4-grams of bytes of the words between their boundary signs."""
    buf, off = text_bytes(texts)
    n = len(off) - 1
    # one space before each text and one at the end bound its words
    wide = np.full(len(buf) + n + 1, 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(off))
    wide[np.arange(len(buf)) + row + 1] = buf
    start = off[:-1] + np.arange(n)
    white = IS_WHITE[wide]
    wide = np.where(white, np.uint8(32), wide)
    row_of = np.repeat(np.arange(n), np.diff(np.append(start, len(wide)))) if n else np.zeros(0, np.int64)
    out = []
    x = wide.astype(np.uint32) + np.uint32(1)
    for k, factors in ((3, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), (4, (0x27D4EB2F, 0x165667B1, 0xD3A2646D, 0xFD7046C5))):
        m = len(x) - k + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for j, f in enumerate(factors):
            h += x[j:j + m] * np.uint32(f)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
        inner = ~white[1:1 + m]
        for j in range(2, k - 1):
            inner &= ~white[j:j + m]
        at = np.flatnonzero(inner)
        out.append((row_of[at], h[at].astype(np.int64)))
    w = bounds(buf, off)
    h = word_hashes(w)
    out.append((w.doc, (h >> U64(64 - BITS)).astype(np.int64)))
    again = np.flatnonzero((h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
    # a repeat weighs about as much as the word's own grams, else long words would hide it
    rows = np.repeat(w.doc[again], 2 * (w.end - w.start)[again])
    out.append((rows, np.full(len(rows), REPEATED, np.int64)))
    return out


def bags(column) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets of each row and their counts."""
    ids, counts = [], []
    for _, texts in slices(as_texts(column)):
        parts = buckets(texts)
        row, b = np.concatenate([r for r, _ in parts]), np.concatenate([x for _, x in parts])
        key, n = np.unique((row << BITS) | b, return_counts=True)
        edge = np.searchsorted(key, np.arange(len(texts) + 1) << BITS)
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            ids.append((key[i:j] & ((1 << BITS) - 1)).astype(np.int32))
            counts.append(n[i:j].astype(np.int32))
    return ids, counts


def train(ids: list[np.ndarray], counts: list[np.ndarray], y: np.ndarray, dim: int = 8, epochs: int = 6, rate: float = 0.1,
          seed: int = 7) -> Model:
    """Stochastic gradient descent over documents, steps scaled by past gradients."""
    rng = np.random.default_rng(seed)
    vec = rng.normal(0, 0.1, (1 << BITS, dim))
    out, bias = rng.normal(0, 0.5, (dim, 2)), np.zeros(2)
    s_vec, s_out, s_bias = np.full((1 << BITS, dim), 1e-8), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for d in rng.permutation(len(y)):
            i = ids[d]
            share = counts[d] / max(1, counts[d].sum())
            x = share @ vec[i]
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1
            g_out, g_vec = np.outer(x, p), np.outer(share, out @ p)
            s_out += g_out**2
            s_bias += p**2
            s_vec[i] += g_vec**2
            out -= step * g_out / np.sqrt(s_out)
            bias -= step * p / np.sqrt(s_bias)
            vec[i] -= step * g_vec / np.sqrt(s_vec[i])
    return Model(vec, out, bias)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 5_000, id_col: str = "doc_id",
        text_col: str = "text", **how) -> Model:
    """Train on at most ``most`` labelled documents, whole texts; their features
    are made by Spark, the descent runs on the driver.  Without labels all
    vectors are 0 and every score is 0.5."""
    def run(batches):
        for b in batches:
            ids, counts = bags(b["__text"])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())),
                                              b["__label"], b["__id"]], ["i", "n", "y", "id"])

    rows = sample(docs, labels, label_col, most, id_col, text_col).select("__id", "__text", "__label")
    got = rows.mapInArrow(run, "i array<int>, n array<int>, y int, id long").toArrow().sort_by("id")
    if not len(got):
        return Model(np.zeros((1 << BITS, 1)), np.zeros((1, 2)), np.zeros(2))

    def column(name: str) -> list[np.ndarray]:
        return [x.values.to_numpy() for x in got[name]]

    return train(column("i"), column("n"), (got["y"].to_numpy() == 1).astype(int), **how)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row's whole text, score the softmax of label 1.

    The average of a document's vectors times the softmax matrix is the average
    of one number per bucket, so tasks look up numbers, not vectors.

    Defined cases: null and empty texts have no features, their score is that of
    the bias; repeated rows and null ids get rows of their own; other columns are
    not read.
    """
    gain = (model.vectors @ (model.out[:, 1] - model.out[:, 0])).astype(np.float64)
    bias = float(model.bias[1] - model.bias[0])

    def run(batches):
        for b in batches:
            z = [np.zeros(0)]
            for _, texts in slices(as_texts(b["__text"])):
                total, n = np.zeros(len(texts)), np.zeros(len(texts))
                for row, bucket in buckets(texts):
                    total += np.bincount(row, weights=gain[bucket], minlength=len(texts))
                    n += np.bincount(row, minlength=len(texts))
                z.append(total / np.maximum(n, 1) + bias)
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(z), -30, 30)))
            yield pa.RecordBatch.from_arrays([b["__id"], pa.array(p)], [id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double")
