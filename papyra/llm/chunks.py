"""Key exchange between chunks of documents.

Counting or comparing hashes of every word position as single rows would
shuffle tens of bytes a position.  Here documents are dealt out by hash into
chunks; each chunk sends its distinct keys to the key's bucket as one sorted
binary column per bucket, the bucket answers with one value per key in the same
order, and the chunk, made again from the same exchange, reads the answers.
A key that a third of all documents share is one key per chunk, so no bucket or
chunk grows with it.  Chunks and buckets are as many as
``spark.sql.shuffle.partitions``: size that setting by the data, as for joins.
All steps are deterministic, so a lost executor's part is made again alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import give_back, partitions

LOW = np.uint64(0xFFFFFFFF)
MESSAGE = pa.schema([("__bucket", pa.int32()), ("__chunk", pa.int32()), ("__kind", pa.int32()), ("__data", pa.binary())])
MESSAGE_SQL = "__bucket int, __chunk int, __kind int, __data binary"


def chunked(docs: DataFrame, id_col: str, text_col: str, **more: Column) -> tuple[DataFrame, int]:
    """__id, __text, ``more`` and __chunk, dealt out by chunk, and the number of chunks."""
    n = partitions(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"),
                       *[c.alias(name) for name, c in more.items()])
    return base.withColumn("__chunk", F.pmod(F.xxhash64("__id", "__text"), F.lit(n)).cast("int")).repartition(n, "__chunk"), n


def bucket_keys(h: np.ndarray, n: int) -> np.ndarray:
    """(bucket << 32) + 32 bits of the hash; sorting by it sorts by bucket."""
    return ((((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)) << np.uint64(32)) | (h & LOW)


def by_bucket(keys: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of the parts of sorted bucket keys that are not empty."""
    at = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    for b in np.flatnonzero(at[1:] > at[:-1]):
        yield int(b), int(at[b]), int(at[b + 1])


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, MESSAGE, strict=True)], schema=MESSAGE)


def ask(base: DataFrame, question: Callable[[int, pa.Table], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        try:
            return messages(question(int(key[0].as_py()), t))
        finally:
            give_back()

    return base.groupBy("__chunk").applyInArrow(run, MESSAGE_SQL)


def answer(asked: DataFrame, reply: Callable[[int, list[tuple[int, bytes]]], list[tuple[int, int, int, bytes]]]) -> DataFrame:
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("__chunk")
        got = list(zip(t["__chunk"].to_pylist(), t["__data"].to_pylist(), strict=True))
        try:
            return messages(reply(int(key[0].as_py()), got))
        finally:
            give_back()

    return asked.groupBy("__bucket").applyInArrow(run, MESSAGE_SQL)


def read(base: DataFrame, answers: DataFrame, work: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """``work`` gets a chunk, its rows and, by kind, its answers in bucket order."""
    def run(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        a = a.sort_by([("__kind", "ascending"), ("__bucket", "ascending")])
        got: dict[int, list[bytes]] = {}
        for kind, data in zip(a["__kind"].to_pylist(), a["__data"].to_pylist(), strict=True):
            got.setdefault(kind, []).append(data)
        whole = {k: b"".join(v) for k, v in got.items()}
        del a, got
        try:
            return work(int(key[0].as_py()), t, whole)
        finally:
            give_back()

    return base.groupBy("__chunk").cogroup(answers.groupBy("__chunk")).applyInArrow(run, schema)
