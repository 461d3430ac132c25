"""Keyword tokens of whole Arrow columns, found in the bytes of all texts at once.

The rules are those of ``text.tokenize``; texts come lower-cased by Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.functions.text import MIN_TOKEN_LEN, STOPWORDS

SLICE_BYTES = 1 << 22  # of text at once; a longer row is a slice of its own
_IN_RUN = np.zeros(256, bool)
_IN_RUN[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def give_back() -> None:
    """Return freed memory to the system; workers outlive the tasks that filled it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column, nulls as empty rows."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return at - at[0], data


def byte_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of at most ``most`` bytes, or of one row."""
    at, _ = _bytes_of(texts)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield first, end - first
        first = end


def runs(texts: pa.Array, least: int = 1) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of all maximal runs of a-z and 0-9 of ``least`` characters or more, in order."""
    at, data = _bytes_of(texts)
    ok = _IN_RUN[data]
    begin, last = ok.copy(), ok.copy()
    begin[1:] &= ~ok[:-1]
    last[:-1] &= ~ok[1:]
    full = at[:-1] < at[1:]  # a run ends with its row
    edge = at[:-1][full]
    begin[edge] = ok[edge]
    edge = at[1:][full] - 1
    last[edge] = ok[edge]
    start = np.flatnonzero(begin)
    length = np.flatnonzero(last) + 1 - start
    for j in range(least - 1):
        ok[start[(length < least) & (length > j)] + j] = False
    start, length = start[length >= least], length[length >= least]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(length), pa.py_buffer(ends), pa.py_buffer(data[ok]))
    return np.searchsorted(at, start, "right") - 1, words


def distinct_tokens(texts: pa.Array, only: pa.Array | None = None) -> pa.Array:
    """Each row's distinct keyword tokens, in order of first appearance; with ``only``
    those of them that it holds."""
    row, words = runs(texts, MIN_TOKEN_LEN + 1)
    if only is None:
        coded = words.dictionary_encode()
        names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keep = ~pc.is_in(names, pa.array(STOPWORDS, pa.large_string())).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
    else:
        names = only.cast(pa.large_string())
        code = pc.fill_null(pc.index_in(words, names), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = code >= 0
    row, code = row[keep], code[keep]
    first = np.sort(np.unique(row * (len(names) + 1) + code, return_index=True)[1])
    row, code = row[first], code[first]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, names.take(pa.array(code)).cast(pa.string()))


def with_tokens(df: DataFrame, text_col: str, only: list[str] | None = None) -> DataFrame:
    """``df`` with ``tokens`` for ``text_col``: its distinct keyword tokens, or those of them
    in ``only``, made next to where the rows are read."""
    from papyra.session import ship_package
    ship_package(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*kept, T.StructField("tokens", T.ArrayType(T.StringType()))])
    names = schema.fieldNames()

    def run(batches):
        some = None if only is None else pa.array(sorted(only), pa.string())
        try:
            for b in batches:
                for at, n in byte_slices(b.column(b.num_columns - 1)):
                    part = b.slice(at, n)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], distinct_tokens(part.columns[-1], some)], names)
        finally:
            give_back()

    return df.select(*[f.name for f in kept], F.lower(text_col).alias("_text")).mapInArrow(run, schema)
