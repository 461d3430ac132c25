"""Sum-of-squares packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut; all pieces are dealt out by hash into
groups of some ``GROUP`` pieces.  A group is packed by one task, longest piece
first: of the open sequences that a piece fits into, it goes where the sum over
all residual gaps of the squared number of open sequences with that gap becomes
smallest (ties: the tightest); a new sequence opens when it fits into none.  A group
sees every kind of length, so it packs as tightly as all documents together, to
within a few sequences; groups share nothing, so their number grows with the data.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import tidy, written
from papyra.llm.byte_bpe import encoder
from papyra.llm.words import as_texts, slices

GROUP = 8192
BATCH = 4096  # pieces of an output batch
SLICE = 4 << 20


def cut_lengths(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, length) of texts of ``n`` ids: the first piece takes what
    whole pieces leave over."""
    count = -(-n // most)
    doc = np.repeat(np.arange(len(n)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, piece, np.where(piece == 0, n[doc] - (count[doc] - 1) * most, most)


def sum_of_squares(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; lengths from 1 to ``most``."""
    open_with = [[] for _ in range(most + 1)]  # gap -> sequences
    count = np.zeros(most + 1, np.int64)
    seq, at = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        with_gap = count[size:most]
        # taking gap g for g - size changes the sum by 2 (count[g - size] - count[g] + 1), and by 1 - 2 count[g] when nothing is left
        change = 2 * (count[:most - size] - with_gap + 1)
        change[:1] = 1 - 2 * with_gap[:1]
        fits = np.flatnonzero(with_gap)
        if len(fits):
            gap = size + int(fits[change[fits].argmin()])
            seq[i] = open_with[gap].pop()
            count[gap] -= 1
        else:
            gap, seq[i] = most, n
            n += 1
        at[i] = most - gap
        if gap > size:
            open_with[gap - size].append(int(seq[i]))
            count[gap - size] += 1
    return seq, at


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """(id, __row, piece, start, length, ids: little-endian unsigned 32-bit) of every
    piece; ``__row`` numbers the rows of the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))

    def run(batches):
        enc, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = as_texts(batch["__text"])
            for first, some in slices(texts, SLICE):
                ids, n = enc.flat(some)
                ends = np.cumsum(n)
                ids, n = np.insert(ids, ends, end_id).astype("<u4"), n + 1
                doc, piece, length = cut_lengths(n, most)
                start = np.cumsum(length) - length
                own = start - np.repeat((np.cumsum(n) - n), -(-n // most))
                keys = batch["__id"].slice(first, len(some))
                for a in range(0, len(doc), BATCH):
                    b = min(a + BATCH, len(doc))
                    edge = np.concatenate([start[a:b], [start[b - 1] + length[b - 1]]]) - start[a]
                    part = ids[start[a]:start[b - 1] + length[b - 1]]
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(doc[a:b])), pa.array(row + doc[a:b]), pa.array(piece[a:b].astype(np.int32)),
                         pa.array(own[a:b]), pa.array(length[a:b]),
                         pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * edge).astype(np.int32)), pa.py_buffer(part.tobytes())])],
                        ["id", "__row", "piece", "start", "length", "ids"])
                row += len(some)

    return rows.mapInArrow(tidy(run), "id long, __row long, piece int, start long, length long, ids binary")


def placed(pieces: DataFrame, most: int, group: int = GROUP) -> DataFrame:
    """(__row, piece, sequence_id, offset) of the pieces of a stored table."""
    groups = max(1, -(-pieces.count() // group))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("__row", "ascending"), ("piece", "ascending")])
        seq, at = sum_of_squares(part["length"].to_numpy(), most)
        return pa.table({"__row": part["__row"], "piece": part["piece"], "sequence_id": pa.array((part["__group"].to_numpy() << 32) + seq),
                         "offset": pa.array(at)})

    dealt = pieces.select("__row", "piece", "length", F.pmod(F.xxhash64("__row", "piece"), F.lit(groups)).alias("__group"))
    return dealt.groupBy("__group").applyInArrow(run, "__row long, piece int, sequence_id long, offset long")


class Packed(NamedTuple):
    """pieces: (id, __row, piece, start, length, ids); places: (__row, piece, sequence_id, offset)."""

    pieces: DataFrame
    places: DataFrame

    def rows(self, *columns) -> DataFrame:
        """Every piece at its place.  ``columns``: what is taken of ``pieces`` (by
        default all); only that is shuffled."""
        taken = self.pieces.select("__row", "piece", *(columns or [c for c in self.pieces.columns if c not in ("__row", "piece")]))
        return taken.join(self.places, ["__row", "piece"]).drop("__row")


def pack(docs: DataFrame, tokenizer: str, end_id: int, most: int = 1024, id_col: str = "doc_id", text_col: str = "text",
         group: int = GROUP) -> Packed:
    """Each document with ``end_id`` behind it, in pieces of at most ``most`` ids, and
    the place of each piece in a sequence of at most ``most`` ids.

    A document of at most ``most`` ids is one piece.  A longer one is cut into pieces of
    ``most`` ids; the first may be shorter.  Pieces of a sequence lie one
    after the other from 0.  Texts are encoded once, next to where they are read;
    the pieces are stored in the shared folder, and only (row, piece, length)
    goes through the packing.

    Defined cases: a null or empty text is ``end_id`` alone; null and repeated ids
    keep all their rows, each packed by itself; other columns are not read;
    an empty table gives no rows.
    """
    if most < 1:
        raise ValueError("a sequence holds at least one id")
    pieces = written(tokenised(docs, tokenizer, end_id, most, id_col, text_col).withColumnRenamed("id", id_col), "pieces")
    return Packed(pieces, placed(pieces, most, group))
