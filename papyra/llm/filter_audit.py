"""Interaction audit of quality filters by contraction of contingency tensors.

Every document fails some of five filters.  What any order of the filters keeps
and removes follows from one 2x2x2x2x2 table per part: how many of its documents
pass (0) or fail (1) each filter.  So documents are read once and counted; the
table of a part is then contracted, for every order and step, with a vector per
filter: pass (1, 0), fail (0, 1) or all (1, 1).

Identical texts are found by a 128-bit hash.  Rows are counted by (text, part,
other filters, labels) before the smallest id of each text is joined to them, so
a text that a third of all rows hold is a few rows by then.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import WORD, row_key

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
MARKS = "[#$%&*|]"
SPREAD = 1024  # partitions that rows without an id may go to
BLOCK = 32  # parts contracted at once
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)


def selectors() -> dict[str, np.ndarray]:
    """For each count, (order and step, filter, 2): what is selected along each axis."""
    kept, removed, reach, alone = [], [], [], []
    for order in ORDERS:
        for step, f in enumerate(order):
            before, through = order[:step], order[:step + 1]
            kept.append([PASS if x in through else ALL for x in FILTERS])
            removed.append([FAIL if x == f else PASS if x in before else ALL for x in FILTERS])
            reach.append([FAIL if x == f else ALL for x in FILTERS])
            alone.append([FAIL if x == f else PASS for x in FILTERS])
    return {k: np.array(v, np.int64) for k, v in (("kept", kept), ("removed", removed), ("failing", reach), ("unique", alone))}


def contract(cells: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """cells (part, measure, 2, 2, 2, 2, 2) -> (part, measure, order and step)."""
    out = np.einsum("pmabcde,sa->pmsbcde", cells, chosen[:, 0])
    for axis in range(1, len(FILTERS)):
        out = np.einsum("pmsx...,sx->pms...", out, chosen[:, axis])
    return out


def _audit(batches):
    sel = selectors()
    steps = len(FILTERS)
    letter = np.array([f for order in ORDERS for f in order])
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(at, BLOCK)
            part, cells = rows["part"], np.zeros((rows.num_rows, 3, 1 << steps), np.int64)
            for i, held in enumerate(rows["cells"].to_pylist()):
                for c in held:
                    cells[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
            # mask has A in its highest bit, so the axes come in the order of the filters
            cells = cells.reshape(len(cells), 3, *[2] * steps)
            got = {k: contract(cells, v) for k, v in sel.items()}
            removed = got["removed"]
            share = np.zeros(removed[:, 0].shape, np.int64)
            for f in FILTERS:
                share[:, letter == f] = removed[:, 0][:, letter == f].sum(axis=1, keepdims=True)
            n, s = len(cells), len(letter)
            flat = {"kept": got["kept"][:, 0], "removed": removed[:, 0], "redundant": got["failing"][:, 0] - removed[:, 0],
                    "unique_fails": got["unique"][:, 0], "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": share}
            yield pa.RecordBatch.from_pydict(
                {"part": part.take(pa.array(np.repeat(np.arange(n), s))), "filter_order": pa.array(np.repeat(ORDERS, steps).tolist() * n),
                 "step": pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), n * len(ORDERS)))}
                | {k: pa.array(v.ravel()) for k, v in flat.items()})


def failures(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails (A: 16 ... D: 2)."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = [n < FEW_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * capitals > CAPITAL_PERCENT * F.length(text).cast("long"), text.rlike(MARKS)]
    return sum((F.when(c, F.lit(16 >> i)).otherwise(F.lit(0)) for i, c in enumerate(fails)), F.lit(0))


def contingency(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail
    (A: 16, B: 8, C: 4, D: 2, E: 1)."""
    lab = (labels.select(F.col(id_col).alias("__id"), F.col("quality").alias("__q"), F.col("toxic").alias("__t"))
           .where("__id is not null").groupBy("__id")
           .agg(F.max(F.when(F.col("__q") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("__t") == 1, 1).otherwise(0)).alias("toxic"))
           .withColumn("__spread", F.lit(0).cast("long")))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__words", F.regexp_extract_all("__text", F.lit(WORD), F.lit(0)))
    rows = rows.select("__id", "part", *row_key(F.col("__text")), failures(F.col("__text"), F.col("__words")).alias("__mask"))
    spread = F.when(F.col("__id").isNull(), F.pmod(F.xxhash64("__k1", "part"), F.lit(SPREAD))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("__spread", spread).join(lab, ["__id", "__spread"], "left").fillna(0, ["good", "toxic"])
    same = ["__k1", "__k2"]
    kind = [*same, "part", "__mask", "good", "toxic"]
    order = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"))
    by_id = rows.groupBy(*kind, "__id").agg(F.count(F.lit(1)).alias("__n"))
    counted = by_id.groupBy(*kind).agg(F.sum("__n").alias("__n"), F.min(F.struct(order.alias("o"), F.col("__n").alias("n"))).alias("__low"))
    first = counted.groupBy(*same).agg(F.min("__low.o").alias("__first"))
    # rows at the smallest id of their text pass E, all others fail it; among rows without an id nothing is smaller
    passes = F.when(F.col("__low.o") == F.col("__first"), F.col("__low.n")).otherwise(F.lit(0).cast("long"))
    cells = (counted.join(first, same).withColumn("__pass", passes)
             .select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("__mask").alias("mask"), F.col("__pass").alias("n")),
                                                                F.struct((F.col("__mask") + 1).alias("mask"), (F.col("__n") - F.col("__pass")).alias("n")))).alias("c")))
    return cells.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Filters: A under 200 words; B under half of the words distinct; C over 2 % capitals
    A-Z; D holds any of ``#$%&*|``; E text identical to that of a smaller id.

    Defined cases: a null text is empty, a null part ''; a row without an id
    has no label and comes after all ids (it fails E when any id has its text, and
    makes no other row fail); rows that repeat an id count each, and none of
    them makes another fail E; an id with several labels is good or toxic if any of
    its labels says so; null labels are neither; further columns are not read;
    an empty table gives no rows.
    """
    cells = contingency(docs, labels, id_col, text_col, part_col)
    # at most 32 cells a part
    tensors = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return tensors.mapInArrow(_audit, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                      "unique_fails long, good_lost long, toxic_lost long, shapley long")
