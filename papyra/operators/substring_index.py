"""Substring search for whole tables of terms, from stored character grams.

A batch of papers becomes two tables:

* ``texts``: (segment, block, paper_id, text) - one field of each paper, A-Z folded;
* ``grams``: (segment, gram, block, ids, n) - the papers of a block whose text holds
  a gram: every run of 1, 2 or 3 characters, and the empty run for all texts.

A term of up to 3 characters is a gram itself; a longer one can only occur where all
its runs of 3 do.  (gram, block) alone says which blocks hold all grams of a term; only
there the id lists of its rarest grams are read and intersected, and the texts that
are left are tested with ``contains``, so results are exact.  Terms never meet texts
that share no gram with them, and no pair of terms and texts is built without one.

As in the keyword index a segment is a batch, a paper that arrives again lives in its
newest segment, and nothing that is stored changes when a batch is added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.arrow_tokens import give_back
from papyra.functions.text import ascii_lower
from papyra.session import ship_package, written

BLOCK_PAPERS = 4096
GRAM = 3
MOST_GRAMS = 16  # of a term that choose blocks; the test of the whole term follows
READ_GRAMS = 3   # whose id lists are read in a block, the shortest ones
SALTS = 16       # a gram of many blocks meets its terms in so many places

TEXTS = "segment long, paper_id string, block long, text string"
GRAMS = "segment long, gram string, block long, ids array<string>, n long"


def _runs(chars: Column, k: int) -> Column:
    """All runs of k characters."""
    n = F.size(chars)
    run = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.concat(*[F.get(chars, i + j) for j in range(k)]))
    return F.when(n >= k, run).otherwise(F.array().cast("array<string>"))


def texts_of(papers: DataFrame, field: str, segment: int, block_papers: int = BLOCK_PAPERS) -> DataFrame:
    """One row a paper, null texts too (they hide older ones)."""
    blocks = max(1, -(-papers.count() // block_papers))
    block = F.lit(int(segment)).cast("long") * (1 << 32) + F.pmod(F.xxhash64("arxiv_id"), F.lit(blocks))
    return papers.select(F.col("arxiv_id").alias("paper_id"), block.alias("block"), ascii_lower(field).alias("text"))


def _grams(text: str) -> np.ndarray:
    """The distinct runs of 1 to GRAM characters of a text and the empty one, 21 bits a character."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
    runs, key = [np.zeros(1, np.int64)], np.zeros(len(c) + 1, np.int64)
    for k in range(min(GRAM, len(c))):
        key = (key[:len(c) - k] << 21) | c[k:]
        runs.append(key)
    return np.unique(np.concatenate(runs))


def _spelled(key: int) -> str:
    return "".join(chr(((key >> at) & 0x1FFFFF) - 1) for at in range(21 * (GRAM - 1), -1, -21) if (key >> at) & 0x1FFFFF)


def grams_of(texts: DataFrame) -> DataFrame:
    """One row per gram and block; a list holds at most the papers of a block, and a
    task holds one block."""
    ship_package(texts.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("paper_id").combine_chunks()
        found = [_grams(x.as_py()) for x in t["text"]]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        keys, code = np.unique(np.concatenate(found), return_inverse=True)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        # a paper id that came twice stands once in a list
        ids = pc.dictionary_encode(t["paper_id"].combine_chunks())
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        name = ids.indices.to_numpy(zero_copy_only=False)[row]
        new = np.ones(len(row), bool)
        new[1:] = (code[1:] != code[:-1]) | (name[1:] != name[:-1])
        n = np.bincount(code[new], minlength=len(keys)).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        out = pa.table({"gram": pa.array([_spelled(k) for k in keys.tolist()], pa.string()), "block": pa.array(np.full(len(keys), key[0].as_py())),
                        "ids": pa.ListArray.from_arrays(ends, ids.dictionary.take(pa.array(name[new]))), "n": pa.array(n)})
        del found, row, code, order, name, new
        give_back()
        return out

    whole = texts.where(F.col("text").isNotNull() & F.col("paper_id").isNotNull()).select("block", "paper_id", "text")
    return whole.groupBy("block").applyInArrow(run, "gram string, block long, ids array<string>, n long")


@dataclass
class SubstringIndex:
    """All segments of an index: the two stored tables."""
    texts: DataFrame
    grams: DataFrame

    @staticmethod
    def path(root: str, table: str, segment: int) -> str:
        return f"{root.rstrip('/')}/{table}/segment={int(segment)}"

    @classmethod
    def add(cls, root: str, papers: DataFrame, segment: int, field: str = "title", block_papers: int = BLOCK_PAPERS) -> None:
        """Write one batch as a segment of its own; a repeat overwrites itself."""
        at = cls.path(root, "texts", segment)
        texts_of(papers, field, segment, block_papers).write.mode("overwrite").parquet(at)
        grams_of(papers.sparkSession.read.parquet(at)).write.mode("overwrite").parquet(cls.path(root, "grams", segment))

    @classmethod
    def open(cls, spark: SparkSession, root: str, last: int | None = None) -> "SubstringIndex":
        """The segments under ``root``, up to number ``last`` (the last committed one)."""
        def read(name: str, schema: str) -> DataFrame:
            found = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
            return found if last is None else found.where(F.col("segment") <= int(last))
        return cls(read("texts", TEXTS), read("grams", GRAMS))

    def live(self) -> DataFrame:
        """(block, paper_id, text) of each paper in its newest segment."""
        newest = self.texts.groupBy("paper_id").agg(F.max("segment").alias("segment"))
        return self.texts.join(newest, ["paper_id", "segment"], "left_semi").select("block", "paper_id", "text")


def term_grams(terms: DataFrame) -> DataFrame:
    """(term, need, gram): the grams that choose a folded term's blocks, ``need`` of them."""
    t = terms.select(ascii_lower("term").alias("term")).where(F.col("term").isNotNull()).distinct().withColumn("_c", F.split("term", ""))
    grams = F.when(F.length("term") <= GRAM, F.array("term")).otherwise(
        F.slice(F.array_distinct(_runs(F.col("_c"), GRAM)), 1, MOST_GRAMS))
    t = t.withColumn("_g", grams)
    return t.select("term", F.size("_g").alias("need"), F.explode("_g").alias("gram"))


def term_blocks(index: SubstringIndex, terms: DataFrame) -> DataFrame:
    """(term, block, read): the blocks that hold all grams of a term, and the rarest of
    these grams there; no id list is read."""
    asked = written(term_grams(terms), "grams").withColumn("_s", F.explode(F.lit(list(range(SALTS)))))
    held = index.grams.select("gram", "block", "n", F.pmod("block", F.lit(SALTS)).cast("int").alias("_s"))
    met = held.join(asked, ["gram", "_s"]).groupBy("term", "need", "block").agg(
        F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("_g"))
    read = F.slice(F.transform("_g", lambda g: g["gram"]), 1, READ_GRAMS)
    return met.where(F.size("_g") == F.col("need")).select("term", "block", read.alias("read"))


def find(index: SubstringIndex, terms: DataFrame) -> DataFrame:
    """(term, paper_id) of every paper whose text contains a ``term``, A-Z folded on
    both sides.

    Defined cases: a null term matches nothing, the empty term every text that is
    not null; terms of any length; terms equal when folded count once; a null text
    matches nothing; other columns of ``terms`` are not read.
    """
    blocks = term_blocks(index, terms)
    chosen = blocks.select("term", "block", F.size("read").alias("_k"), F.explode("read").alias("gram"))
    ids = chosen.join(index.grams.select("gram", "block", "ids"), ["gram", "block"])
    ids = ids.select("term", "block", "_k", F.explode("ids").alias("paper_id"))
    ids = ids.groupBy("term", "block", "_k", "paper_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == F.col("_k"))
    found = ids.join(index.live(), ["block", "paper_id"]).where(F.contains("text", "term"))
    return found.select("term", "paper_id").distinct()
