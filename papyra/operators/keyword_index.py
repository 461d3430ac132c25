"""Stored keyword postings, read block by block.

A batch of papers becomes two tables:

* ``papers``: (segment, paper_id, block, tokens) - the distinct keyword tokens of
  each paper, without its text;
* ``postings``: (segment, token, block, ids, n, first, last) - the sorted ids of
  the papers of a block that hold a token, with their number and id range.

A block is some ``BLOCK_PAPERS`` papers of one id range of one segment.  A segment is
a batch; a paper that arrives again lives in its newest segment, older postings of
it are passed over.  Nothing that is stored changes when a batch is added.

The overlap of a question with any paper of a block is at most the number of its
tokens that have a posting in the block (and the most tokens that a paper of it
holds).  These bounds come from (token, block) alone, so a search reads the id lists
of only those blocks whose bound reaches what it looks for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.arrow_tokens import give_back, with_tokens
from papyra.functions.text import tokenize
from papyra.operators.ranking import split_levels
from papyra.operators.vectors import IdCoder, count_before, _topk_positions
from papyra.session import ship_package, written

BLOCK_PAPERS = 4096
RANGES = 256          # at most so many id ranges of a segment, cut where drawn ids say
QUESTION_BLOCK = 256  # questions that one task answers over a block
NO_PAPER = -1         # blocks of vectors without a paper count down from here
SALTS = 16

POSTINGS = "segment long, token string, block long, ids array<string>, n long, first string, last string"
PAPERS = "segment long, paper_id string, block long, tokens array<string>"


def index_batch(papers: DataFrame, segment: int, block_papers: int = BLOCK_PAPERS) -> tuple[DataFrame, DataFrame]:
    """(papers, postings) of one batch; every arxiv_id once.  Ids are cut into
    ranges, a range that holds more than a block is dealt out by hash."""
    ranges = min(RANGES, max(1, -(-papers.count() // block_papers)))
    drawn = [c for level in split_levels(papers, "arxiv_id", 16) for c in level]
    cuts = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)})
    ident = F.col("paper_id")
    place = F.aggregate(F.lit(cuts), F.lit(0), lambda acc, c: acc + (c <= ident).cast("int")) if cuts else F.lit(0)
    docs = papers.select(F.col("arxiv_id").alias("paper_id"), F.concat_ws(" ", "title", "abstract").alias("_t"))
    docs = docs.withColumn("_range", place).where(F.col("_range").isNotNull())
    held = dict(docs.groupBy("_range").agg(F.count(F.lit(1))).collect())  # at most RANGES rows
    parts = F.get(F.lit([max(1, -(-held.get(i, 0) // block_papers)) for i in range(ranges)]), F.col("_range"))
    block = (F.lit(int(segment)).cast("long") * (1 << 32) + F.col("_range").cast("long") * (1 << 20)
             + F.pmod(F.xxhash64("paper_id"), parts))
    docs = docs.select(F.lit(int(segment)).cast("long").alias("segment"), "paper_id", block.alias("block"), "_t")
    docs = with_tokens(docs, "_t")
    return docs, postings_of(docs)


def postings_of(docs: DataFrame) -> DataFrame:
    """One row per token and block; a list holds at most the papers of a block, and a
    task holds one block."""
    ship_package(docs.sparkSession)

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.filter(t["paper_id"].is_valid()).sort_by("paper_id").combine_chunks()
        lists, ids = t["tokens"].combine_chunks(), t["paper_id"].combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists, ids = pa.concat_arrays(lists.chunks), pa.concat_arrays(ids.chunks)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        held = ids.take(pa.array(row[np.argsort(code, kind="stable")]))
        n = np.bincount(code, minlength=len(coded.dictionary)).astype(np.int64)
        ends = np.cumsum(n)
        full = lambda x: pa.array(np.full(len(n), x.as_py()), pa.int64())
        out = [full(key[0]), coded.dictionary, full(key[1]), pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), held),
               pa.array(n), held.take(pa.array(ends - n)), held.take(pa.array(ends - 1))]
        del coded, code, row
        give_back()
        return pa.table(dict(zip(("segment", "token", "block", "ids", "n", "first", "last"), out, strict=True)))

    return docs.select("segment", "block", "paper_id", "tokens").groupBy("segment", "block").applyInArrow(run, POSTINGS)


@dataclass
class KeywordIndex:
    """All segments of an index: the two stored tables."""
    papers: DataFrame
    postings: DataFrame

    @staticmethod
    def path(root: str, table: str, segment: int) -> str:
        return f"{root.rstrip('/')}/{table}/segment={int(segment)}"

    @classmethod
    def add(cls, root: str, papers: DataFrame, segment: int, block_papers: int = BLOCK_PAPERS) -> None:
        """Write one batch as a segment of its own; a repeat overwrites itself."""
        spark = papers.sparkSession
        docs, _ = index_batch(papers, segment, block_papers)
        at = cls.path(root, "papers", segment)
        docs.drop("segment").write.mode("overwrite").parquet(at)
        stored = spark.read.parquet(at).withColumn("segment", F.lit(int(segment)).cast("long"))
        postings_of(stored).drop("segment").write.mode("overwrite").parquet(cls.path(root, "postings", segment))

    @classmethod
    def open(cls, spark: SparkSession, root: str, last: int | None = None) -> "KeywordIndex":
        """The segments under ``root``, up to number ``last`` (the last committed one)."""
        def read(name: str, schema: str) -> DataFrame:
            found = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")
            return found if last is None else found.where(F.col("segment") <= int(last))
        return cls(read("papers", PAPERS), read("postings", POSTINGS))

    def live(self, tokens: Column | None = None, only: DataFrame | None = None) -> DataFrame:
        """(paper_id, block, tokens) of each paper in its newest segment; ``tokens``: what
        to read of them instead, ``only``: (paper_id) of those that are looked for."""
        papers = self.papers if only is None else self.papers.join(only, "paper_id", "left_semi")
        papers = papers.select("paper_id", "segment", "block", F.col("tokens") if tokens is None else tokens)
        newest = papers.groupBy("paper_id").agg(F.max("segment").alias("segment"))
        return papers.join(newest, ["paper_id", "segment"], "left_semi").drop("segment")

    def universe(self, vecs: DataFrame) -> DataFrame:
        """(block, ids, most): the sorted ids of a block's live papers that have a
        vector, and the most tokens of one.  Vectors without a paper come in blocks of
        their own, which no posting names."""
        found = vecs.select("paper_id").join(self.live(F.size("tokens").alias("size")), "paper_id", "left")
        lost = found.where(F.col("block").isNull()).agg(F.count(F.lit(1))).scalar()
        spare = F.lit(NO_PAPER) - F.pmod(F.xxhash64("paper_id"), F.ceil(F.greatest(lost, F.lit(1)) / F.lit(BLOCK_PAPERS)))
        return (found.withColumn("block", F.coalesce("block", spare.cast("long"))).groupBy("block")
                .agg(F.array_sort(F.collect_list("paper_id")).alias("ids"), F.coalesce(F.max("size"), F.lit(0)).alias("most")))


def question_tokens(questions: DataFrame) -> DataFrame:
    """(question_id, qblock, tokens); questions are answered ``QUESTION_BLOCK`` at a time."""
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK))
    return questions.select("question_id", F.pmod(F.xxhash64("question_id"), F.lit(blocks)).cast("int").alias("qblock"),
                            tokenize("question").alias("tokens"))


def bounds(index: KeywordIndex, universe: DataFrame, asked: DataFrame) -> DataFrame:
    """(question_id, block, bound) of all blocks with a posting of a token of the
    question; no id list is read."""
    tokens = written(asked.select("question_id", F.explode("tokens").alias("token")), "words")
    named = index.postings.select("token", "block").join(tokens, "token").groupBy("question_id", "block").agg(F.count(F.lit(1)).alias("n"))
    return named.join(universe.select("block", "most"), "block").select("question_id", "block", F.least("n", "most").cast("long").alias("bound"))


class _Overlaps:
    """Overlaps of a block's papers with questions, from the id lists."""

    def __init__(self, left: pa.Table):
        is_list = np.array(left["token"].is_valid())
        names, lists = left["token"].to_pylist(), left["ids"].to_pylist()
        self.ids = np.array(next((lists[i] for i in np.flatnonzero(~is_list)), []), dtype=object).astype(str)
        self.at = {}
        for i in np.flatnonzero(is_list).tolist():
            held = np.array(lists[i], dtype=object).astype(str)
            pos = np.searchsorted(self.ids, held)
            ok = pos < len(self.ids)
            ok[ok] = self.ids[pos[ok]] == held[ok]
            # papers that live in a newer segment or have no vector are not in the block's ids
            self.at[names[i]] = pos[ok]

    def of(self, tokens) -> np.ndarray:
        hit = [self.at[t] for t in tokens if t in self.at]
        return np.bincount(np.concatenate(hit), minlength=len(self.ids)) if hit else np.zeros(len(self.ids), np.int64)


def visit(index: KeywordIndex, universe: DataFrame, asked: DataFrame, pairs: DataFrame, depth: int = 0) -> DataFrame:
    """Read the blocks that ``pairs`` (question_id, block) names.

    ``asked``: (question_id, qblock, tokens[, probes: array of (paper_id, overlap)]).
    Per block and question: the ``depth`` best papers (kind 0: paper_id, overlap,
    value null), and for each probe the number of the block's papers that come before
    it by (overlap descending, id) as value (kind 1)."""
    probes = "probes" in asked.columns
    cells = pairs.join(asked.select("question_id", "qblock"), "question_id").select("question_id", "qblock", "block")
    wanted = cells.select("block", "qblock").distinct()
    words = written(asked.select("qblock", F.explode("tokens").alias("token")).distinct(), "words")
    lists = index.postings.select("token", "block", "ids").join(words, "token").join(wanted, ["block", "qblock"], "left_semi")
    left = lists.select("block", "qblock", "token", "ids").unionByName(
        universe.join(wanted, "block").select("block", "qblock", F.lit(None).cast("string").alias("token"), "ids"))
    # new names: both sides come from the same block numbers
    right = cells.join(asked.drop("qblock"), "question_id").withColumns({"_block": F.col("block") + 0, "_qblock": F.col("qblock") + 0}).drop("block", "qblock")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        over = _Overlaps(left)
        out = ([], [], [], [], [])

        def put(q, kind, ids, overlap, value):
            for col, v in zip(out, (np.full(len(ids), q), np.full(len(ids), kind), ids, overlap, value), strict=True):
                col.append(v)

        for row in right.sort_by("question_id").to_pylist():
            got = over.of(row["tokens"])
            if depth:
                best = _topk_positions(got.astype(np.float64), over.ids, depth)
                put(row["question_id"], 0, over.ids[best], got[best], np.zeros(len(best), np.int64))
            if probes and row["probes"]:
                names = np.array([p["paper_id"] for p in row["probes"]])
                keys = np.array([p["overlap"] for p in row["probes"]], np.float64)
                coder = IdCoder(names)
                n = count_before(got.astype(np.float64), coder.codes(over.ids), keys, coder.codes(names), coder.n_codes)
                put(row["question_id"], 1, names, keys.astype(np.int64), n)
        types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        cols = [pa.array(np.concatenate(c).tolist() if c else [], t) for c, t in zip(out, types, strict=True)]
        return pa.table(dict(zip(("question_id", "kind", "paper_id", "overlap", "value"), cols, strict=True)))

    return left.groupBy("block", "qblock").cogroup(right.groupBy("_block", "_qblock")).applyInArrow(
        run, "question_id long, kind int, paper_id string, overlap long, value long")


def _everywhere(few: DataFrame, universe: DataFrame) -> DataFrame:
    """(question_id, block) of every block, for questions that no bound can stop."""
    salted = universe.select("block", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("_s"))
    return few.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")).join(salted, "_s").select("question_id", "block")


def _within(limits: DataFrame, bound: DataFrame, universe: DataFrame) -> DataFrame:
    """(question_id, block) of the blocks whose bound reaches the question's ``least``."""
    some = bound.join(limits, "question_id").where((F.col("bound") >= F.col("least")) & (F.col("least") > 0)).select("question_id", "block")
    return some.unionByName(_everywhere(limits.where(F.col("least") <= 0), universe))


def seeds(bound: DataFrame, universe: DataFrame, depth: int) -> DataFrame:
    """For each question the blocks of the largest bounds that hold ``depth`` papers."""
    from pyspark.sql import Window
    sized = bound.join(universe.select("block", F.size("ids").alias("_n")), "block")
    w = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("_held", F.coalesce(F.sum("_n").over(w), F.lit(0))).where(F.col("_held") < depth).select("question_id", "block")


def best_by(rows: DataFrame, order: list[Column], depth: int, rank: str) -> DataFrame:
    from pyspark.sql import Window
    w = Window.partitionBy("question_id").orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= depth).withColumn(rank, (F.col(rank) - 1).cast("long"))


def keyword_top(index: KeywordIndex, universe: DataFrame, asked: DataFrame, bound: DataFrame, depth: int,
                store=lambda df, name: df) -> tuple[DataFrame, DataFrame]:
    """((question_id, paper_id, overlap, rank_keyword) of the ``depth`` best papers of
    each question with their exact 0-based ranks, (question_id, block) read).

    First the blocks of the largest bounds are read until they hold ``depth`` papers;
    the overlap of the last of these is what a paper of any other block must reach,
    so blocks with a smaller bound are not read.  ``store`` keeps what is used twice."""
    first = store(seeds(bound, universe, depth), "seeds")
    found = store(visit(index, universe, asked, first, depth), "seed_rows")
    held = best_by(found, [F.desc("overlap"), F.asc("paper_id")], depth, "rank")
    limits = held.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.min("overlap").alias("low"))
    limits = asked.select("question_id").join(limits, "question_id", "left").select(
        "question_id", F.when(F.col("n") >= depth, F.col("low")).otherwise(F.lit(0)).cast("long").alias("least"))
    more = store(_within(limits, bound, universe).join(first, ["question_id", "block"], "left_anti"), "further")
    rows = found.unionByName(visit(index, universe, asked, more, depth))
    top = best_by(rows, [F.desc("overlap"), F.asc("paper_id")], depth, "rank_keyword")
    return top.select("question_id", "paper_id", "overlap", "rank_keyword"), first.unionByName(more)


def keyword_ranks(index: KeywordIndex, universe: DataFrame, asked: DataFrame, bound: DataFrame, wanted: DataFrame,
                  store=lambda df, name: df) -> DataFrame:
    """(question_id, paper_id, overlap, rank_keyword) of the ``wanted``
    (question_id, paper_id): overlaps from the stored tokens, ranks from the blocks
    whose bound reaches the smallest overlap asked for."""
    words = asked.select("question_id", F.col("tokens").alias("_q"))
    wanted = written(wanted.select("question_id", "paper_id"), "wanted")
    held = index.live(only=wanted.select("paper_id")).select("paper_id", "tokens")
    mine = wanted.join(words, "question_id").join(held, "paper_id", "left")
    overlap = F.coalesce(F.size(F.array_intersect("_q", F.coalesce("tokens", F.array().cast("array<string>")))), F.lit(0)).cast("long")
    known = store(mine.select("question_id", "paper_id", overlap.alias("overlap")), "overlaps")
    per = known.groupBy("question_id").agg(F.collect_list(F.struct("paper_id", "overlap")).alias("probes"), F.min("overlap").alias("least"))
    probing = asked.join(per.select("question_id", "probes"), "question_id")
    pairs = _within(per.select("question_id", "least"), bound, universe)
    counts = visit(index, universe, probing, pairs).groupBy("question_id", "paper_id").agg(F.sum("value").alias("rank_keyword"))
    # where no block is read, nothing comes before
    return known.join(counts, ["question_id", "paper_id"], "left").withColumn("rank_keyword", F.coalesce("rank_keyword", F.lit(0)).cast("long"))
