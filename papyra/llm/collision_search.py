"""Approximate nearest neighbours by collision counting on sorted projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._common import tidy
from papyra.llm.vectors import by_length, usable
from papyra.llm.words import U64

WIDTH = 2.72  # of a window over the radius
RADII = 0.6 * 1.07 ** np.arange(19)  # up to 2.03: unit vectors are at most 2 apart
TOGETHER = 32  # queries counted at a time
MOST_TASKS = 50_000  # of one search; beyond it a task takes several cells in turn


def bit_counts(rows: np.ndarray) -> list[np.ndarray]:
    """How many of ``rows`` have each bit set, as bit planes, lowest first.

    Full adders take three rows of bits to a sum and a carry, 64 vectors a word.
    """
    planes = []
    while len(rows):
        carries = []
        while len(rows) > 1:
            t = max(1, len(rows) // 3)
            a, b = rows[:t], rows[t:2 * t]
            half = a ^ b
            if len(rows) == 2:
                rows = half
                carries.append(a & b)
            else:
                c = rows[2 * t:3 * t]
                carries.append((a & b) | (half & c))
                rows = np.concatenate([half ^ c, rows[3 * t:]])
        planes.append(rows[0])
        rows = np.concatenate(carries) if carries else rows[:0]
    return planes


def at_least(planes: list[np.ndarray], need: int) -> np.ndarray:
    """The bits whose count is ``need`` or more."""
    more, same = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in reversed(range(max(len(planes), need.bit_length()))):
        plane = planes[i] if i < len(planes) else np.zeros_like(more)
        if need >> i & 1:
            same &= plane
        else:
            more |= same & plane
            same &= ~plane
    return more | same


class Index:
    """Some vectors, their projections sorted one by one.

    Largest inner product becomes least distance: vectors are scaled by the
    block's largest norm and get a component that fills them up to length 1.
    ``below`` holds, for each sorted projection and each of its edges, one bit a
    vector: whether its place is before the edge.  The vectors of a window are the
    bits that differ between two edges, so windows are counted 64 vectors at a time.
    Edges lie at every place of up to 1024 vectors; of more, a window's ends are moved
    to the nearest edge, by at most half of a 128th of the vectors.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int, slack: float, seed: int):
        if len(ids) > 32_768 or projections > 255:
            raise ValueError("at most 32768 vectors a block and 255 projections")
        self.ids, self.x = ids, x
        norm = np.linalg.norm(x, axis=1)
        self.scale = norm.max()
        rest = np.sqrt(np.maximum(0, 1 - (norm / self.scale) ** 2))
        self.axes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1] + 1, projections))
        values = ((x / self.scale) @ self.axes[:-1] + rest[:, None] * self.axes[-1]).T
        n = len(ids)
        steps = min(n, max(128, (1 << 20) // n))
        edges = np.arange(steps + 1) * n // steps
        self.between = np.empty((projections, steps))  # a value beyond it is nearer to the next edge
        self.below = np.zeros((projections, steps + 1, (n + 63) // 64), U64)
        rank = np.empty(n, np.uint16)
        for j in range(projections):
            order = np.argsort(values[j], kind="stable")
            self.between[j] = values[j, order[(edges[:-1] + edges[1:]) // 2]]
            rank[order] = np.arange(n, dtype=np.uint16)
            bits = np.packbits(rank < edges[:, None].astype(np.uint16), axis=1, bitorder="little")
            self.below[j].view(np.uint8)[:, :bits.shape[1]] = bits
        self.start = 0
        # a vector just at the radius lies in a window with probability p
        p = math.erf(WIDTH / 2 / math.sqrt(2))
        self.need = max(0, math.ceil(projections * p - slack * math.sqrt(projections * p * (1 - p))))

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query, ids, scores, verified) of at most k vectors each, best first.

        Windows of WIDTH radii around the query's projection widen from radius
        to radius (virtual rehashing).  A vector in ``need`` windows is verified:
        its inner product is computed.  The search ends at the first radius that the
        k-th verified distance does not exceed; a block that holds fewer than k
        candidates never ends so, and what is left of it is verified as well.

        Windows of a radius hold those of all smaller ones, so that radius can be sought
        from either side: the walk starts where the queries before ended, up or down, and
        counts at one or two radii instead of all up to the last: a radius below the k-th
        distance found in larger windows cannot be the last.  Queries are counted a few at a time.
        """
        norm = np.linalg.norm(q, axis=1, keepdims=True)
        centre = np.ascontiguousarray(((q / norm) @ self.axes[:-1]).T)
        n, m = len(self.ids), len(centre)
        below = self.below.reshape(-1, self.below.shape[2])
        first = np.arange(m)[:, None] * self.below.shape[1]

        def edges(some: list[int], move: float, side: str) -> np.ndarray:
            return first + np.array([b.searchsorted(c, side) for b, c in zip(self.between, centre[:, some] + move, strict=True)])

        def reached(some: list[int], r: int) -> list[bool]:
            """For each query, whether the k-th distance of those in ``need`` windows is within radius r."""
            reach = RADII[r] * WIDTH / 2
            rows = below[edges(some, -reach, "left")]
            rows ^= below[edges(some, reach, "right")]
            bits = at_least(bit_counts(rows), self.need)
            inside = np.unpackbits(bits.view(np.uint8), axis=1, count=n, bitorder="little").view(bool)
            near = []
            for i, row in zip(some, inside, strict=True):
                found = np.flatnonzero(row & other[i])
                self._verify(q[i], found, known[i], score[i])
                if len(found) >= k:
                    last = np.partition(score[i][found], -k)[-k] / (self.scale * norm[i, 0])
                    distance[i] = math.sqrt(max(0.0, 2 - 2 * last))
                near.append(distance[i] <= RADII[r])
                if near[-1]:
                    ended[i] = r, found
            return near

        for group in np.split(np.arange(len(q)), range(1, len(q), TOGETHER)):
            group = group.tolist()
            other = {i: self.ids != own[i] for i in group}
            known, score = {i: np.zeros(n, bool) for i in group}, {i: np.empty(n) for i in group}
            distance, ended = dict.fromkeys(group, math.inf), {}
            near = reached(group, self.start)
            up, down = [[i for i, x in zip(group, near, strict=True) if x == y] for y in (False, True)]
            for r in range(self.start + 1, len(RADII)):
                if up:
                    up = [i for i, x in zip(up, reached(up, r), strict=True) if not x]
            for r in range(self.start - 1, -1, -1):
                down = [i for i in down if distance[i] <= RADII[r]]
                if down:
                    down = [i for i, x in zip(down, reached(down, r), strict=True) if x]
            for i in up:
                ended[i] = len(RADII) - 1, np.flatnonzero(other[i])
                self._verify(q[i], ended[i][1], known[i], score[i])
            self.start = int(np.median([ended[i][0] for i in group]))
            for i in group:
                found = ended[i][1]
                best = found[np.lexsort((self.ids[found], -score[i][found]))[:k]]
                yield i, self.ids[best], score[i][best], int(known[i].sum())

    def _verify(self, q, found, known, score):
        new = found[~known[found]]
        known[new] = True
        score[new] = (self.x[new] * q).sum(axis=1)


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, projections: int = 200, slack: float = 0.3, block: int = 8192,
            query_block: int = 16_384, seed: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for
    every row whose id is divisible by ``every``, among all other rows.

    Vectors and queries are dealt into blocks by hash; a cell is a block of either.
    A cell's rows come to its task sorted, vectors first: the task builds the index
    once and answers the queries batch by batch, so it holds one block of vectors and
    one batch of queries at any size of the table, and building is a small part of
    ``query_block`` searches.  A query gets at most ``k`` rows from each block.  A
    vector at the final radius is in enough windows with the probability that a normal
    variable exceeds ``-slack``, a nearer one with more; nothing limits how many are
    verified.

    Defined cases: null or zero vectors, vectors with null or non-finite
    components and rows with a null id take no part; a query's own row is every
    row with its id; only vectors of the query's length are candidates; ties go
    to the smaller id; fewer candidates than ``k`` are all returned; other columns
    are not read; an empty table gives an empty one.
    """
    good = vectors.select(F.col(id_col).cast("long").alias("__id"), F.col(vector_col).alias("__v")).where(
        F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    is_query = F.pmod("__id", F.lit(every)) == 0
    total, asked = good.agg(F.count("*"), F.count_if(is_query)).first()
    nb, nq = max(1, math.ceil(total / block)), max(1, math.ceil(asked / query_block))
    tasks = min(nb * nq, MOST_TASKS)
    spot, other = F.xxhash64("__id", "__v"), F.xxhash64(F.lit("q"), "__id", "__v")

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    data = good.withColumn("__b", F.pmod(spot, F.lit(nb))).withColumn("__q", numbers(nq)).withColumn("__tag", F.lit(0))
    queries = good.where(is_query).withColumn("__q", F.pmod(other, F.lit(nq))).withColumn("__b", numbers(nb)).withColumn("__tag", F.lit(1))
    cells = data.unionByName(queries).select((F.col("__b") * nq + F.col("__q")).alias("__cell"), "__tag", "__id", "__v")
    cells = cells.repartitionById(tasks, F.pmod("__cell", F.lit(tasks)).cast("int")).sortWithinPartitions("__cell", "__tag")

    @tidy
    def run(batches):
        cell, parts, index = None, [], {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            key, tag = batch["__cell"].to_numpy(), batch["__tag"].to_numpy()
            cut = np.flatnonzero((np.diff(key) != 0) | (np.diff(tag) != 0)) + 1
            for a, b in zip([0, *cut], [*cut, len(key)], strict=True):
                if b == a:
                    continue
                if key[a] != cell:
                    cell, parts, index = key[a], [], {}
                piece = table.slice(a, b - a)
                if tag[a] == 0:
                    parts.append(piece)
                    continue
                if parts:
                    whole = pa.concat_tables(parts).sort_by("__id")
                    ids = whole["__id"].to_numpy()
                    index = {x.shape[1]: Index(ids[rows], x, projections, slack, seed) for rows, x in by_length(whole["__v"])}
                    parts = []
                own = piece["__id"].to_numpy()
                for rows, q in by_length(piece["__v"]):
                    for some in np.array_split(np.arange(len(rows)), math.ceil(len(rows) / 256)) if q.shape[1] in index else ():
                        for i, ids, scores, _ in index[q.shape[1]].search(q[some], own[rows[some]], k):
                            yield pa.RecordBatch.from_arrays(
                                [np.full(len(ids), own[rows[some[i]]]), ids, scores], ["query_id", "vec_id", "score"])

    found = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.distinct()  # rows that repeat an id ask and answer alike
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
