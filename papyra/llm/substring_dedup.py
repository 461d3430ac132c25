"""Substring dedup: remove word passages that occurred earlier in the corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from papyra.llm.chunks import MESSAGE_SQL, answer, ask, bucket_keys, by_bucket, chunked, messages, read
from papyra.llm.words import U64, as_texts, mix64, powers, slices, split_words, word_hashes

RESULT = "long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, text string"
NO_ID = np.iinfo(np.int64).max


class ChunkWords:
    """The words of a chunk: hashes, row and position in the row of each."""

    def __init__(self, column):
        hashes, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for _, texts in slices(as_texts(column)):
            w = split_words(texts)
            hashes.append(word_hashes(w))
            counts.append(w.count)
        self.hash, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count
        self.row = np.repeat(np.arange(len(self.count)), self.count)
        self.pos = np.arange(len(self.hash)) - self.first[self.row]


class RunHashes:
    """Hashes of runs of words of one length, from prefix sums over all words."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(h * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, True)

    def every(self, k: int) -> np.ndarray:
        """The hash of the run of k words from each word on, over the ends of rows too."""
        return (self.sums[k:] - self.sums[:len(self.sums) - k]) * self.back[:max(0, len(self.sums) - k)]

    def at(self, first: np.ndarray, k: int) -> np.ndarray:
        return mix64((self.sums[first + k] - self.sums[first]) * self.back[first])


def sliding(best: np.ufunc, x: np.ndarray, k: int) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every k consecutive entries."""
    width = 1
    while 2 * width <= k:
        x, width = best(x[:-width], x[width:]), 2 * width
    return best(x[:len(x) - (k - width)], x[k - width:]) if k > width else x


class Marks:
    """The marks of a chunk: in each window, its run of ``block`` words of the smallest hash.

    Equal windows have equal marks at the same offset.  Neighbours mostly share theirs,
    so few of the runs are marks.
    """

    def __init__(self, w: ChunkWords, window: int, block: int, n: int):
        empty = np.zeros(0, np.int64)
        self.window, self.span = empty, window - block + 1
        self.key, self.count, self.place = empty.astype(U64), empty, empty
        if len(w.hash) < window:
            return
        self.runs = RunHashes(w.hash).every(block)
        self.least = sliding(np.minimum, self.runs, self.span)
        whole = w.row[:len(self.least)] == w.row[window - 1:]
        pad = np.zeros(self.span - 1, U64)
        cover = sliding(np.maximum, np.concatenate([pad, np.where(whole, self.least, U64(0)), pad]), self.span)
        self.at = np.flatnonzero(cover == self.runs)
        self.window = np.flatnonzero(whole)
        self.key, self.place, self.count = np.unique(bucket_keys(mix64(self.runs[self.at]), n), return_inverse=True, return_counts=True)

    def windows(self, hit: np.ndarray) -> np.ndarray:
        """First words of the windows whose mark is hit; ``hit`` holds one entry a key."""
        at = self.at[hit[self.place]] if len(self.window) else self.window
        if not len(at):
            return at
        runs = np.full(len(self.runs), ~U64(0))
        runs[at] = self.runs[at]
        return self.window[(sliding(np.minimum, runs, self.span) == self.least)[self.window]]


def drop_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without the words covered by a window of ``window``
    words that also starts earlier (smaller id, or same id and earlier start).

    Returns id, n_words, n_removed, the removed word ranges ``spans`` (maximal, in
    input positions, end exclusive) and ``text``, the kept words joined by a space.

    1. The mark of a window is its run of ``window // 2`` words of the smallest
       hash (winnowing).  Marks are counted by place; a repeated window's mark is
       found at two places or more, so only windows of such marks stay.
    2. Of each distinct window that stays (96-bit hash) a chunk sends its first
       position, the smallest one of all chunks stays and all others go.
       Overlapping removed windows join to maximal spans.
    Neither step makes pairs: a passage of any number of documents is one key per
    chunk.

    Defined cases: null and empty texts have no words and give an empty text;
    fewer than ``window`` words lose nothing; positions are (id, start), so rows
    equal in id and text give equal results and do not remove each other; a null
    id comes after all others; other columns are not read; an empty table gives
    an empty one.
    """
    block = max(1, window // 2)
    base, n = chunked(docs, id_col, text_col)

    def ask_marks(chunk: int, t: pa.Table):
        marks = Marks(ChunkWords(t["__text"]), window, block, n)
        out = []
        for b, i, j in by_bucket(marks.key, n):
            data = (np.array([j - i], np.uint32).tobytes() + (marks.key[i:j] & U64(0xFFFFFFFF)).astype(np.uint32).tobytes()
                    + np.packbits(marks.count[i:j] > 1).tobytes())
            out.append((b, chunk, 0, data))
        return out

    def find_hits(bucket: int, got: list[tuple[int, bytes]]):
        keys, many = [], []
        for _, data in got:
            m = int(np.frombuffer(data, np.uint32, 1)[0])
            keys.append(np.frombuffer(data, np.uint32, m, 4))
            many.append(np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + 4 * m), count=m))
        _, inv, seen = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        hit = (seen[inv] > 1) | np.concatenate(many).view(bool)
        ends = np.cumsum([len(x) for x in keys])
        return [(bucket, chunk, 0, np.packbits(part).tobytes())
                for (chunk, _), part in zip(got, np.split(hit, ends[:-1]), strict=True)]

    def bits(data: bytes, keys: np.ndarray) -> np.ndarray:
        """Answers to sorted bucket keys: each bucket's bits start at a byte."""
        raw, out, at = np.frombuffer(data, np.uint8), np.zeros(len(keys), bool), 0
        for _, i, j in by_bucket(keys, n):
            size = (j - i + 7) // 8
            out[i:j] = np.unpackbits(raw[at:at + size], count=j - i)
            at += size
        return out

    def candidates(w: ChunkWords, t: pa.Table, data: bytes):
        """Windows whose mark is hit, in order of their hash: hash, second hash, index of the
        first word, (id, start), and whether one is the first of its hashes."""
        marks = Marks(w, window, block, n)
        first = marks.windows(bits(data, marks.key))
        del marks
        h = RunHashes(w.hash).at(first, window)
        second = (RunHashes(mix64(w.hash ^ U64(0x5BD1E995))).at(first, window) >> U64(32)).astype(np.uint32)
        ids = t["__id"].fill_null(NO_ID).to_numpy()
        doc, start = ids[w.row[first]], w.pos[first]
        order = np.lexsort((start, doc, second, h))  # buckets are ranges of the hash
        h, second, first, doc, start = h[order], second[order], first[order], doc[order], start[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
        return h, second, first, doc, start, new

    def ask_windows(chunk: int, t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        h, second, _, doc, start, new = candidates(ChunkWords(t["__text"]), t, answers.get(0, b""))
        h, second, doc, start = h[new], second[new], doc[new], start[new]
        bucket = (bucket_keys(h, n) >> U64(32)).astype(np.int64)
        rows = []
        at = np.searchsorted(bucket, np.arange(n + 1))
        for b in np.flatnonzero(at[1:] > at[:-1]):
            i, j = at[b], at[b + 1]
            data = b"".join([np.array([j - i], np.int64).tobytes(), h[i:j].tobytes(), doc[i:j].astype(np.int64).tobytes(),
                             start[i:j].astype(np.int32).tobytes(), second[i:j].tobytes()])
            rows.append((int(b), chunk, 1, data))
        return messages(rows)

    def find_first(bucket: int, got: list[tuple[int, bytes]]):
        cols = [[], [], [], []]
        sizes = []
        for _, data in got:
            m = int(np.frombuffer(data, np.int64, 1)[0])
            sizes.append(m)
            at = 8
            for col, kind in zip(cols, (np.uint64, np.int64, np.int32, np.uint32), strict=True):
                col.append(np.frombuffer(data, kind, m, at))
                at += m * np.dtype(kind).itemsize
        h, doc, start, second = (np.concatenate(c) for c in cols)
        order = np.lexsort((start, doc, second, h))
        new = np.ones(len(h), bool)
        hs, ss = h[order], second[order]
        new[1:] = (hs[1:] != hs[:-1]) | (ss[1:] != ss[:-1])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each, the first one of its window
        later = np.empty(len(h), bool)
        later[order] = (doc[order] != doc[lead]) | (start[order] != start[lead])
        return [(bucket, chunk, 1, np.packbits(part).tobytes())
                for (chunk, _), part in zip(got, np.split(later, np.cumsum(sizes)[:-1]), strict=True)]

    def remove(chunk: int, t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        w = ChunkWords(t["__text"])
        h, _, first, doc, start, new = candidates(w, t, answers.get(0, b""))
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        gone = np.zeros(len(at), bool)
        raw, i, p = np.frombuffer(answers.get(1, b""), np.uint8), 0, 0
        if len(at):
            edges = np.searchsorted(bucket_keys(h[at], n) >> U64(32), np.arange(n + 1, dtype=np.uint64))
            for b in np.flatnonzero(edges[1:] > edges[:-1]):
                i, m = edges[b], edges[b + 1] - edges[b]
                gone[i:i + m] = np.unpackbits(raw[p:p + (m + 7) // 8], count=m)
                p += (m + 7) // 8
        dup = gone[group] | (doc != doc[at][group]) | (start != start[at][group]) if len(at) else np.zeros(0, bool)
        cover = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(cover, first[dup], 1)
        np.add.at(cover, first[dup] + window, -1)
        covered = np.cumsum(cover)[:-1] > 0
        sums = np.concatenate([[0], np.cumsum(covered)])
        removed = sums[w.first + w.count] - sums[w.first]
        kept, spans = [], []
        for row, text in enumerate(as_texts(t["__text"])):
            words = text.as_buffer().to_pybytes().split()
            if removed[row]:
                mask = covered[w.first[row]:w.first[row] + w.count[row]]
                words = [x for x, y in zip(words, mask.tolist(), strict=True) if not y]
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            else:
                spans.append([])
            kept.append(b" ".join(words))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({id_col: t["__id"], "n_words": w.count.astype(np.int64), "n_removed": removed.astype(np.int64),
                         "spans": pa.array(spans, kind), "text": pa.array(kept, pa.binary()).cast(pa.string())})

    hits = answer(ask(base, ask_marks), find_hits)
    firsts = answer(read(base, hits, ask_windows, MESSAGE_SQL), find_first)
    return read(base, hits.unionByName(firsts), remove, f"`{id_col}` {RESULT}")
