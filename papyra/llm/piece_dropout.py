"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import heapq
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import tidy
from papyra.llm.words import SLICE_BYTES, STEP, U64, as_texts, mix64, slices

SPACE = "▁"
EMPTY = np.int64(-1)
NONE = np.int64(1) << 62
LONG = 48
MASK = (1 << 64) - 1
#: Segments, and occurrences, that are worked on at a time.
ROWS = 1 << 14


class Pieces:
    """The merges of a BPE model in a hash table, and the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        byte = [m.is_byte(i) for i in range(n)]
        control = [m.is_control(i) or m.is_unknown(i) for i in range(n)]
        self.unknown, self.base = n, n + 1
        plain = {p: i for i, p in enumerate(names) if not byte[i] and not control[i]}
        self.byte_ids = np.full(256, m.unk_id(), np.int32)
        for i, p in enumerate(names):
            if byte[i]:
                self.byte_ids[int(p[3:5], 16)] = i
        # a space is its own sign; the sign itself, written in a text, is spelled in bytes
        self.of_char = np.full(0x110000, self.unknown, np.int32)
        for p, i in plain.items():
            if len(p) == 1 and p != SPACE:
                self.of_char[ord(p)] = i
        self.of_char[0x20] = plain.get(SPACE, self.unknown)
        scores = {i: m.get_score(i) for i in plain.values()}
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.zeros(n, np.int64)
        for i, s in scores.items():
            self.rank[i] = place[s]
        self.merges = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                left, right = plain.get(p[:cut]), plain.get(p[cut:])
                if left is not None and right is not None:
                    self.merges[left * self.base + right] = i
        self.bits = max(4, (4 * len(self.merges)).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.zeros(1 << self.bits, np.int64)
        pairs = np.array(list(self.merges), np.int64)
        for key, slot in zip(self.merges, self.slot(pairs).tolist(), strict=True):
            while self.keys[slot] != EMPTY:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.values[slot] = key, self.merges[key]
        raw = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if control[i] else p.replace(SPACE, " ").encode()
               for i, p in enumerate(names)]
        self.size = np.array([len(x) for x in raw], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or -1."""
        key = left * self.base + right
        out = np.full(len(key), EMPTY)
        open_, slot = np.arange(len(key)), self.slot(key)
        while len(open_):
            found = self.keys[slot]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (found != EMPTY)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def skipped(key: np.ndarray, start: np.ndarray, piece: np.ndarray, cut: np.uint64) -> np.ndarray:
    """Whether the keyed hash of a candidate (where it starts, what it makes) skips it."""
    return mix64(key + (start.astype(U64) << U64(32)) + piece.astype(U64) * U64(0xD6E8FEB86659FD93)) < cut


def skipped_one(key: int, start: int, piece: int, cut: int) -> bool:
    """``skipped`` of one candidate, in plain integers."""
    x = (key + (start << 32) + piece * 0xD6E8FEB86659FD93) & MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31) < cut


def merge_one(p: Pieces, sym: list[int], key: int, cut: int) -> list[tuple[int, int]]:
    """(piece, start) of one segment, by an agenda of candidates, best rank and
    then leftmost first."""
    n = len(sym)
    sym, nxt, prv, alive = list(sym), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    agenda: list[tuple[int, int, int, int, int]] = []

    def propose(a: int) -> None:
        b = nxt[a]
        made = p.merges.get(sym[a] * p.base + sym[b]) if b < n else None
        if made is not None:
            heapq.heappush(agenda, (int(p.rank[made]), a, sym[a], sym[b], made))

    for i in range(n - 1):
        propose(i)
    while agenda:
        _, a, left, right, made = heapq.heappop(agenda)
        b = nxt[a]
        if not alive[a] or sym[a] != left or b >= n or sym[b] != right:
            continue
        if cut and skipped_one(key, a, made, cut):
            continue
        sym[a], alive[b], nxt[a] = made, False, nxt[b]
        if nxt[b] < n:
            prv[nxt[b]] = a
        if prv[a] >= 0:
            propose(prv[a])
        propose(a)
    return [(sym[i], i) for i in range(n) if alive[i]]


def merge_all(p: Pieces, sym: np.ndarray, seg: np.ndarray, start: np.ndarray, banned: np.ndarray):
    """(piece, segment, start) of many short segments, and the same of the merges
    made, in their order: each round carries out the agenda's first candidate of
    every segment that has one.  ``banned`` has the sorted codes of candidates
    that are passed over."""
    done, made_ = [], []
    while len(sym):
        inside = seg[1:] == seg[:-1]
        order = np.full(len(sym), NONE)
        at = np.flatnonzero(inside)
        made = p.merged(sym[at], sym[at + 1])
        ok = made >= 0
        if len(banned):
            code = (seg[at[ok]] * LONG + start[at[ok]]) * p.base + made[ok]
            ok[ok] = banned[np.minimum(np.searchsorted(banned, code), len(banned) - 1)] != code
        order[at[ok]] = (p.rank[made[ok]] << 32) | at[ok]
        result = np.zeros(len(sym), np.int64)
        result[at] = made
        first = np.flatnonzero(np.concatenate([[True], ~inside]))
        best = np.minimum.reduceat(order, first)
        over = np.repeat(best == NONE, np.diff(np.append(first, len(sym))))
        done.append((sym[over], seg[over], start[over]))
        pick = best[best != NONE] & 0xFFFFFFFF
        made_.append((result[pick], seg[pick], start[pick]))
        sym = sym.copy()
        sym[pick] = result[pick]
        keep = ~over
        keep[pick + 1] = False
        sym, seg, start = sym[keep], seg[keep], start[keep]
    none = np.zeros(0, np.int64)
    return tuple(tuple(np.concatenate([none, *x]) for x in zip(*rows, strict=True)) if rows else (none, none, none) for rows in (done, made_))


def spelled(p: Pieces, out: np.ndarray, where: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, row) with the signs that no piece has spelled in bytes."""
    unknown = np.flatnonzero(out == p.unknown)
    if len(unknown):
        some = [p.byte_ids[list(chr(c).encode())] for c in sign[unknown].tolist()]
        many = np.ones(len(out), np.int64)
        many[unknown] = [len(x) for x in some]
        wide = np.repeat(out, many)
        wide[np.repeat(out == p.unknown, many)] = np.concatenate(some)
        out, where = wide, np.repeat(where, many)
    return out.astype(np.int32), where


def encode_drawn(p: Pieces, names: list[str], index: np.ndarray, keys: np.ndarray, cut: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their count) of the occurrences ``index`` of the segments ``names``
    (spaces, then other signs), each drawn by its own key.

    An occurrence follows the merges of its segment up to the first that its key
    skips, and from there those of the segment with that candidate banned, and so
    on.  The merges of a segment with some banned are the same for all that get
    there, so they are made once; the draws are never shared.  Segments longer
    than LONG are merged one by one.
    """
    chars = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32)
    size = np.array([len(x) for x in names], np.int64)
    first = np.cumsum(size) - size
    tables, sizes, known = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
    ends_at = np.zeros(len(index), np.int64)  # the known segmentation of each occurrence
    long: dict[tuple[int, int], int] = {}
    for o in np.flatnonzero(size[index] > LONG).tolist():
        i, key = int(index[o]), int(keys[o]) if cut else 0
        if (i, key) not in long:
            c = chars[first[i]:first[i] + size[i]]
            got = merge_one(p, p.of_char[c].tolist(), key, int(cut))
            ids, _ = spelled(p, np.array([a for a, _ in got]), np.zeros(len(got), np.int64), c[[b for _, b in got]])
            tables.append(ids)
            sizes.append(np.array([len(ids)]))
            long[i, key] = known
            known += 1
        ends_at[o] = long[i, key]
    name = np.flatnonzero(size <= LONG)
    at = np.flatnonzero(size[index] <= LONG)
    here = np.searchsorted(name, index[at])
    banned, tried = np.zeros((len(name), 0), np.int64), np.zeros(len(name), np.int64)
    while len(at):
        path, length = [], []
        for a in range(0, len(name), ROWS):
            some = name[a:a + ROWS]
            seg = np.repeat(np.arange(len(some)), size[some])
            start = np.arange(len(seg)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            sign = chars[first[some][seg] + start]
            codes = np.sort((np.arange(len(some))[:, None] * (LONG * p.base) + banned[a:a + ROWS]).ravel())
            (out, where, begin), made = merge_all(p, p.of_char[sign].astype(np.int64), seg, start, codes)
            order = np.lexsort((begin, where))
            out, where, begin = out[order], where[order], begin[order]
            ids, where = spelled(p, out, where, chars[first[some][where] + begin])
            tables.append(ids)
            sizes.append(np.bincount(where, minlength=len(some)))
            order = np.argsort(made[1], kind="stable")
            path.append((made[2] * p.base + made[0])[order])
            length.append(np.bincount(made[1], minlength=len(some)))
        path, length = np.concatenate(path), np.concatenate(length)
        begins = np.cumsum(length) - length
        stop = np.full(len(at), EMPTY)
        for a in range(0, len(at) if cut else 0, ROWS):
            h = here[a:a + ROWS]
            n = length[h] - tried[h]
            row = np.repeat(np.arange(len(h)), n)
            step = np.arange(len(row)) + np.repeat(begins[h] + tried[h] - (np.cumsum(n) - n), n)
            start, made = np.divmod(path[step], p.base)
            hit = np.flatnonzero(skipped(keys[at[a:a + ROWS]][row], start, made, cut))
            hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
            stop[a + row[hit]] = step[hit]
        on = stop >= 0
        ends_at[at[~on]] = known + here[~on]
        known += len(name)
        new = np.zeros(len(path), bool)
        new[stop[on]] = True
        step = np.flatnonzero(new)
        parent = np.repeat(np.arange(len(name)), length)[step]
        at, here = at[on], (np.cumsum(new) - 1)[stop[on]]
        name, banned = name[parent], np.concatenate([banned[parent], path[step][:, None]], axis=1)
        tried = step - begins[parent]
    table, count = np.concatenate(tables), np.concatenate(sizes)
    n = count[ends_at]
    ends = np.cumsum(n)
    return table[np.repeat((np.cumsum(count) - count)[ends_at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], n


def encode_segments(p: Pieces, names: list[str], salt: int, cut: np.uint64) -> list[np.ndarray]:
    """Ids of each segment, all drawn by one key."""
    ids, n = encode_drawn(p, names, np.arange(len(names)), np.full(len(names), salt, U64), cut)
    return np.split(ids, np.cumsum(n)[:-1])


SEGMENT = re.compile(" *[^ ]*")


def encode_texts(p: Pieces, texts: pa.Array, salt, cut: np.uint64) -> list[np.ndarray]:
    """Ids of whole texts; ``salt`` is one number or one per text.  The key of a
    segment's occurrence is made of its text's salt and its place in the text."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
    double = pc.match_substring(spaced, "  ").to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(texts, " ")
    count = pc.list_value_length(parts).to_numpy().copy()
    flat = parts.flatten()
    flat = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), flat, pa.scalar("", pa.large_string()))
    if double.any():  # runs of spaces go with what follows them
        rows, out, at = flat.to_pylist(), [], 0
        for i, n in enumerate(count.tolist()):
            if double[i]:
                some = [x for x in SEGMENT.findall(" " + texts[i].as_py()) if x]
                out.extend(some)
                count[i] = len(some)
            else:
                out.extend(rows[at:at + n])
            at += n
        flat = pa.array(out, pa.large_string())
    coded = pc.dictionary_encode(flat)
    names = coded.dictionary.to_pylist()
    if not names:
        return [np.zeros(0, np.int32)] * len(texts)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    keys = mix64(np.repeat(np.broadcast_to(np.asarray(salt, U64), len(count)), count) + place.astype(U64) * U64(STEP))
    out, n = encode_drawn(p, names, coded.indices.to_numpy().astype(np.int64), keys, cut)
    edge = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])]
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    return [out[a:b] if not e else out[:0] for a, b, e in zip(edge[:-1], edge[1:], empty.tolist(), strict=True)]


def decode_ids(p: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, lengths) of the texts of consecutive id lists; the space that
    encoding puts first is taken off."""
    n = p.size[ids]
    ends = np.cumsum(n)
    data = p.bytes[np.repeat(p.at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
    lengths = np.diff(edge)
    full = edge[:-1][lengths > 0]
    keep = np.ones(len(data), bool)
    keep[full[data[full] == 32]] = False
    lengths[lengths > 0] -= data[full] == 32
    return data[keep], lengths


def encode(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 0, copy_col: str | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row's whole text.

    Merges follow an agenda, best score first; each candidate is skipped if the
    keyed hash of the row, the segment's place in the text, the candidate's place
    in the segment and its piece falls under ``dropout`` (0: the model's own
    segmentation).  The row's key hashes seed, id, text and, if named, ``copy_col``:
    every occurrence of a word is drawn anew, within a text and in every copy.
    There is no shuffle, and a lost task gives the same ids again.

    Defined cases: null and empty texts give no ids; signs without a piece, and
    the space sign itself, are spelled in bytes, so decoding restores every text;
    rows equal in id, text and ``copy_col`` get equal ids; null ids are kept;
    other columns are not read.
    """
    cut = U64(min(int(dropout * 2**64), 2**64 - 1)) if dropout > 0 else U64(0)

    def run(batches):
        p = pieces(model)
        for batch in batches:
            texts, salt = as_texts(batch["__text"]), batch["__salt"].to_numpy().view(U64)
            for at, some in slices(texts, SLICE_BYTES // 4):
                out = encode_texts(p, some, salt[at:at + len(some)], cut)
                for i in range(0, len(out), 512):
                    few = out[i:i + 512]
                    offsets = np.concatenate([[0], np.cumsum([len(x) for x in few])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch["__id"].slice(at + i, len(few)),
                                                      pa.ListArray.from_arrays(offsets, np.concatenate(few))], [id_col, "ids"])

    salt = F.xxhash64(F.lit(seed), id_col, text_col, *[copy_col] * (copy_col is not None))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"), salt.alias("__salt"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, ids array<int>")


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text, n_tokens, ids_crc32) from ids of any segmentation."""
    def run(batches):
        p = pieces(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                few = batch.slice(at, 512)
                lists = few["__ids"].fill_null([]) if few["__ids"].null_count else few["__ids"]
                count = pc.list_value_length(lists).to_numpy()
                ids = lists.flatten().to_numpy()
                data, lengths = decode_ids(p, ids, count)
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
                text = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])
                ends = np.cumsum(count)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([few["__id"], text.cast(pa.string()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                                                 [id_col, "text", "n_tokens", "ids_crc32"])

    rows = coded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, text string, n_tokens long, ids_crc32 long")
