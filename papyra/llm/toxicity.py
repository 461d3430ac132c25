"""Toxicity by a weighted finite-state pattern grammar over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import tidy, written
from papyra.llm.labelled import sample
from papyra.llm.words import STEP, U64, as_texts, bounds, mix64, powers, slices, text_bytes

# Words of the grammar's classes (English, German, French, Spanish).
TARGET = """you your yours yourself he she they them him her his their people those
du dich dir dein deine ihr euch sie tu te toi vous votre ton ta usted ustedes tú ti tus""".split()
THREAT = """kill hurt destroy beat shoot stab burn hang crush punish töten schlagen vernichten
verletzen tuer frapper détruire brûler matar golpear destruir quemar""".split()
NEGATION = "not no never neither nor without nicht kein keine nie ohne pas jamais sans aucun nunca sin ningún".split()
REPORTED = """said says say told wrote writes quoted quotes called reported claims claimed sagte sagt schrieb
nannte dit écrit déclaré dijo dice escribió llamó""".split()

SLICE = 256 << 10  # a slice's arrays take some hundred bytes a word
SEEN_BYTES = 4 << 20  # of clauses whose parse is kept
PREFIXES = (4, 5, 6, 7, 8)
LABELS = ("plain", "targeted", "threat", "negated", "reported")


class Fst(NamedTuple):
    """A sequential transducer: one arc per state and symbol ('*': any other,
    copied), and an output at the end for each state."""

    arcs: dict
    final: dict
    start: object

    def step(self, state, symbol: str):
        nxt, out = self.arcs.get((state, symbol)) or self.arcs[state, "*"]
        return nxt, symbol if out == "*" else out


def compose(a: Fst, b: Fst, symbols: str) -> Fst:
    """b after a: states are pairs, reached from the start by the input symbols."""
    arcs, final, todo, seen = {}, {}, [(a.start, b.start)], set()
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        final[state] = b.final[state[1]]
        for s in symbols:
            sa, mid = a.step(state[0], s)
            sb, out = b.step(state[1], mid)
            arcs[state, s] = ((sa, sb), out)
            todo.append((sa, sb))
    return Fst(arcs, final, (a.start, b.start))


def negation(reach: int = 3) -> Fst:
    """Insults (i) and threats (h) within ``reach`` words after a negation become I and H."""
    arcs = {}
    for d in range(reach + 1):
        on = max(0, d - 1)
        arcs |= {(d, "n"): (reach, "n"), (d, "*"): (on, "*")}
        if d:
            arcs |= {(d, "i"): (on, "I"), (d, "h"): (on, "H")}
    return Fst(arcs, dict.fromkeys(range(reach + 1), ""), 0)


def reported_speech() -> Fst:
    """What follows a verb of speech in its clause is reported: i and I become q, threats vanish."""
    arcs = {(0, "r"): (1, "r"), (0, "*"): (0, "*"), (1, "*"): (1, "*"), (1, "i"): (1, "q"), (1, "I"): (1, "q"),
            (1, "h"): (1, "o"), (1, "H"): (1, "o")}
    return Fst(arcs, {0: "", 1: ""}, 0)


def clause() -> Fst:
    """Collects a clause's parts; the end names it: threat at a target, insult at
    a target, bare insult, or nothing."""
    arcs, final = {}, {}
    for s in range(8):  # bits: target 1, insult 2, threat 4
        arcs |= {(s, "*"): (s, "*"), (s, "t"): (s | 1, "t"), (s, "i"): (s | 2, "i"), (s, "h"): (s | 4, "h")}
        final[s] = "threat" if s & 5 == 5 else "targeted" if s & 3 == 3 else "plain" if s & 2 else ""
    return Fst(arcs, final, 0)


def grammar() -> Fst:
    return compose(compose(negation(), reported_speech(), "oihtnr"), clause(), "oihtnr")


class Tokens(NamedTuple):
    doc: np.ndarray
    clause: np.ndarray
    patterns: list  # per pattern length, the last one for whole words: hashes, 0 where the word is shorter
    count: np.ndarray


IS_LETTER = np.zeros(256, bool)
IS_LETTER[97:123] = True
IS_LETTER[128:] = True
IS_END = np.zeros(256, bool)
IS_END[[10, 33, 46, 59, 63]] = True
IS_GAP = np.zeros(256, bool)
IS_GAP[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: pa.Array) -> Tokens:
    """Letters of each word, lower-cased; signs and digits inside a word are skipped."""
    buf, off = text_bytes(pc.utf8_lower(texts))
    keep = IS_LETTER[buf] | IS_GAP[buf]
    at = np.flatnonzero(keep)
    kept = np.concatenate([[0], np.cumsum(keep)])
    w = bounds(buf[at], kept[off])
    ends = np.cumsum(IS_END[buf])
    clause_ = ends[at[w.start]] if len(w.start) else w.start
    n = len(w.buf)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((w.buf.astype(U64) + U64(1)) * powers(n), out=sums[1:])
    inv = powers(n + 1, True)[w.start]
    size = w.end - w.start
    patterns = []
    for k in PREFIXES:
        long = size >= k
        h = np.zeros(len(size), U64)
        s = w.start[long]
        h[long] = mix64((sums[s + k] - sums[s]) * inv[long] ^ U64(k))
        patterns.append(h)
    patterns.append(mix64(((sums[w.end] - sums[w.start]) * inv) ^ (size.astype(U64) * U64(STEP))))
    return Tokens(w.doc, clause_, patterns, w.count)


def word_set(words: list[str]) -> np.ndarray:
    return np.sort(tokens(pa.array([" ".join(words)], pa.large_string())).patterns[-1])


class Model(NamedTuple):
    hashes: np.ndarray  # sorted; prefixes and whole words
    weights: np.ndarray  # log odds, 0: known as harmless
    coef: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


N_FEATURES = 2 * len(LABELS) + 4


def features(texts: pa.Array, hashes: np.ndarray, weights: np.ndarray, seen: dict, fst: Fst, sets: list) -> np.ndarray:
    """Per row: for each label log(1 + weight) and the number of matched clauses,
    then the largest weight, the weight per word, words and 1."""
    t = tokens(texts)
    mark = np.zeros(1 << 16, bool)
    mark[(hashes & U64(0xFFFF)).astype(np.int64)] = True
    weight = np.zeros(len(t.doc))
    for h in t.patterns:  # the longest known pattern decides
        may = np.flatnonzero(mark[(h & U64(0xFFFF)).astype(np.int64)])
        if len(may) and len(hashes):
            pos = np.minimum(np.searchsorted(hashes, h[may]), len(hashes) - 1)
            ok = hashes[pos] == h[may]
            weight[may[ok]] = weights[pos[ok]]
    symbol = np.full(len(t.doc), ord("o"), np.uint8)
    for code, group in zip("tnrh", sets, strict=True):
        symbol[np.isin(t.patterns[-1], group)] = ord(code)
    symbol[weight > 0] = ord("i")

    out = np.zeros((len(texts), N_FEATURES))
    if len(t.doc):
        new = np.ones(len(t.doc), bool)
        new[1:] = (t.doc[1:] != t.doc[:-1]) | (t.clause[1:] != t.clause[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(t.doc))
        hot = np.add.reduceat(((symbol == ord("i")) | (symbol == ord("h"))).astype(np.int64), first) > 0
        text = symbol.tobytes()
        for a, b in zip(first[hot].tolist(), last[hot].tolist(), strict=True):
            got = seen.get(text[a:b])
            if got is None:
                state, outs = fst.start, []
                for s in text[a:b].decode():
                    state, o = fst.step(state, s)
                    outs.append(o)
                got = (LABELS.index(fst.final[state]) if fst.final[state] else -1,
                       [i for i, o in enumerate(outs) if o == "i"], [i for i, o in enumerate(outs) if o == "I"],
                       [i for i, o in enumerate(outs) if o == "q"])
                # a parse holds about one number a matched word
                size = 400 + 40 * (b - a)
                if seen.get("bytes", 0) + size <= SEEN_BYTES:
                    seen[text[a:b]] = got
                    seen["bytes"] = seen.get("bytes", 0) + size
            label, plain, negated, quoted = got
            row = out[t.doc[a]]
            for k, where in ((label, plain), (3, negated), (4, quoted)):
                if k >= 0 and where:
                    x = weight[a:b][where]
                    row[k] += x.sum()
                    row[len(LABELS) + k] += 1
                    row[-4] = max(row[-4], x.max())
            if label == 2 and not plain:
                row[len(LABELS) + 2] += 1
    total = out[:, :len(LABELS)].sum(axis=1)
    out[:, :2 * len(LABELS)] = np.log1p(out[:, :2 * len(LABELS)])
    out[:, -3] = np.log1p(100 * total / np.maximum(t.count, 1))
    out[:, -2] = np.log1p(t.count)
    out[:, -1] = 1
    return out


def all_features(column, hashes: np.ndarray, weights: np.ndarray, seen: dict) -> np.ndarray:
    fst, sets = grammar(), [word_set(x) for x in (TARGET, NEGATION, REPORTED, THREAT)]
    parts = [features(t, hashes, weights, seen, fst, sets) for _, t in slices(as_texts(column), SLICE)]
    return np.concatenate([np.zeros((0, N_FEATURES)), *parts])


def count_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and clean documents of each pattern in this task, with the next
    shorter pattern (0: none)."""
    keys, ups, labels = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, bool)]
    for batch in batches:
        toxic = batch["__label"].to_numpy() > 0
        for at, texts in slices(as_texts(batch["__text"]), SLICE):
            t = tokens(texts)
            up = np.zeros(len(t.doc), U64)
            for h in t.patterns:
                at_ = np.flatnonzero(h)
                order = at_[np.lexsort((h[at_], t.doc[at_]))]
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (t.doc[order][1:] != t.doc[order][:-1])
                pick = order[new]
                keys.append(h[pick])
                ups.append(up[pick])
                labels.append(toxic[at + t.doc[pick]])
                up = np.where(h > 0, h, up)
    key, up, label = np.concatenate(keys), np.concatenate(ups), np.concatenate(labels)
    uniq, first, inv = np.unique(key, return_index=True, return_inverse=True)
    bad = np.bincount(inv, weights=label, minlength=len(uniq)).astype(np.int64)
    all_ = np.bincount(inv, minlength=len(uniq))
    for i in range(0, len(uniq), 50_000):
        s = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays([pa.array(uniq[s].view(np.int64)), pa.array(up[first[s]].view(np.int64)),
                                          pa.array(bad[s]), pa.array(all_[s] - bad[s])], ["h", "up", "t", "c"])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients on standardised columns (the last one is 1), by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale[-1] = 0, 1
    scale[scale < 1e-9] = 1
    z = (x - mean) / scale
    b = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (y - p) - pen * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return b, mean, scale


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most: int = 30_000, id_col: str = "doc_id",
        text_col: str = "text") -> Model:
    """Learn the grammar's weights from a sample of at most ``most`` labelled documents.

    Two thirds of the sample give the insult patterns: words and word prefixes of
    4 to 8 bytes that occur in at least 4 toxic documents and mainly there, with
    their log odds; longer patterns that are common in clean documents override
    them.  The last third gives the weights of the clause types.  Without labels
    of both kinds every score is the rate of label 1 (0 without labels).
    """
    rows = sample(docs, labels, label_col, most, id_col, text_col)
    lex = rows.where("__part < 4")
    n = {r["__label"]: r["count"] for r in lex.groupBy("__label").count().collect()}
    n_bad, n_ok = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    counts = written(lex.select("__text", "__label").mapInArrow(tidy(count_patterns), "h long, up long, t long, c long")
                     .groupBy("h").agg(F.max("up").alias("up"), F.sum("t").alias("t"), F.sum("c").alias("c"))
                     .where("t + c >= 4"), "patterns")
    odds = F.log((F.col("t") + 0.5) / (n_bad + 1.0)) - F.log((F.col("c") + 0.5) / (n_ok + 1.0))
    all_ = F.col("t") + F.col("c")
    share = (F.col("t") + 1) / (all_ + 2)
    low = share - 1.3 * F.sqrt(share * (1 - share) / (all_ + 2))
    toxic = (F.col("t") >= 4) & (odds >= 2.0) & (low >= 0.4)
    bad = counts.where(toxic).select("h", odds.alias("w"))
    calm = counts.where(~toxic & (all_ >= 8)).join(bad.select(F.col("h").alias("up")), "up", "left_semi").select(
        "h", F.lit(0.0).alias("w"))
    got = bad.unionByName(calm).toPandas() if n_bad and n_ok else None
    hashes = got["h"].to_numpy(np.int64).view(U64) if got is not None else np.zeros(0, U64)
    order = np.argsort(hashes)
    hashes, weights = hashes[order], got["w"].to_numpy()[order] if got is not None else np.zeros(0)

    def featurise(batches):
        seen: dict = {}
        for b in batches:
            x = all_features(b["__text"], hashes, weights, seen)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), b["__label"]], ["x", "y"])

    fitted = rows.where("__part >= 4").select("__text", "__label").mapInArrow(tidy(featurise), "x array<double>, y int").toPandas()
    y = (fitted["y"].to_numpy() == 1).astype(float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        coef = np.zeros(N_FEATURES)
        coef[-1] = np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
        return Model(hashes, weights, coef, np.zeros(N_FEATURES), np.ones(N_FEATURES))
    return Model(hashes, weights, *logistic(np.stack(fitted["x"].to_list()), y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses) of every row's whole text; ``clauses`` counts the
    matched ones of each type, in the order of LABELS.

    Defined cases: null and empty texts have no match and get the score of an
    empty text; rows are scored one by one, so repeated rows and null ids get
    rows of their own; other columns are not read.
    """
    m = model

    def run(batches):
        seen: dict = {}
        for b in batches:
            x = all_features(b["__text"], m.hashes, m.weights, seen)
            p = 1 / (1 + np.exp(-np.clip(((x - m.mean) / m.scale) @ m.coef, -30, 30)))
            n = np.rint(np.expm1(x[:, len(LABELS):2 * len(LABELS)])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["__id"], pa.array(p), pa.array(list(n), pa.list_(pa.int32()))],
                                             [id_col, "score", "clauses"])

    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(tidy(run), f"`{id_col}` long, score double, clauses array<int>")


def keep_clean(docs: DataFrame, model: Model, cut: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is under ``cut``, all columns unchanged."""
    m = model

    def run(batches):
        seen: dict = {}
        for b in batches:
            x = all_features(b[text_col], m.hashes, m.weights, seen)
            p = 1 / (1 + np.exp(-np.clip(((x - m.mean) / m.scale) @ m.coef, -30, 30)))
            yield b.filter(pa.array(p < cut))

    return docs.mapInArrow(tidy(run), docs.schema)
