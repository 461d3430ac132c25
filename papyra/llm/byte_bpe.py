"""Ids of whole texts by the tokenizers library, each distinct piece encoded once.

``Encoder`` returns what ``Tokenizer.encode(text, add_special_tokens=False)`` of the
library returns.  A byte-level tokenizer never joins what stands before a space
to what follows it, unless white space stands before the space; nor a letter to
what follows it, unless that is a letter or an apostrophe.  So texts without
white space before a space are cut at spaces and after words, and each distinct
piece is encoded once: words of letters by the library's model, other pieces by
the whole library.  Texts with white space before a space, rare white space,
letters above U+024F (whose classes may differ between Unicode versions), NUL or
an added token, and tokenizers of another kind go to the library as they are.

What is known of pieces only saves time and is bounded by bytes.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are not cut (RE2): white space before a space, and what libraries class differently.
ODD = r"\s |[\x00\x0b\x1c-\x1f\x{80}-\x{a0}\x{250}-\x{10ffff}]"
#: A letter and what never belongs to its word.
ENDS = r"(\pL)([^\pL\s'\x00])"
KNOWN_BYTES = 64 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the
    others in order from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known:
    """Ids of strings, in flat arrays; forgets all when the bytes reach a bound."""

    def __init__(self, most: int = KNOWN_BYTES):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size = [], []  # blocks
        self.held, self.flat = 0, None

    def rows(self, names: list[str]) -> np.ndarray:
        """Row of each name, -1 where it is not known."""
        get = self.index.get
        return np.fromiter((get(x, -1) for x in names), np.int64, len(names))

    def add(self, names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(names, range(n, n + len(names)), strict=True))
        self.ids.append(ids)
        self.size.append(size)
        self.held += 4 * len(ids) + 130 * len(names) + sum(map(len, names))
        self.flat = None

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each row)."""
        if self.flat is None:
            self.ids, self.size = [np.concatenate(self.ids)], [np.concatenate(self.size)]
            self.flat = np.cumsum(self.size[0]) - self.size[0]
        n = self.size[0][rows]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[0][np.repeat(self.flat[rows] - (ends - n), n) + np.arange(total)], n


def _flatten(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.uint32, int(size.sum())), size


class Encoder:
    def __init__(self, path: str, known_bytes: int = KNOWN_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.size = self.tok.get_vocab_size()
        made = json.loads(self.tok.to_str())
        before = made["pre_tokenizer"] or {}
        self.cuts = (before.get("type") == "ByteLevel" and not before["add_prefix_space"] and before.get("use_regex", True)
                     and all(made[x] is None for x in ("normalizer", "post_processor", "truncation", "padding"))
                     and made["model"]["type"] == "BPE" and not made["model"].get("dropout"))
        self.odd = "|".join([ODD, *(re.escape(x["content"]) for x in made["added_tokens"])])
        self.letters = byte_letters() | {0: "\0"}  # NUL parts the words here
        self.known = Known(known_bytes)

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _flatten([e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)])

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, with or without a space before."""
        spelled = "\0".join(words).encode().decode("latin1").translate(self.letters).split("\0")
        merge = self.tok.model.tokenize
        return _flatten([[t.id for t in merge(x)] for x in spelled])

    def _learn(self, pieces: list[str]) -> None:
        words = [x for x in pieces if (x[1:] if x[:1] == " " else x).isalpha()]
        rest = [x for x in pieces if not (x[1:] if x[:1] == " " else x).isalpha()]
        for some, ids in ((words, self._words), (rest, self.whole)):
            if some:
                self.known.add(some, *ids(some))

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        marked = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\0 "), ENDS, "\\1\0\\2")
        parts = pc.split_pattern(marked, "\0")
        count = pc.list_value_length(parts).to_numpy()
        coded = pc.dictionary_encode(parts.flatten())
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = self.known.rows(names)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if self.known.held > self.known.most:
                self.known.forget()
                new = np.arange(len(names))
            self._learn([names[i] for i in new.tolist()])
            again = rows if len(new) < len(names) else np.empty(len(names), np.int64)
            again[new] = self.known.rows([names[i] for i in new.tolist()])
            rows = again
        ids, n = self.known.gather(rows[coded.indices.to_numpy()])
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])])

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text);
        ``texts``: large_string without nulls."""
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.cuts else np.ones(len(texts), bool)
        collects = gc.isenabled()
        gc.disable()  # many short strings and lists, no cycles
        try:
            if not odd.any() and len(texts):
                return self._cut(texts)
            rest = self.whole(texts.filter(pa.array(odd)).to_pylist())
            cut = self._cut(texts.filter(pa.array(~odd))) if not odd.all() else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        finally:
            if collects:
                gc.enable()
        size = np.zeros(len(texts), np.int64)
        size[odd], size[~odd] = rest[1], cut[1]
        of = np.repeat(odd, size)
        ids = np.empty(len(of), np.uint32)
        ids[of], ids[~of] = rest[0], cut[0]
        return ids, size

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, size = self.flat(pa.array(texts, pa.large_string()))
        return np.split(ids, np.cumsum(size)[:-1]) if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process; what it knows serves later tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
