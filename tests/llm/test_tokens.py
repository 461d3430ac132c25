import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from papyra.llm import piece_dropout, token_files
from papyra.llm.words import U64

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  a  b\n\tc ", "▁x ▁▁ y", "日本\U0001F600\x00\r\n", "a" * 300, " \n\n  x   y", "naïve don't  it's\n\n ok",
         "<|endoftext|> end", "x  y", "the quick brown fox, jumps!", "  ", "a\n b", "tail ", "\n"]


def test_pieces_without_dropout_are_the_models_own():
    import pyarrow as pa
    p = piece_dropout.pieces(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [t for t in TEXTS if "▁" not in t]
    got = piece_dropout.encode_texts(p, pa.array(texts, pa.large_string()), 1, U64(0))
    assert [x.tolist() for x in got] == sp.encode(texts)


def test_agenda_equals_rounds(monkeypatch):
    p = piece_dropout.pieces(MODEL)
    words = [" " + w for t in TEXTS for w in t.split()] + [" internationalisation", " unbelievably"]
    cut = U64(int(0.3 * 2**64))
    a = piece_dropout.encode_segments(p, words, 5, cut)
    monkeypatch.setattr(piece_dropout, "LONG", 0)
    b = piece_dropout.encode_segments(p, words, 5, cut)
    assert [x.tolist() for x in a] == [x.tolist() for x in b]


def test_dropout_varies_and_decodes(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = piece_dropout.encode(docs, MODEL, dropout=0.3, seed=3)
    back = {r.doc_id: r.text for r in piece_dropout.decode(ids, MODEL).collect()}
    assert back == {i: t or "" for i, t in rows}
    some = [{r.doc_id: r.ids for r in piece_dropout.encode(docs.repartition(n), MODEL, dropout=0.3, seed=s).collect()}
            for n, s in ((2, 3), (5, 3), (2, 4))]
    assert some[0] == some[1] != some[2]
    assert len({tuple(some[0][10 + k * len(TEXTS)]) for k in range(3)}) > 1
    odd = piece_dropout.encode(odd_docs, MODEL)
    assert odd.count() == odd_docs.count() and piece_dropout.encode(no_docs, MODEL).count() == 0


def test_every_occurrence_is_drawn_by_its_own_key(spark):
    p = piece_dropout.pieces(MODEL)
    cut = U64(int(0.1 * 2**64))
    words = sorted({" " + w for t in TEXTS for w in t.split(" ") if w} | {" a", " internationalisation", " unbelievably"})
    index = np.tile(np.arange(len(words)), 40)
    keys = np.random.default_rng(1).integers(0, 2**63, len(index)).astype(U64)
    ids, n = piece_dropout.encode_drawn(p, words, index, keys, cut)
    parts = np.split(ids, np.cumsum(n)[:-1])
    for i, key, got in list(zip(index.tolist(), keys, parts, strict=True))[::13]:
        assert got.tolist() == piece_dropout.encode_segments(p, [words[i]], key, cut)[0].tolist()
    # within one text a segment of one merge is split about one time in ten, a long one in more than 16 ways
    for i, (word, ways) in enumerate(((" a", 2), (" internationalisation", 17))):
        docs = spark.createDataFrame([(i, word[1:] + word * 3999)], "doc_id long, text string")
        got = piece_dropout.encode(docs, MODEL, dropout=0.1, seed=1).first().ids
        drawn = [tuple(x) for x in occurrences(p, got, len(word))]
        assert len(drawn) == 4000 and len(set(drawn)) >= ways
        if word == " a":
            assert 0.08 < sum(len(x) == 2 for x in drawn) / 4000 < 0.12


def occurrences(p, ids, size):
    """The ids of each word of a text that repeats one word of this many bytes."""
    out, have = [[]], 0
    for x in ids:
        if have == size:
            out.append([])
            have = 0
        out[-1].append(x)
        have += int(p.size[x])
    return out


def test_copies_are_drawn_apart(spark):
    text = "the quick brown fox, jumps! " * 20
    docs = spark.createDataFrame([(1, text, 1), (1, text, 2), (1, text, 2)], "doc_id long, text string, copy int")
    ids = piece_dropout.encode(docs, MODEL, copy_col="copy")
    assert sorted({tuple(r.ids): 0 for r in ids.collect()}.values()) == [0, 0]
    assert {r.text for r in piece_dropout.decode(ids, MODEL).collect()} == {text}


def test_token_files_round_trip(spark, tmp_path, odd_docs, no_docs):
    rows = [(1000 - i, t) for i, t in enumerate(TEXTS)] + [(5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = f"file://{tmp_path}/a"
    got = token_files.read_tokens(token_files.write_tokens(docs, out, BPE, 2, frame_bytes=64), out).orderBy("doc_id").collect()
    tok = Tokenizer.from_file(BPE)
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), got, strict=True):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    for k, d in enumerate((odd_docs, no_docs)):
        o = f"file://{tmp_path}/odd{k}"
        assert token_files.read_tokens(token_files.write_tokens(d, o, BPE, 2), o).count() == d.count()


def test_reader_reads_only_asked_frames_and_checks_them():
    sink = io.BytesIO()
    w = token_files.Writer(sink, 2, frame_bytes=40)
    docs = [np.arange(n, dtype=np.uint32) for n in (3, 50, 0, 7, 7, 7, 30)]
    for i, x in enumerate(docs):
        w.add(i * 10, x)
    w.close()
    r = token_files.Reader(sink)
    assert len(r.frames) > 3
    assert [(n, i, x.tolist()) for n, i, x in r.get([4, 1])] == [(1, 10, docs[1].tolist()), (4, 40, docs[4].tolist())]
    raw = bytearray(sink.getvalue())
    raw[int(r.frames[1]["offset"]) + 6] ^= 1
    with pytest.raises(ValueError):
        list(token_files.Reader(io.BytesIO(bytes(raw))).get([1]))
    assert [x[1] for x in token_files.Reader(io.BytesIO(bytes(raw))).get([0])] == [0]
