import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papyra.llm import queries
from papyra.llm.best_fit_packing import cut_lengths, pack, sum_of_squares
from papyra.llm.byte_bpe import Encoder

BPE = public_tokenizers.path("byte_bpe_50k.json")
TOK = Tokenizer.from_file(BPE)
ODD = ["", " ", "  a", "a  b", "a\n b", "hello <|endoftext|> world", "it's they're 12a, b c'x", "\x1c a\x1cb !!\n\nx", "日本 語 x", "a\0b c",
       "tab\tx  y ", "end ", "é è ẞ ﬁ Ⅷ ª²", "x\xa0 y\x85z", "a" * 500, "don't,I'll.we've'x", "a\x0b b c", "\n\n\n", "naïve, façade; ÀÉÎ 1st"]
ENC = Encoder(BPE)


def test_encoder_equals_the_library():
    got, again = ENC(ODD), Encoder(BPE, known_bytes=0)
    for texts in (ODD, ODD[::-1], ODD):
        for t, ids in zip(texts, again(texts), strict=True):
            assert ids.tolist() == TOK.encode(t, add_special_tokens=False).ids
    assert [x.tolist() for x in got] == [x.tolist() for x in again(ODD)]
    assert ENC([]) == [] and ENC.flat(pa.array([], pa.large_string()))[0].size == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'stl.,!19 \n\t\x0b\x1c\xa0Ȁɐ日\0_ß"), max_size=25), max_size=4))
def test_encoder_equals_the_library_on_any_text(texts):
    assert [x.tolist() for x in ENC(texts)] == [TOK.encode(t, add_special_tokens=False).ids for t in texts]


def brute(lengths, most):
    """The rule word for word, over a list of gaps."""
    gaps, seq = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        def squares(g):
            left = sorted([x for x in gaps if x] + [g - lengths[i]])
            left.remove(g)
            return sum(left.count(x) ** 2 for x in set(left) if x)
        fit = sorted({g for g in gaps if g >= lengths[i]}, key=lambda g: (squares(g), g))
        seq[i] = fit[0] if fit else None
        if fit:
            gaps[gaps.index(fit[0])] -= lengths[i]
        else:
            gaps.append(most - lengths[i])
    return gaps, seq


def test_pieces_go_where_the_squares_become_smallest():
    rng = np.random.default_rng(5)
    for most in (1, 7, 20):
        lengths = rng.integers(1, most + 1, 120)
        seq, at = sum_of_squares(lengths, most)
        gaps, chosen = brute(lengths.tolist(), most)
        assert all((chosen[i] is None) == (at[i] == 0) and (chosen[i] or most) == most - at[i] for i in range(len(lengths)))
        assert sorted(most - np.bincount(seq, lengths)) == sorted(gaps)
    assert [x.size for x in sum_of_squares(np.zeros(0, np.int64), 5)] == [0, 0]


def test_only_long_documents_are_cut():
    doc, piece, length = cut_lengths(np.array([1, 10, 11, 30]), 10)
    assert list(zip(doc.tolist(), piece.tolist(), length.tolist())) == [(0, 0, 1), (1, 0, 10), (2, 0, 1), (2, 1, 10), (3, 0, 10), (3, 1, 10), (3, 2, 10)]


def whole(docs, got, most):
    """Pieces cover each document and each sequence without gaps."""
    want = sorted((r.doc_id is not None, r.doc_id or 0, [*TOK.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in docs.collect())
    seqs, parts = {}, []
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= most
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        parts.append((r.doc_id, r.piece, r.start, ids.tolist()))
    for s in seqs.values():
        s.sort()
        assert [a for a, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1].tolist()] and sum(n for _, n in s) <= most
    for _, key, ids in want:
        key = key if _ else None
        count = -(-len(ids) // most)
        edge = [0, *range(len(ids) - (count - 1) * most, len(ids) + 1, most)]
        for k in range(count):
            parts.remove((key, k, edge[k], ids[edge[k]:edge[k + 1]]))
    assert not parts
    return len(seqs)


def test_documents_are_packed_whole(spark, odd_docs, no_docs):
    docs = odd_docs.unionByName(spark.createDataFrame([(500 + i, t, None, None, None, "x", None, 1) for i, t in enumerate(ODD)], odd_docs.schema))
    for most, group in ((1024, 8192), (7, 64), (1, 10_000)):
        got = pack(docs, BPE, 2, most=most, group=group).rows()
        assert got.columns == ["piece", "doc_id", "start", "length", "ids", "sequence_id", "offset"]
        whole(docs, got.collect(), most)
    assert pack(no_docs, BPE, 2).rows().count() == 0


def test_query_packs_close_to_the_bound(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = pack(docs, BPE, 2).rows().collect()
    used = whole(docs, rows, 1024)
    assert used <= 1.01 * -(-sum(r.length for r in rows) // 1024)
    crc = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in rows}
    assert crc == {(r.doc_id, r.piece): r.ids_crc32 for r in queries.op13_best_fit_packing(spark, sf).collect()}
