import random

import pyarrow as pa
import pytest

from papyra.llm import chunks, substring_dedup
from papyra.llm.line_dedup import drop_common_lines
from papyra.llm.ngram_join import keep_one, near_duplicates
from papyra.llm.substring_dedup import drop_repeats
from tests.llm import brute


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz")
    base = [[word() for _ in range(rng.choice([3, 8, 40, 90]))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + rng.choice(base)
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_ngram_join_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = {r[0]: r[1:] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [brute.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute.components(len(rows), links)
    assert got == {i: (len(sets[k]), rows[comp[k]][0]) for k, (i, _) in enumerate(rows)}


def test_ngram_join_chain_of_copies_and_large_group(spark):
    rng = random.Random(1)
    text = [f"t{j}" for j in range(120)]
    rows = []
    for i in range(150):  # each step changes one more word: ends are far apart, neighbours link
        if i % 3 == 0:
            text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = [brute.shingles(t) for _, t in rows]
    links = [(a, b) for a in range(150) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute.components(150, links)
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(comp))


def test_ngram_join_odd_rows(spark, odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].component_id == by[1].doc_id and by[2].component_id in (1, 2)
    assert by[3].n_shingles == 0 and by[3].component_id == 3 and by[5].component_id == 5
    assert by[6].component_id == 6 and by[7].component_id == 6 and by[7].n_shingles == 1
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 7 not in ids and ids.count(8) == 1 and ids.count(None) == 2
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("window", [6, 7, 20])
def test_substring_dedup_equals_brute_force(spark, window):
    rows = corpus(window, 40) + [(1000, None), (1001, ""), (None, "a b " * 30)]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    want = {i: w for (i, _), w in zip(rows, brute.repeats(rows, window), strict=True)}
    assert {r.doc_id: (r.text, r.n_words, r.n_removed) for r in got} == want
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_odd_rows(spark, odd_docs, no_docs):
    got = drop_repeats(odd_docs).collect()
    assert len(got) == odd_docs.count()
    eights = [r for r in got if r.doc_id == 8]
    assert len(eights) == 2 and eights[0] == eights[1] and eights[0].n_removed > 0
    assert [r.n_removed for r in got if r.doc_id == 1] == [0]
    assert drop_repeats(no_docs).count() == 0


def test_line_dedup_equals_brute_force(spark, odd_docs, no_docs):
    out = drop_common_lines(odd_docs, min_docs=3)
    assert set(odd_docs.columns) < set(out.columns)
    rows = odd_docs.collect()
    want = sorted((str(r.doc_id), *w) for r, w in zip(rows, brute.lines([r.doc_id for r in rows], [r.text for r in rows], 3), strict=True))
    assert sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in out.collect()) == want
    assert any(w[3] for w in want)
    assert drop_common_lines(no_docs).count() == 0


def test_line_dedup_counts_an_id_once(spark):
    def dropped(ids):
        rows = [(i, f"shared by rows\nown {n}") for n, i in enumerate(ids)]
        return [r.n_dropped for r in drop_common_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()]

    assert dropped([5] * 12) == [0] * 12
    assert dropped([*range(8), 5, 5, 5, 5]) == [0] * 12
    assert dropped([*range(9), 5, 5, None]) == [1] * 12


def near(word, n=60):
    """Two texts of ``n`` words that link."""
    w = [f"{word}{j}" for j in range(n)]
    return " ".join(w), " ".join([*w[:-1], "other"])


def test_ngram_join_ids_with_several_texts(spark):
    (a, a2), (b, b2) = near("a"), near("b")
    rows = [(3, a), (7, a2), (7, b), (9, b2), (None, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs).collect())
    assert got == [(0, 0), (0, 0), (3, 3), (7, 3), (7, 7), (9, 7)]
    assert sorted((r.doc_id or 0, r.text) for r in keep_one(docs).collect()) == [(0, a), (0, a), (3, a), (7, b)]


def test_keep_one_of_several_texts_of_the_smallest_id(spark):
    (a, a2), (b, b2) = near("a"), near("b")
    docs = spark.createDataFrame([(5, a), (5, a2), (5, a.upper()), (5, b), (6, b2), (8, a2), (8, a2)], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in keep_one(docs).collect()]
    assert len(kept) == 2 and (5, b) in kept and {i for i, _ in kept} == {5}


def test_substring_dedup_asks_about_few_runs(spark, monkeypatch):
    asked = []

    def spy(base, question):
        asked.append(question(0, table))
        return chunks.ask(base, question)

    rng = random.Random(3)
    text = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(400)) for _ in range(50)]
    table = pa.table({"__id": list(range(50)), "__text": text})
    monkeypatch.setattr(substring_dedup, "ask", spy)
    drop_repeats(spark.createDataFrame([(0, "a")], "doc_id long, text string"), window=20)
    # 4 bytes a run and one number a bucket: not every one of the 20,000 runs is asked about
    assert sum(len(row[3]) for row in asked[0]) < 20_000


@pytest.mark.parametrize("window", [1, 2, 5, 20])
def test_substring_dedup_of_few_words(spark, window):
    rng = random.Random(window)
    texts = ["a " * 90, "a b " * 40, "a b c " * 30 + "x", "a " * 20, "a " * 19, "x " + "a " * 21 + "y"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.choice([19, 20, 21, 60]))) for _ in range(30)]
    rows = [(7 * i % 36, t) for i, t in enumerate(texts)]
    got = drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window).collect()
    want = {i: w for (i, _), w in zip(rows, brute.repeats(rows, window), strict=True)}
    assert {r.doc_id: (r.text, r.n_words, r.n_removed) for r in got} == want
