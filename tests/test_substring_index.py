import numpy as np

from papyra.operators import substring_index as SI

PAPERS = "arxiv_id string, title string"
TERMS = "term string, title string, block int"


def folded(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(papers, terms):
    return sorted({(folded(t), i) for t, *_ in terms if t is not None for i, x in papers if x is not None and folded(t) in folded(x)})


def stored(spark, root, parts, block):
    for k, p in enumerate(parts):
        SI.SubstringIndex.add(root, spark.createDataFrame(p, PAPERS), k, block_papers=block)
    return SI.SubstringIndex.open(spark, root)


def test_find_equals_contains(spark, tmp_dir):
    rng = np.random.default_rng(3)
    papers = [(f"p{i:03d}", "".join(rng.choice(list("abAB éß😀"), int(rng.integers(0, 14))))) for i in range(300)]
    papers += [("q1", None), ("q2", ""), ("q3", "x" * 20_000 + "The End"), ("q4", "a"), ("q5", "%_.*")]
    terms = [(t,) for t in ("", "a", "B", "ab", "AbA", "abab", "é", "ß😀", "😀a b", "😀😀", "x" * 5000, "xxthe end", "zzz", ".*", "%", "abxab", None, "aB")]
    terms = [(t, None, 1) for t, in [*terms, *[(x[2:8],) for _, x in papers[:150]]]]
    index = stored(spark, tmp_dir, [papers], 16)
    got = SI.find(index, spark.createDataFrame(terms, TERMS))
    assert got.columns == ["term", "paper_id"]
    assert sorted(map(tuple, got.collect())) == brute(papers, terms)


def test_blocks_without_the_grams_are_skipped(spark, tmp_dir):
    papers = [(f"p{i:03d}", f"common words {i:03d}") for i in range(400)]
    index = stored(spark, tmp_dir, [papers], 20)
    terms = spark.createDataFrame([("words 123", "", 0)], TERMS)
    blocks = index.texts.select("block").distinct().count()
    assert blocks == 20 and SI.term_blocks(index, terms).count() <= 3
    assert [tuple(r) for r in SI.find(index, terms).collect()] == [("words 123", "p123")]


def test_newest_segment_counts(spark, tmp_dir):
    first = [("a", "old title"), ("b", "old book"), ("c", "old gone")]
    index = stored(spark, tmp_dir, [first, [("a", "new title"), ("c", None)]], 4)
    terms = spark.createDataFrame([(t, None, None) for t in ("OLD", "title", "new")], TERMS)
    assert sorted(map(tuple, SI.find(index, terms).collect())) == [("new", "a"), ("old", "b"), ("title", "a")]
    before = SI.SubstringIndex.open(spark, tmp_dir, last=0)
    assert SI.find(before, terms).count() == 4


def test_nothing_indexed_or_asked(spark, tmp_dir):
    index = stored(spark, tmp_dir, [[]], 4)
    terms = spark.createDataFrame([("a", None, None)], TERMS)
    assert SI.find(index, terms).count() == 0
    assert SI.find(index, terms.limit(0)).count() == 0
