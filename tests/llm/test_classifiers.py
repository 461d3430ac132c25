import random

import pytest

from papyra.llm import quality, toxicity


def test_composed_grammar():
    g = toxicity.grammar()

    def run(text):
        state, out = g.start, ""
        for s in text:
            state, o = g.step(state, s)
            out += o
        return g.final[state], out

    assert run("oio") == ("plain", "oio")
    assert run("toi") == ("targeted", "toi")
    assert run("oit") == ("targeted", "oit")
    assert run("oht") == ("threat", "oht")
    assert run("oh") == ("", "oh")
    assert run("noi") == ("", "noI")
    assert run("noooi") == ("plain", "noooi")
    assert run("toroi") == ("", "toroq")
    assert run("noht") == ("", "noHt")


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ba", "ko", "ri", "se", "nu"]) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        w = [word() for _ in range(rng.randint(20, 120))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "Moron,", "vequ" + word()])
        if not good:
            w = [x + "###" for x in w] if rng.random() < 0.5 else [w[0]] * len(w)
        docs.append((i, " ".join(w) + ".", "src", 1))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, label string, score int"), spark.createDataFrame(
        labels, "doc_id long, quality int, toxic int")


def check(scored, labels, col, cut, held, least):
    rows = scored.join(labels, "doc_id").where(held).select("score", col).collect()
    right = sum((r[0] >= cut) == (r[1] == 1) for r in rows)
    assert len(rows) > 100 and right >= least * len(rows)


def test_toxicity_held_out(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"))
    check(toxicity.score(docs, model), labels, "toxic", 0.3, "doc_id % 3 = 1", 0.95)
    left = toxicity.keep_clean(docs, model, 0.5)
    assert left.columns == docs.columns and 500 < left.count() < 800


def test_quality_held_out(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels.where("doc_id % 3 <> 1"))
    check(quality.score(docs, model), labels, "quality", 0.5, "doc_id % 3 = 1", 0.95)


def test_quality_fit_is_repeatable(labelled):
    docs, labels = labelled
    a, b = (quality.fit(docs.repartition(n), labels, epochs=1) for n in (2, 5))
    assert (a.vectors == b.vectors).all()


def test_odd_rows(labelled, odd_docs, no_docs):
    docs, labels = labelled
    for lib, col in ((toxicity, "toxic"), (quality, "quality")):
        model = lib.fit(docs, labels.where("doc_id < 200"), col)
        got = lib.score(odd_docs, model).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
        empty = {r.score for r in got if r.doc_id in (3, 4, 5)}
        assert len(empty) == 1
        assert lib.score(no_docs, model).count() == 0
        none = lib.fit(no_docs, labels, col)
        assert lib.score(odd_docs, none).count() == odd_docs.count()
    assert toxicity.keep_clean(odd_docs, toxicity.fit(docs, labels), 0.5).columns == odd_docs.columns
