import itertools
import re

from papyra.llm.filter_audit import audit

LABELS = "doc_id long, quality int, toxic int, source string"


def brute(docs, labels):
    """Every order applied to every row."""
    rows = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    lab = {}
    for i, q, t, _ in labels:
        g = lab.setdefault(i, [0, 0])
        g[0], g[1] = g[0] or int(q == 1), g[1] or int(t == 1)
    first = {}
    for i, _, x in rows:
        if i is not None:
            first[x] = min(first.get(x, i), i)
    seen = []
    for i, part, x in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", x)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", x)) > 2 * len(x),
                 "D": bool(re.search(r"[#$%&*|]", x)), "E": x in first and (i is None or i > first[x])}
        seen.append((part, {k for k, v in fails.items() if v}, *(lab.get(i, [0, 0]) if i is not None else [0, 0])))
    out, share = {}, {}
    for part in {s[0] for s in seen}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [s for s in seen if s[0] == part]
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                fail = [s for s in seen if s[0] == part and f in s[1]]
                left = [s for s in left if f not in s[1]]
                out[part, order, step] = (len(left), len(gone), len(fail) - len(gone), sum(s[1] == {f} for s in fail), sum(s[2] for s in gone), sum(s[3] for s in gone))
                share[part, f] = share.get((part, f), 0) + len(gone)
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_equals_every_order_applied(spark, odd_docs, no_docs):
    more = [(200 + i, text, "en", src, 1, "x", None, 1) for i, (text, src) in enumerate(itertools.product(
        ["", "same", "A#", "SHOUT " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " |"], ["a", "b", None]))]
    more += [(None, "same", "en", "a", 1, "x", None, 1), (None, "only without id", "en", "a", 1, "x", None, 1), (None, "only without id", "en", "b", 1, "x", None, 1),
             (201, "same", "en", "a", 1, "x", None, 1), (150, "same", "en", "a", 1, "x", None, 1), (150, "same", "en", "b", 1, "x", None, 1)]
    docs = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    labels = [(i, i % 2, int(i % 3 == 0), "s") for i in range(190, 220)] + [(150, None, 1, None), (150, 1, None, None), (None, 1, 1, "a"), (8, 1, 0, "c")]
    got = audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * 4  # a, b, c and no source
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(docs, labels)
    assert audit(no_docs, spark.createDataFrame(labels, LABELS)).count() == 0
    no_labels = audit(docs, spark.createDataFrame([], LABELS)).collect()
    assert {(r.good_lost, r.toxic_lost) for r in no_labels} == {(0, 0)} and len(no_labels) == 2400
