"""Atom files -> entries -> papers; incremental ingest into snapshots."""

import os

import pytest
from pyspark.sql import functions as F

from papyra.operators.normalize import normalize_entries, validate_papers
from papyra.sources.atom import read_atom
from papyra.operators import embed as E
from papyra.operators.keyword_index import KeywordIndex
from papyra.sources.store import BatchStore
from papyra.streaming.ingest import first_entries, ingest_files, ingest_stream

HEAD = ('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom" '
        'xmlns:arxiv="http://arxiv.org/schemas/atom">\n')


def entry(i, title="A title", authors=("Ann",), pdf=True, primary=True, cats=("cs.CL", "cs.LG"),
          ident=None, version="v1"):
    ident = ident or f"http://arxiv.org/abs/2401.{i:05d}{version}"
    parts = [f"<entry><id>{ident}</id><updated>2024-01-0{1 + i % 8}T10:00:0{i % 10}Z</updated>",
             f"<published>2024-01-01T09:30:1{i % 10}Z</published><title>{title}</title>",
             f"<summary>Abstract {i}\n  with   space</summary>"]
    parts += [f"<author><name>{a}</name></author>" for a in authors]
    parts.append(f'<link href="{ident}" rel="alternate" type="text/html"/>')
    if pdf:
        parts.append(f'<link title="pdf" href="http://files/{i}.pdf" rel="related" type="application/pdf"/>')
    if primary:
        parts.append(f'<arxiv:primary_category term="{cats[0] if cats else "x.Y"}"/>')
    parts += [f'<category term="{c}"/>' for c in cats]
    parts.append("</entry>")
    return "".join(parts)


def write_feed(path, entries):
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEAD + "\n".join(entries) + "\n</feed>\n")


def test_atom_edge_cases(spark, tmp_dir):
    write_feed(os.path.join(tmp_dir, "f.xml"), [
        entry(1, title="Multi\n   line\ttitle", authors=("Solo",)),
        entry(2, pdf=False),
        entry(3, primary=False),
        entry(4, primary=False, cats=()),
        entry(5, ident="http://arxiv.org/abs/cs/0001001v1"),
        entry(6, ident="urn:no-abs-here"),
    ])
    p = {r.abs_url: r for r in normalize_entries(read_atom(spark, tmp_dir)).collect()}
    e1 = p["http://arxiv.org/abs/2401.00001v1"]
    assert e1.title == "Multi line title" and e1.authors == ["Solo"] and e1.pdf_url == "http://files/1.pdf"
    assert e1.abstract == "Abstract 1 with space"
    assert str(e1.published) == "2024-01-01 09:30:11"
    assert p["http://arxiv.org/abs/2401.00002v1"].pdf_url == "http://arxiv.org/pdf/2401.00002v1"
    e3 = p["http://arxiv.org/abs/2401.00003v1"]
    assert e3.primary_category == "cs.CL" and e3.categories == ["cs.CL", "cs.LG"]
    e4 = p["http://arxiv.org/abs/2401.00004v1"]
    assert e4.primary_category == "" and e4.categories == []
    assert p["http://arxiv.org/abs/cs/0001001v1"].arxiv_id == "cs/0001001v1"
    assert p["urn:no-abs-here"].arxiv_id == "urn:no-abs-here"


def test_validation_quarantines(spark, tmp_dir):
    write_feed(os.path.join(tmp_dir, "f.xml"), [entry(1), entry(2).replace("<title>A title</title>", "")])
    valid, rejects = validate_papers(normalize_entries(read_atom(spark, tmp_dir)))
    assert valid.count() == 1
    assert [r.reasons for r in rejects.collect()] == [["title is null"]]


def test_stream_equals_batch_and_rerun_is_noop(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    for f in range(3):
        write_feed(os.path.join(landing, f"feed{f}.xml"),
                   [entry(10 * f + j, authors=(f"A{j}", f"B{f}")) for j in range(4)])
    # one paper re-arrives in a later file with a new version and a new title
    write_feed(os.path.join(landing, "feed3.xml"), [entry(0, title="Renamed"), entry(0, version="v2")])
    for f in range(4):  # arrival order = modification time
        os.utime(os.path.join(landing, f"feed{f}.xml"), (1_700_000_000 + 60 * f, 1_700_000_000 + 60 * f))
    store_root = os.path.join(tmp_dir, "store")
    ckpt = os.path.join(tmp_dir, "ckpt")
    ingest_stream(spark, landing, store_root, ckpt, files_per_trigger=1, embed_model="hash",
                  clock=lambda: "2024-09-01 00:00:00")
    store = BatchStore(spark, store_root)
    t = store.tables()
    papers = {r.arxiv_id: r for r in t["papers"].collect()}
    assert len(papers) == 13
    assert papers["2401.00000v1"].title == "Renamed"
    assert "2401.00000v2" in papers
    assert t["paper_embeddings"].where(F.col("model") == "hash").count() == 13
    authors = t["authors"].collect()
    assert sorted(a.name for a in authors) == ["A0", "A1", "A2", "A3", "Ann", "B0", "B1", "B2"]
    assert sorted(a.author_id for a in authors) == list(range(1, 9))
    assert t["paper_authors"].join(t["authors"], "author_id", "left_anti").count() == 0
    assert sorted(r.code for r in t["categories"].collect()) == ["cs.CL", "cs.LG"]
    done = store.batches().orderBy("batch_no").collect()
    assert [(r.new_count, r.updated_count) for r in done] == [(4, 0), (4, 0), (4, 0), (1, 1)]
    # rerun on the same checkpoint: nothing new
    ingest_stream(spark, landing, store_root, ckpt, files_per_trigger=1)
    assert store.batches().count() == 4
    # the streamed result equals one batch over all files
    batch = normalize_entries(read_atom(spark, landing)).select("arxiv_id").distinct().count()
    assert batch == 13


@pytest.mark.parametrize("table", ["categories", "authors", "paper_authors", "_commit"])
def test_crash_between_any_two_writes(spark, tmp_dir, monkeypatch, table):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    write_feed(os.path.join(landing, "f.xml"), [entry(1), entry(2, authors=("Bob",))])
    root = os.path.join(tmp_dir, "store")
    assert ingest_files(spark, landing, root, "a", 0)["new_count"] == 2
    landing = os.path.join(tmp_dir, "later")
    os.makedirs(landing)
    write_feed(os.path.join(landing, "g.xml"), [entry(3, authors=("Cid", "Ann")), entry(1, title="Renamed")])
    name = "commit" if table == "_commit" else "write"
    kept = getattr(BatchStore, name)

    def boom(self, *a, **k):
        if name == "commit" or a[0] == table:
            raise OSError("crash")
        return kept(self, *a, **k)

    monkeypatch.setattr(BatchStore, name, boom)
    with pytest.raises(OSError):
        ingest_files(spark, landing, root, "a", 1)
    monkeypatch.undo()
    store = BatchStore(spark, root)
    assert {r.title for r in store.tables()["papers"].collect()} == {"A title"} and store.tables()["papers"].count() == 2
    assert ingest_files(spark, landing, root, "a", 1)["new_count"] == 1
    assert ingest_files(spark, landing, root, "a", 1) is None
    t = store.tables()
    assert {r.arxiv_id[:10]: r.title for r in t["papers"].collect()} == {
        "2401.00001": "Renamed", "2401.00002": "A title", "2401.00003": "A title"}
    assert {r.name: r.author_id for r in t["authors"].collect()} == {"Ann": 1, "Bob": 2, "Cid": 3}


def test_two_feeds_into_one_store(spark, tmp_dir):
    root = os.path.join(tmp_dir, "store")
    for f in range(2):
        landing = os.path.join(tmp_dir, f"landing{f}")
        os.makedirs(landing)
        write_feed(os.path.join(landing, "x.xml"), [entry(10 * f + j) for j in range(2)])
        ingest_stream(spark, landing, root, os.path.join(tmp_dir, f"ckpt{f}"))
    store = BatchStore(spark, root)
    assert store.tables()["papers"].count() == 4 and store.batches().count() == 2


def test_bad_date_is_quarantined_and_total_is_capped(spark, tmp_dir):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    bad = entry(2).replace("<published>2024-01-01T09:30:12Z", "<published>soon")
    write_feed(os.path.join(landing, "a.xml"), [entry(1), bad, entry(3)])
    write_feed(os.path.join(landing, "b.xml"), [entry(4)])
    root = os.path.join(tmp_dir, "store")
    got = ingest_files(spark, landing, root, "bulk", 0, max_total=3)
    assert (got["new_count"], got["rejected"]) == (2, 1)
    rejects = spark.read.parquet(os.path.join(root, "_rejects"))
    assert [r.reasons for r in rejects.collect()] == [["published is null"]]


class Failing(E.HashingEncoder):
    """Vectors of texts with 'Odd' in them are no numbers."""

    def encode(self, texts, mode="document"):
        out = super().encode(texts, mode)
        out[[t is not None and "Odd" in t for t in texts]] = float("nan")
        return out


def test_rejected_vectors_are_kept_and_tried_again(spark, tmp_dir):
    root, index = os.path.join(tmp_dir, "store"), os.path.join(tmp_dir, "index")
    got = []
    for n, (feed, encoder) in enumerate((([entry(1), entry(2, title="Odd one")], Failing), ([entry(3), entry(4, title="Odd too")], Failing),
                                         ([entry(4, title="Even now")], E.HashingEncoder))):
        landing = os.path.join(tmp_dir, f"landing{n}")
        os.makedirs(landing)
        write_feed(os.path.join(landing, "f.xml"), feed)
        got.append(ingest_files(spark, landing, root, "a", n, embed_model="h", encoder_factory=encoder, keyword_index=index))
    # the second batch tries paper 2 again, in vain; the third encodes it and the renamed paper 4
    assert [(g["new_count"], g["rejected"]) for g in got] == [(2, 1), (2, 2), (0, 0)]
    store = BatchStore(spark, root)
    vecs = store.tables()["paper_embeddings"]
    assert sorted(r.paper_id[:10] for r in vecs.collect()) == ["2401.00001", "2401.00002", "2401.00003", "2401.00004"]
    kept = KeywordIndex.open(spark, index, last=got[-1]["batch_no"])
    assert {r.paper_id[:10]: "even" in r.tokens for r in kept.live().collect()} == {
        "2401.00001": False, "2401.00002": False, "2401.00003": False, "2401.00004": True}
    assert KeywordIndex.open(spark, index, last=1).live().count() == 2


@pytest.mark.parametrize("most", [0, 1, 4, 5, 6, 9, 12, 50])
def test_cap_takes_files_in_order_and_cuts_inside_one(spark, tmp_dir, most):
    landing = os.path.join(tmp_dir, "landing")
    os.makedirs(landing)
    want, n = [], 0
    for name, size in (("a", 4), ("b", 1), ("c", 7)):
        ids = range(n + 1, n + size + 1)
        write_feed(os.path.join(landing, f"{name}.xml"), [entry(i) for i in ids])
        want, n = want + [f"{i:05d}" for i in ids], n + size
    got = first_entries(read_atom(spark, landing), most)
    assert sorted(r.id.split("/")[-1].split(".")[1][:5] for r in got.collect()) == want[:most]
