"""Independent SQL (DuckDB dialect) for every registered query.

Each string runs against the driver's pre-registered views (documents,
embeddings, benchmark, lineitem, orders, part, events, ...).  The fixture
mapping of ``papyra.sources.testbed`` is restated here in SQL, and the
debiased scores are recomputed without any linear-algebra library: the
principal directions come from repeated squaring of the covariance matrix
(normalised by its trace), one direction at a time with deflation.  That
shares no code or method with Spark ML's eigen solver, so it is a real check.
"""

from __future__ import annotations

from papyra.functions.text import STOPWORDS

WS = (r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+")
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def pid(x: str) -> str:
    return f"lpad(cast({x} AS VARCHAR), 19, '0')"


def tokens(x: str) -> str:
    """Distinct keyword tokens of a text, as a list."""
    return (f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains([{STOP}], w)))")


AUTHORS = ("list_concat(['a' || (doc_id % 97), 'b' || (doc_id % 53), 'a' || (doc_id % 97)], "
           "CASE WHEN doc_id % 5 = 0 THEN ['c' || (doc_id % 29)] ELSE []::VARCHAR[] END)")

# --- fixture views as CTE bodies ------------------------------------------------

ENTRIES = f"""entries AS (
  SELECT {pid('doc_id')} AS arxiv_id,
         {ws("split_part(text, chr(10), 1)")} AS title,
         {ws('text')} AS abstract,
         {AUTHORS} AS authors,
         [source, lang, source] AS categories,
         source AS primary_category,
         TIMESTAMP '2024-01-01' + to_days(cast(doc_id % 100000 AS INTEGER)) AS published,
         TIMESTAMP '2024-01-01' + to_days(cast(doc_id % 100000 AS INTEGER) + 1) AS updated,
         'http://x/pdf/' || {pid('doc_id')} AS pdf_url,
         'http://x/abs/' || {pid('doc_id')} AS abs_url,
         CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS journal_ref,
         CAST(NULL AS VARCHAR) AS doi, doc_id
  FROM documents)"""

PAPERS = """papers AS (
  SELECT arxiv_id, title, abstract, primary_category, published, updated, pdf_url, abs_url,
         comment, journal_ref, doi, TIMESTAMP '2024-07-01' AS ingested_at FROM entries)"""

PE = f"""pe AS (
  SELECT {pid('vec_id')} AS paper_id, 'm1' AS model, embedding, len(embedding)::INTEGER AS dim,
         TIMESTAMP '2024-06-01' AS created_at FROM embeddings
  UNION ALL
  SELECT {pid('vec_id')}, 'm2', embedding, len(embedding)::INTEGER, TIMESTAMP '2024-06-01'
  FROM embeddings WHERE vec_id % 4 = 0)"""

QUESTIONS = """questions AS (
  SELECT b.item_id AS question_id, b.text AS question, e.embedding AS qvec
  FROM benchmark b LEFT JOIN embeddings e ON b.item_id = e.vec_id)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- debiased cosine ---------------------------------------------------------------

def _pca_ctes(n_comp: int, squarings: int = 14) -> list[str]:
    """CTEs producing dirs(comp, i, v): the top n_comp unit eigenvectors of
    cov0(i, j, v), by repeated squaring and deflation."""
    out = []
    for t in range(n_comp):
        c = f"cov{t}"
        out.append(f"a{t}_0 AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM {c} WHERE i = j) AS v FROM {c})")
        for s in range(1, squarings + 1):
            prev = f"a{t}_{s - 1}"
            out.append(f"a{t}_{s}r AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v "
                       f"FROM {prev} x JOIN {prev} y ON x.j = y.i GROUP BY x.i, y.j)")
            out.append(f"a{t}_{s} AS MATERIALIZED (SELECT i, j, v / (SELECT sum(v) FROM a{t}_{s}r "
                       f"WHERE i = j) AS v FROM a{t}_{s}r)")
        last = f"a{t}_{squarings}"
        out.append(f"p{t} AS (SELECT i AS jj FROM {last} WHERE i = j ORDER BY v DESC, i LIMIT 1)")
        out.append(f"u{t} AS MATERIALIZED (SELECT a.i, a.v FROM {last} a JOIN p{t} ON a.j = p{t}.jj)")
        out.append(f"d{t} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM u{t}) AS v FROM u{t})")
        out.append(f"l{t} AS (SELECT sum(d1.v * c.v * d2.v) AS lam FROM {c} c "
                   f"JOIN d{t} d1 ON c.i = d1.i JOIN d{t} d2 ON c.j = d2.i)")
        out.append(f"cov{t + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - (SELECT lam FROM l{t}) * d1.v * d2.v AS v "
                   f"FROM {c} c JOIN d{t} d1 ON c.i = d1.i JOIN d{t} d2 ON c.j = d2.i)")
    if n_comp:
        out.append("dirs AS MATERIALIZED (" + " UNION ALL ".join(
            f"SELECT {t} AS comp, i, v FROM d{t}" for t in range(n_comp)) + ")")
    else:
        out.append("dirs AS (SELECT 0 AS comp, 0 AS i, 0.0::DOUBLE AS v WHERE false)")
    return out


def debiased_scores(model: str, ns: tuple[int, ...], center: bool = True) -> list[str]:
    """CTEs ending in scores(question_id, n, paper_id, s): the debiased cosine
    of every question and vector of `model`, for each requested n, rounded
    to 10 places (the ranking key).  Needs entries/pe/questions CTEs."""
    n_comp = max(ns) if center else 0
    values = ", ".join(f"({n})" for n in ns)
    mu = "m.mu" if center else "0.0"
    ctes = [
        f"vecs AS MATERIALIZED (SELECT paper_id, embedding FROM pe WHERE model = '{model}')",
        "elems AS MATERIALIZED (SELECT paper_id, unnest(range(len(embedding))) AS i, "
        "unnest(embedding)::DOUBLE AS v FROM vecs)",
        "nrows AS (SELECT count(*) AS n, max(len(embedding)) AS dim FROM vecs)",
        "mean AS MATERIALIZED (SELECT i, avg(v) AS mu FROM elems GROUP BY i)",
        f"cen AS MATERIALIZED (SELECT e.paper_id, e.i, e.v - {mu} AS c FROM elems e JOIN mean m ON e.i = m.i)",
        "cov0 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.c * b.c) AS v FROM cen a "
        "JOIN cen b ON a.paper_id = b.paper_id GROUP BY a.i, b.i)",
    ]
    ctes += _pca_ctes(n_comp)
    kexpr = "least(n, (SELECT n FROM nrows) // 10, (SELECT dim FROM nrows))" if center else "0"
    ctes += [
        f"variants AS (SELECT n, {kexpr} AS k FROM (VALUES {values}) t(n))",
        "qv AS MATERIALIZED (SELECT question_id, unnest(range(len(qvec))) AS i, unnest(qvec)::DOUBLE AS v "
        "FROM questions)",
        f"qc AS MATERIALIZED (SELECT q.question_id, q.i, q.v - {mu} AS c FROM qv q JOIN mean m ON q.i = m.i)",
        "qp AS MATERIALIZED (SELECT qc.question_id, d.comp, sum(qc.c * d.v) AS p FROM qc JOIN dirs d "
        "ON qc.i = d.i GROUP BY qc.question_id, d.comp)",
        "proj AS MATERIALIZED (SELECT va.n, qp.question_id, d.i, sum(qp.p * d.v) AS s FROM variants va "
        "JOIN qp ON qp.comp < va.k JOIN dirs d ON qp.comp = d.comp GROUP BY va.n, qp.question_id, d.i)",
        "qr AS MATERIALIZED (SELECT va.n, qc.question_id, qc.i, qc.c - coalesce(pr.s, 0) AS r "
        "FROM variants va CROSS JOIN qc LEFT JOIN proj pr ON pr.n = va.n AND pr.question_id = qc.question_id "
        "AND pr.i = qc.i)",
        "qu AS MATERIALIZED (SELECT r.n, r.question_id, r.i, r.r / (nn.nr + 1e-8) AS u FROM qr r JOIN "
        "(SELECT n, question_id, sqrt(sum(r * r)) AS nr FROM qr GROUP BY n, question_id) nn "
        "ON r.n = nn.n AND r.question_id = nn.question_id)",
        "xp AS MATERIALIZED (SELECT cen.paper_id, d.comp, sum(cen.c * d.v) AS p FROM cen JOIN dirs d "
        "ON cen.i = d.i GROUP BY cen.paper_id, d.comp)",
        "xs AS MATERIALIZED (SELECT paper_id, sum(c * c) AS sq FROM cen GROUP BY paper_id)",
        "xd AS MATERIALIZED (SELECT va.n, xs.paper_id, sqrt(greatest(xs.sq - coalesce(("
        "SELECT sum(xp.p * xp.p) FROM xp WHERE xp.paper_id = xs.paper_id AND xp.comp < va.k), 0), 0)) + 1e-8 AS den "
        "FROM variants va CROSS JOIN xs)",
        "dotq AS MATERIALIZED (SELECT qu.n, qu.question_id, cen.paper_id, sum(cen.c * qu.u) AS num "
        "FROM cen JOIN qu ON cen.i = qu.i GROUP BY qu.n, qu.question_id, cen.paper_id)",
        "scores AS MATERIALIZED (SELECT dq.question_id, dq.n, dq.paper_id, round(dq.num / xd.den, 10) AS s "
        "FROM dotq dq JOIN xd ON dq.n = xd.n AND dq.paper_id = xd.paper_id)",
    ]
    return ctes


def papers_minus(label_filter: str) -> str:
    """papers without the documents matching a labels predicate."""
    return (f"papers AS (SELECT arxiv_id, title, abstract, primary_category, published, updated, pdf_url, "
            f"abs_url, comment, journal_ref, doi, TIMESTAMP '2024-07-01' AS ingested_at FROM entries "
            f"WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE {label_filter}))")


def hybrid_ctes(model: str, n: int = 3, rrf_k: int = 60) -> list[str]:
    """CTEs ending in fused(question_id, paper_id, re, rl, rrf); needs
    entries, papers, pe, questions."""
    return debiased_scores(model, (n,)) + [
        "universe AS (SELECT paper_id FROM vecs)",
        "dtext AS (SELECT u.paper_id, coalesce(p.title || ' ' || p.abstract, '') AS text "
        "FROM universe u LEFT JOIN papers p ON p.arxiv_id = u.paper_id)",
        f"dtok AS MATERIALIZED (SELECT paper_id, unnest({tokens('text')}) AS token FROM dtext)",
        f"qtok AS MATERIALIZED (SELECT question_id, unnest({tokens('question')}) AS token FROM questions)",
        "ov AS MATERIALIZED (SELECT q.question_id, d.paper_id, count(*) AS overlap FROM qtok q "
        "JOIN dtok d ON q.token = d.token GROUP BY q.question_id, d.paper_id)",
        "er AS MATERIALIZED (SELECT question_id, paper_id, row_number() OVER (PARTITION BY question_id "
        "ORDER BY s DESC NULLS LAST, paper_id) - 1 AS re FROM scores)",
        "lex AS MATERIALIZED (SELECT s.question_id, s.paper_id, coalesce(ov.overlap, 0) AS overlap FROM scores s "
        "LEFT JOIN ov ON ov.question_id = s.question_id AND ov.paper_id = s.paper_id)",
        "lr AS MATERIALIZED (SELECT question_id, paper_id, overlap, row_number() OVER (PARTITION BY question_id "
        "ORDER BY overlap DESC, paper_id) - 1 AS rl FROM lex)",
        f"fused AS MATERIALIZED (SELECT er.question_id, er.paper_id, er.re, lr.rl, "
        f"1.0::DOUBLE / ({rrf_k} + er.re) + 1.0::DOUBLE / ({rrf_k} + lr.rl) AS rrf FROM er JOIN lr "
        f"ON er.question_id = lr.question_id AND er.paper_id = lr.paper_id)",
        "hyb AS MATERIALIZED (SELECT question_id, paper_id, rrf, row_number() OVER (PARTITION BY question_id "
        "ORDER BY rrf DESC, paper_id) AS rank FROM fused)",
    ]


def raw_cosine_scores(model: str) -> list[str]:
    """scores(question_id, n, paper_id, s) for the plain cosine (n = 0)."""
    return [
        f"vecs AS MATERIALIZED (SELECT paper_id, embedding FROM pe WHERE model = '{model}')",
        "elems AS MATERIALIZED (SELECT paper_id, unnest(range(len(embedding))) AS i, "
        "unnest(embedding)::DOUBLE AS v FROM vecs)",
        "xn AS (SELECT paper_id, sqrt(sum(v * v)) + 1e-8 AS nx FROM elems GROUP BY paper_id)",
        "qv AS MATERIALIZED (SELECT question_id, unnest(range(len(qvec))) AS i, unnest(qvec)::DOUBLE AS v "
        "FROM questions)",
        "qn AS (SELECT question_id, sqrt(sum(v * v)) + 1e-8 AS nq FROM qv GROUP BY question_id)",
        "dotq AS MATERIALIZED (SELECT q.question_id, e.paper_id, sum(e.v * q.v) AS num FROM elems e "
        "JOIN qv q ON e.i = q.i GROUP BY q.question_id, e.paper_id)",
        "scores AS MATERIALIZED (SELECT d.question_id, 0 AS n, d.paper_id, "
        "round((d.num / xn.nx) / qn.nq, 10) AS s FROM dotq d JOIN xn ON d.paper_id = xn.paper_id "
        "JOIN qn ON d.question_id = qn.question_id)",
    ]


ATOM = f"""atom AS (
  SELECT CASE WHEN doc_id % 11 = 0 THEN 'urn:x:' || {pid('doc_id')}
              WHEN doc_id % 7 = 0 THEN 'http://x/abs/cs/' || {pid('doc_id')}
              ELSE 'http://x/abs/' || {pid('doc_id')} END AS id,
         TIMESTAMP '2024-01-01' + to_days(cast(doc_id % 100000 AS INTEGER)) + to_seconds(doc_id % 60) + INTERVAL 750 MILLISECOND AS pub_ts,
         CASE WHEN doc_id % 50 <> 0 THEN split_part(text, chr(10), 1) END AS title,
         text AS summary,
         {AUTHORS} AS authors,
         CASE WHEN doc_id % 6 = 0 THEN 'pages: ' || (doc_id % 40) END AS comment,
         CAST(NULL AS VARCHAR) AS journal_ref,
         doc_id % 3 = 0 AS has_pdf,
         'http://x/files/' || {pid('doc_id')} || '.pdf' AS pdf_href,
         CASE WHEN doc_id % 4 <> 0 THEN source END AS primary_term,
         CASE WHEN doc_id % 8 <> 0 THEN [source, lang] END AS category_terms,
         doc_id
  FROM documents)"""

NORMALIZED = """normalized AS (
  SELECT string_split(id, '/abs/')[-1] AS arxiv_id,
         """ + ws("title") + """ AS title,
         """ + ws("summary") + """ AS abstract,
         authors,
         coalesce(category_terms, []::VARCHAR[]) AS categories,
         coalesce(primary_term, category_terms[1], '') AS primary_category,
         CASE WHEN doc_id % 45 <> 0 THEN date_trunc('second', pub_ts) END AS published,
         date_trunc('second', pub_ts + INTERVAL 1 DAY) AS updated,
         CASE WHEN has_pdf THEN pdf_href ELSE replace(id, '/abs/', '/pdf/') END AS pdf_url,
         id AS abs_url, comment, journal_ref, CAST(NULL AS VARCHAR) AS doi, doc_id
  FROM atom)"""


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"


# --- upsert fixtures ------------------------------------------------------------------

_ECOLS = "arxiv_id, title, abstract, authors, categories, primary_category, published, updated, pdf_url, abs_url, comment, journal_ref"
UPSERT = [
    f"cur AS (SELECT {_ECOLS}, '10.1/' || arxiv_id AS doi, doc_id AS seq FROM entries WHERE doc_id % 3 <> 0)",
    f"inc AS (SELECT arxiv_id, title || ' v2' AS title, abstract, authors, categories, primary_category, published, "
    f"updated, pdf_url, abs_url, comment, journal_ref, doi, doc_id AS seq FROM entries WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 "
    f"UNION ALL SELECT arxiv_id, title || ' v3', abstract, list_reverse(authors), categories, primary_category, "
    f"published, updated, pdf_url, abs_url, comment, journal_ref, doi, doc_id + 1099511627776 FROM entries "
    f"WHERE doc_id % 10 = 0)",
    # current store (the current entries applied to an empty store at 2024-07-01)
    "cur_papers AS (SELECT arxiv_id, title, doi, TIMESTAMP '2024-07-01' AS ingested_at FROM cur)",
    "cur_m AS (SELECT arxiv_id, seq, unnest(authors) AS name, unnest(range(len(authors))) AS pos FROM cur)",
    # ids number the names by first appearance
    "cur_authors AS (SELECT name, row_number() OVER (ORDER BY seq, pos) AS author_id FROM (SELECT * FROM cur_m "
    "QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq, pos) = 1))",
    "cur_pa AS (SELECT m.arxiv_id AS paper_id, a.author_id, m.pos::INTEGER AS author_order "
    "FROM cur_m m JOIN cur_authors a ON a.name = m.name "
    "QUALIFY row_number() OVER (PARTITION BY m.arxiv_id, a.author_id ORDER BY m.seq, m.pos) = 1)",
    # next store after the incoming batch at 2024-08-01
    "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY seq DESC) AS rn FROM inc) "
    "WHERE rn = 1)",
    "next_papers AS (SELECT arxiv_id, title, doi, ingested_at FROM cur_papers WHERE arxiv_id NOT IN "
    "(SELECT arxiv_id FROM inc) UNION ALL SELECT l.arxiv_id, l.title, l.doi, "
    "coalesce(c.ingested_at, TIMESTAMP '2024-08-01') FROM last l LEFT JOIN cur_papers c ON c.arxiv_id = l.arxiv_id)",
    "inc_m AS (SELECT arxiv_id, seq, unnest(authors) AS name, unnest(range(len(authors))) AS pos FROM inc)",
    "next_authors AS (SELECT author_id, name FROM cur_authors UNION ALL "
    "SELECT (SELECT max(author_id) FROM cur_authors) + row_number() OVER (ORDER BY seq, pos), name FROM ("
    "SELECT * FROM inc_m WHERE name NOT IN (SELECT name FROM cur_authors) "
    "QUALIFY row_number() OVER (PARTITION BY name ORDER BY seq, pos) = 1))",
    "inc_pa AS (SELECT m.arxiv_id AS paper_id, a.author_id, m.pos::INTEGER AS author_order "
    "FROM inc_m m JOIN next_authors a ON a.name = m.name "
    "QUALIFY row_number() OVER (PARTITION BY m.arxiv_id, a.author_id ORDER BY m.seq, m.pos) = 1)",
    "next_pa AS (SELECT * FROM cur_pa UNION ALL SELECT i.* FROM inc_pa i ANTI JOIN cur_pa c "
    "ON c.paper_id = i.paper_id AND c.author_id = i.author_id)",
]

VEC_UPSERT = [
    "vin AS ("
    "SELECT " + pid("vec_id") + " AS paper_id, 'm1' AS model, list_transform(embedding, lambda x: x * 2) AS embedding, "
    "vec_id AS seq FROM embeddings WHERE vec_id % 3 = 0 "
    "UNION ALL SELECT " + pid("vec_id") + ", 'm2', list_transform(embedding, lambda x: -x), vec_id FROM embeddings "
    "WHERE vec_id % 3 = 1 "
    "UNION ALL SELECT " + pid("vec_id") + ", 'm1', list_concat(['nan'::FLOAT], embedding[2:]), vec_id + 1099511627776 "
    "FROM embeddings WHERE vec_id % 25 = 0 "
    "UNION ALL SELECT " + pid("vec_id") + ", 'm1', embedding[1:10], vec_id + 2199023255552 FROM embeddings "
    "WHERE vec_id % 35 = 0)",
    "vok AS (SELECT * FROM vin WHERE NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) "
    "OR isinf(x))) AND len(embedding) = (SELECT max(dim) FROM pe p WHERE p.model = vin.model))",
    "vlast AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, model ORDER BY seq DESC) AS rn "
    "FROM vok) WHERE rn = 1)",
    "next_pe AS (SELECT paper_id, model, embedding, dim, created_at FROM pe p WHERE NOT EXISTS (SELECT 1 FROM vlast v "
    "WHERE v.paper_id = p.paper_id AND v.model = p.model) UNION ALL SELECT paper_id, model, embedding, "
    "len(embedding)::INTEGER, TIMESTAMP '2024-08-01' FROM vlast)",
]
