"""Registered queries of the operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm._common import table


def op1_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.embedding_dedup import near_vectors
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.collision_search import nearest
    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def remainder(id_col: str, n: int):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def judged(scored: DataFrame, n: int, held: int, cut: float) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", n) == held).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm import quality
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(remainder("doc_id", 3) != 1), "quality")
    return judged(quality.score(docs, model), 3, 1, 0.5)


def op8_toxic_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm import toxicity
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 4) != 2), "toxic")
    return judged(toxicity.score(docs, model), 4, 2, 0.3)


def op3_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papyra.llm import piece_dropout
    model = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_dropout.encode(table(spark, sf_dir, "documents"), model, dropout=0.1, seed=1)
    return piece_dropout.decode(ids, model).select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))


def op5_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papyra.llm import token_files
    docs = table(spark, sf_dir, "documents")
    out = token_files.token_dir(docs)
    files = token_files.write_tokens(docs, out, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_tokens(files, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.mixing import entropy_copies
    c = entropy_copies(table(spark, sf_dir, "documents"))
    return c.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(
        F.col("__id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.ngram_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=80)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.line_dedup import drop_common_lines
    d = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.substring_dedup import drop_repeats
    d = drop_repeats(table(spark, sf_dir, "documents"), window=20)
    return d.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.embedding_whitening import whiten
    w = whiten(table(spark, sf_dir, "embeddings"), components=8, weights="count")
    w = w.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("__i", "__c"))
    return w.select("vec_id", (F.col("__i") + 1).alias("component"), "n", "deviation", "__c.whitened", "__c.explained", "identity_error")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from papyra.llm.filter_audit import audit
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from papyra.llm.best_fit_packing import pack
    p = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, most=1024)
    # the ids stay in their table; their checksum goes to the places
    return p.rows("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_rotation_codes, op2_subword_quality, op3_piece_dropout, op4_collision_counting, op5_token_frames, op6_entropy_mixing, op7_ngram_jaccard, op8_toxic_grammar, op9_line_dedup, op10_substring_dedup, op11_embedding_whitening, op12_filter_audit, op13_best_fit_packing)}

WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

WORDS_SQL = "[^\\x20\\x09-\\x0D]+"
LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op10_substring_dedup": f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM w),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS h FROM starts),
dups AS (SELECT doc_id, p FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM wins) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM dups),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, count(g.i) AS n_removed,
    string_agg(x, ' ' ORDER BY word.i) FILTER (WHERE g.i IS NULL) AS t
  FROM word LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op7_ngram_jaccard": f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce({LOWER_SQL}, ''), '{WORDS_SQL}') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS MATERIALIZED (SELECT s, count(*) AS c FROM sh GROUP BY s),
ranked AS (
  SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY c, s) AS r
  FROM sh JOIN df USING (s) JOIN n USING (doc_id)),
pre AS MATERIALIZED (SELECT doc_id, s, n FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
cand AS MATERIALIZED (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM pre a JOIN pre b
  ON a.s = b.s AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
inter AS (
  SELECT a, b, count(*) AS i FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
links AS MATERIALIZED (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents UNION
  SELECT b, r FROM reach JOIN both_ways ON a = v)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v) c USING (doc_id)""",
    "op9_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, {WHITE_SQL}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common c USING (k) GROUP BY doc_id""",
    "op12_filter_audit": f"""
WITH lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t
  FROM labels GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
    regexp_extract_all(coalesce(text, ''), '{WORDS_SQL}') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents),
f AS (
  SELECT part, coalesce(g, 0) AS g, coalesce(t, 0) AS t,
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN lab USING (doc_id)),
cells AS (SELECT part, fails, count(*) AS n, sum(g) AS g, sum(t) AS t FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT o, s, substr(o, s, 1) AS l, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)),
counts AS (
  SELECT part, o, s, l,
    sum(CASE WHEN translate(before || l, fails, '') = before || l THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, l) AND translate(before, fails, '') = before THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, l) AND translate(before, fails, '') <> before THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, l) AND translate(before, fails, '') = before THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, l) AND translate(before, fails, '') = before THEN t ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY part, o, s, l)
SELECT part, o AS filter_order, s::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, l))::BIGINT AS shapley
FROM counts""",
}
