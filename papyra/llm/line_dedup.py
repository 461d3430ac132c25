"""Line dedup: drop the lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import WHITE, ascii_lower, row_key, written


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, salts: int = 16,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its common lines removed.

    Lines are split at ``\\n``; a line whose key has at least ``min_chars`` code
    points and occurs in at least ``min_docs`` documents goes everywhere.  Adds
    ``n_lines`` (before) and ``n_dropped``; ``text_col`` holds what is left,
    joined by ``\\n``.

    Distinct keys are taken within each row, so a line that a document repeats
    counts once and costs one counter; counts combine before the shuffle.  Rows
    of an id that occurs more than once are one document: what they count too
    much is taken off again, by a pass over those rows alone.  Only
    hashes and positions are joined, salted by document: the rows of a line of a
    third of all documents go to ``salts`` tasks, which AQE can split further.

    Defined cases: null and empty texts are one empty line, which is never
    dropped; a text whose lines all go becomes empty; rows that repeat an id
    count as one document and each keep a row of their own; a null id is an id
    like any other; input columns named ``n_lines`` or ``n_dropped`` are
    replaced, all others stay; an empty table gives an empty one.
    """
    def split(d: DataFrame) -> DataFrame:
        return d.withColumn("__lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))

    base = (split(docs)
            .withColumns({c: k for c, k in zip(("__k1", "__k2"), row_key(F.col(id_col), F.col(text_col)), strict=True)}))
    hashed = base.select("__k1", "__k2", F.posexplode("__lines").alias("__pos", "__line"))
    hashed = hashed.withColumn("__key", line_key(F.col("__line"))).where(F.length("__key") >= min_chars)
    hashed = hashed.select("__k1", "__k2", "__pos", F.xxhash64("__key").alias("__h1"),
                           F.xxhash64(F.lit("line"), "__key").alias("__h2"))

    keys = F.array_distinct(F.transform(F.filter(F.transform("__lines", line_key), lambda x: F.length(x) >= min_chars),
                                        lambda x: F.struct(F.xxhash64(x).alias("a"),
                                                           F.xxhash64(F.lit("line"), x).alias("b"))))
    h = [F.col("__h.a").alias("__h1"), F.col("__h.b").alias("__h2")]
    seen = base.select(F.explode(keys).alias("__h")).select(*h, F.lit(1).cast("long").alias("__c"))
    again = written(docs.groupBy(F.col(id_col).alias("__again")).count().where("count > 1").select("__again"), "repeated_ids")
    surplus = (split(docs.join(again, F.col(id_col).eqNullSafe(F.col("__again")), "left_semi"))
               .select(F.col(id_col).alias("__id"), F.explode(keys).alias("__h")).groupBy("__id", *h)
               .agg((1 - F.count("*")).alias("__c")).where("__c < 0").drop("__id"))
    common = (seen.unionByName(surplus).groupBy("__h1", "__h2").agg(F.sum("__c").alias("__c"))
              .where(F.col("__c") >= min_docs).select("__h1", "__h2"))

    hashed = hashed.withColumn("__salt", F.pmod("__k1", F.lit(salts)).cast("int"))
    common = common.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    gone = (hashed.join(common, ["__h1", "__h2", "__salt"], "left_semi").groupBy("__k1", "__k2")
            .agg(F.sort_array(F.collect_set("__pos")).alias("__gone")))
    # lines between two dropped positions stay together: one slice each, in order
    cuts = F.concat(F.array(F.lit(-1)), F.col("__gone"), F.array(F.size("__lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("__gone")),
                       lambda i: F.slice("__lines", F.get(cuts, i) + 2, F.get(cuts, i + 1) - F.get(cuts, i) - 1))
    kept = F.when(F.col("__gone").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(
        F.array_join(F.flatten(runs), "\n"))
    out = base.join(gone, ["__k1", "__k2"], "left")
    return (out.withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
            .withColumn(text_col, kept)
            .drop("__lines", "__gone", "__k1", "__k2"))
