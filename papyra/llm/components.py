"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm._common import written


def components(links: DataFrame) -> DataFrame:
    """(v, comp) for every vertex of ``links`` (a, b: long): the smallest vertex
    that it reaches.

    Each round takes the smallest label among neighbours and then the label of
    that label, so chains shorten by doubling; labels are written to the shared
    folder each round.  Vertices of any degree work: the smallest label is
    combined before the shuffle.
    """
    e = written(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))
                                                                   .where("a <> b")).distinct(), "edges")
    lab = written(e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                  .select("v", F.least("v", "m").alias("comp")), "labels")
    while True:
        near = e.join(lab.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("comp").alias("m"))
        step = lab.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("c"))
        jump = lab.select(F.col("v").alias("c"), F.col("comp").alias("c2"))
        new = written(step.join(jump, "c").select("v", "old", F.least("c", "c2").alias("comp")), "labels")
        lab, changed = new.select("v", "comp"), new.where("old <> comp").limit(1).count()
        if not changed:
            return lab


def smallest_ids(parts: DataFrame, classes: DataFrame, salts: int = 16) -> DataFrame:
    """(__rep, comp, __low) for every class (__rep, __low: its smallest id): its
    component and the smallest id of that component.

    Classes are numbered apart from ids, as rows of different content may share
    an id; one without links is its own component.
    """
    linked = parts.withColumnRenamed("v", "__rep").join(classes.select("__rep", "__low"), "__rep").withColumn(
        "__salt", F.pmod("__rep", F.lit(salts)))
    # one component may hold a third of all classes: its rows meet its smallest id in ``salts`` tasks
    least = linked.groupBy("comp").agg(F.min("__low").alias("__least")).withColumn(
        "__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    known = linked.join(least, ["comp", "__salt"]).select("__rep", "comp", "__least")
    return classes.select("__rep", "__low").join(known, "__rep", "left").select(
        "__rep", F.coalesce("comp", "__rep").alias("comp"), F.coalesce("__least", "__low").alias("__low"))
