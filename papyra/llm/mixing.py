"""Mixing sources to target token weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._common import WORD, row_key, written

LN2 = math.log(2.0)
SRC = ["__src", "__none"]


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_copies: float) -> DataFrame:
    """One row per source with its ``target``: weights by rank of the source's
    code points (null last), repeating; what is above ``max_copies`` times the
    source's size is shared again by weight among the others.

    ``sizes`` has one row per source (__src, __none, source_size).  The level
    ``x`` with sum(min(cap, x * weight)) = total is found by Newton's method,
    which is finite here as the sum is concave and piecewise linear.  The rank
    is a window over the sources alone, not over rows of documents.
    """
    rank = F.row_number().over(Window.orderBy("__none", "__src")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    t = written(sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(max_copies))), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else (F.col("__cap") <= F.col("__w") * level)
        a = t.agg(F.count_if(full), F.sum(F.when(full, F.col("__cap")).otherwise(0.0)),
                  F.sum(F.when(full, 0.0).otherwise(F.col("__w")))).first()
        if not a[2] or a[0] == capped:
            break
        level, capped = (float(total) * share - a[1]) / a[2], a[0]
    return t.withColumn("target", F.least("__cap", F.col("__w") * F.lit(float(level or 0.0)))).drop("__w", "__cap")


def dual_step(hist: DataFrame, state: DataFrame) -> DataFrame:
    """One safeguarded Newton step of the dual for every source.

    The dual's gradient is sum(n * z * min(2, exp(lam * z))) - target; sums are
    decimal, so they do not depend on the order of their terms.
    """
    x = F.col("__lam") * F.col("__z")
    rate = F.when(x >= F.lit(LN2), F.lit(2.0)).otherwise(F.exp(x))
    mass = F.col("__n") * F.col("__z") * rate
    slope = F.when(x >= F.lit(LN2), F.lit(0.0)).otherwise(mass * F.col("__z"))
    keep = [c for c in state.columns if c not in ("__f",)]
    t = (hist.join(state.drop("__f"), SRC).groupBy(*keep)
         .agg(F.sum(mass.cast("decimal(38,9)")).cast("double").alias("__f"),
              F.sum(slope.cast("decimal(38,9)")).cast("double").alias("__g")))
    gap = F.col("__f") - F.col("target")
    t = (t.withColumn("__lo", F.when(gap < 0, F.col("__lam")).otherwise(F.col("__lo")))
         .withColumn("__hi", F.when(gap >= 0, F.col("__lam")).otherwise(F.col("__hi"))))
    newton = F.col("__lam") - gap / F.when(F.col("__g") > 0, F.col("__g"))
    inside = newton.isNotNull() & (newton > F.col("__lo")) & (newton < F.col("__hi"))
    done = F.abs(gap) <= F.col("target") * 1e-9
    return t.withColumn("__lam", F.when(done, F.col("__lam")).when(inside, newton).otherwise(
        (F.col("__lo") + F.col("__hi")) / 2)).drop("__g")


def solve_dual(hist: DataFrame, targets: DataFrame, tol: float = 1e-8, rounds: int = 16, steps: int = 4) -> DataFrame:
    """The tilt ``__lam`` of every source, by distributed Newton iterations.

    Four steps make one job; its small result (a row per source) is written to
    the shared folder.  Stops when every source is within ``tol`` of its target.
    """
    ratio = F.col("target") / F.col("source_size")
    second = hist.groupBy(*SRC).agg((F.sum(F.col("__n") * F.col("__z") * F.col("__z"))
                                     / F.sum(F.col("__n") * F.col("__z"))).alias("__mean"))
    state = targets.where("source_size > 0").join(second, SRC).select(
        *SRC, "source_size", "target",
        F.when(ratio >= 2.0, F.lit(LN2)).when(ratio == 1.0, F.lit(0.0)).otherwise(F.log(ratio) / F.col("__mean")).alias("__lam"),
        F.when(ratio < 1.0, F.log(ratio) * 1.000001).otherwise(F.lit(0.0)).alias("__lo"),
        F.when(ratio < 1.0, F.lit(0.0)).otherwise(F.lit(LN2 * 1.000001)).alias("__hi"))
    for _ in range(rounds):
        for _ in range(steps):
            state = dual_step(hist, state)
        state = written(state, "dual")
        worst = state.agg(F.max(F.abs(F.col("__f") - F.col("target")) / F.col("target"))).first()[0]
        if worst is None or worst <= tol:
            break
    return state.select(*SRC, "__lam")


def entropy_copies(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5,
                   block_docs: int = 512, salts: int = 16, id_col: str = "doc_id", text_col: str = "text",
                   source_col: str = "source") -> DataFrame:
    """How often each distinct row of ``docs`` goes into the mix.

    Rates minimise relative entropy to one copy each, under each source's
    token target and at most two copies: ``min(2, exp(lam_s * size))``.  They are
    rounded to 0, 1 or 2 copies in hashed blocks of about ``block_docs`` rows of
    one source, largest first, each choice carrying the words that the last ones
    left over; so a source of any share of the rows spreads over as many blocks
    as it needs, and its rows meet its tilt in ``salts`` tasks, not one.
    Everything is hashed or decimal: reruns agree.

    Returns __k1, __k2 (key of id, text and source), __id, __n (equal rows),
    size, source_size, target, copies.

    Defined cases: null and empty texts have size 0 and one copy; a null source
    is a source, ranked last; equal rows get equal copies; a table without words
    has targets of 0; other columns are not read.
    """
    items = (docs.select(*row_key(F.col(id_col), F.col(text_col), F.col(source_col)), F.col(id_col).alias("__id"),
                         n_words(F.col(text_col)).alias("size"), F.coalesce(F.col(source_col), F.lit("")).alias("__src"),
                         F.col(source_col).isNull().alias("__none"))
             .groupBy("__k1", "__k2", "__id", "size", *SRC).agg(F.count("*").alias("__n")))
    items = written(items, "items")
    hist = written(items.where("size > 0").groupBy(*SRC, F.col("size").alias("__z")).agg(F.sum("__n").alias("__n")), "hist")
    sizes = items.groupBy(*SRC).agg(F.sum(F.col("size") * F.col("__n")).alias("source_size"), F.count("*").alias("__rows"))
    targets = source_targets(sizes, weights, share, 2.0)
    tilt = solve_dual(hist, targets.drop("__rows"))
    per_source = targets.join(tilt, SRC, "left").withColumn("__lam", F.coalesce("__lam", F.lit(0.0)))

    # a source may hold a third of all rows: they are dealt by salt, its one row goes to every salt
    per_salt = per_source.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = items.withColumn("__salt", F.pmod("__k1", F.lit(salts)).cast("int"))
    rows = salted.join(per_salt, [*SRC, "__salt"]).drop("__salt").withColumn("__rate", F.least(F.lit(2.0), F.exp(
        F.least(F.lit(1.0), F.col("__lam") * F.col("size")))))
    block = F.pmod(F.xxhash64("__k2", "__k1"), F.ceil(F.col("__rows") / F.lit(block_docs)))
    rows = rows.withColumn("__block", block).withColumn("__neg", -F.col("size") * F.col("__n"))
    member = ["__neg", "__k1", "__k2", "__id", "__n", "size", "__rate"]
    blocks = rows.groupBy(*SRC, "__block", "source_size", "target").agg(
        F.sort_array(F.collect_list(F.struct(*member))).alias("__m"))

    def choose(acc, m):
        mass = -m["__neg"].cast("double")
        want = acc["carry"] + m["__rate"] * mass
        c = F.when(mass == 0, F.lit(1)).otherwise(
            F.least(F.lit(2), F.greatest(F.lit(0), F.round(want / F.when(mass > 0, mass)).cast("int"))))
        return F.struct((want - c * mass).alias("carry"), F.concat(acc["out"], F.array(c)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<int>").alias("out"))
    chosen = blocks.withColumn("__c", F.aggregate("__m", start, choose)["out"])
    flat = chosen.select("source_size", "target", F.explode(F.arrays_zip("__m", "__c")).alias("__x"))
    return flat.select(*[F.col(f"__x.__m.{c}").alias(c) for c in ("__k1", "__k2", "__id", "__n", "size")],
                       "source_size", "target", F.col("__x.__c").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        copy_col: str | None = None, **how) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``entropy_copies`` says, columns
    unchanged but ``copy_col``, if named, which numbers a row's copies from 1."""
    copies = entropy_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    k1, k2 = row_key(F.col(id_col), F.col(text_col), F.col(source_col))
    keyed = docs.withColumns({"__k1": k1, "__k2": k2})
    out = keyed.join(copies.where("copies > 0").select("__k1", "__k2", "copies").withColumnRenamed("copies", "__copies"),
                     ["__k1", "__k2"])
    return out.withColumn("__i", F.explode(F.sequence(F.lit(1), "__copies"))).select(
        *[F.col("__i" if c == copy_col else f"`{c}`").alias(c) for c in docs.columns])
