"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra.llm._common import partitions, row_key, written
from papyra.llm.chunks import answer, ask, bucket_keys, by_bucket, chunked, read
from papyra.llm.components import components, smallest_ids
from papyra.llm.words import U64, as_texts, mix64, ngram_hashes, short_hashes, slices, split_words, word_hashes

#: Partners of a group in the second round; it only saves pairs of the last, exact one.
STARS = 6
#: 128-bit key of a row's text.
TEXT = ["__t1", "__t2"]
SIGNATURE = "__id long, __t1 long, __t2 long, __n int, __s1 long, __s2 long, __prefix array<long>, __body array<long>"


def shingle_sets(column, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, set sizes) of the rows of each slice: every row's distinct
    shingles, sorted, one row after the other."""
    for _, texts in slices(as_texts(column)):
        w = split_words(texts, lower=True)
        h = word_hashes(w)
        grams, at = ngram_hashes(h, w.doc, k)
        short, rows = short_hashes(h, w.count, k)
        doc = np.concatenate([w.doc[at], rows])
        if len(rows):
            order = np.argsort(doc, kind="stable")
            grams, doc = np.concatenate([grams, short])[order], doc[order]
        edge = np.searchsorted(doc, np.arange(len(texts) + 1))
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
        yield grams[new], np.bincount(doc[new], minlength=len(texts))


def signatures(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: set size, set fingerprint and, if at least ``percent`` of its
    shingles occur in other documents too, its prefix and its shared shingles.

    The global order of the prefix filter is (document frequency class, hash);
    the frequencies cover all documents.  A shingle of one document matches
    nothing: such shingles come first and are left out of prefix and body, and
    a document with fewer than ``percent`` shared shingles has no link.
    """
    base, n = chunked(docs, id_col, text_col, **dict(zip(TEXT, row_key(F.col(text_col)), strict=True)))

    def keys_of(t: pa.Table):
        sets = list(shingle_sets(t["__text"], k))
        grams = np.concatenate([s for s, _ in sets]) if sets else np.zeros(0, U64)
        sizes = np.concatenate([c for _, c in sets]) if sets else np.zeros(0, np.int64)
        del sets
        return grams, sizes, bucket_keys(grams, n)

    def question(chunk: int, t: pa.Table):
        uniq, count = np.unique(keys_of(t)[2], return_counts=True)
        out = []
        for b, i, j in by_bucket(uniq, n):
            more = np.flatnonzero(count[i:j] > 1)
            data = np.concatenate([[j - i], uniq[i:j] & U64(0xFFFFFFFF), more, count[i:j][more]]).astype(np.uint32)
            out.append((b, chunk, 0, data.tobytes()))
        return out

    def reply(bucket: int, got: list[tuple[int, bytes]]):
        keys, counts = [], []
        for _, data in got:
            x = np.frombuffer(data, np.uint32)
            m, rest = int(x[0]), x[1 + int(x[0]):]
            c = np.ones(m, np.int64)
            c[rest[:len(rest) // 2]] = rest[len(rest) // 2:]
            keys.append(x[1:1 + m])
            counts.append(c)
        _, inv = np.unique(np.concatenate(keys), return_inverse=True)
        df = np.bincount(inv, weights=np.concatenate(counts))
        cls = np.where(df > 1, np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1)))), 0).astype(np.uint8)[inv]
        ends = np.cumsum([len(x) for x in keys])
        return [(bucket, chunk, 0, part.tobytes()) for (chunk, _), part in zip(got, np.split(cls, ends[:-1]), strict=True)]

    def sign(chunk: int, t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        grams, sizes, keys = keys_of(t)
        known = np.frombuffer(answers.get(0, b""), np.uint8)
        cls = np.empty(len(keys), np.uint8)
        uniq = np.unique(keys)
        for at in range(0, len(keys), 1 << 18):
            cls[at:at + (1 << 18)] = known[np.searchsorted(uniq, keys[at:at + (1 << 18)])]
        del keys, uniq
        ends = np.cumsum(sizes)
        starts = ends - sizes

        def sums(x: np.ndarray) -> np.ndarray:
            s = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x, dtype=x.dtype)])
            return s[ends] - s[starts]

        s1, s2 = sums(mix64(grams ^ U64(1))), sums(mix64(grams ^ U64(0xA5A5A5A5A5A5A5A5)))
        shared = sums((cls > 0).astype(np.int64))
        near = np.flatnonzero((sizes > 0) & (100 * shared >= percent * sizes))
        prefix, body = [], []
        plen, blen = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int32)
        for d in near:
            c, g = cls[starts[d]:ends[d]], grams[starts[d]:ends[d]]
            size = int(sizes[d])
            g, c = g[c > 0], c[c > 0]
            first = size - (percent * size + 99) // 100 + 1 - (size - len(g))
            prefix.append(g[np.argsort(c, kind="stable")[:first]])
            body.append(g)
            plen[d], blen[d] = len(prefix[-1]), len(g)

        def lists(parts: list[np.ndarray], lengths: np.ndarray) -> pa.Array:
            flat = np.concatenate(parts) if parts else np.zeros(0, U64)
            return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), flat.view(np.int64))

        return pa.table({"__id": t["__id"], "__t1": t["__t1"], "__t2": t["__t2"], "__n": sizes.astype(np.int32), "__s1": s1.view(np.int64), "__s2": s2.view(np.int64),
                         "__prefix": lists(prefix, plen), "__body": lists(body, blen)})

    return read(base, answer(ask(base, question), reply), sign, SIGNATURE)


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    a = classes.select(F.col("__rep").alias("a"), F.col("__n").alias("__na"), F.col("__body").alias("__ba"))
    b = classes.select(F.col("__rep").alias("b"), F.col("__n").alias("__nb"), F.col("__body").alias("__bb"))
    both = F.size(F.array_intersect("__ba", "__bb"))
    return pairs.join(a, "a").join(b, "b").where(
        both * 100 >= (F.col("__na") + F.col("__nb") - both) * percent).select("a", "b")


def settle(rows: DataFrame, place: DataFrame, classes: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """(a, b): links between parts that still share prefix shingles; enough of
    them to join all parts that any link joins.

    The part with most members at a shingle is its hub.  A link between parts
    shares a prefix shingle, so one of its ends is an outsider of that shingle's
    hub, and the other one is a member or an outsider of the same hub.  Outsiders
    and members of a hub are cut into blocks by hash; each block of outsiders meets
    each block of either in a task, which counts intersections exactly and returns
    one link per outsider and part at most.  Sets move once per block, never as
    pairs."""
    at = rows.select("__e", "__gid").join(place, "__gid")
    votes = at.groupBy("__e", "comp").agg(F.count("*").alias("__k")).groupBy("__e").agg(
        F.max(F.struct("__k", (-F.col("comp")).alias("__h"))).alias("__x")).select("__e", (-F.col("__x.__h")).alias("__hub"))
    roles = at.join(votes, "__e").select("__hub", "__rep", "comp").distinct().withColumn("__out", F.col("comp") != F.col("__hub"))
    roles = written(roles, "roles")
    sizes = roles.groupBy("__hub").agg(F.ceil(F.count_if(~F.col("__out")) / F.lit(block)).alias("__m"),
                                       F.ceil(F.count_if("__out") / F.lit(block)).alias("__o"))
    spot = F.xxhash64("__rep")
    r = roles.join(sizes.where("__o > 0"), "__hub")
    zero = F.lit(0).cast("long")
    # left: a block of outsiders, against each block; right: a block, against each block of outsiders
    left = r.where("__out").withColumn("__i", F.pmod(spot, "__o")).withColumn(
        "__j", F.explode(F.sequence(zero, F.col("__m") + F.col("__o") - 1))).withColumn("__left", F.lit(True))
    own = F.when(F.col("__out"), F.col("__m") + F.pmod(spot, F.greatest("__o", F.lit(1)))).otherwise(
        F.pmod(spot, F.greatest("__m", F.lit(1))))
    right = r.withColumn("__j", own).withColumn("__i", F.explode(F.sequence(zero, F.col("__o") - 1))).withColumn("__left", F.lit(False))
    cells = left.unionByName(right).select("__rep", "comp", "__left", F.xxhash64("__hub", "__i", "__j").alias("__g"))
    cells = cells.join(classes.select("__rep", "__n", "__body"), "__rep").withColumn(
        "__p", F.pmod("__g", F.lit(4 * partitions(place.sparkSession))))

    def judge(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("__g", "ascending"), ("__left", "descending"), ("__rep", "ascending")]).combine_chunks()
        cell, rep, comp = t["__g"].to_numpy(), t["__rep"].to_numpy(), t["comp"].to_numpy()
        size, is_left = t["__n"].to_numpy(), t["__left"].to_numpy(zero_copy_only=False)
        lists = t["__body"].combine_chunks() if isinstance(t["__body"], pa.ChunkedArray) else t["__body"]
        edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
        out = ([], [])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            m = a + int(is_left[a:b].sum())
            if m in (a, b):
                continue
            sets = lists.slice(a, b - a)
            uniq, index = np.unique(sets.flatten().to_numpy(), return_inverse=True)
            ends = np.cumsum(pc.list_value_length(sets).to_numpy())
            first, base = ends[m - a - 1], ends[m - a:] - ends[m - a - 1]
            others, held = index[first:], np.zeros(len(uniq), bool)
            for i in range(m - a):
                mine = index[(ends[i - 1] if i else 0):ends[i]]
                held[mine] = True
                sums = np.concatenate([[0], np.cumsum(held[others])])
                both = np.diff(sums[np.concatenate([[0], base])])
                held[mine] = False
                hit = np.flatnonzero((both * (100 + percent) >= percent * (size[a + i] + size[m:b])) & (comp[m:b] != comp[a + i]))
                if len(hit):
                    _, one = np.unique(comp[m:b][hit], return_index=True)
                    out[0].append(np.full(len(one), rep[a + i]))
                    out[1].append(rep[m:b][hit[one]])
        x, y = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
        return pa.table({"a": x, "b": y})

    return cells.groupBy("__p").applyInArrow(judge, "a long, b long").distinct()


def joined(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __t1, __t2, __n, __s1, __s2, __comp, __low) for every row: its text's key,
    its set's size and fingerprint, its component (null without links to it) and the smallest id there.

    Documents link when their sets of ``k``-word shingles (64-bit hashes; A-Z
    lower-cased) have a Jaccard similarity of ``percent`` or more; component_id
    is the smallest id reachable.

    1. Equal sets collapse into one class, equal (prefix, size) into one group.
    2. Every member is compared with its group's first and with one partner of
       its group: of the groups with most documents at a prefix shingle, the one
       that shares most of the prefix.  Links found join classes into parts.
       Where parts still share prefix shingles, up to STARS more partners follow.
    3. Members of parts that still share prefix shingles are compared in blocks
       (see ``settle``).  A link within a part would not change it, so the
       components are those of all links, and a large group of copies never
       becomes all its pairs.
    """
    sig = written(signatures(docs, k, percent, id_col, text_col), "signatures")
    key = ["__n", "__s1", "__s2"]
    near = sig.where("size(__prefix) > 0 and __id is not null")
    # classes get numbers of their own, fixed by the write: rows of different texts may share an id
    classes = written(near.groupBy(*key).agg(F.min("__id").alias("__low"), F.count("*").alias("__m"), F.first("__prefix").alias("__prefix"),
                                             F.first("__body").alias("__body"))
                      .withColumns({"__rep": F.monotonically_increasing_id(), "__p1": F.xxhash64("__n", "__prefix"), "__p2": F.xxhash64(F.lit("p"), "__n", "__prefix")}),
                      "classes")
    groups = written(classes.groupBy("__n", "__p1", "__p2").agg(
        F.min("__rep").alias("__gid"), F.sum("__m").alias("__m"), F.first("__prefix").alias("__prefix")), "groups")
    members = written(classes.select("__rep", "__n", "__p1", "__p2").join(
        groups.select("__p1", "__p2", "__gid"), ["__p1", "__p2"]).select("__rep", "__n", "__gid"), "members")
    # a shingle's place in its document's whole order: shingles of one document come first
    own = F.col("__n") - F.floor((percent * F.col("__n") + 99) / F.lit(100)) + 1 - F.size("__prefix")
    entries = groups.select("__gid", "__n", "__m", own.alias("__own"), F.posexplode("__prefix").alias("__at", "__e"))
    entries = entries.withColumn("__at", F.col("__at") + F.col("__own"))

    def can_link(n1, n2, at1, at2):
        """Whether sets of these sizes that first meet at these places can be near enough."""
        left = F.least(n1 - at1, n2 - at2)
        return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent) & (left * (100 + percent) >= (n1 + n2) * percent)

    def partners(rows: DataFrame, centres: DataFrame, most: int) -> DataFrame:
        """(__gid, b): of the centres of a group's shingles, those that share most of them."""
        both = rows.join(centres, "__e").where(F.col("__c.__gid") != F.col("__gid")).where(
            can_link(F.col("__n"), F.col("__c.__n"), F.col("__at"), F.col("__c.__at")))
        shared = both.groupBy("__gid", F.col("__c.__gid").alias("b")).agg(F.count("*").alias("__k"))
        rank = F.row_number().over(Window.partitionBy("__gid").orderBy(F.desc("__k"), "b"))
        return shared.withColumn("__r", rank).where(F.col("__r") <= most).select("__gid", "b")

    def placed(links: DataFrame) -> DataFrame:
        return written(members.join(links.withColumnRenamed("v", "__rep"), "__rep", "left")
                       .withColumn("comp", F.coalesce("comp", "__rep")), "placed")

    def unsettled(place: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Each group's least and greatest part, and the entries of shingles that parts share."""
        span = place.groupBy("__gid").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"))
        rows = entries.join(span, "__gid")
        mixed = rows.groupBy("__e").agg(F.min("__lo").alias("x"), F.max("__hi").alias("y")).where("x <> y").select("__e")
        return span, rows.join(mixed, "__e", "left_semi")

    spot = ["__gid", "__n", "__at"]
    centre = entries.groupBy("__e").agg(F.max(F.struct("__m", (-F.col("__gid")).alias("__o"), *spot)).alias("__c"),
                                        F.count("*").alias("__k")).where("__k > 1").select("__e", "__c")
    first = members.join(partners(entries, centre, 1), "__gid").select(F.col("__rep").alias("a"), "b").unionByName(
        members.where("__rep <> __gid").select(F.col("__rep").alias("a"), F.col("__gid").alias("b")))
    place = placed(components(verified(first, classes, percent)))

    # groups of near copies without a common original: more partners, drawn by hash
    _, rows = unsettled(place)
    drawn = rows.groupBy("__e").agg(F.array(*[F.min(F.struct(F.xxhash64(F.lit(i), "__gid").alias("__o"), *spot))
                                              for i in range(STARS)]).alias("__c"))
    drawn = drawn.select("__e", F.explode(F.array_distinct("__c")).alias("__c"))
    more = partners(rows, drawn, STARS).join(place.select("__gid", F.col("__rep").alias("a"), F.col("comp").alias("ca")), "__gid").join(
        place.select(F.col("__rep").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").select("a", "b")
    parts = components(place.where("__rep <> comp").select(F.col("__rep").alias("a"), F.col("comp").alias("b")).unionByName(
        verified(more, classes, percent)))
    place = placed(parts)

    _, rows = unsettled(place)
    late = settle(rows, place, classes, percent)
    links = parts.where("v <> comp").select(F.col("v").alias("a"), F.col("comp").alias("b")).unionByName(late)
    named = classes.select(*key, "__rep").join(smallest_ids(components(links), classes), "__rep").select(
        *key, F.col("comp").alias("__comp"), "__low")
    return sig.select("__id", *TEXT, *key).join(named, key, "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Documents link when their sets of ``k``-word shingles (64-bit hashes; A-Z
    lower-cased) have a Jaccard similarity of ``percent`` or more; component_id
    is the smallest id reachable.  See ``joined`` for the method.

    Defined cases: null and empty texts have no shingles and link with nothing,
    so do rows with a null id (component_id null); fewer than ``k`` words are one
    shingle; equal rows each get a row; rows that repeat an id are judged each by
    its own text; other columns are not read; an empty table gives an empty one.
    """
    return joined(docs, k, percent, id_col, text_col).select(
        F.col("__id").alias(id_col), F.col("__n").cast("long").alias("n_shingles"),
        F.when(F.col("__id").isNotNull(), F.coalesce("__low", "__id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with
    the smallest id, and of several texts with that id the one that
    hashes least.  Rows equal in id and text collapse; rows of one id whose
    texts are not near each other are judged apart; rows without an id all stay.
    """
    keyed = docs.withColumns({"__id": F.col(id_col).cast("long"), **dict(zip(TEXT, row_key(F.col(text_col)), strict=True))})
    rows = written(joined(docs, k, percent, id_col, text_col).where("__id is not null and __comp is not null")
                   .select("__id", *TEXT, "__comp", "__low").distinct(), "members")
    heads = rows.where("__id = __low")
    pick = F.struct(*TEXT)
    several = heads.groupBy("__comp").agg(F.min(pick).alias("__first"), F.count("*").alias("__k")).where("__k > 1")
    others = heads.join(several.select("__comp", "__first"), "__comp").where(pick != F.col("__first"))
    gone = rows.where("__id <> __low").select("__id", *TEXT).unionByName(others.select("__id", *TEXT))
    one = keyed.where("__id is not null").join(gone, ["__id", *TEXT], "left_anti").dropDuplicates(["__id", *TEXT])
    return one.select(*[f"`{c}`" for c in docs.columns]).unionByName(
        keyed.where("__id is null").select(*[f"`{c}`" for c in docs.columns]))
