"""Source divergence audit with count-level bitmaps.

How far do the sources of a language differ in the terms they use?  A term is a run of
letters A-Z or of characters from U+0080 on, in lower case as to A-Z.  Each language
keeps the terms of at least ``MIN_DOCS`` of its documents.  With ``count`` occurrences of
a kept term in a group of language and source, ``N`` in all and ``V`` kept terms,
``p = 1 + floor(SCALE * (count + 2) / (N + 2 V))``, and two groups differ in the term
by ``f = floor((p - q)^2 / (p + q))``.

The value of two sources is the sum of ``f`` over all kept terms.  ``p`` depends on the
count alone, so the terms of a group are stored as one bitset of term ids per count.
AND and popcount of two bitsets give the number of terms in a joint cell of two counts,
which is multiplied by the cell's ``f``.  No bitset is kept for count zero: with ``n`` the
terms of a count and ``j`` those of joint cells,

    sum f = sum j (f(c,d) - f(c,0) - f(0,d) + f(0,0))
          + sum n_g(c) (f(c,0) - f(0,0)) + sum n_h(d) (f(0,d) - f(0,0)) + V f(0,0)

so that joint cells are only made of groups that have terms, and zeros follow by
complement.  Term ids are numbered in blocks of terms of like frequency (a block has few
counts, or few terms to a count); a task holds the bitsets of one block and of two tiles of
groups, wherever a hot source has its terms.  All arithmetic is exact.

Defined results: NULL text, lang and source are empty strings, so they form groups like
others; long texts are read whole; repeated rows count as documents of their own; equal
values rank by item as UTF-8 bytes; a group without terms has counts of zero and takes
part in all pairs; with no kept term every value is 0 and there are no term rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import cut_lineage
from tidemark.operators.skew import broadcast_if_small

MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
BLOCK_TERMS = 384
TILE = 64  # groups of a language that meet in one task
HELD = 500_000  # counters a task holds before it passes them on

_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def terms(text: str | None) -> list[bytes]:
    """The terms of a whole text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n)`` of parts of the corpus: occurrences per group, and with a
    NULL source the documents of the language that have the term.

    A task counts in a bounded table first, so that a frequent term is few rows a task.
    """

    def rows(lang: str, source: str | None, held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(lang, pa.string()), len(held)), pa.repeat(pa.scalar(source, pa.string()), len(held)),
             pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
            ["lang", "source", "term", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str | None], Counter] = {}
        size = 0
        for batch in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in batch.columns)):
                count, seen = held.setdefault((lang, source), Counter()), held.setdefault((lang, None), Counter())
                size -= len(count) + len(seen)
                found = terms(text)
                count.update(found)
                seen.update(set(found))
                size += len(count) + len(seen)
                if size + len(held) > HELD:
                    yield from (rows(*key, counted) for key, counted in held.items() if counted)
                    held, size = {}, 0
        yield from (rows(*key, counted) for key, counted in held.items() if counted)

    return plain_columns(docs, "text").mapInArrow(run, "lang string, source string, term binary, n long")


def plain_columns(docs: DataFrame, *more: str) -> DataFrame:
    """Columns ``more``, lang and source with NULL as the empty string."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*more, "lang", "source")])


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """``(lang, source, term, n, total, class, first)`` of the kept terms of each group.

    One shuffle by language and term brings the parts of a term together; its groups, its
    documents and its occurrences ``total`` are added up there.  ``first`` marks one row a term.
    """
    counted = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    of_term = Window.partitionBy("lang", "term")
    group = F.col("source").isNotNull()
    return (
        counted.withColumns({
            "_docs": F.sum(F.when(~group, F.col("n"))).over(of_term),
            "total": F.sum(F.when(group, F.col("n"))).over(of_term),
            "_no": F.row_number().over(of_term.orderBy(F.col("source").asc_nulls_first())),
        })
        .filter(group & (F.col("_docs") >= min_docs))
        .select("lang", "source", "term", "n", "total", F.floor(F.log2("total")).cast("int").alias("class"),
                (F.col("_no") == 2).alias("first"))
    )


def p_of(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (N + 2 V))``, in decimals where 64 bits don't hold it."""
    wide = (F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")).cast("decimal(38,0)")
    far = F.call_function("div", wide, (total + 2 * kept).cast("decimal(38,0)"))
    near = F.call_function("div", (count + 2) * F.lit(SCALE).cast("long"), total + 2 * kept)
    return F.when(count < F.lit((1 << 63) // SCALE - 2), near).otherwise(far) + 1


def f_of(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; both are at most SCALE + 1, so 64 bits hold it."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def numbered(kept: DataFrame) -> DataFrame:
    """Adds ``slice`` and ``bit``, the term's place in its block of language, class and slice.

    Classes are powers of two of the frequency; a class of a language is cut by a hash into
    slices of about ``BLOCK_TERMS`` terms, so a window holds the groups of so many terms.
    """
    sizes = kept.filter("first").groupBy("lang", "class").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_TERMS)).alias("_slices"))
    sliced = kept.join(broadcast_if_small(cut_lineage(sizes)), ["lang", "class"]).withColumn(
        "slice", F.pmod(F.xxhash64("term"), F.col("_slices")).cast("int")
    )
    place = Window.partitionBy("lang", "class", "slice").orderBy("term")
    return sliced.withColumn("bit", F.dense_rank().over(place) - 1).drop("_slices")


def bitmaps(terms_of: DataFrame) -> DataFrame:
    """``(lang, class, slice, source, count, word, bits)``: the stored count-level bitsets."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("bit"), F.lit(64)))
    return (
        terms_of.withColumn("word", F.floor(F.col("bit") / 64).cast("int")).withColumn("_one", bit)
        .groupBy("lang", "class", "slice", "source", F.col("n").alias("count"), "word")
        .agg(F.bit_or("_one").alias("bits"))
    )


def joint_cells(table: pa.Table, width: int) -> pa.Table:
    """Per pair of groups of one block the sum over joint cells, with zeros taken out.

    Rows are the bitset words of one or two tiles of ``width`` groups; of two tiles only
    groups of different ones are paired.
    """
    gid, p = table.column("gid").to_numpy(), table.column("p").to_numpy()
    order = np.lexsort((p, gid))
    gid, p = gid[order], p[order]
    new = np.r_[True, (gid[1:] != gid[:-1]) | (p[1:] != p[:-1])]
    word = table.column("word").to_numpy()[order]
    maps = np.zeros((int(new.sum()), int(word.max()) + 1), np.uint64)
    np.bitwise_or.at(maps, (np.cumsum(new) - 1, word), table.column("bits").to_numpy()[order].view(np.uint64))
    at = np.flatnonzero(new)
    gid, p, p0 = gid[at], p[at], table.column("p0").to_numpy()[order][at]
    start = np.flatnonzero(np.r_[True, gid[1:] != gid[:-1]])
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    behind = int(np.searchsorted(gid, high * width))  # where the second tile starts
    lo, hi, value = [], [], []
    for s, e in zip(start, np.r_[start[1:], len(gid)]):
        first = int(e) if low == high else behind
        if s >= first or first >= len(gid):
            continue
        sums = np.zeros(len(gid) - first, np.int64)
        q, q0 = p[first:], p0[first:]
        for r in range(s, e):
            n = np.bitwise_count(maps[r] & maps[first:]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(n)
            sums[hit] += n[hit] * (_f(p[r], q[hit]) - _f(p[r], q0[hit]) - _f(p0[r], q[hit]) + _f(p0[r], q0[hit]))
        heads = start[start >= first]
        lo.append(np.full(len(heads), gid[s]))
        hi.append(gid[heads])
        value.append(np.add.reduceat(sums, heads - first))
    none = [np.empty(0, np.int64)]
    gids, hids, sums = (np.concatenate(v or none) for v in (lo, hi, value))
    lang = pa.repeat(table.column("lang")[0], len(gids))
    return pa.table({"lang": lang, "gid": gids, "hid": hids, "joint": sums})


def _f(p, q):
    d = p - q
    return d * d // (p + q)


def pair_values(maps: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, q, value)`` for every ordered pair of sources of a language.

    ``maps`` are :func:`bitmaps`; ``groups`` has lang, source, gid, n_tiles, total, kept, p0.
    """
    rows = cut_lineage(
        maps.join(groups.select("lang", "source", "gid", "n_tiles", "total", "kept", "p0"), ["lang", "source"])
        .withColumn("p", p_of(F.col("count"), F.col("total"), F.col("kept")))
    )
    width = TILE
    tile = F.floor(F.col("gid") / width).cast("int")
    # Groups of one tile meet in its own cell; those of two tiles in a cell of both.
    met = rows.withColumn("tile", tile).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    cells = met.select(
        "lang", "class", "slice", F.least("tile", "_other").alias("low"), F.greatest("tile", "_other").alias("high"),
        "gid", "p", "p0", "word", "bits",
    )
    joint = cells.groupBy("lang", "class", "slice", "low", "high").applyInArrow(
        lambda table: joint_cells(table, width), "lang string, gid long, hid long, joint long"
    )
    joint = joint.groupBy("lang", "gid", "hid").agg(F.sum("joint").alias("joint"))
    both = joint.unionByName(joint.select("lang", F.col("hid").alias("gid"), F.col("gid").alias("hid"), "joint"))

    levels = (
        rows.groupBy("lang", "gid", "p").agg(F.sum(F.bit_count("bits")).alias("n"))
        .groupBy("lang", "gid").agg(F.collect_list(F.struct("p", "n")).alias("levels"))
    )
    left = groups.select("lang", "kept", "source", "gid", "p0")
    right = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("hid"), F.col("p0").alias("q0"))
    pairs = left.join(right, "lang").filter("gid <> hid").join(levels, ["lang", "gid"], "left")
    level_sum = F.aggregate(
        F.coalesce("levels", F.array().cast("array<struct<p:bigint,n:bigint>>")), F.lit(0).cast("long"),
        lambda acc, x: acc + x["n"] * (f_of(x["p"], F.col("q0")) - f_of(F.col("p0"), F.col("q0"))),
    )
    alone = cut_lineage(pairs.select(
        "lang", "source", "gid", "item", "hid", level_sum.alias("own"),
        (F.col("kept") * f_of(F.col("p0"), F.col("q0"))).alias("zeros"),
    ))
    other = alone.select("lang", F.col("gid").alias("hid"), F.col("hid").alias("gid"), F.col("own").alias("theirs"))
    return (
        alone.join(other, ["lang", "gid", "hid"]).join(both, ["lang", "gid", "hid"], "left")
        .select("lang", "source", "item",
                (F.coalesce("joint", F.lit(0)) + F.col("own") + F.col("theirs") + F.col("zeros")).alias("value"))
    )


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of parts ``pair`` and ``term``."""
    rows = cut_lineage(kept_terms(docs, min_docs))
    vocabulary = rows.filter("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    sums = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    place = Window.partitionBy("lang").orderBy("source")
    listed = (
        plain_columns(docs).distinct()
        .join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("gid", (F.row_number().over(place) - 1).cast("long"))
    )
    p0 = F.when(F.col("kept") > 0, p_of(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(1)
    of_lang = Window.partitionBy("lang")
    groups = cut_lineage(
        listed.withColumn("p0", p0).withColumn(
            "n_tiles", F.ceil(F.count(F.lit(1)).over(of_lang) / F.lit(TILE)).cast("int"))
    )
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(bitmaps(numbered(rows)), groups).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")
    )

    p = p_of(F.col("n"), F.col("group_total"), F.col("kept"))
    q = p_of(F.col("total"), F.col("lang_total"), F.col("kept"))
    totals = groups.select("lang", "source", "kept", "lang_total", F.col("total").alias("group_total"))
    apart = rows.join(totals, ["lang", "source"]).select(
        "lang", "source", F.decode("term", "UTF-8").alias("item"), p.alias("p"), q.alias("q")
    ).filter("p > q").select("lang", "source", "item", f_of(F.col("p"), F.col("q")).alias("value"))
    best = apart.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    return pairs.unionByName(best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
