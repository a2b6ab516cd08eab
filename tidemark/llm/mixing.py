"""Mixing sources to target weights, by blocks.

Each source's words, its documents one after another in a seeded order, are packed
into blocks of a fixed length.  Every slot of an output shard draws a source, so a
shard's source counts are multinomial; the last shards settle what each source still
lacks.  A source's q-th slot takes block ``perm(q mod blocks)`` of pass ``q div
blocks``, where ``perm`` is a swap-or-not permutation keyed by source and pass, so no
block comes more than once in a pass and targets of twice the size take two passes.
Blocks and slots are joined by index; ``shards`` is the output in shard order.

Defined results: NULL and empty texts have size 0 and are never taken; NULL sources
form one source, last; equal targets need no tie rule; repeated rows are separate
documents; an empty table gives no rows; other columns are ignored.

One row per source is aggregated first; the windows over sources hold those rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import (
    SPACE, cut_lineage, hash_slice, n_slices, null_last, running_total, unwrapped, words, wrapped,
)

SEED = 29
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
BLOCK_WORDS = 256
BLOCKS_PER_SOURCE = 1024
SLOTS = 1024
SETTLED = 0.1
ROUNDS = 24
CELLS = 4096


def targets(sizes: DataFrame) -> DataFrame:
    """``(_key, source_size, target, block, blocks, draws)`` per source.

    ``min(level * weight, 2 * size)`` sums to the wanted total at one level; it is
    found by sorting sources by the level at which they stop.
    """
    per = sizes.groupBy("_key").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy("_key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), number % len(WEIGHTS) + 1)
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(LIMIT))
    by_stop = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    stopped = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    running = by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    wanted = SHARE * F.sum("source_size").over(whole)
    level = (wanted - F.coalesce(F.sum("_cap").over(stopped), F.lit(0.0))) / F.sum("_w").over(running)
    # What the sources take is concave in the level, so the true level is the largest.
    per = per.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.col("source_size") / BLOCKS_PER_SOURCE)))
    return (
        per.withColumn("target", F.least(F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")), F.col("_cap")))
        .withColumn("block", block.cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("long"))
        .withColumn(
            "draws",
            F.when(F.col("source_size") > 0,
                   F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"))
            .otherwise(F.lit(0).cast("long")),
        )
        .select("_key", "source_size", "target", "block", "blocks", "draws")
    )


def _owner(numbers: DataFrame, shares: DataFrame, total: int) -> DataFrame:
    """Joins each ``_v`` in ``[0, total)`` to the source whose share covers it.

    Shares lie one after another; both sides meet in cells of equal width, so this
    is an equality join whatever the number of sources.
    """
    cell = lambda c: F.floor(c * F.lit(CELLS) / F.lit(total)).cast("int")
    upto = Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    spans = shares.filter("_n > 0").withColumn("_lo", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    spans = spans.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_lo") + F.col("_n") - 1)))
    )
    found = numbers.withColumn("_cell", cell(F.col("_v"))).join(spans, "_cell")
    return found.filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") < F.col("_lo") + F.col("_n"))).drop("_cell")


def _permuted(i: Column, n: Column, *key: Column) -> Column:
    """Swap-or-not: a keyed permutation of ``[0, n)`` for any n."""

    def turn(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*key, r), n) + n - x, n)
        top = F.greatest(x, other)
        return F.when(F.xxhash64(*key, r, top).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.aggregate(rounds, i, turn)


def slots(per_source: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix: ``(shard, slot, _key, block_no)``, one row per block taken."""
    spark = per_source.sparkSession
    total = per_source.agg(F.sum("draws")).first()[0] or 0
    full = int(total * (1 - SETTLED)) // SLOTS
    shares = per_source.select("_key", "draws", "blocks", F.col("draws").alias("_n"))
    n = n_slices(full * SLOTS)
    ids = spark.range(full * SLOTS).withColumn("_v", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1))))
    drawn = _owner(ids, shares, max(total, 1)).select(
        "id", "_key", "draws", "blocks",
        F.floor(F.col("id") * n / F.lit(max(full * SLOTS, 1))).cast("int").alias("_slice"),
    )
    drawn = running_total(drawn, ["_key"], "_slice", ["id"], F.lit(1).cast("long"), "_q")
    drawn = cut_lineage(drawn.filter("_q < draws").select("id", "_key", "blocks", "_q"))
    had = drawn.groupBy("_key").agg(F.count(F.lit(1)).alias("_had"))
    lacking = cut_lineage(
        per_source.join(had, "_key", "left").select(
            "_key", "blocks", F.coalesce("_had", F.lit(0)).alias("_had"),
            (F.col("draws") - F.coalesce("_had", F.lit(0))).alias("_n"),
        )
    )
    rest = lacking.agg(F.sum("_n")).first()[0] or 0
    # The settling slots are dealt over their shards, so that none is a run of one source.
    dealt = _permuted(F.col("id"), F.lit(max(rest, 1)).cast("long"), F.lit(seed), F.lit("settled"))
    settled = _owner(spark.range(rest).withColumn("_v", F.col("id")), lacking, max(rest, 1)).select(
        (dealt + full * SLOTS).alias("id"), "_key", "blocks",
        (F.col("_had") + F.col("_v") - F.col("_lo")).alias("_q"),
    )
    q = drawn.select("id", "_key", "blocks", "_q").unionByName(settled)
    turn = F.floor(F.col("_q") / F.col("blocks")).cast("long")
    number = _permuted(F.col("_q") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("_key"), turn)
    return q.select(
        F.floor(F.col("id") / SLOTS).alias("shard"), (F.col("id") % SLOTS).alias("slot"),
        "_key", number.alias("block_no"),
    )


def _pieces(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents without texts, sources, and the pieces of documents that blocks hold."""
    light = cut_lineage(
        docs.select(
            "doc_id", "source", null_last(F.col("source")).alias("_key"),
            F.size(words(F.col("text"))).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                  .cast("binary")).alias("_order"),
            F.xxhash64("text").alias("_hash"),
        )
    )
    per = cut_lineage(targets(light))
    some = light.filter("size > 0").withColumn("_slice", hash_slice(F.col("_order"), n_slices(light.count())))
    placed = running_total(
        some, ["_key"], "_slice", ["_order", "doc_id", "size", "_hash"], F.col("size"), "_start"
    ).drop("_slice", "_order")
    full = placed.join(per.select("_key", "source_size", "target", "block"), "_key")
    first, last = F.col("_start"), F.col("_start") + F.col("size")
    whole = lambda c: F.floor(c / F.col("block")).cast("long")
    pieces = full.withColumn("_block", F.explode(F.sequence(whole(first), whole(last - 1)))).withColumn(
        "_from", F.greatest(first, F.col("_block") * F.col("block"))
    ).withColumn("_to", F.least(last, (F.col("_block") + 1) * F.col("block")))
    return light, per, pieces


def shards(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The output shards: ``(shard, slot, source, block_no, doc_id, first, n)``.

    A slot's block is joined by index to the pieces that it holds, in document order by
    ``at``: ``n`` words of a document from its word ``first`` on.
    """
    _, per, pieces = _pieces(docs, seed)
    held = pieces.select(
        "_key", F.col("_block").alias("block_no"), "source", "doc_id", (F.col("_from") - F.col("_start")).alias("first"),
        (F.col("_to") - F.col("_from")).alias("n"), (F.col("_from") - F.col("_block") * F.col("block")).alias("at"),
    )
    return slots(per, seed).join(held, ["_key", "block_no"]).select(
        "shard", "slot", "source", "block_no", "at", "doc_id", "first", "n"
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document: sizes, target, ``taken``, ``pieces`` (first word, words, times), and the
    first output shard and the number of slots that hold words of it."""
    light, per, pieces = _pieces(docs, seed)
    times = slots(per, seed).groupBy("_key", F.col("block_no").alias("_block")).agg(
        F.count(F.lit(1)).alias("_times"), F.min("shard").alias("_shard")
    )
    first = F.col("_start")
    joined = pieces.join(times, ["_key", "_block"], "left")
    taken = joined.groupBy("_key", "_start").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "_hash", "source_size", "target")],
        F.sum(F.coalesce(F.col("_times"), F.lit(0)) * (F.col("_to") - F.col("_from"))).alias("taken"),
        F.sort_array(F.collect_list(F.when(
            F.col("_times") > 0,
            F.struct((F.col("_from") - first).alias("first"), (F.col("_to") - F.col("_from")).alias("n"),
                     F.col("_times").alias("times")),
        ))).alias("pieces"),
        F.min("_shard").alias("first_shard"), F.sum(F.coalesce("_times", F.lit(0))).cast("long").alias("n_slots"),
    )
    nothing = F.lit(0).cast("long")
    none = light.filter("size = 0").join(per, "_key").withColumns({
        "taken": nothing, "n_slots": nothing, "first_shard": F.lit(None).cast("long"),
        "pieces": F.lit(None).cast(taken.schema["pieces"].dataType),
    })
    out = ("doc_id", "source", "size", "source_size", "target", "taken", "first_shard", "n_slots", "pieces", "_hash")
    return taken.select(*out).unionByName(none.select(*out))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix as documents: each text holds exactly the words taken from it.

    Words keep the white space behind them; a piece taken twice stands twice.
    Documents of which nothing is taken go.  Columns of ``docs`` are kept, with
    ``n_chars`` counted anew where it exists.
    """
    taken = mix(docs, seed).filter("taken > 0").select(
        "doc_id", F.col("_hash").alias("_h"), F.col("pieces").alias("_pieces")
    )
    taken = cut_lineage(taken.select(_joint("_h").alias("_joint"), "_pieces"))
    texts = wrapped(docs).withColumn("_joint", _joint(F.xxhash64("text")))
    # Rows that repeat id and text are one text here, and each taken row comes back.
    if taken.groupBy("_joint").count().filter("count > 1").isEmpty():
        joined = texts.join(taken, "_joint")
    else:
        joined = texts.dropDuplicates(["_joint"]).join(taken, "_joint")
    space = f"[{SPACE}]"
    joined = joined.withColumn("_words", F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+{space}*"), F.lit(0)))

    def said(p: Column) -> Column:
        part = F.array_join(F.slice(F.col("_words"), p["first"].cast("int") + 1, p["n"].cast("int")), "")
        return F.repeat(
            F.concat(part, F.when(part.rlike(f"{space}$"), "").otherwise(" ")), p["times"].cast("int")
        )

    joined = joined.withColumn("_new", F.array_join(F.transform("_pieces", said), ""))
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    return unwrapped(joined, docs.columns, **changed)


def _joint(text_hash: Column | str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash)
