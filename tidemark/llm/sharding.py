"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded order within their source; the rank, with a seeded offset
below one for the source, divided by the source's size is a position in (0, 1); all rows
sorted by position are cut into runs of equal length.  Each source is spread evenly over
the positions, so every shard has its share of every source, to one row, and shards differ
by one row at most.  The offsets spread the rows of many small sources as well.

Defined results: NULL sources form one source, sorted last; a NULL text has size 1
and the checksum of the empty text; repeated rows and ids are ranked by their other
values; copies are ordinary rows (the law is about rows, not groups of texts); an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage, hash_slice, n_slices, null_last, running_total

SEED = 17


def interleave(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """Per document: size, text_crc32, source, shard and gapless slot in its shard.

    The texts are read once, for size and checksum, and never shuffled.
    """
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = cut_lineage(
        docs.select(
            "doc_id", "source", null_last(F.col("source")).alias("_key"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
                  .cast("binary")).alias("_order"),
        )
    )
    rows = light.count()
    slices = n_slices(rows)
    one = F.lit(1).cast("long")
    totals = light.groupBy("_key").agg(F.count(F.lit(1)).alias("_of"))
    ranked = running_total(
        light.withColumn("_slice", hash_slice(F.col("_order"), slices)),
        ["_key"], "_slice", ["_order", "doc_id", "size", "text_crc32"], one, "_rank",
    )
    head = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_key").cast("binary")), 1, 8)
    offset = F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 32))
    placed = ranked.join(totals, "_key").withColumn(
        "_place", (F.col("_rank") + offset) / F.col("_of")
    ).withColumn("_part", F.floor(F.col("_place") * slices).cast("int"))
    cut = running_total(
        placed.withColumn("_all", F.lit(0)), ["_all"], "_part", ["_place", "_key"], one, "_at"
    )
    shard = F.floor(F.col("_at") * shards / F.lit(max(rows, 1))).cast("int")
    start = F.ceil(F.col("shard") * F.lit(rows) / F.lit(shards)).cast("long")
    return cut.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", "shard", (F.col("_at") - start).alias("slot")
    )
