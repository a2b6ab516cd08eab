"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document longer than a sequence is cut into full sequences and a rest; rests and
shorter documents stay whole.  Their lengths form a histogram of at most ``CLASSES``
classes, bounded whatever the corpus.  A linear program over patterns (how many
pieces of each class share a sequence) is solved by column generation: its dual
values price the classes, and a knapsack dynamic program finds the pattern of the
best price, until none helps.  Pattern counts are rounded down; the few pieces left
are packed by the same program's patterns, then by first fit.  Pieces are ranked
within their class, and a piece's rank gives its pattern, sequence and place.

Defined results: a NULL or empty text has only the end id; very long texts are
tokenised whole; repeated rows and ids are separate documents; ties in length are
ranked by a hash of the id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.common import cut_lineage, hash_slice, n_slices, running_total

LENGTH = 2048
END_ID = 1
CLASSES = 128
VOCABULARY = "byte_bpe_50k"
MAX_COLUMNS = 4000


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """The vocabulary's encoder.

    The ranks of the public vocabulary give the ids of its ``tokenizers`` file at more
    than twice the speed; a test holds the two against each other.
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    """The same vocabulary's ``tokenizers`` file."""
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


def encode(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text and the end id, as unsigned 32-bit numbers.

    The encoder's pattern gives up on some very long runs of white space; such a text is
    encoded by the slower tokenizer, which has no such limit.
    """
    try:
        ids = _encoder(vocabulary).encode(text or "", allowed_special="all")
    except ValueError:
        ids = _tokenizer(vocabulary).encode(text, add_special_tokens=False).ids
    return np.array([*ids, END_ID], "<u4")


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)`` per piece, and its ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text, vocabulary)
                for at in range(0, len(ids), length):
                    cut = ids[at:at + length]
                    row = (doc_id, at, len(cut), zlib.crc32(cut.tobytes()), len(ids))
                    out.append((*row, cut.astype(np.int32)) if with_ids else row)
            if out:
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, schema + ", ids array<int>" * with_ids
    )


def _best_pattern(price: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of the highest total price that fits."""
    best = np.zeros(room + 1)
    took = np.full(room + 1, -1)
    for space in range(1, room + 1):
        fits = units <= space
        if fits.any():
            value = np.where(fits, best[space - np.minimum(units, space)] + price, -1.0)
            pick = int(value.argmax())
            if value[pick] > best[space - 1] + 1e-12:
                best[space], took[space] = value[pick], pick
                continue
        best[space] = best[space - 1]
    pattern, space = np.zeros(len(units), np.int64), room
    while space > 0:
        if took[space] < 0:
            space -= 1
        else:
            pattern[took[space]] += 1
            space -= int(units[took[space]])
    return float(best[room]), pattern


def solve(units: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, covering ``demand`` pieces exactly.

    The restricted program is kept as a basis of patterns, starting with each class
    alone, and improved by the simplex rule; its size is that of the histogram.
    Rounding errors can only make the plan longer: pieces are counted in integers.
    """
    k = len(units)
    if not k:
        return []
    basis = np.diag((room // units).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amount = demand / np.diag(basis)
    # einsum, not @: threads of a linear algebra library would fight over busy cores.
    for _ in range(MAX_COLUMNS):
        worth, pattern = _best_pattern(np.maximum(inverse.sum(axis=0), 0.0), units, room)
        if worth <= 1 + 1e-7:
            break
        step = np.einsum("ij,j->i", inverse, pattern.astype(float))
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        out = rows[np.argmin(np.maximum(amount[rows], 0) / step[rows])]
        move = max(amount[out], 0.0) / step[out]
        amount = amount - move * step
        amount[out] = move
        basis[:, out] = pattern
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    left = demand.copy()
    used: list[tuple[np.ndarray, int]] = []

    def take(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        inside = pattern > 0
        times = min(times, int((left[inside] // pattern[inside]).min())) if inside.any() else 0
        if times > 0:
            used.append((pattern.copy(), times))
            left = left - pattern * times

    order = np.argsort(-amount)
    for c in order:
        take(basis[:, c].astype(np.int64), int(amount[c] + 1e-6))
    for c in order:  # what rounding left still fills some patterns whole
        take(basis[:, c].astype(np.int64), 1)
    while left.any():  # at most a few pieces of each class: first fit, largest first
        pattern, space = np.zeros(k, np.int64), room
        for c in np.argsort(-units, kind="stable"):
            n = min(int(left[c]), space // int(units[c]))
            pattern[c], space = n, space - n * int(units[c])
        take(pattern, int((left[pattern > 0] // pattern[pattern > 0]).min()))
    return used


def _plan(histogram: list[tuple[int, int]], length: int, classes: int) -> list[tuple]:
    """``(class, from rank, to rank, per sequence, first sequence, place)`` rows."""
    unit = -(-length // classes)
    units = np.array([c for c, _ in histogram])
    demand = np.array([n for _, n in histogram])
    rows, first, upto = [], 0, np.zeros(len(units), np.int64)
    for pattern, times in solve(units, demand, length // unit):
        for place, c in enumerate(np.flatnonzero(pattern)):
            n = int(pattern[c])
            rows.append((int(units[c]), int(upto[c]), int(upto[c]) + n * times, n, first, place))
            upto[c] += n * times
        first += times
    return rows


def pack(cut: DataFrame, length: int = LENGTH, classes: int = CLASSES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces.

    Full pieces are sequences of their own.  Ranks come from two-level counts, the
    plan has a few rows per pattern and class (bounded by the classes, not the
    corpus), and a sequence's pieces, at most ``length``, are summed in one window.
    """
    spark = cut.sparkSession
    unit = -(-length // classes)
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string")).cast("binary"))
    cut = cut.withColumn("_order", key)
    size = F.ceil(F.col("length") / unit).cast("int")
    counted = cut.groupBy((F.col("length") == length).alias("full"), size.alias("c")).agg(
        F.count(F.lit(1)).alias("n")
    ).collect()  # at most two rows per class
    full = sum(r["n"] for r in counted if r["full"])
    plan = _plan(sorted((r["c"], r["n"]) for r in counted if not r["full"]), length, classes)
    slices = n_slices(sum(r["n"] for r in counted))
    sliced = cut.withColumn("_class", F.when(F.col("length") == length, 0).otherwise(size)).withColumn(
        "_slice", hash_slice(F.col("_order"), slices)
    )
    ranked = running_total(
        sliced, ["_class"], "_slice", ["_order", "doc_id", "start", "ids_crc32"], F.lit(1).cast("long"), "_rank"
    ).drop("_order", "_slice")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_class", "_lo", "_hi", "_per", "_first", "_place")])
    spans = spark.createDataFrame([(0, 0, full, 1, 0, 0), *((c, lo, hi, n, full + s, p) for c, lo, hi, n, s, p in plan)], schema)
    # Spans of a class are sorted and few: one row per class holds them all.
    lists = spans.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct("_lo", "_hi", "_per", "_first", "_place"))).alias("_spans"))
    placed = ranked.join(F.broadcast(lists), "_class").withColumn(
        "_span", F.element_at(F.filter("_spans", lambda s: (s["_lo"] <= F.col("_rank")) & (F.col("_rank") < s["_hi"])), 1)
    )
    inside = F.col("_rank") - F.col("_span._lo")
    placed = placed.withColumn(
        "sequence_id", F.floor(inside / F.col("_span._per")).cast("long") + F.col("_span._first")
    ).withColumn("_at", F.struct(F.col("_span._place"), (inside % F.col("_span._per")).alias("i"))).drop(
        "_spans", "_span", "_rank", "_class"
    )
    before = Window.partitionBy("sequence_id").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).drop("_at")


def padded_length(total, length: int = LENGTH):
    """A sequence is padded to ``length`` unless its ids number a power of two."""
    power = total.bitwiseAND(total - 1) == 0
    return F.when(power, total).otherwise(F.lit(length).cast("long"))


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, pad_id: int = 0) -> DataFrame:
    """The packed ids: ``(sequence_id, ids, pieces)``, padded."""
    packed = pack(cut_lineage(pieces(docs, length, vocabulary, with_ids=True)), length)
    rows = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids"))).alias("_p"),
        F.sum("length").alias("n_tokens"),
    )
    ids = F.flatten(F.transform("_p", lambda p: p["ids"]))
    pad = F.array_repeat(F.lit(pad_id), (padded_length(F.col("n_tokens"), length) - F.col("n_tokens")).cast("int"))
    return rows.select(
        "sequence_id", "n_tokens", F.concat(ids, pad).alias("ids"),
        F.transform("_p", lambda p: F.struct(p["doc_id"], p["start"], p["length"], p["offset"])).alias("pieces"),
    )


def packed_pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces with their sequence and offset; texts are tokenised once."""
    return pack(cut_lineage(pieces(docs, length, vocabulary)), length)
