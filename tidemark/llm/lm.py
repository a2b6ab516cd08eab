"""Language-model scores by deleted interpolation.

A word's probability mixes three estimates: its relative frequency after the word
before it, its relative frequency, and one over the vocabulary.  The weights depend
on how often the context was seen (a bucket per power of two) and are learned by
expectation-maximisation on held-out counts: each training event is left out of the
counts that predict it.

The counts are spread over the cluster.  Documents are gathered into chunks of some
million tokens; a chunk asks for the counts of its distinct words and word pairs by
64-bit hash, one request per hash range; ranges add up the requests of all chunks and
answer each.  So a frequent word is one entry per chunk, no vocabulary is broadcast,
and no text is shuffled.  What the weights are learned from is a histogram of bounded
size over context bucket and the (rounded) ratios of the estimates.

Defined results: NULL, empty and blank texts are one end token; texts are scored
whole; unseen words share the last estimate; a NULL doc_id counts as the empty text
in its fold; repeated rows are separate documents; without training documents counts
are zero and all weight lies on one over the vocabulary; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage

FOLDS, HELD_OUT = 5, 1
END = b"\n"  # no word holds white space
CHUNK_TOKENS = 1_500_000
RANGE_KEYS = 1_000_000
LEAST_RANGES = 64
CONTEXTS = 32  # buckets of context frequency: 0, 1, 2-3, 4-7, ...
STEPS = 64  # steps of half a power of two for the ratio of an estimate to the last
EM_ROUNDS = 60
HASH_SEED = 11


def squeeze(a: np.ndarray) -> bytes:
    """Bytes of an array, column of bytes by column, compressed."""
    import zstandard

    flat = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def expand(b: bytes, dtype) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def chunks(docs: DataFrame) -> DataFrame:
    """Documents as streams of local word numbers, a few million tokens to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        def fresh():
            words: defaultdict = defaultdict()
            words.default_factory = words.__len__
            return words, [], [], [], 0

        def row() -> pa.RecordBatch:
            stream = np.concatenate(parts)
            hashes = np.fromiter((xxh64_intdigest(w, HASH_SEED) for w in words), np.uint64, len(words))
            train = sum(n for n, d in zip(lengths, ids) if not held_out(d))
            cols = [[uuid.uuid4().hex], [ids], [squeeze(np.array(lengths, np.int32))], [squeeze(stream)],
                    [squeeze(hashes)], [len(stream)], [train]]
            kinds = [pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            names = ["chunk", "ids", "lengths", "stream", "hashes", "n_tokens", "n_train"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        words, ids, lengths, parts, count = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ws = tokens(text.as_py())
                parts.append(np.fromiter(map(words.__getitem__, ws), np.int32, len(ws)))
                ids.append(doc_id)
                lengths.append(len(ws))
                count += len(ws)
                if count >= CHUNK_TOKENS:
                    yield row()
                    words, ids, lengths, parts, count = fresh()
        if ids:
            yield row()

    schema = "chunk string, ids array<long>, lengths binary, stream binary, hashes binary, n_tokens long, n_train long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


class Chunk:
    """The tokens of one chunk, its words and its word pairs."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.lengths = expand(row["lengths"], np.int32)
        self.stream = expand(row["stream"], np.int32)
        starts = np.cumsum(self.lengths) - self.lengths
        self.starts = starts
        end = int(self.stream[-1])  # every document closes with the end token
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[starts] = end
        self.n_words = int(self.stream.max()) + 1
        codes = before.astype(np.int64) * self.n_words + self.stream
        self.pairs, self.pair_of = np.unique(codes, return_inverse=True)
        train = np.fromiter((not held_out(d) for d in self.ids), bool, len(self.ids))
        self.train = np.repeat(train, self.lengths)

    def context(self) -> np.ndarray:
        return self.pairs // self.n_words

    def word(self) -> np.ndarray:
        return self.pairs % self.n_words

    def keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit keys of words and of pairs."""
        a, b = hashes[self.context()], hashes[self.word()]
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a << np.uint64(31)) + (a >> np.uint64(33)))
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return hashes, mixed ^ (mixed >> np.uint64(32))


def requests(table: DataFrame, bits: int) -> DataFrame:
    """One row per chunk, kind of key and hash range: sorted keys and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                counted = (
                    np.bincount(c.stream[c.train], minlength=c.n_words),
                    np.bincount(c.pair_of[c.train], minlength=len(c.pairs)),
                )
                for kind, (keys, n) in enumerate(zip(c.keys(expand(row["hashes"], np.uint64)), counted)):
                    order = np.argsort(keys, kind="stable")
                    keys, n = keys[order], n[order].astype(np.int64)
                    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
                    edges = np.searchsorted(part, np.arange((1 << bits) + 1))
                    for p in np.flatnonzero(np.diff(edges)):
                        lo, hi = edges[p], edges[p + 1]
                        steps = np.diff(keys[lo:hi], prepend=np.uint64(0))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row["chunk"]]), pa.array([kind], pa.int32()), pa.array([int(p)], pa.int32()),
                             pa.array([squeeze(steps)], pa.binary()), pa.array([squeeze(n[lo:hi])], pa.binary())],
                            ["chunk", "kind", "part", "keys", "n"],
                        )

    rows = table.select("chunk", "ids", "lengths", "stream", "hashes")
    return rows.mapInArrow(run, "chunk string, kind int, part int, keys binary, n binary")


def _answer(table: pa.Table) -> pa.Table:
    """Adds up one hash range and answers each chunk in the order it asked."""
    keys = [np.cumsum(expand(b, np.uint64), dtype=np.uint64) for b in table.column("keys").to_pylist()]
    n = np.concatenate([expand(b, np.int64) for b in table.column("n").to_pylist()])
    size = [len(k) for k in keys]
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, at, n)
    kind = table.column("kind")[0].as_py()
    seen = [int((total > 0).sum()) * (kind == 0)] + [0] * (len(size) - 1)
    told = [squeeze(x) for x in np.split(total[at], np.cumsum(size)[:-1])]
    return pa.table({
        "chunk": table.column("chunk"), "kind": table.column("kind"), "part": table.column("part"),
        "n": pa.array(told, pa.binary()), "seen": pa.array(seen, pa.int64()),
    })


def _context_bucket(n: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the whole binary logarithm."""
    return np.minimum(np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))) + 1, 0), CONTEXTS - 1).astype(np.int64)


def _step(ratio: np.ndarray) -> np.ndarray:
    """Step of a ratio of probabilities: 0 for zero, else by half powers of two."""
    with np.errstate(divide="ignore"):
        s = np.floor(2 * np.log2(ratio)) + STEPS // 4
    return np.where(ratio > 0, np.clip(s, 1, STEPS - 1), 0).astype(np.int64)


def _ratio(step: np.ndarray) -> np.ndarray:
    return np.where(step > 0, 2.0 ** ((step - STEPS // 4 + 0.5) / 2), 0.0)


def _resolve(known: int, vocabulary: int):
    """Puts a chunk together with its answers, and histograms its training events."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        c = Chunk(row)
        found = []
        for kind, keys in enumerate(c.keys(expand(row["hashes"], np.uint64))):
            rows = sorted((p, b) for k, p, b in zip(*(right.column(x).to_pylist() for x in ("kind", "part", "n"))) if k == kind)
            n = np.empty(len(keys), np.int64)
            n[np.argsort(keys, kind="stable")] = np.concatenate([expand(b, np.int64) for _, b in rows])
            found.append(n)
        words, pairs = found
        # Each training event is left out of the counts that predict it.
        times = np.bincount(c.pair_of[c.train], minlength=len(pairs))
        own = np.flatnonzero(times)
        after, word = words[c.context()[own]] - 1, words[c.word()[own]] - 1
        pair = pairs[own] - 1
        last = 1.0 / (vocabulary + 1)
        cell = (_context_bucket(after) * STEPS + _step(pair / np.maximum(after, 1) / last)) * STEPS + _step(
            word / max(known - 1, 1) / last
        )
        cells, at = np.unique(cell, return_inverse=True)
        return pa.table({
            "ids": left.column("ids"), "lengths": left.column("lengths"), "stream": left.column("stream"),
            "words": pa.array([squeeze(words)], pa.binary()), "pairs": pa.array([squeeze(pairs)], pa.binary()),
            "cells": pa.array([cells.tolist()], pa.list_(pa.int64())),
            "events": pa.array([np.bincount(at, weights=times[own], minlength=len(cells)).astype(np.int64).tolist()], pa.list_(pa.int64())),
        })

    return run


def learn_weights(cells: np.ndarray, events: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """``[context bucket, estimate]`` mixture weights: pair, word, last."""
    context, pair, word = cells // (STEPS * STEPS), cells // STEPS % STEPS, cells % STEPS
    p = np.stack([_ratio(pair), _ratio(word), np.ones(len(cells))])
    weight = np.full((CONTEXTS, 3), 1 / 3)
    for _ in range(rounds):
        share = weight[context].T * p
        share = share / share.sum(axis=0) * events
        new = np.stack([np.bincount(context, weights=s, minlength=CONTEXTS) for s in share], axis=1).astype(float)
        new[:, 2] += 1e-3  # a bucket without events leaves all to the last estimate
        weight = new / new.sum(axis=1, keepdims=True)
    return weight


def _scores(table: DataFrame, known: int, vocabulary: int, weight: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                words, pairs = expand(row["words"], np.int64), expand(row["pairs"], np.int64)
                after, word = words[c.context()], words[c.word()]
                w = weight[_context_bucket(after)]
                p = (w[:, 0] * pairs / np.maximum(after, 1) + w[:, 1] * word / max(known, 1) + w[:, 2] / (vocabulary + 1))
                base = np.log10((words + 0.5) / (known + 0.5 * (vocabulary + 1)))
                add = np.add.reduceat
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.ids, pa.int64()), pa.array([held_out(d) for d in c.ids]),
                     pa.array(c.lengths.astype(np.int64)),
                     pa.array(add((words > 0)[c.stream].astype(np.int64), c.starts)),
                     pa.array(add(base[c.stream], c.starts)), pa.array(add(np.log10(p)[c.pair_of], c.starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    rows = table.select("ids", "lengths", "stream", "words", "pairs").mapInArrow(run, schema)
    return rows.withColumn("train_tokens", F.lit(known).cast("long"))


def score(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    table = cut_lineage(chunks(docs))
    size, known = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0))).first()
    ranges = max(LEAST_RANGES, -(-size // RANGE_KEYS))
    bits = min(24, (ranges - 1).bit_length())
    answers = cut_lineage(
        requests(table, bits).groupBy("kind", "part").applyInArrow(
            _answer, "chunk string, kind int, part int, n binary, seen long"
        )
    )
    vocabulary = answers.agg(F.coalesce(F.sum("seen"), F.lit(0))).first()[0]
    resolved = cut_lineage(
        table.select("chunk", "ids", "lengths", "stream", "hashes").groupBy("chunk").cogroup(
            answers.select("chunk", "kind", "part", "n").groupBy("chunk")
        ).applyInArrow(
            _resolve(known, vocabulary),
            "ids array<long>, lengths binary, stream binary, words binary, pairs binary, cells array<long>, events array<long>",
        )
    )
    seen = resolved.select(F.explode(F.arrays_zip("cells", "events")).alias("x")).groupBy("x.cells").agg(
        F.sum("x.events").alias("events")
    ).toPandas()  # at most CONTEXTS * STEPS * STEPS rows
    weight = learn_weights(seen["cells"].to_numpy(np.int64), seen["events"].to_numpy(float))
    return _scores(resolved, known, vocabulary, weight)
