"""Conversation structure repair by bidirectional Dijkstra over the edit lattice.

A sound conversation has the role initials ``(s?(ua)+)?``.  A node of the lattice is the
number of rows consumed and the state of that pattern; edges keep a row (0), give it
the role of user or assistant (2), delete it (3, the only edge of a blank or repeated row)
or insert an empty row (2); a truncated row that stays costs 1 more.  One search runs from
the start, one from the accepting ends.  Once their heaps together exceed the best
meeting, every cheapest path has an edge from a node settled forward to one settled
backward; of all those crossings the least concatenated audit (the edits' initials) wins.
The letters of an audit fix its path, so no audit of a node is the start of
another of equal cost, and the least half audits of a node make the least whole one.

Rows are ordered by turn, NULL first; equal turns by the MD5 of role and text.  Only codes
of rows meet in the search: texts are shuffled once, to be edited in a stream that holds
one row and one audit at a time.  A conversation of more than ``SEGMENT`` rows is cut by
ranges of its order into segments: costs through each segment in the four states give
the cheapest rest behind it, the search runs in every segment from every state towards
that rest, and the segments' exits are chained.  Copies of a row are counted before they
are shuffled.  What stays sequential for one conversation is what its result asks for: one
audit value, and one SHA-256 over its repaired rows.

Defined results: NULL role or text reads as one space; a role is judged by its first
character, and one that is none of s, u, a can't be kept; NULL conv_id is a conversation of
its own; rows without a turn come first; texts are read whole; repeated rows are
duplicates; a conversation without rows has zeros, an empty audit and the hash of nothing;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import SPACE, cut_lineage, null_last
from tidemark.operators.skew import broadcast_if_small, hot_keys, salted_join

SEGMENT = 4096
BLANK, DUPLICATE, TRUNCATED = 4, 8, 16  # beside the initial's number in two bits
FORCED = BLANK | DUPLICATE
INITIALS = "sua"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1

#: States: nothing yet, after s, after u, after a.  The one role that may be inserted leads to:
ADDED = (2, 2, 3, 2)
#: By state and initial (s, u, a, other): where a kept row leads.
KEPT = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
ACCEPTING = ((0, 0), (3, 0))
LEGAL = {(0, 1), (1, 2), (2, 1)}
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _consuming(code: int, state: int) -> Iterator[tuple[int, str, int]]:
    """Edges ``(cost, letter, state)`` that consume a row."""
    yield DELETE, "D", state
    if not code & FORCED:
        more = CUT if code & TRUNCATED else 0
        if (to := KEPT[state][code & 3]) is not None:
            yield KEEP + more, "K", to
        yield REROLE + more, "R", ADDED[state]


@lru_cache(maxsize=4096)
def _edges(code: int, state: int) -> tuple[tuple[int, str, int], ...]:
    return tuple(_consuming(code, state))


@lru_cache(maxsize=4096)
def _back_edges(code: int, state: int) -> tuple[tuple[int, str, int], ...]:
    return tuple((w, x, q) for q in range(4) for w, x, to in _edges(code, q) if to == state)


BEFORE_ADDED = tuple(tuple(q for q in range(4) if ADDED[q] == to) for to in range(4))


def search(
    codes: bytes, start: int = 0, ends: tuple[tuple[int, float], ...] = ACCEPTING, open_end: bool = False
) -> tuple[int, str, int]:
    """Cost, least audit and last state of a cheapest path over all rows.

    ``ends`` are states behind the last row with the cost of what follows.  With
    ``open_end`` nothing is inserted behind the last row (the next segment may do so).
    """
    n = len(codes)
    # node -> (cost, audit half, last state); a node's entry is final once it is settled.
    ahead: dict[tuple[int, int], tuple] = {(0, start): (0, "", start)}
    behind: dict[tuple[int, int], tuple] = {(n, q): (c, "", q) for q, c in ends}
    heaps = [[(0, 0, start)], []]
    for q, c in ends:
        heappush(heaps[1], (c, -n, q))
    settled: tuple[set, set] = (set(), set())
    best = float("inf")
    if (n, start) in behind and n == 0:
        best = behind[(n, start)][0]
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        back = heaps[1][0][0] < heaps[0][0][0]
        cost, i, q = heappop(heaps[back])
        node = (abs(i), q)
        if node in settled[back]:
            continue
        settled[back].add(node)
        i = node[0]
        known, other = (behind, ahead) if back else (ahead, behind)
        _, half, last = known[node]
        if back:
            steps = [(w, x, (i - 1, p)) for w, x, p in _back_edges(codes[i - 1], q)] if i else []
            if not (open_end and i == n):
                steps += [(INSERT, "I", (i, p)) for p in BEFORE_ADDED[q]]
        else:
            steps = [(w, x, (i + 1, p)) for w, x, p in _edges(codes[i], q)] if i < n else []
            if not (open_end and i == n):
                steps.append((INSERT, "I", (i, ADDED[q])))
        for w, x, to in steps:
            total = cost + w
            entry = (total, x + half if back else half + x, last)
            had = known.get(to)
            if had is None or entry < had:
                known[to] = entry
                if had is None or total < had[0]:
                    heappush(heaps[back], (total, -to[0] if back else to[0], to[1]))
            if to in other:
                best = min(best, total + other[to][0])
    return _crossing(codes, ahead, behind, settled, best, open_end)


def _crossing(codes, ahead, behind, settled, best, open_end) -> tuple[int, str, int]:
    """The least concatenated audit over all crossings of the best cost."""
    n, found = len(codes), []
    for node in settled[0]:
        i, q = node
        cost, half, _ = ahead[node]
        if i == n and node in behind and cost + behind[node][0] == best:
            found.append((half + behind[node][1], behind[node][2]))
        steps = [(w, x, (i + 1, p)) for w, x, p in _edges(codes[i], q)] if i < n else []
        if not (open_end and i == n):
            steps.append((INSERT, "I", (i, ADDED[q])))
        for w, x, to in steps:
            if to in settled[1] and cost + w + behind[to][0] == best:
                found.append((half + x + behind[to][1], behind[to][2]))
    audit, last = min(found)
    return int(best), audit, last


@lru_cache(maxsize=16_384)
def solved(codes: bytes) -> tuple[int, str]:
    return search(codes)[:2]


def through(codes: bytes, last: bool) -> list[list[float]]:
    """Least costs from every state before a segment to every state behind it."""
    out = []
    for start in range(4):
        at = [float("inf")] * 4
        at[start] = 0
        for k in range(len(codes) + 1):
            if k < len(codes) or last:
                at[2] = min(at[2], INSERT + min(at[0], at[1], at[3]))
                at[3] = min(at[3], INSERT + at[2])
            if k < len(codes):
                to = [float("inf")] * 4
                for q in range(4):
                    for w, _, p in _edges(codes[k], q):
                        to[p] = min(to[p], at[q] + w)
                at = to
        out.append(at)
    return out


def _illegal(codes: bytes) -> int:
    return sum((a & 3, b & 3) not in LEGAL for a, b in zip(codes, codes[1:]))


def _faults(codes: bytes) -> tuple[int, int, int]:
    """Rows by first fault: blank, duplicate, truncated."""
    first = [c & BLANK or c & DUPLICATE or c & TRUNCATED for c in codes]
    return first.count(BLANK), first.count(DUPLICATE), first.count(TRUNCATED)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


# --- Spark -----------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with faults planted by the checksum of conv_id and turn.

    Of 20 remainders one drops a row, one empties its text, one takes its sentence ends, one
    repeats it and one gives it to the user.
    """
    text = F.coalesce(F.col("text"), F.lit(" "))
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        fault.alias("_fault"),
    ).filter("_fault <> 0").withColumn(
        "_copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1)))
    ).drop("_fault", "_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """``(conv, conv_id, turn, role, text, digest)`` without NULL roles and texts."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        null_last(F.col("conv_id").cast("string")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
    )


def _code() -> Column:
    """The row's initial and its faults, but for repetition."""
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    return number + F.when(end == "", BLANK).when(~end.isin(".", "!", "?"), TRUNCATED).otherwise(0)


_AUDITS = "conv string, " + ", ".join(f"{c} long" for c in STATS) + ", audit string"


def _short(light: DataFrame) -> DataFrame:
    """Audits of conversations that a task can hold; rows come in their order."""

    def one(conv: str, rows: Iterable[tuple]) -> tuple:
        codes, seen, turns = bytearray(), set(), []
        for _, turn, digest, code in rows:
            codes.append(code | DUPLICATE if digest in seen else code)
            seen.add(digest)
            if turn is not None and (not turns or turn != turns[-1]):
                turns.append(turn)
        gaps = turns[-1] - turns[0] + 1 - len(turns) if turns else 0
        whole = bytes(codes)
        cost, audit = solved(whole)
        return conv, gaps, *_faults(whole), _illegal(whole), cost, audit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((one(c, g) for c, g in groupby(_rows(batches), key=itemgetter(0))), _ARROW)

    rows = light.repartition("conv").sortWithinPartitions("conv", "turn", "digest")
    return rows.mapInArrow(run, _AUDITS)


_ARROW = pa.schema([("conv", pa.string()), *((c, pa.int64()) for c in STATS), ("audit", pa.string())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, held: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``held`` bytes of text."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size > held:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _segments(light: DataFrame, segment: int) -> DataFrame:
    """``(conv, seg, codes)`` of long conversations; ``seg`` follows their order."""
    rows = cut_lineage(light.groupBy("conv", "digest", "turn", "code").agg(F.count(F.lit(1)).alias("copies")))
    key = F.concat(F.hex("digest"), F.lit(":"), F.col("conv"))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = (
        rows.withColumn("_key", key).groupBy("_key").agg(F.min(turn).alias("_first"), F.count(F.lit(1)).alias("_turns"))
        .filter("_turns > 1").drop("_turns")
    )
    told = salted_join(rows.withColumn("_key", key), again, "_key", ["conv", "digest", "turn"])
    later = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(turn)
    # Copies are unrolled in two steps, so that no row holds a list of all.
    run_ = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / segment)))
    copy = F.explode(F.sequence(F.col("_run") * segment, F.least(F.col("copies"), (F.col("_run") + 1) * segment) - 1))
    each = told.withColumn("_later", later).withColumn("_run", run_).withColumn("copy", copy)
    ordered = each.select(
        "conv", "turn", "digest", "copy",
        (F.col("code") + F.when(F.col("_later") | (F.col("copy") > 0), DUPLICATE).otherwise(0)).alias("code"),
    ).repartitionByRange("conv", "turn", "digest", "copy").sortWithinPartitions("conv", "turn", "digest", "copy")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        number = TaskContext.get().partitionId() << 32
        for conv, group in groupby(_rows(batches), key=itemgetter(0)):
            codes = bytearray()
            for row in group:
                codes.append(row[-1])
                if len(codes) == segment:
                    yield conv, number, bytes(codes)
                    number, codes = number + 1, bytearray()
            if codes:
                yield conv, number, bytes(codes)
                number += 1

    schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("codes", pa.binary())])
    return ordered.mapInArrow(lambda batches: _batches(cut(batches), schema), "conv string, seg long, codes binary")


def _long(light: DataFrame, segment: int) -> DataFrame:
    """Audits of conversations longer than a segment."""
    segs = cut_lineage(_segments(light, segment))
    ends = segs.groupBy("conv").agg(F.max("seg").alias("_last"))
    marked = cut_lineage(segs.join(ends, "conv").select("conv", "seg", "codes", (F.col("seg") == F.col("_last")).alias("last")))

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("by", pa.list_(pa.float64()))])
        yield from _batches(((c, s, sum(through(x, last), [])) for c, s, x, last in _rows(batches)), schema)

    def rests(frame: pd.DataFrame) -> pd.DataFrame:
        rest, out = [0.0 if q in (0, 3) else float("inf") for q in range(4)], []
        for by in frame.sort_values("seg", ascending=False)["by"]:
            out.append(rest)
            rest = [min(by[4 * q + p] + rest[p] for p in range(4)) for q in range(4)]
        return pd.DataFrame({"conv": frame["conv"].iloc[0], "seg": sorted(frame["seg"], reverse=True), "rest": out})

    rest = marked.mapInArrow(costs, "conv string, seg long, by array<double>").groupBy("conv").applyInPandas(
        rests, "conv string, seg long, rest array<double>"
    )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(conv, seg, codes, last, rest):
            ends = tuple((q, int(c)) for q, c in enumerate(rest) if c != float("inf"))
            found = [search(codes, q, ends, not last) for q in range(4)]
            return (conv, seg, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found],
                    [*_faults(codes), _illegal(codes), codes[0] & 3, codes[-1] & 3])

        longs = pa.list_(pa.int64())
        schema = pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("costs", longs), ("audits", pa.list_(pa.string())),
                            ("exits", longs), ("stats", longs)])
        yield from _batches((one(*r) for r in _rows(batches)), schema, 4 << 10)

    halves = marked.join(rest, ["conv", "seg"]).select("conv", "seg", "codes", "last", "rest").mapInArrow(
        searched, "conv string, seg long, costs array<long>, audits array<string>, exits array<long>, stats array<long>"
    )

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        state, audit, before, sums = 0, [], None, [0, 0, 0, 0]
        frame = frame.sort_values("seg")
        for audits, exits, stats in zip(frame["audits"], frame["exits"], frame["stats"]):
            audit.append(audits[state])
            state = int(exits[state])
            sums = [a + int(b) for a, b in zip(sums, stats)]
            sums[3] += before is not None and (before, int(stats[4])) not in LEGAL
            before = int(stats[5])
        return pd.DataFrame([[frame["conv"].iloc[0], 0, *sums, int(frame["costs"].iloc[0][0]), "".join(audit)]],
                            columns=["conv", *STATS, "audit"])

    found = halves.groupBy("conv").applyInPandas(chained, _AUDITS)
    turns = light.select("conv", "turn").distinct().groupBy("conv").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("_gaps"))
    return found.join(turns, "conv").withColumn("gaps", F.coalesce("_gaps", F.lit(0))).drop("_gaps")


def audits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``conv`` (a key), gaps, blank, duplicate, truncated, illegal, cost and audit."""
    light = _keyed(rows).select("conv", "turn", "digest", _code().alias("code"))
    large = cut_lineage(hot_keys(light.select("conv"), "conv", segment).select("conv"))
    if large.isEmpty():
        return _short(light)
    large = broadcast_if_small(large)
    return _short(light.join(large, "conv", "left_anti")).unionByName(
        _long(cut_lineage(light.join(large, "conv", "left_semi")), segment)
    )


def _edited(audit: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """``(turn, role, text, edit)`` of the repaired conversation."""
    odd = (len(audit) - audit.count("D")) % 2  # then it opens with a kept s
    out = 0
    for edit in audit:
        role = "user" if out % 2 == odd else "assistant"
        turn, own, text = (None, None, "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        out += 1
        yield turn, own if edit == "K" else role, text, edit


def _streamed(rows: DataFrame, heads: DataFrame, run, schema) -> DataFrame:
    """Each conversation's head, then its rows in order, through ``run``."""
    body = _keyed(rows).select("conv", F.lit(1).alias("kind"), "turn", "digest", "role", "text", F.lit(None).alias("head"))
    first = heads.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                         F.lit(None).cast("binary").alias("digest"), F.lit("").alias("role"), F.lit("").alias("text"), "head")
    met = first.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "digest")
    return met.select("conv", "turn", "role", "text", "head").mapInArrow(run, schema)


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position, turn, role, text, edit.

    ``found`` are the :func:`audits` of ``rows``; inserted rows have no turn.
    """
    ids = _keyed(rows).groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    heads = ids.join(found, "conv").select("conv", F.struct("conv_id", "audit").alias("head"))
    kind = ids.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("position", T.LongType()),
                           T.StructField("turn", T.LongType())])
    for name in ("role", "text", "edit"):
        schema = schema.add(name, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def edited():
            for _, group in groupby(_rows(batches), key=itemgetter(0)):
                head = next(group)[-1]
                for at, row in enumerate(_edited(head["audit"], (r[1:4] for r in group))):
                    yield head["conv_id"], at, *row

        yield from _batches(edited(), to_arrow_schema(schema))

    return _streamed(rows, heads, run, schema)


def report(rows: DataFrame, original: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Per conv_id of ``original`` the faults of ``rows``, their repair and its hash."""
    ids = original.groupBy(null_last(F.col("conv_id").cast("string")).alias("conv")).agg(F.first("conv_id").alias("conv_id"))
    kept = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in STATS]
    heads = ids.join(audits(rows, segment), "conv", "left").select(
        "conv", F.struct("conv_id", *kept, F.coalesce("audit", F.lit("")).alias("audit")).alias("head"))
    schema = T.StructType([*heads.schema["head"].dataType.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        def hashed():
            for _, group in groupby(_rows(batches), key=itemgetter(0)):
                head = next(group)[-1]
                digest = hashlib.sha256()
                for at, (_, role, text, _) in enumerate(_edited(head["audit"], (r[1:4] for r in group))):
                    digest.update(f"{chr(10) if at else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                yield *head.values(), digest.hexdigest()

        yield from _batches(hashed(), to_arrow_schema(schema))

    return _streamed(rows, heads, run, schema)
