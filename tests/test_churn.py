"""Line churn: exact on short texts, quick and bounded on long ones."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import content
from tidemark.operators import history


def plain(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        before = 0
        for j, b in enumerate(y):
            kept = row[j + 1]
            row[j + 1] = before + 1 if a == b else max(kept, row[j])
            before = kept
    return row[-1]


@pytest.mark.parametrize("block, edits", [(16_384, 1000), (5, 1000), (7, 0), (64, 3)])
def test_lcs_is_exact(monkeypatch, block, edits):
    monkeypatch.setattr(content, "BLOCK_LINES", block)
    monkeypatch.setattr(content, "MAX_EDITS", edits)
    rng = random.Random(2)
    for _ in range(300):
        kinds = rng.choice([2, 5, 40])
        x = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        y = list(x) if rng.random() < 0.5 else [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(y))
            y[at:at + rng.randint(0, 2)] = [rng.randrange(kinds) for _ in range(rng.randint(0, 2))]
        a, b = np.array(x, np.int64), np.array(y, np.int64)
        assert content.lcs_length(a, b) == plain(x, y)
        edits_found = content._few_edits(a, b, 10**6)
        assert (len(x) + len(y) - edits_found) // 2 == plain(x, y)


def test_long_texts(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(500_000)] + ["same"] * 500_000
    rng.shuffle(lines)
    new = list(lines)
    for k in range(50):  # an edit, a line twice, a line taken out
        new[rng.randrange(len(new))] = f"edited {k}"
        at = rng.randrange(len(new))
        new.insert(at, new[at])
        del new[rng.randrange(len(new))]
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(new))], "a string, b string")
    t0 = time.time()
    got = history.churn(rows, "a", "b").select("added", "removed").first()
    assert time.time() - t0 < 60
    assert got["added"] == got["removed"] and 50 <= got["added"] <= 100


def test_far_texts_take_bounded_memory():
    rng = np.random.default_rng(1)
    x, y = rng.permutation(40_000), rng.permutation(40_000)
    # The longest increasing subsequence of a permutation, counted another way.
    place = np.empty(40_000, np.int64)
    place[x] = np.arange(40_000)
    tails = []
    import bisect

    for v in place[y].tolist():
        at = bisect.bisect_left(tails, v)
        tails[at:at + 1] = [v]
    assert content.lcs_length(x, y) == len(tails)


def test_texts_are_moved_last(spark):
    rows = [(f"f{i % 3}", i, f"text {i // 6}", "local") for i in range(60)]
    versions = spark.createDataFrame(rows, "file_path string, timestamp long, content string, source string")
    got = sorted((r["file_path"], r["timestamp"], r["content"], r["added"], r["removed"], r["parent_timestamp"])
                 for r in history.capture_revisions(versions, slices=4).collect())
    want, last = [], {}
    for path, at, text, _ in rows:
        if last.get(path, ("", None))[0] != text:
            old, parent = last.get(path, ("", None))
            want.append((path, at, text, 1, int(old != ""), parent))
            last[path] = (text, at)
    assert got == sorted(want)


def test_rename_of_many_paths(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"f{i % 5}", f"t{i}") for i in range(50)], "id long, file_path string, content string")
    heads = spark.createDataFrame([(f"f{i}", f"h{i}", i) for i in range(5)], "file_path string, content string, head_record_id long")
    moves = spark.createDataFrame([("f1", "f2"), ("f3", "g3")], "old_path string, new_path string")
    seen = []
    for small in (True, False):
        monkeypatch.setattr(history, "is_small", lambda df: small)
        revisions, tops = history.rename_history(rows, heads, moves)
        seen.append((sorted((r["file_path"], r["id"]) for r in revisions.collect()), sorted((r["file_path"], r["content"]) for r in tops.collect())))
    assert seen[0] == seen[1]
    assert seen[0][1] == [("f0", "h0"), ("f2", "h1"), ("f4", "h4"), ("g3", "h3")]
    assert revisions.groupBy("file_path").agg(F.count("*").alias("n")).filter("file_path = 'f2'").first()["n"] == 20
