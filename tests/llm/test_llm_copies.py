"""Near copies of the pipeline's stage, against all pairs."""

import random

import corpus_pipeline
import pytest

from tests.llm import brute
from tests.llm.conftest import DOCS
from tidemark.llm import jaccard, simhash


def grams(text):
    ws = brute.words(brute.ascii_lower(text))
    return frozenset(tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(rows):
    """The group of each row, over all pairs."""
    sets = [grams(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    return brute.groups(len(rows), pairs)


def kept(rows):
    """doc_ids that stay: the smallest of each group."""
    best = {}
    for g, (d, _) in zip(near_copies(rows), rows):
        best[g] = min(best.get(g, d), d)
    return sorted(best.values())


def planted():
    """Texts with copies whose similarity lies between 0.6 and 1, and their likeness."""
    rng = random.Random(5)
    rows, seen = [], []
    for k in range(60):
        ws = [f"w{rng.randrange(4000)}" for _ in range(300)]
        rows.append((10 * k, " ".join(ws)))
        copy = list(ws)
        for at in rng.sample(range(10, 290), 1 + k % 12):
            copy[at] = f"x{k}.{at}"
        rows.append((10 * k + 1, " ".join(copy)))
        seen.append(alike(grams(rows[-1][1]), grams(rows[-2][1])))
    return rows, seen


@pytest.mark.parametrize("limit", [1024, 8])
def test_stage_drops_copies_from_0_8_on(spark, monkeypatch, folder, limit):
    monkeypatch.setattr(jaccard, "CELL_ROWS", limit)
    rows, seen = planted()
    assert sum(0.8 <= j <= 0.95 for j in seen) >= 20 and sum(j < 0.8 for j in seen) >= 10
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "r", 1) for i, t in rows], DOCS).repartition(3)
    out = corpus_pipeline.simhash_stage(spark, docs, folder)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == kept(rows)


def test_stage_on_documents(spark, documents, edge, folder):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, documents, folder).collect()) == kept(rows)
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, edge, folder).collect()) == kept(rows)


def test_simhash_alone_finds_close_copies(spark, monkeypatch, folder):
    # Without MinHash bands: pairs within the radius are found, verified, and no others.
    for name in ("BANDS", "FIRST_BANDS"):
        monkeypatch.setattr(jaccard, name, 0)
    rows, seen = planted()
    prints = [simhash.majority(jaccard.shingles(t)) for _, t in rows]
    close = [(a ^ b).bit_count() <= jaccard.RADIUS for a, b in zip(prints[::2], prints[1::2])]
    want = [near and like >= 0.8 for near, like in zip(close, seen)]
    assert 5 <= sum(want) < sum(like >= 0.8 for like in seen)
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), "r", 1) for i, t in rows], DOCS).repartition(3)
    out = {r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, folder).collect()}
    assert [d + 1 not in out for d, _ in rows[::2]] == want and {d for d, _ in rows[::2]} <= out
