"""SimHash, quality, personal data and language identification."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import DOCS, prose
from tidemark.llm import language, pii, quality, simhash
from tidemark.llm.queries import QUERIES, op6, op8, op9, op10


def test_bit_slices_match_brute_force():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**64, 40, dtype=np.uint64)[rng.integers(0, 40, 700)]
    for _ in range(4):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))
    cell = np.sort(rng.integers(0, 5, len(fp)))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :])
    for radius in (0, 1, 3, 4, 6):
        i, j = simhash.within(fp, cell, radius)
        want = np.argwhere((near <= radius) & (cell[:, None] == cell[None, :]))
        assert sorted(zip(i.tolist(), j.tolist())) == sorted((a, b) for a, b in want.tolist() if a > b)
        assert len(set(zip(i.tolist(), j.tolist()))) == len(i)


@pytest.mark.parametrize("rows", [1, 2**20, 2**28, 2**34])
def test_masks_leave_no_pair_out(rows):
    rng = np.random.default_rng(2)
    chosen = simhash.masks(rows)
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in chosen)


def check_components(got):
    """component_id is the smallest doc_id of the group by 4 bits or fewer."""
    prints = [int(r["fingerprint"], 16) for r in got]
    pairs = [(i, j) for i in range(len(got)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group = brute.groups(len(got), pairs)
    least = {}
    for g, r in zip(group, got):
        least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    assert [r["component_id"] for r in got] == [least[g] for g in group]


def test_simhash(edge, edge_rows, documents):
    got = op6(edge).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter(
        (r[0], f"{brute.fingerprint(r[1]):016x}") for r in edge_rows
    )
    check_components(got)
    check_components(op6(documents).collect())


def test_simhash_splits_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 7)
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(2**62), 2**62, 40)}
    for seed in (5, -9):  # two chains, each step one bit
        for b in range(30):
            fps.add(seed)
            seed ^= 1 << b
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f, f) for f in fps], "fp long, node long")
    edges = simhash.links(nodes).collect()
    near = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4]
    at = {f: i for i, f in enumerate(fps)}
    assert brute.groups(len(fps), [(at[e.a], at[e.b]) for e in edges]) == brute.groups(len(fps), near)


def test_simhash_keeps_one_of_each_group(edge, edge_rows):
    kept = simhash.without_near_duplicates(edge)
    assert kept.columns == edge.columns
    rows = kept.collect()
    ids = [r["doc_id"] for r in rows]
    want = {r["component_id"] for r in op6(edge).collect()}
    assert sorted(ids) == sorted(want) and {r["_rest"] for r in rows} == {"clash"}


def test_quality_counts(edge, edge_rows, documents):
    for docs, rows in ((edge, edge_rows), (documents, documents.collect())):
        want = Counter((r[0], *brute.quality_counts(r[1])) for r in rows)
        got = op8(docs).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_agrees_with_labels(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = op8(docs).join(labels, "doc_id").filter("not base_failed").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)


def test_weak_supervision_learns_accuracies():
    votes = [((1, 1, None), 800), ((0, 0, None), 90), ((0, 1, 1), 10), ((1, 1, 1), 100)]
    model = quality.estimate(votes)
    right = model["right"]
    assert quality.posterior((0, 0, None), model["good"], right) < 0.5 < quality.posterior((1, 1, 1), model["good"], right)
    assert quality.estimate([])["good"] == quality.START_GOOD


TRICKY = [
    "a@b.c_x@d.e", "@x.y a@b a@b. a@b.c.", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "256.1.1.1 001.002.003.004",
    "99999999999999999999.1.1.1", "4111-1111-1111-1111", "4111  1111 1111 1111 1", "41111111111111111111111",
    "5 4111 1111 1111 1111", "+1+12345678", "+49 (0) 30-1234567)", "+1.2345678 +12 34", "\U0001d54fé a@b.de 1.1.1.1",
    "+4111111111111111 4111111111111111", "1-2-3", "mail:a%b@c-d.e-f\n+123 456 789 0 x", "0.0.0.0", "a@b.c" * 40,
]


def test_base_spans_match_patterns(spark, edge, edge_rows):
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(TRICKY)] + [
        (100, "x" * 50_000 + "9 " * 20_000 + "1." * 20_000, None, None, None, None, None)
    ]
    for docs, given in ((spark.createDataFrame(rows, DOCS), rows), (edge, edge_rows)):
        want = {}
        for r in given:
            s = brute.spans(r[1])
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in s)
            want[r[0]] = (*(sum(x[0] == k for x in s) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest())
        got = op9(docs).collect()
        assert len(got) == len(given)
        for r in got:
            assert tuple(r)[1:6] == want[r["doc_id"]], given


def test_bootstrap_finds_unseen_identifiers(spark):
    texts = [f"{prose(i, 12)} reach us at {i}user@mail.example.com {prose(90 + i, 6)}" for i in range(12)]
    texts.append(f"{prose(70, 9)} reach us at user99(at)mail9 {prose(71, 5)}")
    texts.append(f"{prose(72, 9)} order number 1234567 {prose(73, 5)}")
    rows = [(i, t, None, None, None, None, None) for i, t in enumerate(texts)]
    rows[3] = (3, texts[3].replace("reach us at 3user@mail.example.com", "reach us at user33@localhost"), *rows[3][2:])
    got = {r["doc_id"]: r["spans"] for r in op9(spark.createDataFrame(rows, DOCS)).collect()}
    start = rows[3][1].index("user33@localhost")
    assert got[3] == f"email:{start}:{start + len('user33@localhost')}"
    assert got[13] == ""
    assert all(s.count(":") == 2 for i, s in got.items() if i not in (3, 12, 13))


def test_redaction(edge, edge_rows):
    got = pii.redacted(edge)
    assert got.columns == edge.columns
    assert Counter((r["doc_id"], r["text"], r["_rest"]) for r in got.collect()) == Counter(
        (r[0], brute.redact(r[1]), "clash") for r in edge_rows
    )


def test_language(spark, folder, edge):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    rows = op10(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    got = {r["doc_id"]: r for r in op10(edge).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (brute.fold(i, 4) == 2) for i, r in got.items())
    kept = language.with_language(edge, *language.fit(edge, F.lit(True)))
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {1, 2, 3, 8}
    none = language.predict(edge, *language.fit(edge, F.lit(False)), ["doc_id"]).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_language_mixture():
    logs = np.log(np.full((3, language.CELLS), 1e-6))
    for k, text in enumerate(("aaa", "bbb", "ccc")):
        logs[k, np.unique(language.trigrams(text))] = np.log(0.3)
    found = language.infer("aaa " * 60 + "bbb " * 40, logs)
    assert [i for i, _ in found] == [0, 1] and abs(found[0][1] - 0.6) < 0.02
    assert [i for i, _ in language.infer("ccc " * 50, logs)] == [2]


@pytest.mark.parametrize("name", ["op6_simhash", "op8_quality", "op9_pii", "op10_language"])
def test_empty_tables(spark, empty, tmp_path, name):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
