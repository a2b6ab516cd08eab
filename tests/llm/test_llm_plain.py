"""Scores and verdicts against plain versions; odd columns, NULL ids and long texts."""

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import DOCS, prose
from tidemark.llm import lm, quality
from tidemark.llm.queries import op2, op3, op4, op6, op7, op8, op9, op10, op13


def test_lm_scores_match_plain(spark, documents, edge):
    for docs in (documents.limit(120), edge):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        texts = [(i, [*brute.words(brute.ascii_lower(t)), "\n"]) for i, t in rows]
        word, pair = Counter(), Counter()
        for i, ws in texts:
            if brute.fold(i, 5) != 1:
                word.update(ws)
                pair.update(zip(["\n", *ws], ws))
        known, v = sum(word.values()), len(word)
        last = 1 / (v + 1)
        cells = Counter()
        for (a, b), n in pair.items():  # each event is left out of the counts that predict it
            after = np.array([word[a] - 1])
            cells[int((lm._context_bucket(after)[0] * lm.STEPS
                       + lm._step(np.array([(n - 1) / max(word[a] - 1, 1) / last]))[0]) * lm.STEPS
                      + lm._step(np.array([(word[b] - 1) / max(known - 1, 1) / last]))[0])] += n
        weight = lm.learn_weights(np.array(sorted(cells), np.int64), np.array([cells[c] for c in sorted(cells)], float))
        want = Counter()
        for i, ws in texts:
            total = 0.0
            for a, b in zip(["\n", *ws], ws):
                w = weight[lm._context_bucket(np.array([word[a]]))[0]]
                total += np.log10(w[0] * pair[a, b] / max(word[a], 1) + w[1] * word[b] / max(known, 1) + w[2] * last)
            want[i, len(ws), round(float(total), 6)] += 1
        got = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in op7(docs).collect())
        assert got == want


def votes(text):
    """Each rule's vote in the order of the rules; None abstains."""
    ws = brute.words(text)
    n, chars, symbols, dup, repeats = brute.quality_counts(text)
    bare = "".join(ws)
    lines = [x for x in (text or "").split("\n") if x.strip(brute.SPACE)]
    w, c = max(n, 1), max(chars, 1)
    upper, letters = sum(x.isupper() for x in bare), sum(x.isalnum() for x in bare)
    runs, bars = len(re.findall(r"[#*$%&|<>]{2,}", bare)), sum(x == "|" for x in ws)
    shouts, distinct, mean = sum(x in "!?" for x in bare), len(set(ws)) / w, chars / w

    def vote(bad, good):
        return 0 if bad else 1 if good else None

    return (
        vote(symbols / w > 0.1, symbols / w < 0.02), vote(runs / w > 0.05, runs / w < 0.01), vote(bars / w > 0.1, bars / w < 0.02),
        vote(letters / c < 0.75, letters / c > 0.85), vote(repeats / w > 0.28, repeats / w < 0.25),
        vote(dup / max(len(lines), 1) > 0.3, dup / max(len(lines), 1) < 0.1),
        vote((distinct < 0.15 and n >= 50) or (distinct < 0.35 and n <= 100), distinct > 0.4),
        vote(upper / c > 0.3, upper / c < 0.12), vote(shouts / w > 0.1, shouts / w < 0.03),
        vote(mean < 2.5 or mean > 12, 3.5 <= mean <= 9),
    )


def test_quality_verdicts_match_plain(spark, documents):
    rows = documents.collect()
    cast = {r["doc_id"]: votes(r["text"]) for r in rows}
    model = quality.estimate(sorted(Counter(cast.values()).items(), key=str))
    got = {r["doc_id"]: r for r in op8(documents).collect()}
    assert got.keys() == cast.keys()
    for i, v in cast.items():
        p = quality.posterior(v, model["good"], model["right"])
        assert abs(got[i]["posterior"] - p) < 1e-9
        assert got[i]["kept"] == (not got[i]["base_failed"] and p >= 0.5)


def test_vectors_with_clashing_columns_and_no_ids(spark):
    rng = np.random.default_rng(8)
    v = [float(x) for x in rng.normal(size=32)]
    w = [float(x) for x in rng.normal(size=32)]
    rows = [(None, v, 1, "a", 2, 3), (5, v, 1, "b", 2, 3), (5, v, 1, "b", 2, 3), (7, w, 1, "c", 2, 3), (None, None, 1, "d", 2, 3), (9, [x * 3 for x in w], 1, "e", 2, 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, vector string, n int, component int")
    got = op2(table).collect()
    assert Counter(r["vec_id"] for r in got) == Counter(r[0] for r in rows)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] is not None) == [
        (5, 2, 5), (5, 2, 5), (7, 1, 7), (9, 1, 7)
    ]


def test_texts_of_many_words(spark):
    long = prose(11, 250_000)
    rows = [(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "x" * 400_000, "en", "b"), (4, "short text", "de", "b")]
    docs = spark.createDataFrame([(i, t, la, s, len(t), "clash", 7) for i, t, la, s in rows], DOCS)
    sizes = {i: len(brute.words(t)) for i, t, *_ in rows}
    assert {r["doc_id"]: r["size"] for r in op3(docs).collect()} == sizes
    assert {r["doc_id"]: r["n_tokens"] for r in op7(docs).collect()} == {i: n + 1 for i, n in sizes.items()}
    assert {r["doc_id"]: r["n_words"] for r in op8(docs).collect()} == sizes
    prints = {r["doc_id"]: r for r in op6(docs).collect()}
    assert all(int(prints[i]["fingerprint"], 16) == brute.fingerprint(t) for i, t, *_ in rows) and prints[2]["component_id"] == 1
    assert op4(docs).agg(F.countDistinct("doc_id")).first()[0] == 4
    assert {r["doc_id"] for r in op9(docs).collect()} == {r["doc_id"] for r in op10(docs).collect()} == {1, 2, 3, 4}
    assert op13(docs).filter("part = 'pair'").count() == 2
