"""The source divergence audit against plain counting."""

import re
from collections import Counter, defaultdict

import pytest

from tests.llm.conftest import prose
from tidemark.llm import divergence
from tidemark.llm.queries import op13

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=10, top=10):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {la for la, _ in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)
        own = sorted(s for la, s in groups if la == lang)

        def p_of(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * v) for t in kept}

        p = {s: p_of(count[lang, s]) for s in own}
        q = p_of(sum((count[lang, s] for s in own), Counter()))

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in own:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -x, k + 1) for k, (x, i) in enumerate(found)}
    return out


def test_divergence_on_the_table(spark, documents):
    assert {tuple(r) for r in op13(documents).collect()} == plain([tuple(r) for r in documents.collect()])


@pytest.mark.parametrize("tile", [1, 2, 64])
def test_divergence_of_odd_rows(spark, monkeypatch, edge, edge_rows, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 3)
    monkeypatch.setattr(divergence, "HELD", 20)
    for min_docs in (1, 2, 99):
        got = divergence.audit(edge, min_docs, 3).collect()
        assert {tuple(r) for r in got} == plain(edge_rows, min_docs, 3) and len(got) == len(plain(edge_rows, min_docs, 3))


def test_divergence_of_a_long_text_and_a_hot_group(spark):
    rows = [(i, prose(i % 7, 30) + " Tail", "en", "hot" if i % 3 else f"s{i}") for i in range(60)]
    rows.append((99, prose(5, 200_000), "en", "long"))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in op13(table).collect()} == plain(rows)


def test_divergence_of_nothing(spark, empty):
    assert op13(empty).collect() == []


def test_p_is_exact_beyond_64_bits(spark):
    n, total, kept = 5 * 10**11, 3 * 10**13, 10**8
    row = spark.sql(f"select {n}l as n, {total}l as t, {kept}l as v")
    from pyspark.sql import functions as F

    got = row.select(divergence.p_of(F.col("n"), F.col("t"), F.col("v")).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * kept)
