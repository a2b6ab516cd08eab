"""The pipeline, stage by stage, against plain versions."""

from collections import Counter

import __spark_entry__
import corpus_pipeline

from tests.llm import brute
from tests.llm.test_llm_copies import near_copies
from tidemark.llm import language


def plain(name, rows, columns):
    """What a stage keeps, as a multiset of (doc_id, text)."""
    at = {c: i for i, c in enumerate(columns)}
    pairs = [(r[at["doc_id"]], r[at["text"]]) for r in rows]
    if name == "language":
        return Counter(p for p in pairs if any(c.isalpha() for c in p[1] or ""))
    if name == "simhash":
        best = {}
        for p, g in zip(pairs, near_copies(pairs)):
            best[g] = min(best.get(g, p), p, key=lambda x: x[0])
        return Counter(best.values())
    return Counter((i, brute.redact(t)) for i, t in pairs)


def test_stages(spark, edge, documents, folder, tmp_path):
    for label, docs in (("edge", edge), ("documents", documents)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            rows = docs.collect()
            stage(spark, docs, folder).write.parquet(f"{tmp_path}/{label}/{name}")
            out = spark.read.parquet(f"{tmp_path}/{label}/{name}")
            if name == "packing":
                assert sum(r["length"] for r in out.collect()) == sum(
                    r["doc_tokens"] for r in out.filter("start = 0").collect()
                )
                assert out.select("doc_id").distinct().count() == len(rows)
                break
            assert out.columns == columns
            got = out.collect()
            if name == "mixing":
                sizes = Counter()
                for r in rows:
                    sizes[r["source"]] += len(brute.words(r["text"]))
                taken = Counter()
                for r in got:
                    taken[r["source"]] += len(brute.words(r["text"]))
                want = brute.targets(dict(sizes))
                assert all(abs(taken[s] - want[s]) <= max(2, 0.005 * want[s]) for s in want)
            else:
                assert Counter((r["doc_id"], r["text"]) for r in got) == plain(name, rows, columns)
            docs = out


def test_run(spark, folder):
    first = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    assert first.count() and sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_empty(spark, empty, folder, tmp_path):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries() and language.UNKNOWN == "und"
