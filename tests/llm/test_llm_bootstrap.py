"""The bootstrap with stray seeds, and past its third round."""

from tidemark.llm import pii

EDGES = "pattern string, value string, kind string"


def found(spark, edges):
    out = pii.bootstrap(spark.createDataFrame(edges, EDGES)).collect()
    return {r["value"]: r["found_kind"] for r in out}


def test_one_stray_seed_vetoes_no_context(spark):
    edges = [("reach us at", f"e{i}", "email") for i in range(30)]
    edges += [("reach us at", "p0", "phone"), ("reach us at", "unseen", None)]
    edges += [("even", f"a{i}", "ip") for i in range(9)] + [("even", f"b{i}", "card") for i in range(9)] + [("even", "torn", None)]
    assert found(spark, edges) == {"unseen": "email"}


def test_one_stray_pattern_vetoes_no_instance(spark):
    edges = [(f"m{p}", f"e{p}.{i}", "email") for p in range(4) for i in range(9)]
    edges += [("call", f"p{i}", "phone") for i in range(9)]
    edges += [(p, "unseen", None) for p in ("m0", "m1", "m2", "m3", "call")]
    assert found(spark, edges) == {"unseen": "email"}


def test_rounds_go_on_while_they_find(spark):
    edges = [("seeds", f"0.{j}", "email") for j in range(3)]
    for layer in range(5):  # two patterns of three values teach each value of the next layer
        for j in range(3):
            for p in "ab":
                name = f"{layer}.{j}{p}"
                edges += [(name, f"{layer}.{i}", None) for i in range(3)] + [(name, f"{layer + 1}.{j}", None)]
    assert found(spark, edges) == {f"{layer}.{j}": "email" for layer in range(1, 6) for j in range(3)}
