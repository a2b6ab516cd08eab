"""Clock matrices, and every branch of the relation against a plain table."""

import itertools

from pyspark.sql import functions as F

from tidemark.functions import clocks
from tidemark.operators import classify, clock_ops

CLOCKS = [None, {}, {"a": 0}, {"a": 1}, {"a": 2}, {"b": 1}, {"a": 1, "b": 1}, {"a": 2, "b": 1}, {"a": 1, "b": 2}]


def plain_relation(a, b):
    a, b = a or {}, b or {}
    keys = set(a) | set(b)
    gt = any(a.get(k, 0) > b.get(k, 0) for k in keys)
    lt = any(a.get(k, 0) < b.get(k, 0) for k in keys)
    return "concurrent" if gt and lt else "dominates" if gt else "dominated" if lt else "equal"


def test_relation_merge_and_increment(spark):
    pairs = list(itertools.product(CLOCKS, CLOCKS))
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a map<string,bigint>, b map<string,bigint>"
    )
    rows = df.select(
        "i", clocks.relation("a", "b").alias("r"), clocks.merge("a", "b").alias("m"),
        clocks.merge("b", "a").alias("m2"), clocks.increment("a", "a").alias("inc"),
        clocks.latest_device("a").alias("top"),
    ).collect()
    for row in rows:
        a, b = pairs[row["i"]]
        assert row["r"] == plain_relation(a, b)
        want = {k: max((a or {}).get(k, 0), (b or {}).get(k, 0)) for k in set(a or {}) | set(b or {})}
        assert row["m"] == want == row["m2"]
        assert row["inc"] == {**(a or {}), "a": (a or {}).get("a", 0) + 1}
        top = min(((-n, k) for k, n in (a or {}).items()), default=(0, None))[1]
        assert row["top"] == top


def test_dominators_match_pairwise(spark):
    groups = list(itertools.combinations(range(len(CLOCKS)), 3))
    data = [(g, f"id{i}", CLOCKS[c]) for g, combo in enumerate(groups) for i, c in enumerate(combo)]
    df = spark.createDataFrame(data, "g int, _id string, vclock map<string,bigint>")
    got = {r["g"]: r["dominator"] for r in clock_ops.dominators(df, ["g"]).collect()}
    for g, combo in enumerate(groups):
        best = [
            f"id{i}" for i, c in enumerate(combo)
            if all(plain_relation(CLOCKS[c], CLOCKS[o]) in ("equal", "dominates") for o in combo)
        ]
        assert got[g] == (best[0] if best else None)


def plain_six_way(lvc, rvc, same_bytes, ld, rd, base, attributed, recreate):
    rel = plain_relation(lvc, rvc)
    same = ld == rd and (ld or same_bytes)
    if same:
        return "identical" if rel == "equal" else "vclock-only-drift"
    if rel == "concurrent":
        return "true-divergent"
    if rel == "dominated":
        explained = base == "match"
        if rd and not ld and attributed:
            return "remote-edit" if explained else "true-divergent"
        if base == "none":
            return "remote-edit"
        if base == "legacy":
            return "legacy-skip"
        return "remote-edit" if explained and not ld else "true-divergent"
    if rel == "equal" and not attributed:
        return "remote-edit" if recreate else "true-divergent"
    return "local-edit"


def test_every_branch_of_the_relation(spark):
    cases = list(
        itertools.product(
            [({"a": 1}, {"a": 1}), ({"a": 2}, {"a": 1}), ({"a": 1}, {"a": 2}), ({"a": 1}, {"b": 1})],
            [True, False], [True, False], [True, False],
            ["none", "legacy", "match", "other", "deleted"], [True, False], [True, False],
        )
    )
    rows = []
    for i, ((lvc, rvc), same, ld, rd, base, att, rec) in enumerate(cases):
        b = {
            "none": (None, None, None, None), "legacy": ({"a": 1}, None, None, False),
            "match": ({"a": 1}, ["x"], 1, False), "other": ({"a": 1}, ["z"], 1, False),
            "deleted": ({"a": 1}, [], 0, True),
        }[base]
        rows.append((i, lvc, ["x"], 1, ld, rvc, ["x"] if same else ["y"], 1, rd, *b, att, rec))
    v = "vclock map<string,bigint>, {0}chunks array<string>, {0}size bigint, {0}deleted boolean"
    schema = "i int, " + ", ".join(p + v.format(p) for p in ("l_", "r_", "b_")) + ", attributed boolean, recreate boolean"
    got = {r["i"]: r["relation"] for r in classify.classify_relation(spark.createDataFrame(rows, schema)).collect()}
    for i, ((lvc, rvc), same, ld, rd, base, att, rec) in enumerate(cases):
        assert got[i] == plain_six_way(lvc, rvc, same, ld, rd, base, att, rec), cases[i]


def test_verdict_without_local(spark):
    row = spark.range(1).select(classify.verdict(F.lit(False), F.lit(None).cast("string")).alias("v")).first()
    assert row["v"] == "take-remote"
