"""Conversation repair against a plain version that tries all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tidemark.llm import repair
from tidemark.llm.queries import op12

ROWS = "conv_id long, turn long, role string, text string, conv string, digest string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds):
    """(cost, audit, roles kept) over kinds (initial, forced, truncated), by plain recursion."""
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @lru_cache(None)
    def best(i, state, added):
        found = []
        if i == len(kinds) and state in ("", "a"):
            found.append((0, ""))
        if added < 3:
            for role in "ua":
                if role in step[state]:
                    c, a = best(i, role, added + 1)
                    found.append((c + 2, "I" + a))
        if i < len(kinds):
            initial, forced, cut = kinds[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if not forced:
                if initial in step[state]:
                    c, a = best(i + 1, initial, 0)
                    found.append((c + cut, "K" + a))
                for role in "ua":
                    if role in step[state]:
                        c, a = best(i + 1, role, 0)
                        found.append((c + 2 + cut, "R" + a))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def plain(rows):
    """conv_id -> contract columns, from all rows of the original table."""
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        row = (turn, "user" if fault == 4 else role, text)
        convs[conv] += [] if fault == 0 else [row] * (2 if fault == 3 else 1)
    out = {}
    for conv, got in convs.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        turns = {t for t, _, _ in got if t is not None}
        seen, kinds, n = set(), [], [0, 0, 0]
        for _, role, text in got:
            end = WORD.findall(text)
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[-1] not in ".!?" else 3
            seen.add((role, text))
            kinds.append((role[:1], fault < 2, int(fault == 2)))
            if fault < 3:
                n[fault] += 1
        pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        cost, audit = cheapest(tuple(kinds))
        lines, left = [], iter(got)
        size = len(audit) - audit.count("D")
        roles = ["s"] * (size % 2) + ["user", "assistant"] * (size // 2)
        for edit in audit:
            row = next(left) if edit != "I" else (None, "", "")
            if edit != "D":
                role = roles.pop(0)
                lines.append(f"{row[1] if edit == 'K' else role}:{row[2]}")
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *n, pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def given():
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", None, "", "tool", "usher"])
            text = rng.choice(["Yes.", "no", "", None, " \n\t", f"It is {turn}!", "é ünd 中?\n", "\xa0"])
            rows.append((conv, rng.choice([turn, turn, turn * 2, None, 0]), role, text, "clash", "x"))
    rows += [(70, t, "user" if t % 2 == 0 else "assistant", "long " * 50_000 + f"{t}.", None, None) for t in range(5)]
    return rows + rows[:9] + [rows[4]] * 7


def test_search_finds_least_audit():
    rng = random.Random(1)
    for _ in range(600):
        kinds = tuple((rng.choice("suaaux"), rng.random() < 0.2, int(rng.random() < 0.2)) for _ in range(rng.randint(0, 9)))
        codes = bytes(
            "sua".find(i) % 4 + repair.DUPLICATE * f + repair.TRUNCATED * c for i, f, c in kinds
        )
        assert repair.search(codes)[:2] == cheapest(kinds)
        by = repair.through(codes, True)
        assert min(by[0][0], by[0][3]) == cheapest(kinds)[0]


@pytest.mark.parametrize("segment", [repair.SEGMENT, 4, 1])
def test_repair_matches_plain(spark, segment):
    rows = given()
    table = spark.createDataFrame(rows, ROWS).repartition(3)
    got = repair.report(repair.damaged(table), table, segment).collect()
    want = plain(rows)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_repaired_rows_are_sound(spark):
    table = spark.createDataFrame(given(), ROWS)
    broken = repair.damaged(table)
    found = repair.audits(broken)
    by = {}
    for r in repair.repaired_rows(broken, found).orderBy("conv_id", "position").collect():
        by.setdefault(r["conv_id"], []).append(r)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in op12(table).collect()}
    for conv, rows in by.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in rows))
        assert [r["position"] for r in rows] == list(range(len(rows)))
        whole = "\n".join(f"{r['role']}:{r['text']}" for r in rows)
        assert hashlib.sha256(whole.encode()).hexdigest() == hashes[conv]


def test_repair_of_little(spark):
    table = spark.createDataFrame([], ROWS)
    assert op12(table).collect() == []
    none = spark.createDataFrame([(1, 0, "user", "", None, None)], ROWS)
    got = repair.report(none.filter("false"), none).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    same = spark.createDataFrame([(1, None, "user", "Same.", None, None)] * 50, ROWS)
    for segment in (4096, 8):
        got = repair.report(same, same, segment).collect()
        assert [(r["duplicate"], r["cost"], r["audit"]) for r in got] == [(49, 149, "K" + "D" * 49 + "I")]
