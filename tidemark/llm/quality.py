"""Quality rules as weak supervision.

Each rule looks at a few counts of a document and votes good, bad or abstains.
Expectation-maximisation over the histogram of vote patterns (at most 3 to the power
of the rules; in practice a few dozen) estimates each rule's accuracy on good and on bad documents and the
share of good ones; a document is kept when its posterior is one half or more.  No
label is read.

Defined results: NULL and empty texts have zero counts and fail the base rules; very
long texts are counted whole; repeated rows are counted like others; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut_lineage, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT = 0.30
# Chance of a true vote, on bad and on good documents: where it starts, and its bounds.
# A rule sees one kind of fault, so most bad documents pass it; few good ones fail it.
START = (0.3, 0.99)
BOUNDS = ((0.1, 0.99), (0.98, 0.9999))
START_GOOD = 0.8
EM_ROUNDS = 50


def counts(docs: DataFrame) -> DataFrame:
    """The counts that rules look at, one row per document; texts aren't shuffled."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, SPACE, "")
    without = lambda chars: F.length("_bare") - F.length(F.translate("_bare", chars, ""))
    base = docs.select(
        "doc_id", words(F.col("text")).alias("_words"), bare.alias("_bare"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("_lines"),
    )
    n = F.size("_words")
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))
    )).otherwise(F.array().cast("array<bigint>"))
    base = base.withColumn("_windows", windows)
    # Only texts in which a window comes twice need the places of such windows.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    placed = F.when(twice, F.sort_array(F.arrays_zip(
        F.col("_windows").alias("h"), F.sequence(F.lit(1), F.size("_windows")).alias("i")
    )))
    base = base.withColumn("_placed", placed)
    pairs = F.arrays_zip(
        F.col("_placed").alias("me"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("_placed", 1, F.size("_placed") - 1)).alias("a"),
        F.slice("_placed", 2, F.size("_placed")).alias("b"),
    )
    same = lambda p, k: F.coalesce(p[k]["h"] == p["me"]["h"], F.lit(False))
    starts = F.sort_array(F.transform(
        F.filter(pairs, lambda p: same(p, "a") | same(p, "b")), lambda p: p["me"]["i"]
    ))
    base = base.withColumn("_starts", starts)
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return base.select(
        "doc_id", n.cast("long").alias("n_words"),
        F.length("_bare").cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_bare") - F.length(F.regexp_replace("_bare", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_bare", r"[^\p{L}\p{N}]+", "")).cast("long").alias("n_letters"),
        without("!?").cast("long").alias("n_shouts"),
        F.regexp_count("_bare", F.lit("[#*$%&|<>]{2,}")).cast("long").alias("n_runs"),
        F.size(F.array_remove("_words", "|")).cast("long").alias("n_unbarred"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
    )


def rules() -> dict[str, Column]:
    """Name to vote: 1 good, 0 bad, NULL abstains."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 1)

    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    dup = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    distinct = per_word("n_distinct")
    bars = (F.col("n_words") - F.col("n_unbarred")) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": vote(per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.02),
        "runs": vote(per_word("n_runs") > 0.05, per_word("n_runs") < 0.01),
        "bars": vote(bars > 0.1, bars < 0.02),
        "letters": vote(per_char("n_letters") < 0.75, per_char("n_letters") > 0.85),
        "repeats": vote(per_word("n_repeat_words") > 0.28, per_word("n_repeat_words") < 0.25),
        "lines": vote(dup > 0.3, dup < 0.1),
        # Short texts repeat little, so a small share of distinct words tells there early.
        "variety": vote(
            (distinct < 0.15) & (F.col("n_words") >= 50) | (distinct < 0.35) & (F.col("n_words") <= 100),
            distinct > 0.4,
        ),
        "upper": vote(per_char("n_upper") > 0.3, per_char("n_upper") < 0.12),
        "shouts": vote(per_word("n_shouts") > 0.1, per_word("n_shouts") < 0.03),
        "word_length": vote((mean < 2.5) | (mean > 12), mean.between(3.5, 9)),
    }


def estimate(patterns: list[tuple[tuple, int]], rounds: int = EM_ROUNDS) -> dict:
    """EM over ``(votes, documents)`` pairs: prior and two accuracies per rule."""
    k = len(patterns[0][0]) if patterns else 0
    good, right = START_GOOD, [list(START) for _ in range(k)]
    clip = lambda x, y: min(max(x, BOUNDS[y][0]), BOUNDS[y][1])
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        mass, hit, seen = 0.0, [list(START) for _ in range(k)], [[1.0, 1.0] for _ in range(k)]
        for votes, n in patterns:
            p = posterior(votes, good, right)
            mass += n * p
            for j, v in enumerate(votes):
                if v is not None:
                    for y, share in ((1, p), (0, 1 - p)):
                        seen[j][y] += n * share
                        hit[j][y] += n * share * (v == y)
        good = min(max(mass / total, 0.05), 0.99)
        right = [[clip(hit[j][y] / seen[j][y], y) for y in (0, 1)] for j in range(k)]
    return {"good": good, "right": right}


def posterior(votes: tuple, good: float, right: list) -> float:
    """Probability that a document with these votes is good."""
    score = math.log(good) - math.log(1 - good)
    for j, v in enumerate(votes):
        if v is not None:
            bad_, good_ = right[j]
            score += math.log(good_ / (1 - bad_)) if v == 1 else math.log((1 - good_) / bad_)
    return 1 / (1 + math.exp(-max(min(score, 700), -700)))


def judge(docs: DataFrame, min_posterior: float = 0.5) -> DataFrame:
    """Counts, base verdict, ``posterior`` and ``kept`` per document."""
    named = rules()
    table = cut_lineage(counts(docs).select("*", *[v.cast("int").alias(f"_v_{k}") for k, v in named.items()]))
    cols = [f"_v_{k}" for k in named]
    # At most 3 ** 10 = 59,049 rows, whatever the size of the corpus.
    seen = [(tuple(r[:-1]), r[-1]) for r in table.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()]
    model = estimate(seen)
    log_odds = F.lit(math.log(model["good"]) - math.log(1 - model["good"]))
    for c, (bad_, good_) in zip(cols, model["right"]):
        log_odds = log_odds + F.when(F.col(c) == 1, math.log(good_ / (1 - bad_))).when(
            F.col(c) == 0, math.log((1 - good_) / bad_)
        ).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(MAX_REPEAT * 100))
    out = table.withColumn("posterior", 1 / (1 + F.exp(-log_odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior)).drop(*cols)
