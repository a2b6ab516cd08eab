"""Language identification by multilingual mixture inference.

Letter trigrams are counted per language over all training documents, in a fixed
number of hashed cells, and smoothed.  A document is a mixture: expectation-
maximisation estimates the share of each language from the likelihoods of its
trigrams.  Sets of its strongest languages are then fitted anew, and the set with the
best likelihood less a penalty per language is its language set; the language of the
largest share in that set's own mixture is the prediction, and that share the score.

Only text and language of training documents teach the model.  It holds ``CELLS``
numbers per language, whatever the corpus; that is all the driver sees.

Defined results: ``und`` with score 0 for NULL texts, texts without a letter, and
where no training document taught anything; texts are read whole; NULL languages
teach nothing but are predicted; equal shares go to the language first by code point;
repeated rows are counted like others; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import unwrapped, wrapped

CELLS = 1 << 16
SMOOTHING = 0.05
ROUNDS = 15
PENALTY = 8.0  # times log(trigrams) / 2, for each language after the first
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points of the first plane are letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def trigrams(text: str | None) -> np.ndarray:
    """Cell numbers of the letter trigrams of a whole text; words end in blanks.

    Empty where the text has no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        letter[far] = [chr(c).isalpha() for c in points[far].tolist()]
    c = np.concatenate((np.zeros(1, np.uint32), np.where(letter, points, 0).astype(np.uint32), np.zeros(1, np.uint32)))
    a, b, d = c[:-2], c[1:-1], c[2:]
    mixed = a * np.uint32(2654435761) ^ b * np.uint32(2246822519) ^ d * np.uint32(3266489917)
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(CELLS))[b > 0]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """``(lang, cell, n)`` over all rows of ``labelled`` (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                found = trigrams(text.as_py())
                if lang not in held:
                    held[lang] = np.zeros(CELLS, np.int64)
                held[lang] += np.bincount(found, minlength=CELLS)
        for lang, n in held.items():
            cell = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(n[cell])],
                ["lang", "cell", "n"],
            )

    rows = labelled.select("text", "lang").mapInArrow(run, "lang string, cell int, n long")
    return rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, training: Column, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and the logarithms of their trigram probabilities."""
    labelled = docs.filter(training & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    counted = gram_counts(labelled).toPandas()  # at most CELLS rows per language
    langs = sorted(set(counted["lang"]))
    n = np.zeros((len(langs), CELLS))
    n[np.searchsorted(np.array(langs, object), counted["lang"].to_numpy(object)) if langs else [], counted["cell"]] = counted["n"]
    total = n.sum(axis=1, keepdims=True)
    return langs, np.log((n + SMOOTHING) / (total + SMOOTHING * CELLS)).astype(np.float32)


def _mixture(p: np.ndarray, n: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Shares of the rows of ``p`` and the log-likelihood they reach."""
    share, total = start, n.sum()
    for _ in range(rounds):
        mixed = share @ p
        share = share * (p @ (n / mixed)) / total
    return share, float(n @ np.log(share @ p))


def infer(text: str | None, logs: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> list[tuple[int, float]]:
    """``(language, share)`` of the chosen language set, strongest first.

    Shares are those of the mixture of the set alone.  Another language joins the set
    while the likelihood gains more than the penalty by it.
    """
    found = trigrams(text)
    if not len(found) or not len(logs):
        return []
    n = np.bincount(found, minlength=1)
    cell = np.flatnonzero(n)
    n = n[cell].astype(float)
    at = logs[:, cell].astype(float)
    top = at.max(axis=0)
    p = np.exp(np.maximum(at - top, -50.0))
    k = len(logs)
    whole, _ = _mixture(p, n, np.full(k, 1 / k), rounds)
    order = np.argsort(-whole, kind="stable")
    cost = penalty * np.log(max(2.0, n.sum())) / 2
    chosen, share, reached = order[:1], np.ones(1), float(n @ np.log(np.maximum(p[order[0]], 1e-300)))
    for size in range(2, k + 1):
        start = np.maximum(whole[order[:size]], 1e-6)
        fitted, value = _mixture(p[order[:size]], n, start / start.sum(), rounds)
        if value - reached <= cost:
            break
        chosen, share, reached = order[:size], fitted, value
    return [(int(chosen[i]), min(float(share[i]), 1.0)) for i in np.argsort(-share, kind="stable")]


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row with lang_pred, score, lang_set and the set's shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [infer(t.as_py(), logs) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1],
                 pa.array([langs[s[0][0]] if s else UNKNOWN for s in sets], pa.string()),
                 pa.array([s[0][1] if s else 0.0 for s in sets], pa.float64()),
                 pa.array([[langs[i] for i, _ in s] for s in sets], pa.list_(pa.string())),
                 pa.array([[share for _, share in s] for s in sets], pa.list_(pa.float64()))],
                [*keep, "lang_pred", "score", "lang_set", "shares"],
            )

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType(source.schema.fields[:-1])
    schema = schema.add("lang_pred", "string").add("score", "double")
    schema = schema.add("lang_set", T.ArrayType(T.StringType())).add("shares", T.ArrayType(T.DoubleType()))
    return source.mapInArrow(run, schema)


def _with_letters(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([len(trigrams(t.as_py())) > 0 for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def with_language(docs: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """The rows of ``docs`` with a letter; a NULL lang is the one found, if any was learned."""
    rows = wrapped(docs)
    if not langs:
        return unwrapped(_with_letters(rows), docs.columns)
    # A text without a letter has no language set; ``und`` may as well be a learned label.
    found = predict(rows, langs, logs, ["doc_id", "text", "_rest"]).filter(F.size("lang_set") > 0)
    lang = {"lang": F.coalesce(F.col("_rest")["lang"], F.col("lang_pred"))} if "lang" in docs.columns else {}
    return unwrapped(found, docs.columns, **lang)
