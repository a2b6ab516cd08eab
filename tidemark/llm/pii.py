"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Base spans come from four patterns.  They seed a bootstrap: every token that looks
like an identifier is a candidate, in the lexical pattern made of its two words to
the left, what stands before it, and its shape.  A pattern is scored for each kind by the share of
its distinct instances that are known as it, an instance by the patterns it stands in; both are
sums over a bipartite graph, recomputed from one written table in each round.
Patterns and instances of high confidence become known, and unseen instances of good
patterns become spans of the kind that taught the pattern.

Positions are found without a function per row: splitting a text by a pattern gives
what lies between the matches, so running lengths give the starts.

Defined results: NULL and empty texts have no spans; offsets are in code points, end
exclusive; texts are scanned whole, in time linear in their length; base matches that
fail their check are dropped without retry; found spans never overlap base spans;
repeated rows keep their own spans; an empty table gives no rows; other columns are
ignored, or kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, cut_lineage, row_key, unwrapped, wrapped
from tidemark.operators.skew import hot_keys, salted_join

# A match starts where the last one ended or where its run of characters starts, and
# runs are possessive: no other start or shorter run can match, and none is tried.
# A run of card digits is taken from its start and only from 16 digits on.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPAN = "struct<kind:string,start:int,end:int>"
NO_SPANS = f"array<{SPAN}>"

CANDIDATE = f"[^{SPACE}]*[0-9@][^{SPACE}]*"
MIN_CHARS = 6
HOT_EDGES = 256  # edges of a pattern beyond which they are spread
MIN_SUPPORT = 3  # distinct known instances that a pattern needs
MIN_PATTERN = 0.5
MIN_INSTANCE = 0.9


def _found(text: Column, pattern: str, may: Column) -> tuple[Column, Column]:
    """Matches and the pieces around them (one more), where ``may`` allows any."""
    return (
        F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("hits"),
        F.when(may, F.split(text, pattern, -1)).alias("gaps"),
    )


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(lengths: Column) -> Column:
    """Sum of all earlier entries for each entry; blocks of a root of their number."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def blocks(s: Column) -> Column:
        n, b = F.size(s["l"]), s["b"]
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / b).cast("int")), lambda j: total(F.slice(s["l"], j * b + 1, b)))
        upto = F.aggregate(
            sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        )
        return _let(upto, lambda offsets: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.get(offsets, F.floor(i / b).cast("int")) + total(F.slice(s["l"], F.floor(i / b).cast("int") * b + 1, i % b)),
        ))

    root = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    return F.when(F.size(lengths) > 0, _let(F.struct(lengths.alias("l"), root.alias("b")), blocks))


def _placed(hits: Column, gaps: Column) -> Column:
    """``(hit, start, end)`` of the matches, from what lies between them."""
    inner = F.slice(gaps, 1, F.size(hits))
    lengths = F.zip_with(hits, inner, lambda h, g: F.length(h) + F.length(g))

    def place(p: Column) -> Column:
        start = p["at"] + F.length(p["gap"])
        return F.struct(p["hit"].alias("hit"), start.alias("start"), (start + F.length(p["hit"])).alias("end"))

    return F.transform(F.arrays_zip(hits.alias("hit"), inner.alias("gap"), _before(lengths).alias("at")), place)


def _luhn(hit: Column) -> Column:
    """16 to 19 digits whose doubled sum is a multiple of ten."""
    digits = F.reverse(F.split(F.regexp_replace(hit, "[^0-9]", ""), ""))

    def add(acc: Column, d: Column) -> Column:
        n = d.cast("int") * F.when(acc["odd"], 2).otherwise(1)
        return F.struct((acc["sum"] + n - F.when(n > 9, 9).otherwise(0)).alias("sum"), (~acc["odd"]).alias("odd"))

    digits = F.filter(digits, lambda d: d != "")
    total = F.aggregate(
        digits, F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd")), add, lambda acc: acc["sum"]
    )
    return F.size(digits).between(16, 19) & (total % 10 == 0)


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def _spans_of(kind: str, hits: Column, gaps: Column) -> Column:
    good = F.filter(_placed(hits, gaps), lambda m: _holds(kind, m["hit"]))
    named = F.transform(
        good, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    )
    return F.coalesce(named, F.array().cast(NO_SPANS))


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``_spans``: base spans, by kind as listed, then start."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    may = {
        "email": F.instr(body, "@") > 0,
        "ip": body.rlike(r"[0-9]\.[0-9]"),
        "card": body.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
        "phone": F.instr(body, "+") > 0,
    }
    out = docs
    for kind in KINDS:
        hits, gaps = _found(body, PATTERNS[kind], may[kind])
        out = out.withColumns({f"_h_{kind}": hits, f"_g_{kind}": gaps})
    spans = [_spans_of(kind, F.col(f"_h_{kind}"), F.col(f"_g_{kind}")) for kind in KINDS]
    out = out.withColumn("_spans", F.concat(*spans))
    return out.drop(*[f"_{a}_{k}" for k in KINDS for a in "hg"])


def _overlaps(spans: Column, start: Column, end: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < end) & (start < s["end"]))


def with_candidates(spanned: DataFrame) -> DataFrame:
    """Adds ``_cands``: ``(kind, start, end, value, pattern)`` of what may identify.

    Seeds are base spans; other candidates are words with a digit or an @, trimmed of
    punctuation, that overlap no base span and have no kind.  The pattern is the two
    words to the left and whether the token has an @, letters or neither.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits, gaps = _found(body, CANDIDATE, body.rlike("[0-9@]"))
    rows = spanned.withColumns({"_hits": hits, "_gaps": gaps}).withColumn(
        "_words", _placed(F.col("_hits"), F.col("_gaps"))
    )
    trimmed = F.transform("_words", lambda m: F.struct(
        (m["start"] + F.length(m["hit"]) - F.length(F.regexp_replace(m["hit"], r"^[^\p{L}\p{N}+]++", ""))).alias("start"),
        (m["end"] - F.length(m["hit"]) + F.length(F.regexp_replace(m["hit"], r"[^\p{L}\p{N}]++$", ""))).alias("end"),
    ))
    others = F.filter(
        trimmed, lambda m: (m["end"] - m["start"] >= MIN_CHARS) & ~_overlaps(F.col("_spans"), m["start"], m["end"])
    )
    none = F.lit(None).cast("string")
    every = F.concat(
        F.col("_spans"),
        F.coalesce(F.transform(others, lambda m: F.struct(none.alias("kind"), m["start"].alias("start"), m["end"].alias("end"))),
                   F.array().cast(NO_SPANS)),
    )

    def describe(m: Column) -> Column:
        value = F.substring(body, m["start"] + 1, m["end"] - m["start"])
        left = F.substring(body, F.greatest(m["start"] - 63, F.lit(1)), F.least(m["start"], F.lit(64)))
        before = F.array_remove(F.split(F.translate(F.lower(left), SPACE, " " * len(SPACE)), " "), "")
        context = F.array_join(F.slice(F.reverse(before), 1, 2), " ")
        shape = F.when(F.instr(value, "@") > 0, "@").when(value.rlike(r"\p{L}"), "a").otherwise("0")
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
                        F.md5(value.cast("binary")).alias("value"), F.concat_ws("\u0001", context, shape).alias("pattern"))

    return rows.withColumn("_every", every).withColumn("_cands", F.transform("_every", describe)).drop(
        "_hits", "_gaps", "_words", "_every"
    )


def _leading(weights: dict[str, Column]) -> tuple[Column, Column]:
    """The kind of the largest weight, NULL where two share it, and that weight."""
    most = F.greatest(*weights.values())
    at_top = F.array_compact(F.array(*[F.when(w == most, F.lit(k)) for k, w in weights.items()]))
    return F.when(F.size(at_top) == 1, F.get(at_top, F.lit(0))), most


def bootstrap(found: DataFrame) -> DataFrame:
    """``(pattern, value, kind)`` of unseen instances that became known.

    Patterns and instances are weighed for each kind and take the leading one, if it has
    its share; one stray seed decides nothing.  Rounds go on until none finds a fresh
    instance; known values only grow, so they end.  Only distinct pattern-instance edges
    take part; each round is two groupings of them, both combined before their shuffle.
    """
    edges = cut_lineage(
        found.groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    )
    known = cut_lineage(edges.filter("kind is not null").groupBy("value").agg(F.min("kind").alias("as_kind")))
    seeds = known
    # A common context has a fixed share of all edges; its edges are spread in each round.
    hot = cut_lineage(hot_keys(edges, "pattern", HOT_EDGES))
    while True:
        told = edges.select("pattern", "value").join(known, "value", "left")
        scored = told.groupBy("pattern").agg(
            F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("as_kind") == k).alias(f"_{k}") for k in KINDS]
        )
        kind, hits = _leading({k: F.col(f"_{k}") for k in KINDS})
        good = scored.select("pattern", "n", kind.alias("pattern_kind"), hits.alias("hits")).filter(
            F.col("pattern_kind").isNotNull() & (F.col("hits") >= MIN_SUPPORT) & (F.col("hits") >= MIN_PATTERN * F.col("n"))
        ).select("pattern", "pattern_kind", (F.col("hits") / F.col("n")).alias("trust"))
        weight = -F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))
        met = salted_join(edges.select("pattern", "value"), good, "pattern", ["value"], "inner", HOT_EDGES, hot)
        weighed = met.groupBy("value").agg(
            *[F.sum(F.when(F.col("pattern_kind") == k, weight).otherwise(0.0)).alias(f"_{k}") for k in KINDS]
        )
        kind, most = _leading({k: F.col(f"_{k}") for k in KINDS})
        reached = weighed.withColumn("as_kind", kind).filter(
            F.col("as_kind").isNotNull() & (1 - F.exp(-most) >= MIN_INSTANCE)
            & (most >= MIN_PATTERN * sum(F.col(f"_{k}") for k in KINDS))
        )
        fresh = cut_lineage(reached.select("value", "as_kind").join(known, "value", "left_anti"))
        if fresh.isEmpty():
            break
        known = cut_lineage(known.unionByName(fresh))
    return known.join(seeds.select("value"), "value", "left_anti").withColumnRenamed("as_kind", "found_kind")


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` with ``base_spans`` and all ``spans`` of each row.

    Texts are read once; spans and candidates are written, texts are not.  Rows meet
    what the bootstrap found by a hash of id and text, so equal rows share it.
    """
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *keep])).withColumn("_row", row_key())
    marked = with_candidates(with_base_spans(rows))
    base = cut_lineage(marked.select("_row", *keep, "_spans", "_cands"))
    found = base.select("_row", F.explode("_cands").alias("_c")).select("_row", "_c.*")
    more = found.filter("kind is null").join(bootstrap(found), "value").groupBy("_row").agg(
        F.collect_set(F.struct(F.col("found_kind").alias("kind"), "start", "end")).alias("_more")
    )
    joined = base.drop("_cands").join(more, "_row", "left").drop("_row")
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.transform(
        F.concat("_spans", F.coalesce(F.col("_more").cast(NO_SPANS), F.array().cast(NO_SPANS))),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    every = F.transform(F.sort_array(ranked), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.withColumn("spans", every).withColumnRenamed("_spans", "base_spans").drop("_more")


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in capitals; overlaps are one."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    step = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], -s["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(acc["out"]).alias("out"),
        )

    folded = F.aggregate(ordered, step, add)
    tail = F.substring(text, folded["at"] + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(folded["out"], tail))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in texts replaced; ``n_chars`` is counted anew."""
    found = detect(wrapped(docs), ["doc_id", "text", "_rest"])
    text = redact(F.col("text"), F.col("spans"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unwrapped(found, docs.columns, **changed)
