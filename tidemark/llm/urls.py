"""URL filters by a trie over reversed host labels and path segments.

A rule is a host, a path and a verdict.  It fits the URLs of its host and of all its
subdomains whose path starts with the rule's path.  Of the rules that fit, that with
the longest host decides, among those that with the longest path; of an allow and a
block entry of the same host and path the block entry.  One trie holds all rules: from
the root along the host's labels from the last to the first, then along the path cut
behind each slash; what is left of a rule's path hangs at its last node.

The trie goes to the tasks only after its rules were counted and measured.  A longer
list is joined instead: each distinct host and path asks for the pairs of a host suffix
and a path prefix that a rule could have, by digest, with hot keys salted.

Defined results: host and path of a NULL URL, or one without ``://``, are empty; a rule
with an empty host fits every URL, and NULLs in a rule count as empty; where no rule
fits, ``rule`` is NULL and the verdict is ``default``; ports and user names stay in the
host; long URLs are read whole; equal rows are judged alike and all kept; an empty table
gives no rows, and no rules let ``default`` decide everywhere; other columns are ignored
by ``judge`` and kept by ``filtered``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut_lineage
from tidemark.operators.skew import is_small, salted_join

ALLOW, BLOCK = "allow", "block"
RULES = "host string, path string, verdict string"


class Trie:
    """Rules ``(host, path, verdict)``; nodes are numbers, so that it pickles flat."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[dict[str, tuple[str, str]]] = [{}]
        self.sizes: list[list[int]] = [[]]  # lengths of a node's ends, longest first
        for host, path, verdict in rules:
            cut = path.rfind("/") + 1
            node = 0
            for step in [*_labels(host), *_pieces(path[:cut])]:
                if step not in self.edges[node]:
                    self.edges[node][step] = len(self.edges)
                    self.edges.append({})
                    self.ends.append({})
                    self.sizes.append([])
                node = self.edges[node][step]
            tail = path[cut:]
            if self.ends[node].get(tail, ("", ALLOW))[1] != BLOCK:
                self.ends[node][tail] = (host + path, verdict)
        for node, ends in enumerate(self.ends):
            self.sizes[node] = sorted({len(t) for t in ends}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Rule text and verdict of the longest match."""
        node, found = 0, self._below(0, path)
        for label in _labels(host):
            node = self.edges[node].get(label)
            if node is None:
                break
            found = self._below(node, path) or found
        return found

    def _below(self, node: int | None, path: str) -> tuple[str, str] | None:
        found, at = None, 0
        while node is not None:
            for n in self.sizes[node]:
                if (end := self.ends[node].get(path[at:at + n])) is not None:
                    found = end
                    break
            cut = path.find("/", at) + 1
            node = self.edges[node].get(path[at:cut]) if cut else None
            at = cut
        return found


def _labels(host: str) -> list[str]:
    """Labels from the last to the first; host labels hold no slash, path pieces end with one."""
    return host.split(".")[::-1] if host else []


def _pieces(path: str) -> list[str]:
    return [p + "/" for p in path.split("/")[:-1]]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From behind the host to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def _plain(rules: DataFrame) -> DataFrame:
    """Rules without NULLs, hosts in lower case, one verdict per host and path."""
    host = F.translate(F.coalesce("host", F.lit("")), ascii_uppercase, ascii_lowercase)
    return (
        rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"),
                     F.coalesce("verdict", F.lit(BLOCK)).alias("verdict"))
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts behind allow
    )


def _walked(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``found`` by the broadcast trie; ``rules`` are of checked size."""
    held = rows.sparkSession.sparkContext.broadcast(Trie(tuple(r) for r in rules.collect()))
    entry = pa.struct([("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = held.value
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [m and {"rule": m[0], "verdict": m[1]} for m in map(trie.match, hosts, paths)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, entry)], [*batch.schema.names, "found"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("found", _FOUND)]))


_FOUND = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def _key(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("/"), path).cast("binary"), 256)


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``found`` by joins, for rule lists of any length.

    Per distinct host and path as many keys are asked as it has host suffixes times
    rule path lengths up to its own; only digests are shuffled.
    """
    listed = rules.select(_key(F.col("host"), F.col("path")).alias("_ask"),
                          F.concat("host", "path").alias("rule"), "verdict")
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().collect()]
    labels = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.split("host", "[.]"))
    own = cut_lineage(rows.select("host", "path").distinct().withColumn("_own", _key(F.col("host"), F.col("path"))))
    asked = (
        own.withColumn("_labels", labels)
        .withColumn("_depth", F.explode(F.sequence(F.lit(0), F.size("_labels"))))
        .withColumn("_size", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")))
        .filter(F.col("_size") <= F.length("path"))
        .withColumn("_suffix", F.array_join(F.slice("_labels", F.size("_labels") - F.col("_depth") + 1, F.col("_depth")), "."))
        .select("_own", "_depth", "_size", _key(F.col("_suffix"), F.substr("path", F.lit(1), F.col("_size"))).alias("_ask"))
    )
    best = F.max_by(F.struct("rule", "verdict"), F.struct("_depth", "_size")).alias("found")
    found = salted_join(asked, listed, "_ask", ["_own"], how="inner").groupBy("_own").agg(best)
    keyed = rows.withColumn("_own", _key(F.col("host"), F.col("path")))
    return salted_join(keyed, found, "_own", rows.columns).drop("_own")


def _judged(rows: DataFrame, rules: DataFrame) -> DataFrame:
    plain = cut_lineage(_plain(rules))
    return _walked(rows, plain) if is_small(plain) else _joined(rows, plain)


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = ALLOW) -> DataFrame:
    """Columns ``keep`` of every page with host, path, rule and verdict.

    ``rules`` has the columns host, path and verdict (``allow`` or ``block``).
    """
    rows = pages.select(F.struct(*keep).alias("kept"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    return _judged(rows, rules).select(
        "kept.*", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def filtered(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = ALLOW) -> DataFrame:
    """The pages that are allowed, with all their columns."""
    return judge(pages.select(F.struct("*").alias("page"), F.col(url).alias("url")), rules, ["page"], "url", default).filter(
        F.col("verdict") == ALLOW
    ).select("page.*")
