"""URL filters against plain prefix and suffix checks."""

import random

import pytest

from tidemark.llm import urls
from tidemark.llm.queries import URL_RULES, op11

PAGES = "page_id long, url string, html string, host string, rule string, found string"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def plain(url, rules):
    host, path = parts(url)
    fits = [
        (len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return (host, path, None, "allow") if best is None else (host, path, *best[3:])


def given():
    rng = random.Random(5)
    hosts = ["example.org", "EXAMPLE.org", "a.example.org", "xexample.org", "org", "b.c.com", "com", "net", "", "org.",
             "u@a.org:80", ".org", "a..org", "É.org", "example.org.evil.net"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/123/x", "/en/2", "/fr/", "/de/x", "//", "/en//1", "/" + "y/" * 3000]
    ends = ["", "?q=/es/", "#/fr/", "?", "?u=http://com/de/", "\n/x"]
    rows = [f"{rng.choice(['http', 'x', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(ends)}" for _ in range(400)]
    rows += [None, "", "no scheme", "a?b=c://org/es/", "://", ":///", "https://com/de/", "https://com/de/"]
    return [(i if i % 50 else None, u, "h", "clash", "clash", None) for i, u in enumerate(rows)]


MORE = [*URL_RULES, ("", "/y/y/", "block"), ("example.org", "/es/", "allow"), ("a.example.org", "", "allow"), ("org", "", "block"),
        ("COM", "/en/1", "block"), ("com", "/en/", "allow"), ("com", "/en/123/x", "allow"), ("net", "//", "block"), (None, "/fr/", None)]


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("rules", [URL_RULES, MORE])
def test_urls_match_plain(spark, monkeypatch, rules, small):
    if not small:
        monkeypatch.setattr(urls, "is_small", lambda df: False)
    rows = given()
    table = spark.createDataFrame(rows, PAGES).repartition(3)
    read = [((h or "").lower(), p or "", v or "block") for h, p, v in rules]
    got = urls.judge(table, spark.createDataFrame(rules, urls.RULES), ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[2:] == plain(r["url"], read)
    kept = urls.filtered(table, spark.createDataFrame(rules, urls.RULES))
    assert kept.columns == table.columns
    assert sorted(r["url"] or "" for r in kept.collect()) == sorted(u or "" for _, u, *_ in rows if plain(u, read)[3] == "allow")


def test_urls_of_little(spark):
    table = spark.createDataFrame(given(), PAGES)
    assert op11(table.filter("false")).collect() == []
    none = spark.createDataFrame([], urls.RULES)
    assert {(r["rule"], r["verdict"]) for r in urls.judge(table, none, ["page_id"], default="block").collect()} == {(None, "block")}


def test_op11_on_the_table(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    got = op11(pages).collect()
    assert len(got) == len(url)
    assert all(tuple(r)[1:] == plain(url[r["page_id"]], URL_RULES) for r in got)
    assert {r["verdict"] for r in got} == {"allow", "block"}
