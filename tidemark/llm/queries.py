"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import divergence, language, lattice, lm, mixing, packing, pii, quality, repair, sharding, simhash
from tidemark.llm import urls, warc
from tidemark.llm.common import fold_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


#: The checksum folds over the bytes (hexadecimal ``h``) by a table that its polynomial gives.
CRC_TABLE = """steps(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all
  select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8)"""
CRC_OF_H = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1),
                   lambda i: ('0x' || substr(h, 2 * i - 1, 2))::bigint)),
                 lambda x, y: xor(x >> 8, t[1 + (xor(x, y) & 255)])))"""


def register(name: str, table: str, sql: str | None = None):
    def wrap(fn: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@register(
    "op1_warc", "pages",
    """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages
), f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
       case when page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when page_id <> first_id then first_id end as refers_to
from p left join f on f.d = p.d""",
)
def op1(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = warc.new_archive(spark)
    warc.write_archive(pages, folder)
    return warc.read_archive(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@register("op2_lattice", "embeddings")
def op2(vectors: DataFrame) -> DataFrame:
    return lattice.near_duplicates(vectors)


@register("op3_mixing", "documents")
def op3(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "first_shard", "n_slots")


@register("op4_packing", "documents")
def op4(docs: DataFrame) -> DataFrame:
    return packing.packed_pieces(docs).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@register(
    "op5_sharding", "documents",
    f"""
with recursive {CRC_TABLE},
d as (select doc_id, hex(encode(coalesce(text, ''))) as h, md5('17:' || coalesce(doc_id::varchar, '')) as o,
             coalesce('=' || source, '~') as k from documents),
b as (select doc_id, o, k, length(h) // 2 + 1 as size,
             {CRC_OF_H} as text_crc32 from d, crc),
r as (select *, row_number() over (partition by k order by o, doc_id, size, text_crc32) - 1 as r,
             count(*) over (partition by k) as n, count(*) over () as total from b),
g as (select *, row_number() over (order by (r + ('0x' || substr(md5('17:' || k), 1, 8))::bigint / 4294967296.0::double) / n, k) - 1 as pos from r)
select doc_id, cast(size as bigint) as size, cast(text_crc32 as bigint) as text_crc32, 'rows' as law,
       cast((pos * 8) // total as integer) as shard,
       cast(pos - ceil(((pos * 8) // total) * total / 8.0) as bigint) as slot, cast(null as integer) as grown_shard
from g""",
)
def op5(docs: DataFrame) -> DataFrame:
    return sharding.interleave(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@register("op6_simhash", "documents")
def op6(docs: DataFrame) -> DataFrame:
    return simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


@register("op7_lm", "documents")
def op7(docs: DataFrame) -> DataFrame:
    return lm.score(docs)


@register("op8_quality", "documents")
def op8(docs: DataFrame) -> DataFrame:
    return quality.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


@register("op9_pii", "documents")
def op9(docs: DataFrame) -> DataFrame:
    base = F.col("base_spans")
    return pii.detect(docs, ["doc_id"]).select(
        "doc_id", *[pii.count_of(k, base).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.digest(base).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


@register("op10_language", "documents")
def op10(docs: DataFrame) -> DataFrame:
    held_out = fold_of(F.col("doc_id"), 4) == 2
    langs, logs = language.fit(docs, ~held_out)
    return language.predict(docs, langs, logs, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_set", "shares"
    )


#: The rules that op11 judges by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@register(
    "op11_urls", "pages",
    """
with rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut as (select row_number() over () as k, page_id,
               case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (select k, page_id, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host
          from cut),
best as (select k, arg_max({'rule': h || p, 'verdict': v}, length(h) * 100000 + length(p)) as m
         from parts join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by k)
select page_id, host, path, m.rule as rule, coalesce(m.verdict, 'allow') as verdict from parts left join best using (k)""",
)
def op11(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(URL_RULES, urls.RULES)
    return urls.judge(pages, rules, ["page_id"])


def _plus(value: str, cost: str, edits: str) -> str:
    """SQL for a cost of nine digits followed by its audit, with edits put before."""
    return f"lpad((left({value}, 9)::int + {cost})::varchar, 9, '0') || '{edits}' || substr({value}, 10)"


def _row_edits(state: int, added: int, kept: dict[str, int]) -> str:
    """SQL for the best way to consume a row: NULL options are ignored by ``least``."""
    keeps = " ".join(f"when '{i}' then {_plus(f'v{to}', 'cut', 'K')}" for i, to in kept.items())
    change = f"case when not forced then {_plus(f'v{added}', '2 + cut', 'R')} end"
    return f"least({_plus(f'v{state}', '3', 'D')}, {change}, case when not forced then case initial {keeps} end end) as r{state}"


@register(
    "op12_repair", "conversations",
    # The lattice from its last row to its first: v0 to v3 are the best rest of each state.
    rf"""
with recursive {CRC_TABLE},
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) as h from conversations),
f as (select conv_id, turn, role, text, {CRC_OF_H} % 20 as fault from d, crc),
x as (select conv_id, turn, case when fault = 4 then 'user' else role end as role,
             case fault when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
             unnest(range(case when fault = 3 then 2 else 1 end)) from f where fault <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(length(role) || ':' || role || text)) as i
      from x),
g as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again,
             rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as trimmed, left(role, 1) as initial,
             lag(left(role, 1)) over (partition by conv_id order by i) as before from o),
c as (select *, trimmed = '' or again as forced,
             case when trimmed <> '' and not again and right(trimmed, 1) not in ('.', '!', '?') then 1 else 0 end as cut from g),
s as (
  select conv_id, max(i) as i, '000000000' as v0, '000000004II' as v1, '000000002I' as v2, '000000000' as v3 from c group by conv_id
  union all
  select conv_id, i, least(r0, {_plus('r2', '2', 'I')}, {_plus('r3', '4', 'II')}),
         least(r1, {_plus('r2', '2', 'I')}, {_plus('r3', '4', 'II')}), least(r2, {_plus('r3', '2', 'I')}), least(r3, {_plus('r2', '2', 'I')})
  from (select s.conv_id, s.i - 1 as i, {_row_edits(0, 2, dict(s=1, u=2))}, {_row_edits(1, 2, dict(u=2))},
               {_row_edits(2, 3, dict(a=3))}, {_row_edits(3, 2, dict(u=2))}
        from s join c on c.conv_id is not distinct from s.conv_id and c.i = s.i)),
best as (select conv_id, left(v0, 9)::bigint as cost, substr(v0, 10) as audit from s where i = 0),
edits as (select conv_id, audit, p, substr(audit, p, 1) as e, p - length(replace(left(audit, p), 'I', '')) as added,
                 length(replace(left(audit, p), 'D', '')) - 1 as place, length(replace(audit, 'D', '')) % 2 as odd
          from (select *, unnest(range(1, length(audit) + 1)) as p from best)),
lines as (select e.conv_id, p, case when e = 'K' then c.role when place % 2 = odd then 'user' else 'assistant' end
                 || ':' || case when e = 'I' then '' else c.text end as line
          from edits e left join c on c.conv_id is not distinct from e.conv_id and c.i = p - added and e <> 'I' where e <> 'D'),
whole as (select conv_id, string_agg(line, chr(10) order by p) as w from lines group by conv_id),
n as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
             count(*) filter (trimmed = '') as blank, count(*) filter (trimmed <> '' and again) as duplicate,
             sum(cut) as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal from c group by conv_id)
select i.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
       coalesce(audit, '') as audit, sha256(coalesce(w, '')) as repaired_sha256
from (select distinct conv_id from conversations) i
left join n on n.conv_id is not distinct from i.conv_id left join best b on b.conv_id is not distinct from i.conv_id
left join whole on whole.conv_id is not distinct from i.conv_id""",
)
def op12(rows: DataFrame) -> DataFrame:
    return repair.report(repair.damaged(rows), rows)


@register(
    "op13_divergence", "documents",
    r"""
with d as (select row_number() over () as k, coalesce(text, '') as t, coalesce(lang, '') as lang,
                  coalesce(source, '') as source from documents),
tok as (select k, lang, source, unnest(regexp_extract_all(
          translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from tok group by all having count(distinct k) >= 10),
grp as (select lang, source, coalesce(v, 0) as v
        from (select distinct lang, source from d) left join (select lang, count(*) as v from kept group by lang) using (lang)),
c as (select lang, source, term, count(*) as n from tok semi join kept using (lang, term) group by all),
gn as (select lang, source, sum(n) as total from c group by all),
p as (select g.lang, g.source, k.term, coalesce(n, 0) as n,
             1 + (1000000000::hugeint * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v) as p
      from grp g join kept k on k.lang = g.lang
      left join gn on gn.lang = g.lang and gn.source = g.source
      left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(total) + 2 * any_value(v)) as q
      from c join (select lang, sum(n) as total from c group by lang) using (lang) join (select distinct lang, v from grp) using (lang)
      group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s, 0) as value
          from grp a join grp b on a.lang = b.lang and a.source <> b.source
          left join (select x.lang, x.source, y.source as item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) as s
                     from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) z
            on z.lang = a.lang and z.source = a.source and z.item = b.source),
found as (select lang, source, 'pair' as part, item, value from pairs
          union all
          select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p join q using (lang, term) where n > 0 and p > q)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank
from (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from found)
where part = 'pair' or rank <= 10""",
)
def op13(docs: DataFrame) -> DataFrame:
    return divergence.audit(docs)
