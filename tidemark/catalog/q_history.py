"""Revision history."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import history

NOW = 1700000000000 + 40 * 24 * 3600 * 1000


CAPTURE = """
texts as (select * from fx_versions where strpos(content, chr(0)) = 0 and file_path not like 'chat/%7.md'),
prev as (select *, coalesce(lag(content) over (partition by file_path order by timestamp), '') as before_ from texts),
changed as (select * from prev where before_ <> content)
"""


@query(
    "H1_capture_revisions",
    f"""with {CAPTURE} select file_path, timestamp, source, sha256(encode(before_)) as base_hash,
          lag(timestamp) over (partition by file_path order by timestamp) as parent_timestamp, false as conflict from changed""",
)
def _(t):
    return history.capture_revisions(t.versions, ["chat/*7.md"], slices=8).select(
        "file_path", "timestamp", "source", "base_hash", "parent_timestamp", "conflict"
    )


LINES = "len(string_split({0}, chr(10))) - case when suffix({0}, chr(10)) or {0} = '' then 1 else 0 end"


@query(
    "H2_line_churn",
    # Lines are only taken out, so all that is left is the longest common part.
    f"""select doc_id, 0::bigint as added, ({LINES.format('old')} - ({LINES.format('new')}))::bigint as removed
        from (select doc_id, text as old, regexp_replace(text, '(?m)^.*a\n', '', 'g') as new from documents)""",
)
def _(t):
    revised = t.files.select("doc_id", F.col("content").cast("string").alias("old")).withColumn(
        "new", F.regexp_replace("old", r"(?m)^.*a\n", "")
    )
    return history.churn(revised, "old", "new").select("doc_id", "added", "removed")


@query(
    "H2_line_churn_disjoint",
    """select doc_id, len(string_split(text, chr(10)))::bigint - case when suffix(text, chr(10)) or text = '' then 1 else 0 end as removed,
              0::bigint as added from documents""",
)
def _(t):
    # Against an empty text every line is removed, which SQL can count.
    df = t.source("documents").select("doc_id", F.col("text").alias("old"), F.lit("").alias("new"))
    return history.churn(df, "old", "new").select("doc_id", "added", "removed")


@query(
    "H3_link_chain",
    "select id, file_path, lag(id) over (partition by file_path order by timestamp, id) as parent_id from fx_revisions",
)
def _(t):
    return history.link_chain(t.revisions, slices=8).select("id", "file_path", "parent_id")


@query(
    "H3_chain_heads",
    "select file_path, max_by(id, (timestamp, id)) as head_record_id from fx_revisions group by 1",
)
def _(t):
    return history.chain_heads(t.revisions)


@query(
    "H4_file_history",
    "select id, timestamp, added, removed from fx_revisions where file_path = 'chat/2.md' and timestamp >= 1700000060000",
)
def _(t):
    return history.file_history(t.revisions, "chat/2.md", 1700000060000).select("id", "timestamp", "added", "removed")


WALK = """
with recursive own as (
  select r.id, r.file_path, case when r.parent_id in (select id from fx_revisions) then r.parent_id end as parent_id from fx_revisions r),
walk(id, cur, depth) as (
  select id, id, 0 from own
  union all select w.id, o.parent_id, w.depth + 1 from walk w join own o on o.id = w.cur
  where o.parent_id is not null and w.depth < 60),
ends as (select w.id, w.cur as root_id, w.depth from walk w join own o on o.id = w.cur where o.parent_id is null),
head as (select distinct h.file_path, w.cur as id from fx_heads h join walk w on w.id = h.head_record_id),
fork as (select w.id, arg_min(w.cur, w.depth) as fork_id from walk w join own o on o.id = w.id
         join head h on h.id = w.cur and h.file_path = o.file_path group by 1)
"""


LINEAGE = """
 select o.file_path, o.id, e.depth::bigint as depth, e.root_id, e.id is null as cyclic,
   exists (select 1 from head h where h.id = o.id and h.file_path = o.file_path) as on_head_path,
   case when e.id is not null then (select count(*) from walk w where w.cur = o.id and w.id in (select id from ends)) end as subtree_size,
   f.fork_id
 from own o left join ends e using (id) left join fork f using (id)
"""


@query("H6_lineage", WALK + LINEAGE)
def _(t):
    return history.lineage(t.revisions, t.heads)


def picks(t):
    return t.revisions.filter(F.col("id") % 3 != 0).select("file_path", "id")


CONTENT = """
content as (select o.file_path, o.id, case when h.head_record_id = o.id then h.content when f.fork_id is not null then r.content end as content
  from own o join fx_revisions r using (id) left join fork f using (id) left join fx_heads h on h.file_path = o.file_path
  where o.id % 3 <> 0)
"""


@query("H5_revision_content", WALK + ", " + CONTENT + " select * from content")
def _(t):
    return history.revision_content(t.revisions, t.heads, picks(t))


@query(
    "H7_restore",
    WALK + ", " + CONTENT + """, pick as (select file_path, min(id) as id from content group by 1)
    select h.file_path, coalesce(c.content, h.content) as content, case when c.content is not null then c.id else h.head_record_id end as head_record_id
    from fx_heads h left join pick p using (file_path) left join content c on c.id = p.id""",
)
def _(t):
    first = picks(t).groupBy("file_path").agg(F.min("id").alias("id"))
    return history.restore(t.heads, history.revision_content(t.revisions, t.heads, first))


def resolutions(t):
    local = F.concat(F.lit("L\n"), "content")
    remote = F.concat("content", F.lit("\nR"))
    return t.heads.select(
        "file_path", local.alias("local_content"), remote.alias("remote_content"),
        F.when(F.length("content") % 2 == 0, "local").otherwise("remote").alias("winner"),
        F.crc32("file_path").alias("id"), F.lit(5).cast("bigint").alias("timestamp"),
    )


@query(
    "H8_record_conflicts",
    """select file_path, true as conflict, head_record_id as parent_id, 'local' as source,
         case when length(content) % 2 = 0 then 'L' || chr(10) || content else content || chr(10) || 'R' end as content from fx_heads""",
)
def _(t):
    return history.record_conflicts(resolutions(t), t.heads)[0].select(
        "file_path", "conflict", "parent_id", "source", "content"
    )


@query(
    "H8_conflict_heads",
    """select file_path, case when length(content) % 2 = 0 then 'L' || chr(10) || content else content || chr(10) || 'R' end as content from fx_heads""",
)
def _(t):
    return history.record_conflicts(resolutions(t), t.heads)[1].select("file_path", "content")


@query(
    "H9_history_retention",
    f"select id, file_path, timestamp from fx_revisions where timestamp >= {1700000000000 + 60000}",
)
def _(t):
    return history.history_retention(t.revisions, NOW + 60000, 40).select("id", "file_path", "timestamp")


MOVED = "case when conv_id % 4 = 1 then 'moved/' || conv_id || '.md' else 'chat/' || conv_id || '.md' end"


@query(
    "H10_rename_history",
    f"""select 'revision' as kind, {MOVED} as file_path, count(*) as n from conversations group by 1, 2
        union all select distinct 'head', {MOVED}, 1 from conversations""",
)
def _(t):
    c = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint")
    renames = t.heads.filter(c % 4 == 1).select(
        F.col("file_path").alias("old_path"), F.replace(F.col("file_path"), F.lit("chat/"), F.lit("moved/")).alias("new_path")
    )
    revisions, heads = history.rename_history(t.revisions, t.heads, renames)
    return revisions.groupBy("file_path").agg(F.count("*").alias("n")).withColumn("kind", F.lit("revision")).unionByName(
        heads.select("file_path", F.lit(1).cast("bigint").alias("n"), F.lit("head").alias("kind"))
    )


@query(
    "H10_clear_history",
    """select 'revision' as kind, id::varchar as name from fx_revisions where (id // 1000) % 3 <> 0
       union all select 'head', file_path from fx_heads where regexp_extract(file_path, '(\\d+)', 1)::bigint % 3 <> 0""",
)
def _(t):
    c = F.regexp_extract("file_path", r"(\d+)", 1).cast("bigint")
    revisions, heads = history.clear_history(t.revisions, t.heads, t.heads.filter(c % 3 == 0))
    return revisions.select(F.lit("revision").alias("kind"), F.col("id").cast("string").alias("name")).unionAll(
        heads.select(F.lit("head"), "file_path")
    )


@query("H11_history_totals", "select count(*) as revisions, min(timestamp) as oldest from fx_revisions")
def _(t):
    return history.history_totals(t.revisions)
