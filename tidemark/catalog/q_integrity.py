"""Divergence, consistency, repair and garbage collection."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import ids
from tidemark.operators import integrity

DIFF = """
select _id, 'local_only' as side, cast(null as varchar) as relation from fx_local_docs
  where _id not in (select _id from fx_remote_docs)
union all select _id, 'remote_only', null from fx_remote_docs where _id not in (select _id from fx_local_docs)
union all select _id, 'differing', rel from fx_rel where rel <> 'equal'
"""


def presence(t):
    return integrity.chunk_presence(t.file_docs, t.local_chunks, t.remote_chunks)


@query("D1_diff_file_docs", DIFF)
def _(t):
    return integrity.diff_file_docs(t.local_docs, t.remote_docs)


@query(
    "D2_chunk_refs",
    "select unnest(chunks) as id, substr(_id, 6) as path from fx_file_docs where not deleted",
)
def _(t):
    return integrity.chunk_refs(t.file_docs)


@query(
    "D3_chunk_consistency",
    """select 'local_only' as bucket, id from fx_presence where l and not r
       union all select 'remote_only', id from fx_presence where r and not l
       union all select 'orphan_local', id from fx_presence where l and not f
       union all select 'orphan_remote', id from fx_presence where r and not f
       union all select 'missing_referenced', id from fx_presence where f and not l and not r""",
)
def _(t):
    docs = t.file_docs.withColumn("vclock", t._local_clock)
    return integrity.chunk_consistency(docs, docs, t.local_chunks, t.remote_chunks).report


@query(
    "D3_missing_paths",
    """select id, path from (select unnest(chunks) as id, substr(_id, 6) as path from fx_file_docs where not deleted)
       where id in (select id from fx_presence where f and not l and not r)""",
)
def _(t):
    return integrity.missing_referenced_paths(t.file_docs, presence(t))


@query("D3_needs_convergence", DIFF)
def _(t):
    found = integrity.chunk_consistency(t.local_docs, t.remote_docs, t.local_chunks, t.remote_chunks)
    assert found.state == "needs-convergence"
    return found.divergence


@query(
    "D4_consistency_counts",
    """select count(*) filter (l) as local_chunks, count(*) filter (r) as remote_chunks,
              count(*) filter (f) as referenced_ids, count(*) filter (l and not r) as local_only,
              count(*) filter (r and not l) as remote_only,
              count(*) filter (f and not l and not r) as missing_referenced,
              count(*) filter (l and not f) as orphan_local, count(*) filter (r and not f) as orphan_remote
       from fx_presence""",
)
def _(t):
    return integrity.consistency_counts(presence(t))


@query(
    "D5_snapshot_changed",
    """select (max(_local_seq), count(*)) <> (select (max(_local_seq), count(*)) from fx_stored_docs where not deleted)
         as changed from fx_stored_docs""",
)
def _(t):
    before = integrity.docs_signature(t.stored_docs.filter(~F.col("deleted")))
    return integrity.snapshot_changed(before, integrity.docs_signature(t.stored_docs))


PLAN = """
select id, case when l and f then 'push' when r and f then 'pull' when l then 'delete-local' else 'delete-remote' end as action
from fx_presence where l <> r
"""


@query("D6_repair_plan", PLAN)
def _(t):
    return integrity.repair_plan(presence(t))


@query(
    "D7_revalidate_plan",
    f"""select id, action from ({PLAN})
        where not (action = 'delete-local' and id in (select unnest(chunks) from fx_remote_docs where not deleted))
          and not (action = 'delete-remote' and id in (select unnest(chunks) from fx_file_docs where doc_id % 2 = 1))""",
)
def _(t):
    odd = t.file_docs.filter(F.col("doc_id") % 2 == 1).withColumn("deleted", F.lit(False))
    return integrity.revalidate_plan(integrity.repair_plan(presence(t)), t.remote_docs, odd)


@query(
    "D8_apply_repair",
    """select 'local' as side, id from fx_presence where (l or (r and f)) and not (l and not r and not f)
       union all select 'remote', id from fx_presence where (r or (l and f)) and not (r and not l and not f)""",
)
def _(t):
    done = integrity.apply_repair(integrity.repair_plan(presence(t)), t.local_chunks, t.remote_chunks)
    return done.local_chunks.select(F.lit("local").alias("side"), F.col("_id").alias("id")).unionAll(
        done.remote_chunks.select(F.lit("remote"), "_id")
    )


@query(
    "D8_repair_results",
    f"""select action, case when action = 'pull' and substr(id, 12, 1) = '0' and substr(id, 13, 1) in ('1', '2') then 'hash-mismatch' else 'ok' end as result,
          count(*) as n from ({PLAN}) group by all""",
)
def _(t):
    broken = F.substring("_id", 12, 2).isin("01", "02")
    remote = t.remote_chunks.withColumn(
        "content", F.when(broken, F.concat("content", F.lit(b"!"))).otherwise(F.col("content"))
    )
    done = integrity.apply_repair(integrity.repair_plan(presence(t)), t.local_chunks, remote)
    return done.results.groupBy("action", "result").agg(F.count("*").alias("n"))


@query(
    "D9_gc_chunks",
    "select _id from fx_local_chunks where _id not in (select id from fx_refs)",
)
def _(t):
    return integrity.gc_chunks(t.file_docs, t.local_chunks).deleted


@query(
    "D9_gc_kept",
    "select _id, octet_length(content) as bytes from fx_local_chunks where _id in (select id from fx_refs)",
)
def _(t):
    kept = integrity.gc_chunks(t.file_docs, t.local_chunks).kept
    return kept.select("_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query(
    "D9_gc_counts",
    """select (select count(*) from fx_local_chunks) as scanned, (select count(*) from fx_refs) as referenced,
              (select count(*) from fx_local_chunks where _id not in (select id from fx_refs)) as deleted""",
)
def _(t):
    return integrity.gc_counts(t.file_docs, t.local_chunks)


@query(
    "D10_missing_chunks",
    """select 'file:' || p.path as _id, string_agg(p.chunk_id, ',' order by p.ord) as missing from fx_pieces p
       where p.doc_id % 10 <> 3 and p.chunk_id not in (select _id from fx_local_chunks) group by 1""",
)
def _(t):
    return integrity.missing_chunks(t.file_docs, t.local_chunks).select(
        "_id", F.array_join("missing", ",").alias("missing")
    )


@query(
    "D11_quarantine",
    """with gone as (select lower(p.path) as path_key, string_agg(p.chunk_id, ',' order by p.ord) as missing from fx_pieces p
          where p.doc_id % 10 <> 3 and p.chunk_id not in (select _id from fx_local_chunks union select _id from fx_remote_chunks)
          group by 1),
       was as (select lower(p.path) as path_key, string_agg(p.chunk_id, ',' order by p.ord) as missing
          from fx_pieces p where p.doc_id % 10 <> 3 and p.doc_id % 4 < 3 and substr(p.chunk_id, 12, 1) in ('a', '1') group by 1)
       select coalesce(g.path_key, w.path_key) as path_key,
              case when g.missing is null then 'cleared' else 'quarantined' end as state,
              g.missing is not null and g.missing is distinct from w.missing as is_new, g.missing
       from gone g full join was w using (path_key)""",
)
def _(t):
    one_sided = F.filter("chunks", lambda c: F.substring(c, 12, 1).isin("a", "1"))
    previous = (
        t.file_docs.filter((F.col("doc_id") % 10 != 3) & (F.col("doc_id") % 4 < 3))
        .select(F.lower(ids.path_of("_id")).alias("path_key"), one_sided.alias("missing_chunks"))
        .filter(F.size("missing_chunks") > 0)
    )
    return integrity.quarantine(t.file_docs, t.local_chunks, t.remote_chunks, previous).withColumn(
        "missing", F.array_join("missing", ",")
    )


CONFIG_REL = """
select _id, case when gt and lt then 'concurrent' when gt then 'dominates' else 'dominated' end as relation
from (select _id, bool_or(l > r) as gt, bool_or(l < r) as lt
      from (select _id, dev, coalesce(max(n) filter (side = 'l'), 0) as l, coalesce(max(n) filter (side = 'r'), 0) as r
            from fx_config_vc group by 1, 2) group by 1)
where (gt or lt) and _id in (select _id from fx_config_docs where side = 'l') and _id in (select _id from fx_config_docs where side = 'r')
"""


@query("D12_config_divergence", CONFIG_REL)
def _(t):
    return integrity.config_divergence(t.config_local, t.config_remote)


@query(
    "D12_dangerous",
    f"""select 'push' as direction, * from ({CONFIG_REL}) where relation in ('concurrent', 'dominated')
        union all select 'pull', * from ({CONFIG_REL}) where relation in ('concurrent', 'dominates')""",
)
def _(t):
    div = integrity.config_divergence(t.config_local, t.config_remote)
    return integrity.dangerous_for(div, "push").withColumn("direction", F.lit("push")).unionByName(
        integrity.dangerous_for(div, "pull").withColumn("direction", F.lit("pull"))
    )


@query(
    "D14_push_backfill",
    f"""select _id as id, 'race-stale' as reason, cast(0 as integer) as attempts from ({DIFF})
        where (side = 'local_only' or relation = 'dominates') and _id not in (select id from fx_unpushed)""",
)
def _(t):
    return integrity.push_backfill(t.local_docs, t.remote_docs, t.unpushed)


@query(
    "D15_empty_folders",
    """with f as (select doc_id, 'n/' || doc_id % 7 || '/' || doc_id % 150 || '/d' || doc_id || '.md' as path from fx_files),
       dirs as (select doc_id, path, unnest(['n', 'n/' || doc_id % 7, 'n/' || doc_id % 7 || '/' || doc_id % 150]) as dir from f)
       select distinct dir from dirs where doc_id % 3 <> 0
         and dir not in (select dir from dirs where doc_id % 3 = 0)""",
)
def _(t):
    d = F.col("doc_id")
    path = F.concat(
        F.lit("n/"), (d % 7).cast("string"), F.lit("/"), (d % 150).cast("string"), F.lit("/d"), d.cast("string"), F.lit(".md")
    )
    disk = t.files.select("doc_id", path.alias("path"))
    return integrity.empty_folders(disk.drop("doc_id"), disk.filter(d % 3 != 0).drop("doc_id"))
