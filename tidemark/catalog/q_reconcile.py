"""Reconcile, ingest, deletes, renames and baselines."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import CHUNK_BYTES, DEVICE, PREVIOUS_DEVICES
from tidemark.functions import clocks, ids
from tidemark.operators.paths import with_path_key
from tidemark.plans import apply, reconcile
from tidemark.session import cut_lineage, work_dir
from tidemark.sources.store import DocStore


def text(name):
    return F.when(F.col(name).isNotNull(), clocks.clock_text(name)).alias(name)


def plan(t, **more):
    return reconcile.reconcile_plan(
        t.case_disk, t.case_docs, t.baselines, t.manifest, DEVICE, PREVIOUS_DEVICES, CHUNK_BYTES, **more
    )


@query("D13_path_collisions", "select * from fx_collisions")
def _(t):
    return reconcile.path_collisions(t.case_disk, t.case_docs, t.baselines, chunk_bytes=CHUNK_BYTES)


def ingested(scope):
    """SQL of the outcome of every file, given the SQL of its scope."""
    return f"""s as (select p.*, {scope} as scope from fx_disk_prints p),
       j as (select s.*, d._id as doc, d.chunks as dchunks, d.deleted as dead, r.rel as brel,
                    b.path_key is not null as based, coalesce(b.deleted, false) as bdead, b.chunks is null or b.size is null as legacy,
                    coalesce(not b.deleted and b.size = s.size and b.chunks = s.own, false) as explained,
                    coalesce(not d.deleted and d.size = s.size and d.chunks = s.own, false) as same
             from s left join fx_local_docs d on d._id = 'file:' || s.path left join fx_base_rel r on r._id = d._id left join fx_baselines b on b.path_key = s.path_key),
       rel as (select *, case when same then 'same' when brel = 'concurrent' then 'hold'
                    when brel = 'dominated' and dead then 'hold' when brel = 'dominated' and not based then 'hold'
                    when brel = 'dominated' and legacy then 'hold' when brel = 'dominated' then 'hold' else 'go' end as verdict from j),
       o as (select *, case when scope = 'skipped' then 'skipped' when scope = 'out' then 'out-of-scope'
                    when doc is not null and not dead and dchunks = own then 'unchanged' when doc is null then 'written'
                    when verdict = 'hold' then 'held' else 'written' end as outcome from rel)"""


SCOPE = """case when p.size / 1048576.0 > 0.015 then 'skipped'
                    when regexp_matches(path, 'notes|NOTES') and not regexp_matches(path, '7[.]md') then 'in' else 'out' end"""


@query(
    "P10_ingest_files",
    f"""with {ingested(SCOPE)}
       select path, outcome, case when outcome = 'written' then array_to_string(own, ',') end as chunks,
              case when outcome = 'written' then size end as size,
              case when outcome = 'written' then coalesce(b.vc, '{{dev-a:1}}') end as vclock
       from o left join fx_local_bump b on b._id = o.doc""",
)
def _(t):
    return reconcile.ingest_files(
        t.disk, t.local_docs, t.baselines, DEVICE, "notes|NOTES", r"7[.]md", 0.015, CHUNK_BYTES
    ).select("path", "outcome", F.array_join("chunks", ",").alias("chunks"), "size", text("vclock"))


@query(
    "P10_ingest_chunks",
    f"""with {ingested("'in'")}
       select distinct 'chunk:s256:' || sha256(content[i * 1024 + 1 : i * 1024 + 1024]) as _id,
              octet_length(content[i * 1024 + 1 : i * 1024 + 1024]) as bytes
       from fx_disk d, lateral (select unnest(range(0, greatest(1, (octet_length(d.content) + 1023) // 1024))) as i) t
       where path in (select path from o where outcome = 'written')""",
)
def _(t):
    made = reconcile.ingest_files(t.disk, t.local_docs, t.baselines, DEVICE, chunk_bytes=CHUNK_BYTES)
    return reconcile.ingest_chunks(t.disk, made, CHUNK_BYTES).select(
        "_id", F.octet_length("content").cast("bigint").alias("bytes")
    )


@query(
    "P11_classify_files",
    "select path_key, fpath as path, relation from fx_occupant_rel where relation is not null",
)
def _(t):
    crowd = reconcile.path_collisions(t.case_disk, t.case_docs, t.baselines, chunk_bytes=CHUNK_BYTES)
    found = reconcile.classify_files(t.case_disk, t.case_docs, t.baselines, CHUNK_BYTES)
    return found.join(crowd.select("path_key").distinct(), "path_key", "left_anti")


@query("P12_reconcile_plan", "select path_key, path, action, relation, bucket from fx_plan")
def _(t):
    return plan(t)


@query(
    "P12_reconcile_first_run",
    """select path_key, path, case when restorable then 'restore' else action end as action, relation,
              case when restorable then 'restored' else bucket end as bucket
       from (select p.*, coalesce(o.fpath is null and o.doc is not null and not o.dead and not o.based, false) as restorable
             from fx_plan p left join fx_occupants o using (path_key))""",
)
def _(t):
    return reconcile.reconcile_plan(
        t.case_disk, t.case_docs, t.baselines, None, DEVICE, PREVIOUS_DEVICES, CHUNK_BYTES
    )


BROKEN = """
broken as (select distinct _id from (select _id, unnest(chunks) as c from fx_case_docs where not deleted)
           where c not in (select _id from fx_local_chunks union select _id from fx_remote_chunks))
"""


@query(
    "P12_reconcile_quarantine",
    f"""with {BROKEN}
       select path_key, path, case when stuck then 'quarantined' else action end as action, relation,
              case when stuck then 'quarantined' else bucket end as bucket
       from (select *, coalesce(action in ('restore', 'pull', 'collision-restore') and doc in (select _id from broken), false) as stuck from fx_plan)""",
)
def _(t):
    return plan(t, local_chunks=t.local_chunks, remote_chunks=t.remote_chunks)


def clock_sql(rows, key):
    """SQL of one clock text per key from ``(key, dev, n)`` rows."""
    return f"""select {key}, '{{' || string_agg(dev || ':' || n, ',' order by dev) || '}}' as vc
               from (select {key}, dev, sum(n)::bigint as n from ({rows}) group by 1, 2) group by 1"""


ALL_CLOCKS = "select * from fx_case_vc where _id in (select _id from fx_case_docs)"

APPLIED = f"""
cvc as ({clock_sql(ALL_CLOCKS, "_id")}),
cbump as ({clock_sql(ALL_CLOCKS + " union all select _id, 'dev-a', 1 from fx_case_docs", "_id")}),
bvc as ({clock_sql("select * from fx_baselines_vc where path_key in (select path_key from fx_baselines)", "path_key")}),
pushed as (select p.path_key, p.path, pr.own, pr.size, pr.mtime, coalesce(b.vc, '{{dev-a:1}}') as vc
           from fx_plan p join fx_case_prints pr using (path) left join cbump b on b._id = 'file:' || p.path where p.action = 'push'),
buried as (select p.path_key, r._id, b.vc from fx_plan p join fx_base_rel r on r._id = 'file:' || p.path and r.rel <> 'dominated'
           join fx_baselines x on x.path_key = p.path_key join cbump b on b._id = r._id where p.action = 'delete'),
dropped as (select b._id, b.vc from fx_plan join cbump b on b._id = 'file:' || path where action in ('dedup-file', 'tombstone')),
tombs as (select _id, vc from buried union all select * from dropped),
taken as (select p.path, d.size, d.mtime from fx_plan p join fx_case_docs d on d._id = p.doc
          where action in ('restore', 'pull', 'collision-restore')),
est as (select p.path_key, d._id, d.chunks, d.size, d.deleted as dead, v.vc as dvc,
               case when action in ('restore', 'pull') or pr.path is null then d.mtime when pr.size = d.size then pr.mtime end as mt
        from fx_plan p join fx_case_docs d on d._id = coalesce(p.doc, 'file:' || p.path) left join cvc v on v._id = d._id
        left join fx_case_prints pr on pr.path = p.path
        where action in ('restore', 'pull', 'vclock-adopt', 'delete-apply', 'baseline-align', 'collision-resolved')),
al as (select o.path_key, o.doc as _id, dchunks as chunks, dsize as size, v.vc as dvc, case when fsize = dsize then fmtime end as mt
       from fx_plan p join fx_occupants o using (path_key) left join cvc v on v._id = o.doc where p.action = 'align'),
based as (select b.path_key, b.chunks, b.size, b.mtime, coalesce(b.deleted, false) as dead, v.vc from fx_baselines b left join bvc v using (path_key)),
settled as (
  select path_key, vc, array_to_string(own, ',') as chunks, size, mtime, false as deleted from pushed
  union all select path_key, vc, '', 0, null, true from buried
  union all
  select e.path_key, dvc, case when e.dead then '' else array_to_string(e.chunks, ',') end, case when e.dead then 0 else e.size end,
         case when not e.dead then mt end, e.dead
  from est e left join based b using (path_key) left join fx_base_rel r on r._id = e._id
  where not coalesce(b.path_key is not null and r.rel = 'equal' and case when e.dead then b.dead
          else not b.dead and b.size = e.size and b.chunks = e.chunks and (mt is null or b.mtime is not distinct from mt) end, false)
  union all
  select a.path_key, coalesce(b.vc, dvc), array_to_string(a.chunks, ','), a.size, mt,
         coalesce(b.size = a.size and b.chunks = a.chunks and b.dead, false)
  from al a left join based b using (path_key)
  where b.path_key is null or b.chunks is null or b.size is null
     or not coalesce(b.size = a.size and b.chunks = a.chunks and (mt is null or b.mtime is not distinct from mt or b.dead), false))
"""


def applied_store(t, disk, docs):
    """A store that a whole reconcile run was committed to, with the plan's disk work."""
    base = f"{work_dir(t.spark)}/settled-{uuid.uuid4().hex}"
    held = DocStore(t.spark, base)
    docs = docs.withColumn("_version", F.lit(1)).withColumn("_local_seq", F.lit(1).cast("bigint"))
    held.start(docs, t.spark.createDataFrame([], "_id string, content binary"), baselines=t.baselines)
    docs, bases = cut_lineage(held.docs()), cut_lineage(held.table("baselines", "path_key"))
    made = reconcile.reconcile_plan(
        disk, docs, bases, t.manifest, DEVICE, PREVIOUS_DEVICES, CHUNK_BYTES, with_doc=True
    )
    done = apply.apply_plan(made, disk, docs, bases, DEVICE, chunk_bytes=CHUNK_BYTES)
    started = disk.agg(F.max("mtime")).first()[0] + 5000
    for _ in range(2):  # the second time is a replay
        apply.settle(held, 1, disk, done, started)
    return held


@query(
    "P12_apply_plan",
    f"""with {APPLIED}
       select 'doc' as kind, 'file:' || path as key, vc as vclock, array_to_string(own, ',') as chunks, size, mtime, false as deleted from pushed
       union all select 'doc', d._id, x.vc, array_to_string(d.chunks, ','), d.size, d.mtime, true from fx_case_docs d join tombs x using (_id)
       union all select 'doc', d._id, v.vc, array_to_string(d.chunks, ','), d.size, d.mtime, d.deleted from fx_case_docs d left join cvc v using (_id)
         where d._id not in (select _id from tombs) and d._id not in (select 'file:' || path from pushed)
       union all select 'baseline', path_key, vc, chunks, size, mtime, deleted from settled
       union all select 'baseline', path_key, vc, array_to_string(chunks, ','), size, mtime, dead from based
         where path_key not in (select path_key from settled)
       union all select 'disk', path, null, null, size, mtime, null from fx_case_prints where path not in (select path from taken)
         and path not in (select path from fx_plan where action = 'dedup-file' or (action = 'delete-apply' and doc = 'file:' || path))
       union all select 'disk', path, null, null, size, mtime, null from taken
       union all select 'conflict', path, action, null, null, null, null from fx_plan where action like 'conflict%' or action = 'collision-unresolved'""",
)
def _(t):
    held = applied_store(t, t.case_disk, t.case_docs)
    now = apply.listing(t.case_disk, held.written("disk", 1))
    names = {v: k for k, v in apply.CONFLICTS.items()}
    actions = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    more = ("chunks", "size", "mtime", "deleted")
    return (
        held.docs().select(F.lit("doc").alias("kind"), F.col("_id").alias("key"), "vclock", *more)
        .unionByName(held.table("baselines", "path_key").select(
            F.lit("baseline").alias("kind"), F.col("path_key").alias("key"), "vclock", *more))
        .select("kind", "key", clocks.clock_text("vclock").alias("vclock"), F.array_join("chunks", ",").alias("chunks"),
                "size", "mtime", "deleted")
        .unionByName(now.select(F.lit("disk").alias("kind"), F.col("path").alias("key"), "size", "mtime"), allowMissingColumns=True)
        .unionByName(held.written("conflicts", 1).select(
            F.lit("conflict").alias("kind"), F.col("path").alias("key"), actions[F.col("kind")].alias("vclock")), allowMissingColumns=True)
    )


@query("P12_apply_settled", "select 'again' as scenario, false as needed union all select 'edited', true")
def _(t):
    # After the commit a second scan isn't needed, until a file changes.
    disk = t.disk
    held = applied_store(t, disk, t.local_docs.drop("doc_id"))
    now = cut_lineage(with_path_key(apply.listing(disk, held.written("disk", 1))))
    docs = cut_lineage(held.docs(columns=["_local_seq"]))
    cursor, manifest = held.table("cursor", "name"), held.written("manifest", 1)

    def run(name, files):
        return reconcile.reconcile_needed(files, docs, manifest, cursor).select(F.lit(name).alias("scenario"), "needed")

    return run("again", now).unionAll(run("edited", now.withColumn("mtime", F.col("mtime") + 10_000)))


@query(
    "P13_reconcile_report",
    """select count(*) filter (bucket = 'in-sync') as in_sync, count(*) filter (bucket = 'local-win') as local_wins,
         count(*) filter (bucket = 'remote-win') as remote_wins, count(*) filter (bucket = 'pushed') as pushed,
         count(*) filter (bucket = 'deleted') as deleted, count(*) filter (bucket = 'restored') as restored,
         count(*) filter (bucket = 'quarantined') as quarantined,
         count(*) filter (bucket = 'collision-resolved') as collisions_resolved,
         count(*) filter (bucket not in ('in-sync', 'quarantined')) as discrepancies,
         count(*) filter (bucket = 'deleted') > (select count(*) from fx_case_disk) * 0.1 as large_delete
       from fx_plan""",
)
def _(t):
    return reconcile.reconcile_report(plan(t), t.case_disk)


@query(
    "P14_reconcile_needed",
    """select 'clean' as scenario, false as needed union all select 'newer-file', true
       union all select 'docs-moved', true union all select 'twins', true
       union all select 'manifest', (select count(*) from (
          (select lower(path) from fx_disk except select lower(path) from fx_manifest) union all
          (select lower(path) from fx_manifest except select lower(path) from fx_disk))) > 0""",
)
def _(t):
    from tidemark.operators.integrity import docs_signature

    newest = t.disk.agg((F.max("mtime") + 5000).alias("last_started_at"), F.lit(1).alias("k"))
    cursor = docs_signature(t.stored_docs).withColumn("k", F.lit(1)).join(newest, "k").drop("k")
    listed = t.disk.select("path")

    def run(name, disk, manifest, cur):
        return reconcile.reconcile_needed(disk, t.stored_docs, manifest, cur).select(
            F.lit(name).alias("scenario"), "needed"
        )

    return (
        run("clean", t.disk, listed, cursor)
        .unionAll(run("newer-file", t.disk, listed, cursor.withColumn("last_started_at", F.col("last_started_at") - 1)))
        .unionAll(run("docs-moved", t.disk, listed, cursor.withColumn("doc_count", F.col("doc_count") - 1)))
        .unionAll(run("twins", t.case_disk, t.case_disk.select("path"), cursor))
        .unionAll(run("manifest", t.disk, t.manifest, cursor))
    )


@query(
    "P15_update_baselines",
    """with j as (select d._id, lower(substr(d._id, 6)) as path_key, d.chunks, d.size, d.deleted as dead,
                 case when octet_length(f.content) = d.size then f.mtime end as mt, b.path_key is not null as based,
                 coalesce(b.deleted, false) as bdead, b.chunks as bc, b.size as bs, b.mtime as bm, r.rel, lt.vc as dvc,
                 (select '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' from fx_baselines_vc v where v.path_key = b.path_key) as bvc
               from fx_local_docs d left join fx_disk f on lower(f.path) = lower(substr(d._id, 6))
               left join fx_baselines b on b.path_key = lower(substr(d._id, 6)) left join fx_base_rel r using (_id) left join fx_local_text lt using (_id)),
       l as (select *, case when dead then case when based and bdead and rel = 'equal' then 'already-aligned' else 'deleted' end
               when not based or bc is null or bs is null then 'upgraded-legacy'
               when bs = size and bc = chunks and (mt is null or bm is not distinct from mt or bdead) then 'already-aligned'
               when bs = size and bc = chunks then 'stamped-mtime' else 'recovered-stale' end as label from j)
       select path_key, label, case when label = 'already-aligned' then bvc when dead then dvc when based then bvc else dvc end as vclock,
         array_to_string(case when label = 'already-aligned' then bc when dead then [] else chunks end, ',') as chunks,
         case when label = 'already-aligned' then bs when dead then 0 else size end as size,
         case when label = 'already-aligned' then bm when not dead then mt end as mtime,
         case when label in ('already-aligned', 'stamped-mtime') then bdead else dead end as deleted from l
       union all
       select b.path_key, 'unchanged', (select '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' from fx_baselines_vc v where v.path_key = b.path_key),
         array_to_string(b.chunks, ','), b.size, b.mtime, b.deleted from fx_baselines b
       where b.path_key not in (select lower(substr(_id, 6)) from fx_local_docs)""",
)
def _(t):
    return reconcile.update_baselines(t.baselines, t.local_docs.drop("doc_id"), t.disk).select(
        "path_key", "label", text("vclock"), F.array_join("chunks", ",").alias("chunks"), "size", "mtime", "deleted"
    )


@query(
    "P15_establish_baselines",
    """with j as (select d._id, lower(substr(d._id, 6)) as path_key, d.chunks, d.size, d.deleted as dead,
                 case when octet_length(f.content) = d.size then f.mtime end as mt, b.path_key is not null as based,
                 coalesce(b.deleted, false) as bdead, b.chunks as bc, b.size as bs, b.mtime as bm, r.rel
               from fx_local_docs d left join fx_disk f on lower(f.path) = lower(substr(d._id, 6))
               left join fx_baselines b on b.path_key = lower(substr(d._id, 6)) left join fx_base_rel r using (_id))
       select case when dead then case when based and bdead and rel = 'equal' then 'already-aligned' else 'deleted' end
               when based and not bdead and bc is not null and bs = size and bc = chunks and rel = 'equal'
                    and (mt is null or bm is not distinct from mt) then 'already-aligned' else 'established' end as label,
              count(*) as n from j group by 1
       union all select 'unchanged', count(*) from fx_baselines where path_key not in (select lower(substr(_id, 6)) from fx_local_docs)""",
)
def _(t):
    done = reconcile.update_baselines(t.baselines, t.local_docs.drop("doc_id"), t.disk, "establish")
    return done.groupBy("label").agg(F.count("*").alias("n"))


@query("P16_has_unpushed", "select path, unpushed or doc_pending as unpushed from (select e.*, path in (select path from fx_files where doc_id % 6 = 1) as doc_pending from fx_case_edits e)")
def _(t):
    pending = t.files.filter(F.col("doc_id") % 6 == 1).select("path")
    return reconcile.has_unpushed(t.case_disk, t.case_docs, t.baselines, pending, CHUNK_BYTES).drop("path_key")


DELETED = """
select w.path, case when d._id is null then 'baseline-removed' when d.deleted then 'baseline-aligned'
     when case when b.path_key is not null then r.rel = 'dominated' else true end then 'held' else 'tombstone' end as outcome, d._id
from wanted w left join fx_local_docs d on d._id = 'file:' || w.path left join fx_baselines b on b.path_key = lower(w.path)
left join fx_base_rel r on r._id = d._id
"""


@query(
    "P17_mark_deleted",
    f"""with wanted as (select path from fx_files where doc_id % 4 <> 2), del as ({DELETED})
       select path, outcome, case outcome when 'tombstone' then b.vc when 'baseline-aligned' then t.vc end as vclock
       from del left join fx_local_bump b using (_id) left join fx_local_text t using (_id)""",
)
def _(t):
    wanted = t.files.filter(F.col("doc_id") % 4 != 2).select("path")
    return reconcile.mark_deleted(t.local_docs, t.baselines, wanted, DEVICE).select("path", "outcome", text("vclock"))


@query(
    "P18_delete_folder",
    f"""with wanted as (select substr(_id, 6) as path from fx_local_docs where _id like 'file:notes/en/%' and not deleted), del as ({DELETED})
       select path, outcome, case outcome when 'tombstone' then b.vc end as vclock from del left join fx_local_bump b using (_id)""",
)
def _(t):
    return reconcile.delete_folder(t.local_docs, t.baselines, "notes/en", DEVICE).select("path", "outcome", text("vclock"))


@query(
    "P19_rename_docs",
    """with j as (select r.*, p.own, p.size, n._id as nid, n.deleted as nd, o._id as oid, o.deleted as od,
               coalesce(not n.deleted, false) and (nb.path_key is null or nr.rel = 'dominated') as new_held,
               coalesce(not o.deleted, false) and (ob.path_key is null or orr.rel = 'dominated') as old_held,
               lower(r.path) = lower(r.old_path) as same_key
             from fx_renames r left join fx_disk_prints p using (path)
             left join fx_local_docs n on n._id = 'file:' || r.path left join fx_local_docs o on o._id = 'file:' || r.old_path
             left join fx_baselines nb on nb.path_key = lower(r.path) left join fx_baselines ob on ob.path_key = lower(r.old_path)
             left join fx_base_rel nr on nr._id = n._id left join fx_base_rel orr on orr._id = o._id),
       o as (select *, case when own is null then 'gone' when old_path = path then 'ingest' when new_held or (old_held and same_key) then 'held'
               when old_held then 'new-only' when oid is not null and not od then 'renamed' else 'new-doc' end as outcome from j),
       vcs as (select path, old_path, kind, dev, max(n) as n from (
            select path, old_path, 'base' as kind, v.dev, v.n from o join fx_local_vc v on v._id in (o.nid, o.oid)
            union all select path, old_path, 'new', v.dev, v.n from o join fx_local_vc v on v._id = o.nid
            union all select path, old_path, 'old', v.dev, v.n from o join fx_local_vc v on v._id = o.oid
            union all select path, old_path, unnest(['base', 'new', 'old']), 'dev-a', 0 from o) group by 1, 2, 3, 4),
       t as (select path, old_path, kind, step, '{' || string_agg(dev || ':' || (n + case when dev = 'dev-a' then step else 0 end), ',' order by dev) || '}' as vc
             from vcs, (values (0), (1), (2)) s(step) group by 1, 2, 3, 4)
       select o.old_path, o.path, outcome,
         (select vc from t where t.path = o.path and t.old_path = o.old_path
            and t.kind = case outcome when 'new-only' then 'new' when 'renamed' then 'base' when 'new-doc' then 'base' end
            and t.step = case outcome when 'renamed' then 2 else 1 end) as vclock,
         case when outcome = 'renamed' then 'tombstone' when outcome = 'new-doc' and not same_key then
              case when oid is null then 'baseline-removed' else 'baseline-aligned' end end as old_outcome,
         case when outcome = 'renamed' then (select vc from t where t.path = o.path and t.old_path = o.old_path and t.kind = 'base' and t.step = 1)
              when outcome = 'new-doc' and not same_key and oid is not null then
              (select vc from t where t.path = o.path and t.old_path = o.old_path and t.kind = 'old' and t.step = 0) end as old_vclock,
         array_to_string(own, ',') as chunks, size, same_key as case_only from o""",
)
def _(t):
    d = F.col("doc_id")
    disk = t._disk.select("doc_id", "path")
    files = t.files.select("doc_id", "path")
    next_path = files.select((d - 1).alias("doc_id"), F.col("path").alias("old_path"))
    own_path = files.withColumnRenamed("path", "old_path")
    renames = (
        disk.filter(d % 5 == 1).join(next_path, "doc_id").select("old_path", "path")
        .unionByName(disk.filter((d % 5 == 3) & (d % 17 != 0)).select(F.col("path").alias("old_path"), "path"))
        .unionByName(disk.filter((d % 17 == 0) & (d % 5 != 1)).join(own_path, "doc_id").select("old_path", "path"))
        .unionByName(disk.filter((d % 5 == 2) & (d % 17 != 0)).select(F.concat(F.lit("old/"), "path").alias("old_path"), "path"))
        .unionByName(files.filter(d % 50 == 7).select(F.col("path").alias("old_path"), F.concat(F.lit("nowhere/"), "path").alias("path")))
    )
    return reconcile.rename_docs(renames, t.disk, t.local_docs, t.baselines, DEVICE, CHUNK_BYTES).select(
        "old_path", "path", "outcome", text("vclock"), "old_outcome", text("old_vclock"),
        F.array_join("chunks", ",").alias("chunks"), "size", "case_only",
    )
