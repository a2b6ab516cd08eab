"""Classification, pull, push and conflict plans."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import clocks, ids
from tidemark.operators import classify
from tidemark.plans import conflicts, pull, push

# Relation of local (left) and remote (right) docs, both with real clocks.
PAIR = """
pair as (
  select l._id, l.doc_id, f.rel, l.deleted as ld, r.deleted as rd,
         l.chunks as lc, r.chunks as rc, l.size as ls, r.size as rs,
         (l.deleted = r.deleted and (l.deleted or (l.size = r.size and l.chunks = r.chunks))) as same
  from fx_local_docs l join fx_remote_docs r using (_id) join fx_rel f using (_id)),
pair_rel as (
  select *, case when same and rel = 'equal' then 'identical' when same then 'vclock-only-drift'
     when rel = 'concurrent' then 'true-divergent' when rel = 'dominated' then 'remote-edit'
     when rel = 'equal' then 'true-divergent' else 'local-edit' end as relation from pair),
pair_verdict as (
  select *, case relation when 'identical' then 'keep-local' when 'vclock-only-drift' then 'silent-merge'
     when 'remote-edit' then 'take-remote' when 'local-edit' then 'keep-local' else 'concurrent' end as verdict from pair_rel)
"""


@query(
    "P1_classify_relation",
    """with pair as (
         select l._id, l.doc_id, f.rel, l.deleted as ld, r.deleted as rd, b.path_key is not null as based, b.deleted as bd,
           b.chunks is null or b.size is null as legacy, l.doc_id % 2 = 0 as attributed, l.doc_id % 3 = 0 as recreate,
           (l.deleted = r.deleted and (l.deleted or (l.size = r.size and l.chunks = r.chunks))) as same,
           coalesce(not b.deleted and b.size = l.size and b.chunks = l.chunks, false) as explained
         from fx_local_docs l join fx_remote_docs r using (_id) join fx_rel f using (_id)
         left join fx_baselines b on b.path_key = lower(substr(l._id, 6)))
       select _id, case when same and rel = 'equal' then 'identical' when same then 'vclock-only-drift'
         when rel = 'concurrent' then 'true-divergent'
         when rel = 'dominated' and rd and not ld and attributed then
           case when based and not bd and not legacy and explained then 'remote-edit' else 'true-divergent' end
         when rel = 'dominated' and not based then 'remote-edit'
         when rel = 'dominated' and legacy then 'legacy-skip'
         when rel = 'dominated' then case when explained and not ld then 'remote-edit' else 'true-divergent' end
         when rel = 'equal' and not attributed then case when recreate then 'remote-edit' else 'true-divergent' end
         else 'local-edit' end as relation from pair""",
)
def _(t):
    d = F.col("doc_id")
    base = t.baselines.select("path_key", *[F.col(c).alias("b_" + c) for c in ("vclock", "chunks", "size", "deleted")])
    pairs = (
        classify.prefixed(t.local_docs, "l_", "_id")
        .join(t.local_docs.select("_id", "doc_id"), "_id")
        .join(classify.prefixed(t.remote_docs, "r_", "_id"), "_id")
        .withColumn("path_key", F.lower(ids.path_of("_id")))
        .join(base, "path_key", "left")
        .withColumn("attributed", d % 2 == 0)
        .withColumn("recreate", d % 3 == 0)
    )
    return classify.classify_relation(pairs).select("_id", "relation")


@query(
    "P2_pull_verdicts",
    f"""with {PAIR}
       select r._id, p.relation, coalesce(p.verdict, 'take-remote') as verdict
       from fx_remote_docs r left join pair_verdict p using (_id)""",
)
def _(t):
    return classify.pull_verdicts(t.remote_docs, t.local_docs).select("_id", "relation", "verdict")


def pull_plan(t):
    held = t.unpushed.select(F.col("id").alias("_id"))
    return pull.pull_plan(t.feed, t.local_docs, held)


PULL = f"""
{PAIR},
latest as (select id as _id, max(seq) as seq, max_by(deleted, seq) as gone, max_by(doc_id, seq) as feed_doc from fx_feed group by 1),
pull as (
  select f._id, f.seq,
    case when f.gone and f._id not like 'file:%' then 'ignored'
         when f.gone and (l._id is null or l.deleted) then 'deletion-moot'
         when f.gone and f._id in (select id from fx_unpushed) then 'deletion-conflict'
         when f.gone then 'deletion-applied'
         when f._id like 'chunk:%' then 'chunk'
         when p.rel = 'equal' and p.lc = p.rc and p.ld = p.rd then 'converged'
         else coalesce(p.verdict, 'take-remote') end as outcome,
    p.ld, p.rd, r.chunks as rchunks, r.size as rsize, r.deleted as rdeleted
  from latest f left join fx_local_docs l using (_id) left join fx_remote_docs r using (_id)
  left join pair_verdict p using (_id)),
pull_out as (
  select q._id, q.seq, outcome, outcome in ('take-remote', 'silent-merge', 'deletion-applied') as accepted,
    case outcome when 'take-remote' then rt.vc when 'silent-merge' then m.vc when 'deletion-applied' then lt.vc
                 when 'deletion-conflict' then '{{}}' end as vclock,
    case when outcome in ('take-remote', 'silent-merge') then array_to_string(rchunks, ',')
         when outcome = 'deletion-applied' then '' end as chunks,
    case when outcome in ('take-remote', 'silent-merge') then rsize when outcome = 'deletion-applied' then 0 end as size,
    case when outcome in ('take-remote', 'silent-merge') then rdeleted when outcome = 'deletion-applied' then true end as deleted,
    case when outcome = 'deletion-conflict' then 'pull-delete-vs-edit'
         when outcome = 'concurrent' and rd and not ld then 'pull-delete-vs-edit'
         when outcome = 'concurrent' and ld and not rd then 'local-delete-vs-remote-edit'
         when outcome = 'concurrent' and not ld and not rd then 'edit-vs-edit' end as pending_kind
  from pull q left join fx_remote_text rt using (_id) left join fx_local_text lt using (_id)
  left join fx_merged_text m using (_id))
"""


@query("P3_pull_plan", f"with {PULL} select * from pull_out")
def _(t):
    return pull_plan(t).select(
        "_id", "seq", "outcome", "accepted", clocks.clock_text("vclock").alias("_vc"), F.col("vclock").isNull().alias("_no"),
        F.array_join("chunks", ",").alias("chunks"), "size", "deleted", "pending_kind",
    ).withColumn("vclock", F.when(~F.col("_no"), F.col("_vc"))).drop("_vc", "_no")


@query(
    "P4_pull_stats",
    f"""with {PULL} select count(*) filter (outcome = 'keep-local') as keep_local, count(*) filter (outcome = 'chunk') as chunks,
          count(*) filter (outcome like 'deletion-%') as deleted, count(*) filter (outcome = 'converged') as converged,
          count(*) filter (outcome = 'silent-merge') as silent_merge,
          count(*) filter (outcome in ('concurrent', 'deletion-conflict')) as concurrent,
          count(*) filter (accepted) as accepted,
          count(*) filter (accepted and seq % 4 <> 0) as written, count(*) filter (accepted and seq % 12 = 0) as skipped,
          count(*) filter (accepted and seq % 4 = 0 and seq % 12 <> 0) as failed from pull_out""",
)
def _(t):
    plan = pull_plan(t)
    s = F.col("seq")
    result = F.when(s % 4 != 0, "applied").when(s % 12 == 0, "skipped").otherwise("failed")
    return pull.pull_stats(plan, plan.filter("accepted").select("_id", result.alias("result")))


# Echo records: what an earlier pull wrote, by id and sequence.
WRITES = "select _id as id, doc_id + 1 - doc_id % 3 as seq from fx_local_docs where doc_id % 4 <> 0"


def pull_writes(t):
    d = F.col("doc_id")
    return t.local_docs.filter(d % 4 != 0).select(F.col("_id").alias("id"), (d + 1 - d % 3).alias("seq"))


CANDIDATES = f"""
changed as (select s._id, 'change' as origin from fx_stored_docs s left join ({WRITES}) w on w.id = s._id
            where s._local_seq > 20 and (w.seq is null or s._local_seq > w.seq)),
cand as (select * from changed union all
         select _id, 'retry' from fx_stored_docs where _id in (select id from fx_unpushed) and _id not in (select _id from changed))
"""


@query(
    "P5_push_candidates",
    f"""with {CANDIDATES} select _id, origin from cand union all
        select id, 'zombie' from fx_unpushed where id not in (select _id from fx_stored_docs)""",
)
def _(t):
    candidates, zombies = push.push_candidates(t.stored_docs, 20, pull_writes(t), t.unpushed)
    return candidates.unionAll(zombies.withColumn("origin", F.lit("zombie")))


PUSH = f"""
{PAIR},
push as (
  select l._id, p.rel as relation, coalesce(u.attempts, 0) as attempts, l.chunks,
    case when p.rel is null then case when u.reason = 'race-stale' and u.attempts >= 3 then 'divergent' else 'push' end
         when p.rel in ('equal', 'dominates') and p.lc = p.rc and p.ld = p.rd then 'skip'
         when p.rel = 'dominates' then case when u.reason = 'race-stale' and u.attempts >= 3 then 'divergent' else 'push' end
         else 'divergent' end as action
  from fx_local_docs l left join pair p using (_id) left join fx_unpushed u on u.id = l._id)
"""


def push_plan(t):
    return push.push_plan(t.local_docs, t.remote_docs, t.unpushed)


@query("P6_push_plan", f"with {PUSH} select _id, action, relation, attempts from push")
def _(t):
    return push_plan(t).drop("chunks")


FAILED = "substr(id, 12, 1) = 'e' and substr(id, 13, 1) in ('0', '1', '2', '3')"
GATED = f"""
{PUSH},
gated as (select *, action = 'push' and coalesce(list_bool_or(list_transform(chunks, lambda id: {FAILED})), false) as withheld from push)
"""


def chunk_results(t):
    sub = F.substring("id", 12, 2)
    error = F.when(sub.isin("e0", "e1", "e2", "e3"), "forbidden").when(F.substring("id", 12, 1) == "f", "conflict")
    return t.chunks.select(F.col("_id").alias("id")).withColumn("error", error)


@query("P7_gate_files_on_chunks", f"with {GATED} select _id, action, withheld from gated")
def _(t):
    return push.gate_files_on_chunks(push_plan(t), chunk_results(t)).select("_id", "action", "withheld")


@query(
    "P8_apply_push_results",
    f"""with {GATED},
      out as (select *, case when action = 'divergent' then 'divergent'
                when withheld or (action = 'push' and bytes % 5 = 0) then 'race-stale' end as reason,
                action = 'skip' or (action = 'push' and not withheld and bytes % 5 <> 0) as leaves from
              (select g.*, d.size as bytes from gated g join fx_local_docs d using (_id)))
      select _id as id, reason, cast(attempts + 1 as integer) as attempts, 77 as added_at from out where reason is not null
      union all
      select id, reason, attempts, added_at from fx_unpushed u
      where id not in (select _id from out where leaves or reason is not null) and id in (select _id from fx_stored_docs)""",
)
def _(t):
    plan = push.gate_files_on_chunks(push_plan(t), chunk_results(t))
    _, zombies = push.push_candidates(t.stored_docs, 20, pull_writes(t), t.unpushed)
    sent = plan.filter("action = 'push'").join(t.local_docs.select("_id", "size"), "_id")
    results = sent.select(F.col("_id").alias("id"), F.when(F.col("size") % 5 == 0, "conflict").alias("error"))
    return push.apply_push_results(t.unpushed, plan, results, zombies, now=77)


@query(
    "P9_warmup_unpushed",
    f"""with {PAIR} select u.* from fx_unpushed u join fx_local_docs l on l._id = u.id left join pair p on p._id = u.id
       where not coalesce(p.rel in ('equal', 'dominates') and p.lc = p.rc and p.ld = p.rd, false)""",
)
def _(t):
    return push.warmup_unpushed(t.unpushed, t.local_docs, t.remote_docs)


CHOICES = """
select _id, case doc_id % 4 when 0 then 'keep-local' when 1 then 'take-remote' when 2 then 'defer' else 'take-remote' end as choice
from fx_local_docs where doc_id % 8 <> 7
"""
ANY_BUMP = """
bump as (select _id, kind, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc
  from (select _id, kind, dev, sum(n)::bigint as n from (
     select _id, 'merged' as kind, dev, n from fx_merged_vc union all select _id, 'remote', dev, n from fx_remote_vc
     union all select _id, 'merged', 'dev-a', 1 from fx_file_docs union all select _id, 'remote', 'dev-a', 1 from fx_file_docs)
   group by 1, 2, 3) group by 1, 2)
"""


@query(
    "P20_resolve_conflicts",
    f"""with {PAIR}, {ANY_BUMP},
       conf as (select p.*, p.doc_id % 5 = 0 as binary_, c.choice from pair_verdict p left join ({CHOICES}) c using (_id)
                where verdict = 'concurrent'),
       dec as (select *, case when binary_ then 'keep-local' when choice in ('keep-local', 'take-remote') then choice else 'pending' end as decision from conf)
       select d._id, decision,
         case when decision = 'keep-local' or (decision = 'take-remote' and rd) then m.vc when decision = 'take-remote' then r.vc end as vclock,
         case decision when 'keep-local' then array_to_string(lc, ',') when 'take-remote' then array_to_string(rc, ',') end as chunks,
         case decision when 'keep-local' then ls when 'take-remote' then rs end as size,
         case decision when 'keep-local' then ld when 'take-remote' then rd end as deleted
       from dec d join bump m on m._id = d._id and m.kind = 'merged' join bump r on r._id = d._id and r.kind = 'remote'""",
)
def _(t):
    d = F.col("doc_id")
    torn = classify.pull_verdicts(t.remote_docs, t.local_docs).filter("verdict = 'concurrent'").select("_id")
    facts = t.local_docs.select("_id", (d % 5 == 0).alias("binary"))
    choice = F.when(d % 4 == 0, "keep-local").when(d % 4 == 2, "defer").otherwise("take-remote")
    choices = t.local_docs.filter(d % 8 != 7).select("_id", choice.alias("choice"))
    out = conflicts.resolve_conflicts(torn.join(facts, "_id"), t.local_docs, t.remote_docs, choices, "dev-a")
    return out.select(
        "_id", "decision", F.when(F.col("vclock").isNotNull(), clocks.clock_text("vclock")).alias("vclock"),
        F.array_join("chunks", ",").alias("chunks"), "size", "deleted",
    )


@query(
    "P21_pending_conflicts_review",
    f"""with {PAIR}
       select c.id, c.kind, case when case c.kind
           when 'local-delete-vs-remote-edit' then l.deleted and not r.deleted
           when 'edit-vs-edit' then not l.deleted and not r.deleted and p.verdict = 'concurrent'
           else not l.deleted end then 'present' else 'drop' end as decision
       from fx_pending_conflict c left join fx_local_docs l on l._id = c.id left join fx_remote_docs r on r._id = c.id
       left join pair_verdict p on p._id = c.id""",
)
def _(t):
    return pull.pending_conflicts_review(t.pending_conflict, t.local_docs, t.remote_docs)


@query(
    "T5_pending_apply_step",
    """with gone as (select distinct 'file:' || path as _id from fx_pieces where chunk_id not in (select _id from fx_local_chunks))
       select id, reason, cast(case when outcome = 'retry' then attempts + 1 else attempts end as integer) as attempts, outcome
       from (select p.*, case when p.reason = 'pending-deletion' then case when d.deleted then 'applied' else 'moot' end
                when d._id is null or d.deleted then 'moot' when g._id is not null then 'retry' else 'applied' end as outcome
             from fx_pending_apply p left join fx_local_docs d on d._id = p.id left join gone g on g._id = p.id)""",
)
def _(t):
    return pull.pending_apply_step(t.pending_apply, t.local_docs, t.local_chunks)
