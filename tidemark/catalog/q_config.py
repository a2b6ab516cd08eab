"""Settings files."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import DEVICE
from tidemark.functions import clocks
from tidemark.operators import config
from tidemark.plans import pull, push

POLICY = config.Policy(units={"other": True, "theme-css": False}, block_plugin_code=False)
LOCKED = config.Policy()

UNITS = """
units as (select *, case when m = 0 then 'app-behavior' when m = 1 then 'layout' when m = 2 then 'enabled-list'
     when m = 3 then 'core-settings' when m = 4 then 'community-settings' when m = 5 then 'install-state' when m = 6 then 'theme-css'
     when m = 7 then 'snippets' else 'other' end as unit, m = 5 as is_plugin_code,
     case when m in (4, 5) then '.config/plugins/p' || k end as plugin_dir
   from (select *, k % 9 as m from fx_config_paths)),
sent as (select u.*, case when u.unit = 'layout' then false else coalesce(o.allowed,
     u.unit in ('app-behavior', 'core-settings', 'community-settings', 'snippets', 'other')) end as send
   from units u left join fx_config_overrides o using (path)),
received as (select s.* from sent s left join fx_plugins p using (plugin_dir)
   where send and (unit <> 'community-settings' or p.plugin_dir is not null) and not coalesce(p.desktop_only, false))
"""


@query("B8_classify_config_paths", f"with {UNITS} select path, unit, is_plugin_code, plugin_dir from units")
def _(t):
    return config.classify_config_paths(t.config_paths.select("path"))


@query("B9_send_scope", f"with {UNITS} select path, unit from sent where send")
def _(t):
    return config.send_scope(t.config_paths.select("path"), POLICY, t.config_overrides).select("path", "unit")


@query(
    "B9_send_scope_locked",
    f"""with {UNITS} select path, unit from units where unit in ('app-behavior', 'core-settings', 'community-settings', 'snippets', 'theme-css')""",
)
def _(t):
    return config.send_scope(t.config_paths.select("path"), LOCKED).select("path", "unit")


@query("B10_receive_scope", f"with {UNITS} select path, unit from received")
def _(t):
    return config.receive_scope(t.config_paths.select("path"), POLICY, t.plugins, True, t.config_overrides).select("path", "unit")


CONFIG_PAIR = """
crel as (select _id, case when gt and lt then 'concurrent' when gt then 'dominates' when lt then 'dominated' else 'equal' end as rel
  from (select _id, bool_or(l > r) as gt, bool_or(l < r) as lt
        from (select _id, dev, coalesce(max(n) filter (side = 'l'), 0) as l, coalesce(max(n) filter (side = 'r'), 0) as r
              from fx_config_vc group by 1, 2) group by 1)),
cl as (select * from fx_config_docs where side = 'l'), cr as (select * from fx_config_docs where side = 'r'),
cpair as (select _id, rel, cl.chunks as lc, cr.chunks as rc, cl.deleted as ld, cr.deleted as rd, cl.size as ls, cr.size as rs,
    cl.deleted = cr.deleted and (cl.deleted or (cl.size = cr.size and cl.chunks = cr.chunks)) as same
  from cl join cr using (_id) join crel using (_id))
"""


@query(
    "P22_config_scan",
    f"""with {UNITS}
       select 'config:' || path as _id, 'chunk:s256:' || sha256(encode(body)) as chunks, octet_length(encode(body)) as size,
              coalesce((select '{{' || string_agg(dev || ':' || n, ',' order by dev) || '}}' from (
                   select dev, sum(n)::bigint as n from (select dev, n from fx_config_vc v where v._id = 'config:' || s.path and side = 'l'
                     union all select 'dev-a', 1) group by dev)), '{{dev-a:1}}') as vclock
       from sent s where send and not (k % 4 = 1 and on_remote)""",
)
def _(t):
    synced = t._config_docs("r").filter(F.col("k") % 4 == 1).select(
        F.substring("_id", 8, 1 << 30).alias("path"),
        (F.col("size") - F.when(F.col("k") % 6 == 1, 1).otherwise(0)).alias("size"),
        "k",
    )
    body = t.config_disk.select("path", F.array(config.contentf.chunk_id("content")).alias("chunks"))
    last = synced.join(body, "path").select("path", "size", "chunks")
    out = config.config_scan(t.config_disk, t.config_local, last, POLICY, DEVICE, t.config_overrides)
    return out.select("_id", F.array_join("chunks", ",").alias("chunks"), "size", clocks.clock_text("vclock").alias("vclock"))


@query(
    "P23_config_push_plan",
    f"""with {CONFIG_PAIR}, p as (select cl._id, rel as relation, case when rel is null or rel = 'dominates' then 'push'
             when rel = 'equal' and lc = rc and ld = rd then 'skip' else 'divergent' end as action from cl left join cpair using (_id))
       select *, (select count(*) > 0 from p where action = 'divergent') as blocked from p""",
)
def _(t):
    return push.config_push_plan(t.config_local, t.config_remote)


@query(
    "P24_force_advance",
    f"""with {CONFIG_PAIR}, bad as (select _id from cpair where rel in ('concurrent', 'dominated'))
       select _id, '{{' || string_agg(dev || ':' || n, ',' order by dev) || '}}' as vclock
       from (select _id, dev, max(n) + case when dev = 'dev-a' then 1 else 0 end as n from fx_config_vc join bad using (_id) group by 1, 2) group by 1""",
)
def _(t):
    from tidemark.operators.integrity import config_divergence, dangerous_for

    bad = dangerous_for(config_divergence(t.config_local, t.config_remote), "push")
    return push.force_advance(bad, t.config_local, t.config_remote, DEVICE).select(
        "_id", clocks.clock_text("vclock").alias("vclock")
    )


def config_feed(t):
    body = F.struct(
        "_id", "schema_version", "chunks", "mtime", F.lit(0).cast("bigint").alias("ctime"), "size", "deleted", "vclock"
    )
    k = F.col("k")
    return t.config_remote.select(
        F.col("_id").alias("id"), (k + 1).alias("seq"), (k % 12 == 5).alias("deleted"), F.when(k % 12 != 5, body).alias("doc")
    )


def config_pull_sql(recreate):
    tie = "'take-remote'" if recreate else "'concurrent'"
    return f"""with {CONFIG_PAIR}
       select cr._id, case when cr.k % 12 = 5 then 'deleted' when rel is null then 'take-remote'
           when rel = 'equal' and lc = rc and ld = rd then 'converged' when same then case when rel = 'equal' then 'keep-local' else 'silent-merge' end
           when rel = 'concurrent' then 'concurrent' when rel = 'dominated' then 'take-remote'
           when rel = 'equal' then {tie} else 'keep-local' end as outcome
       from cr left join cpair using (_id)"""


@query("P25_config_pull_plan", config_pull_sql(False))
def _(t):
    return pull.config_pull_plan(config_feed(t), t.config_local).select("_id", "outcome")


@query("P25_config_pull_recreated", config_pull_sql(True))
def _(t):
    return pull.config_pull_plan(config_feed(t), t.config_local, recreate=True).select("_id", "outcome")


@query(
    "P26_config_write_plan",
    f"""with {UNITS}, b as (select d._id, d.deleted, case when d.k % 6 = 1 then body || '!' else body end as body, d.chunks[1] as c
             from fx_config_docs d join fx_config_paths p on d._id = 'config:' || p.path where side = 'r')
       select substr(_id, 8) as path, case when substr(c, 12, 1) = '0' then 'missing-chunks' else 'ok' end as status,
              case when substr(c, 12, 1) = '0' then 0 else octet_length(encode(body)) end as size,
              case when substr(c, 12, 1) <> '0' then body end as content
       from b where not deleted and substr(_id, 8) in (select path from received)""",
)
def _(t):
    out = config.config_write_plan(t.config_remote, t.config_remote_chunks, POLICY, t.plugins, True, t.config_overrides)
    return out.select("path", "status", "size", F.col("content").cast("string").alias("content"))


@query(
    "P27_config_tree",
    f"""with {UNITS} select unit, count(*) as items, count(*) filter (on_remote and not on_local) as server_only,
          bool_and(send) as all_on, bool_or(send) as any_on from sent where on_local or on_remote group by 1""",
)
def _(t):
    paths = t.config_paths
    return config.config_tree(paths.filter("on_local"), paths.filter("on_remote"), POLICY, t.config_overrides)
