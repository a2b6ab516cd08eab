"""Vector clocks."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import clocks, ids
from tidemark.operators import clock_ops


def pairs(t):
    return t.local_docs.select("_id", F.col("vclock").alias("a")).join(
        t.remote_docs.select("_id", F.col("vclock").alias("b")), "_id"
    )


@query("V1_clock_relation", "select _id, rel as relation from fx_rel")
def _(t):
    return clock_ops.with_vc_relation(pairs(t), "a", "b").select("_id", "relation")


@query(
    "V2_clock_merge",
    """select _id, vc as merged from fx_merged_text
       where _id in (select _id from fx_local_docs) and _id in (select _id from fx_remote_docs)""",
)
def _(t):
    return clock_ops.merge_vc(pairs(t), "a", "b").select("_id", clocks.clock_text("merged").alias("merged"))


FOLDER = "regexp_extract(_id, '^file:(.*)/[^/]*$', 1)"


@query(
    "V2_clock_merge_by_folder",
    f"""select folder, '{{' || string_agg(dev || ':' || n, ',' order by dev) || '}}' as merged
        from (select {FOLDER} as folder, dev, max(n) as n from fx_local_vc
              where _id in (select _id from fx_local_docs) group by 1, 2) group by 1""",
)
def _(t):
    docs = t.local_docs.withColumn("folder", ids.parent_dir(ids.path_of("_id")))
    return clock_ops.merge_vc_by(docs, ["folder"]).select(
        "folder", clocks.clock_text("vclock").alias("merged")
    )


@query(
    "V3_clock_increment",
    """select _id, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc
       from (select _id, dev, sum(n)::bigint as n
             from (select * from fx_local_vc union all
                   select distinct _id, 'dev-b', 1 from fx_local_vc)
             where _id in (select _id from fx_local_docs) group by 1, 2) group by 1""",
)
def _(t):
    return clock_ops.increment_vc(t.local_docs, "dev-b").select("_id", clocks.clock_text("vclock").alias("vc"))


@query(
    "V4_dominators",
    """with g as (select c._id, lower(c._id) as k from fx_case_docs c),
       top as (select k, dev, max(n) as n from fx_case_vc join g using (_id) group by 1, 2),
       short as (select distinct g._id, g.k from g join top using (k)
                 left join fx_case_vc v on v._id = g._id and v.dev = top.dev
                 where coalesce(v.n, 0) < top.n),
       best as (select k, min(_id) as dominator from g
                where _id not in (select _id from short) group by 1)
       select k as path_key, dominator, min(_id) as smallest from g left join best using (k) group by 1, 2""",
)
def _(t):
    return clock_ops.dominators(t.case_docs.withColumn("path_key", F.lower("_id")), ["path_key"])


@query(
    "V5_latest_device",
    """select _id, dev as latest_device from fx_local_vc where _id in (select _id from fx_local_docs)
       qualify row_number() over (partition by _id order by n desc, dev) = 1""",
)
def _(t):
    return clock_ops.with_latest_device(t.local_docs).select("_id", "latest_device")
