"""Scans, writes, replication, logs and retry-set loading."""

import uuid

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import clocks
from tidemark.operators import baselines, integrity, logs
from tidemark.schemas import DAY_MS
from tidemark.session import work_dir
from tidemark.sources import feed, scan
from tidemark.sources.store import DocStore

NOW = 1704153600000  # 2024-01-02T00:00:00Z, inside the events table


@query("A1_scan_docs", "select _id, size from fx_stored_docs where _id like 'file:notes/%' order by _id")
def _(t):
    return scan.scan_docs(t.stored_docs, "file:notes/").select("_id", "size")


@query("A1_scan_docs_top", "select _id from fx_stored_docs order by _id limit 25")
def _(t):
    return scan.scan_docs(t.stored_docs, limit=25, include_docs=False)


@query("A1_scan_docs_keys", "select _id, size from fx_stored_docs where _id in (select id from fx_unpushed)")
def _(t):
    return scan.scan_docs(t.stored_docs, keys=t.unpushed.select(F.col("id").alias("_id"))).select("_id", "size")


@query("A2_list_ids", "select _id from fx_local_chunks where _id like 'chunk:s256:%'")
def _(t):
    return scan.list_ids(t.local_chunks, "chunk:s256:")


@query(
    "A3_changes_since",
    """select _id, _local_seq, (select coalesce(max(_local_seq), 40) from fx_stored_docs where _local_seq > 40) as last_seq
       from fx_stored_docs where _local_seq > 40""",
)
def _(t):
    rows, cursor = scan.changes_since(t.stored_docs, 40)
    one = F.lit(1).alias("k")
    return rows.select("_id", "_local_seq", one).join(F.broadcast(cursor.select("*", one)), "k").drop("k")


@query(
    "A3_stream_changes",
    """select _id, doc_id, size, _version, _local_seq from fx_stored_docs where _local_seq > 40
       union all select _id, doc_id, size + 1, _version + 1, (select max(_local_seq) + 1 from fx_stored_docs)
       from fx_stored_docs where doc_id % 10 = 5""",
)
def _(t):
    # Drained, changed by a batch, and drained again from the checkpoint.
    base = f"{work_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    held = DocStore(t.spark, f"{base}/store")
    none = t.spark.createDataFrame([], "_id string, content binary")
    held.start(t.stored_docs, none)
    columns = ["_id", "doc_id", "size", "_version", "_local_seq"]
    edited = t.stored_docs.filter(F.col("doc_id") % 10 == 5).withColumn("expected_vclock", F.col("vclock"))
    for again in (False, True):
        if again:
            held.apply(1, edited.withColumn("size", F.col("size") + 1), none)
        feed.stream_changes(t.spark, f"{base}/store", 40, columns).writeStream.format("parquet").option(
            "checkpointLocation", f"{base}/check"
        ).trigger(availableNow=True).start(f"{base}/rows").awaitTermination()
    return t.spark.read.parquet(f"{base}/rows").select(*columns)


@query(
    "A4_bulk_get",
    "select _id, array_to_string(chunks, ',') as chunks from fx_stored_docs where not deleted and _id in (select id from fx_unpushed)",
)
def _(t):
    return scan.bulk_get(t.stored_docs, t.unpushed.select(F.col("id").alias("_id"))).select(
        "_id", F.array_join("chunks", ",").alias("chunks")
    )


@query("A5_docs_under_folder", "select _id, size from fx_stored_docs where _id like 'file:notes/en/%' and not deleted")
def _(t):
    return scan.docs_under_folder(t.stored_docs, "notes/en").select("_id", "size")


@query(
    "A6_read_disk",
    """select 'docs/lang=' || lang || '/source=' || source as folder, cast(sum(octet_length(encode(text)) + 1) as bigint) as bytes,
          cast(sum(octet_length(encode(text)) + 1) as bigint) as body_bytes,
          cast(sum(length(text) - length(replace(text, chr(10), '')) + 1) as bigint) as lines
       from documents group by all
       union all select '.config', sum(octet_length(encode(source)) + 1)::bigint, sum(octet_length(encode(source)) + 1)::bigint, count(*) from documents
       union all select 'docs/_y', sum(octet_length(encode(lang)) + 1)::bigint, sum(octet_length(encode(lang)) + 1)::bigint, count(*) from documents
       union all select 'docs', 0, 0, 0""",
)
def _(t):
    # The documents written as files, a folder per language and source, are the disk; each
    # write leaves an empty file behind, and two folders have names that readers pass over.
    root = f"{work_dir(t.spark)}/disk-{uuid.uuid4().hex}"
    docs = t.source("documents").select("lang", "source", "text")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").text(f"{root}/docs")
    docs.select("source").write.text(f"{root}/.config")
    docs.select("lang").write.text(f"{root}/docs/_y")
    files = scan.read_disk(t.spark, root)
    body = F.decode("content", "UTF-8")
    return files.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.sum("size").alias("bytes"),
        F.sum(F.octet_length("content")).cast("bigint").alias("body_bytes"),
        F.sum(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))).cast("bigint").alias("lines"),
    )


BATCH = """
batch as (select r._id, r.chunks, r.size, r.deleted, r.doc_id from fx_remote_docs r),
ok as (select b.*, coalesce(s._version, 0) + 1 as _version from batch b left join fx_stored_docs s using (_id))
"""


def batch(t):
    stored = t.stored_docs.select("_id", F.col("vclock").alias("expected_vclock"))
    docs = t.remote_docs.join(stored, "_id", "left").withColumn(
        "expected_vclock", F.coalesce("expected_vclock", clocks.empty_clock())
    )
    return docs


WHOLE_BATCH = f"""with {BATCH} select 'doc' as kind, _id, _version, (select max(_local_seq) + 1 from fx_stored_docs) as _local_seq from ok
        union all select 'doc', _id, _version, _local_seq from fx_stored_docs where _id not in (select _id from batch)
          and not (doc_id % 6 = 2)
        union all select 'chunk', _id, null, null from fx_chunks where substr(_id, 12, 1) <> 'a'"""


@query("A7_apply_batch", WHOLE_BATCH)
def _(t):
    deletes = t.stored_docs.filter(F.col("doc_id") % 6 == 2).select("_id").join(
        t.remote_docs.select("_id"), "_id", "left_anti"
    )
    done = scan.apply_batch(t.stored_docs, t.local_chunks, batch(t), t.remote_chunks, deletes)
    return done.docs.select(F.lit("doc").alias("kind"), "_id", "_version", "_local_seq").unionByName(
        done.chunks.select(F.lit("chunk").alias("kind"), "_id"), allowMissingColumns=True
    )


@query("A7_durable_batch", WHOLE_BATCH)
def _(t):
    deletes = t.stored_docs.filter(F.col("doc_id") % 6 == 2).select("_id").join(
        t.remote_docs.select("_id"), "_id", "left_anti"
    )
    held = DocStore(t.spark, f"{work_dir(t.spark)}/store-{uuid.uuid4().hex}")
    held.start(t.stored_docs, t.local_chunks)
    for _ in range(2):  # the second time is a replay
        held.apply(1, batch(t), t.remote_chunks, deletes)
    return held.docs().select(F.lit("doc").alias("kind"), "_id", "_version", "_local_seq").unionByName(
        held.chunks().select(F.lit("chunk").alias("kind"), "_id"), allowMissingColumns=True
    )


@query(
    "A7_apply_batch_conflicts",
    """select _id, l.vc as stored, r.vc as expected from fx_rel join fx_local_text l using (_id) join fx_remote_text r using (_id)
       where rel <> 'equal'
       union all select _id, '{}', vc from fx_remote_text join fx_remote_docs using (_id) where _id not in (select _id from fx_local_docs)""",
)
def _(t):
    wrong = t.remote_docs.withColumn("expected_vclock", F.col("vclock"))
    return scan.apply_batch(t.stored_docs, t.local_chunks, wrong, t.remote_chunks).conflicts


@query(
    "A8_replicate_all",
    """select 'doc' as kind, _id, '' as verdict from fx_local_docs where not deleted
       union all select case when substr(_id, 12, 1) in ('b', 'c') then 'dropped' else 'chunk' end, _id,
         case substr(_id, 12, 1) when 'b' then 'content-missing' when 'c' then 'hash-mismatch' else '' end from fx_local_chunks""",
)
def _(t):
    digit = F.substring("_id", 12, 1)
    damaged = t.local_chunks.withColumn(
        "content", F.when(digit == "c", F.concat("content", F.lit(b"?"))).when(digit != "b", F.col("content"))
    )
    r = scan.replicate_all(t.stored_docs, damaged)
    return (
        r.docs.select(F.lit("doc").alias("kind"), "_id", F.lit("").alias("verdict"))
        .unionAll(r.chunks.select(F.lit("chunk"), "_id", F.lit("")))
        .unionAll(r.dropped.select(F.lit("dropped"), "_id", "verdict"))
    )


@query(
    "A9_delete_remote",
    "select _id, true as deleted from fx_remote_docs where not deleted and _id in (select id from fx_unpushed)",
)
def _(t):
    return scan.delete_remote(t.remote_docs, t.unpushed.select(F.col("id").alias("_id"))).select("_id", "deleted")


@query("A10_pull_by_prefix", "select _id, size from fx_remote_docs where _id like 'file:notes/fr/%' and not deleted")
def _(t):
    return scan.pull_by_prefix(t.remote_docs.withColumn("_rev", F.lit("1-a")), "file:notes/fr/").select("_id", "size")


@query("A10_list_remote_by_prefix", "select _id from fx_remote_docs where _id like 'file:notes/fr/%' and not deleted")
def _(t):
    return scan.list_remote_by_prefix(t.remote_docs, "file:notes/fr/")


@query(
    "A11_delete_by_prefix",
    "select case when _id like 'file:notes/de/%' then 'deleted' else 'remaining' end as part, _id from fx_stored_docs",
)
def _(t):
    left, gone = scan.delete_by_prefix(t.stored_docs, "file:notes/de/")
    return gone.select(F.lit("deleted").alias("part"), "_id").unionAll(left.select(F.lit("remaining"), "_id"))


@query(
    "A12_export_log",
    """select id, strftime(make_timestamp(timestamp * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z [' || upper(level) || '] ' || message as line from fx_logs""",
)
def _(t):
    return scan.export_log(t.logs)[0].select("id", "line")


@query(
    "A12_export_log_header",
    """select count(*) as log_count, strftime(make_timestamp(min(timestamp) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as range_from,
         strftime(make_timestamp(max(timestamp) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' as range_to,
         count(*) filter (level = 'debug') as debug, count(*) filter (level = 'info') as info,
         count(*) filter (level = 'warn') as warn, count(*) filter (level = 'error') as error from fx_logs""",
)
def _(t):
    return scan.export_log(t.logs)[1]


@query(
    "B11_classify_errors",
    r"""select id, case when regexp_matches(message, 'operation was aborted|\baborted\b', 'i') then 'aborted'
          when status in (401, 403) then 'auth' when status = 404 then 'not-found' when status >= 500 then 'server'
          when regexp_matches(message, 'timed?[\s_-]?out|timeout', 'i') then 'timeout'
          when regexp_matches(message, 'network|fetch|econn|enotfound|getaddrinfo|load failed|dns|unreachable|offline', 'i') then 'network'
          else 'unknown' end as error_kind from fx_errors""",
)
def _(t):
    return logs.classify_errors(t.errors).select("id", "error_kind")


@query(
    "B15_upgrade_baselines",
    """with raw as (select case when doc_id % 17 = 0 then upper(path) else path end as path, doc_id, size, doc_id % 3 = 0 as bare from fx_files
         union all select upper(path), doc_id, 0, true from fx_files where doc_id % 19 = 5)
       select lower(path) as path_key, '{dev-a:' || doc_id % 4 || '}' as vclock, case when not bare then 'c' || doc_id end as chunks,
              case when not bare then size end as size, case when not bare and doc_id % 2 = 0 then doc_id end as mtime,
              not bare and doc_id % 5 = 0 as deleted
       from (select * from raw qualify row_number() over (partition by lower(path) order by bare, path) = 1)""",
)
def _(t):
    d = F.col("doc_id")
    n = d.cast("string")
    clock = F.concat(F.lit('{"dev-a":'), (d % 4).cast("string"), F.lit("}"))
    full = F.concat(
        F.lit('{"vclock":'), clock, F.lit(',"chunks":["c'), n, F.lit('"],"size":'), F.col("size").cast("string"),
        F.when(d % 2 == 0, F.concat(F.lit(',"mtime":'), n)).otherwise(F.lit("")),
        F.when(d % 5 == 0, F.lit(',"deleted":true')).otherwise(F.lit("")), F.lit("}"),
    )
    main = t.files.select(
        F.when(d % 17 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"),
        F.when(d % 3 == 0, clock).otherwise(full).alias("value"),
    )
    extra = t.files.filter(d % 19 == 5).select(F.upper("path").alias("path"), clock.alias("value"))
    out = baselines.upgrade_baselines(main.unionAll(extra))
    return out.withColumn("vclock", clocks.clock_text("vclock")).withColumn("chunks", F.array_join("chunks", ","))


@query("E1_docs_signature", "select coalesce(max(_local_seq), 0) as max_seq, count(*) as doc_count from fx_stored_docs")
def _(t):
    return integrity.docs_signature(t.stored_docs)


@query(
    "E2_store_totals",
    """select count(*) as stores, sum(n)::bigint as docs, coalesce(sum(b), 0)::bigint as bytes
       from (select source, count(*) as n, case when min(doc_id) % 2 = 0 then sum(octet_length(encode(text))) end as b from documents group by 1)""",
)
def _(t):
    per = t.source("documents").groupBy("source").agg(
        F.count("*").alias("doc_count"),
        F.when(F.min("doc_id") % 2 == 0, F.sum(F.octet_length("text"))).alias("bytes"),
    )
    return logs.store_totals(per)


@query(
    "E3_log_stats",
    """select count(*) as entries, min(timestamp) as oldest, max(timestamp) as newest, sum(48 + 2 * length(message))::bigint as approx_bytes,
         count(*) filter (level = 'debug') as debug, count(*) filter (level = 'info') as info,
         count(*) filter (level = 'warn') as warn, count(*) filter (level = 'error') as error from fx_logs""",
)
def _(t):
    return logs.log_stats(t.logs)


@query("E4_log_range", f"select id, timestamp, level, message from fx_logs where timestamp >= {NOW}")
def _(t):
    return logs.log_range(t.logs, NOW)


@query(
    "E5_log_retention",
    f"""with recent as (select * from fx_logs where timestamp >= {NOW + 9 * DAY_MS} - 5 * {DAY_MS})
        select id, timestamp, level from recent qualify row_number() over (order by timestamp desc, id desc) <= 104""",
)
def _(t):
    return logs.log_retention(t.logs, NOW + 9 * DAY_MS, 5, 0.02)[0].select("id", "timestamp", "level")


@query(
    "E5_log_retention_counts",
    f"""select count(*) filter (timestamp < {NOW + 9 * DAY_MS - 5 * DAY_MS}) as removed_by_age,
          greatest(count(*) filter (timestamp >= {NOW + 9 * DAY_MS - 5 * DAY_MS}) - 104, 0) as removed_by_size,
          least(count(*) filter (timestamp >= {NOW + 9 * DAY_MS - 5 * DAY_MS}), 104) as kept from fx_logs""",
)
def _(t):
    return logs.log_retention(t.logs, NOW + 9 * DAY_MS, 5, 0.02)[1]


@query("E6_log_tail", "select id, timestamp, level, message from fx_logs order by timestamp desc, id desc limit 500")
def _(t):
    return logs.log_tail(t.logs)


@query(
    "E7_truncate_sections",
    """with r as (select 'local_only' as bucket, id from fx_presence where l and not r
          union all select 'remote_only', id from fx_presence where r and not l
          union all select 'orphan_local', id from fx_presence where l and not f
          union all select 'orphan_remote', id from fx_presence where r and not f
          union all select 'missing_referenced', id from fx_presence where f and not l and not r)
       select bucket, cast(rn as integer) as rank, id as line from (select *, row_number() over (partition by bucket order by id) as rn from r) where rn <= 20
       union all select bucket, 21, '... and ' || count(*) - 20 || ' more' from r group by bucket having count(*) > 20""",
)
def _(t):
    presence = integrity.chunk_presence(t.file_docs, t.local_chunks, t.remote_chunks)
    return logs.truncate_sections(integrity.report_rows(presence), 20)


@query(
    "J1_load_unpushed",
    """select 'file:' || path as id, case when doc_id % 3 = 0 then 'race-stale' else 'divergent' end as reason,
         cast(case when doc_id % 4 = 0 then 0 else doc_id % 7 end as integer) as attempts, doc_id as added_at
       from fx_files where doc_id % 3 <> 2 and doc_id % 5 <> 0""",
)
def _(t):
    d = F.col("doc_id")
    n = d.cast("string")
    reason = F.when(d % 3 == 0, "race-stale").when(d % 3 == 1, "divergent").otherwise("other")
    attempts = F.when(d % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(',"attempts":'), (d % 7).cast("string")))
    value = F.when(d % 5 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"reason":"'), reason, F.lit('","addedAt":'), n, attempts, F.lit("}"))
    )
    raw = t.files.select(F.concat(F.lit("file:"), "path").alias("id"), value.alias("value"))
    return baselines.load_retry_rows(raw, baselines.UNPUSHED_REASONS)
