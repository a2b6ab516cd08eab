"""Chunking, dedup and chunk integrity."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.tables import CHUNK_BYTES
from tidemark.operators import chunking

JOINED = "array_to_string(chunks, ',')"


@query(
    "C1_split_into_chunks",
    """select doc_id, ord::integer as ord, chunk_id as _id, octet_length(piece) as bytes from fx_pieces""",
)
def _(t):
    return t.pieces.select("doc_id", "ord", "_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query(
    "C2_dedup_chunks",
    "select _id, octet_length(content) as bytes, md5(content) as body from fx_chunks",
)
def _(t):
    return t.chunks.select("_id", F.octet_length("content").cast("bigint").alias("bytes"), F.md5("content").alias("body"))


@query("C3_file_fingerprints", f"select doc_id, path, {JOINED} as chunks, size from fx_file_docs join fx_files using (doc_id, size)")
def _(t):
    return chunking.file_fingerprints(t.files.select("doc_id", "path", "content"), CHUNK_BYTES).select(
        "doc_id", "path", F.array_join("chunks", ",").alias("chunks"), "size"
    )


@query(
    "C4_disk_fingerprints",
    "select path, array_to_string(chunks, ',') as chunks, reused from fx_disk_prints",
)
def _(t):
    return chunking.disk_fingerprints(t.disk, t.baselines, CHUNK_BYTES).select(
        "path", F.array_join("chunks", ",").alias("chunks"), "reused"
    )


@query(
    "C5_verify_chunks",
    """select case when substr(_id, 12, 1) = 'd' then replace(_id, 's256', 'x64') else _id end as _id,
       case when substr(_id, 12, 1) = 'b' then 'content-missing' when substr(_id, 12, 1) = 'd' then 'alg-mismatch'
            when substr(_id, 12, 1) = 'c' then 'hash-mismatch' else 'ok' end as verdict from fx_chunks""",
)
def _(t):
    digit = F.substring("_id", 12, 1)
    damaged = t.chunks.select(
        F.when(digit == "d", F.replace(F.col("_id"), F.lit("s256"), F.lit("x64"))).otherwise(F.col("_id")).alias("_id"),
        F.when(digit == "c", F.concat("content", F.lit(b"?"))).when(digit != "b", F.col("content")).alias("content"),
    )
    return chunking.verify_chunks(damaged).select("_id", "verdict")


@query(
    "C6_reassemble",
    """with gone as (select p.doc_id, string_agg(p.chunk_id, ',' order by p.ord) as missing from fx_pieces p
                     where p.chunk_id not in (select _id from fx_local_chunks) group by 1),
            have as (select p.doc_id, coalesce(sum(octet_length(p.piece)), 0)::bigint as size from fx_pieces p
                     where p.chunk_id in (select _id from fx_local_chunks) group by 1)
       select d._id, case when g.missing is not null then 'missing-chunks'
                          when h.size > 0.02 * 1048576 then 'exceeds-max-size' else 'ok' end as status,
              coalesce(g.missing, '') as missing, coalesce(h.size, 0) as size,
              case when g.missing is null and h.size <= 0.02 * 1048576 then sha256(f.content) end as body
       from fx_file_docs d join fx_files f using (doc_id) left join gone g using (doc_id) left join have h using (doc_id)""",
)
def _(t):
    return chunking.reassemble(t.file_docs, t.local_chunks, 0.02).select(
        "_id", "status", F.array_join("missing", ",").alias("missing"), "size", F.sha2("content", 256).alias("body")
    )


@query(
    "C7_at_rest_bytes",
    """select (select sum(octet_length(content)) from fx_chunks where _id in (select id from fx_refs))::bigint as at_rest,
              (select count(*) from fx_chunks where _id in (select id from fx_refs)) as chunks,
              sum(size)::bigint as logical,
              round((select sum(octet_length(content)) from fx_chunks where _id in (select id from fx_refs))::double / sum(size), 6) as ratio
       from fx_file_docs where not deleted""",
)
def _(t):
    return chunking.at_rest_bytes(t.file_docs, t.chunks)


@query(
    "C8_codec_report",
    """with b as (select case when doc_id % 8 = 0 then ''::blob
             when doc_id % 8 = 1 then '\\x00'::blob || content when doc_id % 8 = 2 then '\\x01'::blob || content
             when doc_id % 8 = 3 then '\\x02'::blob || content when doc_id % 8 = 4 then '\\x03'::blob || content
             when doc_id % 8 = 5 then '\\x80'::blob || content when doc_id % 8 = 6 then '\\x04'::blob || content
             else '\\x01'::blob || content[1:5] end as blob, doc_id % 8 as m, size from fx_files)
       select case when m = 0 then 'invalid: empty' when m = 1 then 'plain'
                   when m in (2, 4, 7) and octet_length(blob) < 13 then 'invalid: short encrypted'
                   when m = 2 then 'encrypted' when m = 3 then 'compressed' when m = 4 then 'encrypted+compressed'
                   when m = 5 then 'invalid: extension bit' when m = 6 then 'invalid: reserved bits' end as mode,
              count(*) as blobs, sum(octet_length(blob))::bigint as bytes from b group by 1""",
)
def _(t):
    m = F.col("doc_id") % 8
    body = F.col("content")
    blob = F.when(m == 0, F.lit(b""))
    for value, head in ((1, b"\x00"), (2, b"\x01"), (3, b"\x02"), (4, b"\x03"), (5, b"\x80"), (6, b"\x04")):
        blob = blob.when(m == value, F.concat(F.lit(head), body))
    blob = blob.otherwise(F.concat(F.lit(b"\x01"), F.substring(body, 1, 5)))
    return chunking.codec_report(t.files.select(blob.alias("content")))


@query("C9_gzip_savings")
def _(t):
    return chunking.gzip_savings(t.chunks)
