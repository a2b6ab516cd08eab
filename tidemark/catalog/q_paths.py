"""Ids, paths, scope and row checks."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.functions import clocks
from tidemark.operators import paths
from tidemark.schemas import CLOCK

MIXED_IDS = """
select case doc_id % 9 when 0 then 'file:' || path when 1 then 'config:.config/' || doc_id || '.json'
  when 2 then 'chunk:s256:' || md5(path) when 3 then 'chunk:x64:' || doc_id when 4 then 'chunk:' || doc_id
  when 5 then 'chunk:zzz:' || doc_id when 6 then '_local/' || doc_id when 7 then '_scan/' || doc_id
  else 'odd' || doc_id end as _id, doc_id from fx_files
"""


def mixed_ids(t):
    d = F.col("doc_id")
    n = d.cast("string")
    return t.files.select(
        F.when(d % 9 == 0, F.concat(F.lit("file:"), "path"))
        .when(d % 9 == 1, F.concat(F.lit("config:.config/"), n, F.lit(".json")))
        .when(d % 9 == 2, F.concat(F.lit("chunk:s256:"), F.md5("path")))
        .when(d % 9 == 3, F.concat(F.lit("chunk:x64:"), n))
        .when(d % 9 == 4, F.concat(F.lit("chunk:"), n))
        .when(d % 9 == 5, F.concat(F.lit("chunk:zzz:"), n))
        .when(d % 9 == 6, F.concat(F.lit("_local/"), n))
        .when(d % 9 == 7, F.concat(F.lit("_scan/"), n))
        .otherwise(F.concat(F.lit("odd"), n))
        .alias("_id"),
        "doc_id",
    )


@query(
    "B1_doc_id",
    f"""select _id,
        case when _id like 'config:%' then 'config' when _id like 'chunk:%' then 'chunk'
             when _id like 'file:%' then 'file' when _id[1] = '_' then 'local' else 'unknown' end as kind,
        case when _id like 'config:%' then substr(_id, 8) when _id like 'file:%' then substr(_id, 6) end as path,
        case when _id like 'chunk:s256:%' then 's256' when _id like 'chunk:x64:%' then 'x64' end as alg,
        case when _id like 'chunk:s256:%' then substr(_id, 12) when _id like 'chunk:x64:%' then substr(_id, 11) end as hash,
        case when _id like '\\_local/%' escape '\\' then substr(_id, 8)
             when _id[1] = '_' then substr(_id, 2) end as local_name,
        case when _id like 'chunk:zzz:%' then 'unknown algorithm'
             when _id like 'chunk:%' and _id not like 'chunk:%:%' then 'missing algorithm tag' end as id_error
        from ({MIXED_IDS})""",
)
def _(t):
    return paths.with_doc_id(mixed_ids(t).drop("doc_id"))


# Titles come from whole texts: accents exercise the NFC fold.
FOLD_SQL = """
select doc_id, 'Notes/' || case when doc_id % 2 = 0 then nfc_normalize(text)
  else replace(nfc_normalize(text), 'é', 'e' || chr(769)) end as path from documents
"""


@query(
    "B2_path_key",
    f"""select doc_id, path, replace(lower(nfc_normalize(path)), 'i' || chr(775), 'i' || chr(775)) as path_key
        from ({FOLD_SQL})""",
)
def _(t):
    d = t.source("documents")
    combining = F.lit("e\u0301")
    df = d.select(
        "doc_id",
        F.concat(
            F.lit("Notes/"),
            F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(
                F.replace(F.col("text"), F.lit("é"), combining)
            ),
        ).alias("path"),
    )
    return paths.with_path_key(df)


@query(
    "B3_parent_dir",
    """select doc_id, p as path, case when strpos(p, '/') = 0 then ''
              else array_to_string(string_split(p, '/')[:-2], '/') end as parent_dir
       from (select doc_id, case when doc_id % 4 = 0 then 'top' || doc_id || '.md' else path end as p from fx_files)""",
)
def _(t):
    d = F.col("doc_id")
    named = F.when(d % 4 == 0, F.concat(F.lit("top"), d.cast("string"), F.lit(".md"))).otherwise(F.col("path"))
    return paths.with_parent_dir(t.files.select("doc_id", named.alias("path")))


@query(
    "B4_unsafe_paths",
    """select doc_id, p as path,
       case when p = '' then 'empty path' when contains(p, '\\') then 'backslash separator'
            when starts_with(p, '/') then 'absolute path' when regexp_matches(p, '^[a-zA-Z]:') then 'drive letter'
            when list_contains(string_split(p, '/'), '..') then 'parent-directory traversal (..)' end as unsafe_reason
       from (select doc_id, case doc_id % 8 when 0 then '' when 1 then replace(path, '/', '\\') when 2 then '/' || path
             when 3 then 'C:/' || path when 4 then '../' || path when 5 then 'a/../' || path
             when 6 then 'a..b/' || path else path end as p from fx_files)""",
)
def _(t):
    d, p = F.col("doc_id"), F.col("path")
    made = (
        F.when(d % 8 == 0, "")
        .when(d % 8 == 1, F.replace(p, F.lit("/"), F.lit("\\")))
        .when(d % 8 == 2, F.concat(F.lit("/"), p))
        .when(d % 8 == 3, F.concat(F.lit("C:/"), p))
        .when(d % 8 == 4, F.concat(F.lit("../"), p))
        .when(d % 8 == 5, F.concat(F.lit("a/../"), p))
        .when(d % 8 == 6, F.concat(F.lit("a..b/"), p))
        .otherwise(p)
    )
    return paths.flag_unsafe_paths(t.files.select("doc_id", made.alias("path")))


@query(
    "B5_filter_glob",
    """select doc_id, path from fx_files where regexp_full_match(path, 'notes/(?:.+/)?doc[^/]1[^/]*[.]md')
       or regexp_full_match(path, '.*2[.]md')""",
)
def _(t):
    return paths.filter_glob(t.files.select("doc_id", "path"), ["notes/**/doc?1*.md", "**2.md"])


@query(
    "B6_scope_classes",
    r"""select doc_id, path, case when regexp_matches(path, '(?P<folder>notes)/\p{L}+/src[0-4]') and not regexp_matches(path, '3[.]md$')
          then 'in' else 'out' end as scope from fx_files""",
)
def _(t):
    scoped = paths.with_scope(t.files.select("doc_id", "path", "size"), r"(?<folder>notes)/\p{L}+/src[0-4]", "3[.]md$")
    return scoped.select("doc_id", "path", "scope")


@query(
    "B6_sync_scope",
    """select doc_id, p as path, round(size / 1048576.0, 1) as size_mb,
       case when size / 1048576.0 > 0.01 then 'skipped' when starts_with(p, '.') then 'out'
            when regexp_matches(p, 'notes') and not regexp_matches(p, '3[.]md') then 'in' else 'out' end as scope
       from (select doc_id, size, case when doc_id % 6 = 0 then '.' || path when doc_id % 6 = 1 then upper(path)
             else path end as p from fx_files)""",
)
def _(t):
    d, p = F.col("doc_id"), F.col("path")
    made = F.when(d % 6 == 0, F.concat(F.lit("."), p)).when(d % 6 == 1, F.upper(p)).otherwise(p)
    return paths.with_scope(
        t.files.select("doc_id", made.alias("path"), "size"), "notes", r"3[.]md", 0.01
    ).drop("size")


@query(
    "B7_diffable_text",
    """select doc_id, not (doc_id % 5 = 0 or (doc_id % 5 = 1) or
          (octet_length(encode(text)) > 8192 and try(decode(encode(text)[1:8192])) is null)) as diffable
       from documents""",
)
def _(t):
    d = F.col("doc_id")
    body = (
        F.when(d % 5 == 0, F.concat(F.lit(b"\x00"), "content"))
        .when(d % 5 == 1, F.concat(F.lit(b"\xff\xfe"), "content"))
        .otherwise(F.col("content"))
    )
    return paths.flag_diffable_text(t.files.select("doc_id", body.alias("content"))).drop("content")


DEVICES = """
select 'file:' || path as _id, case doc_id % 6 when 0 then 'dev-a' when 1 then 'X' || doc_id
  when 2 then 'x' when 3 then '-lead' when 4 then '' else 'a-very-long-device-name-' || lpad(doc_id::varchar, 12, '0') end as device
from fx_files union all select 'file:' || path, 'ok-' || doc_id from fx_files
"""


@query(
    "B12_bad_devices",
    f"""select _id, device, problem from (select _id, device,
          case when device = '' then 'required' when length(device) < 2 then 'too short'
               when length(device) > 30 then 'too long'
               when not regexp_full_match(device, '[a-z0-9][a-z0-9-]*[a-z0-9]') then 'bad characters' end as problem
        from ({DEVICES})) where problem is not null""",
)
def _(t):
    d = F.col("doc_id")
    n = d.cast("string")
    name = (
        F.when(d % 6 == 0, "dev-a").when(d % 6 == 1, F.concat(F.lit("X"), n)).when(d % 6 == 2, "x")
        .when(d % 6 == 3, "-lead").when(d % 6 == 4, "")
        .otherwise(F.concat(F.lit("a-very-long-device-name-"), F.lpad(n, 12, "0")))
    )
    vclock = F.map_from_arrays(
        F.array(name, F.concat(F.lit("ok-"), n)), F.array(F.lit(1), F.lit(2))
    ).cast(CLOCK)
    docs = t.files.select(F.concat(F.lit("file:"), "path").alias("_id"), vclock.alias("vclock"))
    return paths.flag_bad_devices(docs)


@query(
    "B13_schema_gate",
    "select _id, cast(1 + doc_id % 3 as integer) as schema_version from fx_local_docs where doc_id % 3 <> 1",
)
def _(t):
    aged = t.local_docs.withColumn("schema_version", (1 + F.col("doc_id") % 3).cast("int"))
    return paths.schema_gate(aged, "file").select("_id", "schema_version")


@query(
    "B14_legacy_docs",
    f"""select _id, case when _id like 'odd%' then 'unknown prefix' when _id like 'config:%' then 'config row in file store'
          else 'file without clock' end as why
        from ({MIXED_IDS}) where _id like 'odd%' or _id like 'config:%' or (_id like 'file:%' and doc_id % 2 = 0)""",
)
def _(t):
    vc = F.when(F.col("doc_id") % 2 == 1, F.create_map(F.lit("dev-a"), F.lit(1)).cast(CLOCK))
    return paths.find_legacy_docs(mixed_ids(t).select("_id", vc.alias("vclock")))
