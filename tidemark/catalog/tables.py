"""Store-shaped tables derived by Spark from a data folder, and their SQL twins.

Every table grows with its source.  ``VIEWS`` holds the same derivations as SQL
so that a query can be checked against another engine.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import content as contentf
from tidemark.schemas import CLOCK

CHUNK_BYTES = 1024
CONFIG_DIR = ".config"
DEVICE = "dev-a"
PREVIOUS_DEVICES = ["dev-old"]

VIEWS: dict[str, str] = {
    "fx_files": """
select doc_id, 'notes/' || lang || '/' || source || '/doc' || doc_id || '.md' as path,
       encode(text) as content, octet_length(encode(text)) as size,
       1700000000000 + doc_id * 1000 as mtime
from documents""",
    "fx_pieces": """
select f.doc_id, f.path, t.i as ord,
       'chunk:s256:' || sha256(f.content[t.i * 1024 + 1 : t.i * 1024 + 1024]) as chunk_id,
       f.content[t.i * 1024 + 1 : t.i * 1024 + 1024] as piece
from fx_files f,
     lateral (select unnest(range(0, greatest(1, (f.size + 1023) // 1024))) as i) t""",
    "fx_file_docs": """
select 'file:' || p.path as _id, p.doc_id, list(p.chunk_id order by p.ord) as chunks,
       any_value(f.mtime) as mtime, any_value(f.size) as size, p.doc_id % 10 = 3 as deleted
from fx_pieces p join fx_files f using (doc_id) group by p.path, p.doc_id""",
    "fx_chunks": """
select chunk_id as _id, any_value(piece) as content from fx_pieces group by chunk_id""",
    "fx_local_chunks": "select * from fx_chunks where substr(_id, 12, 1) not in ('0', 'a')",
    "fx_remote_chunks": "select * from fx_chunks where substr(_id, 12, 1) not in ('1', 'a')",
    "fx_local_vc": """
select 'file:' || path as _id, 'dev-a' as dev,
       1 + doc_id % 3 + case when doc_id % 5 = 1 then 1 else 0 end as n from fx_files
union all select 'file:' || path, 'dev-b', 1 from fx_files where doc_id % 2 = 1""",
    "fx_remote_vc": """
select 'file:' || path as _id, 'dev-a' as dev, 1 + doc_id % 3 as n from fx_files
union all
select 'file:' || path, 'dev-b', doc_id % 2 + case when doc_id % 4 = 1 then 1 else 0 end
from fx_files where doc_id % 2 = 1 or doc_id % 4 = 1""",
    "fx_local_docs": "select * from fx_file_docs where doc_id % 7 <> 0",
    "fx_remote_docs": """
select _id, doc_id,
       case when doc_id % 6 = 1 then list_concat(chunks, ['chunk:s256:edited']) else chunks end as chunks,
       mtime, case when doc_id % 6 = 1 then size + 1 else size end as size,
       doc_id % 10 in (3, 4) as deleted
from fx_file_docs where doc_id % 11 <> 0""",
    "fx_baselines": """
select lower(nfc_normalize(substr(_id, 6))) as path_key, doc_id,
       case when doc_id % 4 = 0 then null else chunks end as chunks,
       case when doc_id % 4 = 0 then null else size end as size,
       case when doc_id % 4 = 2 then mtime end as mtime, deleted
from fx_file_docs where doc_id % 3 <> 2""",
    "fx_baselines_vc": """
select lower(nfc_normalize('notes/' || lang || '/' || source || '/doc' || doc_id || '.md')) as path_key,
       'dev-a' as dev, case when doc_id % 2 = 1 then 1 else 1 + doc_id % 3 end as n
from documents""",
    "fx_disk": """
select case when doc_id % 17 = 0 then upper(path) else path end as path, doc_id,
       mtime + case when doc_id % 8 = 0 then 1 else 0 end as mtime,
       case when doc_id % 9 = 0 then content || encode('!') else content end as content
from fx_files where doc_id % 10 <> 3 and doc_id % 13 <> 0""",
    "fx_case_disk": """
select path, mtime, content from fx_disk
union all
select upper(path), mtime, content from fx_disk
where doc_id % 19 = 5 and doc_id % 17 <> 0 and doc_id % 4 <> 2""",
    "fx_case_docs": """
select _id, chunks, mtime, size, deleted from fx_local_docs
union all
select 'file:' || upper(substr(_id, 6)),
       case when doc_id % 3 = 0 then list_concat(chunks, ['chunk:s256:variant']) else chunks end,
       mtime, size, deleted
from fx_local_docs where doc_id % 19 = 5""",
    "fx_case_vc": """
select v._id, v.dev, v.n from fx_local_vc v
union all
select 'file:' || upper(path), 'dev-a', 1 + doc_id % 3 + case when doc_id % 4 = 1 then 1 else 0 end
from fx_files where doc_id % 19 = 5
union all
select 'file:' || upper(path), 'dev-c', 1 from fx_files where doc_id % 19 = 5 and doc_id % 4 = 3""",
    "fx_manifest": "select path from fx_files where doc_id % 5 <> 0",
    "fx_stored_docs": """
select *, 1 + doc_id % 4 as _version, doc_id + 1 as _local_seq from fx_local_docs""",
    "fx_unpushed": """
select _id as id, case when doc_id % 4 = 1 then 'divergent' else 'race-stale' end as reason,
       cast(doc_id % 5 as integer) as attempts, 1000 + doc_id as added_at
from fx_file_docs where doc_id % 9 in (2, 4)
union all
select 'file:gone/doc' || doc_id || '.md', 'race-stale', 1, 5 from fx_files where doc_id % 50 = 7""",
    "fx_pending_apply": """
select _id as id, case when doc_id % 10 = 3 then 'pending-deletion' else 'missing-chunks' end as reason,
       cast(doc_id % 4 as integer) as attempts, 1000 + doc_id as added_at
from fx_file_docs where doc_id % 8 in (1, 3)
union all
select 'file:gone/doc' || doc_id || '.md', 'missing-chunks', 2, 5 from fx_files where doc_id % 50 = 7""",
    "fx_pending_conflict": """
select _id as id, case doc_id % 3 when 0 then 'edit-vs-edit' when 1 then 'pull-delete-vs-edit'
                  else 'local-delete-vs-remote-edit' end as kind, 1000 + doc_id as added_at
from fx_file_docs where doc_id % 4 = 1""",
    "fx_feed": """
select _id as id, doc_id * 2 + 2 as seq, doc_id % 10 = 4 as deleted, doc_id
from fx_remote_docs
union all
select _id, doc_id * 2 + 1, false, doc_id from fx_remote_docs where doc_id % 3 = 0
union all
select chunks[1], doc_id * 2 + 10000000, doc_id % 4 = 0, doc_id from fx_remote_docs where doc_id % 2 = 0""",
    "fx_changes": """
select 'file:notes/u' || user_id || '.md' as id, event_id + 1 as seq,
       event_type = 'error' as deleted from events""",
    "fx_vault_events": """
select epoch_ms(ts) as ts_ms, 'notes/u' || user_id || '.md' as path,
       case event_type when 'error' then 'delete' else 'modify' end as kind from events""",
    "fx_logs": """
select event_id as id, epoch_ms(ts) as timestamp,
       case event_type when 'error' then 'error' when 'click' then 'info'
                       when 'view' then 'debug' else 'warn' end as level,
       event_type || ' ' || props as message
from events""",
    "fx_errors": """
select event_id as id,
       cast(case event_id % 9 when 0 then 401 when 1 then 403 when 2 then 404 when 3 then 500
                              when 4 then 503 when 5 then 409 end as integer) as status,
       case event_id % 7 when 0 then 'The operation was aborted' when 1 then 'Request timed out'
            when 2 then 'Failed to fetch' when 3 then 'getaddrinfo ENOTFOUND host'
            when 4 then 'connection TIMEOUT' when 5 then 'aborted' else event_type || props end as message
from events""",
    "fx_versions": """
select 'chat/' || conv_id || '.md' as file_path, turn as timestamp, text as content,
       case role when 'user' then 'local' else 'sync' end as source
from conversations""",
    "fx_revisions": """
select conv_id * 1000 + turn as id, 'chat/' || conv_id || '.md' as file_path,
       1700000000000 + turn * 60000 as timestamp, length(text) as added, turn as removed,
       role <> 'user' as conflict,
       case when turn = 0 then (case when conv_id % 7 = 3 then conv_id * 1000 + 1 end)
            when turn % 3 = 2 then conv_id * 1000 + turn - 2
            else conv_id * 1000 + turn - 1 end as parent_id,
       text as content
from conversations""",
    "fx_heads": """
select file_path, max_by(content, id) as content,
       case when max(id) % 5 = 4 then null else max(id) end as head_record_id
from fx_revisions group by file_path""",
    "fx_config_paths": """
select '.config/' || case p_partkey % 9
         when 0 then 'app.json' when 1 then 'workspace.json'
         when 2 then 'core-plugins.json' when 3 then 'graph.json'
         when 4 then 'plugins/p' || p_partkey || '/data.json'
         when 5 then 'plugins/p' || p_partkey || '/main.js'
         when 6 then 'themes/t' || p_partkey || '/theme.css'
         when 7 then 'snippets/s' || p_partkey || '.css'
         else 'misc/x' || p_partkey || '.bin' end as path,
       min(p_partkey) as k, bool_or(p_partkey % 3 <> 0) as on_local,
       bool_or(p_partkey % 4 <> 0) as on_remote,
       min(p_name) || ' ' || max(p_name) || ' ' || count(*) || ' ' || min(p_partkey) as body
from part group by 1""",
    "fx_config_vc": """
select 'config:' || path as _id, 'l' as side, 'dev-a' as dev,
       1 + k % 3 + case when k % 5 = 1 then 1 else 0 end as n from fx_config_paths where on_local
union all select 'config:' || path, 'l', 'dev-b', 1 from fx_config_paths where on_local and k % 2 = 1
union all select 'config:' || path, 'r', 'dev-a', 1 + k % 3 from fx_config_paths where on_remote
union all select 'config:' || path, 'r', 'dev-b', k % 2 + case when k % 4 = 1 then 1 else 0 end
from fx_config_paths where on_remote and k % 2 = 1""",
    "fx_config_docs": """
select 'config:' || path as _id, k, side,
       ['chunk:s256:' || sha256(encode(case when side = 'r' and k % 6 = 1 then body || '!' else body end))] as chunks,
       octet_length(encode(body)) + case when side = 'r' and k % 6 = 1 then 1 else 0 end as size,
       case when side = 'r' then k % 10 = 4 else k % 10 = 3 end as deleted
from fx_config_paths, (values ('l'), ('r')) s(side)
where (side = 'l' and on_local) or (side = 'r' and on_remote)""",
    "fx_config_overrides": """
select path, k % 2 = 0 as allowed from fx_config_paths where k % 10 in (1, 2)""",
    "fx_plugins": """
select '.config/plugins/p' || p_partkey as plugin_dir,
       case when p_partkey % 5 = 0 then null else p_partkey % 7 = 0 end as desktop_only
from part where p_partkey % 9 in (4, 5) and p_partkey % 4 <> 1""",
    # derived facts used by several checks
    "fx_rel": """
select _id, case when gt and lt then 'concurrent' when gt then 'dominates'
                 when lt then 'dominated' else 'equal' end as rel
from (select coalesce(a._id, b._id) as _id,
             bool_or(coalesce(a.n, 0) > coalesce(b.n, 0)) as gt,
             bool_or(coalesce(a.n, 0) < coalesce(b.n, 0)) as lt
      from (select * from fx_local_vc where _id in (select _id from fx_local_docs)) a
      full join (select * from fx_remote_vc where _id in (select _id from fx_remote_docs)) b
        on a._id = b._id and a.dev = b.dev group by 1)
where _id in (select _id from fx_local_docs) and _id in (select _id from fx_remote_docs)""",
    "fx_local_text": """
select _id, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc from fx_local_vc group by 1""",
    "fx_remote_text": """
select _id, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc from fx_remote_vc group by 1""",
    "fx_merged_vc": """
select _id, dev, max(n) as n from (select * from fx_local_vc union all select * from fx_remote_vc)
group by 1, 2""",
    "fx_merged_text": """
select _id, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc from fx_merged_vc group by 1""",
    "fx_refs": """
select distinct c as id from (select unnest(chunks) as c from fx_file_docs where not deleted)""",
    "fx_presence": """
select coalesce(l._id, r._id, f.id) as id, l._id is not null as l, r._id is not null as r,
       f.id is not null as f
from fx_local_chunks l full join fx_remote_chunks r on l._id = r._id
full join fx_refs f on f.id = coalesce(l._id, r._id)""",
    "fx_disk_prints": """
select l.path, l.path_key, l.mtime, l.size, l.own, coalesce(hit, false) as reused,
       case when hit then b.chunks else l.own end as chunks
from (select d.path, lower(nfc_normalize(d.path)) as path_key, d.mtime, octet_length(d.content) as size,
             list('chunk:s256:' || sha256(d.content[t.i * 1024 + 1 : t.i * 1024 + 1024]) order by t.i) as own
      from fx_disk d, lateral (select unnest(range(0, greatest(1, (octet_length(d.content) + 1023) // 1024))) as i) t
      group by all) l
left join (select *, true as hit from fx_baselines where not deleted and chunks is not null) b
  on b.path_key = l.path_key and b.mtime = l.mtime and b.size = l.size""",
    "fx_case_prints": """
select l.path, l.path_key, l.mtime, l.size, l.own, coalesce(hit, false) as reused,
       case when hit then b.chunks else l.own end as chunks
from (select d.path, lower(nfc_normalize(d.path)) as path_key, d.mtime, octet_length(d.content) as size,
             list('chunk:s256:' || sha256(d.content[t.i * 1024 + 1 : t.i * 1024 + 1024]) order by t.i) as own
      from fx_case_disk d, lateral (select unnest(range(0, greatest(1, (octet_length(d.content) + 1023) // 1024))) as i) t
      group by all) l
left join (select *, true as hit from fx_baselines where not deleted and chunks is not null) b
  on b.path_key = l.path_key and b.mtime = l.mtime and b.size = l.size""",
    "fx_base_rel": """
select _id, path_key, case when gt and lt then 'concurrent' when gt then 'dominates' when lt then 'dominated' else 'equal' end as rel
from (select d._id, lower(substr(d._id, 6)) as path_key,
             bool_or(coalesce(b.n, 0) > coalesce(v.n, 0)) as gt, bool_or(coalesce(b.n, 0) < coalesce(v.n, 0)) as lt
      from fx_case_docs d cross join (values ('dev-a'), ('dev-b'), ('dev-c')) devs(dev)
      left join fx_case_vc v on v._id = d._id and v.dev = devs.dev
      left join (select * from fx_baselines_vc where path_key in (select path_key from fx_baselines)) b
        on b.path_key = lower(substr(d._id, 6)) and b.dev = devs.dev
      group by 1, 2)""",
    "fx_local_bump": """
select _id, '{' || string_agg(dev || ':' || n, ',' order by dev) || '}' as vc
from (select _id, dev, sum(n)::bigint as n
      from (select * from fx_local_vc union all select distinct _id, 'dev-a', 1 from fx_local_vc) group by 1, 2) group by 1""",
    "fx_case_edits": """
select p.path, case when coalesce(b.deleted, false) then true
    when b.path_key is null or b.chunks is null or b.size is null then
      case when d._id is not null and not d.deleted then p.size <> d.size or p.own <> d.chunks else true end
    else p.size <> b.size or p.own <> b.chunks end as unpushed
from fx_case_prints p left join fx_baselines b using (path_key) left join fx_case_docs d on d._id = 'file:' || p.path""",
    "fx_crowded": """
select path_key from (select path_key, 1 as f, 0 as d from fx_case_prints union all
                      select lower(substr(_id, 6)), 0, 1 from fx_case_docs where not deleted)
group by 1 having sum(f) > 1 or sum(d) > 1""",
    "fx_collisions": """
select v.path_key, v.path,
    case when not (backed and any_doc and one_list and not edited) then 'collision-unresolved'
         when v.path = c.canonical and has_file then 'keep' when v.path = c.canonical then 'collision-restore'
         when has_file then 'dedup-file' else 'tombstone' end as action,
    case when backed and any_doc and one_list and not edited then 'resolved' else 'unresolved' end as state,
    coalesce(backed and any_doc and one_list and not edited and v.path = c.canonical, false) as is_canonical
from (select path_key, path, bool_or(f) as has_file, bool_or(d) as has_doc
      from (select path_key, path, true as f, false as d from fx_case_prints union all
            select lower(substr(_id, 6)), substr(_id, 6), false, true from fx_case_docs where not deleted)
      where path_key in (select path_key from fx_crowded) group by 1, 2) v
join (select x.path_key, bool_and(not is_file or d._id is not null) as backed, bool_or(coalesce(e.unpushed and is_file, false)) as edited
      from (select path_key, path, true as is_file from fx_case_prints union all
            select lower(substr(_id, 6)), substr(_id, 6), false from fx_case_docs where not deleted) x
      left join (select * from fx_case_docs where not deleted) d on d._id = 'file:' || x.path
      left join fx_case_edits e on e.path = x.path
      group by 1) k using (path_key)
left join (select lower(substr(_id, 6)) as path_key, count(*) > 0 as any_doc, count(distinct array_to_string(chunks, ',')) = 1 as one_list,
             min(substr(_id, 6)) as smallest from fx_case_docs where not deleted group by 1) o using (path_key)
left join (select path_key, coalesce(min(p) filter (not short), min(p)) as canonical
           from (select g.path_key, g._id, substr(g._id, 6) as p, bool_or(coalesce(v.n, 0) < t.n) as short
                 from (select _id, lower(substr(_id, 6)) as path_key from fx_case_docs where not deleted) g
                 join (select lower(substr(_id, 6)) as path_key, dev, max(n) as n from fx_case_vc
                       where _id in (select _id from fx_case_docs where not deleted) group by 1, 2) t on t.path_key = g.path_key
                 left join fx_case_vc v on v._id = g._id and v.dev = t.dev group by 1, 2) group by 1) c using (path_key)""",
    "fx_occupants": """
select k.path_key, p.path as fpath, p.mtime as fmtime, p.size as fsize, p.chunks as fchunks,
       d._id as doc, d.chunks as dchunks, d.size as dsize, coalesce(d.deleted, false) as dead,
       b.path_key is not null as based, coalesce(b.deleted, false) as bdead, b.chunks is null or b.size is null as legacy,
       r.rel as brel, coalesce(not b.deleted and b.size = p.size and b.chunks = p.chunks, false) as explained,
       coalesce(not d.deleted and d.size = p.size and d.chunks = p.chunks, false) as same
from (select path_key from fx_case_prints union select lower(substr(_id, 6)) from fx_case_docs) k
left join fx_case_prints p using (path_key)
left join (select * from fx_case_docs qualify row_number() over (partition by lower(substr(_id, 6)) order by deleted, _id) = 1) d
  on lower(substr(d._id, 6)) = k.path_key
left join fx_baselines b using (path_key) left join fx_base_rel r on r._id = d._id
where k.path_key not in (select path_key from fx_crowded)""",
    "fx_occupant_rel": """
select *, case when fpath is null or doc is null then null
    when same and brel = 'equal' then 'identical' when same then 'vclock-only-drift'
    when brel = 'concurrent' then 'true-divergent'
    when brel = 'dominated' and dead then case when based and not bdead and not legacy and explained then 'remote-edit' else 'true-divergent' end
    when brel = 'dominated' and not based then 'remote-edit' when brel = 'dominated' and legacy then 'legacy-skip'
    when brel = 'dominated' then case when explained then 'remote-edit' else 'true-divergent' end
    else 'local-edit' end as relation
from fx_occupants""",
    "fx_single_plan": """
select o.path_key, coalesce(fpath, substr(doc, 6)) as path, doc, dead, relation,
    case when fpath is null and (doc is null or dead) then case when doc is not null and based and not bdead then 'baseline-align' end
         when fpath is not null and doc is null then 'push'
         when fpath is not null and dead then case relation when 'local-edit' then 'push' when 'remote-edit' then 'delete-apply'
              when 'true-divergent' then 'conflict-recreate' else 'error' end
         when fpath is null and based and bdead then case brel when 'dominated' then 'restore' when 'concurrent' then 'conflict-delete' else 'delete' end
         when fpath is null and based then case brel when 'dominated' then 'conflict-delete' else 'delete' end
         when fpath is null and (l.dev in ('dev-a', 'dev-old') or o.path_key in (select lower(path) from fx_manifest)) then 'delete'
         when fpath is null then 'restore'
         else case relation when 'identical' then 'align' when 'vclock-only-drift' then 'vclock-adopt' when 'local-edit' then 'push'
              when 'true-divergent' then 'conflict-edit' else 'pull' end end as action
from fx_occupant_rel o
left join (select _id, dev from fx_case_vc qualify row_number() over (partition by _id order by n desc, dev) = 1) l on l._id = o.doc""",
    "fx_plan": """
select path_key, path, action, relation,
    case when action in ('align', 'vclock-adopt') then 'in-sync'
         when action = 'push' and doc is not null and not dead then 'local-win'
         when action in ('push', 'conflict-recreate') then 'pushed' when action in ('pull', 'conflict-edit') then 'remote-win'
         when action = 'restore' then 'restored' when action in ('delete', 'delete-apply', 'conflict-delete') then 'deleted' end as bucket, doc
from fx_single_plan where action is not null
union all select path_key, path, action, null, null, case when action = 'collision-restore' then 'file:' || path end
from fx_collisions where action <> 'keep'
union all select path_key, path, 'collision-resolved', null, 'collision-resolved', null from fx_collisions where is_canonical and state = 'resolved'""",
    "fx_renames": """
select o.path as old_path, d.path as path from fx_disk d join fx_files o on o.doc_id = d.doc_id + 1 where d.doc_id % 5 = 1
union all select f.path, d.path from fx_disk d join fx_files f using (doc_id) where d.doc_id % 17 = 0 and d.doc_id % 5 <> 1
union all select 'old/' || d.path, d.path from fx_disk d where d.doc_id % 5 = 2 and d.doc_id % 17 <> 0
union all select d.path, d.path from fx_disk d where d.doc_id % 5 = 3 and d.doc_id % 17 <> 0
union all select path, 'nowhere/' || path from fx_files where doc_id % 50 = 7""",
}


def sql_with_views(body: str) -> str:
    """``body`` preceded by the views it needs, in dependency order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(body)
    if not order:
        return body
    views = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in order)
    lead = body.strip()
    if lead.lower().startswith("with recursive "):
        return f"with recursive {views},\n{lead[15:]}"
    if lead.lower().startswith("with "):
        return f"with {views},\n{lead[5:]}"
    return f"with {views}\n{lead}"


def _clock(*entries: tuple[str, Column, Column | None]) -> Column:
    """Clock from (device, counter, condition) entries."""
    parts = [
        F.struct(F.lit(dev).alias("key"), n.cast("bigint").alias("value"), (cond if cond is not None else F.lit(True)).alias("on"))
        for dev, n, cond in entries
    ]
    kept = F.filter(F.array(*parts), lambda e: e["on"])
    return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["key"], e["value"]))).cast(CLOCK)


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


class Tables:
    """Lazily built DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def source(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- files and chunks ---------------------------------------------------
    @cached_property
    def files(self) -> DataFrame:
        d = F.col("doc_id")
        return self.source("documents").select(
            "doc_id",
            F.concat(
                F.lit("notes/"), "lang", F.lit("/"), "source", F.lit("/doc"), d.cast("string"), F.lit(".md")
            ).alias("path"),
            F.encode("text", "UTF-8").alias("content"),
            F.octet_length("text").cast("bigint").alias("size"),
            (F.lit(1700000000000) + d * 1000).alias("mtime"),
        )

    @cached_property
    def file_docs(self) -> DataFrame:
        return self.files.select(
            F.concat(F.lit("file:"), "path").alias("_id"),
            "doc_id",
            contentf.chunk_list("content", CHUNK_BYTES).alias("chunks"),
            "mtime",
            F.col("mtime").alias("ctime"),
            "size",
            (F.col("doc_id") % 10 == 3).alias("deleted"),
        ).withColumn("schema_version", F.lit(2))

    @cached_property
    def pieces(self) -> DataFrame:
        from tidemark.operators.chunking import split_into_chunks

        return split_into_chunks(self.files.select("doc_id", "path", "content"), CHUNK_BYTES)

    @cached_property
    def chunks(self) -> DataFrame:
        # Lengths beside the ids, so that presence and sizes never open a body.
        sized = self.pieces.select("_id", "content", F.octet_length("content").cast("bigint").alias("bytes"))
        return sized.dropDuplicates(["_id"])

    def _without(self, *digits: str) -> DataFrame:
        return self.chunks.filter(~F.substring("_id", 12, 1).isin(*digits))

    @cached_property
    def local_chunks(self) -> DataFrame:
        return self._without("0", "a")

    @cached_property
    def remote_chunks(self) -> DataFrame:
        return self._without("1", "a")

    @cached_property
    def _local_clock(self) -> Column:
        d = F.col("doc_id")
        return _clock(
            ("dev-a", F.lit(1) + d % 3 + _flag(d % 5 == 1), None), ("dev-b", F.lit(1), d % 2 == 1)
        )

    @cached_property
    def _remote_clock(self) -> Column:
        d = F.col("doc_id")
        return _clock(
            ("dev-a", F.lit(1) + d % 3, None),
            ("dev-b", d % 2 + _flag(d % 4 == 1), (d % 2 == 1) | (d % 4 == 1)),
        )

    @cached_property
    def local_docs(self) -> DataFrame:
        return self.file_docs.filter(F.col("doc_id") % 7 != 0).withColumn("vclock", self._local_clock)

    @cached_property
    def remote_docs(self) -> DataFrame:
        d = F.col("doc_id")
        edited = d % 6 == 1
        return (
            self.file_docs.filter(d % 11 != 0)
            .withColumn(
                "chunks",
                F.when(edited, F.concat("chunks", F.array(F.lit("chunk:s256:edited")))).otherwise(
                    F.col("chunks")
                ),
            )
            .withColumn("size", F.col("size") + _flag(edited))
            .withColumn("deleted", (d % 10).isin(3, 4))
            .withColumn("vclock", self._remote_clock)
        )

    @cached_property
    def stored_docs(self) -> DataFrame:
        d = F.col("doc_id")
        return self.local_docs.withColumn("_version", 1 + d % 4).withColumn("_local_seq", d + 1)

    @cached_property
    def baselines(self) -> DataFrame:
        from tidemark.operators.paths import with_path_key

        d = F.col("doc_id")
        legacy = d % 4 == 0
        keyed = with_path_key(
            self.file_docs.filter(d % 3 != 2).withColumn("path", F.substring("_id", 6, 1 << 30))
        )
        return keyed.select(
            "path_key",
            _clock(("dev-a", F.when(d % 2 == 1, F.lit(1)).otherwise(1 + d % 3), None)).alias("vclock"),
            F.when(~legacy, F.col("chunks")).alias("chunks"),
            F.when(~legacy, F.col("size")).alias("size"),
            F.when(d % 4 == 2, F.col("mtime")).alias("mtime"),
            "deleted",
        )

    @cached_property
    def _disk(self) -> DataFrame:
        d = F.col("doc_id")
        body = F.when(d % 9 == 0, F.concat("content", F.encode(F.lit("!"), "UTF-8"))).otherwise(
            F.col("content")
        )
        return self.files.filter((d % 10 != 3) & (d % 13 != 0)).select(
            "doc_id",
            F.when(d % 17 == 0, F.upper("path")).otherwise(F.col("path")).alias("path"),
            (F.col("mtime") + _flag(d % 8 == 0)).cast("bigint").alias("mtime"),
            F.col("mtime").alias("ctime"),
            F.octet_length(body).cast("bigint").alias("size"),
            body.alias("content"),
        )

    @cached_property
    def disk(self) -> DataFrame:
        return self._disk.drop("doc_id")

    @cached_property
    def case_disk(self) -> DataFrame:
        d = F.col("doc_id")
        extra = self._disk.filter((d % 19 == 5) & (d % 17 != 0) & (d % 4 != 2)).withColumn(
            "path", F.upper("path")
        )
        return self._disk.unionByName(extra).drop("doc_id")

    @cached_property
    def case_docs(self) -> DataFrame:
        d = F.col("doc_id")
        extra = (
            self.local_docs.filter(d % 19 == 5)
            .withColumn("_id", F.concat(F.lit("file:"), F.upper(F.substring("_id", 6, 1 << 30))))
            .withColumn(
                "chunks",
                F.when(d % 3 == 0, F.concat("chunks", F.array(F.lit("chunk:s256:variant")))).otherwise(
                    F.col("chunks")
                ),
            )
            .withColumn(
                "vclock",
                _clock(
                    ("dev-a", 1 + d % 3 + _flag(d % 4 == 1), None), ("dev-c", F.lit(1), d % 4 == 3)
                ),
            )
        )
        return self.local_docs.unionByName(extra).drop("doc_id")

    @cached_property
    def manifest(self) -> DataFrame:
        return self.files.filter(F.col("doc_id") % 5 != 0).select("path")

    # --- retry sets and feeds -------------------------------------------------
    def _gone(self) -> tuple[DataFrame, Column]:
        lost = self.files.filter(F.col("doc_id") % 50 == 7)
        return lost, F.concat(F.lit("file:gone/doc"), F.col("doc_id").cast("string"), F.lit(".md"))

    @cached_property
    def unpushed(self) -> DataFrame:
        d = F.col("doc_id")
        lost, gone_id = self._gone()
        return self.file_docs.filter((d % 9).isin(2, 4)).select(
            F.col("_id").alias("id"),
            F.when(d % 4 == 1, "divergent").otherwise("race-stale").alias("reason"),
            (d % 5).cast("int").alias("attempts"),
            (1000 + d).alias("added_at"),
        ).unionByName(
            lost.select(
                gone_id.alias("id"), F.lit("race-stale").alias("reason"),
                F.lit(1).alias("attempts"), F.lit(5).cast("bigint").alias("added_at"),
            )
        )

    @cached_property
    def pending_apply(self) -> DataFrame:
        d = F.col("doc_id")
        lost, gone_id = self._gone()
        return self.file_docs.filter((d % 8).isin(1, 3)).select(
            F.col("_id").alias("id"),
            F.when(d % 10 == 3, "pending-deletion").otherwise("missing-chunks").alias("reason"),
            (d % 4).cast("int").alias("attempts"),
            (1000 + d).alias("added_at"),
        ).unionByName(
            lost.select(
                gone_id.alias("id"), F.lit("missing-chunks").alias("reason"),
                F.lit(2).alias("attempts"), F.lit(5).cast("bigint").alias("added_at"),
            )
        )

    @cached_property
    def pending_conflict(self) -> DataFrame:
        d = F.col("doc_id")
        return self.file_docs.filter(d % 4 == 1).select(
            F.col("_id").alias("id"),
            F.when(d % 3 == 0, "edit-vs-edit").when(d % 3 == 1, "pull-delete-vs-edit")
            .otherwise("local-delete-vs-remote-edit").alias("kind"),
            (1000 + d).alias("added_at"),
        )

    @cached_property
    def feed(self) -> DataFrame:
        """Change feed of the remote store: files (some twice) and chunk rows."""
        d = F.col("doc_id")
        body = F.struct("_id", "schema_version", "chunks", "mtime", "ctime", "size", "deleted", "vclock")
        rows = self.remote_docs
        deleted = d % 10 == 4
        latest = rows.select(
            F.col("_id").alias("id"), (d * 2 + 2).alias("seq"), deleted.alias("deleted"),
            F.when(~deleted, body).alias("doc"),
        )
        older = rows.filter(d % 3 == 0).select(
            F.col("_id").alias("id"), (d * 2 + 1).alias("seq"), F.lit(False).alias("deleted"), body.alias("doc")
        )
        chunk_rows = rows.filter(d % 2 == 0).select(
            F.element_at("chunks", 1).alias("id"), (d * 2 + 10000000).alias("seq"),
            (d % 4 == 0).alias("deleted"), F.when(d % 4 != 0, body).alias("doc"),
        )
        return latest.unionByName(older).unionByName(chunk_rows)

    @cached_property
    def changes(self) -> DataFrame:
        return self.source("events").select(
            F.concat(F.lit("file:notes/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("id"),
            (F.col("event_id") + 1).alias("seq"),
            (F.col("event_type") == "error").alias("deleted"),
        )

    @staticmethod
    def as_vault_events(events: DataFrame) -> DataFrame:
        return events.select(
            F.col("ts").cast("timestamp").alias("ts"),
            F.concat(F.lit("notes/u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
            F.lit(None).cast("string").alias("old_path"),
            F.when(F.col("event_type") == "error", "delete").otherwise("modify").alias("kind"),
        )

    @cached_property
    def vault_events(self) -> DataFrame:
        return self.as_vault_events(self.source("events"))

    # --- logs and history ------------------------------------------------------
    @staticmethod
    def as_logs(events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        return events.select(
            F.col("event_id").alias("id"),
            # Nearest millisecond, as the SQL twin rounds.
            F.floor((F.unix_micros(F.col("ts").cast("timestamp")) + 500) / 1000).alias("timestamp"),
            F.when(kind == "error", "error").when(kind == "click", "info").when(kind == "view", "debug")
            .otherwise("warn").alias("level"),
            F.concat("event_type", F.lit(" "), "props").alias("message"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self.as_logs(self.source("events"))

    @cached_property
    def errors(self) -> DataFrame:
        e = F.col("event_id")
        codes = F.array(*[F.lit(v) for v in (401, 403, 404, 500, 503, 409)])
        return self.source("events").select(
            e.alias("id"),
            F.when(e % 9 < 6, F.try_element_at(codes, (e % 9 + 1).cast("int"))).alias("status"),
            F.when(e % 7 == 0, "The operation was aborted").when(e % 7 == 1, "Request timed out")
            .when(e % 7 == 2, "Failed to fetch").when(e % 7 == 3, "getaddrinfo ENOTFOUND host")
            .when(e % 7 == 4, "connection TIMEOUT").when(e % 7 == 5, "aborted")
            .otherwise(F.concat("event_type", "props")).alias("message"),
        )

    @cached_property
    def versions(self) -> DataFrame:
        return self.source("conversations").select(
            F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("file_path"),
            F.col("turn").alias("timestamp"),
            F.col("text").alias("content"),
            F.when(F.col("role") == "user", "local").otherwise("sync").alias("source"),
        )

    @cached_property
    def revisions(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        base = c * 1000
        return self.source("conversations").select(
            (base + t).alias("id"),
            F.concat(F.lit("chat/"), c.cast("string"), F.lit(".md")).alias("file_path"),
            (F.lit(1700000000000) + t * 60000).alias("timestamp"),
            F.length("text").cast("bigint").alias("added"),
            t.alias("removed"),
            (F.col("role") != "user").alias("conflict"),
            F.when(t == 0, F.when(c % 7 == 3, base + 1))
            .when(t % 3 == 2, base + t - 2).otherwise(base + t - 1).alias("parent_id"),
            F.col("text").alias("content"),
        )

    @cached_property
    def heads(self) -> DataFrame:
        return self.revisions.groupBy("file_path").agg(
            F.max_by("content", "id").alias("content"),
            F.when(F.max("id") % 5 != 4, F.max("id")).alias("head_record_id"),
        )

    # --- settings store ----------------------------------------------------------
    @cached_property
    def config_paths(self) -> DataFrame:
        p = F.col("p_partkey")
        name = p.cast("string")
        rest = (
            F.when(p % 9 == 0, "app.json").when(p % 9 == 1, "workspace.json")
            .when(p % 9 == 2, "core-plugins.json").when(p % 9 == 3, "graph.json")
            .when(p % 9 == 4, F.concat(F.lit("plugins/p"), name, F.lit("/data.json")))
            .when(p % 9 == 5, F.concat(F.lit("plugins/p"), name, F.lit("/main.js")))
            .when(p % 9 == 6, F.concat(F.lit("themes/t"), name, F.lit("/theme.css")))
            .when(p % 9 == 7, F.concat(F.lit("snippets/s"), name, F.lit(".css")))
            .otherwise(F.concat(F.lit("misc/x"), name, F.lit(".bin")))
        )
        return (
            self.source("part")
            .select(F.concat(F.lit(CONFIG_DIR + "/"), rest).alias("path"), "p_partkey", "p_name")
            .groupBy("path")
            .agg(
                F.min("p_partkey").alias("k"),
                F.bool_or(p % 3 != 0).alias("on_local"),
                F.bool_or(p % 4 != 0).alias("on_remote"),
                F.concat_ws(
                    " ", F.min("p_name"), F.max("p_name"), F.count("*").cast("string"),
                    F.min("p_partkey").cast("string"),
                ).alias("body"),
            )
        )

    def _config_docs(self, side: str) -> DataFrame:
        k = F.col("k")
        edited = (k % 6 == 1) if side == "r" else F.lit(False)
        body = F.encode(F.when(edited, F.concat("body", F.lit("!"))).otherwise(F.col("body")), "UTF-8")
        if side == "l":
            vc = _clock(("dev-a", 1 + k % 3 + _flag(k % 5 == 1), None), ("dev-b", F.lit(1), k % 2 == 1))
        else:
            vc = _clock(("dev-a", 1 + k % 3, None), ("dev-b", k % 2 + _flag(k % 4 == 1), k % 2 == 1))
        return self.config_paths.filter("on_local" if side == "l" else "on_remote").select(
            F.concat(F.lit("config:"), "path").alias("_id"),
            "k",
            F.lit(3).alias("schema_version"),
            F.array(contentf.chunk_id(body)).alias("chunks"),
            F.lit(1700000000000).alias("mtime"),
            F.octet_length(body).cast("bigint").alias("size"),
            (k % 10 == (4 if side == "r" else 3)).alias("deleted"),
            vc.alias("vclock"),
            body.alias("content"),
        )

    @cached_property
    def config_local(self) -> DataFrame:
        return self._config_docs("l").drop("content")

    @cached_property
    def config_remote(self) -> DataFrame:
        return self._config_docs("r").drop("content")

    @cached_property
    def config_remote_chunks(self) -> DataFrame:
        return (
            self._config_docs("r")
            .select(F.element_at("chunks", 1).alias("_id"), "content")
            .dropDuplicates(["_id"])
            .filter(~F.substring("_id", 12, 1).isin("0"))
        )

    @cached_property
    def config_disk(self) -> DataFrame:
        body = F.encode("body", "UTF-8")
        return self.config_paths.select(
            "path", F.lit(1700000000000).alias("mtime"),
            F.octet_length(body).cast("bigint").alias("size"), body.alias("content"),
        )

    @cached_property
    def config_overrides(self) -> DataFrame:
        return self.config_paths.filter((F.col("k") % 10).isin(1, 2)).select(
            "path", (F.col("k") % 2 == 0).alias("allowed")
        )

    @cached_property
    def plugins(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.source("part").filter((p % 9).isin(4, 5) & (p % 4 != 1)).select(
            F.concat(F.lit(CONFIG_DIR + "/plugins/p"), p.cast("string")).alias("plugin_dir"),
            F.when(p % 5 != 0, p % 7 == 0).alias("desktop_only"),
        )
