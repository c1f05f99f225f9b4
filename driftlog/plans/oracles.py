"""DuckDB SQL with the results of the registered queries."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

DAY = 86_400_000
QUIET, CAP = 21_600_000, 86_400_000

# ------------------------------------------------------------ shared parts

MS = "(epoch_us(ts) // 1000)"
K = "cast(json_extract_string(props, '$.k') as integer)"

NOTES = f"""notes as (
  select 'u' || user_id as session_id, event_id as notif_id, {MS} as t_ms,
    case event_type when 'signup' then 'create' when 'click' then 'modify' when 'purchase' then 'rename'
      when 'error' then 'remove' end as operation,
    case {K} % 10 when 9 then '.git/' when 8 then 'tmp/x.tmp/' else 'src/' end
      || 'd' || ({K} % 7) || '/f' || {K} || '.txt' as path,
    value > 199 as need_rescan
  from events),
touches as (select * from notes where operation is not null and path not like '.git/%' and path not like '%.tmp/%'),
overs as (select session_id, notif_id, t_ms, 'notify:rescan' as source, 1::bigint as raw_events from notes where need_rescan),
moments as (select session_id, t_ms from touches union select session_id, t_ms from overs)"""

# Windows without commands: a recursive walk from start to start.
WINDOWS = f"""{NOTES},
gaps as (select session_id, t_ms,
    coalesce(t_ms - lag(t_ms) over (partition by session_id order by t_ms) >= {QUIET}, false) as cut from moments),
starts(session_id, start) as (
  select session_id, min(t_ms) from moments group by session_id
  union all
  select s.session_id, min(g.t_ms) from starts s join gaps g on g.session_id = s.session_id
   and g.t_ms > s.start and (g.cut or g.t_ms >= s.start + {CAP}) group by s.session_id),
assigned as (select m.session_id, m.t_ms, max(s.start) as window_start from moments m
  join starts s on s.session_id = m.session_id and s.start <= m.t_ms group by 1, 2),
bounds as (select session_id, window_start, max(t_ms) as last_ms, count(*) as instants,
    least(window_start + {CAP}, max(t_ms) + {QUIET}) as closed_ms from assigned group by 1, 2)"""

WINDOW_PATHS = f"""{WINDOWS},
wtouches as (select t.*, a.window_start from touches t join assigned a using (session_id, t_ms)),
wpaths as (select session_id, window_start, path, count(*) as raw_events,
    min(t_ms) as first_ms, arg_min(notif_id, (t_ms, notif_id)) as first_notif, max(t_ms) as last_ms,
    list(distinct operation) as ops
  from wtouches group by 1, 2, 3)"""


def op_list(column: str) -> str:
    return (
        f"array_to_string(list_filter(['create','modify','remove','rename','other'], lambda x: list_contains({column}, x)), ',')"
    )


TALK = """talk as (
  select conv_id, turn, role, sha256(text) as sha, length(text) as n,
    coalesce(lag(sha256(text)) over (partition by conv_id order by turn), sha256(text)) as prev_sha
  from conversations),
typed as (
  select *, 'c' || conv_id as session_id, turn as seq,
    case when turn = 0 then 'session_start' when role = 'assistant' then 'snapshot' when turn % 4 = 0 then 'mark'
      when n % 5 = 0 then 'flush' when n % 7 = 0 then 'overflow' when n % 11 = 0 then 'session_end'
      else 'touched_paths' end as type,
    '2024-01-01T00:' || lpad(turn::varchar, 2, '0') || ':00.' || lpad((n % 1000)::varchar, 3, '0')
      || case when n % 17 = 0 then '' when n % 2 = 0 then 'Z' else '+01:00' end as ts
  from talk),
tl as (
  select *,
    case when type = 'session_start' then 'op:' || sha end as baseline_op,
    case when type = 'session_start' then 't:' || substr(sha, 1, 40) end as baseline_tree,
    case when type = 'snapshot' then 'op:' || sha end as snap_op,
    case when type = 'snapshot' then 'op:' || prev_sha end as parent_op,
    case when type = 'snapshot' then case when n % 19 = 0 then 'x:' else 'c:' end || substr(sha, 1, 40) end as commit,
    case when type = 'snapshot' then 't:' || substr(sha, 1, 40) end as snap_tree,
    case when type in ('mark', 'flush', 'session_end') then 'op:' || prev_sha end as ref_op,
    case when type in ('session_start', 'snapshot') then 'op:' || sha
      when type in ('mark', 'flush', 'session_end') then 'op:' || prev_sha end as op,
    case when type in ('session_start', 'snapshot') then 't:' || substr(sha, 1, 40) end as tree,
    'src/' || substr(sha, 1, 2) || '.txt' as path1, 'src/' || substr(sha, 3, 2) || '.txt' as path2,
    case n % 3 when 0 then 'added' when 1 then 'modified' else 'removed' end as kind,
    case when n % 3 < 2 then 'b:' || substr(sha, 1, 40) end as blob,
    case when n % 3 > 0 then 'b:' || substr(prev_sha, 1, case when n % 13 = 0 then 39 else 40 end) end as prev_blob
  from typed)"""

LINES = """lines as (
  select 'c' || conv_id || '.ndjson' as file, conv_id, turn,
    row_number() over (partition by conv_id order by turn) as line_no,
    case when conv_id % 6 = 4 and turn = 1 then 'not-json' when conv_id % 6 = 5 and turn = 1 then '  '
    else '{"v":' || case when conv_id % 6 = 3 and turn = 1 then '1' else '0' end || ',"seq":'
      || (turn - case when conv_id % 6 = 5 and turn > 1 then 1 else 0 end) || ',"session_id":"'
      || case when conv_id % 6 = 2 and turn = 2 then 'other' else 'c' || conv_id end
      || '","ts":"x","type":"mark","data":{"label":"' || role || '","meta":{"n":' || turn || '},"ref_op":"op:'
      || sha256(text) || '"},"future":true}' end as value
  from conversations where not (conv_id % 6 = 1 and turn = 2)),
numbered as (
  select *, sum(case when trim(value) <> '' then 1 else 0 end) over (partition by file order by line_no)
      - case when trim(value) <> '' then 1 else 0 end as rec_no,
    case when json_valid(value) then value end as js
  from lines),
recs as (
  select file, conv_id, line_no, rec_no::bigint as rec_no, value, js is not null as parsed,
    cast(json_extract_string(js, '$.v') as bigint) as v, cast(json_extract_string(js, '$.seq') as bigint) as seq,
    json_extract_string(js, '$.session_id') as sid
  from numbered where trim(value) <> ''),
judged as (
  select r.*, first_value(sid) over (partition by file order by line_no) as sid0 from recs r)"""

MANIFESTS = """marks as (
  select 'c' || conv_id as session_id, conv_id, case when conv_id % 5 = 3 then 2 else 1 end as session_format,
    0 as schema_version, max(turn) as last_seq,
    case when conv_id % 5 = 2 then null when conv_id % 5 = 1 then max(turn) - 1 else max(turn) end as durable_seq,
    case when conv_id % 11 = 0 then '../x.ndjson' end as events_object, conv_id % 13 <> 0 as parsed
  from conversations group by conv_id)"""


def verdicts(error: str, line: str, expected: str, actual: str, place: str = "1") -> str:
    return f"""failed as (
  select file, line_no, {place} as place, {line} as error_line, {error} as error_class,
    {expected} as expected, {actual} as actual from judged),
firsts as (
  select * from (select *, row_number() over (partition by file order by place, line_no) as rn
    from failed where error_class is not null) where rn = 1)"""


VERDICT_ROWS = """select f.file, e.file is null as ok, e.error_class, e.error_line as line_no, e.expected, e.actual
from (select distinct file from lines) f left join firsts e using (file)"""

TIMELINE_ERROR = """case when not parsed then 'json' when v <> 0 then 'version' when seq <> rec_no then 'sequence'
  when sid <> sid0 then 'session' end"""

TIMELINE_VERDICTS = verdicts(
    TIMELINE_ERROR,
    "line_no",
    f"case {TIMELINE_ERROR} when 'sequence' then rec_no::varchar when 'session' then sid0 end",
    f"case {TIMELINE_ERROR} when 'version' then v::varchar when 'sequence' then seq::varchar when 'session' then sid end",
)

TREES = """before as (
  select 's' || (doc_id % 8) as session_id, lang || '/' || source || '/' || doc_id || '.txt' as path,
    sha256(text) as blob, doc_id % 5 = 0 as executable, n_chars as bytes from documents),
after as (
  select 's' || (doc_id % 8) as session_id, case when doc_id % 25 = 3 then 'moved/' else '' end
      || lang || '/' || source || '/' || doc_id || '.txt' as path,
    case when doc_id % 25 = 1 then sha256(text || 'x') else sha256(text) end as blob,
    case when doc_id % 25 = 2 then not (doc_id % 5 = 0) else doc_id % 5 = 0 end as executable, n_chars as bytes
  from documents where doc_id % 25 <> 0
  union all
  select 's' || (item_id % 8), 'added/' || item_id || '.txt', sha256(text), false, length(text) from benchmark),
differing as (
  select session_id, path, b.blob as old_blob, a.blob as new_blob, a.bytes as new_bytes,
    case when b.blob is null then 'added' when a.blob is null then 'removed'
      when a.blob = b.blob then 'mode_changed' else 'modified' end as kind
  from before b full join after a using (session_id, path)
  where (a.blob, a.executable) is distinct from (b.blob, b.executable))"""

GENS = """gens as (
  select 's' || (doc_id % 8) as session_id, g as gen, lang || '/' || source || '/' || doc_id || '.txt' as path,
    sha256(text || '#' || ((doc_id % 5 + g) // 5)) as blob, n_chars as bytes, text || '#' || ((doc_id % 5 + g) // 5) as body
  from documents, range(5) t(g) where (doc_id + g) % 7 <> 0)"""

SYNC = f"""{TREES},
named as (
  select 'dest' as side, * from before union all select 'source', * from after),
files as (
  select side, session_id,
    case when bytes % 3 = 0 then 'store/git/objects/' || substr(blob, 1, 2) || '/' || substr(blob, 3, 38)
      when bytes % 3 = 1 then 'op_store/views/' || blob else path end as path,
    max(bytes) as bytes, max(blob) as digest from named group by all),
typed_files as (select *, case when bytes % 97 = 0 then 'symlink' else 'file' end as file_type,
    path like 'store/git/objects/%' or path like 'op_store/views/%' as immutable from files),
plan as (
  select session_id, path,
    case when s.file_type = 'symlink' then 'error_symlink'
      when s.path is null then case when d.immutable then 'keep' else 'remove' end
      when d.path is null then case when s.immutable then 'link' else 'copy' end
      when s.immutable or (s.bytes = d.bytes and s.digest = d.digest) then 'reuse' else 'replace' end as action,
    s.bytes as source_bytes
  from (select * from typed_files where side = 'source') s
  full join (select * from typed_files where side = 'dest') d using (session_id, path)),
sync as (select session_id, path, action,
    case when action in ('copy', 'replace') then source_bytes else 0 end as bytes_copied from plan)"""


def _q(name: str, sql: str, ctes: str = "", recursive: bool = False) -> None:
    head = f"with {'recursive ' if recursive else ''}{ctes}\n" if ctes else ""
    ORACLES[name] = head + sql


# --------------------------------------------------------- sources, sinks

_q("timeline_scan", "select file, line_no, rec_no::bigint as rec_no, value from numbered", LINES)
_q("timeline_scan_typed", """select file, line_no, sid as session_id, seq, 'mark' as type,
  json_extract_string(value, '$.data.label') as label,
  cast(json_extract_string(value, '$.data.meta.n') as bigint) as meta_n,
  json_extract_string(value, '$.data.ref_op') as ref_op from recs where parsed""", LINES)
_q("file_endings", "select distinct file, true as complete from lines", LINES)
_q("manifest_scan", """select session_id as folder, parsed, case when parsed then session_id end as session_id,
  case when parsed then session_format end as session_format, case when parsed then last_seq end as last_seq,
  case when parsed then durable_seq end as durable_seq, case when parsed then events_object end as events_object
from marks""", MANIFESTS)
_NOTIF = f"""select 'u' || user_id as session_id, event_id as notif_id, {MS} as t_ms,
  case event_type when 'signup' then 'create' when 'click' then 'modify' when 'purchase' then 'modify'
    when 'error' then 'remove' else 'access' end as kind,
  case when event_type = 'purchase' then 'any' end as rename_mode,
  '/work/' || case {K} % 10 when 9 then '.git/' when 8 then 'tmp/x.tmp/' else 'src/' end
    || 'd' || ({K} % 7) || '/f' || {K} || '.txt' as paths,
  value > 199 as need_rescan, cast(null as varchar) as error from events"""
_q("notification_scan", _NOTIF)
_q("notification_stream", _NOTIF)
_q("tree_scan", """select lang || '/' || source || '/' || doc_id || '.txt' as path, strlen(text)::bigint as bytes,
  sha256(text) as blob from documents where doc_id % 9 <> 0""")
_q("timeline_export", """select session_id, seq, seq as line_index, type, coalesce(snap_op, baseline_op) as op from tl""", TALK)
_q("event_objects", """select session_id, durable_seq, 'events/' || lpad(durable_seq::varchar, 20, '0') || '.ndjson' as events_object
from marks where durable_seq is not null and durable_seq % 3 <> 0""", MANIFESTS)
_FEED = "select session_id, seq, type, op from tl"
_q("durable_publication", _FEED, TALK)
_q("live_feed", _FEED, TALK)
_q("publication_conflicts", """select session_id, seq, type, op, 'batch' as reason from sent where rival is not null and digest > rival
union all select session_id, seq, type, op, case seq when 0 then 'accepted' else 'staged' end from sent where other and digest < rival
union all select session_id, seq, 'late', op, 'accepted' from tl where seq = 1""", f"""{TALK},
events as (select session_id, seq, type, op, false as other from tl
  union all select session_id, seq, type, 'other:' || session_id, true from tl where seq in (0, 2)),
hashed as (select *, sha256('{{"session_id":"' || session_id || '","seq":' || seq || ',"type":"' || type || '"'
  || coalesce(',"op":"' || op || '"', '') || '}}') as digest from events),
sent as (select h.*, r.digest as rival from hashed h left join hashed r
  on r.session_id = h.session_id and r.seq = h.seq and r.other <> h.other)""")
_q("timeline_tail", "select value, coalesce(case when parsed then seq end, -1) as seq from recs", LINES)

ATTEMPTS = """tries as (
  select 'c' || (o_custkey % 50) as session_id, o_orderkey as attempt_id,
    case o_orderkey % 20 when 0 then 409 when 1 then 429 when 2 then 503 when 3 then 404 else 200 end as status,
    case when o_orderkey % 40 = 1 then 2 end as retry_after from orders)"""
_q("cursor_store", """select session_id, 'sink' || (attempt_id % 3) as sink, max(attempt_id) as delivered_seq
from tries where status = 200 group by 1, 2""", ATTEMPTS)

# ------------------------------------------------- validation and lookups

_q("validate_timeline", VERDICT_ROWS, f"{LINES}, {TIMELINE_VERDICTS}")
_SPOOL = """case when not parsed then 'json' when seq <> rec_no then 'sequence' when sid <> spool then 'session'
  when v <> 0 then 'version' end"""
_q("validate_spool", VERDICT_ROWS.replace("firsts e", "firsts2 e"), LINES.replace(
    "judged as (", """raw as (select file, conv_id, line_no, line_no - 1 as rec_no,
    json_valid(value) as parsed, case when json_valid(value) then value end as js,
    'c' || case when conv_id % 10 = 0 then conv_id + 1 else conv_id end as spool from lines),
judged as (select file, conv_id, line_no, rec_no, parsed, spool,
    cast(json_extract_string(js, '$.v') as bigint) as v, cast(json_extract_string(js, '$.seq') as bigint) as seq,
    json_extract_string(js, '$.session_id') as sid from raw),
unused as (""") + ", " + verdicts(
    _SPOOL, "rec_no + 1",
    f"case {_SPOOL} when 'sequence' then rec_no::varchar when 'session' then spool when 'version' then '0' end",
    f"case {_SPOOL} when 'version' then v::varchar when 'sequence' then seq::varchar when 'session' then sid end",
) + """, firsts2 as (
  select file, error_class, error_line, expected, actual from firsts where regexp_extract(file, 'c(\\d+)', 1)::bigint % 7 <> 6
  union all select distinct file, 'incomplete', null, null, null from lines where conv_id % 7 = 6)""")
_VIEW = """case when not parsed then 'json' when seq <> rec_no then 'sequence' when sid <> sid0 then 'session' end"""
_q("validate_records", VERDICT_ROWS, LINES + ", " + verdicts(
    _VIEW, "rec_no + 1",
    f"case {_VIEW} when 'sequence' then rec_no::varchar when 'session' then sid0 end",
    f"case {_VIEW} when 'sequence' then seq::varchar when 'session' then sid end",
    "case when not parsed then 0 else 1 end",
))
_q("validate_for_summary", """select m.file, e.file is null as ok, e.error_class, e.error_line as line_no, e.expected, e.actual
from sums m left join firsts2 e using (file)""", f"{LINES}, {MANIFESTS}, " + verdicts(
    _VIEW, "line_no",
    f"case {_VIEW} when 'sequence' then rec_no::varchar when 'session' then sid0 end",
    f"case {_VIEW} when 'sequence' then seq::varchar when 'session' then sid end",
) + """,
sums as (select session_id || '.ndjson' as file, case when last_seq = 5 then 'else' else session_id end as want, last_seq from marks),
streams as (select file, max(rec_no) as last_rec, max(sid0) as sid from judged group by file),
late as (select m.file, case when sid <> want then 'manifest_session' when last_rec <> last_seq then 'durable' end as error_class,
    null::bigint as error_line, case when sid <> want then want else last_seq::varchar end as expected,
    case when sid <> want then sid else last_rec::varchar end as actual from sums m join streams using (file)),
firsts2 as (select file, error_class, error_line, expected, actual from firsts
  union all select * from late where error_class is not null and file not in (select file from firsts))""")
_q("compatible_manifests", "select session_id, session_format from marks where session_format = 1 and schema_version = 0", MANIFESTS)
_q("open_sessions", """select session_id, verdict, case when verdict = 'beyond_watermark' then coalesce(end_seq, 0) end as requested_seq,
  durable_seq
from (
  select m.session_id, case when last_seq = 6 then null else durable_seq end as durable_seq, end_seq,
    case when last_seq = 6 then 'missing_manifest' when not m.parsed then 'invalid_manifest'
      when session_format <> 1 then 'incompatible' when durable_seq is null then 'not_durable'
      when events_object like '%..%' then 'unsafe_object'
      when e.error_class is not null then 'timeline_' || e.error_class
      when end_seq is distinct from durable_seq then 'beyond_watermark' else 'open' end as verdict
  from marks m left join firsts e on e.file = m.session_id || '.ndjson'
  left join (select file, max(seq) as end_seq from recs group by 1) s on s.file = m.session_id || '.ndjson')""",
   f"{LINES}, {MANIFESTS}, {TIMELINE_VERDICTS}")
_q("durable_events", """select tl.session_id, tl.seq, type, durable_seq from tl join marks using (session_id) where tl.seq <= durable_seq""",
   f"{TALK}, {MANIFESTS}")
_q("event_lookup", """select a.session_id, a.seq,
  case when durable_seq is null then 'not_durable' when a.seq > durable_seq or t.seq is null then 'beyond_watermark' else 'found' end as outcome,
  case when a.seq <= durable_seq then t.type end as type
from (select session_id, seq + 1 as seq from tl) a join marks m using (session_id)
left join tl t on t.session_id = a.session_id and t.seq = a.seq""", f"{TALK}, {MANIFESTS}")
_q("timeline_index", "select session_id, seq, ts as timestamp, type as kind, op, tree from tl", TALK)
_OPS = """, known as (
  select * from (select session_id, seq, op, parent_op, commit, tree,
    row_number() over (partition by session_id, op order by seq) as rn from tl where type in ('session_start', 'snapshot'))
  where rn = 1)"""
_q("inspect_operation", """select session_id, op, k.seq, k.parent_op, k.commit, k.tree,
  case when k.seq is null then 'unknown_operation' else 'found' end as outcome
from (select distinct session_id, case when seq % 5 = 3 then op || '0' else op end as op from tl where op is not null)
left join known k using (session_id, op)""", TALK + _OPS)
_q("engine_index", """select session_id, seq, op, parent_op, commit, tree from tl
where type in ('session_start', 'snapshot') and seq between 1 and 4""", TALK)
_q("engine_inspection", """select session_id, op, k.seq, k.parent_op, k.commit, k.tree,
  case when k.seq is null then 'unknown_operation' else 'found' end as outcome
from (select distinct session_id, op from tl where op is not null and substr(session_id, 2)::bigint % 10 = 3)
left join known k using (session_id, op)""", TALK + _OPS)
_q("engine_tree_as_of", "select session_id, gen as at_seq, path, blob, bytes from gens where session_id in ('s2', 's5')", GENS)
_q("inspect_tree", """select session_id, asked_tree, case when f.op is null then 'unknown_tree' when k.seq is null then 'unknown_operation'
  else 'found' end as outcome, k.seq, f.op, k.parent_op, k.commit
from (select distinct session_id, case when seq % 5 = 3 then tree || '0' else tree end as asked_tree from tl where tree is not null) a
left join (select session_id, tree, arg_min(op, seq) as op from tl where tree is not null group by 1, 2) f
  on f.session_id = a.session_id and f.tree = a.asked_tree
left join known k on k.session_id = a.session_id and k.op = f.op""".replace("select session_id, asked_tree", "select a.session_id, asked_tree"), TALK + _OPS)
_TREE_OF = "trees_of as (select session_id, op, arg_max(tree, seq) as tree from tl where op is not null and tree is not null group by 1, 2)"
_q("op_to_tree", "select * from trees_of", f"{TALK}, {_TREE_OF}")
_OBSERVED = """observed as (select session_id, max(seq) as last_seq,
  arg_max(case when type <> 'mark' then op end, case when type <> 'mark' and op is not null then seq end) as last_op from tl group by 1)"""
_q("missing_durable_ops", """select session_id, op from (
  select session_id, case when last_seq % 2 = 1 then last_op || 'x' else last_op end as op from observed) o
where not exists (select 1 from trees_of t where t.session_id = o.session_id and t.op = o.op)""", f"{TALK}, {_TREE_OF}, {_OBSERVED}")
_q("observed_watermark", "select * from observed", f"{TALK}, {_OBSERVED}")
_q("latest_commit", "select session_id, arg_max(commit, seq) as commit from tl where type = 'snapshot' group by 1", TALK)
_q("session_status", """select o.session_id, last_seq + 1 as next_seq, snapshots, last_op, last_seq % 3 = 0 as pending_snapshot,
  coalesce(paused, false) as paused
from observed o join (select session_id, count(*) filter (type = 'snapshot') as snapshots from tl group by 1) c using (session_id)
left join (select session_id, arg_max(type, seq) = 'snapshot' as paused from tl
  where seq > 1 and type in ('snapshot', 'mark') group by 1) p using (session_id)""", f"{TALK}, {_OBSERVED}")
_q("describe_events", """select session_id, seq,
  case type when 'session_start' then 'Session started' when 'touched_paths' then '2 touched paths'
    when 'snapshot' then 'Snapshot · ' || (1 + n % 2) || ' changed path' || case when n % 2 = 0 then '' else 's' end
    when 'mark' then 'Mark · m' || n when 'overflow' then 'Watcher overflow' when 'flush' then 'Durable flush'
    else 'Session ended' end as title,
  case type when 'session_start' then session_id || ' · /work'
    when 'touched_paths' then (n % 50) || ' watcher events · ' || case when n % 2 = 0 then 'modify, create' else 'modify, rename, create' end
    when 'snapshot' then snap_op || ' → ' || snap_tree || case when n % 4 < 2 then ' · listing truncated' else '' end
    when 'mark' then ref_op when 'overflow' then 'notify:rescan · recovery: full_scan_snapshot'
    when 'flush' then ref_op else 'stop' end as detail,
  case type when 'touched_paths' then path1 || '|' || path2 when 'snapshot' then kind || ': ' || path1 end as paths
from tl""", TALK)
_q("listed_changes", """select session_id, seq, snap_op as op, path1 as path, kind, blob, prev_blob,
  case when n % 3 < 2 then n end as bytes from tl where type = 'snapshot'""", TALK)
_TOUCHED = """touched as (
  select session_id, seq, n, 1 as pos, path1 as path, ['modify'] as ops from tl where type = 'touched_paths'
  union all select session_id, seq, n, 2, path2, case when n % 2 = 0 then ['create', 'modify'] else ['rename', 'create'] end
  from tl where type = 'touched_paths')"""
_q("touched_paths", "select session_id, seq, path, array_to_string(ops, ',') as operations from touched", f"{TALK}, {_TOUCHED}")
_CONTINUITY = """arr as (
  select conv_id::varchar as stream_id, turn as arrival,
    case when conv_id % 11 = 5 and turn = 1 then -1 when conv_id % 3 = 1 and turn >= 2 then turn + 1 else turn end as seq,
    case when conv_id % 7 = 3 and turn >= 3 then 'other' else 'c' || conv_id end as sid,
    case when conv_id % 13 = 6 and turn = 2 then 'lagged by 3' when conv_id % 13 = 7 and turn = 2 then '' end as lag_text
  from conversations),
seen as (select *, lag(seq) over w as pseq, lag(sid) over w as psid from arr window w as (partition by stream_id order by arrival)),
noted as (select *,
    case when lag_text is not null then 'sse_overflow' when seq < 0 or sid <> psid or seq <> pseq + 1 then 'sequence_gap' end as notice,
    case when lag_text = '' then 'The live subscriber lagged and records may have been dropped.' when lag_text is not null then lag_text
      when seq < 0 then 'Invalid live event envelope' when sid <> psid then 'Session changed from ' || psid || ' to ' || sid
      when seq <> pseq + 1 then 'Expected sequence ' || (pseq + 1) || ', received ' || seq end as detail
  from seen),
broken as (select *, min(case when notice is not null then arrival end) over (partition by stream_id) as broken_at from noted)"""
_LIVE = """select stream_id, arrival, seq, case when broken_at is null or arrival < broken_at then 'accepted' when arrival = broken_at then 'notice' else 'blocked' end as outcome,
  case when arrival = broken_at then notice end as notice, case when arrival = broken_at then detail end as detail from broken"""
_q("live_continuity", _LIVE, _CONTINUITY)
_q("live_continuity_streamed", _LIVE, _CONTINUITY)
_q("schema_audit", """select session_id, seq, rule, detail from (
  select session_id, seq, unnest([
    case when type = 'snapshot' and parent_op is distinct from op_before then {'rule': 'snapshot_parent', 'detail': parent_op} end,
    case when type = 'mark' and ref_op is distinct from op_before then {'rule': 'mark_op', 'detail': ref_op} end,
    case when type = 'flush' and ref_op is distinct from op_before then {'rule': 'flush_op', 'detail': ref_op} end,
    case when type = 'session_end' and ref_op is distinct from op_before then {'rule': 'end_op', 'detail': ref_op} end,
    case when type = 'flush' and n % 2 = 1 then {'rule': 'flush_through', 'detail': (seq + 1)::varchar} end,
    case when type = 'session_end' and snaps <> 1 then {'rule': 'end_snapshots', 'detail': '1'} end,
    case when type = 'session_end' and next_type is distinct from 'flush' then {'rule': 'end_flush', 'detail': coalesce(next_type, '')} end,
    case when type = 'mark' and over_seq > coalesce(snap_seq, -1) then {'rule': 'overflow_snapshot', 'detail': over_seq::varchar} end,
    case when type = 'snapshot' and (n % 4 < 2) <> (n % 2 = 1) then {'rule': 'truncated', 'detail': '1'} end,
    case when type = 'touched_paths' and path1 >= path2 then {'rule': 'paths_sorted', 'detail': '2'} end,
    case when type = 'touched_paths' and n % 2 = 1 then {'rule': 'operations_sorted', 'detail': '2'} end
  ], recursive := false) as r
  from (select *, last_value(case when type in ('session_start', 'snapshot') then op end ignore nulls)
      over (partition by session_id order by seq rows between unbounded preceding and 1 preceding) as op_before,
    lead(type) over (partition by session_id order by seq) as next_type,
    sum(case when type = 'snapshot' then 1 else 0 end) over (partition by session_id order by seq) as snaps,
    max(case when type = 'overflow' then seq end) over (partition by session_id order by seq) as over_seq,
    max(case when type = 'snapshot' then seq end) over (partition by session_id order by seq) as snap_seq from tl)
  ) where r is not null""".replace("select session_id, seq, rule, detail from (", "select session_id, seq, r.rule as rule, r.detail as detail from (").replace(", recursive := false", ""), TALK)
_q("append_admission", """select journal, offer, case when stop is null or offer < stop then 'accepted' when offer = stop then refusal else 'not_reached' end as outcome,
  used::bigint as used, attempted, 600::bigint as limit_bytes
from (select *, min(case when refusal is not null then offer end) over (partition by journal) as stop from (
  select *, case when sid <> 'c' || conv_id then 'session' when version <> 0 then 'schema' when seq <> offer then 'sequence'
      when used + attempted > 600 then 'full' end as refusal
  from (select *, sum(attempted) over (partition by journal order by offer) - attempted as used from (
    select conv_id, 'j' || conv_id as journal, turn as offer, strlen(text) + 1 as attempted,
      case when conv_id % 9 = 4 and turn >= 3 then turn + 1 else turn end as seq,
      case when conv_id % 9 = 5 and turn = 2 then 'other' else 'c' || conv_id end as sid,
      case when conv_id % 9 = 6 and turn = 2 then 1 else 0 end as version from conversations))))""")

# -------------------------------------------------------- activity windows

_q("touch_operations", "select notif_id, operation from notes", NOTES)
_q("kept_notifications", "select session_id, notif_id, t_ms, operation, path as paths from touches", NOTES)
_q("kept_by_session", """select session_id, notif_id, t_ms, operation, path as paths from notes
where operation is not null and session_id <> 'u7' and path not like '.git/%' and case when substr(session_id, 2)::bigint % 2 = 0
  then not (path like '%/d2/%' or path like 'src/d1/%' or path like 'src/d3/%') else path not like '%.tmp/%' end""", NOTES)
_q("observed_counts", """select session_id, count(*) as raw_events, min(t_ms) as first_ms, max(t_ms) as last_ms
from touches group by 1""", NOTES)
_q("debounce_windows", "select * from bounds", WINDOWS, True)
# Commands: the pause that covers an instant holds deadlines back, closing
# commands start a new epoch.
_COMMANDED = f"""{NOTES},
cmds as (select 'u' || user_id as session_id, event_id as command_id, {MS} as t_ms,
    case (event_id // 25) % 5 when 0 then 'pause' when 1 then 'resume' when 2 then 'snap' when 3 then 'mark' else 'flush' end as command
  from events where event_id % 25 = 0),
switched as (select *, lag(command) over (partition by session_id order by t_ms, command_id) as before
  from cmds where command in ('pause', 'resume')),
pauses as (select session_id, t_ms as from_ms,
    (select min(r.t_ms) from switched r where r.session_id = s.session_id and r.command = 'resume' and r.t_ms >= s.t_ms) as to_ms
  from switched s where command = 'pause' and before is distinct from 'pause'),
placed as (select m.session_id, m.t_ms,
    (select count(*) from cmds c where c.session_id = m.session_id and c.command <> 'pause' and c.t_ms <= m.t_ms) as epoch,
    (select max(p.from_ms) from pauses p where p.session_id = m.session_id and p.from_ms <= m.t_ms
      and (p.to_ms is null or m.t_ms < p.to_ms)) as paused_from,
    (select min(c.t_ms) from cmds c where c.session_id = m.session_id and c.command <> 'pause' and c.t_ms > m.t_ms) as next_close,
    (select min(p.from_ms) from pauses p where p.session_id = m.session_id and p.from_ms > m.t_ms) as next_pause
  from moments m),
ready as (select *, coalesce(paused_from - 1, t_ms) as eff from placed),
gaps as (select *, coalesce(epoch <> lag(epoch) over w or lag(t_ms) over w + {QUIET} <= eff, false) as cut
  from ready window w as (partition by session_id order by t_ms)),
starts(session_id, start) as (
  select session_id, min(t_ms) from ready group by session_id
  union all
  select s.session_id, min(g.t_ms) from starts s join gaps g on g.session_id = s.session_id
   and g.t_ms > s.start and (g.cut or g.eff >= s.start + {CAP}) group by s.session_id),
assigned as (select m.session_id, m.t_ms, max(s.start) as window_start, any_value(next_close) as next_close,
    any_value(next_pause) as next_pause, any_value(paused_from) as paused_from from ready m
  join starts s on s.session_id = m.session_id and s.start <= m.t_ms group by 1, 2),
closing as (select session_id, window_start, max(t_ms) as last_ms, count(*) as instants,
    least(window_start + {CAP}, max(t_ms) + {QUIET}) as deadline, arg_max(next_close, t_ms) as next_close,
    first(next_close order by t_ms desc) as nc, first(next_pause order by t_ms desc) as np,
    first(paused_from order by t_ms desc) as pf from assigned group by 1, 2),
bounds as (select session_id, window_start, last_ms, instants,
    case when (pf is not null and deadline >= pf) or (pf is null and np <= deadline and (nc is null or np < nc)) then nc
      else least(deadline, nc) end as closed_ms from closing)"""
_q("debounce_with_commands", "select * from bounds", _COMMANDED, True)
_q("activity_streamed", f"""select b.session_id, b.window_start, b.last_ms, b.closed_ms, coalesce(w.raw, 0)::bigint as raw_events,
  coalesce(w.paths, '') as paths, concat_ws(',', case when w.n > 2 then 'recorder:audit_path_limit:2' end, o.sources) as sources
from bounds b left join (
  select session_id, window_start, sum(raw_events) as raw, count(*) as n,
    string_agg(path || '=' || replace({op_list('ops')}, ',', '+'), ',' order by rank) filter (rank <= 2) as paths
  from (select *, row_number() over (partition by session_id, window_start order by first_ms, first_notif, path) as rank from (
    select session_id, window_start, path, count(*) as raw_events, min(t_ms) as first_ms, arg_min(notif_id, (t_ms, notif_id)) as first_notif,
      list(distinct operation) as ops from touches join assigned using (session_id, t_ms) group by 1, 2, 3)) group by 1, 2) w
  using (session_id, window_start)
left join (
  select session_id, window_start, string_agg(case place when 2 then 'recorder:overflow_report_limit:2' else source end, ',' order by place) as sources
  from (select o.session_id, window_start, source, row_number() over (partition by o.session_id, window_start order by o.t_ms, notif_id) as place
    from overs o join assigned using (session_id, t_ms)) where place <= 2 group by 1, 2) o using (session_id, window_start)""", _COMMANDED, True)
_q("debounce_streamed", f"""select a.session_id, a.window_start, max(t_ms) as last_ms, least(a.window_start + {CAP}, max(t_ms) + {QUIET}) as closed_ms,
  sum(c)::bigint as raw_events
from assigned a join (select session_id, t_ms, count(*) as c from touches group by 1, 2) using (session_id, t_ms)
group by 1, 2""",
   WINDOWS.replace("union select session_id, t_ms from overs", ""), True)
_ACTIVITY = f"""select session_id, window_start, count(*) as paths, sum(raw_events)::bigint as raw_events,
  min(first_ms) as started_ms, max(last_ms) as ended_ms, {op_list('flatten(list(ops))')} as operations from wpaths group by 1, 2"""
_q("window_activity", _ACTIVITY, WINDOW_PATHS, True)
_q("window_path_operations", f"select session_id, window_start, path, {op_list('ops')} as operations from wpaths", WINDOW_PATHS, True)
_q("capped_window_paths", f"""select session_id, window_start, path, rank, {op_list('ops')} as operations from (
  select *, row_number() over (partition by session_id, window_start order by first_ms, first_notif, path) - 1 as rank from wpaths)
where rank < 2""", WINDOW_PATHS, True)
_q("path_limit_reports", """select session_id, window_start, 'recorder:audit_path_limit:2' as source, sum(raw_events)::bigint as raw_events
from wpaths group by 1, 2 having count(*) > 2""", WINDOW_PATHS, True)
_q("touched_path_events", f"""select session_id, window_start,
  string_agg(path || '=' || replace({op_list('ops')}, ',', '+'), ',' order by path) as paths from wpaths group by 1, 2""", WINDOW_PATHS, True)
_q("capped_overflows", f"""select session_id, window_start, notif_id, place,
  case when place = 1 then 'recorder:overflow_report_limit:2' else source end as source, raw_events
from (select *, t_ms // {5 * DAY} * {5 * DAY} as window_start,
    row_number() over (partition by session_id, t_ms // {5 * DAY} order by t_ms, notif_id) - 1 as place from overs) where place < 2""", NOTES)
_q("full_scan_windows", """select session_id, window_start, count(*) as overflows, sum(raw_events)::bigint as overflow_raw, true as full_scan
from overs join assigned using (session_id, t_ms) group by 1, 2""", WINDOWS, True)
_q("merged_windows", f"""select session_id, t_ms // {DAY} * {DAY} as window_start, count(distinct path) as paths, count(*) as raw_events,
  min(t_ms) as started_ms, {op_list('list(distinct operation)')} as operations from touches group by 1, 2""", NOTES)
_q("dirty_sessions", """select session_id, count(*) as dirty_windows, min(window_start) as dirty_since from bounds
where window_start % 10 >= 8 group by 1""", WINDOWS, True)
_ASSEMBLY = f"""{NOTES},
cmds as (select 'u' || user_id as session_id, event_id as command_id, {MS} as t_ms,
    case when event_id % 150 = 0 then 'flush' else 'mark' end as command from events where event_id % 50 = 0),
placed as (select m.*, (select count(*) from cmds c where c.session_id = m.session_id and c.t_ms <= m.t_ms) as epoch,
    (select min(c.t_ms) from cmds c where c.session_id = m.session_id and c.t_ms > m.t_ms) as next_close from moments m),
gaps as (select *, coalesce(epoch <> lag(epoch) over w or lag(t_ms) over w + {QUIET} <= t_ms, false) as cut
  from placed window w as (partition by session_id order by t_ms)),
starts(session_id, start) as (
  select session_id, min(t_ms) from placed group by session_id
  union all
  select s.session_id, min(g.t_ms) from starts s join gaps g on g.session_id = s.session_id
   and g.t_ms > s.start and (g.cut or g.t_ms >= s.start + {CAP}) group by s.session_id),
assigned as (select m.session_id, m.t_ms, max(s.start) as window_start, any_value(next_close) as next_close from placed m
  join starts s on s.session_id = m.session_id and s.start <= m.t_ms group by 1, 2),
bounds as (select session_id, window_start,
    least(window_start + {CAP}, max(t_ms) + {QUIET}, max(next_close)) as closed_ms from assigned group by 1, 2),
touched as (select session_id, window_start, count(*) as raw from touches join assigned using (session_id, t_ms) group by 1, 2),
reports as (select o.*, window_start, row_number() over (partition by o.session_id, window_start order by t_ms, notif_id) - 1 as place
  from overs o join assigned using (session_id, t_ms)),
emitted as (
  select session_id, 'session_start' as type, min(t_ms) as at_ms, -1 as phase, 0 as place, null as detail, null::bigint as raw_events
  from notes group by 1
  union all select r.session_id, 'overflow', closed_ms, 0, place, case when place = 63 then 'recorder:overflow_report_limit:64' else source end, raw_events
  from reports r join bounds using (session_id, window_start) where place < 64
  union all select session_id, 'touched_paths', closed_ms, 1, 0, null, raw from touched join bounds using (session_id, window_start)
  union all select session_id, 'snapshot', closed_ms, 2, 0, null, null from bounds
  union all select session_id, command, t_ms, 3, command_id, null, null from cmds)"""
_q("assembled_timeline", """select session_id, row_number() over w - 1 as seq, type, at_ms, detail, raw_events,
  (sum(case when type = 'snapshot' then 1 else 0 end) over w)::bigint as snapshots
from emitted window w as (partition by session_id order by type <> 'session_start', at_ms, phase, place, type)""", _ASSEMBLY, True)

# Typed bodies: paths capped at 3, changes at 2, states as of each capture.
# arg_max leaves out NULL arguments, so states are wrapped: a removal may be last.
_TYPED = f"""{_ASSEMBLY},
limited as (select *, row_number() over (partition by session_id, window_start order by first_ms, first_notif, path) as rank,
    sum(raw_events) over (partition by session_id, window_start) as all_raw, min(first_ms) over (partition by session_id, window_start) as began,
    count(*) over (partition by session_id, window_start) as all_paths from (
  select session_id, window_start, path, count(*) as raw_events, min(t_ms) as first_ms, arg_min(notif_id, (t_ms, notif_id)) as first_notif,
    list(distinct operation) as ops from touches join assigned using (session_id, t_ms) group by 1, 2, 3)),
bodies as (select session_id, closed_ms, began, string_agg(path || ':' || replace({op_list('ops')}, ',', '+'), ',' order by path) as paths
  from limited join bounds using (session_id, window_start) where rank <= 3 group by 1, 2, 3),
everything as (select * from emitted union all select distinct session_id, 'overflow', closed_ms, 0, -1, 'recorder:audit_path_limit:3', all_raw::bigint
  from limited join bounds using (session_id, window_start) where all_paths > 3),
numbered as (select *, row_number() over w - 1 as seq, (sum(case when type = 'snapshot' then 1 else 0 end) over w)::bigint as snapshots
  from everything window w as (partition by session_id order by type <> 'session_start', at_ms, phase, place, type)),
captures as (select session_id, snapshots as capture_no, at_ms from numbered where type in ('session_start', 'snapshot')),
seen as (select t.*, (select min(capture_no) from captures c where c.session_id = t.session_id and c.at_ms >= t.t_ms) as capture_no from touches t),
states as (select session_id, capture_no, path, arg_max({{'e': case when operation <> 'remove' then
    {{'blob': sha256((notif_id % 50)::varchar), 'x': notif_id % 3 = 0, 'bytes': notif_id % 1000}} end}}, (t_ms, notif_id)).e as after
  from (select * from seen where capture_no is not null) group by 1, 2, 3),
kinds as (select *, case when before is null and after is null then null when before is null then 'added' when after is null then 'removed'
    when before.blob <> after.blob then 'modified' when before.x <> after.x then 'mode_changed' end as kind
  from (select *, lag(after) over (partition by session_id, path order by capture_no) as before from states)),
changed as (select *, row_number() over (partition by session_id, capture_no order by path) as place from kinds where kind is not null and capture_no > 0),
listed as (select session_id, capture_no, count(*) as total, string_agg(concat_ws(':', path, kind, coalesce('b:' || after.blob, ''),
      coalesce('b:' || before.blob, ''), coalesce(after.bytes::varchar, '')), ',' order by path) filter (place <= 2) as changes,
    count(*) filter (kind = 'added') as added, count(*) filter (kind = 'removed') as removed, count(*) filter (kind = 'modified') as modified,
    count(*) filter (kind = 'mode_changed') as mode_changed from changed group by 1, 2)"""
_CLOCK = "strftime(make_timestamp({0} * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
_q("assembled_round_trip", f"""select n.session_id, n.seq, {_CLOCK.format('n.at_ms')} as ts, n.type, n.raw_events, n.detail as source,
  b.paths, case when n.type = 'touched_paths' then {_CLOCK.format('b.began')} end as started_at,
  case when n.type = 'snapshot' then coalesce(l.changes, '') end as changes,
  case when n.type = 'snapshot' then coalesce(l.added, 0) end as added, case when n.type = 'snapshot' then coalesce(l.removed, 0) end as removed,
  case when n.type = 'snapshot' then coalesce(l.modified, 0) end as modified,
  case when n.type = 'snapshot' then coalesce(l.mode_changed, 0) end as mode_changed,
  case when n.type = 'snapshot' then coalesce(l.total, 0) > 2 end as truncated,
  case when n.type = 'mark' then 'm' || n.place end as label, case when n.type = 'mark' then n.place end as meta_n,
  case when n.type = 'flush' then n.seq end as through_seq
from numbered n left join bodies b on n.type = 'touched_paths' and b.session_id = n.session_id and b.closed_ms = n.at_ms
left join listed l on n.type = 'snapshot' and l.session_id = n.session_id and l.capture_no = n.snapshots""", _TYPED, True)
_q("assembled_audit", "select session_id, 0::bigint as seq, '' as rule, '' as detail from notes where false", NOTES)

# ------------------------------------------------------------------ trees


def lanes(digest: str) -> str:
    # The low 60 bits of a 64-bit number read from 15 hex digits.
    return " || ':' || ".join(
        f"sum(('0x' || substr({digest}, {1 + 15 * lane}, 15))::bigint::hugeint)::varchar" for lane in range(4)
    )


_q("tree_ids", f"""select session_id, 't:' || sha256(count(*)::varchar || ':' || {lanes('d')}) as tree, count(*) as entries, sum(bytes)::bigint as bytes
from (select *, sha256(path || chr(0) || 'file' || chr(0) || blob || chr(0) || executable::varchar) as d from before) group by 1""", TREES)
_q("incremental_capture", """select 's' || (doc_id % 8) as session_id, source || '/' || doc_id as path, sha256(text) as blob,
  doc_id % 3 <> 0 and doc_id % 7 <> 0 as reused from documents""")
_q("new_blobs", """select blob, any_value(bytes) as bytes from (select sha256(text) as blob, n_chars as bytes from documents)
where blob not in (select sha256(text) from documents where doc_id % 10 = 0) group by 1""")
_q("classified_changes", "select session_id, path, kind from differing", TREES)
_q("tree_diff", """select session_id, path, kind, 'b:' || new_blob as blob, 'b:' || old_blob as prev_blob, null::varchar as "from",
  new_bytes as bytes from differing""", TREES)
_q("tree_diff_capped", """select session_id, rank, path, kind from (
  select *, row_number() over (partition by session_id order by path) - 1 as rank from differing) where rank < 20""", TREES)
_q("tree_diff_stats", """select session_id, count(*) filter (kind = 'added') as added, count(*) filter (kind = 'removed') as removed,
  count(*) filter (kind = 'modified') as modified, 0::bigint as renamed, count(*) filter (kind = 'mode_changed') as mode_changed,
  count(*) > 20 as truncated from differing group by 1""", TREES)
_q("running_tree_ids", f"""select session_id, gen, 't:' || sha256(count(*)::varchar || ':' || {lanes('d')}) as tree, count(*) as entries,
  sum(bytes)::bigint as bytes
from (select *, sha256(path || chr(0) || 'file' || chr(0) || blob || chr(0) || 'false') as d from gens) group by 1, 2""", GENS)
_q("operation_chain", """select session_id, seq, op, lag(op) over (partition by session_id order by seq) as parent_op, commit, tree
from (select session_id, gen as seq, 't:' || max(blob) as tree,
    'op:' || sha256(session_id || ':' || gen || ':t:' || max(blob)) as op,
    'c:' || substr(sha256('commit:' || session_id || ':' || gen || ':t:' || max(blob)), 1, 40) as commit
  from gens group by session_id, gen)""", GENS)
_HIST = f"""{GENS},
runs as (select *, gen - row_number() over (partition by session_id, path, blob order by gen) as island from gens),
hist as (select session_id, path, min(gen) as valid_from, case when max(gen) < 4 then max(gen) + 1 end as valid_to, blob
  from runs group by session_id, path, blob, island)"""
_q("path_history", "select * from hist", _HIST)
_q("tree_as_of", "select session_id, gen as at_seq, path, blob, bytes from gens", GENS)
_q("durable_prefix", """select session_id, case when conv_id % 5 = 0 then least(last, 2) else last end as durable_seq,
  case when conv_id % 5 = 0 then least(last, 2) else last end + 1 as events
from (select conv_id, 'c' || conv_id as session_id, max(turn)::bigint as last from conversations group by 1)""")
_q("materialized_files", """select session_id, 'op:' || gen as op, 'ok' as outcome, path, bytes, sha256(body) as content_id from gens
union all select distinct session_id, 'op:unknown', 'unknown_op', null, null, null from gens where gen = 0""", GENS)
_q("operation_diff", """select session_id, b::bigint as before_seq, a::bigint as after_seq, 'ok' as outcome, path, xb as before, yb as after from (
  select coalesce(x.session_id, y.session_id) as session_id, coalesce(x.b, y.b) as b, coalesce(x.a, y.a) as a,
    coalesce(x.path, y.path) as path, x.blob as xb, y.blob as yb
  from (select g.*, r.* from gens g join asked r on g.gen = r.b) x
  full join (select g.*, r.* from gens g join asked r on g.gen = r.a) y
  on x.session_id = y.session_id and x.path = y.path and x.a = y.a and x.b = y.b)
where xb is distinct from yb
union all select distinct session_id, 0, null::bigint, 'unknown_op', null, null, null from gens where gen = 0""",
   f"{GENS},\nasked(b, a) as (values (3, 1), (0, 2), (0, 3), (0, 4))")
_MARKED = f"""{GENS},
marked as (select *, case when session_id <> 's1' then 2 else -1 end as upto from gens)"""
_q("durable_files", """select session_id, 'op:' || gen as op, 'ok' as outcome, path, sha256(body) as content_id from marked where gen <= upto
union all select distinct session_id, 'op:' || gen, 'not_durable', null, null from marked where gen > upto""", _MARKED)
_q("durable_diff", """select session_id, b::bigint as before_seq, a::bigint as after_seq, 'ok' as outcome, path, xb as before, yb as after from (
  select coalesce(x.session_id, y.session_id) as session_id, coalesce(x.b, y.b) as b, coalesce(x.a, y.a) as a,
    coalesce(x.path, y.path) as path, x.blob as xb, y.blob as yb
  from (select g.*, r.* from marked g join asked r on g.gen = r.b where upto > 0) x
  full join (select g.*, r.* from marked g join asked r on g.gen = r.a where upto > 0) y
  on x.session_id = y.session_id and x.path = y.path and x.a = y.a and x.b = y.b)
where xb is distinct from yb
union all select distinct session_id, 1, gen::bigint, 'not_durable', null, null, null from marked where gen > upto""",
   f"{_MARKED},\nasked(b, a) as (values (1, 0), (1, 1), (1, 2))")
_COMPARED = f"""{TREES},
pairs as (select session_id, path, b.blob as want, a.blob as got,
    case when a.blob is null then 'missing' when b.blob is null then 'extra' when a.blob = b.blob then 'equal' else 'changed' end as outcome
  from before b full join after a using (session_id, path))"""
_q("tree_comparison", "select session_id, path, outcome, want, got from pairs where outcome <> 'equal'", _COMPARED)
_q("tree_comparison_totals", """select session_id, count(want) as expected_files, count(got) as actual_files,
  count(*) filter (outcome = 'equal') as equal, count(*) filter (outcome = 'missing') as missing, count(*) filter (outcome = 'extra') as extra,
  count(*) filter (outcome = 'changed') as changed, 0::bigint as symlink,
  count(*) filter (outcome = 'equal') = greatest(count(want), count(got)) as ok from pairs group by 1""", _COMPARED)
_q("store_growth", """select g.session_id, g.gen, entries, coalesce(new_blobs, 0) as new_blobs, coalesce(new_bytes, 0)::bigint as new_bytes
from (select session_id, gen, count(*) as entries from gens group by 1, 2) g
left join (select session_id, gen, count(*) as new_blobs, sum(bytes) as new_bytes from (
  select session_id, blob, min(gen) as gen, max(bytes) as bytes from gens group by 1, 2) group by 1, 2) f using (session_id, gen)
""".replace("select g.session_id, g.gen", "select session_id, gen"), GENS)
_q("identifier_audit", """select session_id, seq, 'prev_blob' as "column", prev_blob as value from tl
where type = 'snapshot' and length(prev_blob) = 41""", TALK)

# --------------------------------------------------------------- delivery

_SNAPS = f"""{TALK},
snaps as (select session_id, seq, commit, case when regexp_matches(regexp_replace(commit, '^c:', ''), '^([0-9A-Fa-f]{{40}}|[0-9A-Fa-f]{{64}})$')
    then lower(regexp_replace(commit, '^c:', '')) end as checkpoint from tl where type = 'snapshot'),
stored as (select session_id, case when seq % 3 = 0 then 'c:' || repeat('0', 40) else upper(substr(commit, 3, 40)) end as commit,
    case when seq % 3 = 0 then repeat('0', 40) else lower(substr(commit, 3, 40)) end as checkpoint from snaps)"""
_q("checkpoint_rejects", "select session_id, seq, commit from snaps where checkpoint is null", _SNAPS)
_q("checkpoint_keys", "select session_id, commit, checkpoint from stored", _SNAPS)
_q("dangling_snapshots", """select session_id, seq, commit, case when checkpoint is null then 'invalid' else 'missing' end as reason
from snaps s where checkpoint is null or not exists (
  select 1 from stored t where t.session_id = s.session_id and t.checkpoint = s.checkpoint)""", _SNAPS)
_q("orphan_checkpoints", """select session_id, checkpoint from stored t where not exists (
  select 1 from snaps s where t.session_id = s.session_id and t.checkpoint = s.checkpoint)""", _SNAPS)
_q("session_name_audit", r"""select session_id, ref_prefix, rtrim(ref_prefix, '/') || '/' || session_id as ref, rule from (
  select *, unnest(list_filter([
    case when not starts_with(ref_prefix, 'refs/') then 'prefix_under_refs' end,
    case when starts_with(ref_prefix, 'refs/heads') then 'prefix_not_heads' end,
    case when contains(ref_prefix, '//') then 'prefix_no_double_slash' end,
    case when ends_with(ref_prefix, '/') then 'prefix_no_trailing_slash' end,
    case when session_id = '' then 'session_not_empty' end,
    case when contains(session_id, '/') then 'session_no_slash' end,
    case when contains(session_id, '\') then 'session_no_backslash' end,
    case when contains(session_id, '..') then 'session_no_dots' end], lambda x: x is not null)) as rule
  from (select case conv_id % 9 when 1 then 'a/' when 2 then '..' when 3 then 'b\\' else '' end
      || case when conv_id % 9 = 4 then '' else 'c' || conv_id end as session_id,
    case conv_id % 7 when 1 then 'refs/heads/x' when 2 then 'refs//r' when 3 then 'refs/r/' when 4 then 'tags/r' else 'refs/recorder' end as ref_prefix
  from conversations where turn = 0))""")
_q("advance_decisions", """select session_id, wanted, tip, expected,
  case when refused then 'invalid_name' when wanted is null then 'invalid_commit' when tip = wanted then 'already_there'
    when tip is null then 'create' when tip = expected then 'advance' when expected is not null then 'conflict'
    else 'conflict_unexpected' end as outcome
from (select 'c' || conv_id as session_id, conv_id % 10 = 9 as refused, case when conv_id % 8 <> 7 then h end as wanted,
    case conv_id % 4 when 0 then null when 1 then h else reverse(h) end as tip,
    case conv_id % 3 when 0 then null when 1 then reverse(h) else substr(h || h, 5, 40) end as expected
  from (select conv_id, substr(sha256(text), 1, 40) as h from conversations where turn = 0))""")
_RESUME = f"""{MANIFESTS},
offered as (select 'c' || conv_id as session_id, turn as seq from conversations
  where not (conv_id % 5 = 1 and turn = 2) and not (conv_id % 5 = 2 and turn = 0) and not (conv_id % 5 = 3 and turn < 3)),
cursors as (select session_id, case last_seq % 3 when 0 then null when 1 then last_seq else 1 end as delivered from marks where last_seq <> 4),
steps as (select *, lag(seq) over (partition by session_id order by seq) as prev from offered),
gap as (select session_id, min(seq) as gap_next, arg_min(prev, seq) as gap_after from steps where seq <> prev + 1 group by 1),
spans as (select session_id, min(seq) as first_seq, max(seq) as last_seq from offered group by 1),
decided as (select s.*, delivered, gap_after, gap_next,
    case when gap_after is not null then 'not_contiguous' when delivered is null and first_seq <> 0 then 'not_from_start'
      when last_seq <= delivered then 'nothing_left' when first_seq > delivered + 1 then 'gap_after_delivered' else 'publish' end as outcome
  from spans s left join cursors using (session_id) left join gap using (session_id))"""
_q("resume_plan", """select session_id, outcome, case when outcome = 'publish' then greatest(first_seq, coalesce(delivered + 1, 0)) end as start_seq,
  last_seq, case when outcome = 'nothing_left' then delivered end as accepted_seq, gap_after, gap_next from decided""", _RESUME)
_q("events_to_publish", """select session_id, seq from offered join decided using (session_id)
where outcome = 'publish' and seq >= greatest(first_seq, coalesce(delivered + 1, 0))""", _RESUME)


def batch_sql(max_events: int, max_bytes: int) -> str:
    return f"""sized as (
  select source as session_id, row_number() over (partition by source order by doc_id) - 1 as seq, strlen(text) as len from documents),
sums as (select *, sum(len + 1) over (partition by session_id order by seq) as through from sized),
walk(session_id, first_seq, last_seq) as (
  select session_id, 0::bigint, greatest(0, coalesce(max(seq) filter (through + 1 <= {max_bytes} and seq < {max_events}), 0))
  from sums group by 1
  union all
  select w.session_id, w.last_seq + 1,
    coalesce(max(s.seq) filter (s.through - b.through + 1 <= {max_bytes} and s.seq <= w.last_seq + {max_events}), w.last_seq + 1)
  from walk w join sums b on b.session_id = w.session_id and b.seq = w.last_seq
  join sums s on s.session_id = w.session_id and s.seq > w.last_seq and s.seq <= w.last_seq + {max_events} group by 1, 2, w.last_seq),
bounds as (select w.session_id, first_seq, last_seq, last_seq - first_seq + 1 as events, sum(len + 1)::bigint + 1 as bytes
  from walk w join sums s on s.session_id = w.session_id and s.seq between first_seq and last_seq group by 1, 2, 3),
stops as (select *, min(case when bytes > {max_bytes} then first_seq end) over (partition by session_id) as stop,
    max(last_seq) over (partition by session_id) as finish from bounds),
batches as (select session_id, first_seq, last_seq, events, bytes,
    case when stop is null or first_seq < stop then 'ready' when first_seq = stop then 'oversize' else 'not_reached' end as outcome,
    (stop is null or first_seq < stop) and last_seq = finish as is_final from stops)"""


_q("delivery_batches", "select * from batches", batch_sql(8, 34_000), True)
_q("delivery_batches_oversize", "select * from batches", batch_sql(8, 16_384), True)
_q("response_classes", """select attempt_id, status, class, class = 'success' or (class = 'conflict' and attempt_id % 40 = 0) as delivered
from (select *, case when status between 200 and 299 then 'success' when status = 409 then 'conflict'
    when status = 429 or status between 500 and 599 then 'retry' else 'permanent' end as class from tries)""", ATTEMPTS)
_q("retry_schedule", """select request_id, attempt, class, wait_ms, coalesce(started, 0)::bigint as started_after_ms,
  class = 'retry' and attempt = 9 as gave_up, attempt > 9 as over_limit
from (select *, sum(wait_ms) over w as started, coalesce(bool_or(wait_ms is null) over w, false) as ended
  from (select request_id, attempt, class, case when class = 'retry' and attempt <= 8
      then coalesce(retry_after * 1000, least(50 * 2 ** (attempt - 1), 5000))::bigint end as wait_ms
    from (select o_orderkey // 11 as request_id, (o_orderkey % 11 + 1)::int as attempt,
        case when o_custkey % 10 < 9 then 'retry' else 'success' end as class, case when o_custkey % 40 = 1 then 2 end as retry_after from orders))
  window w as (partition by request_id order by attempt rows between unbounded preceding and 1 preceding))
where not ended or attempt > 9""")
_q("acknowledgement_checks", """select session_id, last_seq, durable_seq, accepted as accepted_through_seq, durable as durable_through_seq,
  case when accepted is null then 'missing' when accepted < last_seq then 'short' when durable_seq is not null and durable is null then 'no_durable'
    when durable < durable_seq then 'durable_short' else 'ok' end as verdict
from (select session_id, last_seq, case when is_final then last_seq end as durable_seq,
    case when last_seq % 7 <> 6 then last_seq - case when last_seq % 5 = 2 then 1 else 0 end end as accepted,
    case when last_seq % 7 <> 6 and is_final and last_seq % 3 <> 0 then last_seq - last_seq % 2 end as durable
  from batches where outcome = 'ready')""", batch_sql(8, 34_000), True)
_FLUSHES = f"""{TALK},
ends as (select session_id, max(seq) as fin, arg_max(commit, case when type = 'snapshot' then seq end) as commit from tl group by 1),
targets as (select *, fin as target_seq from ends union all select *, fin - 1 from ends),
picked as (select *, coalesce(case when target_seq % 4 = 0 then 'c:' || repeat('a', 40) end, commit) as c from targets),
keyed as (select *, case when regexp_matches(regexp_replace(c, '^c:', ''), '^[0-9a-f]{{40}}$') then regexp_replace(c, '^c:', '') end as checkpoint,
    case when fin <> 3 and target_seq = fin then case when fin = 5 then 4 else fin end end as accepted,
    case when target_seq = fin then case fin when 4 then 2 when 2 then fin end end as durable from picked),
gated as (select session_id, target_seq, checkpoint, case when fin <> target_seq then 'journal_end' when c is null then 'no_checkpoint'
    when checkpoint is null then 'invalid_checkpoint' when accepted is null then 'not_acknowledged' when accepted < target_seq then 'accepted_short'
    when durable < target_seq then 'durable_short' else 'durable' end as outcome from keyed)"""
_q("flush_gate", "select * from gated", _FLUSHES)
_q("durable_watermarks", """select session_id, max(target_seq) as durable_seq, arg_max(checkpoint, target_seq) as checkpoint from gated
where outcome = 'durable' group by 1""", _FLUSHES)
_q("sync_plan", "select session_id, path, action, bytes_copied from sync", SYNC)
_q("sync_totals", """select session_id, count(*) filter (action = 'link') as files_linked, count(*) filter (action = 'copy') as files_copied,
  count(*) filter (action = 'replace') as files_replaced, count(*) filter (action = 'reuse') as files_reused,
  count(*) filter (action = 'remove') as files_removed, sum(bytes_copied)::bigint as bytes_copied,
  count(*) filter (action = 'error_symlink') as errors from sync group by 1""", SYNC)
_q("store_composition", """select session_id, immutable, count(*) as objects, sum(bytes)::bigint as bytes from typed_files where side = 'dest' group by 1, 2""", SYNC)
_q("redacted_log", """select source as session_id, doc_id as message_id,
  replace(replace('token ' || token || ' failed: ' || text, lo, '***'), hi, '***') as message
from (select doc_id, source, text, sha256(text) as token, min(sha256(text)) over (partition by source) as lo,
  max(sha256(text)) over (partition by source) as hi from documents)""")
_LISTING = """listed as (
  select 'rec/dev/' || case page_id % 25 when 0 then '../' when 1 then 'a//' else '' end || 'p'
    || case when page_id % 25 = 6 then page_id - 1 else page_id end || case when page_id % 25 = 3 then '/' else '.html' end as key_name,
    case when page_id % 25 = 4 then -1 else length(html) end as size, page_id % 25 as fault from pages
  union all select 'other/x.html', 1, -1)"""
_q("listing_audit", """select key_name, rule, count(*) as objects from (
  select key_name, case fault when -1 then 'outside_prefix' when 0 then 'unsafe_segment' when 1 then 'unsafe_segment'
    when 3 then 'trailing_slash' when 4 then 'invalid_size' end as rule from listed) where rule is not null group by 1, 2
union all select key_name, 'duplicate', count(*) from listed group by 1 having count(*) > 1""", _LISTING)
_q("listing_totals", """select count(*) as object_count, sum(size)::bigint as object_bytes from listed
where fault not in (-1, 0, 1, 3, 4) and key_name in (select key_name from listed group by 1 having count(*) = 1)""", _LISTING)
_q("listing_sessions", """select 's' || (page_id % 7) as session_id, count(*) as objects, sum(length(html))::bigint as bytes from pages
where page_id % 10 <> 0 group by 1""")

_q("listing_session_outcomes", """select case when page_id % 10 <> 0 then 's' || (page_id % 7) end as session_id, count(*) as objects,
  sum(length(html))::bigint as bytes, case when page_id % 10 = 0 then 'unnamed' else 'ok' end as outcome, ' rec/ ' as prefix
from pages group by all
union all select null, 0, 0, 'bad_prefix', unnest(['rec//x', '..'])""".replace("group by all", "group by 1, 4"))

# ------------------------------------------------------------ measurement

_q("session_summary", """select c.session_id, events, snapshot_count, touched_path_windows, coalesce(paths, 0) as distinct_touched_paths,
  raw_watcher_events::bigint as raw_watcher_events, coalesce(ops, '') as observed_touch_operations, overflow_events
from (select session_id, count(*) as events, count(*) filter (type = 'snapshot') as snapshot_count,
    count(*) filter (type = 'touched_paths') as touched_path_windows, sum(case when type = 'touched_paths' then n % 50 else 0 end) as raw_watcher_events,
    count(*) filter (type = 'overflow') as overflow_events from tl group by 1) c
left join (select session_id, count(distinct path) as paths,
    array_to_string(list_sort(list_distinct(flatten(list(ops)))), ',') as ops from touched group by 1) t using (session_id)""",
   f"{TALK}, {_TOUCHED}")
_q("recording_overhead", """select run_id, off_seconds, on_seconds, on_seconds - off_seconds as overhead_seconds,
  (on_seconds - off_seconds) / nullif(off_seconds, 0) * 100 as overhead_percent
from (select o_orderpriority || '-' || (o_custkey % 10) as run_id,
    sum(o_totalprice::decimal(28, 6)) filter (o_orderkey % 2 = 1)::double / nullif(count(*) filter (o_orderkey % 2 = 1), 0) as off_seconds,
    sum(o_totalprice::decimal(28, 6)) filter (o_orderkey % 2 = 0)::double / nullif(count(*) filter (o_orderkey % 2 = 0), 0) as on_seconds
  from orders group by 1)""")
_q("paired_result_rules", """select o_orderkey as run_id, unnest(list_filter([
  case when o_orderkey % 50 = 0 then 'schema' end, case when o_orderkey % 31 = 0 then 'equal_mutations' end,
  case when o_orderkey % 37 = 0 then 'non_negative_on_workload_seconds' end,
  case when o_orderkey % 29 = 0 then 'non_negative_on_baseline_setup_seconds' end,
  case when o_totalprice < 1000 then 'non_negative_flush_time_to_durable_seconds' end,
  'non_negative_warm_index_op_to_tree_lookup_ns',
  case when o_orderkey % 41 = 0 then 'has_events' end, case when o_orderkey % 43 = 0 then 'baseline_excluded' end], lambda x: x is not null)) as rule
from orders""")
_q("matched_edits", """select e.session_id, sample_id, e.path, case when s.snap is not null then f.seq end as touched_seq, s.snap as snapshot_seq,
  case when s.snap is null then 'failed' else 'ok' end as status
from (select session_id, session_id || '-' || seq || '-' || path as sample_id, case when seq % 5 = 2 then path || '.gone' else path end as path from touched) e
left join (select session_id, path, min(seq) as seq from touched group by 1, 2) f on f.session_id = e.session_id and f.path = e.path
left join (select a.session_id, a.seq, min(b.seq) as snap from tl a join tl b on a.session_id = b.session_id and b.seq > a.seq and b.type = 'snapshot'
  group by 1, 2) s on s.session_id = f.session_id and s.seq = f.seq""", f"{TALK}, {_TOUCHED}")
_SAMPLES = """samples as (
  select 'u' || user_id as session_id, event_id as sample_id, case event_id % 3 when 0 then 'isolated' when 1 then 'burst' else 'continuous' end as mode,
    'f' || event_id as path, ns // 3600000000000 * 2 as touched_seq, ns // 3600000000000 * 2 + 1 as snapshot_seq,
    case when event_id % 20 = 0 then 'failed' else 'ok' end as status, ns, v, event_id * 1000 as m
  from (select *, epoch_us(ts) * 1000 as ns, cast(round(value * 100) as bigint) as v from events)),
metrics as (
  select * exclude (watcher), case when lead_sample = sample_id then watcher end as scoped, watcher from (
    select session_id, sample_id, mode, path, touched_seq, snapshot_seq, status, ns,
      case when status = 'ok' then v / 1000000.0::double end as watcher,
      case when status = 'ok' then (v * 6) / 1000000.0::double end as debounce,
      case when status = 'ok' then (v * 2) / 1000000.0::double end as delivery,
      case when status = 'ok' then (v * 9 - 500) / 1000000.0::double end as to_touched,
      case when status = 'ok' then (v * 4) / 1000000.0::double end as to_snapshot,
      case when status = 'ok' then (v * 2) / 1000000.0::double end as creation,
      case when status = 'ok' then (v * 13 - 500) / 1000000.0::double end as completion,
      case when status = 'ok' then (v * 13) / 1000000.0::double end as start_to,
      case when status = 'ok' then first_value(sample_id) over (partition by session_id, touched_seq, status order by ns, sample_id) end as lead_sample
    from samples))"""
_NAMES = """watcher_detection_wall_estimate debounce_projector_daemon_wall touched_sse_delivery_wall_estimate
edit_completion_to_touched_receipt_monotonic touched_receipt_to_snapshot_receipt_monotonic snapshot_creation_to_receipt_wall_estimate
edit_completion_to_snapshot_receipt_monotonic edit_start_to_snapshot_receipt_monotonic""".split()
_COLUMNS = "watcher debounce delivery to_touched to_snapshot creation completion start_to".split()
_q("edit_latencies", "select sample_id, " + ", ".join(f"{c} as {n}" for c, n in zip(_COLUMNS, _NAMES)) + " from metrics", _SAMPLES)
_q("scoped_estimates", f"""select sample_id, case when status = 'ok' then lead_sample = sample_id end as representative,
  scoped as {_NAMES[0]} from metrics""", _SAMPLES)


def percentile_sql(keys: str, source: str) -> str:
    at = []
    for p in (50, 95, 99):
        r = f"((n - 1) * {p} / 100.0::double)"
        lo = f"max(value) filter (rn = floor({r}))"
        hi = f"max(value) filter (rn = ceil({r}))"
        at.append(f"case when {lo} = {hi} then {lo} else {lo} + ({hi} - {lo}) * (any_value({r}) - floor(any_value({r}))) end as p{p}")
    return f"""select {keys}, any_value(n) as count, min(value) as min, {', '.join(at)}, max(value) as max
from (select *, row_number() over (partition by {keys} order by value) - 1 as rn, count(*) over (partition by {keys}) as n
  from {source} where value is not null) group by {keys}"""


_q("latency_statistics", percentile_sql("event_type", "events"))
_LONG = " union all ".join(
    f"select mode, '{n}' as metric, {c if c != 'watcher' else 'scoped'} as value from metrics where status = 'ok'" for c, n in zip(_COLUMNS, _NAMES)
)
_q("latency_summary", f"""select scope, metric, samples, successful, failed, count, min, p50, p95, p99, max
from ({percentile_sql('scope, metric', 'scoped_values')}) join counts using (scope)""", f"""{_SAMPLES},
long_values as ({_LONG}),
scoped_values as (select 'all' as scope, metric, value from long_values union all select mode, metric, value from long_values),
counts as (select scope, count(*) as samples, count(*) filter (status = 'ok') as successful, count(*) filter (status <> 'ok') as failed
  from (select 'all' as scope, status from metrics union all select mode, status from metrics) group by 1)""")
_q("latency_result_rules", """select session_id as result_id, sample_id, unnest(list_filter([
  case when status <> 'ok' then 'completed' end, case when mode not in ('isolated', 'burst', 'continuous') then 'mode' end,
  case when path = '' then 'path' end, case when touched_seq >= snapshot_seq then 'order' end,
  case when completion is null then 'completion_number' end, case when completion < 0 or completion is null then 'completion_negative' end],
  lambda x: x is not null)) as rule from changed
union all select session_id, null, 'path_repeated' from (select session_id, path from changed group by 1, 2 having count(*) > 1) group by 1
union all select session_id, null, unnest(list_filter([case when not bool_or(mode = 'isolated') then 'missing_isolated' end,
  case when not bool_or(mode = 'burst') then 'missing_burst' end, case when not bool_or(mode = 'continuous') then 'missing_continuous' end],
  lambda x: x is not null)) from changed group by 1
union all select session_id, null, unnest(list_filter([case when n % 2 <> 0 then 'failures' end,
  case when n % 3 = 0 or n % 5 = 0 then 'summary_counts' end], lambda x: x is not null)) from (select session_id, count(*) as n from changed group by 1)
union all select 'none', null, 'no_samples'""", f"""{_SAMPLES},
changed as (select session_id, sample_id, status, completion, touched_seq, case when sample_id % 101 = 0 then 'other' else mode end as mode,
    case when sample_id % 51 = 0 then '' when sample_id % 53 = 0 then 'same' else path end as path,
    case when sample_id % 59 = 0 then touched_seq else snapshot_seq end as snapshot_seq from metrics)""")
_q("normalized_clocks", """select session_id, seq, ts, (epoch_ms(timestamp '2024-01-01 00:00:00') + seq * 60000 + n % 1000
  - case when n % 2 = 0 then 0 else 3600000 end) * 1000000 as clock_ns from tl where n % 17 <> 0""", TALK)
_q("rejected_clocks", "select session_id, seq, ts from tl where n % 17 = 0", TALK)
_q("workload_final_state", """select slot, 'file-' || lpad(slot::varchar, 8, '0') || '.dat' as path, coalesce(writes, 0) as writes,
  substr(repeat(lpad(coalesce(last + 1000, slot)::varchar, 20, '0') || ':', 4), 1, 64) as payload
from range(1000) t(slot) left join (select event_id % 1000 as slot, max(event_id) as last, count(*) as writes
  from events group by 1) using (slot)""")
_q("churn_mismatches", """select session_id, path, null::varchar as planned, kind as observed from differing
where kind = 'mode_changed' and session_id = 's1'""", TREES)
_q("churn_totals", """select session_id, coalesce(i.add, 0) as add, modify, mode, remove, move,
  coalesce(i.add, 0) + modify + mode + remove + 2 * move as expected_entries, d.n as actual_entries,
  coalesce(i.add, 0) + modify + mode + remove + 2 * move = d.n as ok
from (select 's' || (doc_id % 8) as session_id, count(*) filter (doc_id % 25 = 1) as modify, count(*) filter (doc_id % 25 = 2) as mode,
    count(*) filter (doc_id % 25 = 0) as remove, count(*) filter (doc_id % 25 = 3) as move from documents group by 1)
left join (select 's' || (item_id % 8) as session_id, count(*) as add from benchmark group by 1) i using (session_id)
join (select session_id, count(*) as n from differing group by 1) d using (session_id)""", TREES)
