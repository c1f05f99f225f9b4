"""Engine tables derived from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlog.operators.segments import Debounce

RULE = Debounce(quiescence_ms=21_600_000, max_delay_ms=86_400_000)
IGNORES = [".git", ".jj", "*.tmp"]
ROOT = "/work"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return table(spark, sf_dir, "events").selectExpr(
        "concat('u', cast(user_id as string)) session_id",
        "event_id notif_id",
        "unix_millis(cast(ts as timestamp)) t_ms",
        "case event_type when 'signup' then 'create' when 'click' then 'modify' "
        "when 'purchase' then 'modify' when 'error' then 'remove' else 'access' end kind",
        "case when event_type = 'purchase' then 'any' end rename_mode",
        f"array(concat('{ROOT}/', case {k} % 10 when 9 then '.git/' when 8 then 'tmp/x.tmp/' "
        f"else 'src/' end, 'd', cast({k} % 7 as string), '/f', cast({k} as string), '.txt')) paths",
        "value > 199 need_rescan",
        "cast(null as string) error",
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and flushes, and a pause with its resume on some sessions."""
    return table(spark, sf_dir, "events").filter("event_id % 50 = 0").selectExpr(
        "concat('u', cast(user_id as string)) session_id",
        "event_id command_id",
        "unix_millis(cast(ts as timestamp)) t_ms",
        "case when event_id % 150 = 0 then 'flush' else 'mark' end command",
    )


def edits(touches: DataFrame) -> DataFrame:
    """File states behind the touches: a removal empties its path, any other
    touch writes content named after the notification."""
    return touches.select("session_id", "t_ms", "notif_id", "operation", F.posexplode("paths").alias("pos", "path")).selectExpr(
        "session_id",
        "t_ms",
        "notif_id * 1024 + pos edit_id",
        "path",
        "'file' entry_type",
        "case when operation <> 'remove' then sha2(cast(notif_id % 50 as string), 256) end blob",
        "notif_id % 3 = 0 executable",
        "notif_id % 1000 bytes",
    )


def pausing_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_id % 25 = 0").selectExpr(
        "concat('u', cast(user_id as string)) session_id",
        "event_id command_id",
        "unix_millis(cast(ts as timestamp)) t_ms",
        "case event_id div 25 % 5 when 0 then 'pause' when 1 then 'resume' when 2 then 'snap' "
        "when 3 then 'mark' else 'flush' end command",
    )


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed timelines, one per conversation: turn 0 starts the session,
    assistant turns are snapshots, every fourth other turn is a mark, some
    turns are flushes, overflows or ends, the rest touched_paths."""
    talk = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "role", "sha2(text, 256) sha", "length(text) n"
    )
    before = talk.selectExpr("conv_id", "turn + 1 turn", "sha prev_sha", "n prev_n")
    rows = talk.join(before, ["conv_id", "turn"], "left")
    body = rows.selectExpr(
        "conv_id", "turn", "sha", "n", "coalesce(prev_sha, sha) prev_sha", "coalesce(prev_n, n) prev_n",
        "case when turn = 0 then 'session_start' when role = 'assistant' then 'snapshot' "
        "when turn % 4 = 0 then 'mark' when n % 5 = 0 then 'flush' when n % 7 = 0 then 'overflow' "
        "when n % 11 = 0 then 'session_end' else 'touched_paths' end type",
    )
    change = (
        "named_struct('path', concat('src/', substr(sha, 1, 2), '.txt'), 'kind', "
        "case when n % 3 = 0 then 'added' when n % 3 = 1 then 'modified' else 'removed' end, "
        "'blob', case when n % 3 < 2 then concat('b:', substr(sha, 1, 40)) end, "
        "'prev_blob', case when n % 3 > 0 then concat('b:', substr(prev_sha, 1, case when n % 13 = 0 then 39 else 40 end)) end, "
        "'from', cast(null as string), 'bytes', case when n % 3 < 2 then cast(n as bigint) end)"
    )
    return body.selectExpr(
        "concat('c', cast(conv_id as string)) session_id",
        "cast(turn as bigint) seq",
        "concat('2024-01-01T00:', lpad(cast(turn as string), 2, '0'), ':00.', lpad(cast(n % 1000 as string), 3, '0'), "
        "case when n % 17 = 0 then '' when n % 2 = 0 then 'Z' else '+01:00' end) ts",
        "type",
        "case when type = 'session_start' then named_struct('roots', array('/work'), "
        "'baseline_op', concat('op:', sha), 'baseline_tree', concat('t:', substr(sha, 1, 40)), "
        "'ignore', array('.git')) end session_start",
        f"case when type = 'snapshot' then named_struct('op', concat('op:', sha), "
        f"'parent_op', concat('op:', prev_sha), 'commit', concat(case when n % 19 = 0 then 'x:' else 'c:' end, substr(sha, 1, 40)), "
        f"'tree', concat('t:', substr(sha, 1, 40)), 'changes', array({change}), "
        f"'stats', named_struct('added', cast(case when n % 3 = 0 then 1 else 0 end as bigint), "
        f"'removed', cast(case when n % 3 = 2 then 1 else 0 end as bigint), "
        f"'modified', cast(case when n % 3 = 1 then 1 else 0 end as bigint) + cast(n % 2 as bigint), "
        f"'renamed', cast(0 as bigint), 'mode_changed', cast(0 as bigint)), "
        f"'truncated', n % 4 < 2) end snapshot",
        "case when type = 'touched_paths' then named_struct('paths', array("
        "named_struct('path', concat('src/', substr(sha, 1, 2), '.txt'), 'operations', array('modify')), "
        "named_struct('path', concat('src/', substr(sha, 3, 2), '.txt'), 'operations', "
        "case when n % 2 = 0 then array('create', 'modify') else array('rename', 'create') end)), "
        "'raw_events', cast(n % 50 as bigint), 'window_started_at', 'x', 'window_ended_at', 'y') end touched_paths",
        "case when type = 'mark' then named_struct('label', concat('m', cast(n as string)), "
        "'ref_op', concat('op:', prev_sha)) end mark",
        "case when type = 'flush' then named_struct('op', concat('op:', prev_sha), "
        "'through_seq', cast(turn + (n % 2) as bigint)) end flush",
        "case when type = 'session_end' then named_struct('final_op', concat('op:', prev_sha), 'reason', 'stop', "
        "'snapshots', cast(1 as bigint), 'events', cast(turn as bigint)) end session_end",
        "cast(null as struct<scope:string,message:string,fatal:boolean,retrying:boolean>) error",
        "case when type = 'overflow' then named_struct('source', 'notify:rescan', "
        "'raw_events', cast(1 as bigint), 'recovery', 'full_scan_snapshot') end overflow",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw NDJSON lines with one fault class per file; line_no from 1."""
    talk = table(spark, sf_dir, "conversations").filter("not (conv_id % 6 = 1 and turn = 2)")
    value = (
        "case when conv_id % 6 = 4 and turn = 1 then 'not-json' "
        "when conv_id % 6 = 5 and turn = 1 then '  ' "
        "else concat('{\"v\":', case when conv_id % 6 = 3 and turn = 1 then '1' else '0' end, "
        "',\"seq\":', cast(turn - case when conv_id % 6 = 5 and turn > 1 then 1 else 0 end as string), "
        "',\"session_id\":\"', case when conv_id % 6 = 2 and turn = 2 then 'other' "
        "else concat('c', cast(conv_id as string)) end, "
        "'\",\"ts\":\"x\",\"type\":\"mark\",\"data\":{\"label\":\"', role, '\",\"meta\":{\"n\":', cast(turn as string), "
        "'},\"ref_op\":\"op:', sha2(text, 256), '\"},\"future\":true}') end"
    )
    return talk.selectExpr(
        "concat('c', cast(conv_id as string), '.ndjson') file",
        "conv_id",
        # Turns are contiguous, so only the dropped turn shifts the numbering.
        "cast(turn + 1 - case when conv_id % 6 = 1 and turn > 2 then 1 else 0 end as bigint) line_no",
        f"{value} value",
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.max("turn").alias("last_seq"))
        .selectExpr(
            "concat('c', cast(conv_id as string)) session_id",
            "case when conv_id % 5 = 3 then 2 else 1 end session_format",
            "0 schema_version",
            "cast(last_seq as bigint) last_seq",
            "cast(case when conv_id % 5 = 2 then null when conv_id % 5 = 1 then last_seq - 1 "
            "else last_seq end as bigint) durable_seq",
            "case when conv_id % 11 = 0 then '../x.ndjson' end events_object",
            "conv_id % 13 <> 0 parsed",
        )
    )


def tree_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('s', cast(doc_id % 8 as string)) session_id",
        "concat(lang, '/', source, '/', cast(doc_id as string), '.txt') path",
        "sha2(text, 256) blob",
        "doc_id % 5 = 0 executable",
        "n_chars bytes",
    )


def tree_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "documents").filter("doc_id % 25 <> 0").selectExpr(
        "concat('s', cast(doc_id % 8 as string)) session_id",
        "concat(case when doc_id % 25 = 3 then 'moved/' else '' end, lang, '/', source, '/', "
        "cast(doc_id as string), '.txt') path",
        "case when doc_id % 25 = 1 then sha2(concat(text, 'x'), 256) else sha2(text, 256) end blob",
        "case when doc_id % 25 = 2 then not (doc_id % 5 = 0) else doc_id % 5 = 0 end executable",
        "n_chars bytes",
    )
    added = table(spark, sf_dir, "benchmark").selectExpr(
        "concat('s', cast(item_id % 8 as string)) session_id",
        "concat('added/', cast(item_id as string), '.txt') path",
        "sha2(text, 256) blob",
        "false executable",
        "cast(length(text) as bigint) bytes",
    )
    return kept.unionByName(added)


def churn_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes that turn ``tree_before`` into ``tree_after``."""
    path = "concat(lang, '/', source, '/', cast(doc_id as string), '.txt')"
    changed = table(spark, sf_dir, "documents").filter("doc_id % 25 < 4").selectExpr(
        "concat('s', cast(doc_id % 8 as string)) session_id",
        f"{path} path",
        "case doc_id % 25 when 0 then 'remove' when 1 then 'modify' when 2 then 'mode' else 'move' end action",
        f"case when doc_id % 25 = 3 then concat('moved/', {path}) end moved_to",
    )
    added = table(spark, sf_dir, "benchmark").selectExpr(
        "concat('s', cast(item_id % 8 as string)) session_id",
        "concat('added/', cast(item_id as string), '.txt') path",
        "'add' action",
        "cast(null as string) moved_to",
    )
    return changed.unionByName(added)


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five full trees per session."""
    return (
        table(spark, sf_dir, "documents")
        .withColumn("gen", F.explode(F.sequence(F.lit(0), F.lit(4))))
        .filter("(doc_id + gen) % 7 <> 0")
        .selectExpr(
            "concat('s', cast(doc_id % 8 as string)) session_id",
            "gen",
            "concat(lang, '/', source, '/', cast(doc_id as string), '.txt') path",
            "sha2(concat(text, '#', cast((doc_id % 5 + gen) div 5 as string)), 256) blob",
            "n_chars bytes",
        )
    )


def generation_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of all blobs the generations name."""
    content = table(spark, sf_dir, "documents").select(
        F.explode(F.array(F.lit("0"), F.lit("1"))).alias("v"), "text"
    ).selectExpr("concat(text, '#', v) body")
    return content.selectExpr("sha2(body, 256) blob", "encode(body, 'UTF-8') content")


def batch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sizes per source in document order; each source holds every
    twentieth document, so the sequence is the position in that order."""
    from driftlog.operators.ordered import ordered_scan, seq_chunk

    docs = table(spark, sf_dir, "documents").selectExpr(
        "source session_id", "doc_id", "cast(octet_length(text) as bigint) len"
    )
    return ordered_scan(docs, ["session_id"], ["doc_id"], seq_chunk("doc_id"), rank="seq")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat('c', cast(o_custkey % 50 as string)) session_id",
        "o_orderkey attempt_id",
        "case o_orderkey % 20 when 0 then 409 when 1 then 429 when 2 then 503 when 3 then 404 else 200 end status",
        "case when o_orderkey % 40 = 1 then 2 end retry_after",
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").selectExpr(
        "concat('rec/dev/', case page_id % 25 when 0 then '../' when 1 then 'a//' else '' end, "
        "'p', cast(case when page_id % 25 = 6 then page_id - 1 else page_id end as string), "
        "case when page_id % 25 = 3 then '/' else '.html' end) key_name",
        "case when page_id % 25 = 4 then -1 else cast(length(html) as bigint) end size",
    )
    # One object outside the prefix, named after the last page.
    outside = pages.agg(F.count(F.lit(1)).alias("n")).selectExpr("'other/x.html' key_name", "cast(1 as bigint) size")
    return pages.unionByName(outside)


def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "concat(o_orderpriority, '-', cast(o_custkey % 10 as string)) run_id",
        "case when o_orderkey % 2 = 0 then 'on' else 'off' end recording",
        "cast(o_totalprice as double) wall_seconds",
        "cast(10000 as bigint) logical_mutations",
    )


def sync_listing(spark: SparkSession, sf_dir: str, tree: DataFrame) -> DataFrame:
    """A tree as repository files: content objects, plus a mutable name."""
    return tree.selectExpr(
        "session_id",
        "case when bytes % 3 = 0 then concat('store/git/objects/', substr(blob, 1, 2), '/', substr(blob, 3, 38)) "
        "when bytes % 3 = 1 then concat('op_store/views/', blob) else path end path",
        "bytes",
        "blob digest",
    ).groupBy("session_id", "path").agg(
        F.max("bytes").alias("bytes"), F.max("digest").alias("digest")
    ).selectExpr("*", "case when bytes % 97 = 0 then 'symlink' else 'file' end file_type")
