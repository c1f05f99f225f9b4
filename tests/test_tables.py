"""Engine tables, the durable store, interval joins and exact selection."""

from __future__ import annotations

import glob
import random
import statistics as plain

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from driftlog.functions.paths import session_filters
from driftlog.operators import measure, publish, segments, trees, windows
from driftlog.operators.segments import Debounce, debounce_instants
from driftlog.session import scratch_path
from driftlog.sources import sinks, tables
from driftlog.streaming.runs import run_available


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ----------------------------------------------------------- engine tables


def test_lookups_prune_buckets_and_row_groups(spark, monkeypatch):
    monkeypatch.setattr(tables, "RUN_ROWS", 500)
    path = scratch_path(spark, "engine")
    events = spark.range(4_000).selectExpr("case when id < 3000 then 'hot' else concat('s', id % 40) end session_id", "id seq", "repeat('x', 50) body")
    tables.write_table(events, path, buckets=8, row_group_bytes=4_096)
    assert tables.read_table(spark, path).count() == 4_000
    found = tables.read_table(spark, path, ["hot"], 700, 720)
    assert rows(found, "session_id", "seq") == [("hot", n) for n in range(700, 721)]
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    pruned = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "bucket_of_8" in pruned and "xxhash64" not in pruned
    assert "session_id,hot" in pushed and "GreaterThanOrEqual(seq,700)" in pushed
    # One folder of the eight is read.
    used = {r[0].split("/")[-2] for r in found.select(F.input_file_name()).distinct().collect()}
    assert len(used) == 1
    # The hot session stands in several sorted files whose ranges do not overlap.
    groups = []
    for name in glob.glob(f"{path.removeprefix('file:')}/{used.pop()}/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        at = meta.schema.to_arrow_schema().get_field_index("seq")
        for i in range(meta.num_row_groups):
            stats = meta.row_group(i).column(at).statistics
            groups.append((stats.min, stats.max))
    hit = [g for g in groups if g[0] <= 720 and g[1] >= 700]
    assert len(groups) >= 6 and len(hit) <= 2


def test_requested_sessions_are_named_or_joined(spark, monkeypatch):
    path = scratch_path(spark, "engine")
    tables.write_table(spark.range(300).selectExpr("concat('s', id % 30) session_id", "id seq"), path, buckets=4)
    asked = spark.createDataFrame([("s3",), ("s4",), ("s3",), (None,), ("none",)], "session_id string")
    want = sorted((f"s{n % 30}", n) for n in range(300) if n % 30 in (3, 4))
    assert rows(tables.rows_for(spark, path, asked), "session_id", "seq") == sorted(want, key=repr)
    monkeypatch.setattr(tables, "NAMED_SESSIONS", 1)
    assert rows(tables.rows_for(spark, path, asked), "session_id", "seq") == sorted(want, key=repr)
    empty = scratch_path(spark, "engine")
    tables.write_table(spark.createDataFrame([], "session_id string, seq long"), empty)
    assert tables.read_table(spark, empty, ["a"], schema="session_id string, seq long").count() == 0


# ----------------------------------------------------------- durable store

EVENT = "session_id string, seq bigint, body string"


def batch(spark, session, *seqs, body="b"):
    return spark.createDataFrame([(session, q, f"{body}{q}") for q in seqs], EVENT)


def test_unlike_contents_are_reported(spark):
    store = sinks.DurableStore(spark, scratch_path(spark, "store"), EVENT)
    store.publish(batch(spark, "x", 0, 1, 4), 0)
    store.publish(batch(spark, "x", 1, 2, 4, body="c"), 1)
    store.publish(batch(spark, "y", 0).union(batch(spark, "y", 0, body="z")).union(batch(spark, "y", 0)), 2)
    assert rows(store.visible(), "session_id", "seq", "body")[:3] == [("x", 0, "b0"), ("x", 1, "b1"), ("x", 2, "c2")]
    found = rows(store.conflicts(), "session_id", "seq", "body", "reason")
    assert found[:2] == [("x", 1, "c1", "accepted"), ("x", 4, "c4", "staged")]
    assert len(found) == 3 and found[2][0::3] == ("y", "batch")
    store.publish(batch(spark, "x", 3), 3)
    assert rows(store.watermarks(), "session_id", "durable_seq") == [("x", 4), ("y", 0)]
    assert rows(store.visible().filter("session_id = 'x'"), "seq", "body") == [(0, "b0"), (1, "b1"), (2, "c2"), (3, "b3"), (4, "b4")]


def test_live_starts_before_the_first_publication(spark):
    store = sinks.DurableStore(spark, scratch_path(spark, "store"), EVENT)
    assert run_available(store.live(), "early").count() == 0
    assert store.visible().count() == store.watermarks().count() == store.conflicts().count() == 0
    store.publish(batch(spark, "s"), 0)
    store.publish(batch(spark, "s", 1), 0)
    assert store.watermarks().count() == 0
    store.publish(batch(spark, "s", 0), 0)
    assert rows(run_available(store.live(), "late"), "seq") == [(0,), (1,)]


def test_a_publication_without_head_is_finished_or_written_over(spark, monkeypatch):
    path = scratch_path(spark, "store")
    store = sinks.DurableStore(spark, path, EVENT)
    store.publish(batch(spark, "s", 0), 0)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(sinks.DurableStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.publish(batch(spark, "s", 1, 2), 1)
    assert rows(store.visible(), "seq") == [(0,)]
    again = sinks.DurableStore(spark, path, EVENT)
    again.publish(batch(spark, "s", 1, 2, 3), 1)
    assert rows(again.visible(), "seq") == [(0,), (1,), (2,), (3,)] and again.conflicts().count() == 0


def test_reads_follow_the_batch_not_the_history(spark, monkeypatch):
    """An append reads the state of its buckets, and no event written before."""
    store = sinks.DurableStore(spark, scratch_path(spark, "store"), EVENT)
    for n in range(3):
        store.publish(spark.range(50).selectExpr("concat('s', id % 5) session_id", f"{n} * 10 + id div 5 seq", "'b' body"), n)
    read = []
    real = sinks.DurableStore._partitions

    def seen(self, kind, places, schema):
        found = real(self, kind, places, schema)
        read.append((kind, len(places), found.count()))
        return found

    monkeypatch.setattr(sinks.DurableStore, "_partitions", seen)
    monkeypatch.setattr(sinks.DurableStore, "_table", lambda *_: pytest.fail("read accepted events"))
    store.publish(batch(spark, "s1", 30), 3)
    assert read == [("state", 1, 1), ("staged", 0, 0)] or read[0][2] <= 5 and all(k != "accepted" for k, *_ in read)


def test_random_batches_against_a_dictionary(spark):
    rng = random.Random(4)
    store = sinks.DurableStore(spark, scratch_path(spark, "store"), EVENT)
    sent: dict = {}
    for n in range(6):
        seqs = rng.sample(range(14), 5)
        store.publish(batch(spark, "s", *seqs).union(batch(spark, "t", *[q for q in seqs if q % 2])), n)
        for q in seqs:
            sent.setdefault("s", set()).add(q)
            if q % 2:
                sent.setdefault("t", set()).add(q)
        want = []
        for name, held in sent.items():
            upto = next(k for k in range(15) if k not in held)
            want += [(name, q) for q in range(upto)]
        assert rows(store.visible(), "session_id", "seq") == sorted(want, key=repr)


# ----------------------------------------------------------- interval joins


def test_dyadic_nodes_cover_an_interval_once(spark):
    pairs = [(a, b) for a in range(0, 18) for b in range(a, 18)]
    df = spark.createDataFrame(pairs, "a long, b long").select(
        "a", "b", trees.dyadic_nodes(F.col("a"), F.col("b"), 4).alias("nodes")
    )
    for r in df.collect():
        covered = sorted(x for n in r.nodes for x in range(n.place << n.level, (n.place + 1) << n.level))
        assert covered == list(range(r.a, min(r.b, 16)))
        assert len(r.nodes) <= 8


def test_trees_and_diffs_of_a_hot_session(spark):
    rng = random.Random(9)
    versions = []
    for path in range(60):
        cuts = sorted(rng.sample(range(200), 6))
        for a, b in zip(cuts, [*cuts[1:], None], strict=True):
            if rng.random() < 0.8:
                versions.append(("hot", f"p{path}", "file", f"b{rng.randrange(4)}", False, a, b))
    df = spark.createDataFrame(versions, "session_id string, path string, entry_type string, blob string, executable boolean, valid_from long, valid_to long")
    points = rng.sample(range(230), 40)
    asked = spark.createDataFrame([("hot", p) for p in points] + [("cold", 3), ("hot", points[0])], "session_id string, at_seq long")
    alive = lambda v, p: v[5] <= p and (v[6] is None or p < v[6])
    got = trees.tree_at(df, asked)
    assert rows(got, "at_seq", "path", "blob") == sorted(((p, v[1], v[3]) for p in points for v in versions if alive(v, p)), key=repr)
    assert trees.tree_at(df, asked.limit(0)).count() == 0
    requests = [(rng.choice(points), rng.choice(points)) for _ in range(25)]
    changed = trees.diff_operations(df, spark.createDataFrame([("hot", *r) for r in requests], "session_id string, before_seq long, after_seq long"))
    want = set()
    for one, two in requests:
        for path in {v[1] for v in versions}:
            old = next((v[3] for v in versions if v[1] == path and alive(v, one)), None)
            new = next((v[3] for v in versions if v[1] == path and alive(v, two)), None)
            if old != new:
                want.add((one, two, path, old, new))
    assert rows(changed, "before_seq", "after_seq", "path", "before", "after") == sorted(want, key=repr)


# -------------------------------------------------------------- selection


@pytest.mark.parametrize("limit", [1, 3, 65_536])
def test_percentiles_by_repeated_cuts(spark, monkeypatch, limit):
    monkeypatch.setattr(measure, "PART_VALUES", limit)
    rng = random.Random(limit)
    data = {
        "lopsided": [rng.random() * 1e-9 for _ in range(400)] + [1e12, -1e12],
        "same": [5.0] * 30,
        "one": [7.0],
        "mixed": [rng.choice([1.0, 2.0, 1e300, -1e-300]) for _ in range(100)],
    }
    df = spark.createDataFrame([(k, v) for k, values in data.items() for v in values], "k string, value double")
    got = {r.k: r for r in measure.statistics(df, ["k"]).collect()}
    for k, values in data.items():
        order = sorted(values)
        assert (got[k]["count"], got[k].min, got[k].max) == (len(order), order[0], order[-1])
        for p in (50, 95, 99):
            rank = (len(order) - 1) * p / 100.0
            lo, hi = order[int(rank)], order[min(int(rank) + 1, len(order) - 1)]
            assert got[k][f"p{p}"] == pytest.approx(lo + (hi - lo) * (rank - int(rank)), rel=1e-12, abs=1e-300)
    assert got["one"].p50 == plain.median(data["one"])


# ------------------------------------------------------------ window folds


@pytest.mark.parametrize("fold", [1, 2, 3, 7])
def test_blocks_of_chunks_compose(spark, monkeypatch, fold):
    monkeypatch.setattr(segments, "FOLD_CHUNKS", fold)
    rng = random.Random(fold)
    data = []
    for session, step in (("dense", 4), ("sparse", 40), ("long", 11)):
        t = 0
        for _ in range(500):
            t += rng.randint(1, step)
            data.append((session, t, t // 700 if session == "long" else 0))
    df = spark.createDataFrame(data, "session_id string, t_ms bigint, epoch bigint").withColumn("eff_ms", F.col("t_ms"))
    got = {(r.session_id, r.t_ms): r.window_start for r in debounce_instants(df, Debounce(12, 45, 64)).collect()}
    want, start, last = {}, None, None
    for session, t, epoch in data:
        if last is None or last[0] != session or last[2] != epoch or t >= min(start + 45, last[1] + 12):
            start = t
        want[session, t], last = start, (session, t, epoch)
    assert got == want


def test_a_dense_session_is_folded_by_many_tasks_in_short_rows(spark):
    rule = Debounce(50, 400, 3_200)
    df = spark.range(120_000).selectExpr("'hot' session_id", "id t_ms", "id eff_ms", "0L epoch")
    chunked = df.withColumn("chunk", F.floor(F.col("t_ms") / rule.chunk_ms).cast("bigint"))
    edges = segments._by_chunk(chunked, "t_ms").mapInPandas(segments._time_edges(rule), segments._TIME_EDGE_SCHEMA)
    packed = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = edges.withColumn("block", F.floor(F.col("chunk") / 4).cast("bigint")).repartition(
            "session_id", "block"
        ).sortWithinPartitions("session_id", "block", "chunk")
        placed = blocks.select("block", F.spark_partition_id().alias("task")).distinct().collect()
        composed = blocks.mapInPandas(segments._time_compose(rule), segments._TIME_EDGE_SCHEMA)
        assert len({r.task for r in placed}) > 4 and composed.count() == len({r.block for r in placed}) == 10
        assert composed.agg(F.max(F.size("entries"))).first()[0] <= 401
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", packed)
    starts = debounce_instants(df, rule).select("window_start").distinct()
    assert rows(starts, "window_start") == sorted(((n,) for n in range(0, 120_000, 400)), key=repr)


# ------------------------------------------------------------ session lists


def test_sessions_with_unlike_lists(spark):
    lists = spark.createDataFrame(
        [("a", "/w/", ["/w/out/"], ["*.tmp", "build"]), ("b", "/", None, None), ("c", "/w", [], ["[x"])],
        "session_id string, root string, excluded array<string>, ignores array<string>",
    )
    filters = session_filters(lists)
    assert [bool(r.error) for r in filters.orderBy("session_id").collect()] == [False, False, True]
    paths = ["/w/a.tmp", "/w/src/x", "/w/out/y", "/w/build/z", "/w/.git/c", "/w/output", "/q"]
    notes = spark.createDataFrame(
        [(s, i, i, "modify", None, [p], False, None) for s in "abc" for i, p in enumerate(paths)],
        "session_id string, notif_id long, t_ms long, kind string, rename_mode string, paths array<string>, need_rescan boolean, error string",
    )
    kept = {}
    for r in windows.observe_sessions(notes, filters).collect():
        kept.setdefault(r.session_id, set()).update(r.paths)
    assert kept == {"a": {"src/x", "output"}, "b": {"w/a.tmp", "w/src/x", "w/out/y", "w/build/z", "w/output", "q"}}


def test_unusable_prefixes_have_an_outcome(spark):
    listing = spark.createDataFrame([("rec/s1/a", 3), ("rec//b", 2), ("rec/../c", 1), ("other/s2", 1)], "key_name string, size bigint")
    show = lambda p: rows(publish.sessions_in_listing(listing, p), "session_id", "objects", "bytes", "outcome")
    assert show("rec/") == [("s1", 1, 3, "ok"), (None, 2, 3, "unnamed")]
    assert show("a//b") == show("..") == [(None, 0, 0, "bad_prefix")]
    assert show("none") == []
