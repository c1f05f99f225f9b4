"""Chunked ordered calculations against plain Python loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from driftlog.operators.ordered import (
    attach_facts,
    first_per_group,
    ordered_scan,
    smallest_per_group,
)


def test_scan_matches_a_loop(spark):
    rng = random.Random(5)
    rows = []
    for key in "abc":
        at = 0
        for _ in range({"a": 400, "b": 1, "c": 60}[key]):
            at += rng.randint(1, 9)
            rows.append((key, at, rng.choice([None, rng.randint(-5, 5)])))
    df = spark.createDataFrame(rows, "k string, at bigint, v bigint")
    got = ordered_scan(
        df, ["k"], ["at"], F.floor(F.col("at") / 13),
        rank="rn", sums={"total": F.col("v")}, prev={"before": F.col("v")},
        following={"after": F.col("v")}, last={"latest": F.col("v")}, upcoming={"coming": F.col("v")},
    ).collect()
    want = []
    for key in "abc":
        mine = [r for r in rows if r[0] == key]
        for i, (_, at, v) in enumerate(mine):
            values = [r[2] for r in mine]
            want.append((
                key, at, v, i, sum(x or 0 for x in values[: i + 1]),
                values[i - 1] if i else None,
                values[i + 1] if i + 1 < len(values) else None,
                next((x for x in reversed(values[: i + 1]) if x is not None), None),
                next((x for x in values[i + 1:] if x is not None), None),
            ))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_scan_never_orders_a_whole_key_of_rows(spark):
    df = spark.range(10).selectExpr("'k' k", "id at", "id v")
    plan = ordered_scan(df, ["k"], ["at"], F.floor(F.col("at") / 3), rank="rn")
    text = plan._jdf.queryExecution().toString()
    for line in text.splitlines():
        if "row_number()" in line and "windowspecdefinition" in line:
            assert "_chunk" in line.split("windowspecdefinition(")[1].split("ASC")[0]


def test_joins_spread_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id % 3 > 0, 'hot', cast(id as string)) k", "id")
    facts = rows.select("k").distinct().withColumn("size", F.length("k"))
    plain = sorted(map(tuple, rows.join(facts, "k", "left").select("k", "id", "size").collect()))
    salted = attach_facts(rows, facts, ["k"], F.col("id")).select("k", "id", "size")
    assert sorted(map(tuple, salted.collect())) == plain


def test_group_picks(spark):
    rows = spark.range(500).selectExpr("id % 3 k", "500 - id v", "id")
    first = first_per_group(rows, ["k"], ["v"], ["id", "v"]).collect()
    assert {r.k: r.id for r in first} == {0: 498, 1: 499, 2: 497}
    small = smallest_per_group(rows, ["k"], ["v"], 4).collect()
    assert len(small) == 12
    assert sorted(r.v for r in small if r.k == 1) == [1, 4, 7, 10]
    assert sorted(r.rank for r in small if r.k == 2) == [0, 1, 2, 3]
