"""Request cuts over blocks against one fold, and other plans that spread a single large key."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.operators import faults


def folded(rows, max_events, max_bytes):
    out, last = {}, None
    for t, _, i, c, s in sorted(rows, key=lambda r: r[:3]):
        if last is None or t != last[0]:
            last = [t, c, 0, 0, 0]
        elif c != last[1] or last[3] >= max_events or last[4] + s > max_bytes:
            last = [t, c, last[2] + 1, 0, 0]
        last[3] += 1
        last[4] += s
        out[t, i] = last[2]
    return out


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 7), (3, 40)])
def test_request_cuts_over_blocks(spark, seed, parts):
    r = random.Random(seed)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(r.choice(["big"] * 30 + ["a", "b", "c"]), float(k // 3), f"id{k:05d}", "x" if r.random() < 0.97 else "y", r.choice([1, 10, 99, 350, 2000])) for k in range(2500)]
    df = spark.createDataFrame(rows, "tenant string, at double, id string, channel string, size long").withColumn("block", F.lit("clash"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for max_events, max_bytes in ((5, 1500), (40, 3000), (3000, 10**9)):
            got = {(x.tenant, x.id): x.request for x in faults.request_plan(df, max_events, max_bytes).collect()}
            assert got == folded(rows, max_events, max_bytes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_request_cuts_of_nothing_and_one_row(spark):
    df = spark.createDataFrame([(None, 0.0, "a", None, 5)], "tenant string, at double, id string, channel string, size long")
    assert [tuple(x) for x in faults.request_plan(df, 5, 10).collect()] == [(None, "a", 0)]
    assert faults.request_plan(df.where("false"), 5, 10).count() == 0
