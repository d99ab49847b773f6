"""Exact fault injection and request planning."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import staged

VARIANTS = ["bad_type", "bad_time", "unknown_attribute", "duplicate_id"]


def injection_plan(spark: SparkSession, total: int, count: int, seed: int) -> DataFrame:
    """(k, slot, variant): ``count`` slots, one in each equal stretch of ``total``, never two side by side where stretches allow it.

    The place in a stretch is a hash of seed and number, so it is the same on every run.
    """
    width = total / max(1, count)
    lo = F.floor(F.col("id") * F.lit(width)).cast("long")
    room = F.greatest(F.floor((F.col("id") + 1) * F.lit(width)).cast("long") - lo - 1, F.lit(1))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("id")).cast("binary")), 1, 8), 16, 10).cast("long")
    pick = F.element_at(F.array(*map(F.lit, VARIANTS)), (F.col("id") % len(VARIANTS) + 1).cast("int"))
    return spark.range(count).select(F.col("id").alias("k"), (lo + h % room).alias("slot"), pick.alias("variant"))


def placed(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """``rows`` with ``place``: dense numbers from 0 in the order of ``key`` and ``ties``, whatever gaps and repeats ``key`` has.

    Bounds from approximate quantiles cut the rows by range; places count within a range, from the running
    sum of the counts of the ranges before (one row per range).
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000)).first()[0] if n > 1 else None
    x = rows.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(key))) if bounds else F.lit(0))
    counts = x.groupBy("_range").agg(F.count("*").alias("_n"))
    first = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key, *ties))
    return x.withColumn("_at", at).join(F.broadcast(first), "_range").withColumn("place", F.col("_first") + F.col("_at") - 1).drop("_range", "_at", "_first")


def checked_total(rows: DataFrame, planned: int) -> DataFrame:
    """``rows``, if there are as many as the plan was made for; an exact share of another number would be no exact share."""
    found = rows.count()
    if found != planned:
        raise ValueError(f"the plan is for {planned} events, there are {found}")
    return rows


def partners(rows: DataFrame, bad: str = "variant") -> DataFrame:
    """``rows`` (batch_id, idx, id, variant) with the id of a clean partner in the same batch.

    The nearest clean row before, else the nearest after; ``appended`` marks rows whose batch has none.
    Both are found in one pass: a frame up to the end of the batch would be read anew for each row.
    """
    w = Window.partitionBy("batch_id").orderBy("idx")
    rows = rows.withColumn("_clean", F.when(F.col(bad).isNull(), F.col("id")))
    before, after = (F.expr(f"{f}(_clean) ignore nulls").over(w) for f in ("lag", "lead"))
    return rows.withColumn("partner_id", F.coalesce(before, after)).withColumn("appended", F.col(bad).isNotNull() & F.col("partner_id").isNull()).drop("_clean")


def corrupt(rows: DataFrame) -> DataFrame:
    """The four variants applied to (id, type, time, extra, partner_id, variant)."""
    v = F.col("variant")
    return rows.withColumns({
        "type": F.when(v == "bad_type", F.concat("type", F.lit("-x"))).otherwise(F.col("type")),
        "time": F.when(v == "bad_time", "yesterday").otherwise(F.col("time")),
        "extra": F.coalesce(v == "unknown_attribute", F.lit(False)),
        "id": F.when(v == "duplicate_id", F.coalesce("partner_id", "id")).otherwise(F.col("id")),
    })


def emitted(rows: DataFrame) -> DataFrame:
    """What goes out of ``rows`` (with their partners): each row, corrupted if it has a variant, and the clean appended ones.

    A batch without any clean row has no partner to give, so each of its corrupted rows brings its clean self, at the
    end of the batch: the number of corrupted rows stays exact, and that of clean ones grows.
    """
    size = F.count("*").over(Window.partitionBy("batch_id"))
    last = F.row_number().over(Window.partitionBy("batch_id").orderBy("idx"))
    more = rows.withColumn("_size", size).where("appended").withColumns({"idx": (F.col("_size") + last - 1).cast(rows.schema["idx"].dataType), "variant": F.lit(None).cast("string")}).drop("_size")
    return corrupt(rows).unionByName(more.withColumn("extra", F.lit(False)))


def request_plan(rows: DataFrame, max_events: int, max_bytes: int) -> DataFrame:
    """``rows`` (tenant, at, id, channel, size) with ``request``: contiguous cuts in order, numbered from 0 in each tenant.

    A new request starts where the tenant or channel changes or where the next event would break a limit; an event over the
    limit is alone.  A cut depends on the cut before, but from any row on, the next cut follows from the next ``max_events`` rows.  So
    the sorted rows are cut into blocks by range, each with the first rows of the next; a block turns the place of its first cut into that of the
    next block, by pointer doubling, and only these maps of at most ``max_events`` + 1 places, one for each block, are followed in
    order.  A tenant may spread over all blocks.
    """
    spark = rows.sparkSession
    x = rows.select("tenant", "at", "id", "channel", F.col("size").cast("long").alias("size")).repartitionByRange("tenant", "at", "id").sortWithinPartitions("tenant", "at", "id").withColumn("_m", F.monotonically_increasing_id())
    x = staged(x.select("tenant", "id", "channel", "size", F.shiftright("_m", 33).alias("part"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("k")), "ordered")
    sizes = [(r.part, r.n) for r in x.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]  # a row for each range
    where = spark.createDataFrame(_blocks(sizes, max_events), "part long, block long, shift long, before long")
    x = x.join(F.broadcast(where), "part").select("block", (F.col("k") + F.col("shift")).alias("k"), "tenant", "id", "channel", "size", "before", F.lit(True).alias("own"))
    more = x.where((F.col("block") > 0) & (F.col("k") <= max_events)).withColumns({"block": F.col("block") - 1, "k": F.col("k") + F.col("before"), "own": F.lit(False)})
    blocks = x.unionByName(more)

    def nexts(t: pa.Table) -> tuple[pa.Table, np.ndarray, int]:
        """The rows in order, the place of the next cut after a cut at each of them, and how many are the block's own."""
        t = t.combine_chunks().sort_by("k")
        n, size = len(t), np.asarray(t.column("size"))
        change = np.zeros(n, bool)
        for c in ("tenant", "channel"):
            code = t.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        at, i = np.append(np.flatnonzero(change), n), np.arange(n)
        total = np.concatenate([[0], np.cumsum(size)])
        full = np.searchsorted(total, total[:-1] + max_bytes, "right") - 1
        nxt = np.minimum(np.minimum(i + max_events, at[np.searchsorted(at, i, "right").clip(max=len(at) - 1)]), np.maximum(i + 1, full))
        return t, np.minimum(nxt, n), int(np.asarray(t.column("own")).sum())

    def leave(t: pa.Table) -> pa.Table:
        t, nxt, own = nexts(t)
        to = nxt[:own].copy()
        while (inside := to < own).any():
            to[inside] = to[to[inside]]
        first = np.arange(max_events + 1)
        out = np.where(first >= own, first - own, to[np.minimum(first, own - 1)] - own)
        return pa.table({"block": t.column("block")[:1], "leaves": pa.array([out.tolist()], pa.list_(pa.int64()))})

    def follow(batches):
        at = 0
        for pdf in batches:
            enter = []
            for to in pdf.leaves:
                enter.append(at)
                at = int(to[at])
            yield pd.DataFrame({"block": pdf.block, "enter": enter})

    leaves = staged(blocks.groupBy("block").applyInArrow(leave, "block long, leaves array<long>"), "leaves")
    entered = leaves.repartition(1).sortWithinPartitions("block").mapInPandas(follow, "block long, enter long")
    kinds = {f.name: f.dataType.simpleString() for f in rows.select("tenant", "id").schema}

    def cut(t: pa.Table) -> pa.Table:
        t, nxt, own = nexts(t)
        first, at = np.zeros(own, np.int64), int(t.column("enter")[0].as_py())
        while at < own:
            first[at] = 1
            at = int(nxt[at])
        tenant = t.column("tenant")[:own].combine_chunks().dictionary_encode("encode").indices.to_numpy()
        start = np.flatnonzero(np.concatenate([[True], tenant[1:] != tenant[:-1]]))
        so_far = np.cumsum(first)
        local = so_far - np.repeat((so_far - first)[start], np.diff(np.append(start, own)))
        return pa.table({"block": t.column("block")[:own], "tenant": t.column("tenant")[:own], "id": t.column("id")[:own], "local": local})

    done = staged(blocks.join(staged(entered, "entered"), "block").groupBy("block").applyInArrow(cut, f"block long, tenant {kinds['tenant']}, id {kinds['id']}, local long"), "cuts")
    most = done.groupBy("tenant", "block").agg(F.max("local").alias("n"))
    before = most.select("tenant", "block", F.coalesce(F.sum("n").over(Window.partitionBy("tenant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    b = before.withColumnsRenamed({"tenant": "_t", "block": "_b"})
    return done.join(b, F.col("tenant").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_b"))).select("tenant", "id", (F.col("local") + F.col("before") - 1).alias("request"))


def _blocks(sizes: list[tuple[int, int]], least: int) -> list[tuple[int, int, int, int]]:
    """(part, block, place of the part in it, rows of the block before) of consecutive parts put together until a block has more than ``least`` rows."""
    out, block, held, before = [], 0, 0, 0
    for part, n in sizes:
        if held > least:
            block, held, before = block + 1, 0, held
        out.append((part, block, held, before))
        held += n
    return out


def tenant_batches(rows: DataFrame, max_events: int) -> DataFrame:
    """``rows`` (tenant, at, id) with ``batch``: consecutive batches of at most ``max_events`` per tenant."""
    w = Window.partitionBy("tenant").orderBy("at", "id")
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / max_events).cast("long"))
