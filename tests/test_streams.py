"""Streams: token buckets and whole ingests over several micro-batches, atomic commits, rows behind the watermark."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from rivulet.operators import program, ratelimit
from rivulet.streaming import jobs
from rivulet.streaming.commits import Log

from .test_operators import _requests


def in_files(df, path, *order, parts):
    """``df`` cut into ``parts`` files in some order, which a stream reads one by one."""
    rows = df.orderBy(*order).collect()
    os.makedirs(path, exist_ok=True)
    for k in range(parts):
        df.sparkSession.createDataFrame(rows[len(rows) * k // parts : len(rows) * (k + 1) // parts], df.schema).coalesce(1).write.parquet(f"{path}/new")
        (made,) = glob.glob(f"{path}/new/part-*")
        os.rename(made, f"{path}/{k:03d}.parquet")
        os.utime(f"{path}/{k:03d}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
        for f in glob.glob(f"{path}/new/*") + glob.glob(f"{path}/new/.*.crc"):
            os.remove(f)
        os.rmdir(f"{path}/new")


def streamed(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


KEYS = lambda x: sorted(map(tuple, x.select("batch_id", "idx", "key").collect()))
TOLD = lambda x: sorted((r.batch_id, r.status, r.why, r.retry_after, r.accepted, len(r.rejected)) for r in x.collect())


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    from rivulet.plans import ingest

    requests, _ = _requests(spark)
    run = lambda b, state=None: program.ingest(b, *ingest._dimensions(spark), ingest._keys(spark), ingest._limits(spark), (0.00001, 4.0), max_bytes=2000, state=state)
    path = str(tmp_path_factory.mktemp("r") / "all")
    requests.write.parquet(path)
    requests = spark.read.parquet(path)
    got = run(requests)
    return requests, run, KEYS(got.published), TOLD(got.responses), got.letters.count()


@pytest.mark.parametrize("parts", [1, 3])
def test_ingest_in_several_micro_batches(spark, tmp_path, whole, parts):
    requests, run, keys, told, letters = whole
    assert any(t[1] == 429 for t in told) and letters > 20
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    in_files(requests, src, "at", "batch_id", parts=parts)
    if parts > 1:  # the stream stops after the first files and starts again
        held = sorted(glob.glob(f"{src}/*.parquet"))[1:]
        put_off = str(tmp_path / "held")
        os.mkdir(put_off)
        for f in held:
            os.rename(f, f"{put_off}/{os.path.basename(f)}")
        assert jobs.ingest(streamed(spark, requests, src), run, out, cp).awaitTermination(300)
        for f in held:
            os.rename(f"{put_off}/{os.path.basename(f)}", f)
    assert jobs.ingest(streamed(spark, requests, src), run, out, cp).awaitTermination(300)
    log = Log(spark, out)
    assert log.epochs() == list(range(parts)) and log.sweep() == 0
    assert KEYS(log.read("published")) == keys and TOLD(log.read("responses")) == told and log.read("letters").count() == letters


def test_nothing_of_a_failed_epoch_is_visible(spark, tmp_path, whole):
    requests, run, keys, _, _ = whole
    log = Log(spark, str(tmp_path / "out"))
    staged = lambda: set(glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/staged-*"))
    before = staged()

    def short(batch, state):
        got = run(batch, state)
        got.published = got.published.limit(3)
        return got

    with pytest.raises(RuntimeError, match="were written"):
        jobs.commit_epoch(requests, short, log, 0)
    assert log.epochs() == [] and log.read("published") is None and staged() == before

    # a driver that dies between two writes leaves folders that no manifest names
    got = run(requests)
    got.published.write.parquet(f"{log.path}/published/000000000000-dead")
    assert log.read("published") is None and log.sweep() == 1
    got.close()

    jobs.commit_epoch(requests, run, log, 0)
    there = json.dumps(log.manifests())
    jobs.commit_epoch(requests, lambda *_: pytest.fail("it was committed"), log, 0)
    assert not log.write(0, {}) and json.dumps(log.manifests()) == there and KEYS(log.read("published")) == keys
    # neither plain requests nor anything else that was staged on the way is left
    assert staged() == before


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_buckets_last_from_micro_batch_to_micro_batch(spark, tmp_path, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = spark.range(900).select(F.concat(F.lit("t"), F.col("id") % 7).alias("tenant"), (F.col("id") / 9).alias("at"), F.concat(F.lit("req-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("id"), (F.col("id") % 4 + 1).alias("n"))
    limits = spark.createDataFrame([("t1", 0.5, 4.0), ("t2", 100.0, 50.0)], "tenant string, rate double, burst double")
    want = ratelimit.token_buckets(rows, limits, (2.0, 6.0))
    src, cp, out = (str(tmp_path / n) for n in ("in", "cp", "out"))
    in_files(rows, src, "at", "id", parts=parts)
    try:
        late, put_off = f"{src}/002.parquet", str(tmp_path / "002.parquet")
        if parts == 3:  # the stream stops before the last file and starts again
            os.rename(late, put_off)
        for _ in range(2 if parts == 3 else 1):
            q = jobs.token_buckets(streamed(spark, rows, src), limits, (2.0, 6.0)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
            assert q.awaitTermination(300)
            if os.path.exists(put_off):
                os.rename(put_off, late)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    told = lambda x: sorted((r.tenant, r.id, r.allowed, r.retry_after) for r in x.collect())
    got = told(spark.read.parquet(out))
    assert got == told(want) and {g[2] for g in got} == {True, False}
    # the same fold in parts, with the state between them
    state = None
    parts_ = []
    for lo, hi in ((0, 20), (20, 55), (55, 200)):
        d = ratelimit.token_buckets(rows.where(f"at >= {lo} and at < {hi}"), limits, (2.0, 6.0), state)
        parts_ += told(d)
        state = spark.createDataFrame(ratelimit.closing_state(d, state).collect(), "tenant string, tokens double, last double")
    assert sorted(parts_) == told(want) and state.count() == 7


def test_buckets_refuse_limits_that_are_none(spark):
    rows = spark.createDataFrame([("t", 0.0, "a", 1)], "tenant string, at double, id string, n long")
    none = spark.createDataFrame([], "tenant string, rate double, burst double")
    for default in ((0.0, 5.0), (1.0, 0.5)):
        with pytest.raises(ValueError, match="rate must be"):
            ratelimit.token_buckets(rows, none, default)
    with pytest.raises(Exception, match="rate must be > 0 and burst >= 1 for t"):
        ratelimit.token_buckets(rows, spark.createDataFrame([("t", 0.0, 5.0)], none.schema), (1.0, 1.0)).collect()


def test_late_rows_are_kept_apart(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.range(300).select("id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 10 - F.when(F.col("id") % 50 == 49, 900).otherwise(0)).alias("ts"))
    in_files(rows, src, "id", parts=4)
    assert jobs.timely(streamed(spark, rows, src), out, str(tmp_path / "cp"), 120).awaitTermination(200)
    log = Log(spark, out)
    timely, late, clock = (log.read(n) for n in ("timely", "late", "clock"))
    ids = lambda x: {r.id for r in x.collect()}
    assert ids(timely) | ids(late) == set(range(300)) and timely.count() + late.count() == 300
    assert {99, 149, 199, 249, 299} <= ids(late) and 49 in ids(timely)
    assert clock.agg(F.sum("timely"), F.sum("late")).first() == (timely.count(), late.count())


def test_the_oldest_pairs_leave_a_full_window(spark, tmp_path):
    import random

    r = random.Random(6)
    rows = [("s", f"u{int(r.paretovariate(0.7)) % 60}", 0, k, None if r.random() < 0.05 else r.randrange(40)) for k in range(700)]
    df = spark.createDataFrame(rows, "source string, user_ref string, partition int, offset long, seq long")
    src, out, cap, slots = str(tmp_path / "in"), str(tmp_path / "out"), 24, 3
    in_files(df, src, "offset", parts=4)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = jobs.bounded_monitor(streamed(spark, df, src), cap, slots).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    slot = {x.user_ref: x.slot for x in df.select("user_ref", F.pmod(F.xxhash64("source", "user_ref"), F.lit(slots)).alias("slot")).distinct().collect()}
    want = {k: [0, 0, 0, {}] for k in range(slots)}
    for _, user, _, _, seq in rows:  # a plain window for each slot
        w = want[slot[user]]
        if seq is None:
            w[1] += 1
        elif user in w[3] and seq <= w[3][user]:
            w[0] += seq < w[3][user]
        else:
            w[3][user] = seq
            if len(w[3]) > cap // slots:
                del w[3][next(iter(w[3]))]
                w[2] += 1
    got = spark.read.parquet(out).groupBy("slot").agg(F.sum("violations"), F.sum("unchecked"), F.sum("evicted"), F.max("held")).collect()
    assert {g[0]: list(g[1:4]) for g in got} == {k: w[:3] for k, w in want.items()} and max(g[4] for g in got) <= cap // slots
    assert sum(w[2] for w in want.values()) > 10 and sum(w[0] for w in want.values()) > 10


def test_keys_stay_unique_over_days(spark, tmp_path):
    rows = spark.range(400).select(F.lit("s").alias("source"), F.concat(F.lit("k"), F.col("id") % 170 + F.when(F.col("id") % 3 == 0, 1000).otherwise(0)).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("ts"), F.col("id").alias("n"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    in_files(rows, src, "ts", parts=4)
    held = f"{src}/003.parquet"
    os.rename(held, str(tmp_path / "later"))
    for bits in (64, 64):  # filters so small that most keys pass them, and a restart
        assert jobs.unique(streamed(spark, rows, src), out, str(tmp_path / "cp"), buckets=4, bits=bits).awaitTermination(300)
        if os.path.exists(str(tmp_path / "later")):
            os.rename(str(tmp_path / "later"), held)
    want = sorted(map(tuple, rows.groupBy("source", "id").agg(F.min("ts"), F.min("n")).collect()))
    log = Log(spark, out)
    assert sorted(map(tuple, log.read("unique").select("source", "id", "ts", "n").collect())) == want and len(log.epochs()) == 4
    assert log.read("seen").count() == len(want) and log.last("filters").count() == 4


def test_a_topic_is_read_by_offsets(spark, tmp_path):
    from rivulet.sources import topics

    path = "file://" + str(tmp_path / "topic")
    make = lambda lo, hi: spark.range(lo, hi).select((F.col("id") % 3).cast("int").alias("partition"), F.floor(F.col("id") / 3).alias("offset"), F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("string").cast("binary").alias("value"))
    topics.write(make(0, 300).where("offset <> 40 or partition <> 1"), path)
    offsets = lambda df: {p: sorted(r.offset for r in df.where(F.col("partition") == p).collect()) for p in range(3)}
    assert topics.read(spark, path).count() == 299 and sorted(map(tuple, topics.held(spark, path).collect())) == [(0, 0, 100), (1, 0, 100), (2, 0, 100)]
    part = topics.read(spark, path, {0: 90, 2: 5}, {1: 3, 2: 7})
    assert offsets(part) == {0: list(range(90, 100)), 1: [0, 1, 2], 2: [5, 6]}
    told = {r.partition: (r.low, r.end, r.read_to, r.gaps, r.drained) for r in topics.drained(topics.read(spark, path, stop={2: 50}), topics.held(spark, path)).collect()}
    assert told == {0: (0, 100, 100, 0, True), 1: (0, 100, 100, 1, True), 2: (0, 100, 50, 0, False)}
    run = lambda: topics.stream(spark, path, {0: 50}).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    assert run()
    topics.write(make(300, 360), path)
    assert run()
    got = offsets(spark.read.parquet(str(tmp_path / "out")))
    assert got == {0: list(range(50, 120)), 1: [k for k in range(120) if k != 40], 2: list(range(120))}
    assert topics.read(spark, "file://" + str(tmp_path / "none")).count() == 0
