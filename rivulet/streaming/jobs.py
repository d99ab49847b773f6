"""Streaming forms of the batch operators.

Each takes a streaming frame; state is bounded by a watermark or a time to live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dlq
from ..operators.program import Ingested
from ..operators.ratelimit import Bucket
from ..staging import staged, unstage
from .commits import Log


def ingest(requests: DataFrame, run: Callable[[DataFrame, DataFrame | None], Ingested], path: str, checkpoint: str, trigger: dict | None = None):
    """Run a stream of whole requests through ``run``, the ingest program with its dimensions, into the commit log at ``path``.

    Requests come whole, so that no batch's elements fall into two micro-batches.  ``run`` takes the requests and the token buckets as
    the last committed epoch left them; the buckets afterwards are committed with the rows, so a retried or restarted
    micro-batch starts from the same tokens.
    """
    log = Log(requests.sparkSession, path)
    return requests.writeStream.foreachBatch(lambda batch, epoch: commit_epoch(batch, run, log, epoch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def commit_epoch(batch: DataFrame, run: Callable[[DataFrame, DataFrame | None], Ingested], log: Log, epoch: int) -> None:
    """Commit ``letters``, ``published``, ``responses`` and ``buckets`` of one micro-batch, or nothing of it.

    A micro-batch whose account does not balance fails: each event that a response calls accepted is published, each that it calls rejected
    is a letter.  One that was committed before is not run again.  What the program staged is deleted either way.
    """
    if log.has(epoch):
        return
    got = run(batch, log.last("buckets", before=epoch))
    try:
        log.write(epoch, {"letters": dlq.letter_records(got.letters), "published": got.published, "responses": got.responses, "buckets": got.state}, balanced)
    finally:
        got.close()


def balanced(there: dict[str, DataFrame]) -> None:
    """Raise if the responses name other numbers of accepted and rejected events than were written."""
    said = there["responses"].agg(F.coalesce(F.sum("accepted"), F.lit(0)), F.coalesce(F.sum(F.size("rejected")), F.lit(0))).first()
    wrote = there["published"].count(), there["letters"].count()
    if tuple(said) != wrote:
        raise RuntimeError(f"responses name {tuple(said)} accepted and rejected events, {wrote} were written")


class _TokenBuckets(StatefulProcessor):
    """One bucket for each tenant, kept as its tokens and the time of its last request."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, last double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a tenant's narrow rows of one micro-batch, which the source's trigger bounds
        x = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.bucket.get() if self.bucket.exists() else (None, float(x["at"].iloc[0]))
        bucket = Bucket(key[0], float(x.rate.iloc[0]), float(x.burst.iloc[0]), held[0], held[1])
        took = [bucket.take(float(at), int(n)) for at, n in zip(x["at"], x.n, strict=True)]
        self.bucket.update((bucket.tokens, bucket.last))
        yield pd.DataFrame({"tenant": key[0], "id": x.id.to_numpy(), "allowed": [t[0] for t in took], "retry_after": pd.array([t[1] for t in took], "Int64")})

    def close(self) -> None:
        pass


def token_buckets(charges: DataFrame, limits: DataFrame, default: tuple[float, float]) -> DataFrame:
    """(tenant, id, allowed, retry_after) of a stream of charges (tenant, at seconds, id, n) under buckets that last from micro-batch to micro-batch.

    State is two numbers per tenant, in the RocksDB store, which the session has to name in ``spark.sql.streaming.stateStore.providerClass``.  In a
    micro-batch a tenant's charges count in the order of at, then id; micro-batches count as they come.
    """
    lim = limits.select("tenant", F.col("rate").cast("double").alias("rate"), F.col("burst").cast("double").alias("burst"))
    x = charges.select("tenant", F.col("at").cast("double").alias("at"), "id", F.col("n").cast("long").alias("n")).join(F.broadcast(lim), "tenant", "left")
    x = x.withColumns({"rate": F.coalesce("rate", F.lit(default[0])), "burst": F.coalesce("burst", F.lit(default[1]))})
    out = f"tenant string, id {x.schema['id'].dataType.simpleString()}, allowed boolean, retry_after long"
    return x.groupBy("tenant").transformWithStateInPandas(_TokenBuckets(), out, "append", "None")


def timely(events: DataFrame, path: str, checkpoint: str, late_seconds: int, trigger: dict | None = None):
    """Commit a stream's ``timely`` rows and, apart, those ``late`` ones that lie behind the watermark, so that none is lost uncounted.

    The watermark of a micro-batch is the greatest ``ts`` of the epochs before, less ``late_seconds``; it is committed with the rows as ``clock`` (ts, timely, late).
    """
    log = Log(events.sparkSession, path)

    def write(batch: DataFrame, epoch: int) -> None:
        before = log.last("clock", before=epoch)
        high = before.first().ts if before is not None else None
        mark = F.lit(None).cast("timestamp") if high is None else F.lit(high) - F.expr(f"interval {late_seconds} seconds")
        flagged = batch.withColumn("_late", F.coalesce(F.col("ts") < mark, F.lit(False)))
        clock = flagged.agg(F.greatest(F.max("ts"), F.lit(high).cast("timestamp")).alias("ts"), F.count_if(~F.col("_late")).alias("timely"), F.count_if("_late").alias("late"))
        log.write(epoch, {"timely": flagged.where(~F.col("_late")).drop("_late"), "late": flagged.where("_late").drop("_late"), "clock": clock})

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """First row per (source, id) within the watermark of ``ts``."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "id"])


def rate_view(events: DataFrame, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(start, accepted, rejected, dlq) of each stretch of time, from events (ts, accepted, and dlq: written as a dead letter)."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"))
    dlq_ = F.count_if("dlq") if "dlq" in events.columns else F.count_if(F.lit(False))
    return w.agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), dlq_.alias("dlq")).select("w.start", "accepted", "rejected", "dlq")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Closed sessions with what an abandonment check needs: they come out once the watermark passes their gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    found = g.agg(F.count("*").alias("n"), F.max(F.col("type") == "application-started").alias("started"), F.max(F.col("type").isin("application-submitted", "application-draft-saved")).alias("ended"))
    return found.select("user_id", "w.start", F.col("w.end").alias("end"), "n", (F.col("started") & ~F.col("ended")).alias("abandoned"))


def ordering_monitor(events: DataFrame, keep_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """(source, user_ref, violations, unchecked, evicted) per key and micro-batch.

    State is the highest number seen for a key.  A key is evicted once the watermark of ``ts`` is ``keep_ms`` past
    its last event, so state is bounded by activity, a replay evicts alike, and a bounded stream ends.
    """

    def check(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"source": [key[0]], "user_ref": [key[1]], "violations": [0], "unchecked": [0], "evicted": [1]})
            return
        high, last = state.get if state.exists else (None, 0)
        # one key's rows of one micro-batch, which the source's trigger bounds; only four narrow columns are kept
        rows = pd.concat([b[["partition", "offset", "seq", "ts"]] for b in batches]).sort_values(["partition", "offset"])
        late_ones = unchecked = 0
        for seq in rows.seq:
            if pd.isna(seq):
                unchecked += 1
                continue
            late_ones += high is not None and seq < high
            high = int(seq) if high is None else max(high, int(seq))
        last = max(last, int(rows.ts.max().timestamp() * 1000))
        state.update((high, last))
        state.setTimeoutTimestamp(max(last + keep_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source": [key[0]], "user_ref": [key[1]], "violations": [int(late_ones)], "unchecked": [unchecked], "evicted": [0]})

    keyed = events.withWatermark("ts", late).groupBy("source", "user_ref")
    return keyed.applyInPandasWithState(check, "source string, user_ref string, violations long, unchecked long, evicted long", "high long, last long", "append", GroupStateTimeout.EventTimeTimeout)


class _Window(StatefulProcessor):
    """High-water numbers of at most ``cap`` pairs, the oldest ones leaving first.

    A pair keeps its place in the queue while it is there, so the queue is a run of numbers without holes: head and tail.
    """

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.high = handle.getMapState("high", "source string, user_ref string", "seq long")
        self.queue = handle.getMapState("queue", "place long", "source string, user_ref string")
        self.ends = handle.getValueState("ends", "head long, tail long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one hash partition's narrow rows of one micro-batch, which the source's trigger bounds
        x = pd.concat([b[["source", "user_ref", "partition", "offset", "seq"]] for b in rows]).sort_values(["partition", "offset"])
        head, tail = self.ends.get() if self.ends.exists() else (0, 0)
        known: dict[tuple, int | None] = {}  # what this micro-batch touched; None: not there
        late = unchecked = evicted = 0
        for pair, seq in zip(zip(x.source, x.user_ref, strict=True), x.seq, strict=True):
            if pd.isna(seq):
                unchecked += 1
                continue
            if pair not in known:
                known[pair] = self.high.getValue(pair)[0] if self.high.containsKey(pair) else None
            if known[pair] is None:
                self.queue.updateValue((tail,), pair)
                tail += 1
            elif seq <= known[pair]:
                late += seq < known[pair]
                continue
            known[pair] = int(seq)
            while tail - head > self.cap:
                oldest = tuple(self.queue.getValue((head,)))
                self.queue.removeKey((head,))
                known[oldest] = None
                head, evicted = head + 1, evicted + 1
        for pair, seq in known.items():
            if seq is not None:
                self.high.updateValue(pair, (seq,))
            elif self.high.containsKey(pair):
                self.high.removeKey(pair)
        self.ends.update((head, tail))
        yield pd.DataFrame({"slot": [key[0]], "violations": [int(late)], "unchecked": [unchecked], "evicted": [evicted], "held": [tail - head]})

    def close(self) -> None:
        pass


def bounded_monitor(events: DataFrame, cap: int = 100_000, slots: int = 64) -> DataFrame:
    """(slot, violations, unchecked, evicted, held) for each micro-batch, of at most ``cap`` pairs of source and user_ref.

    Pairs are dealt out by hash to ``slots``, each of which holds at most ``cap // slots`` of them and evicts the one that it has held longest; a
    pair that is seen again does not get younger.  Evictions can only hide violations.  State is in the RocksDB store, which
    the session has to name.
    """
    x = events.select("source", "user_ref", "partition", "offset", "seq", F.pmod(F.xxhash64("source", "user_ref"), F.lit(slots)).alias("slot"))
    return x.groupBy("slot").transformWithStateInPandas(_Window(max(1, cap // slots)), "slot long, violations long, unchecked long, evicted long, held long", "append", "None")


def unique(events: DataFrame, path: str, checkpoint: str, buckets: int = 64, bits: int = 1 << 17, trigger: dict | None = None):
    """Commit the first row of each (source, id) of a stream as ``unique``, however long ago the key was seen first.

    Keys that were seen lie in ``seen``, by bucket of their hash; each bucket has a Bloom filter of ``bits`` bits, committed as ``filters``.
    Only keys that pass their filter are looked up, and only in the buckets that these are in, so new keys cost no join.  Of the rows of one
    micro-batch with one key the least ``ts`` counts.
    """
    log = Log(events.sparkSession, path)

    def write(batch: DataFrame, epoch: int) -> None:
        if log.has(epoch):
            return
        key = ["source", "id"]
        first = batch.groupBy(*key).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in key]), "ts").alias("_r")).select(*key, "_r.*").withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        first = staged(first, "first")
        old, seen = log.last("filters", before=epoch), log.read("seen", before=epoch)
        fresh = first
        if seen is not None:
            maybe = staged(_passed(first, old, bits), "maybe")
            where = [r["_bucket"] for r in maybe.select("_bucket").distinct().collect()]  # at most ``buckets``
            again = maybe.join(seen.where(F.col("_bucket").isin(where)), ["_bucket", *key], "left_semi").select(*key)
            fresh = first.join(staged(again, "again"), key, "left_anti")
        fresh = staged(fresh, "fresh")
        try:
            log.write(epoch, {"unique": fresh.drop("_bucket"), "seen": fresh.select("_bucket", *key).repartition("_bucket").sortWithinPartitions("_bucket"), "filters": _filters(fresh, old, bits)})
        finally:
            for x in (first, fresh):
                unstage(x)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _places(bits: int) -> list:
    """Three places of a key in a filter."""
    return [F.pmod(F.xxhash64("source", "id", F.lit(i)), F.lit(bits)).cast("int") for i in range(3)]


def _filters(keys: DataFrame, old: DataFrame | None, bits: int) -> DataFrame:
    """(_bucket, filter): one bitmap for each bucket, with the bits of ``old``."""
    new = keys.select("_bucket", F.explode(F.array(*_places(bits))).alias("place")).groupBy("_bucket").agg(F.collect_set("place").alias("places"))  # at most ``bits`` places
    both = new.withColumn("filter", F.lit(None).cast("binary")) if old is None else new.join(old, "_bucket", "full")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for places, held in zip(b.places, b["filter"], strict=True):
                bitmap = np.zeros(bits, np.uint8) if held is None else np.unpackbits(np.frombuffer(held, np.uint8), count=bits)
                if places is not None:
                    bitmap[np.asarray(places, np.int64)] = 1
                out.append(np.packbits(bitmap).tobytes())
            yield pd.DataFrame({"_bucket": b["_bucket"], "filter": out})

    return both.select("_bucket", "places", "filter").mapInPandas(run, "_bucket int, filter binary")


def _passed(keys: DataFrame, filters: DataFrame, bits: int) -> DataFrame:
    """Keys whose places are all set in the filter of their bucket; the filters, buckets x bits / 8 bytes, go to every executor once."""
    shared = keys.sparkSession.sparkContext.broadcast({r["_bucket"]: bytes(r["filter"]) for r in filters.collect()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmaps = {k: np.unpackbits(np.frombuffer(v, np.uint8), count=bits) for k, v in shared.value.items()}
        for b in batches:
            there = np.zeros(len(b), bool)
            for bucket, at in b.groupby("_bucket").indices.items():
                if bucket in bitmaps:
                    there[at] = np.all([bitmaps[bucket][b[f"p{i}"].to_numpy()[at]] for i in range(3)], axis=0)
            yield b.loc[there, ["_bucket", "source", "id"]]

    x = keys.select("_bucket", "source", "id", *[p.alias(f"p{i}") for i, p in enumerate(_places(bits))])
    return x.mapInPandas(run, "_bucket int, source string, id string")


def abandonment(events: DataFrame, gap_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """(user_id, last, n) of each user who started an application and then was silent for ``gap_ms`` without submitting or saving it.

    An event-time timer of the last event decides; events behind the watermark are dropped by it and come in no count.
    """

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, ended, last, n = state.get
            state.remove()
            if started and not ended:
                yield pd.DataFrame({"user_id": [key[0]], "last": [last], "n": [n]})
            return
        started, ended, last, n = state.get if state.exists else (False, False, 0, 0)
        for b in batches:
            started |= bool((b.type == "application-started").any())
            ended |= bool(b.type.isin(["application-submitted", "application-draft-saved"]).any())
            last = max(last, int(b.ts.max().timestamp() * 1000))
            n += len(b)
        state.update((started, ended, last, n))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))

    keyed = events.withWatermark("ts", late).groupBy("user_id")
    return keyed.applyInPandasWithState(follow, "user_id long, last long, n long", "started boolean, ended boolean, last long, n long", "append", GroupStateTimeout.EventTimeTimeout)
