"""The event table as contract events, requests, ledger and topic.

The table holds clicks, views and purchases; here they become events of twenty
tenants with known faults, so that every verdict and imbalance occurs.  ``SQL``
says the same for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S

TENANTS = [f"tenant_{i:04d}" for i in range(20)]
TYPES = {"view": "job-viewed", "click": "application-started", "signup": "user-registered", "purchase": "application-submitted", "error": "error"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingress(events: DataFrame) -> DataFrame:
    """One row per event: its request (tenant and day), its place there, and the fields that it sends."""
    e = events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.concat(F.lit("tenant_"), F.lpad((F.col("user_id") % 20).cast("string"), 4, "0")).alias("tenant"),
        (F.col("user_id") % 20 * 100000 + F.datediff("ts", F.lit("1970-01-01").cast("date"))).alias("batch_id"),
        F.element_at(F.array(*map(F.lit, S.CHANNELS)), (F.col("user_id") % 3 + 1).cast("int")).alias("channel"),
    )
    in_batch, of_user = Window.partitionBy("batch_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    e = e.withColumns({
        "idx": (F.row_number().over(in_batch) - 1).cast("long"),
        "seq": (F.row_number().over(of_user) - 1).cast("long"),
        "prev": F.lag("event_id").over(in_batch),
    })
    return e.select(
        "event_id", "ts", "user_id", "event_type", "value", "tenant", "batch_id", "channel", "idx", "seq",
        F.concat(F.lit("/careers/"), "tenant").alias("source"),
        F.when(F.col("event_id") % 47 == 7, "").when((F.col("event_id") % 53 == 8) & F.col("prev").isNotNull(), F.concat(F.lit("ev-"), "prev")).otherwise(F.concat(F.lit("ev-"), "event_id")).alias("id"),
        F.concat(F.lit(S.PREFIX), kind[F.col("event_type")]).alias("type"),
        F.when(F.col("event_id") % 41 == 5, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("time"),
        (F.col("event_id") % 43 == 6).alias("extra"),
        F.lpad(F.col("seq").cast("string"), 10, "0").alias("sequence"),
        F.concat(F.lit("usr_"), "user_id").alias("user_ref"),
    )


def raw_elements(rows: DataFrame, long_names: bool = False) -> DataFrame:
    """(batch_id, idx, event_id, raw): each event as the JSON that its request carries; with ``long_names`` some candidates have one of 1,500 letters."""
    envelope = [F.lit("1.0").alias("specversion"), "id", "source", "type", "time", F.col("channel").alias("sourcechannel"), "sequence"]
    data = F.struct(
        F.struct(F.col("user_ref").alias("user_id"), F.concat("user_ref", F.lit("@example.invalid")).alias("email"), *([F.when(F.col("event_id") % 29 == 1, F.repeat(F.lit("n"), 1500)).alias("name")] if long_names else [])).alias("candidate"),
        F.struct(F.concat(F.lit("job_"), (F.col("event_id") % 97)).alias("job_id"), F.concat(F.lit("sess_"), "user_id").alias("session_id"), (F.col("event_id") % 5 + 1).alias("step_number")).alias("event_payload"),
    ).alias("data")
    return rows.select("batch_id", "idx", "event_id", F.to_json(F.struct(*envelope, F.when(F.col("extra"), "1").alias("shadow"), data)).alias("raw"))


def requests(rows: DataFrame, long_names: bool = False) -> DataFrame:
    """(batch_id, body): whole request bodies, elements in order."""
    e = raw_elements(rows, long_names).groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("x"))
    return e.select("batch_id", F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y["raw"]), ","), F.lit("]")).alias("body"))


def ledger(rows: DataFrame) -> DataFrame:
    """What was sent: one row per event, some of them twice."""
    sent = rows.select("id", "source", "type", "tenant", "user_ref", "seq", "event_id")
    return sent.unionByName(sent.where("event_id % 101 = 3"))


def topic(rows: DataFrame) -> DataFrame:
    """What was stored: lost, repeated, foreign and renumbered events included; offsets out of order."""
    ok = rows.where("event_id % 97 <> 0 and event_id % 7 <> 1").select("id", "source", "type", "user_ref", "seq", "event_id", (F.col("user_id") % 12).cast("int").alias("partition"))
    ok = ok.withColumn("seq", F.when(F.col("event_id") % 83 == 0, F.col("seq") + 1).when(F.col("event_id") % 79 == 0, F.lit(None)).otherwise(F.col("seq")))
    more = ok.where("event_id % 89 = 0").withColumn("copy", F.lit(1))
    alien = ok.where("event_id % 91 = 0").withColumns({"id": F.concat(F.lit("x-"), "id"), "copy": F.lit(2)})
    all_ = ok.withColumn("copy", F.lit(0)).unionByName(more).unionByName(alien)
    w = Window.partitionBy("partition").orderBy((F.col("event_id") * 7919) % 10007, "event_id", "copy")
    return all_.withColumn("offset", (F.row_number().over(w) - 1).cast("long"))


def topic_records(top: DataFrame) -> DataFrame:
    """``topic`` rows as stored records (partition, offset, value); the values of some are cut short."""
    value = F.to_json(F.struct("source", "id", "type", F.lpad(F.col("seq").cast("string"), 10, "0").alias("sequence")))
    return top.select("partition", "offset", F.when(F.col("event_id") % 211 == 0, F.substring(value, 1, 25)).otherwise(value).cast("binary").alias("value"))


def dead_letters(rows: DataFrame) -> DataFrame:
    """What was rejected: (source, reason, rejected_source, rejected_id, rejected_type)."""
    bad = rows.where("event_id % 7 = 1")
    code = F.element_at(F.array(*map(F.lit, ["SCHEMA", "BAD_TIME", "UNKNOWN_ATTRIBUTE", "STRANGE"])), (F.col("event_id") % 4 + 1).cast("int"))
    return bad.select("source", F.concat(code, F.lit(": at $["), F.col("idx"), F.lit("]")).alias("reason"), F.when(F.col("event_id") % 5 > 0, F.col("source")).alias("rejected_source"), F.when(F.col("event_id") % 5 > 0, F.col("id")).alias("rejected_id"), F.when(F.col("event_id") % 5 > 0, F.col("type")).alias("rejected_type"))


SQL = """
e0 AS (
  SELECT event_id, ts, user_id, event_type, value,
    'tenant_' || lpad((user_id % 20)::VARCHAR, 4, '0') AS tenant,
    user_id % 20 * 100000 + date_diff('day', DATE '1970-01-01', ts::DATE) AS batch_id,
    CASE user_id % 3 WHEN 0 THEN 'WEB_APP' WHEN 1 THEN 'MOBILE_APP' ELSE 'THIRD_PARTY_SERVICE' END AS channel
  FROM events),
e1 AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts, event_id) - 1 AS idx,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
    lag(event_id) OVER (PARTITION BY batch_id ORDER BY ts, event_id) AS prev FROM e0),
ing AS (
  SELECT event_id, ts, user_id, event_type, value, tenant, batch_id, channel, idx, seq, '/careers/' || tenant AS source,
    CASE WHEN event_id % 47 = 7 THEN '' WHEN event_id % 53 = 8 AND prev IS NOT NULL THEN 'ev-' || prev ELSE 'ev-' || event_id END AS id,
    'com.careerpage.career.' || CASE event_type WHEN 'view' THEN 'job-viewed' WHEN 'click' THEN 'application-started' WHEN 'signup' THEN 'user-registered' WHEN 'purchase' THEN 'application-submitted' ELSE 'error' END AS type,
    CASE WHEN event_id % 41 = 5 THEN 'yesterday' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS time,
    event_id % 43 = 6 AS extra, lpad(seq::VARCHAR, 10, '0') AS sequence, 'usr_' || user_id AS user_ref
  FROM e1),
v0 AS (
  SELECT *, CASE WHEN extra THEN 'UNKNOWN_ATTRIBUTE' WHEN event_type = 'error' THEN 'SCHEMA' WHEN time = 'yesterday' THEN 'BAD_TIME' WHEN id = '' THEN 'BAD_ID' END AS c0 FROM ing),
v1 AS (
  SELECT *, CASE WHEN c0 IS NOT NULL THEN c0 WHEN row_number() OVER (PARTITION BY batch_id, source, id, c0 IS NULL ORDER BY idx) > 1 THEN 'DUPLICATE_ID' END AS code FROM v0),
ver AS (
  SELECT *, code || CASE code WHEN 'UNKNOWN_ATTRIBUTE' THEN ' at $[' || idx || ']: shadow' WHEN 'SCHEMA' THEN ' at $.type' WHEN 'BAD_TIME' THEN ' at $.time' ELSE ' at $.id' END AS reason FROM v1),
led AS (SELECT id, source, type, tenant, user_ref, seq, event_id FROM ing UNION ALL SELECT id, source, type, tenant, user_ref, seq, event_id FROM ing WHERE event_id % 101 = 3),
t0 AS (
  SELECT id, source, type, user_ref, event_id, (user_id % 12)::INT AS part,
    CASE WHEN event_id % 83 = 0 THEN seq + 1 WHEN event_id % 79 = 0 THEN NULL ELSE seq END AS seq
  FROM ing WHERE event_id % 97 <> 0 AND event_id % 7 <> 1),
t1 AS (SELECT *, 0 AS copy FROM t0 UNION ALL SELECT *, 1 FROM t0 WHERE event_id % 89 = 0
  UNION ALL SELECT 'x-' || id, source, type, user_ref, event_id, part, seq, 2 FROM t0 WHERE event_id % 91 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY (event_id * 7919) % 10007, event_id, copy) - 1 AS off FROM t1),
dlq AS (
  SELECT source, CASE event_id % 4 WHEN 0 THEN 'SCHEMA' WHEN 1 THEN 'BAD_TIME' WHEN 2 THEN 'UNKNOWN_ATTRIBUTE' ELSE 'STRANGE' END AS code,
    CASE WHEN event_id % 5 > 0 THEN source END AS rsource, CASE WHEN event_id % 5 > 0 THEN id END AS rid, CASE WHEN event_id % 5 > 0 THEN type END AS rtype
  FROM ing WHERE event_id % 7 = 1)
"""
