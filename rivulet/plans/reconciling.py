"""Queries on ledger, topic, dead letters, order and receipts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import crypto, text
from ..operators import metrics, reconcile, summaries
from ..sources import adapt, readers, sinks, topics
from ..staging import shared_dir, staged
from .ingest import _MASTER, _key_values, _rows, _sql


def _sides(spark, d):
    r = _rows(spark, d)
    return adapt.ledger(r), adapt.topic(r), adapt.dead_letters(r)


def _found(spark, d):
    return reconcile.presence(*_sides(spark, d))


def _staged_sides(spark, d):
    """Ledger, topic and dead letters, derived once, with pseudonyms."""
    r = staged(_rows(spark, d), "events")
    keys = F.broadcast(crypto.key_dimension(spark, _MASTER, adapt.TENANTS))
    led = adapt.ledger(r).join(keys, "tenant").withColumn("expected", crypto.pseudonym(F.col("user_ref"))).drop("enc_key", "ipad", "opad")
    top = adapt.topic(r).withColumn("tenant", text.tenant_of(F.col("source"))).join(keys, "tenant")
    top = top.withColumn("user_pseudo", crypto.pseudonym(F.when(F.col("event_id") % 73 == 0, F.concat("user_ref", F.lit("?"))).otherwise(F.col("user_ref")))).drop("enc_key", "ipad", "opad")
    return staged(led, "ledger"), staged(top, "topic"), staged(adapt.dead_letters(r), "letters")


def reconcile_summary(spark, d):
    led, top, dead = _staged_sides(spark, d)
    records = adapt.topic_records(top)
    broken = readers.decode_events(records).where("not decoded").agg(F.count("*").alias("n"))
    ends = readers.drained(top, spark.createDataFrame([(p, 10**9 if p == 5 else 1) for p in range(12)], "partition int, end long"))
    x = reconcile.summary(led, top, dead, text.code_of(F.col("reason")), "event_id", ends, broken, expected_dlq=100)
    return x.withColumn("failures", F.array_join("failures", "; "))


def topic_decoded(spark, d):
    """Topic values decoded again, the undecodable counted by partition."""
    x = readers.decode_events(adapt.topic_records(_sides(spark, d)[1]))
    return x.groupBy("partition").agg(F.count_if("decoded").alias("decoded"), F.count_if(~F.col("decoded")).alias("undecodable"), F.sum(F.when(F.col("decoded"), F.col("seq"))).alias("seq_total"))


def reconcile_missing(spark, d):
    return reconcile.missing(_found(spark, d))


def reconcile_unexpected(spark, d):
    return reconcile.unexpected(_found(spark, d))


def reconcile_by_source(spark, d):
    return reconcile.group_deltas(*_sides(spark, d), "source")


def reconcile_by_type(spark, d):
    return reconcile.group_deltas(*_sides(spark, d), "type")


def unattributed_letters(spark, d):
    led, _, dead = _sides(spark, d)
    return reconcile.unattributed(dead, led).groupBy("source").agg(F.count("*").alias("n"))


def dlq_by_code(spark, d):
    return reconcile.by_code(_sides(spark, d)[2], text.code_of(F.col("reason")))


def seq_mismatches(spark, d):
    led, top, _ = _sides(spark, d)
    return reconcile.sequence_mismatches(led, top, "event_id").select("source", "id", "partition", "offset", "seq", "expected_seq")


def pseudonym_mismatches(spark, d):
    led, top, _ = _sides(spark, d)
    keys = F.broadcast(crypto.key_dimension(spark, _MASTER, adapt.TENANTS))
    led = led.join(keys, "tenant").withColumn("expected", crypto.pseudonym(F.col("user_ref")))
    top = top.withColumn("tenant", text.tenant_of(F.col("source"))).join(keys, "tenant").withColumn("user_pseudo", crypto.pseudonym(F.when(F.col("event_id") % 73 == 0, F.concat("user_ref", F.lit("?"))).otherwise(F.col("user_ref"))))
    return reconcile.pseudonym_mismatches(led, top, "event_id").select("source", "id", "partition", "offset", "user_pseudo")


def partition_offsets(spark, d):
    return reconcile.partition_ends(_sides(spark, d)[1])


def topic_drained(spark, d):
    top = _sides(spark, d)[1]
    ends = spark.createDataFrame([(p, 400 if p % 2 else 10**9) for p in range(13)], "partition int, end long")
    return readers.drained(top, ends)


def topic_ranges(spark, d):
    """A topic with lost offsets, written as files and read by offset ranges: what its ends are the source says."""
    top = _sides(spark, d)[1].where("event_id % 13 <> 0")
    path = f"{shared_dir(spark)}/topic-{uuid.uuid4().hex}"
    topics.write(adapt.topic_records(top.withColumn("x", F.lit(0))).select("partition", "offset", F.lit(None).cast("string").alias("key"), "value"), path)
    got = topics.read(spark, path, stop={p: 20 for p in range(1, 12, 2)})
    return topics.drained(got, topics.held(spark, path))


def wire_duplicates(spark, d):
    return _sides(spark, d)[1].groupBy("source").agg((F.count("*") - F.countDistinct("id")).alias("duplicates"))


def ordering_violations(spark, d):
    x = reconcile.ordering_violations(_sides(spark, d)[1])
    return x.groupBy("source").agg(F.count_if("late").alias("violations"), F.count_if(F.col("seq").isNull()).alias("unchecked"))


def sequence_texts(spark, d):
    x = _rows(spark, d).withColumn("s", F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("n"), "sequence")).when(F.col("event_id") % 5 == 1, F.concat(F.lit(" "), "sequence")).otherwise(F.col("sequence")))
    return x.groupBy("user_id").agg(F.sum(text.sequence_number(F.col("s"))).alias("total"), F.count_if(text.sequence_number(F.col("s")).isNull()).alias("unchecked"))


def _attempts(spark, d):
    """One row per send of an order: (batch_id, attempt, status, size, seconds)."""
    o = adapt.table(spark, d, "orders")
    k = F.col("o_orderkey")
    a = o.select(k.alias("batch_id"), "o_custkey", F.explode(F.sequence(F.lit(1), F.when(k % 7 == 0, 3).when(k % 5 == 0, 2).otherwise(1))).alias("attempt"), F.when(k % 7 == 0, 3).when(k % 5 == 0, 2).otherwise(1).alias("of"), (k % 40 + 1).alias("size"))
    a = a.withColumn("k", F.col("batch_id")).withColumn("status", F.when(F.col("attempt") < F.col("of"), 429).otherwise(F.when(F.col("k") % 11 == 0, 503).when(F.col("k") % 13 == 0, 429).otherwise(202)))
    return a.withColumns({"accepted": F.when(F.col("status") == 202, F.col("size") - (F.col("k") % 3 == 0).cast("long")).otherwise(0), "rejected": F.when(F.col("status") == 202, (F.col("k") % 3 == 0).cast("long")).otherwise(0), "seconds": ((F.col("k") * 31 + F.col("attempt") * 7) % 1000) / 1000})


def run_receipt(spark, d):
    a = _attempts(spark, d)
    last = a.groupBy("batch_id").agg(F.max_by(F.struct("size", "accepted", "rejected", "status"), "attempt").alias("x"), (F.count("*") - 1).alias("retries"), F.count_if(F.col("status") == 429).alias("limited"), F.count_if(F.col("status") == 503).alias("down"))
    s = last.agg(F.count("*").alias("batches"), F.sum("x.size").alias("sent"), F.sum("x.accepted").alias("accepted"), F.sum("x.rejected").alias("rejected"), F.sum("retries").alias("retried"), F.sum("limited").alias("rate_limited"), F.sum("down").alias("sink_unavailable"))
    s = s.withColumn("unaccepted", F.col("sent") - F.col("accepted") - F.col("rejected"))
    return s.withColumn("clean", F.col("unaccepted") == 0)


def responses_by_class(spark, d):
    return metrics.counters(_attempts(spark, d).withColumn("class", text.status_class(F.col("status"))), "class")


def held_rate(spark, d):
    x = _attempts(spark, d).groupBy((F.col("batch_id") % 10).alias("run")).agg(F.sum("size").alias("events"), F.sum("seconds").alias("seconds"), F.sum("accepted").alias("accepted"))
    x = x.withColumn("achieved", F.round(F.col("events") / F.col("seconds"), 4))
    return x.select("run", "achieved", F.when(F.col("events") > 0, F.col("achieved") >= 0.95 * 41).alias("held"))


def exact_quantiles(spark, d):
    a = staged(_attempts(spark, d).select("status", "seconds"), "attempts")
    got = metrics.exact_quantiles(a, "status", "seconds", [0.5, 0.99, 1.0])
    at = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return got.groupBy("status").agg(at(0.5).alias("p50"), at(0.99).alias("p99"), at(1.0).alias("slowest"))


def reconcile_by_summaries(spark, d):
    """Missing and unexpected keys from summaries of both sides, without a join of the tables."""
    led, top, dead = (staged(x, "side") for x in _sides(spark, d))
    return summaries.missing_and_unexpected(led, top, dead)


def loss_window(spark, d):
    miss = _found(spark, d).agg(F.count_if((F.col("sent") > 0) & (F.col("kept") == 0) & (F.col("refused") == 0)).alias("missing"), F.count_if(F.col("sent") > 0).alias("expected"))
    rec = run_receipt(spark, d).select("unaccepted")
    w = F.col("missing") - F.col("unaccepted")
    return miss.crossJoin(rec).select("missing", "unaccepted", w.alias("window"), (w.between(0, 50000) & (F.col("missing") < F.col("expected"))).alias("holds"))


def flood_isolation(spark, d):
    r = _rows(spark, d)
    before, after = r.where("ts < timestamp'2024-01-16'"), r.where("ts >= timestamp'2024-01-16' or tenant = 'tenant_0003'")
    a = before.groupBy("source").agg(F.count("*").alias("before"))
    b = after.groupBy("source").agg(F.count("*").alias("after"))
    return a.join(b, "source", "full").select("source", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).where("before <> after")


def dlq_exactness(spark, d):
    """Injected against rejected per code, and the planned total."""
    r = _rows(spark, d)
    plan = r.where("event_id % 7 = 1").groupBy(F.element_at(F.array(*map(F.lit, ["SCHEMA", "BAD_TIME", "UNKNOWN_ATTRIBUTE", "DUPLICATE_ID"])), (F.col("event_id") % 4 + 1).cast("int")).alias("code")).agg(F.count("*").alias("planned"))
    got = dlq_by_code(spark, d).select("code", F.col("n").alias("found"))
    return plan.join(got, "code", "full").select("code", F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("found", F.lit(0)).alias("found")).withColumn("exact", F.col("planned") == F.col("found"))


def ledger_merge(spark, d):
    led = adapt.ledger(_rows(spark, d)).withColumn("shard", F.when(F.col("event_id") % 500 == 0, 9).otherwise(F.lit(0)))
    return led.groupBy("tenant").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n")).withColumn("overlap", F.col("shards") > 1)


def ledger_shards(spark, d):
    """Ledgers of four shards of tenants, written as JSON lines by what was sent, read again and merged."""
    sent = staged(readers.sent_rows(adapt.raw_elements(_rows(spark, d))), "sent")
    path, shards = f"{shared_dir(spark)}/ledgers-{uuid.uuid4().hex}", []
    for k in range(4):
        sinks.append_json(sent.where(F.substring("tenant", -1, 1).cast("int") % 4 == k), f"{path}/{k}")
        shards.append(readers.read_ledger(spark, f"{path}/{k}"))
    return reconcile.merged_shards(shards).groupBy("tenant", "type").agg(F.count("*").alias("n"), F.sum("seq").alias("seq_total"), F.count_if(F.col("_corrupt").isNotNull()).alias("broken"))


def reconcile_samples(spark, d):
    return reconcile.samples(_found(spark, d), 3)


QUERIES = {f.__name__: f for f in (
    reconcile_summary, topic_decoded, reconcile_missing, reconcile_unexpected, reconcile_by_summaries, reconcile_by_source, reconcile_by_type, unattributed_letters, dlq_by_code, seq_mismatches, pseudonym_mismatches,
    partition_offsets, topic_drained, topic_ranges, wire_duplicates, ordering_violations, sequence_texts, run_receipt, responses_by_class, held_rate, exact_quantiles, loss_window, flood_isolation, dlq_exactness, ledger_merge, ledger_shards, reconcile_samples,
)}

_KEYS = """,
a AS (SELECT source, id, count(*) AS sent FROM led GROUP BY 1, 2), b AS (SELECT source, id, count(*) AS kept FROM top GROUP BY 1, 2),
c AS (SELECT rsource AS source, rid AS id, count(*) AS refused FROM dlq WHERE rsource <> '' AND rid <> '' GROUP BY 1, 2),
p AS (SELECT source, id, coalesce(sent, 0) AS sent, coalesce(kept, 0) AS kept, coalesce(refused, 0) AS refused FROM a FULL JOIN b USING (source, id) FULL JOIN c USING (source, id))
"""
_ATT = """att0 AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 3 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END AS n, o_orderkey % 40 + 1 AS size FROM orders),
att1 AS (SELECT k, n, size, unnest(range(1, n + 1)) AS attempt FROM att0),
att2 AS (SELECT *, CASE WHEN attempt < n THEN 429 WHEN k % 11 = 0 THEN 503 WHEN k % 13 = 0 THEN 429 ELSE 202 END AS status FROM att1),
att AS (SELECT *, CASE WHEN status = 202 THEN size - (k % 3 = 0)::INT ELSE 0 END AS accepted, CASE WHEN status = 202 THEN (k % 3 = 0)::INT ELSE 0 END AS rejected, ((k * 31 + attempt * 7) % 1000) / 1000.0::DOUBLE AS seconds FROM att2),
rec AS (SELECT count(*) AS batches, sum(x.size)::BIGINT AS sent, sum(x.accepted)::BIGINT AS accepted, sum(x.rejected)::BIGINT AS rejected, sum(r)::BIGINT AS retried, sum(l)::BIGINT AS rate_limited, sum(w)::BIGINT AS sink_unavailable
  FROM (SELECT k, arg_max({'size': size, 'accepted': accepted, 'rejected': rejected}, attempt) AS x, count(*) - 1 AS r, count(*) FILTER (status = 429) AS l, count(*) FILTER (status = 503) AS w FROM att GROUP BY k))"""


def _groups(by: str, r: str) -> str:
    return _sql(f", x AS (SELECT {by} AS g, count(DISTINCT source || '|' || id) AS sent FROM led GROUP BY 1), y AS (SELECT {by} AS g, count(DISTINCT source || '|' || id) AS stored FROM top GROUP BY 1), z AS (SELECT coalesce({r}, '(unattributable)') AS g, count(*) AS rejected FROM dlq GROUP BY 1), j AS (SELECT g, coalesce(sent, 0) AS sent, coalesce(stored, 0) AS stored, coalesce(rejected, 0) AS rejected FROM x FULL JOIN y USING (g) FULL JOIN z USING (g)) SELECT g AS \"group\", sent, stored, rejected, stored - sent AS delta, sent - stored - rejected AS unresolved FROM j")


SQL = {
    "reconcile_summary": _sql(f"""{_KEYS}, s AS (SELECT sum(sent)::BIGINT AS ledger_rows, count(*) FILTER (sent > 0) AS expected, sum(sent)::BIGINT - count(*) FILTER (sent > 0) AS ledger_duplicates, count(*) FILTER (sent > 0 AND (kept > 0 OR refused > 0)) AS accepted, count(*) FILTER (kept > 0) AS stored, sum(kept)::BIGINT - count(*) FILTER (kept > 0) AS wire_duplicates, count(*) FILTER (sent > 0 AND kept = 0 AND refused = 0) AS missing, count(*) FILTER (kept > 0 AND sent = 0) AS unexpected FROM p),
o AS (SELECT *, max(seq) OVER (PARTITION BY source, user_ref ORDER BY part, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM top),
l AS (SELECT source, id, arg_max(seq, event_id) AS es, arg_min(user_ref, event_id) AS u FROM led GROUP BY 1, 2),
m AS (SELECT count(*) FILTER (seq <> es) AS seq_mismatches, count(*) FILTER (CASE WHEN event_id % 73 = 0 THEN user_ref || '?' ELSE user_ref END <> u) AS pseudonym_mismatches FROM top JOIN l USING (source, id)),
z AS (SELECT s.*, (SELECT count(*) FROM dlq) AS dlq, 12 - (SELECT count(DISTINCT part) FROM top WHERE part <> 5) AS undrained, (SELECT count(*) FROM top WHERE event_id % 211 = 0) AS undecodable,
  (SELECT count(*) FROM dlq WHERE rid IS NULL OR NOT EXISTS (SELECT 1 FROM led WHERE led.source = dlq.rsource AND led.id = dlq.rid)) AS unattributed,
  (SELECT count(DISTINCT code) FROM dlq WHERE code = 'STRANGE') AS unknown_codes, (SELECT count(*) FROM o WHERE seq < high) AS ordering_violations, (SELECT count(*) FROM o WHERE seq IS NULL) AS ordering_unchecked, m.* FROM s, m),
y AS (SELECT *, abs(dlq - 100) AS dlq_off, abs(wire_duplicates) AS duplicates_off FROM z),
x AS (SELECT *, concat_ws('; ', {", ".join(f"CASE WHEN {c} > 0 THEN '{c}: ' || {c} END" for c in reconcile.FAILURES)}) AS failures FROM y)
SELECT *, CASE WHEN expected = 0 OR undrained > 0 THEN 'UNVERIFIED' WHEN failures <> '' THEN 'FAIL' ELSE 'PASS' END AS verdict FROM x"""),
    "topic_decoded": _sql("SELECT part AS partition, count(*) FILTER (event_id % 211 <> 0) AS decoded, count(*) FILTER (event_id % 211 = 0) AS undecodable, sum(CASE WHEN event_id % 211 <> 0 THEN seq END)::BIGINT AS seq_total FROM top GROUP BY 1"),
    "reconcile_missing": _sql(_KEYS + "SELECT source, id FROM p WHERE sent > 0 AND kept = 0 AND refused = 0"),
    "reconcile_unexpected": _sql(_KEYS + "SELECT source, id FROM p WHERE kept > 0 AND sent = 0"),
    "reconcile_by_summaries": _sql(_KEYS + "SELECT 'missing' AS side, source, id FROM p WHERE sent > 0 AND kept = 0 AND refused = 0 UNION ALL SELECT 'unexpected', source, id FROM p WHERE kept > 0 AND sent = 0"),
    "reconcile_by_source": _groups("source", "rsource"),
    "reconcile_by_type": _groups("type", "rtype"),
    "unattributed_letters": _sql("SELECT source, count(*) AS n FROM dlq WHERE rid IS NULL OR NOT EXISTS (SELECT 1 FROM led WHERE led.source = dlq.rsource AND led.id = dlq.rid) GROUP BY 1"),
    "dlq_by_code": _sql("SELECT code, count(*) AS n, code <> 'STRANGE' AS known FROM dlq GROUP BY 1"),
    "seq_mismatches": _sql(", l AS (SELECT source, id, arg_max(seq, event_id) AS expected_seq FROM led GROUP BY 1, 2) SELECT source, id, part AS partition, off AS \"offset\", seq, expected_seq FROM top JOIN l USING (source, id) WHERE seq <> expected_seq"),
    "pseudonym_mismatches": _sql(f", k AS (SELECT * FROM (VALUES {_key_values()}) t(tenant, ipad, opad)), l AS (SELECT source, id, arg_min(user_ref, event_id) AS u FROM led GROUP BY 1, 2), m AS (SELECT top.*, CASE WHEN event_id % 73 = 0 THEN user_ref || '?' ELSE user_ref END AS v FROM top), j AS (SELECT m.*, l.u FROM m JOIN l USING (source, id) WHERE v <> l.u) SELECT source, id, part AS partition, off AS \"offset\", sha256(unhex(opad) || unhex(sha256(unhex(ipad) || v::BLOB))) AS user_pseudo FROM j JOIN k ON '/careers/' || k.tenant = source"),
    "partition_offsets": _sql("SELECT part AS partition, count(*) AS records, max(off) + 1 AS end_offset FROM top GROUP BY 1"),
    "topic_drained": _sql(", n AS (SELECT i::INT AS partition, CASE WHEN i % 2 = 1 THEN 400 ELSE 1000000000 END::BIGINT AS \"end\" FROM range(13) r(i)), g AS (SELECT part AS partition, max(off) + 1 AS read_to FROM top GROUP BY 1) SELECT partition, \"end\", coalesce(read_to, 0) AS read_to, coalesce(read_to, 0) >= \"end\" AS drained FROM n LEFT JOIN g USING (partition)"),
    "topic_ranges": _sql(", k AS (SELECT part, off FROM top WHERE event_id % 13 <> 0), n AS (SELECT part, min(off) AS low, max(off) + 1 AS e FROM k GROUP BY 1), g AS (SELECT part, max(off) + 1 AS r, count(*) AS c FROM k WHERE part % 2 = 0 OR off < 20 GROUP BY 1) SELECT part AS partition, low, e AS \"end\", coalesce(r, low) AS read_to, coalesce(r, low) - low - coalesce(c, 0) AS gaps, coalesce(r, low) >= e AS drained FROM n LEFT JOIN g USING (part)"),
    "wire_duplicates": _sql("SELECT source, count(*) - count(DISTINCT id) AS duplicates FROM top GROUP BY 1"),
    "ordering_violations": _sql(", o AS (SELECT *, max(seq) OVER (PARTITION BY source, user_ref ORDER BY part, off ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM top) SELECT source, count(*) FILTER (seq < high) AS violations, count(*) FILTER (seq IS NULL) AS unchecked FROM o GROUP BY 1"),
    "sequence_texts": _sql("SELECT user_id, sum(CASE WHEN event_id % 5 <> 0 THEN seq END)::BIGINT AS total, count(*) FILTER (event_id % 5 = 0) AS unchecked FROM ing GROUP BY 1"),
    "run_receipt": f"WITH {_ATT} SELECT *, sent - accepted - rejected AS unaccepted, sent - accepted - rejected = 0 AS clean FROM rec",
    "responses_by_class": f"WITH {_ATT} SELECT (status // 100) || 'xx' AS class, count(*) AS n FROM att GROUP BY 1",
    "held_rate": f"WITH {_ATT}, h AS (SELECT k % 10 AS run, round(sum(size) / sum(seconds), 4) AS achieved FROM att GROUP BY 1) SELECT run, achieved, achieved >= 0.95 * 41 AS held FROM h",
    "exact_quantiles": f"WITH {_ATT} SELECT status, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.99) AS p99, max(seconds) AS slowest FROM att GROUP BY 1",
    "loss_window": _sql(_KEYS + f", {_ATT}, m AS (SELECT count(*) FILTER (sent > 0 AND kept = 0 AND refused = 0) AS missing, count(*) FILTER (sent > 0) AS expected FROM p), u AS (SELECT sent - accepted - rejected AS unaccepted FROM rec) SELECT missing, unaccepted, missing - unaccepted AS \"window\", missing - unaccepted BETWEEN 0 AND 50000 AND missing < expected AS holds FROM m, u"),
    "flood_isolation": _sql(", f AS (SELECT source, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-16' OR tenant = 'tenant_0003') AS after FROM ing GROUP BY 1) SELECT source, before, after FROM f WHERE before <> after"),
    "dlq_exactness": _sql(", q AS (SELECT CASE event_id % 4 WHEN 0 THEN 'SCHEMA' WHEN 1 THEN 'BAD_TIME' WHEN 2 THEN 'UNKNOWN_ATTRIBUTE' ELSE 'DUPLICATE_ID' END AS code, count(*) AS planned FROM ing WHERE event_id % 7 = 1 GROUP BY 1), g AS (SELECT code, count(*) AS found FROM dlq GROUP BY 1) SELECT code, coalesce(planned, 0) AS planned, coalesce(found, 0) AS found, coalesce(planned, 0) = coalesce(found, 0) AS exact FROM q FULL JOIN g USING (code)"),
    "ledger_shards": _sql("SELECT tenant, type, count(*) AS n, sum(seq)::BIGINT AS seq_total, 0::BIGINT AS broken FROM ing GROUP BY 1, 2"),
    "reconcile_samples": _sql(_KEYS + "(SELECT 'missing' AS what, source, id FROM p WHERE sent > 0 AND kept = 0 AND refused = 0 ORDER BY source, id LIMIT 3) UNION ALL (SELECT 'unexpected', source, id FROM p WHERE kept > 0 AND sent = 0 ORDER BY source, id LIMIT 3)"),
    "ledger_merge": _sql(", s AS (SELECT tenant, CASE WHEN event_id % 500 = 0 THEN 9 ELSE substr(tenant, 11, 1)::INT % 4 END AS shard FROM led) SELECT tenant, count(DISTINCT shard) AS shards, count(*) AS n, count(DISTINCT shard) > 1 AS overlap FROM s GROUP BY 1"),
}
