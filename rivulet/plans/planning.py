"""Queries on metrics, rates, skew, planning, faults and sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text
from ..operators import faults, metrics, reconcile, skew
from ..operators import sessions as ses
from ..sources import adapt, readers
from ..staging import staged
from .ingest import _rows, _sql, _verdicts

EDGES = [1, 5, 10, 25, 50, 100, 250, 500]


def event_counters(spark, d):
    return metrics.counters(_rows(spark, d).withColumn("channel", F.when(F.col("event_id") % 9 > 0, F.col("channel"))), "type", "channel")


def label_cap(spark, d):
    x = adapt.table(spark, d, "events").withColumn("user", F.concat(F.lit("usr_"), "user_id"))
    return metrics.capped_labels(x, "user", "event_id")


def size_histogram(spark, d):
    x = _rows(spark, d).groupBy("batch_id").agg(F.count("*").alias("size"))
    return metrics.histogram(x, F.col("size"), EDGES).select(F.col("le").cast("string").alias("le"), "n", "cumulative")


def bucket_quantiles(spark, d):
    x = adapt.table(spark, d, "orders").select((F.col("o_totalprice") / 1000).alias("v"))
    h = metrics.histogram(x, F.col("v"), EDGES)
    out = None
    for q in (0.1, 0.5, 0.9, 0.99):
        y = metrics.bucket_quantile(h, q)
        out = y if out is None else out.unionByName(y)
    return out.select("q", F.round("value", 6).alias("value"))


def scrape_rates(spark, d):
    e = adapt.table(spark, d, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600).alias("b")).agg(F.count_if(F.col("event_type") != "error").alias("ok"), F.count_if(F.col("event_type") == "error").alias("bad"))
    w = Window.orderBy("b")
    s = e.select((F.col("b") * 21600).alias("at"), (F.col("b") % 37 == 0).cast("int").alias("workers"), F.when(F.col("b") % 23 == 0, 0).otherwise(F.sum("ok").over(w)).alias("accepted"), F.sum("bad").over(w).alias("rejected"))
    x = metrics.rates(s, ["accepted", "rejected"])
    return x.select("at", "caveat", F.round("error_rate", 9).alias("error_rate"), F.round("accepted_per_sec", 9).alias("accepted_per_sec"), F.round("rejected_per_sec", 9).alias("rejected_per_sec"))


def gateway_rates(spark, d):
    """Rates of accepted, rejected, dead-lettered and shed events between scrapes of six hours, with the error rate."""
    k = F.col("event_id")
    e = adapt.table(spark, d, "events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600).alias("b")).agg(F.count_if(k % 7 != 1).alias("accepted"), F.count_if(k % 7 == 1).alias("rejected"), F.count_if(k % 14 == 1).alias("dlq"), F.count_if(k % 11 == 0).alias("shed"))
    w = Window.orderBy("b")  # one row for each scrape
    s = e.select((F.col("b") * 21600).alias("at"), F.lit(2).alias("workers"), *[F.sum(c).over(w).alias(c) for c in ("accepted", "rejected", "dlq", "shed")])
    x = metrics.rates(s, ["accepted", "rejected", "dlq", "shed"])
    return x.select("at", "caveat", *[F.round(c, 9).alias(c) for c in ("error_rate", "accepted_per_sec", "rejected_per_sec", "dlq_per_sec", "shed_per_sec")])


def metric_samples(spark, d):
    e = adapt.table(spark, d, "events")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("events_total{type=\""), "event_type", F.lit("\" broken"))).otherwise(F.concat(F.lit("events_total{type=\""), "event_type", F.lit("\",user=\""), "user_id", F.lit("\"} "), F.col("event_id") % 7))
    x = readers.parse_metrics(e.select(line.alias("value")))
    return x.groupBy(F.col("labels")["type"].alias("type"), "ok").agg(F.count("*").alias("n"), F.sum("sample").alias("total"))


def rate_view(spark, d):
    v = _rows(spark, d)
    return v.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count_if(F.col("event_type") != "error").alias("accepted"), F.count_if(F.col("event_type") == "error").alias("rejected")).select(F.unix_timestamp("w.start").alias("start"), "accepted", "rejected")


def gauges(spark, d):
    """Lag of a consumer that has committed what it read of some partitions, and the depth of the dead letters."""
    r = _rows(spark, d)
    top = adapt.topic(r)
    committed = top.where("partition <> 7 and event_id % 3 = 0").groupBy("partition").agg((F.max("offset") + 1).alias("offset"))
    lag = reconcile.consumer_lag(reconcile.partition_ends(top), committed).select(F.concat(F.lit("lag of "), "partition").alias("gauge"), F.col("lag").alias("value"))
    return lag.unionByName(adapt.dead_letters(r).agg(F.lit("dead letters").alias("gauge"), F.count("*").alias("value")))


def zipf_plan(spark, d):
    """The orders' tenants in the order of their orders, and the same number of orders dealt to them by a Zipf law."""
    name = F.concat(F.lit("tenant_"), F.lpad((F.col("o_custkey") % 20).cast("string"), 4, "0"))
    t = staged(adapt.table(spark, d, "orders").groupBy(name.alias("tenant")).agg(F.count("*").alias("n")), "tenants")
    n = t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # one row per tenant
    t = t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tenant"))).select("tenant", "rank")
    x = skew.apportion(skew.zipf_shares(t, 1.1), "share", n, "rank")
    return x.where("units > 0").select("tenant", F.round("share", 9).alias("share"), "units", skew.users_needed().alias("users"))


def skew_report(spark, d):
    return skew.report(adapt.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))


def busiest_tenant(spark, d):
    c = _rows(spark, d).groupBy("tenant").agg(F.count("*").alias("n"))
    return c.agg(F.max_by("tenant", F.struct("n", "tenant")).alias("tenant"), F.max("n").alias("n"))


def max_events_per_user(spark, d):
    return _rows(spark, d).groupBy("source", "user_ref").agg(F.count("*").alias("n")).groupBy("source").agg(F.max("n").alias("most"))


def fingerprint(spark, d):
    return skew.fingerprint(_rows(spark, d), "source", "type", "channel")


def fingerprint_overall(spark, d):
    """One digest of all sources together."""
    return skew.fingerprint(_rows(spark, d).withColumn("all", F.lit("all")), "all", "source", "type", "channel")


def channel_metadata(spark, d):
    """Events by channel and by what their metadata, of a different shape for each channel, says of the client."""
    k = (F.col("event_id") % 4).cast("string")
    web = F.to_json(F.struct(F.concat(F.lit("/page/"), k).alias("page"), F.lit("agent").alias("userAgent")))
    app = F.to_json(F.struct(F.struct(F.concat(F.lit("model "), k).alias("model")).alias("device")))
    hook = F.to_json(F.struct(F.concat(F.lit("source"), k).alias("utm_source"), F.lit("cpc").alias("utm_medium")))
    r = _rows(spark, d).withColumn("metadata", F.when(F.col("event_id") % 37 == 0, "{}").when(F.col("channel") == "WEB_APP", web).when(F.col("channel") == "MOBILE_APP", app).otherwise(hook))
    return metrics.counters(r.withColumn("label", text.channel_label(F.col("channel"), F.col("metadata"))), "channel", "label")


def scrape_totals(spark, d):
    """Samples of four workers, read from their texts and put together by scrape."""
    e = adapt.table(spark, d, "events").select(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).alias("day"), "event_id", (F.col("user_id") % 4).alias("worker"))
    w = e.groupBy("day", "worker").agg(F.count("*").alias("n"), F.max(F.col("event_id") % 100).alias("full"))
    line = F.explode(F.array(*[F.concat(F.lit(f'{name}{{worker="'), "worker", F.lit('"} '), value.cast("string")) for name, value in (("events_total", F.col("n")), ("buffer_utilisation", F.col("full")))]))
    lines = w.select("day", line.alias("value"))
    return metrics.scrape_totals(readers.parse_metrics(lines, "day"), "day").select("day", "name", "value")


def metric_projection(spark, d):
    """The four fields that metrics need, parsed from the events' texts alone."""
    e = adapt.raw_elements(_rows(spark, d)).select(F.from_json("raw", S._struct(**{k: S._s for k in ("source", "type", "sourcechannel", "sequence")})).alias("e"))
    return metrics.counters(e.select("e.*").withColumnRenamed("sourcechannel", "channel"), "type", "channel")


def attribute_audit(spark, d):
    """Names of top-level attributes, and whether the contract lets an attribute have such a name."""
    e = adapt.raw_elements(_rows(spark, d)).select(F.explode(F.json_object_keys("raw")).alias("name"))
    return e.groupBy("name", text.attribute_name_ok(F.col("name")).alias("ok")).agg(F.count("*").alias("n"))


def tenant_shards(spark, d):
    """Every event counted in the shard of its tenant; the digest is taken once per tenant."""
    t = _rows(spark, d).groupBy("tenant").agg(F.count("*").alias("n"))
    return t.withColumn("shard", text.shard_of(F.col("tenant"), 4))


def request_plan(spark, d):
    r = _rows(spark, d).select("tenant", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), F.lit("c").alias("channel"), (F.col("event_id") % 900 + 100).alias("size")).withColumn("channel", F.when(F.col("id") % 41 == 0, "b").otherwise("a"))
    return faults.request_plan(r, 50, 8000)


def tenant_batches(spark, d):
    r = _rows(spark, d).select("tenant", F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return faults.tenant_batches(r, 60).groupBy("tenant", "batch").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def user_sequences(spark, d):
    return _rows(spark, d).groupBy("source", "user_ref").agg(F.max("sequence").alias("last"), F.count("*").alias("n"))


def _partnered(spark, d, rate=0.02):
    r = staged(_rows(spark, d), "events")
    n = r.count()
    plan = faults.injection_plan(spark, n, skew.injected_total(n, rate), 42)
    # the slot is a place in the order of event_id, which may have gaps and repeats
    r = faults.checked_total(r, n)
    r = faults.placed(r, "event_id", "ts", "user_id", "event_type", "value")
    x = r.select("batch_id", "idx", "event_id", F.concat(F.lit("ev-"), "event_id").alias("id"), "type", "time", "place").join(plan.select(F.col("slot").alias("place"), "variant"), "place", "left")
    return faults.partners(x)


def _injected(spark, d):
    return faults.corrupt(_partnered(spark, d))


def injection_report(spark, d):
    """What went out at a rate at which some batches have no clean event left."""
    x = staged(faults.emitted(_partnered(spark, d, 0.3).drop("place")), "emitted")
    bad = F.col("variant").isNotNull()
    y = x.agg(F.count_distinct("batch_id").alias("batches"), F.count("*").alias("emitted"), F.count_if(bad).alias("injected"), F.count_if(F.col("appended") & ~bad).alias("appended"))
    return y.withColumn("rate", F.round(F.col("injected") / F.col("emitted"), 6))


def injection_plan(spark, d):
    n = adapt.table(spark, d, "events").count()
    return faults.injection_plan(spark, n, skew.injected_total(n, 0.02), 42)


def inject_faults(spark, d):
    x = _injected(spark, d).where("variant is not null")
    return x.groupBy("variant").agg(F.count("*").alias("injected"), F.count_if("appended").alias("appended"), F.count_if(F.col("time") == "yesterday").alias("bad_times"))


def webhook_fanout(spark, d):
    o = adapt.table(spark, d, "orders")
    js = F.to_json(F.struct(F.lit("board").alias("partner"), F.concat(F.lit("x"), "o_orderkey").alias("external_application_id"), F.concat(F.lit("tenant_"), F.lpad((F.col("o_custkey") % 20).cast("string"), 4, "0")).alias("career_site_id"), F.when(F.col("o_orderkey") % 12 > 0, F.concat(F.lit("job_"), F.col("o_orderkey") % 9)).alias("job_id"), F.lit("https://boards.example.com/jobs/1").alias("referrer_url"), F.concat(F.lit("src"), F.col("o_custkey") % 3).alias("utm_source"), F.lit("cpc").alias("utm_medium"), F.col("o_orderdate").cast("string").alias("occurred_at"), F.struct(F.concat(F.lit("c"), "o_custkey").alias("candidate_ref")).alias("applicant")))
    w = readers.parse_webhooks(o.select("o_orderkey", js.alias("body")))
    kinds = F.array(*[F.struct(F.lit(i).cast("long").alias("k"), F.lit(S.PREFIX + t).alias("type")) for i, t in enumerate(("job-viewed", "application-started", "application-step-completed", "application-submitted"))])
    return w.where("ok").select("o_orderkey", F.concat(F.lit("/careers/"), "career_site_id").alias("source"), "utm_source", F.explode(kinds).alias("e")).select("o_orderkey", "source", "utm_source", "e.k", "e.type")


def attribution(spark, d):
    e = adapt.table(spark, d, "events").select(F.col("event_type"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.count("k").alias("known"))


def dedup_events(spark, d):
    r = _rows(spark, d)
    x = r.unionByName(r.where("event_id % 10 = 0"))
    return ses.deduplicated(x).groupBy("source").agg(F.count("*").alias("n"))


def _session_events(spark, d):
    return _rows(spark, d).select("user_id", "ts", F.regexp_replace("type", "^com\\.careerpage\\.career\\.", "").alias("type"), (F.col("event_id") % 5 + 1).alias("step"))


def sessions(spark, d):
    return ses.sessions(_session_events(spark, d), "12 hours").select("user_id", F.unix_timestamp(F.col("first_ts").cast("timestamp")).alias("start"), "n", "max_step", "started", "ended")


def sessions_30_minutes(spark, d):
    return ses.sessions(_session_events(spark, d)).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def abandonment(spark, d):
    s = ses.sessions(_session_events(spark, d), "12 hours")
    return ses.abandoned(s, 43200, F.lit(1706486400)).select("user_id", F.unix_timestamp(F.col("last_ts").cast("timestamp")).alias("last"), "n")


def funnel_survival(spark, d):
    return ses.funnel(ses.sessions(_session_events(spark, d), "12 hours"), 5)


def validation_failures(spark, d):
    v = _verdicts(spark, d).where("code is not null")
    return metrics.counters(v, "source", "code")


QUERIES = {f.__name__: f for f in (
    event_counters, label_cap, size_histogram, bucket_quantiles, scrape_rates, gateway_rates, metric_samples, rate_view, gauges, zipf_plan, skew_report, busiest_tenant, max_events_per_user, fingerprint, fingerprint_overall, channel_metadata, scrape_totals, metric_projection, attribute_audit, tenant_shards,
    request_plan, tenant_batches, user_sequences, injection_plan, inject_faults, injection_report, webhook_fanout, attribution, dedup_events, sessions, sessions_30_minutes, abandonment, funnel_survival, validation_failures,
)}

_LE = "(SELECT unnest([1, 5, 10, 25, 50, 100, 250, 500, 'inf'::DOUBLE]) AS le)"


def _hist(source: str) -> str:
    return f"b AS (SELECT l.le, (SELECT min(k.le) FROM {_LE} k WHERE k.le > l.le) AS nx FROM {_LE} l), c AS (SELECT (SELECT min(le) FROM {_LE} z WHERE z.le >= v) AS le, count(*) AS n FROM ({source}) GROUP BY 1), h AS (SELECT b.le, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (ORDER BY b.le)::BIGINT AS cumulative FROM b LEFT JOIN c ON b.le = c.le)"


_SES = """, se0 AS (SELECT user_id, ts, event_id % 5 + 1 AS step, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM ing),
se1 AS (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM se0),
ss AS (SELECT user_id, s, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, max(step) AS max_step, bool_or(event_type = 'click') AS started, bool_or(event_type = 'purchase') AS ended FROM se1 GROUP BY 1, 2) """
_S12, _S30 = _SES.format(gap="12 HOURS"), _SES.format(gap="30 MINUTES")
_PLAN = """, n AS (SELECT count(*) AS n, floor(count(*) * 0.02 + 0.5)::BIGINT AS c FROM events),
pl0 AS (SELECT i AS k, floor(i * (n / c::DOUBLE))::BIGINT AS lo, floor((i + 1) * (n / c::DOUBLE))::BIGINT AS hi, ('0x' || substr(md5('42:' || i), 1, 8))::BIGINT AS h FROM n, range(c) r(i)),
pl AS (SELECT k, lo + h % greatest(hi - lo - 1, 1) AS slot, ['bad_type', 'bad_time', 'unknown_attribute', 'duplicate_id'][k % 4 + 1] AS variant FROM pl0) """

SQL = {
    "event_counters": _sql("SELECT type, coalesce(CASE WHEN event_id % 9 > 0 THEN channel END, '__unset__') AS channel, count(*) AS n FROM ing GROUP BY 1, 2"),
    "label_cap": "WITH p AS (SELECT 'usr_' || user_id AS u, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY f, u) AS k FROM p) SELECT CASE WHEN k <= 64 THEN u ELSE '__other__' END AS user, sum(n)::BIGINT AS n, sum(CASE WHEN k > 64 THEN n ELSE 0 END)::BIGINT AS folded FROM r GROUP BY 1",
    "size_histogram": _sql(", " + _hist("SELECT count(*) AS v FROM ing GROUP BY batch_id") + " SELECT CASE WHEN isinf(le) THEN 'Infinity' ELSE le::DECIMAL(10, 1)::VARCHAR END AS le, n, cumulative FROM h"),
    "bucket_quantiles": "WITH " + _hist("SELECT o_totalprice / 1000 AS v FROM orders") + ", q AS (SELECT unnest([0.1, 0.5, 0.9, 0.99])::DOUBLE AS q), t AS (SELECT max(cumulative) AS t FROM h), f AS (SELECT q, min(le) AS le FROM q, t, h WHERE cumulative >= q * t GROUP BY q), g AS (SELECT f.q, f.le, h.cumulative AS c, q * t AS rank, coalesce((SELECT max(le) FROM h x WHERE x.n > 0 AND x.le < f.le), 0) AS lo, coalesce((SELECT max(cumulative) FROM h x WHERE x.n > 0 AND x.le < f.le), 0) AS lc FROM f JOIN h ON h.le = f.le, t) SELECT q, CASE WHEN isinf(le) THEN NULL WHEN c <= lc THEN le ELSE round(lo + (le - lo) * (rank - lc) / (c - lc), 6) END AS value FROM g",
    "scrape_rates": "WITH e AS (SELECT floor(floor(epoch(ts)) / 21600)::BIGINT AS b, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1), s AS (SELECT b * 21600 AS t, (b % 37 = 0)::INT AS w, CASE WHEN b % 23 = 0 THEN 0 ELSE sum(ok) OVER (ORDER BY b)::BIGINT END AS a, sum(bad) OVER (ORDER BY b)::BIGINT AS r FROM e), l AS (SELECT *, lag(t) OVER o AS pt, lag(w) OVER o AS pw, lag(a) OVER o AS pa, lag(r) OVER o AS pr FROM s WINDOW o AS (ORDER BY t)), c AS (SELECT *, CASE WHEN pt IS NULL THEN 'baseline' WHEN pt = t THEN 'same time' WHEN pw <> w THEN 'workers changed' WHEN a < pa OR r < pr THEN 'counter fell' END AS caveat FROM l) SELECT t AS at, caveat, CASE WHEN caveat IS NULL AND a - pa + r - pr > 0 THEN round((r - pr) / (a - pa + r - pr)::DOUBLE, 9) END AS error_rate, CASE WHEN caveat IS NULL THEN round((a - pa) / (t - pt)::DOUBLE, 9) END AS accepted_per_sec, CASE WHEN caveat IS NULL THEN round((r - pr) / (t - pt)::DOUBLE, 9) END AS rejected_per_sec FROM c",
    "gateway_rates": """WITH e AS (SELECT floor(epoch(ts) / 21600)::BIGINT AS b, count(*) FILTER (event_id % 7 <> 1) AS accepted, count(*) FILTER (event_id % 7 = 1) AS rejected, count(*) FILTER (event_id % 14 = 1) AS dlq, count(*) FILTER (event_id % 11 = 0) AS shed FROM events GROUP BY 1),
p AS (SELECT *, lag(b) OVER (ORDER BY b) AS q FROM e)
SELECT b * 21600 AS at, CASE WHEN q IS NULL THEN 'baseline' END AS caveat, CASE WHEN q IS NOT NULL THEN round(rejected / (accepted + rejected), 9) END AS error_rate,
  round(accepted / ((b - q) * 21600), 9) AS accepted_per_sec, round(rejected / ((b - q) * 21600), 9) AS rejected_per_sec, round(dlq / ((b - q) * 21600), 9) AS dlq_per_sec, round(shed / ((b - q) * 21600), 9) AS shed_per_sec FROM p""",
    "metric_samples": "SELECT CASE WHEN event_id % 10 > 0 THEN event_type END AS type, event_id % 10 > 0 AS ok, count(*) AS n, sum(CASE WHEN event_id % 10 > 0 THEN event_id % 7 END)::DOUBLE AS total FROM events GROUP BY 1, 2",
    "rate_view": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) FILTER (event_type <> 'error') AS accepted, count(*) FILTER (event_type = 'error') AS rejected FROM events GROUP BY 1",
    "gauges": _sql("SELECT 'lag of ' || part AS gauge, max(off) + 1 - coalesce(max(off) FILTER (part <> 7 AND event_id % 3 = 0) + 1, 0) AS value FROM top GROUP BY part UNION ALL SELECT 'dead letters', count(*) FROM dlq"),
    "zipf_plan": "WITH n AS (SELECT count(*) AS n FROM orders), o AS (SELECT 'tenant_' || lpad((o_custkey % 20)::VARCHAR, 4, '0') AS tenant, count(*) AS c FROM orders GROUP BY 1), t0 AS (SELECT tenant, row_number() OVER (ORDER BY c DESC, tenant) AS rank FROM o), t AS (SELECT rank, tenant, pow(rank, -1.1) AS p FROM t0), s AS (SELECT *, p / sum(p) OVER () AS share FROM t), x AS (SELECT *, share / sum(share) OVER () * n AS e FROM s, n), y AS (SELECT *, floor(e)::BIGINT AS u, row_number() OVER (ORDER BY round(e - floor(e), 9) DESC, rank) AS k, n - sum(floor(e)) OVER () AS l FROM x), z AS (SELECT *, u + (k <= l)::BIGINT AS units FROM y) SELECT tenant, round(share, 9) AS share, units, greatest(50, ceil(units / 625.0))::BIGINT AS users FROM z WHERE units > 0",
    "skew_report": "WITH c AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, row_number() OVER (ORDER BY n) AS a, count(*) OVER () AS k, sum(n) OVER () AS t FROM c) SELECT max(t)::BIGINT AS units, max(k) AS tenants, round_even(sum(n) FILTER (r <= greatest(1, floor(k * 0.01))) / max(t)::DOUBLE, 4) AS top1_share, round_even(sum(n) FILTER (r <= greatest(1, floor(k * 0.05))) / max(t)::DOUBLE, 4) AS top5_share, max(n) AS busiest, max(n) FILTER (a = k // 2 + 1) AS median, min(n) AS thinnest FROM r",
    "busiest_tenant": _sql("SELECT tenant, count(*) AS n FROM ing GROUP BY 1 ORDER BY n DESC, tenant DESC LIMIT 1"),
    "max_events_per_user": _sql("SELECT source, max(n) AS most FROM (SELECT source, user_ref, count(*) AS n FROM ing GROUP BY 1, 2) GROUP BY 1"),
    "fingerprint": _sql(", c AS (SELECT source, type || '|' || channel || '|' || count(*) AS x FROM ing GROUP BY source, type, channel) SELECT source, sha256(string_agg(x, ';' ORDER BY x)) AS digest FROM c GROUP BY 1"),
    "fingerprint_overall": _sql(", c AS (SELECT source || '|' || type || '|' || channel || '|' || count(*) AS x FROM ing GROUP BY source, type, channel) SELECT 'all' AS \"all\", sha256(string_agg(x, ';' ORDER BY x)) AS digest FROM c"),
    "channel_metadata": _sql("SELECT channel, CASE WHEN event_id % 37 = 0 THEN '__unset__' WHEN channel = 'WEB_APP' THEN '/page/' || (event_id % 4) WHEN channel = 'MOBILE_APP' THEN 'model ' || (event_id % 4) ELSE 'source' || (event_id % 4) || '/cpc' END AS label, count(*) AS n FROM ing GROUP BY 1, 2"),
    "scrape_totals": "WITH w AS (SELECT floor(floor(epoch(ts)) / 86400)::BIGINT AS day, user_id % 4 AS w, count(*) AS n, max(event_id % 100) AS f FROM events GROUP BY 1, 2) SELECT day, 'events_total' AS name, sum(n)::DOUBLE AS value FROM w GROUP BY 1 UNION ALL SELECT day, 'buffer_utilisation', max(f)::DOUBLE FROM w GROUP BY 1",
    "metric_projection": _sql("SELECT type, channel, count(*) AS n FROM ing GROUP BY 1, 2"),
    "attribute_audit": _sql("SELECT name, name <> 'data' AS ok, n FROM (SELECT unnest(['specversion', 'id', 'source', 'type', 'time', 'sourcechannel', 'sequence', 'data']) AS name, count(*) AS n FROM ing GROUP BY 1 UNION ALL SELECT 'shadow', count(*) FROM ing WHERE extra) WHERE n > 0"),
    "request_plan": """WITH RECURSIVE e AS (SELECT 'tenant_' || lpad((user_id % 20)::VARCHAR, 4, '0') AS tenant, event_id AS id, CASE WHEN event_id % 41 = 0 THEN 'b' ELSE 'a' END AS channel, event_id % 900 + 100 AS size, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT tenant, id, channel, k, 0 AS request, 1 AS n, size AS total FROM e WHERE k = 1
  UNION ALL SELECT e.tenant, e.id, e.channel, e.k, f.request + (e.channel <> f.channel OR f.n >= 50 OR f.total + e.size > 8000)::INT,
    CASE WHEN e.channel <> f.channel OR f.n >= 50 OR f.total + e.size > 8000 THEN 1 ELSE f.n + 1 END, CASE WHEN e.channel <> f.channel OR f.n >= 50 OR f.total + e.size > 8000 THEN e.size ELSE f.total + e.size END
  FROM f JOIN e ON e.tenant = f.tenant AND e.k = f.k + 1)
SELECT tenant, id, request::BIGINT AS request FROM f""",
    "tenant_batches": _sql(", b AS (SELECT tenant, event_id, (row_number() OVER (PARTITION BY tenant ORDER BY ts, event_id) - 1) // 60 AS batch FROM ing) SELECT tenant, batch, count(*) AS n, min(event_id) AS first_id FROM b GROUP BY 1, 2"),
    "user_sequences": _sql("SELECT source, user_ref, max(sequence) AS last, count(*) AS n FROM ing GROUP BY 1, 2"),
    "injection_plan": "WITH x AS (SELECT 1)" + _PLAN + "SELECT k, slot, variant FROM pl",
    "inject_faults": _sql(_PLAN + ", j AS (SELECT ing.*, variant FROM ing LEFT JOIN pl ON pl.slot = ing.event_id), c AS (SELECT *, count(*) FILTER (variant IS NULL) OVER (PARTITION BY batch_id) AS clean FROM j) SELECT variant, count(*) AS injected, count(*) FILTER (clean = 0) AS appended, count(*) FILTER (variant = 'bad_time' OR time = 'yesterday') AS bad_times FROM c WHERE variant IS NOT NULL GROUP BY 1"),
    "injection_report": _sql(_PLAN.replace("0.02", "0.3") + ", j AS (SELECT ing.*, variant FROM ing LEFT JOIN pl ON pl.slot = ing.event_id), c AS (SELECT *, count(*) FILTER (variant IS NULL) OVER (PARTITION BY batch_id) AS clean FROM j), t AS (SELECT count(DISTINCT batch_id) AS batches, count(variant) AS injected, count(*) FILTER (variant IS NOT NULL AND clean = 0) AS appended, count(*) AS n FROM c) SELECT batches, n + appended AS emitted, injected, appended, round(injected / (n + appended)::DOUBLE, 6) AS rate FROM t"),
    "webhook_fanout": "SELECT o_orderkey, '/careers/tenant_' || lpad((o_custkey % 20)::VARCHAR, 4, '0') AS source, 'src' || (o_custkey % 3) AS utm_source, k, 'com.careerpage.career.' || ['job-viewed', 'application-started', 'application-step-completed', 'application-submitted'][k + 1] AS type FROM orders, range(4) r(k) WHERE o_orderkey % 12 > 0",
    "attribution": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, count(props->>'$.k') AS known FROM events GROUP BY 1",
    "dedup_events": _sql("SELECT source, count(DISTINCT id) AS n FROM ing GROUP BY 1"),
    "sessions": _sql(_S12 + "SELECT user_id, floor(epoch(first_ts))::BIGINT AS start, n, max_step, started, ended FROM ss"),
    "sessions_30_minutes": _sql(_S30 + "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM ss GROUP BY 1"),
    "abandonment": _sql(_S12 + "SELECT user_id, floor(epoch(last_ts))::BIGINT AS last, n FROM ss WHERE started AND NOT ended AND floor(epoch(last_ts)) + 43200 < 1706486400"),
    "funnel_survival": _sql(_S12 + "SELECT k AS step, count(*) AS reached FROM ss, range(1, 6) r(k) WHERE max_step >= k GROUP BY 1"),
    "validation_failures": _sql("SELECT source, code, count(*) AS n FROM ver WHERE code IS NOT NULL GROUP BY 1, 2"),
}
