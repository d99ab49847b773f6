"""Cases that the tables do not hold."""

import hashlib
import hmac
import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet import schemas as S
from rivulet.functions import crypto, text
from rivulet.operators import dlq, faults, metrics, program, ratelimit, skew, validate
from rivulet.sources import adapt, readers
from rivulet.streaming import jobs

GOOD = {"specversion": "1.0", "id": "a", "source": "/careers/t_1", "type": S.EVENT_TYPES[0], "time": "2024-01-01T00:00:00Z", "data": {"candidate": {"user_id": "u"}, "event_payload": {"job_id": "j", "session_id": "s"}}}


def _verdicts(spark, events):
    rows = [(1, i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    v = validate.validate_batches(spark.createDataFrame(rows, "batch_id long, idx long, raw string"))
    return [(r.code, r.reason) for r in v.orderBy("idx").collect()]


def _codes(spark, events):
    return [c for c, _ in _verdicts(spark, events)]


DATA = {"candidate": {"user_id": "u"}, "event_payload": {"job_id": "j", "session_id": "s"}}


@pytest.mark.parametrize("change, reason", [
    ({"shadow": 1, "another": 2}, "UNKNOWN_ATTRIBUTE at $[0]: another"), ({"id": 5}, "SCHEMA at $.id"), ({"time": "2024-01-01"}, "BAD_TIME at $.time"), ({"source": "/careers/"}, "BAD_SOURCE at $.source"),
    ({"type": "other"}, "SCHEMA at $.type"), ({"specversion": None}, "SCHEMA at $.specversion"), ({"data": 3}, "SCHEMA at $.data"), ({"data": {}}, "SCHEMA at $.data"),
    ({"data": DATA | {"candidate": {}}}, "SCHEMA at $.data.candidate"), ({"data": DATA | {"candidate": {"user_id": "u", "age": 3}}}, "SCHEMA at $.data.candidate"),
    ({"data": DATA | {"event_payload": {"job_id": "j", "session_id": "s", "recommended_job_ids": [1, 2]}}}, "SCHEMA at $.data.event_payload.recommended_job_ids[...]"),
    ({"data": DATA | {"event_payload": {"job_id": "j", "session_id": "s", "recommended_job_ids": ["1"], "client_metadata": {"a": [1, {"b": None}]}}}}, None),
    ({"data": DATA | {"event_payload": {"job_id": "j", "session_id": "s", "completion_method": "GUESS"}}}, "SCHEMA at $.data.event_payload.completion_method"),
    ({"data": DATA | {"event_payload": {"job_id": "j", "session_id": "s", "step_number": "1"}}}, "SCHEMA at $.data.event_payload.step_number"),
    ({"data": DATA | {"candidate": {"user_id": "u", "years_of_experience": "3", "experience_status": "OLD"}}}, "SCHEMA at $.data.candidate.experience_status"),
])
def test_reasons_name_paths(spark, change, reason):
    assert _verdicts(spark, [GOOD | change])[0][1] == reason


def test_one_rejection_for_several_tenants(spark):
    got = _verdicts(spark, [GOOD, GOOD | {"source": "/careers/t_2"}, "nonsense"])
    assert got == [("MIXED_TENANT", "MIXED_TENANT: spans more than one tenant"), ("MIXED_TENANT", None), ("MIXED_TENANT", None)]
    assert _verdicts(spark, ["nonsense", "[1]"])[1] == ("SCHEMA", "SCHEMA at $[1]: not an object")
    big = GOOD | {"subject": "x" * 70_000}
    assert _verdicts(spark, [big]) == [("OVERSIZED", "OVERSIZED at $[0]: exceeds 65536 bytes")]


@pytest.mark.parametrize("change, code", [
    ({}, None), ({"shadow": 1}, "UNKNOWN_ATTRIBUTE"), ({"id": 5}, "SCHEMA"), ({"id": ""}, "BAD_ID"), ({"time": "2024-01-01"}, "BAD_TIME"),
    ({"source": "/careers/"}, "BAD_SOURCE"), ({"type": "other"}, "SCHEMA"), ({"specversion": "2.0"}, "SCHEMA"), ({"sourcechannel": "FAX"}, "SCHEMA"),
    ({"data": {"candidate": {"user_id": "u", "age": 3}, "event_payload": {"job_id": "j", "session_id": "s"}}}, "SCHEMA"),
    ({"data": {"candidate": {"user_id": "u", "years_of_experience": 3.5}, "event_payload": {"job_id": "j", "session_id": "s", "step_number": 1}}}, None),
    ({"keyversion": "1"}, "SCHEMA"), ({"subject": None}, None), ({"time": "9999-99-99T99:99:99Z"}, None),
])
def test_verdicts(spark, change, code):
    assert _codes(spark, [GOOD | change]) == [code]


def test_order_of_verdicts(spark):
    assert _codes(spark, [GOOD, GOOD, GOOD | {"time": "x", "source": "y"}, "[1]", "nonsense", GOOD | {"id": "b"}]) == ["MIXED_TENANT"] * 6
    assert _codes(spark, [GOOD | {"time": "x"}, GOOD, GOOD, "[1]", "nonsense", GOOD | {"id": "b"}]) == ["BAD_TIME", None, "DUPLICATE_ID", "SCHEMA", "SCHEMA", None]


def test_limits_and_empty_bodies(spark):
    df = spark.createDataFrame([(1, "[]"), (2, "{}"), (3, None), (4, json.dumps([{"a": "x" * 60}])), (5, "[1,2,3]")], "batch_id long, body string")
    got = {r.batch_id: r.code for r in validate.batch_limits(df, 10**6, 2, 50).collect()}
    assert got == {1: None, 2: "BODY_NOT_A_BATCH", 3: "BODY_NOT_A_BATCH", 4: "EVENT_TOO_LARGE", 5: "TOO_MANY_EVENTS"}
    assert validate.batch_limits(df, 5).where("batch_id = 4").first().code == "BODY_TOO_LARGE"


ENC, MAC = "4417c2a69bbd29056cd2335c4bdaf848dd60a2d506eb53913adab53cbb31efbc", "e94ec8c9b917dea3a7d691164616b9b9efa37379f8dca894866b14b2363b2fa5"


def test_hmac_and_keys(spark):
    # HKDF-SHA256 with the tenant's name as salt, infos "enc" and "mac"
    enc, mac = crypto.tenant_keys(b"k" * 32, "t")
    assert (enc.hex(), mac.hex()) == (ENC, MAC)
    k = crypto.key_dimension(spark, b"k" * 32, ["t"])
    got = k.select(crypto.pseudonym(F.lit("usr_1")).alias("p")).first().p
    assert got == hmac.new(mac, b"usr_1", hashlib.sha256).hexdigest() and enc != mac
    with pytest.raises(ValueError):
        crypto.tenant_keys(b"short", "t")


def test_ciphertext_is_bound_to_its_place(spark):
    k = crypto.key_dimension(spark, b"k" * 32, ["t"])
    aad, other = crypto.bound_data(F.lit("a"), F.lit("bc")), crypto.bound_data(F.lit("ab"), F.lit("c"))
    x = k.withColumn("tok", crypto.encrypt_field(F.lit("x" * 200), F.col("enc_key"), F.col("keyversion"), aad))
    r = x.select(crypto.decrypt_field(F.col("tok"), F.col("enc_key"), aad).alias("ok"), crypto.decrypt_field(F.col("tok"), F.col("enc_key"), other).alias("bad"), crypto.decrypt_field(F.lit("junk"), F.col("enc_key"), aad).alias("junk")).first()
    assert (r.ok, r.bad, r.junk) == ("x" * 200, None, None)


def test_apportion_loses_nothing(spark):
    w = spark.createDataFrame([(i, float(x)) for i, x in enumerate((3, 1, 1, 1, 0.5))], "i int, w double")
    assert sum(r.units for r in skew.apportion(w, "w", 100, "i").collect()) == 100


def test_bucket_refills_to_its_burst_only(spark):
    rows = spark.createDataFrame([("t", 0.0, 1, 3), ("t", 1.0, 2, 1), ("t", 100.0, 3, 3), ("u", 0.0, 4, 9)], "tenant string, at double, id long, n long")
    got = {r.id: (r.allowed, r.retry_after) for r in ratelimit.token_buckets(rows, spark.createDataFrame([("t", 0.5, 3.0)], "tenant string, rate double, burst double"), (1.0, 5.0)).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (False, 1)}


def test_quantile_of_nothing_and_of_the_last_bucket(spark):
    empty = spark.createDataFrame([], "v double")
    assert metrics.bucket_quantile(metrics.histogram(empty, F.col("v"), [1, 2]), 0.5).first().value is None
    high = metrics.histogram(spark.createDataFrame([(9.0,)], "v double"), F.col("v"), [1, 2])
    assert metrics.bucket_quantile(high, 0.5).first().value is None


def test_names_and_sequences(spark):
    df = spark.createDataFrame([("/careers/a-1", " 007 "), ("/careers/", "1_0"), (None, "99999999999999999999")], "s string, q string")
    assert [tuple(r) for r in df.select(text.tenant_of(F.col("s")), text.sequence_number(F.col("q"))).collect()] == [("a-1", 7), (None, None), (None, None)]


def test_partner_is_nearest_clean(spark):
    rows = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", "x"), (2, 0, "c", "x"), (2, 1, "d", None), (3, 0, "e", "x")], "batch_id int, idx int, id string, variant string")
    got = {r.id: (r.partner_id, r.appended) for r in faults.partners(rows).where("variant is not null").collect()}
    assert got == {"b": ("a", False), "c": ("d", False), "e": (None, True)}


def test_schema_drift():
    other = T.StructType([f for f in S.LEDGER if f.name != "seq"] + [T.StructField("x", T.LongType())])
    assert S.drift(S.LEDGER, S.LEDGER) == [] and S.drift(other, S.LEDGER) == ["seq", "x"]


def test_ledger_lines_that_do_not_parse(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"id":"a","source":"s","seq":1}\nnot json\n')
    got = readers.read_ledger(spark, str(p)).cache()
    assert got.count() == 2 and got.where("_corrupt is not null").count() == 1


def _requests(spark):
    from rivulet.plans import ingest

    r = adapt.ingress(adapt.table(spark, "/root/testdata/sf0.001", "events"))
    at = r.groupBy("batch_id").agg(F.unix_timestamp(F.min("ts").cast("timestamp")).cast("double").alias("at"))
    run = lambda b, state=None: program.ingest(b, *ingest._dimensions(spark), ingest._keys(spark), ingest._limits(spark), (0.0001, 25.0), max_bytes=2000, state=state)
    return adapt.requests(r, long_names=True).join(ingest._claims(r), "batch_id").join(at, "batch_id"), run


def test_streaming_dedup_and_order(spark, tmp_path):
    top = adapt.topic(adapt.ingress(adapt.table(spark, "/root/testdata/sf0.001", "events")))
    src = str(tmp_path / "t")
    top.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.parquet(src)
    s = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    for name, df in (("uniq", jobs.deduplicated(s)), ("late", jobs.ordering_monitor(s))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    from rivulet.operators import sessions
    from rivulet.operators.reconcile import ordering_violations

    assert spark.table("uniq").count() == sessions.deduplicated(top).count()
    assert spark.table("late").agg(F.sum("violations")).first()[0] == ordering_violations(top).where("late").count()


def test_timers_follow_event_time(spark, tmp_path):
    """Two files, read one after the other: what lies behind the watermark of the first is evicted or abandoned in the second."""
    src = str(tmp_path / "e")
    kind = "user_id long, type string, ts timestamp, source string, user_ref string, partition int, offset long, seq long"
    rows = [[(1, "application-started", "2024-01-01 00:00:00", "s", "a", 0, 0, 5), (2, "application-started", "2024-01-01 00:00:00", "s", "b", 0, 1, 1), (2, "application-submitted", "2024-01-01 00:05:00", "s", "b", 0, 2, 2)], [(3, "job-viewed", "2024-01-01 09:00:00", "s", "c", 0, 3, 1)], [(3, "job-viewed", "2024-01-01 09:01:00", "s", "c", 0, 4, 0)]]
    for k, part in enumerate(rows):
        x = spark.createDataFrame([(*r[:2], None, *r[3:]) for r in part], kind).withColumn("ts", F.to_timestamp(F.element_at(F.array(*[F.lit(r[2]) for r in part]), (F.col("offset") - part[0][6] + 1).cast("int"))))
        x.coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    s = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    for name, df in (("quiet", jobs.abandonment(s)), ("order", jobs.ordering_monitor(s))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
    assert [(r.user_id, r.n) for r in spark.table("quiet").collect()] == [(1, 1)]
    assert {r.user_ref for r in spark.table("order").where("evicted = 1").collect()} == {"a", "b"}
    assert spark.table("order").agg(F.sum("violations")).first()[0] == 1


def test_every_order_becomes_a_webhook(spark):
    from rivulet.plans import planning

    sf = "/root/testdata/sf0.001"
    got = {r.o_orderkey: r.n for r in planning.webhook_fanout(spark, sf).groupBy("o_orderkey").agg(F.count("*").alias("n")).collect()}
    # a call without a job_id is rejected; every other order gives its four events
    assert got == {r.o_orderkey: 4 for r in adapt.table(spark, sf, "orders").collect() if r.o_orderkey % 12}


def test_injection_is_exact_on_ids_with_gaps_and_repeats(spark, tmp_path):
    from rivulet.plans import planning

    e = adapt.table(spark, "/root/testdata/sf0.001", "events").withColumn("event_id", F.floor(F.col("event_id") / 2) * 5 + 1000)
    e.write.parquet(str(tmp_path / "events.parquet"))
    n = e.count()
    assert sum(r.injected for r in planning.inject_faults(spark, str(tmp_path)).collect()) == skew.injected_total(n, 0.02)
    places = faults.placed(e, "event_id", "ts", "user_id").select("place", "event_id").orderBy("place").collect()
    assert [r.place for r in places] == list(range(n)) and [r.event_id for r in places] == sorted(r.event_id for r in places)
    assert faults.placed(e.where("event_id < 0"), "event_id").count() == 0


def test_no_window_ranks_one_row_per_key(spark):
    n = [7, 7, 7, 1, 1, 2, 9, 9, 3, 5] * 12
    counts = spark.createDataFrame([(i, x) for i, x in enumerate(n)], "k int, n long")
    report, down, up = skew.report(counts), sorted(n, reverse=True), sorted(n)
    share = lambda p: round(sum(down[: max(1, int(len(n) * p))]) / sum(n), 4)
    assert tuple(report.first()) == (sum(n), len(n), share(0.01), share(0.05), 9, up[len(n) // 2], 1)
    assert "Aggregate [n#" in report._jdf.queryExecution().optimizedPlan().toString().rpartition("Window")[2]
    labels = spark.createDataFrame([("b", 2), (None, 1), ("a", 3), ("a", 4), ("c", 5)], "label string, at long")
    capped = metrics.capped_labels(labels, "label", "at", 2)
    assert sorted(map(tuple, capped.collect()), key=repr) == sorted([(None, 1, 0), ("b", 1, 0), (S.OTHER, 3, 3)], key=repr)
    assert "Window" not in capped._jdf.queryExecution().optimizedPlan().toString()


def test_sinks_keep_keys_together_and_report(spark, tmp_path):
    from rivulet.operators import reconcile
    from rivulet.sources import sinks

    rows = spark.createDataFrame([(f"k{i % 7}", i, None if i % 5 else "x") for i in range(70)], "key string, n int, note string")
    records = sinks.as_records(rows, "key")
    assert json.loads(records.where("value like '%note%'").first().value)["note"] == "x"
    sinks.publish_files(records, str(tmp_path / "p"), 3)
    back = spark.read.parquet(str(tmp_path / "p")).withColumn("file", F.input_file_name())
    assert back.count() == 70 and back.groupBy("key").agg(F.count_distinct("file").alias("f")).where("f > 1").count() == 0
    for _ in range(2):
        sinks.append_json(rows.select("key", "n"), str(tmp_path / "ledger"))
    assert spark.read.json(str(tmp_path / "ledger")).count() == 140
    led = spark.createDataFrame([("s1", "a", "t", 1, 0), ("s1", "b", "t", 2, 1), ("s2", "a", "t", 1, 2)], "source string, id string, type string, seq long, line long")
    top = spark.createDataFrame([("s1", "a", "t", "u", 1, 0, 0), ("s1", "b", "t", "u", 2, 0, 1)], "source string, id string, type string, user_ref string, seq long, partition int, offset long")
    dead = spark.createDataFrame([("s2", "SCHEMA at $.type", "s2", "a", "t")], "source string, reason string, rejected_source string, rejected_id string, rejected_type string")
    ends, none = readers.drained(top, spark.createDataFrame([(0, 2)], "partition int, end long")), spark.createDataFrame([(0,)], "n long")
    told = lambda led_, **more: reconcile.summary(led_, top, dead, text.code_of(F.col("reason")), "line", ends, none, pseudonyms=False, **more).first()
    good = told(led, expected_dlq=1)
    assert good.verdict == "PASS" and good.failures == [] and good.pseudonym_mismatches is None and (good.accepted, good.stored, good.dlq) == (3, 2, 1)
    assert told(led, expected_dlq=2).failures == ["dlq_off: 1"] and told(led, expected_duplicates=1).failures == ["duplicates_off: 1"]
    assert told(led.where("id = 'a'")).failures == ["unexpected: 1"] and told(led.where("id > 'z'")).verdict == "UNVERIFIED"
    sinks.report(reconcile.counts(reconcile.presence(led, top, dead), dead), reconcile.group_deltas(led, top, dead, "source"), str(tmp_path / "r"), shown=1)
    assert spark.read.json(str(tmp_path / "r/summary")).first().expected == 3
    assert spark.read.parquet(str(tmp_path / "r/groups")).count() == 2 and spark.read.json(str(tmp_path / "r/first")).first().group == "s1"


def test_letters_that_do_not_decode(spark):
    x = readers.decode_letters(spark.createDataFrame([("k", '{"source":"/careers/a"}'), ("k", "junk"), ("k", None)], "key string, value string"))
    assert [r.decoded for r in x.collect()] == [False] * 3


def test_tenants_go_to_one_of_the_shards_by_their_digest(spark):
    from rivulet.plans import planning

    got = planning.tenant_shards(spark, "/root/testdata/sf0.001").collect()
    assert {r.tenant: r.shard for r in got} == {r.tenant: int.from_bytes(hashlib.blake2b(r.tenant.encode(), digest_size=8).digest(), "big") % 4 for r in got}
    assert sum(r.n for r in got) == adapt.table(spark, "/root/testdata/sf0.001", "events").count()


def test_no_event_of_an_unknown_tenant_passes_unsealed(spark):
    k = crypto.key_dimension(spark, b"k" * 32, ["t"])
    rows = spark.createDataFrame([("t", "s", "i", "y", "u", None), ("x", "s", "j", "y", "u", "a@b")], "tenant string, source string, id string, type string, user_id string, email string")
    good = crypto.protect(rows.where("tenant = 't'"), k).first()
    assert good.email_enc is None and good.email_hmac is None and len(good.user_id_pseudo) == 64
    with pytest.raises(Exception, match="no keys for tenant x"):
        crypto.protect(rows, k).collect()


def test_calls_with_foreign_keys_are_refused(spark):
    call = {k: "x" for k in readers.WEBHOOK_KEYS[:-1]} | {"applicant": {"candidate_ref": "c"}}
    bodies = [call, call | {"more": 1}, call | {"applicant": {"candidate_ref": "c", "age": 3}}, call | {"applicant": {}}, {k: v for k, v in call.items() if k != "utm_medium"}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "junk"), (10, None)], "i int, body string")
    assert [r.i for r in readers.parse_webhooks(df).where("ok").collect()] == [0]


def test_an_appended_partner_is_clean(spark):
    rows = spark.createDataFrame([(1, 0, "a", "t", "now", "duplicate_id"), (1, 1, "b", "t", "now", "bad_time"), (2, 0, "c", "t", "now", None), (2, 1, "d", "t", "now", "duplicate_id")], "batch_id int, idx int, id string, type string, time string, variant string")
    got = sorted((r.batch_id, r.idx, r.id, r.time, r.variant) for r in faults.emitted(faults.partners(rows)).collect())
    assert got == sorted([(1, 0, "a", "now", "duplicate_id"), (1, 1, "b", "yesterday", "bad_time"), (1, 2, "a", "now", None), (1, 3, "b", "now", None), (2, 0, "c", "now", None), (2, 1, "c", "now", "duplicate_id")], key=lambda r: r[:3])


def test_a_real_frame_against_its_declaration(spark):
    led = adapt.ledger(adapt.ingress(adapt.table(spark, "/root/testdata/sf0.001", "events")))
    assert S.drift(led.schema, S.LEDGER) == ["event_id"] and S.drift(led.drop("event_id").schema, S.LEDGER) == []
