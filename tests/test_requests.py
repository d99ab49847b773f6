"""Requests as clients send them, rotated keys, replay, and answers from summaries and narrowed ranges."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rivulet import schemas as S
from rivulet.functions import crypto
from rivulet.operators import decrypt, metrics, program, replay, summaries, validate
from rivulet.sources import readers

from .test_operators import DATA, GOOD

TENANT = "t_1"


def ask(spark, bodies, **more):
    """The ingest program over (batch_id, body) rows of one tenant."""
    rows = [(b, float(k), body, TENANT, "cred", None) for k, (b, body) in enumerate(bodies)]
    r = spark.createDataFrame(rows, "batch_id string, at double, body string, token_tenant string, credential_id string, channel_hint string")
    tenants = spark.createDataFrame([(TENANT,)], "tenant string")
    creds = spark.createDataFrame([("cred", TENANT, "WEB_APP")], "credential_id string, tenant string, channel string")
    limits = spark.createDataFrame([], "tenant string, rate double, burst double")
    keys = crypto.key_dimension(spark, b"k" * 32, [TENANT])
    return program.ingest(r, tenants, creds, keys, limits, more.pop("default", (1000.0, 1000.0)), **more)


def test_requests_of_any_id_and_repeated_keys(spark):
    twice = json.dumps(GOOD)[:-1] + ', "id": "b"}'
    got = ask(spark, [("req-1", json.dumps([GOOD])), ("req-2", f"[{twice}, {json.dumps(GOOD | {'id': 'c'})}]"), ("x/y", '[{"id": "q", "id": 5}]'), ("", "junk")])
    told = {r.batch_id: (r.status, r.accepted, [tuple(x) for x in r.rejected]) for r in got.responses.collect()}
    assert told == {"req-1": (202, 1, []), "req-2": (202, 2, []), "x/y": (202, 0, [(0, "SCHEMA at $.id")]), "": (400, 0, [])}
    ids = {json.loads(r.value)["id"] for r in got.published.collect()}
    assert ids == {"a", "b", "c"}
    assert readers.split_batches(spark.createDataFrame([(1, f"[{twice}]")], "batch_id long, body string")).count() == 1


def test_dead_letters_have_their_times_and_fields(spark):
    from rivulet.operators import dlq

    got = ask(spark, [("r", json.dumps([GOOD | {"id": ""}]))])
    letter = json.loads(dlq.letter_records(got.letters).first().value)
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"
    assert F.lit(1) is not None and __import__("re").match(stamp, letter["time"]) and letter["data"]["error_context"]["failed_at"] == letter["time"]
    assert "field" not in letter["data"]["error_context"] and letter["data"]["error_context"]["retry_count"] == 0
    bad = got.letters.select("batch_id", F.col("index").alias("idx"), "reason", F.lit("{}").alias("raw")).withColumns({"field": F.lit("$.id"), "retry_count": F.lit(2)})
    again = json.loads(dlq.letter_records(dlq.dead_letters(bad)).first().value)["data"]["error_context"]
    assert (again["field"], again["retry_count"]) == ("$.id", 2)


def test_sizes_leave_out_what_is_the_default(spark):
    plain = GOOD | {"data": DATA}
    full = plain | {"datacontenttype": "application/json", "data": {"candidate": DATA["candidate"], "event_payload": DATA["event_payload"] | {"recommended_job_ids": [], "client_metadata": {}}}}
    rich = plain | {"datacontenttype": "text/plain", "data": {"candidate": DATA["candidate"], "event_payload": DATA["event_payload"] | {"recommended_job_ids": ["j"], "client_metadata": {"a": 1}}}}
    # the contract's form, written out by hand
    want = '{"specversion":"1.0","id":"a","source":"/careers/t_1","type":"com.careerpage.career.job-viewed","time":"2024-01-01T00:00:00Z","data":{"candidate":{"user_id_pseudo":"u"},"event_payload":{"job_id":"j","session_id":"s"}}}'
    df = spark.createDataFrame([(json.dumps(e),) for e in (plain, full, rich)], "raw string").withColumn("e", F.from_json("raw", S.INGRESS_EVENT))
    sizes = [r[0] for r in df.select(program.contract_size(F.col("e"))).collect()]
    assert sizes == [len(want), len(want), len(want) + len('"datacontenttype":"text/plain",') + len(',"recommended_job_ids":["j"],"client_metadata":{"a":1}')]
    for limit, status in ((len(want), []), (len(want) - 1, ["OVERSIZED"])):
        v = ask(spark, [("r", json.dumps([full]))], max_bytes=limit).letters.where("stage = 'validate'").collect()
        assert [x.reason.split()[0] for x in v] == status
    value = json.loads(ask(spark, [("r", json.dumps([full]))]).published.first().value)
    assert "datacontenttype" not in value and set(value["data"]["event_payload"]) == {"job_id", "session_id"}


def test_a_foreign_partition_hint_refuses_the_request(spark):
    key = ask(spark, [("r", json.dumps([GOOD]))]).published.first().key
    got = ask(spark, [("own", json.dumps([GOOD | {"partitionkey": key}])), ("other", json.dumps([GOOD, GOOD | {"id": "b", "partitionkey": "t_1|x"}, "bad"]))])
    assert {r.batch_id: (r.status, r.why, r.accepted, len(r.rejected)) for r in got.responses.collect()} == {"own": (202, None, 1, 0), "other": (403, "PARTITION_HINT", 0, 0)}
    assert got.letters.count() == 0 and got.published.count() == 1


def test_verdicts_need_no_exchange(spark):
    r = spark.createDataFrame([(1, json.dumps([GOOD, GOOD, GOOD | {"id": "b"}]))], "batch_id long, body string")
    v = validate.verdict_rows(validate.judged(validate.limited(r), validate.numbered("raws")), "batch_id")
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("from_json") <= 1
    assert [x.code for x in v.orderBy("idx").collect()] == [None, "DUPLICATE_ID", None]


def test_keys_with_versions(spark):
    keys = crypto.key_dimension(spark, b"k" * 32, ["t", "o"]).unionByName(crypto.key_dimension(spark, b"n" * 32, ["t"], 2, 100.0))
    rows = spark.createDataFrame([("t", "s", "i", "y", "u", "a@b", 99.0), ("t", "s", "j", "y", "u", "c@d", 100.0), ("o", "s", "k", "y", "u", "e@f", 500.0)], "tenant string, source string, id string, type string, user_id string, email string, at double")
    from rivulet.staging import staged

    sealed = staged(crypto.protect(rows, keys, "at"), "t")
    got = {r.id: r for r in sealed.collect()}
    assert len(got) == 3 == sealed.count() and [got[i].keyversion for i in "ijk"] == [1, 2, 1] and got["i"].user_id_pseudo != got["j"].user_id_pseudo
    assert crypto.protect(rows, keys).where("id = 'i'").first().keyversion == 2
    asked = sealed.select(F.col("id").alias("request_id"), F.col("id").alias("actor"), F.lit(True).alias("authorized"), F.lit(0.0).alias("at"), F.col("tenant").alias("career_site_id"), "source", "id", "type", F.lit("email").alias("field"), F.col("email_enc").alias("token"))
    value = lambda df, k=keys: {r.request_id: (r.status, r.reason, r.value) for r in decrypt.answer(df, k).collect()}
    assert value(asked) == {"i": (200, None, "a@b"), "j": (200, None, "c@d"), "k": (200, None, "e@f")}
    # an unknown version, and the right one over another key's ciphertext
    for prefix in ("7", "1"):
        assert value(asked.where("id = 'j'").withColumn("token", F.concat(F.lit(prefix), F.expr("substr(token, 2)"))))["j"] == (400, "DECRYPT_FAILED", None)


@pytest.mark.parametrize("column, why", [("authorized", "UNAUTHORIZED"), ("actor", None), ("at", None), ("career_site_id", "UNKNOWN_TENANT"), ("source", "DECRYPT_FAILED"), ("id", "DECRYPT_FAILED"), ("type", "DECRYPT_FAILED"), ("field", "UNKNOWN_FIELD"), ("token", "DECRYPT_FAILED"), ("request_id", "RATE_LIMITED")])
def test_nulls_open_nothing(spark, column, why):
    keys = crypto.key_dimension(spark, b"k" * 32, ["t"])
    rows = spark.createDataFrame([("t", "s", "i", "y", "u", "a@b")], "tenant string, source string, id string, type string, user_id string, email string")
    asked = crypto.protect(rows, keys).select(F.lit(1).alias("request_id"), F.lit("op").alias("actor"), F.lit(True).alias("authorized"), F.lit(0.0).alias("at"), F.col("tenant").alias("career_site_id"), "source", "id", "type", F.lit("email").alias("field"), F.col("email_enc").alias("token"))
    got = decrypt.answer(asked.withColumn(column, F.lit(None).cast(asked.schema[column].dataType)), keys).first()
    if why:
        assert (got.reason, got.value) == (why, None)


def test_replay_ends_for_every_letter(spark):
    late = GOOD | {"id": "late", "time": "soon"}
    events = [GOOD | {"id": ""}, late, GOOD | {"id": "odd", "shadow": 1}, GOOD | {"id": "both", "shadow": 1, "time": "soon"}, GOOD]
    first = ask(spark, [("a", json.dumps(events)), ("b", json.dumps([late])), ("c", json.dumps([GOOD | {"id": "c", "time": "soon"}]))])
    letters = first.letters
    assert letters.count() == 6
    mend = lambda raw, why: F.when(why.startswith("BAD_TIME"), F.replace(raw, F.lit('"soon"'), F.lit('"2024-01-01T00:00:00Z"'))).when(why.startswith("UNKNOWN"), F.regexp_replace(raw, '"shadow":1,?', "")).otherwise(raw)
    claims = spark.createDataFrame([("a", 1.0, TENANT, "cred", None), ("b", 2.0, TENANT, "stranger", None)], "batch_id string, at double, token_tenant string, credential_id string, channel_hint string")

    def run(requests):
        return program.ingest(requests, spark.createDataFrame([(TENANT,)], "tenant string"), spark.createDataFrame([("cred", TENANT, "WEB_APP")], "credential_id string, tenant string, channel string"), crypto.key_dimension(spark, b"k" * 32, [TENANT]), spark.createDataFrame([], "tenant string, rate double, burst double"), (1000.0, 1000.0))

    got = {(r.batch_id, r["index"]): (r.fate, r.retry_count, r.reason) for r in replay.rounds(letters, claims, run, 2, mend).collect()}
    assert got == {
        ("a", 0): ("rejected", 1, "BAD_ID at $.id"), ("a", 1): ("published", 1, None), ("a", 2): ("published", 1, None), ("a", 3): ("published", 2, None),
        ("b", 0): ("parked", 2, "CREDENTIAL_MISMATCH"), ("c", 0): ("parked", 2, "BAD_TIME at $.time"),
    }
    assert replay.rounds(letters.where("false"), claims, run, 2, mend).count() == 0


def test_replay_publishes_what_a_round_has_sealed(spark):
    """A mended letter that only encryption makes too large is sealed from then on: it is not sealed again."""
    long = GOOD | {"time": "soon", "data": DATA | {"candidate": DATA["candidate"] | {"name": "n" * 1500}}}
    fine = GOOD | {"id": "fine", "time": "soon"}
    more = {"max_bytes": 2000}
    letters = ask(spark, [("a", json.dumps([fine, long, GOOD | {"id": ""}])), ("b", json.dumps([long | {"shadow": 1}]))], **more).letters
    claims = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "batch_id string, at double").withColumns({"token_tenant": F.lit(TENANT), "credential_id": F.lit("cred"), "channel_hint": F.lit(None).cast("string")})
    mend = lambda raw, why: F.when(why.startswith("BAD_TIME"), F.replace(raw, F.lit('"soon"'), F.lit('"2024-01-01T00:00:00Z"'))).when(why.startswith("UNKNOWN"), F.regexp_replace(raw, '"shadow":1,?', "")).otherwise(raw)

    def run(requests):
        return program.ingest(requests, spark.createDataFrame([(TENANT,)], "tenant string"), spark.createDataFrame([("cred", TENANT, "WEB_APP")], "credential_id string, tenant string, channel string"), crypto.key_dimension(spark, b"k" * 32, [TENANT]), spark.createDataFrame([], "tenant string, rate double, burst double"), (1000.0, 1000.0), **more)

    got = {(r.batch_id, r["index"]): (r.stage, r.fate, r.retry_count, r.reason) for r in replay.rounds(letters, claims, run, 3, mend).collect()}
    assert got == {
        ("a", 0): ("validate", "published", 1, None), ("a", 1): ("validate", "published", 1, None), ("a", 2): ("validate", "rejected", 1, "BAD_ID at $.id"),
        ("b", 0): ("validate", "published", 2, None),
    }


def keyed(spark, rows):
    return spark.createDataFrame(rows, "source string, id string")


@pytest.mark.parametrize("apart", [0, 3, 60, 900])
def test_summaries_tell_what_a_join_tells(spark, apart):
    r = random.Random(apart)
    same = [("s", f"k{i}") for i in range(3000)] + [("s", "hot")] * 500 + [(None, "x"), ("s", None)]
    a = same + [("a", f"n{i}") for i in range(apart)] + [("d", f"m{i}") for i in range(apart // 3)] * 3
    b = same + [("b", f"n{i}") for i in range(apart // 2)] + [("d", f"m{i}") for i in range(apart // 3)] + ([("s", "hot")] * 2 if apart else [])
    r.shuffle(a)
    count = lambda x: Counter(k for k in x if None not in k)
    want = sorted((*k, count(a)[k], count(b)[k]) for k in count(a).keys() | count(b).keys() if count(a)[k] != count(b)[k])
    got, cells = summaries.differing(keyed(spark, a), keyed(spark, b), ["source", "id"])
    assert sorted(map(tuple, got.collect())) == want and cells is not None
    got, cells = summaries.differing(keyed(spark, a), keyed(spark, b), ["source", "id"], limit=40)
    assert sorted(map(tuple, got.collect())) == want and (cells is None) == (apart > 60 or (apart == 60 and cells is None))


def test_cells_come_apart_or_say_that_they_do_not():
    r = random.Random(4)
    keys = {r.randrange(1 << 62): r.choice([1, -1, 2, -3]) for _ in range(40)}
    for cells in (240, 40):
        width, table = cells // 4, {}
        for d, n in keys.items():
            for i, p in enumerate(summaries._PLACES):
                c = table.setdefault(d % p % width + i * width, [0, 0, 0])
                for j, x in enumerate((n, n * d, n * summaries._check(d))):
                    c[j] += x
        assert summaries.peel([(k, *v) for k, v in table.items()], cells) == (keys if cells == 240 else None)
    assert summaries.peel([], 64) == {}


@pytest.mark.parametrize("kind", ["double", "long", "ties"])
def test_quantiles_by_narrowed_ranges(spark, kind):
    r = random.Random(7)
    draw = {"double": lambda: r.gauss(0, 1) ** 3, "long": lambda: r.randrange(-(10**12), 10**12), "ties": lambda: r.choice([1, 2, 2, 2, 3]) * 1.5}[kind]
    rows = [(r.choice(["a", "b", "b", "b", None]), draw()) for _ in range(6000)] + [("one", draw()), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, f"g string, v {'long' if kind == 'long' else 'double'}").repartition(4)
    qs = [0.0, 0.001, 0.5, 0.9, 0.999, 1.0]
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        want |= {(g, q): v[max(1, -int(-q * len(v) // 1)) - 1] for q in qs}
    for most, accuracy in ((100_000, 10_000), (20, 50), (3, 4)):
        got = {(x.g, x.q): x.value for x in metrics.exact_quantiles(df, "g", "v", qs, most, accuracy).collect()}
        assert got == want


def test_webhooks_take_texts_only(spark):
    call = {k: "x" for k in readers.WEBHOOK_KEYS[:-1]} | {"applicant": {"candidate_ref": "c"}}
    bodies = [call, call | {"partner": 5}, call | {"applicant": {"candidate_ref": 7}}, call | {"applicant": {"candidate_ref": "c", "email_enc": None}}, call | {"applicant": {"candidate_ref": "c", "email_enc": 1}}, call | {"job_id": None}, call | {"applicant": ["candidate_ref"]}, call | {"applicant": None}, call | {"utm_source": {"a": 1}}]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(20, json.dumps(call)[:-1] + ', "partner": "y"}')], "i int, body string")
    got = {r.i: (r.ok, r.partner) for r in readers.parse_webhooks(df).collect()}
    assert {i for i, x in got.items() if x[0]} == {0, 3, 20}


def test_published_events_are_decoded_strictly(spark):
    value = json.loads(ask(spark, [("r", json.dumps([GOOD | {"data": {"candidate": {"user_id": "u", "email": "a@b", "years_of_experience": 3.5}, "event_payload": {"job_id": "j", "session_id": "s", "client_metadata": {"a": [1, None]}}}}]))]).published.first().value)
    data = value["data"]
    odd = [value | {"shadow": 1}, {k: v for k, v in value.items() if k != "time"}, value | {"keyversion": "1"}, value | {"type": "other"}, value | {"sourcechannel": "FAX"}, value | {"data": data | {"candidate": data["candidate"] | {"user_id": "plain"}}}, value | {"data": {"candidate": data["candidate"]}}]
    rows = [(0, json.dumps(value)), *[(i + 1, json.dumps(o)) for i, o in enumerate(odd)], (90, "junk"), (91, None), (92, "[]")]
    got = readers.decode_published(spark.createDataFrame(rows, "i int, value string"))
    assert [r.i for r in got.where("ok").collect()] == [0] and got.where("ok").first().e.keyversion == 1
    assert S.drift(S.PUBLISHED_EVENT, S.INGRESS_EVENT) == ["data"]


def test_what_was_not_read_whole_is_not_verified(spark, tmp_path):
    from rivulet.functions import text
    from rivulet.operators import faults, reconcile
    from rivulet.sources import sinks

    led = spark.createDataFrame([("s1", "a", "t", 1, 0, None), ("s1", "b", "t", 2, 1, None), ("s1", "c", "t", 3, 2, None)], "source string, id string, type string, seq long, line long, _corrupt string")
    top = spark.createDataFrame([("s1", "a", "t", "u", 1, 0, 0), ("s1", "z", "t", "u", 2, 0, 1)], "source string, id string, type string, user_ref string, seq long, partition int, offset long")
    dead = spark.createDataFrame([], "source string, reason string, rejected_source string, rejected_id string, rejected_type string")
    none = spark.createDataFrame([(0,)], "n long")
    told = lambda led_, end: reconcile.summary(led_, top, dead, text.code_of(F.col("reason")), "line", readers.drained(top, spark.createDataFrame([(0, end)], "partition int, end long")), none, pseudonyms=False)
    assert told(led, 2).first().verdict == "FAIL" and told(led, 3).first().verdict == "UNVERIFIED" and told(led.where("id > 'z'"), 2).first().verdict == "UNVERIFIED"
    broken = led.unionByName(spark.createDataFrame([(None, None, None, None, 9, '{"id":')], led.schema))
    x = told(broken, 2).first()
    assert x.verdict == "UNVERIFIED" and x.ledger_rows == 3
    found = reconcile.presence(led, top, dead)
    assert [tuple(r) for r in reconcile.samples(found, 1).collect()] == [("missing", "s1", "b"), ("unexpected", "s1", "z")]
    sinks.report(told(led, 2), reconcile.group_deltas(led, top, dead, "source"), str(tmp_path), samples=reconcile.samples(found), failures=1)
    first = spark.read.json(str(tmp_path / "failures")).first()
    assert len(first.failures) == 1 and first.more >= 1 and spark.read.json(str(tmp_path / "samples")).count() == 3
    shard = lambda *t: spark.createDataFrame([(x, k) for k, x in enumerate(t)], "tenant string, seq long")
    assert reconcile.merged_shards([shard("a", "a", "b"), shard("c")]).count() == 4
    with pytest.raises(ValueError, match=r"b \(0 and 2\)"):
        reconcile.merged_shards([shard("a", "b"), shard("c"), shard("b")])
    with pytest.raises(ValueError, match="the plan is for 4 events, there are 3"):
        faults.checked_total(led, 4)


def test_rates_of_a_stream_by_the_second(spark, tmp_path):
    from rivulet.streaming import jobs

    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("id") / 7)).alias("ts"), (F.col("id") % 5 > 0).alias("accepted"), (F.col("id") % 10 == 0).alias("dlq"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.rate_view(s).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    want = rows.groupBy("ts").agg(F.count_if("accepted"), F.count_if(~F.col("accepted")), F.count_if("dlq")).collect()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, want))
