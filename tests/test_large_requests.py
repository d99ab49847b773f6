"""Requests of a tenant's whole day that are larger than what one request may be."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from rivulet import schemas as S
from rivulet.operators import faults, validate
from rivulet.plans import registry

from . import oracle


def one_day(path, n: int) -> str:
    """A table of ``n`` events that are all of one tenant and day."""
    duckdb.sql(
        f"COPY (SELECT k AS event_id, TIMESTAMP '2024-01-02' + to_microseconds(k * 86400000000 // {n}) AS ts, 20 * (k % 7) AS user_id, ['view', 'click', 'signup', 'purchase', 'view', 'error'][k % 6 + 1] AS event_type,"
        f" k / 7.0::DOUBLE AS value, '{{}}' AS props FROM range({n}) r(k)) TO '{path}/events.parquet' (FORMAT parquet)"
    )
    return str(path)


def same(spark, d: str, name: str) -> list:
    got, want = registry.queries()[name](spark, d).toPandas(), oracle.connect(d).execute(registry.oracle_sql()[name]).df()
    assert oracle.rows(got) == oracle.rows(want)
    return oracle.rows(want)


@pytest.mark.parametrize("name", ["ingest_counters", "ingest_responses", "validate_batch_limits"])
def test_a_body_over_the_contracts_bytes_is_told_by_its_events(spark, tmp_path, name):
    assert "TOO_MANY_EVENTS" in repr(same(spark, one_day(tmp_path, 15000), name))


def test_partners_in_large_batches(spark):
    r = random.Random(5)
    rows = [(b, i, f"{b}-{i}", "x" if r.random() < 0.9 else None) for b, n in ((1, 3000), (2, 40), (3, 1)) for i in range(n)]
    got = faults.partners(spark.createDataFrame(rows, "batch_id int, idx int, id string, variant string"))
    # a frame that ends with the batch costs the square of its rows
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()

    def nearest(b, i):
        clean = [k for a, k, _, v in rows if a == b and v is None]
        before, after = [k for k in clean if k < i], [k for k in clean if k > i]
        k = before[-1] if before else after[0] if after else None
        return None if k is None else f"{b}-{k}"

    assert {x.id: x.partner_id for x in got.where("idx % 10 = 0").collect()} == {i: nearest(b, k) for b, k, i, _ in rows if k % 10 == 0}


def test_batches_of_any_size_are_not_put_together(spark, tmp_path):
    d = one_day(tmp_path, 300)
    for name in ("validate_verdicts", "validate_duplicates", "dlq_records", "validation_failures"):
        got = registry.queries()[name](spark, d)
        assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString() and all("events.parquet" in f for f in got.inputFiles())  # no staged bodies
    assert len(same(spark, d, "validate_duplicates")) > 0 and len(same(spark, d, "ingest_outcome")) == 1


def test_elements_apart_get_the_verdicts_of_their_request(spark):
    r, rows = random.Random(6), []
    for b in [None, *range(30)]:
        tenants = ["a", "b"] if r.random() < 0.3 else ["a"]
        for i in range(r.choice([1, 2, 12])):
            e = {"specversion": "1.0", "id": r.choice(["1", "2", "3", ""]), "source": f"/careers/{r.choice(tenants)}", "type": S.EVENT_TYPES[0], "time": r.choice(["2024-01-01T00:00:00Z"] * 4 + ["now"]), "data": {"candidate": {"user_id": "u"}, "event_payload": {"job_id": "j", "session_id": "s"}}}
            e |= r.choice([{}, {}, {}, {"shadow": 1}, {"type": "x"}, {"source": "/else"}, {"source": 7}])
            rows.append((b, i, json.dumps(e) if r.random() < 0.95 else r.choice(["[]", "no", "null"])))
    elements = spark.createDataFrame(rows, "batch_id long, idx long, raw string")
    whole = elements.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("idx", "raw"))).alias("elements"))
    want = validate.verdict_rows(validate.judged(whole, F.col("elements")), "batch_id")
    got = validate.validate_batches(elements)
    assert got.columns == want.columns and {"MIXED_TENANT", "DUPLICATE_ID", "SCHEMA", None} <= {x.code for x in got.select("code").distinct().collect()}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
