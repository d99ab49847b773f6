"""Sources: request bodies, topics, ledgers, partner calls and metric texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text

WEBHOOK_KEYS = ["partner", "external_application_id", "career_site_id", "job_id", "referrer_url", "utm_source", "utm_medium", "occurred_at", "applicant"]
APPLICANT_KEYS = ["candidate_ref", "email_hmac", "email_enc", "phone_enc", "name_enc"]


def split_batches(requests: DataFrame) -> DataFrame:
    """(batch_id, idx, raw) of every element of JSON-array bodies; other bodies give no rows.  Of a key that repeats in an object the last value counts."""
    requests.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parts = F.expr("try_cast(try_parse_json(body) as array<variant>)")
    return requests.select("batch_id", F.posexplode(parts).alias("idx", "v")).select("batch_id", F.col("idx").cast("long").alias("idx"), F.expr("to_json(v)").alias("raw"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger; a line that does not parse is kept with its text in ``_corrupt``."""
    return spark.read.schema(S._struct(**{f.name: f.dataType for f in S.LEDGER}, _corrupt=S._s)).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def read_topic(spark: SparkSession, topic: str, servers: str, end: str = "latest") -> DataFrame:
    """A bounded read of a topic from its first offset on; needs the Kafka connector on the class path."""
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("endingOffsets", end).load()


def drained(records: DataFrame, ends: DataFrame) -> DataFrame:
    """(partition, end, read_to, drained) for every partition of ``ends`` (partition, end)."""
    got = records.groupBy("partition").agg((F.max("offset") + 1).alias("read_to"))
    return ends.join(got, "partition", "left").select("partition", "end", F.coalesce("read_to", F.lit(0)).alias("read_to"), (F.coalesce("read_to", F.lit(0)) >= F.col("end")).alias("drained"))


def decode_events(records: DataFrame, value: str = "value") -> DataFrame:
    """Published events of a topic: source, id, type, seq and whether the value could be decoded."""
    text = F.col(value).cast("string")
    got = records.withColumn("_e", F.from_json(text, S._struct(source=S._s, id=S._s, type=S._s, sequence=S._s)))
    ok = F.expr("try_parse_json(cast(" + value + " as string))").isNotNull() & F.col("_e.source").isNotNull() & F.col("_e.id").isNotNull()
    return got.select(*[c for c in records.columns if c not in ("source", "id", "type", "seq", "decoded")], "_e.source", "_e.id", "_e.type", F.trim("_e.sequence").try_cast("bigint").alias("seq"), ok.alias("decoded"))


def decode_letters(records: DataFrame) -> DataFrame:
    """Dead letters (key, value) as rows: source, code, reason, stage, index, and source, id and type of what was rejected.

    The latter are null where the payload does not hold them as texts; ``decoded`` is false where the value is no dead letter.
    """
    context = S._struct(reason=S._s, stage=S._s, index=S._l)
    e = records.withColumn("_e", F.from_json("value", S._struct(source=S._s, id=S._s, type=S._s, data=S._struct(original_payload=S._s, error_context=context))))
    payload, ok = F.col("_e.data.original_payload"), F.col("_e.data.error_context.reason").isNotNull() & F.col("_e.source").isNotNull() & (F.col("_e.type") == S.DLQ_TYPE)
    context = [F.col(f"_e.data.error_context.{k}").alias(k) for k in ("reason", "stage", "index")]
    return e.select("key", "_e.source", text.code_of(F.col("_e.data.error_context.reason")).alias("code"), *context, *[text.json_text(payload, k).alias(f"rejected_{k}") for k in ("source", "id", "type")], F.coalesce(ok, F.lit(False)).alias("decoded"))


def parse_webhooks(calls: DataFrame) -> DataFrame:
    """Partner calls (body) with their fields; ``ok`` is false where a key is unknown or missing, or a value is no text, in the call or in its applicant.

    Of an applicant only ``candidate_ref`` has to be there; the others may be left out or null.
    """
    calls.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    v = F.call_function("try_parse_json", F.col("body"))
    kind = lambda path: F.call_function("schema_of_variant", F.call_function("try_variant_get", v, F.lit(path), F.lit("variant")))
    keys, of_applicant = F.json_object_keys("body"), F.json_object_keys(F.get_json_object("body", "$.applicant"))
    ok = (F.size(F.array_except(keys, F.array(*map(F.lit, WEBHOOK_KEYS)))) == 0) & (F.size(F.array_except(of_applicant, F.array(*map(F.lit, APPLICANT_KEYS)))) == 0)
    for k in [*WEBHOOK_KEYS[:-1], "applicant.candidate_ref"]:
        ok = ok & (kind(f"$.{k}") == "STRING")
    for k in APPLICANT_KEYS[1:]:
        ok = ok & F.coalesce(kind(f"$.applicant.{k}"), F.lit("VOID")).isin("STRING", "VOID")
    fields = {k: F.get_json_object("body", f"$.{k}") for k in WEBHOOK_KEYS[:-1]}
    return calls.withColumns(fields | {"candidate_ref": F.get_json_object("body", "$.applicant.candidate_ref"), "ok": F.coalesce(ok, F.lit(False))})


def decode_published(records: DataFrame, value: str = "value") -> DataFrame:
    """``records`` with the published event ``e`` of each value, decoded strictly, and ``ok``: false for a missing or unknown field, another kind of value, or one that no enumeration has.

    The decoded event has to say all that the text says: its own JSON is compared with that of the text, in which keys have one order.
    """
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text_ = F.col(value).cast("string")
    plain = lambda x: F.to_json(F.call_function("try_parse_json", x))
    e = F.from_json(text_, S.PUBLISHED_EVENT)
    x = records.withColumn("e", e)
    need = ["specversion", "id", "source", "type", "time", "data.candidate.user_id_pseudo", "data.event_payload.job_id", "data.event_payload.session_id"]
    ok = plain(text_) == plain(F.to_json("e"))
    for k in need:
        ok = ok & F.col(f"e.{k}").isNotNull()
    ok = ok & (F.col("e.specversion") == "1.0") & F.col("e.type").isin(S.EVENT_TYPES)
    for k, allowed in (("sourcechannel", S.CHANNELS), ("referrertype", S.REFERRERS), ("completionmethod", S.COMPLETION_METHODS), ("data.candidate.experience_status", S.EXPERIENCE), ("data.event_payload.completion_method", S.COMPLETION_METHODS)):
        ok = ok & F.coalesce(F.col(f"e.{k}").isin(allowed), F.lit(True))
    return x.withColumn("ok", F.coalesce(ok, F.lit(False)))


def sent_rows(elements: DataFrame) -> DataFrame:
    """Ledger rows of elements (batch_id, idx, raw): one for each event that was sent, whatever became of it; fields that are no texts are null."""
    raw = F.col("raw")
    field = lambda k: text.json_text(raw, k).alias(k)
    return elements.select(
        field("id"), field("source"), field("type"), text.tenant_of(text.json_text(raw, "source")).alias("tenant"),
        F.get_json_object(raw, "$.data.candidate.user_id").alias("user_ref"), text.sequence_number(text.json_text(raw, "sequence")).alias("seq"),
    )


def parse_metrics(lines: DataFrame, *keep: str) -> DataFrame:
    """Samples (keep..., name, labels, value) of metric texts; a line that cannot be read has ok = false and a null value, never 0."""
    x = lines.where(F.trim("value") != "").where(~F.col("value").startswith("#"))
    head = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)$"
    number = F.regexp_extract("value", head, 3)
    labels = F.regexp_extract("value", head, 2)
    keys, values = F.regexp_extract_all(labels, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="'), F.lit(1)), F.regexp_extract_all(labels, F.lit(r'="([^"]*)"'), F.lit(1))
    v = F.when(number.isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(number.try_cast("double"))
    return x.select(*keep, F.regexp_extract("value", head, 1).alias("name"), F.map_from_arrays(keys, values).alias("labels"), v.alias("sample")).withColumn("ok", (F.col("name") != "") & F.col("sample").isNotNull())
