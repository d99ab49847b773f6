"""Dead-letter rows, their records and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text

_CONTEXT = ["reason", "failed_at", "exception_class", "field", "index", "stage", "retry_count", "original_topic", "original_partition", "original_offset"]


def dead_letters(rejected: DataFrame, stage: str = "validate", at: Column | None = None, topic: str = S.TOPIC_RAW) -> DataFrame:
    """One dead letter per rejection (batch_id, idx, reason, raw); rows without a reason give none.

    The id is a digest of batch, place and stage, so a replayed batch writes the same ids.
    A source that is no tenant's is replaced by the unknown one.  The payload is kept in the shape that the
    rejection left it in: the element's text at ``validate``, the sealed event at ``encrypt``; what is no
    JSON object becomes an empty one.  ``at`` is the time of the rejection, as text; without it, the time of the run.
    A column ``field`` names the field at fault, a column ``retry_count`` how often the letter was sent again.
    """
    bad = rejected.where("reason is not null")
    parts = [F.col("batch_id"), F.col("idx"), *([F.lit(stage)] if stage != "validate" else [])]
    digest = F.upper(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 20))
    is_object = F.coalesce(F.expr("schema_of_variant(try_parse_json(raw))").startswith("OBJECT"), F.lit(False))
    source = text.json_text(F.col("raw"), "source")
    at = text.rfc3339(F.current_timestamp()) if at is None else at
    given = lambda c, kind, default: (F.col(c) if c in rejected.columns else F.lit(default)).cast(kind).alias(c)
    return bad.select(
        F.lit("1.0").alias("specversion"), F.concat(F.lit("dlq-"), digest).alias("id"),
        F.when(F.coalesce(source.startswith("/careers/"), F.lit(False)), source).otherwise(S.UNKNOWN_SOURCE).alias("source"),
        F.lit(S.DLQ_TYPE).alias("type"), at.alias("time"), text.json_text(F.col("raw"), "subject").alias("subject"), F.lit(S.DLQ_SCHEMA).alias("dataschema"), F.lit("application/json").alias("datacontenttype"),
        "batch_id", F.col("idx").cast("long").alias("index"), "reason", at.alias("failed_at"), F.lit("ValidationError").alias("exception_class"), given("field", "string", None), F.lit(stage).alias("stage"), given("retry_count", "int", 0),
        F.lit(topic).alias("original_topic"), F.lit(None).cast("int").alias("original_partition"), F.lit(None).cast("long").alias("original_offset"),
        F.when(is_object, F.col("raw")).otherwise("{}").alias("original_payload"),
    )


def letter_records(letters: DataFrame) -> DataFrame:
    """(key, value) of each letter: its source, and the CloudEvent with payload and error context, unset fields left out."""
    data = F.struct(F.expr("parse_json(original_payload)").alias("original_payload"), F.struct(*_CONTEXT).alias("error_context"))
    head = ["specversion", "id", "source", "type", "time", "subject", "dataschema", "datacontenttype"]
    return letters.select(F.col("source").alias("key"), F.to_json(F.struct(*head, data.alias("data"))).alias("value"))


def replay_split(letters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain letters that go through the pipeline again, sealed ones that are published as they are)."""
    return letters.where("stage = 'validate'"), letters.where("stage = 'encrypt'")


def replayed_elements(plain: DataFrame) -> DataFrame:
    """(batch_id, idx, raw) of plain letters: each batch is sent again with its rejected elements, in their order."""
    return plain.select("batch_id", F.col("index").alias("idx"), F.col("original_payload").alias("raw"))


def replayed_records(sealed: DataFrame) -> DataFrame:
    """(key, value) of sealed letters: never encrypted again, and keyed as they were."""
    return sealed.select(text.json_text(F.col("original_payload"), "partitionkey").alias("key"), F.col("original_payload").alias("value"))
