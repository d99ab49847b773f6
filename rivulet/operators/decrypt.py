"""Decrypt requests: credential, bucket, field, tenant and ciphertext in that order, and an audit row for every attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import crypto
from . import ratelimit

UNIDENTIFIED = "unidentified"
_STATUS = {"UNAUTHORIZED": 401, "RATE_LIMITED": 429, "UNKNOWN_FIELD": 400, "UNKNOWN_TENANT": 404, "DECRYPT_FAILED": 400}
_OUTCOME = {"UNAUTHORIZED": "denied", "RATE_LIMITED": "rate-limited", "UNKNOWN_FIELD": "rejected", "UNKNOWN_TENANT": "failed", "DECRYPT_FAILED": "failed"}


def answer(requests: DataFrame, keys: DataFrame, rate: float = 10.0, burst: float = 10.0) -> DataFrame:
    """``requests`` with status, reason, outcome and, where it is ``ok``, the value.

    ``requests``: request_id, actor, authorized, at (seconds), career_site_id, source, id, type, field and token.
    Refusals before the bucket cost nothing of it; what is not known to be authorized, or not known to be allowed, is refused.  The token names the
    version of the keys that opens it.  The ciphertext is bound to its place, so another tenant's key or another
    event's token fails.
    """
    yes = F.coalesce("authorized", F.lit(False))
    asked = requests.where(yes).select(F.col("actor").alias("tenant"), "at", F.col("request_id").alias("id"), F.lit(1).alias("n"))
    none = requests.sparkSession.createDataFrame([], "tenant string, rate double, burst double")
    allowed = ratelimit.token_buckets(asked, none, (rate, burst)).select(F.col("id").alias("request_id"), "allowed", "retry_after")
    k = crypto.by_tenant(keys).select(F.col("tenant").alias("career_site_id"), "versions")
    x = requests.join(allowed, "request_id", "left").join(F.broadcast(k), "career_site_id", "left")
    x = x.withColumn("value", crypto.open_field(F.col("token"), F.col("versions"), F.col("source"), F.col("id"), F.col("type"), F.col("field")))
    reason = (
        F.when(~yes, "UNAUTHORIZED").when(~F.coalesce("allowed", F.lit(False)), "RATE_LIMITED").when(~F.coalesce(F.col("field").isin(S.PII_FIELDS), F.lit(False)), "UNKNOWN_FIELD")
        .when(F.col("token").isNull(), "DECRYPT_FAILED").when(F.col("versions").isNull(), "UNKNOWN_TENANT").when(F.col("value").isNull(), "DECRYPT_FAILED")
    )
    x = x.withColumn("reason", reason).drop("versions", "token", "allowed")
    pick = lambda table, ok: F.coalesce(*[F.when(F.col("reason") == c, F.lit(v)) for c, v in table.items()], F.lit(ok))
    return x.withColumns({"status": pick(_STATUS, 200), "outcome": pick(_OUTCOME, "ok"), "value": F.when(F.col("reason").isNull(), F.col("value")), "retry_after": F.when(F.col("reason") == "RATE_LIMITED", F.col("retry_after"))})


def audit(answers: DataFrame, at: Column) -> DataFrame:
    """One row per attempt, never the value: who asked for which field of which event, and the outcome.

    Only a success names its actor; what was refused before the body was read names nothing else either.
    """
    read = ~F.col("outcome").isin("denied", "rate-limited")
    field = lambda c: F.when(read, F.col(c)).alias(c)
    return answers.select("request_id", F.when(F.col("outcome") == "ok", F.col("actor")).otherwise(UNIDENTIFIED).alias("actor"), field("career_site_id"), field("source"), F.when(read, F.col("id")).alias("event_id"), field("field"), "outcome", at.alias("at"))
