"""Binding requests to tenants: tokens, credentials and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bind(requests: DataFrame, elements: DataFrame, tenants: DataFrame, credentials: DataFrame) -> DataFrame:
    """(batch_id, status, why): 200, or 403 for the whole request, from ``requests`` and their ``elements`` (batch_id, source) apart."""
    src = elements.groupBy("batch_id").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    return bind_whole(requests.join(src, "batch_id", "left"), tenants, credentials).select("batch_id", "status", "why")


def bind_whole(requests: DataFrame, tenants: DataFrame, credentials: DataFrame) -> DataFrame:
    """``requests`` (token_tenant, credential_id, channel_hint, and the least and greatest source lo and hi of their elements) with sourcechannel, status and why.

    ``tenants`` (tenant), ``credentials`` (credential_id, tenant, channel): both are small by nature and are broadcast.
    """
    r = requests.join(F.broadcast(tenants.select(F.col("tenant").alias("token_tenant"), F.lit(True).alias("known"))), "token_tenant", "left")
    c = credentials.select("credential_id", F.col("tenant").alias("c_tenant"), F.col("channel").alias("c_channel"))
    r = r.join(F.broadcast(c), "credential_id", "left")
    expected = F.concat(F.lit("/careers/"), "token_tenant")
    why = (
        F.when(F.col("known").isNull(), "UNKNOWN_TENANT")
        .when(F.col("c_tenant").isNull() | (F.col("c_tenant") != F.col("token_tenant")), "CREDENTIAL_MISMATCH")
        .when(F.col("channel_hint").isNotNull() & (F.col("channel_hint") != F.col("c_channel")), "CHANNEL_MISMATCH")
        .when((F.col("lo") != expected) | (F.col("hi") != expected), "SOURCE_MISMATCH")
    )
    return r.select(*requests.columns, F.col("c_channel").alias("sourcechannel"), F.when(why.isNull(), 200).otherwise(403).cast("int").alias("status"), why.alias("why"))


def token_budget(failures: DataFrame, limit: int) -> DataFrame:
    """Failed tokens of a run (run_id, at, request_id): the first ``limit`` are checked, later ones refused."""
    w = Window.partitionBy("run_id").orderBy("at", "request_id")
    return failures.withColumn("refused", F.row_number().over(w) > limit)
