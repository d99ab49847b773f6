"""Token buckets: a fold over each tenant's requests in time order.

The state depends on each earlier decision, so no window function expresses it.
Rows are dealt and sorted by tenant; a task carries two numbers per tenant from batch to batch.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_buckets(rows: DataFrame, limits: DataFrame, default: tuple[float, float], state: DataFrame | None = None) -> DataFrame:
    """``rows`` (tenant, at seconds, id, n) with allowed, tokens left and retry_after.

    A request of n events is charged one by one; the first denial refuses it all and
    what it had spent stays spent.  Buckets start full, or as ``state`` (tenant, tokens, last; one row for each tenant) says, and refill up to the burst.
    Order: at, then id, which may be of any type.  Tenants without limits get ``default`` (rate, burst).  A rate that is not
    positive or a burst under 1 is refused.
    """
    if default[0] <= 0 or default[1] < 1:
        raise ValueError(f"rate must be > 0 and burst >= 1, got {default}")
    lim = limits.select("tenant", F.col("rate").cast("double").alias("rate"), F.col("burst").cast("double").alias("burst"))
    lim = lim.where(F.assert_true((F.col("rate") > 0) & (F.col("burst") >= 1), F.concat(F.lit("rate must be > 0 and burst >= 1 for "), "tenant")).isNull())
    df = rows.select("tenant", F.col("at").cast("double").alias("at"), "id", F.col("n").cast("long").alias("n"))
    df = df.join(F.broadcast(lim), "tenant", "left").withColumns({"rate": F.coalesce("rate", F.lit(default[0])), "burst": F.coalesce("burst", F.lit(default[1]))})
    if state is not None:
        df = df.join(F.broadcast(state.select("tenant", F.col("tokens").alias("held"), "last")), "tenant", "left")
    else:
        df = df.withColumns({"held": F.lit(None).cast("double"), "last": F.lit(None).cast("double")})

    def fold(batches):
        bucket = None
        for pdf in batches:
            ok, left, retry, until = [], [], [], []
            for t, at, n, rate, burst, held, last in zip(pdf.tenant, pdf["at"], pdf.n, pdf.rate, pdf.burst, pdf.held, pdf["last"], strict=True):
                if bucket is None or t != bucket.tenant:
                    bucket = Bucket(t, rate, burst, None if pd.isna(held) else held, at if pd.isna(last) else last)
                good, wait = bucket.take(at, n)
                ok.append(good)
                left.append(bucket.tokens)
                retry.append(wait)
                until.append(bucket.last)
            yield pd.DataFrame({"tenant": pdf.tenant, "at": pdf["at"], "id": pdf.id, "n": pdf.n, "allowed": ok, "tokens": left, "retry_after": pd.array(retry, "Int64"), "last": until})

    id_type = df.schema["id"].dataType.simpleString()
    return df.repartition("tenant").sortWithinPartitions("tenant", "at", "id").mapInPandas(fold, f"tenant string, at double, id {id_type}, n long, allowed boolean, tokens double, retry_after long, last double")


class Bucket:
    """The tokens of one tenant."""

    def __init__(self, tenant: str, rate: float, burst: float, tokens: float | None, last: float):
        self.tenant, self.rate, self.burst, self.tokens, self.last = tenant, rate, burst, burst if tokens is None else tokens, last

    def take(self, at: float, n: int) -> tuple[bool, int | None]:
        """(allowed, seconds until there is a token again) for a request of ``n`` events; a time before the last one refills nothing."""
        self.tokens = min(self.burst, self.tokens + max(0.0, at - self.last) * self.rate)
        self.last = max(self.last, at)
        if self.tokens >= n:
            self.tokens -= n
            return True, None
        self.tokens -= math.floor(self.tokens)
        return False, max(1, math.ceil((1 - self.tokens) / self.rate))


def closing_state(decisions: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(tenant, tokens, last) after ``decisions``; tenants of ``state`` without a decision keep theirs."""
    new = decisions.groupBy("tenant").agg(F.max_by(F.struct("tokens", "last"), F.struct("at", "id")).alias("x")).select("tenant", "x.tokens", "x.last")
    return new if state is None else new.unionByName(state.select("tenant", "tokens", "last").join(new.select("tenant"), "tenant", "left_anti"))


def bucket_tallies(decisions: DataFrame, limits: DataFrame) -> DataFrame:
    """(tenant, configured, seen, consumed, denied) over the tenants of either side."""
    d = decisions.groupBy("tenant").agg(F.sum(F.when(F.col("allowed"), F.col("n")).otherwise(0)).alias("consumed"), F.count_if(~F.col("allowed")).alias("denied"), F.lit(True).alias("seen"))
    full = limits.select("tenant", F.lit(True).alias("configured")).join(d, "tenant", "full")
    return full.select("tenant", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("configured", "seen")), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("consumed", "denied")))
