"""Replay of dead letters in rounds, until each of them is published, rejected for good or parked.

Plain letters go through the whole ingest again, as the requests that they came from; what is rejected for the same reason as before is
done with, what is refused with its request, or rejected for another reason, is tried again up to a limit.
Sealed letters are published as they are, also those that a round has sealed: what encryption alone makes too large is never encrypted again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import staged, unstage
from . import dlq
from .program import Ingested


def rounds(letters: DataFrame, claims: DataFrame, run: Callable[[DataFrame], Ingested], most: int = 3, repair: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(batch_id, index, stage, fate, retry_count, reason, first_reason): one row for each letter.

    ``claims`` has the rest of each request by batch_id; ``run`` is the ingest program.  ``repair`` makes the payload that is sent
    from the payload and the reason.  ``fate`` is published, rejected (the same reason twice) or parked (``most`` rounds were not
    enough, or its request is unknown); ``retry_count`` counts the rounds that the letter went through.
    """
    plain, sealed = dlq.replay_split(letters)
    done = [sealed.select("batch_id", F.col("index"), "stage", F.lit("published").alias("fate"), F.col("retry_count").cast("long").alias("retry_count"), F.lit(None).cast("string").alias("reason"), F.col("reason").alias("first_reason"))]
    left = staged(plain.select("batch_id", "index", "stage", "retry_count", "reason", F.col("reason").alias("first_reason"), F.col("original_payload").alias("raw")), "letters")
    for _ in range(most):
        if left.isEmpty():
            break
        tried = staged(_tried(left, claims, run, repair), "tried")
        unstage(left)
        told = ["batch_id", "index", "stage", "fate", F.col("retry_count").cast("long").alias("retry_count"), "reason", "first_reason"]
        done.append(tried.where("fate <> 'open'").select(*told))
        left = staged(tried.where("fate = 'open'").drop("fate"), "letters")
    out = left.select("batch_id", "index", "stage", F.lit("parked").alias("fate"), F.col("retry_count").cast("long").alias("retry_count"), "reason", "first_reason")
    for x in done:
        out = out.unionByName(x)
    return out


def _tried(left: DataFrame, claims: DataFrame, run: Callable[[DataFrame], Ingested], repair) -> DataFrame:
    """``left`` after one more round, with its fate so far."""
    left = left.withColumn("raw", F.col("raw") if repair is None else repair(F.col("raw"), F.col("reason")))
    x = left.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("index", "raw"))).alias("x"))
    body = F.concat(F.lit("["), F.array_join(F.transform("x", lambda y: y["raw"]), ","), F.lit("]"))
    whole = staged(x.select("batch_id", F.transform("x", lambda y: y["index"]).alias("places"), body.alias("body")), "replayed")
    got = run(whole.drop("places").join(claims, "batch_id"))
    try:
        place = whole.select("batch_id", F.posexplode("places").alias("idx", "index"))
        said = got.responses.select("batch_id", "status", "why", F.map_from_entries("rejected").alias("named"))
        sealed = dlq.replay_split(got.letters)[1].select("batch_id", F.col("index").alias("idx"), F.lit(True).alias("sealed"))
        out = place.join(said, "batch_id", "left").join(sealed, ["batch_id", "idx"], "left").select("batch_id", "index", "status", "why", F.try_element_at("named", F.col("idx")).alias("now"), "sealed")
        y = left.join(out, ["batch_id", "index"], "left")
        accepted = (F.col("status") == 202) & (F.col("now").isNull() | F.col("sealed").isNotNull())
        reason = F.when(F.col("status") == 202, F.col("now")).otherwise(F.coalesce("why", "reason"))
        # places of a request with fewer elements differ, what is wrong does not
        same = F.regexp_replace("now", r"\[\d+\]", "") == F.regexp_replace("reason", r"\[\d+\]", "")
        fate = F.when(accepted, "published").when((F.col("status") == 202) & same, "rejected").otherwise("open")
        return staged(y.select("batch_id", "index", "stage", (F.col("retry_count") + 1).alias("retry_count"), F.when(~F.coalesce(accepted, F.lit(False)), reason).alias("reason"), "first_reason", "raw", F.coalesce(fate, F.lit("open")).alias("fate")), "round")
    finally:
        got.close()
        unstage(whole)
