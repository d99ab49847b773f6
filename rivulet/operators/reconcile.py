"""Ledger against topic and dead letters: one full outer join on (source, id).

Each side is first reduced to one row per key, so a hot key costs one row; all
counts then come from presence flags in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S

UNGROUPED = "(unattributable)"


def presence(ledger: DataFrame, stored: DataFrame, rejected: DataFrame) -> DataFrame:
    """(source, id, sent, kept, refused): how often each key is in the ledger, the topic and the dead letters."""
    a = ledger.groupBy("source", "id").agg(F.count("*").alias("sent"))
    b = stored.groupBy("source", "id").agg(F.count("*").alias("kept"))
    c = rejected.where("rejected_source <> '' and rejected_id <> ''").groupBy(F.col("rejected_source").alias("source"), F.col("rejected_id").alias("id")).agg(F.count("*").alias("refused"))
    x = a.join(b, ["source", "id"], "full").join(c, ["source", "id"], "full")
    return x.select("source", "id", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("sent", "kept", "refused")))


def counts(found: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row of the counts that the keys alone give."""
    there, kept, out = F.col("sent") > 0, F.col("kept") > 0, F.col("refused") > 0
    x = found.agg(
        F.sum("sent").alias("ledger_rows"), F.count_if(there).alias("expected"), (F.sum("sent") - F.count_if(there)).alias("ledger_duplicates"),
        F.count_if(there & (kept | out)).alias("accepted"), F.count_if(kept).alias("stored"), (F.sum("kept") - F.count_if(kept)).alias("wire_duplicates"),
        F.count_if(there & ~kept & ~out).alias("missing"), F.count_if(kept & ~there).alias("unexpected"),
    )
    return x.crossJoin(rejected.agg(F.count("*").alias("dlq")))


#: What makes a verdict FAIL, in the order in which it is reported; each is a count that has to be 0.
FAILURES = ["undrained", "undecodable", "missing", "unexpected", "unattributed", "dlq_off", "unknown_codes", "duplicates_off", "ordering_violations", "seq_mismatches", "pseudonym_mismatches"]


def summary(ledger: DataFrame, stored: DataFrame, rejected: DataFrame, code: Column, line: str, ends: DataFrame, undecodable: DataFrame, expected_dlq: int | None = None, expected_duplicates: int = 0, pseudonyms: bool = True) -> DataFrame:
    """One row: all counts, the verdict, and ``failures``, a text for each count that should be 0 and is not.

    The verdict is UNVERIFIED, whatever else holds, for what could not be read whole: an empty ledger, one with lines that do not parse (rows with
    a text in ``_corrupt``), or a topic that was not read to its ends.  ``ends`` (partition, drained) and ``undecodable``
    (n) tell how the topic was read; without ``expected_dlq`` the number of dead letters is not asserted, and
    without ``pseudonyms`` (columns expected and user_pseudo) these are not measured: null, not 0.
    All frames are read several times, so stage them.
    """
    broken = F.count_if(F.col("_corrupt").isNotNull()) if "_corrupt" in ledger.columns else F.lit(0).cast("long")
    corrupt = ledger.agg(broken.alias("_broken"))
    ledger = ledger.where("_corrupt is null") if "_corrupt" in ledger.columns else ledger
    x = counts(presence(ledger, stored, rejected), rejected).crossJoin(corrupt)
    known = code.isin(S.KNOWN_CODES)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(ends.where(~F.col("drained")), "undrained"), undecodable.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("undecodable")), one(unattributed(rejected, ledger), "unattributed"),
        rejected.agg(F.count_distinct(F.when(~known, code)).alias("unknown_codes")),
        ordering_violations(stored).agg(F.count_if("late").alias("ordering_violations"), F.count_if(F.col("seq").isNull()).alias("ordering_unchecked")),
        one(sequence_mismatches(ledger, stored, line), "seq_mismatches"),
        one(pseudonym_mismatches(ledger, stored, line), "pseudonym_mismatches") if pseudonyms else stored.agg(F.lit(None).cast("long").alias("pseudonym_mismatches")),
    ]
    for p in parts:
        x = x.crossJoin(p)  # one row each
    off = F.abs(F.col("dlq") - F.lit(expected_dlq)) if expected_dlq is not None else F.lit(0)
    x = x.withColumns({"dlq_off": off.cast("long"), "duplicates_off": F.abs(F.col("wire_duplicates") - expected_duplicates).cast("long")})
    failures = F.filter(F.array(*[F.when(F.coalesce(F.col(c), F.lit(0)) > 0, F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in FAILURES]), lambda f: f.isNotNull())
    x = x.withColumn("failures", failures)
    unread = (F.col("expected") == 0) | (F.col("_broken") > 0) | (F.col("undrained") > 0)
    return x.withColumn("verdict", F.when(unread, "UNVERIFIED").when(F.size("failures") > 0, "FAIL").otherwise("PASS")).drop("_broken")


def samples(found: DataFrame, limit: int = 3) -> DataFrame:
    """(what, source, id): the first ``limit`` keys, by name, of those missing and of those unexpected."""
    one = lambda df, what: df.orderBy("source", "id").limit(limit).select(F.lit(what).alias("what"), "source", "id")
    return one(missing(found), "missing").unionByName(one(unexpected(found), "unexpected"))


def merged_shards(shards: list[DataFrame]) -> DataFrame:
    """All rows of several ledgers; a tenant that is in two of them is an error, as its rows could not be told from repeats."""
    if not shards:
        raise ValueError("there is no ledger to merge")
    out = None
    for k, s in enumerate(shards):
        s = s.withColumn("_shard", F.lit(k))
        out = s if out is None else out.unionByName(s)
    twice = out.groupBy("tenant").agg(F.min("_shard").alias("a"), F.max("_shard").alias("b")).where("a <> b").orderBy("tenant").limit(3).collect()
    if twice:
        raise ValueError("tenants in more than one ledger: " + ", ".join(f"{r.tenant} ({r.a} and {r.b})" for r in twice))
    return out.drop("_shard")


def missing(found: DataFrame) -> DataFrame:
    return found.where("sent > 0 and kept = 0 and refused = 0").select("source", "id")


def unexpected(found: DataFrame) -> DataFrame:
    return found.where("kept > 0 and sent = 0").select("source", "id")


def unattributed(rejected: DataFrame, ledger: DataFrame) -> DataFrame:
    """Dead letters whose key is null or in no ledger row."""
    keys = ledger.select(F.col("source").alias("rejected_source"), F.col("id").alias("rejected_id")).distinct()
    return rejected.join(keys, ["rejected_source", "rejected_id"], "left_anti")


def group_deltas(ledger: DataFrame, stored: DataFrame, rejected: DataFrame, by: str) -> DataFrame:
    """(group, sent, stored, rejected, delta, unresolved) by ``by``: distinct keys sent and stored, rejected rows."""
    key = F.struct("source", "id")
    a = ledger.groupBy(F.col(by).alias("group")).agg(F.countDistinct(key).alias("sent"))
    b = stored.groupBy(F.col(by).alias("group")).agg(F.countDistinct(key).alias("stored"))
    c = rejected.groupBy(F.coalesce(f"rejected_{by}", F.lit(UNGROUPED)).alias("group")).agg(F.count("*").alias("rejected"))
    x = a.join(b, "group", "full").join(c, "group", "full").select("group", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("sent", "stored", "rejected")))
    return x.withColumns({"delta": F.col("stored") - F.col("sent"), "unresolved": F.col("sent") - F.col("stored") - F.col("rejected")})


def by_code(rejected: DataFrame, code: Column) -> DataFrame:
    return rejected.groupBy(code.alias("code")).agg(F.count("*").alias("n")).withColumn("known", F.col("code").isin(S.KNOWN_CODES))


def sequence_mismatches(ledger: DataFrame, stored: DataFrame, line: str) -> DataFrame:
    """Stored rows whose number is not the ledger's; of several ledger rows the last by ``line`` counts."""
    last = ledger.groupBy("source", "id").agg(F.max_by("seq", line).alias("expected_seq"))
    return stored.where("seq is not null").join(last, ["source", "id"]).where("expected_seq is not null and seq <> expected_seq")


def pseudonym_mismatches(ledger: DataFrame, stored: DataFrame, line: str) -> DataFrame:
    """Stored rows whose pseudonym is not the expected one of the first ledger row by ``line``."""
    first = ledger.groupBy("source", "id").agg(F.min_by("expected", line).alias("expected"))
    return stored.join(first, ["source", "id"]).where("expected is not null and expected <> user_pseudo")


def ordering_violations(stored: DataFrame) -> DataFrame:
    """Rows with a flag ``late``: a lower number than one already read for the same source and user.

    Reading order is (partition, offset); rows without a number are skipped.
    """
    w = Window.partitionBy("source", "user_ref").orderBy("partition", "offset").rowsBetween(Window.unboundedPreceding, -1)
    return stored.withColumn("late", F.coalesce(F.col("seq") < F.max("seq").over(w), F.lit(False)))


def consumer_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """(partition, lag) of ``ends`` (partition, end_offset) against ``committed`` (partition, offset), 0 where nothing was committed yet."""
    x = ends.join(committed.select("partition", F.col("offset").alias("_done")), "partition", "left")
    return x.select("partition", F.greatest(F.col("end_offset") - F.coalesce("_done", F.lit(0)), F.lit(0)).cast("long").alias("lag"))


def partition_ends(stored: DataFrame) -> DataFrame:
    return stored.groupBy("partition").agg(F.count("*").alias("records"), (F.max("offset") + 1).alias("end_offset"))
