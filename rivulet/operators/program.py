"""The ingest program: limits, verdicts, tenants, token buckets, encryption, dead letters and responses.

A request stays one row until the end: its verdicts, its sealed events and its response are folds over its own array, and
only decisions of the token buckets, narrow rows, meet it by a join.  Encryption draws fresh nonces, so the sealed
requests are staged once and all outputs read that table.  What holds plain requests on the way is deleted before the program returns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import crypto, text
from ..staging import staged, unstage
from . import dlq, ratelimit, tenancy, validate

_CLEAR = ["experience_status", "years_of_experience", "education_degree", "education_branch"]
_LIMITS = {"BODY_NOT_A_BATCH": 400, "BODY_TOO_LARGE": 413, "TOO_MANY_EVENTS": 413, "EVENT_TOO_LARGE": 413}


@dataclass
class Ingested:
    """``published`` (batch_id, idx, key, value), ``letters`` and ``responses``; ``state`` (tenant, tokens, last) of the buckets afterwards.

    ``close`` deletes the staged table that all of them read.
    """

    published: DataFrame
    letters: DataFrame
    responses: DataFrame
    state: DataFrame
    tables: list[DataFrame]

    def close(self) -> None:
        for t in self.tables:
            unstage(t)


def _payload(e: Column) -> Column:
    """The event's payload without what is the contract's default anyway: no jobs, no metadata."""
    p = e["event_payload"]
    less = {"recommended_job_ids": F.size(p["recommended_job_ids"]) > 0, "client_metadata": F.to_json(p["client_metadata"]) != "{}"}
    return F.struct(*[(F.when(less[k], p[k]) if k in less else p[k]).alias(k) for k in S.PAYLOAD_KEYS])


def _event(e: Column, candidate: Column, **given: Column) -> Column:
    """The contract's form of a parsed event; attributes at their default are left out."""
    head = {k: e[k] for k in S.CONTEXT_ATTRIBUTES} | {"datacontenttype": F.nullif(e["datacontenttype"], F.lit("application/json"))} | given
    return F.struct(*[v.alias(k) for k, v in head.items()], F.struct(candidate.alias("candidate"), _payload(e["data"]).alias("event_payload")).alias("data"))


def contract_form(e: Column) -> Column:
    """The parsed event with the contract's candidate in place of the plain one."""
    c = e["data"]["candidate"]
    return _event(e, F.struct(c["user_id"].alias("user_id_pseudo"), *[c[k].alias(k) for k in _CLEAR]))


def contract_size(e: Column) -> Column:
    """Bytes of the contract's form, null if the event was not parsed."""
    return F.octet_length(F.to_json(contract_form(e)))


def _sealed(v: Column, keys: Column, tenant: Column, channel: Column) -> Column:
    """(key, value, conflict) of an accepted event ``v``: its record, and whether it asked for another key."""
    e = v["e"]
    c = e["data"]["candidate"]
    made = crypto.sealed_fields(v["source"], v["id"], v["type"], {f: c[f] for f in S.PII_FIELDS}, c["user_id"], keys)
    key = text.partition_key(tenant, made["user_id_pseudo"])
    candidate = F.struct(*[made[k].alias(k) for k in ("user_id_pseudo", "email_hmac", *[f"{f}_enc" for f in S.PII_FIELDS])], *[c[k].alias(k) for k in _CLEAR])
    value = F.to_json(_event(e, candidate, keyversion=keys["keyversion"], sourcechannel=channel, partitionkey=key))
    return F.struct(key.alias("key"), value.alias("value"), text.hint_conflicts(e["partitionkey"], key).alias("conflict"))


def ingest(
    requests: DataFrame, tenants: DataFrame, credentials: DataFrame, keys: DataFrame, limits: DataFrame, default: tuple[float, float],
    max_events: int = S.MAX_EVENTS, max_bytes: int = S.MAX_EVENT_BYTES, at: Column | None = None, state: DataFrame | None = None, max_body: int = S.MAX_BODY_BYTES,
) -> Ingested:
    """Run request rows (batch_id of any type, at seconds, body, token_tenant, credential_id, channel_hint) through all stages.

    A request is refused as a whole by its size (400, 413), its token, credential, channel, source or partition hint
    (403) or its tenant's bucket (429, charged for the events that pass); then nothing of it is written.  Otherwise
    (202) each event is accepted, or rejected alone and written as a dead letter: as it came, or sealed if
    encryption made it too large.  Buckets start as ``state`` says.  Keys are those that are valid at the request's time.
    """
    read = validate.judged(validate.limited(requests, max_body, max_events), F.when(F.col("code").isNull(), validate.numbered("raws")), max_bytes, contract_size)
    there = F.filter("verdicts", lambda v: v["code"].isNull() | ~v["code"].isin(validate.STRUCTURAL))
    read = read.withColumn("_s", F.transform(there, lambda v: v["source"])).withColumns({"lo": F.array_min("_s"), "hi": F.array_max("_s"), "n": F.size(F.filter("verdicts", lambda v: v["code"].isNull()))})
    plain = staged(tenancy.bind_whole(read.drop("_s", "raws"), tenants, credentials), "judged")
    try:
        charge = plain.where("code is null and status = 200 and n > 0").select(F.col("token_tenant").alias("tenant"), "at", F.col("batch_id").alias("id"), "n")
        buckets = staged(ratelimit.token_buckets(charge, limits, default, state), "buckets")
        done = staged(_finished(plain, buckets, keys, max_bytes), "sealed")
    finally:
        unstage(plain)
    each = done.select("batch_id", F.inline("outcomes"))
    letters = None
    for stage in ("validate", "encrypt"):
        of = dlq.dead_letters(each.where(F.col("stage") == stage), stage, at)
        letters = of if letters is None else letters.unionByName(of)
    named = F.transform(F.filter("outcomes", lambda o: o["reason"].isNotNull()), lambda o: F.struct(o["idx"].cast("int").alias("idx"), o["reason"].alias("reason")))
    responses = done.select("batch_id", "status", "why", "retry_after", F.size(F.filter("outcomes", lambda o: o["reason"].isNull())).cast("long").alias("accepted"), named.alias("rejected"))
    return Ingested(each.where("stage is null").select("batch_id", "idx", "key", "value"), letters, responses, ratelimit.closing_state(buckets, state), [done, buckets])


def _finished(plain: DataFrame, buckets: DataFrame, keys: DataFrame, max_bytes: int) -> DataFrame:
    """(batch_id, status, why, retry_after, outcomes) of each request; outcomes (idx, reason, stage, raw, key, value) of those with status 202, accepted events without a stage."""
    r = plain.join(buckets.select(F.col("id").alias("batch_id"), "allowed", "retry_after"), "batch_id", "left")
    good = F.col("code").isNull() & (F.col("status") == 200)
    r = r.withColumn("live", good & F.coalesce("allowed", F.lit(True)))
    r = r.join(F.broadcast(crypto.by_tenant(keys)).withColumnRenamed("tenant", "token_tenant"), "token_tenant", "left").withColumn("_k", crypto.valid_at(F.col("versions"), F.col("at"))).drop("versions")
    # nothing may pass unsealed
    r = r.where(F.assert_true(~F.col("live") | (F.col("n") == 0) | F.col("_k").isNotNull(), F.concat(F.lit("no keys for tenant "), F.coalesce("token_tenant", F.lit("(null)")))).isNull())

    def outcome(v: Column) -> Column:
        sealed = F.when(v["code"].isNull(), _sealed(v, F.col("_k"), F.col("token_tenant"), F.col("sourcechannel")))
        return F.struct(v["idx"].alias("idx"), v["code"].alias("code"), v["reason"].alias("reason"), F.when(v["code"].isNotNull(), v["raw"]).alias("raw"), sealed.alias("s"))

    def named(o: Column) -> Column:
        late = F.coalesce(F.octet_length(o["s"]["value"]) > max_bytes, F.lit(False))
        place = F.concat(F.lit("OVERSIZED at $["), o["idx"].cast("string"), F.lit(f"]: exceeds {max_bytes} bytes"))
        return F.struct(
            o["idx"].alias("idx"), F.when(late, place).otherwise(o["reason"]).alias("reason"), F.when(late, "encrypt").when(o["code"].isNotNull(), "validate").alias("stage"),
            F.when(late, o["s"]["value"]).otherwise(o["raw"]).alias("raw"), F.when(~late, o["s"]["key"]).alias("key"), F.when(~late, o["s"]["value"]).alias("value"),
        )

    r = r.withColumn("_o", F.when(F.col("live"), F.transform("verdicts", outcome)))
    hint = F.coalesce(F.exists("_o", lambda o: F.coalesce(o["s"]["conflict"], F.lit(False))), F.lit(False))
    # a batch of several tenants has one rejection and no letter but that
    told = F.filter(F.transform("_o", named), lambda o: o["reason"].isNotNull() | o["stage"].isNull())
    status = F.coalesce(*[F.when(F.col("code") == k, v) for k, v in _LIMITS.items()], F.when(hint, 403), F.when(F.col("status") != 200, F.col("status")), F.when(~F.col("live"), 429), F.lit(202))
    why = F.coalesce("code", F.when(hint, "PARTITION_HINT"), F.when(F.col("status") != 200, F.col("why")), F.when(~F.col("live"), "RATE_LIMITED"))
    none = "cast(array() as array<struct<idx:bigint,reason:string,stage:string,raw:string,key:string,value:string>>)"
    return r.select(
        "batch_id", status.cast("int").alias("status"), why.alias("why"), F.when(good & ~F.col("live"), F.col("retry_after")).alias("retry_after"),
        F.when(F.col("live") & ~hint, told).otherwise(F.expr(none)).alias("outcomes"),
    )
