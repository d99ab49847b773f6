"""Verdicts on raw events, in the contract's order.

Structure first (unknown attribute, size, schema), then one tenant per batch,
then the envelope's own rules, then duplicates among what is still valid.  Every
verdict is a code and a reason: the code with a path or an attribute's name, never a value.

A request is one row with at most some hundred elements, so all of this is a fold over the request's
array: no exchange and no window, and elements are exploded for output alone.  Batches without such a bound come as
rows of elements, are judged one by one and meet their batch in windows (``validate_batches``).

An element is parsed once into the declared type and once as a variant.  If both
say the same, no key is unknown and no value was converted, and only the enumerations are
left to check; the checks path by path run on the other elements alone.  Of a key that repeats in an object the last value counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text

#: Codes of elements whose source does not count: their structure does not pass.
STRUCTURAL = ["SCHEMA", "UNKNOWN_ATTRIBUTE", "OVERSIZED"]
_TEXT_KEYS = ["subject", "dataschema", "datacontenttype", "sequence", "partitionkey"]
_ENUMS = {"type": S.EVENT_TYPES, "sourcechannel": S.CHANNELS, "referrertype": S.REFERRERS, "completionmethod": S.COMPLETION_METHODS}
_CANDIDATE, _PAYLOAD, _JOBS = "$.data.candidate", "$.data.event_payload", "$.data.event_payload.recommended_job_ids"


class _Checks:
    """Checks of one element: its text ``raw`` and its variant ``v``."""

    def __init__(self, raw: Column, v: Column):
        self.raw, self.v = raw, v
        self._kinds: dict[str, tuple[Column, Column]] = {}

    def get(self, path: str, kind: str) -> Column:
        return F.call_function("try_variant_get", self.v, F.lit(path), F.lit(kind))

    def kind(self, path: str) -> Column:
        if path not in self._kinds:  # columns are made once for each path: making them is what takes the driver's time
            kind = F.call_function("schema_of_variant", self.get(path, "variant"))
            self._kinds[path] = kind, F.regexp_extract(kind, "^[A-Z]+", 0)
        return self._kinds[path][0]

    def is_(self, path: str, *kinds: str) -> Column:
        """True if the value is there with one of the kinds."""
        self.kind(path)
        return F.coalesce(self._kinds[path][1].isin(*kinds), F.lit(False))

    def there(self, path: str) -> Column:
        return self.kind(path).isNotNull()

    def text(self, path: str) -> Column:
        return self.get(path, "string")

    def closed(self, path: str, keys: list[str]) -> Column:
        found = F.json_object_keys(F.get_json_object(self.raw, path))
        return F.coalesce(F.size(F.array_except(found, F.array(*map(F.lit, keys)))) == 0, F.lit(True))


def schema_fault(raw: Column, v: Column) -> Column:
    """The path of the first fault of an element (text and variant), null without one.

    Values that are there come first, in the contract's order, then what is missing, named by its parent.
    """
    c, bad = _Checks(raw, v), []
    null_or = lambda path, *kinds: c.there(path) & ~c.is_(path, "VOID", *kinds)
    one_of = lambda path, allowed: c.there(path) & ~(c.is_(path, "VOID") | (c.is_(path, "STRING") & F.coalesce(c.text(path).isin(allowed), F.lit(False))))
    bad.append(("$.specversion", c.there("$.specversion") & ~(c.is_("$.specversion", "STRING") & c.text("$.specversion").eqNullSafe(F.lit("1.0")))))
    bad += [(f"$.{k}", c.there(f"$.{k}") & ~c.is_(f"$.{k}", "STRING")) for k in ("id", "source", "type", "time")]
    bad += [("$.type", one_of("$.type", S.EVENT_TYPES))]
    bad += [(f"$.{k}", null_or(f"$.{k}", "STRING")) for k in _TEXT_KEYS]
    bad += [("$.keyversion", null_or("$.keyversion", "BIGINT"))]
    bad += [(f"$.{k}", one_of(f"$.{k}", v)) for k, v in _ENUMS.items() if k != "type"]
    bad += [(p, c.there(p) & ~c.is_(p, "OBJECT")) for p in ("$.data", _CANDIDATE, _PAYLOAD)]
    bad += [(f"{p}.{k}", c.there(f"{p}.{k}") & ~c.is_(f"{p}.{k}", "STRING")) for p, k in ((_CANDIDATE, "user_id"), (_PAYLOAD, "job_id"), (_PAYLOAD, "session_id"))]
    bad += [(f"{_CANDIDATE}.{k}", null_or(f"{_CANDIDATE}.{k}", "STRING")) for k in S.CANDIDATE_KEYS if k not in ("user_id", "years_of_experience", "experience_status")]
    bad += [(f"{_CANDIDATE}.experience_status", one_of(f"{_CANDIDATE}.experience_status", S.EXPERIENCE)), (f"{_CANDIDATE}.years_of_experience", null_or(f"{_CANDIDATE}.years_of_experience", "DECIMAL", "DOUBLE", "FLOAT", "BIGINT"))]
    bad += [(f"{_PAYLOAD}.{k}", null_or(f"{_PAYLOAD}.{k}", "BIGINT")) for k in ("step_number", "time_spent_on_step_ms", "total_application_duration_ms")]
    bad += [(f"{_PAYLOAD}.{k}", null_or(f"{_PAYLOAD}.{k}", "STRING")) for k in ("step_name", "action")]
    bad += [(f"{_PAYLOAD}.completion_method", one_of(f"{_PAYLOAD}.completion_method", S.COMPLETION_METHODS))]
    items = c.get(_JOBS, "array<variant>")
    bad += [(_JOBS, c.there(_JOBS) & ~c.is_(_JOBS, "ARRAY")), (f"{_JOBS}[...]", F.coalesce(F.exists(items, lambda x: F.call_function("schema_of_variant", x) != "STRING"), F.lit(False)))]
    bad += [(f"{_PAYLOAD}.client_metadata", c.there(f"{_PAYLOAD}.client_metadata") & ~c.is_(f"{_PAYLOAD}.client_metadata", "OBJECT"))]
    bad += [("$.data", ~c.closed("$.data", ["candidate", "event_payload"])), (_CANDIDATE, ~c.closed(_CANDIDATE, S.CANDIDATE_KEYS)), (_PAYLOAD, ~c.closed(_PAYLOAD, S.PAYLOAD_KEYS))]
    bad += [(p, c.there(p) & ~c.there(f"{p}.{k}")) for p, k in ((_CANDIDATE, "user_id"), (_PAYLOAD, "job_id"), (_PAYLOAD, "session_id"), ("$.data", "candidate"), ("$.data", "event_payload"))]
    bad += [("$", ~c.there(f"$.{k}")) for k in ("specversion", "id", "source", "type", "time", "data")]
    return F.coalesce(*[F.when(x, F.lit(p)) for p, x in bad])


def _enum_fault(e: Column) -> Column:
    """The same for an element whose parsed form ``e`` says all that the text says."""
    candidate, payload = e["data"]["candidate"], e["data"]["event_payload"]
    bad = [(f"$.{k}", e[k].isNotNull() & ~e[k].isin(v)) for k, v in _ENUMS.items()]
    bad += [(f"{_CANDIDATE}.experience_status", ~candidate["experience_status"].isin(S.EXPERIENCE)), (f"{_PAYLOAD}.completion_method", ~payload["completion_method"].isin(S.COMPLETION_METHODS))]
    return F.coalesce(F.when(~e["specversion"].eqNullSafe(F.lit("1.0")), F.lit("$.specversion")), *[F.when(c, F.lit(p)) for p, c in bad])


def _structural(p: Column, max_bytes: int, size: Column) -> Column:
    """Code and reason of one element ``p`` (idx, raw, v, e, same), null where its structure passes; ``size`` bytes count."""
    e, checks = p["e"], _Checks(p["raw"], p["v"])
    full = p["same"]
    for c in (e["specversion"], e["id"], e["source"], e["type"], e["time"], e["data"]["candidate"]["user_id"], e["data"]["event_payload"]["job_id"], e["data"]["event_payload"]["session_id"]):
        full = full & c.isNotNull()
    at = F.concat(F.lit(" at $["), p["idx"].cast("string"), F.lit("]"))
    told = lambda code, reason: F.struct(F.lit(code).alias("code"), reason.alias("reason"))
    big, oversized = size > max_bytes, told("OVERSIZED", F.concat(F.lit("OVERSIZED"), at, F.lit(f": exceeds {max_bytes} bytes")))
    schema = lambda path: F.when(path.isNotNull(), told("SCHEMA", F.concat(F.lit("SCHEMA at "), path)))
    extra = text.extra_attribute(p["raw"])
    slow = (
        F.when(~F.coalesce(checks.kind("$").startswith("OBJECT"), F.lit(False)), told("SCHEMA", F.concat(F.lit("SCHEMA"), at, F.lit(": not an object"))))
        .when(extra.isNotNull(), told("UNKNOWN_ATTRIBUTE", F.concat(F.lit("UNKNOWN_ATTRIBUTE"), at, F.lit(": "), extra)))
        .when(big, oversized).otherwise(schema(schema_fault(p["raw"], p["v"])))
    )
    return F.when(full, F.when(big, oversized).otherwise(schema(_enum_fault(e)))).otherwise(slow)


def envelope_problem(source: Column, time: Column, id_: Column) -> Column:
    return F.when(~F.coalesce(source.rlike(S.SOURCE_RE), F.lit(False)), "BAD_SOURCE").when(~F.coalesce(time.rlike(S.TIME_RE), F.lit(False)), "BAD_TIME").when(F.coalesce(id_ == "", F.lit(True)), "BAD_ID")


def raw_subject(type_: Column, subject: Column) -> Column:
    """True for a published login or registration whose subject is a plain user id."""
    return type_.rlike("(user-registered|user-logged-in)$") & F.coalesce(subject.rlike("^(usr_|user_)"), F.lit(False))


def last_of_repeated_keys(frame: DataFrame) -> None:
    """Let objects with a repeated key be parsed, the last value counting.  The setting stays in the session, as results are computed later."""
    frame.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def judged(requests: DataFrame, elements: Column, max_bytes: int = S.MAX_EVENT_BYTES, size=None) -> DataFrame:
    """``requests`` with ``verdicts``: for each of its ``elements`` (an array of idx and raw) idx, raw, source, id, type, time, the parsed event e, code and reason.

    A null code means accepted.  A batch of several tenants is refused as one: all its elements have the code MIXED_TENANT, and the
    reason stands at index 0 alone, as its one rejection.  ``size`` makes the bytes that count from an element's parsed event and text; without
    it they are those of the text.
    """
    last_of_repeated_keys(requests)
    # one step for each level of what the next one reads several times
    parsed = F.transform(elements, lambda x: F.struct(x["idx"].alias("idx"), x["raw"].alias("raw"), F.call_function("try_parse_json", x["raw"]).alias("v"), F.from_json(x["raw"], S.INGRESS_EVENT).alias("e")))
    json_of = lambda v: F.to_json(F.call_function("try_parse_json", v))
    seen = F.transform(parsed, lambda p: F.struct(*[p[k].alias(k) for k in ("idx", "raw", "v", "e")], F.coalesce(F.to_json(p["v"]) == json_of(F.to_json(p["e"])), F.lit(False)).alias("same")))

    def told(p: Column) -> Column:
        field = lambda k: F.when(p["same"], p["e"][k]).otherwise(_Checks(p["raw"], p["v"]).text(f"$.{k}"))
        x = _structural(p, max_bytes, F.octet_length(p["raw"]) if size is None else F.coalesce(size(p["e"]), F.octet_length(p["raw"])))
        return F.struct(*[p[k].alias(k) for k in ("idx", "raw", "e")], *[field(k).alias(k) for k in ("source", "id", "type", "time")], x.alias("x"))

    where = F.create_map(*[F.lit(x) for kv in (("BAD_SOURCE", "$.source"), ("BAD_TIME", "$.time"), ("BAD_ID", "$.id")) for x in kv])

    def enveloped(p: Column) -> Column:
        problem = F.when(p["x"].isNull(), envelope_problem(p["source"], p["time"], p["id"]))
        reason = F.coalesce(p["x"]["reason"], F.concat(problem, F.lit(" at "), where[problem]))
        return F.struct(*[p[k].alias(k) for k in ("idx", "raw", "e", "source", "id", "type", "time")], p["x"].isNull().alias("decoded"), F.coalesce(p["x"]["code"], problem).alias("code"), reason.alias("reason"))

    # a valid source has no line end in it
    key = lambda p: F.when(p["code"].isNull(), F.concat(p["source"], F.lit("\n"), p["id"]))

    def whole(v: Column) -> Column:
        sources = F.transform(F.filter(v, lambda p: p["decoded"]), lambda p: p["source"])
        mixed = _let(sources, lambda s: F.coalesce(F.array_min(s) != F.array_max(s), F.lit(False)))
        return _let(F.struct(mixed.alias("mixed"), F.transform(v, key).alias("keys")), lambda of: F.transform(v, lambda p, i: final(of, p, i)))

    def final(of: Column, p: Column, i: Column) -> Column:
        again = p["code"].isNull() & (F.array_position(of["keys"], key(p)) <= i)
        return F.struct(*[p[k].alias(k) for k in ("idx", "raw", "source", "id", "type", "time", "e")], *_in_batch(of["mixed"], again, p["idx"], p["code"], p["reason"]))

    return requests.withColumn("verdicts", _let(F.transform(F.transform(seen, told), enveloped), whole))


def _in_batch(mixed: Column, again: Column, idx: Column, code: Column, reason: Column) -> tuple[Column, Column]:
    """Final code and reason of an element of a batch of several tenants, or whose id was there before."""
    why = F.when(mixed, F.when(idx == 0, "MIXED_TENANT: spans more than one tenant")).when(again, "DUPLICATE_ID at $.id").otherwise(reason)
    return F.when(mixed, "MIXED_TENANT").when(again, "DUPLICATE_ID").otherwise(code).alias("code"), why.alias("reason")


def _let(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is read: a column would be put into the lambdas that read it and made for each element."""
    return F.transform(F.array(value), use)[0]


def verdict_rows(found: DataFrame, *keep: str, parsed: bool = False) -> DataFrame:
    """One row for each verdict of ``judged`` requests."""
    # plain columns, and the outer form: pruned fields of a struct, or filters on the size, would have the array made again
    x = found.select(*keep, F.inline_outer("verdicts")).where("idx is not null")
    return x if parsed else x.drop("e")


def numbered(raws: Column | str) -> Column:
    """Texts of elements as ``judged`` takes them."""
    return F.transform(raws, lambda r, i: F.struct(i.cast("long").alias("idx"), r.alias("raw")))


def validate_batches(elements: DataFrame, max_bytes: int = S.MAX_EVENT_BYTES) -> DataFrame:
    """Every element (batch_id, idx, raw) with its final ``code`` and ``reason`` (null: accepted), for elements that come apart.

    Each is judged alone.  Only what a batch decides as a whole, its tenants and repeated ids, is found over its rows, which
    spill: a batch of any size is never put together.
    """
    alone = judged(elements.select("batch_id", F.array(F.struct("idx", "raw")).alias("element")), F.col("element"), max_bytes)
    # one exchange and one sort for both windows
    v = verdict_rows(alone, "batch_id").withColumn("_fine", F.col("code").isNull()).repartition("batch_id")
    v = v.withColumn("_nth", F.row_number().over(Window.partitionBy("batch_id", "source", "id", "_fine").orderBy("idx", F.xxhash64("raw"))))
    decoded, batch = F.when(F.col("_fine") | ~F.col("code").isin(STRUCTURAL), F.col("source")), Window.partitionBy("batch_id")
    v = v.withColumn("_mixed", F.coalesce(F.min(decoded).over(batch) != F.max(decoded).over(batch), F.lit(False)))
    final = _in_batch(F.col("_mixed"), F.col("_fine") & (F.col("_nth") > 1), F.col("idx"), F.col("code"), F.col("reason"))
    return v.select("batch_id", "idx", "raw", "source", "id", "type", "time", *final)


def limited(requests: DataFrame, max_body: int = S.MAX_BODY_BYTES, max_events: int = S.MAX_EVENTS, max_event: int = S.MAX_INGRESS_BYTES) -> DataFrame:
    """``requests`` (body, ...) with the elements' texts ``raws`` in place of the body, and ``code``; null code: within the limits."""
    last_of_repeated_keys(requests)
    parts = F.expr("try_cast(try_parse_json(body) as array<variant>)")
    r = requests.withColumn("raws", F.when(F.octet_length("body") <= max_body, F.transform(parts, lambda v: F.call_function("to_json", v))))
    code = F.when(F.octet_length("body") > max_body, "BODY_TOO_LARGE").when(F.col("raws").isNull(), "BODY_NOT_A_BATCH").when(F.size("raws") > max_events, "TOO_MANY_EVENTS").when(F.exists("raws", lambda x: F.octet_length(x) > max_event), "EVENT_TOO_LARGE")
    return r.withColumn("code", code).drop("body")


def batch_limits(requests: DataFrame, max_body: int = S.MAX_BODY_BYTES, max_events: int = S.MAX_EVENTS, max_event: int = S.MAX_INGRESS_BYTES) -> DataFrame:
    """(batch_id, n_events, code) of whole requests (batch_id, body); null code: within the limits."""
    r = limited(requests, max_body, max_events, max_event)
    return r.select("batch_id", F.when(F.col("raws").isNotNull(), F.size("raws")).cast("long").alias("n_events"), "code")


def rejections(verdicts: DataFrame) -> DataFrame:
    """The elements that a response names: one for a batch of several tenants, each rejected one otherwise."""
    return verdicts.where("reason is not null")


def outcomes(verdicts: DataFrame) -> DataFrame:
    """(batch_id, accepted, rejected, rejections) per batch; rejections are (idx, code, reason) in body order."""
    named = F.col("reason").isNotNull()
    return verdicts.groupBy("batch_id").agg(
        F.count_if(F.col("code").isNull()).alias("accepted"), F.count_if(named).alias("rejected"),
        F.array_sort(F.collect_list(F.when(named, F.struct("idx", "code", "reason")))).alias("rejections"),
    )
