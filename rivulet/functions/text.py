"""Scalar functions of the contract as Spark columns."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .. import schemas as S


def tenant_of(source: Column) -> Column:
    """The tenant named by a source; null where the source is malformed."""
    t = F.regexp_extract(source, S.SOURCE_RE, 1)
    return F.when(t != "", t)


def attribute_name_ok(name: Column) -> Column:
    return name.rlike("^[a-z][a-z0-9]{0,19}$") & (name != "data")


def extra_attribute(raw: Column) -> Column:
    """The first top-level key, by name, that the contract does not allow; null if there is none."""
    return F.array_min(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, [*S.CONTEXT_ATTRIBUTES, "data"]))))


def json_text(raw: Column, key: str) -> Column:
    """A top-level value of a JSON object that is a text; null for other kinds, other values and broken JSON."""
    v = F.call_function("try_variant_get", F.call_function("try_parse_json", raw), F.lit(f"$.{key}"), F.lit("variant"))
    return F.when(F.call_function("schema_of_variant", v) == "STRING", F.call_function("try_variant_get", v, F.lit("$"), F.lit("string")))


def channel_label(channel: Column, metadata: Column) -> Column:
    """What tells a channel's clients apart, read from its own shape of metadata: page, device model or campaign."""
    get = lambda path: F.get_json_object(metadata, path)
    campaign = F.concat_ws("/", get("$.utm_source"), get("$.utm_medium"))
    return F.when(channel == "MOBILE_APP", get("$.device.model")).when(channel == "THIRD_PARTY_SERVICE", F.when(campaign != "", campaign)).otherwise(get("$.page"))


def partition_key(tenant: Column, pseudonym: Column) -> Column:
    return F.concat_ws("|", tenant, pseudonym)


def hint_conflicts(hint: Column, key: Column) -> Column:
    return hint.isNotNull() & (hint != key)


def sequence_number(seq: Column) -> Column:
    """The number a sequence text holds, null ("unchecked") for anything else."""
    return F.trim(seq).try_cast("bigint")


def code_of(reason: Column) -> Column:
    return F.rtrim(F.split(F.trim(reason), r"\s+")[0], F.lit(":"))


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("other")


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def preview(text: Column, width: int = 20) -> Column:
    """A long cell as its start and its length."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(".."), F.length(text).cast("string"))).otherwise(text)


@F.pandas_udf(IntegerType())
def _blake_mod(tenant: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") % int(k) for t, k in zip(tenant, n, strict=True)], dtype="int32")


def shard_of(tenant: Column, n: int) -> Column:
    """Shard number of a tenant; meant for the tenant dimension, not for events."""
    return _blake_mod(tenant, F.lit(n))
