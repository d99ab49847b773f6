"""Pseudonyms and field encryption with Spark's own functions.

Keys are derived once per tenant on the driver (a small dimension) and joined by
broadcast.  They live in columns, never as literals, so no plan text shows them.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S

BLOCK = 64


def _expand(secret: bytes, info: bytes, length: int) -> bytes:
    out, last = b"", b""
    for i in range(-(-length // 32)):
        last = hmac.new(secret, last + info + bytes([i + 1]), hashlib.sha256).digest()
        out += last
    return out[:length]


def tenant_keys(master: bytes, tenant: str) -> tuple[bytes, bytes]:
    """(encryption key, mac key) of a tenant: HKDF with one extract, salted with the tenant's name, and two expands."""
    if len(master) < 32:
        raise ValueError("the master secret has less than 32 bytes")
    base = hmac.new(tenant.encode(), master, hashlib.sha256).digest()
    return _expand(base, b"enc", 32), _expand(base, b"mac", 32)


def key_dimension(spark: SparkSession, master: bytes, tenants: list[str], version: int = 1, valid_from: float = float("-inf")) -> DataFrame:
    """(tenant, keyversion, valid_from, enc_key, ipad, opad): one row per tenant, pads made ready for the MAC.

    The union of several versions is a dimension with rotated keys; a version seals what happens from ``valid_from`` (seconds) on.
    """
    rows = []
    for t in tenants:
        enc, mac = tenant_keys(master, t)
        k = mac.ljust(BLOCK, b"\0")
        rows.append((t, version, float(valid_from), bytearray(enc), bytearray(b ^ 0x36 for b in k), bytearray(b ^ 0x5C for b in k)))
    return spark.createDataFrame(rows, "tenant string, keyversion int, valid_from double, enc_key binary, ipad binary, opad binary")


def by_tenant(keys: DataFrame) -> DataFrame:
    """(tenant, versions): all versions of a tenant's keys in one row, in the order in which they became valid."""
    return keys.groupBy("tenant").agg(F.array_sort(F.collect_list(F.struct("valid_from", "keyversion", "enc_key", "ipad", "opad"))).alias("versions"))


def valid_at(versions: Column, at: Column | None) -> Column:
    """The version of keys that is valid at a time in seconds, the last one without a time; null if none is."""
    live = versions if at is None else F.filter(versions, lambda k: k["valid_from"] <= at)
    return F.try_element_at(live, F.lit(-1))


def of_version(versions: Column, version: Column) -> Column:
    """The keys of one version, null if there is none."""
    return F.try_element_at(F.filter(versions, lambda k: k["keyversion"] == version), F.lit(1))


def token_version(token: Column) -> Column:
    """The key version that a token names, null if it names none."""
    return F.when(token.rlike(r"^[0-9]{1,9}\."), F.split_part(token, F.lit("."), F.lit(1)).cast("int"))


def pseudonym(value: Column, ipad: Column = None, opad: Column = None) -> Column:
    """HMAC-SHA256 of a text under prepared pads, in lower hex; null stays null."""
    ipad, opad = F.col("ipad") if ipad is None else ipad, F.col("opad") if opad is None else opad
    return F.sha2(F.concat(opad, F.unhex(F.sha2(F.concat(ipad, F.encode(value, "UTF-8")), 256))), 256)


def bound_data(*parts: Column) -> Column:
    """Parts with two-byte lengths before each, so that no two lists of parts give the same bytes."""
    b = [F.encode(p.cast("string"), "UTF-8") for p in parts]
    return F.concat(*[x for p in b for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 4, "0")), p)])


def encrypt_field(value: Column, key: Column, version: Column, aad: Column) -> Column:
    """``version.base64url(nonce, ciphertext, tag)``; null stays null."""
    raw = F.base64(F.aes_encrypt(F.encode(value, "UTF-8"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), aad))
    return F.when(value.isNotNull(), F.concat(version.cast("string"), F.lit("."), F.translate(raw, "+/\r\n", "-_")))


def decrypt_field(token: Column, key: Column, aad: Column) -> Column:
    """The text of a token, null if it was made with another key, version or place."""
    ok = token.rlike(r"^[0-9]+\.[A-Za-z0-9_=-]+$")
    raw = F.when(ok, F.unbase64(F.translate(F.split_part(token, F.lit("."), F.lit(2)), "-_", "+/")))
    return F.decode(F.try_aes_decrypt(F.when(F.octet_length(raw) >= 28, raw), key, F.lit("GCM"), F.lit("DEFAULT"), aad), "UTF-8")


def open_field(token: Column, versions: Column, source: Column, id_: Column, type_: Column, field: Column) -> Column:
    """The text of a token under the keys of the version that it names; null for an unknown version, another place or another tenant's token."""
    version = token_version(token)
    return decrypt_field(token, of_version(versions, version)["enc_key"], bound_data(source, id_, type_, field, version))


def sealed_fields(source: Column, id_: Column, type_: Column, fields: dict[str, Column], user: Column, k: Column) -> dict[str, Column]:
    """Columns in place of personal ones under the keys ``k`` (a struct): user_id_pseudo, ``<field>_enc``, and email_hmac for a mail."""
    version = k["keyversion"]
    made = {f"{f}_enc": encrypt_field(v, k["enc_key"], version, bound_data(source, id_, type_, F.lit(f), version)) for f, v in fields.items()}
    if "email" in fields:
        made["email_hmac"] = pseudonym(fields["email"], k["ipad"], k["opad"])
    return made | {"user_id_pseudo": pseudonym(user, k["ipad"], k["opad"])}


def with_keys(rows: DataFrame, keys: DataFrame, at: str | None = None) -> DataFrame:
    """``rows`` (tenant, ...) with ``_keys``, those of its tenant that are valid at the time ``at``; a row without any fails the job."""
    df = rows.join(F.broadcast(by_tenant(keys)), "tenant", "left").withColumn("_keys", valid_at(F.col("versions"), None if at is None else F.col(at))).drop("versions")
    return df.where(F.assert_true(F.col("_keys").isNotNull(), F.concat(F.lit("no keys for tenant "), F.coalesce("tenant", F.lit("(null)")))).isNull())


def protect(events: DataFrame, keys: DataFrame, at: str | None = None) -> DataFrame:
    """Candidates with a pseudonym and encrypted fields in place of plain ones.

    ``events`` has tenant, source, id, type, user_id and any of the personal fields;
    these become ``<field>_enc``, the mail also ``email_hmac``.  Of several versions of a tenant's keys the one that is valid at the
    time in column ``at`` seals, the last one without it.  A row of a tenant without keys fails the
    job: tenants are bound before, and nothing may pass unsealed.  Encryption draws a fresh nonce, so write the result once before it is read twice.
    """
    df = with_keys(events, keys, at)
    fields = [f for f in S.PII_FIELDS if f in events.columns]
    made = sealed_fields(F.col("source"), F.col("id"), F.col("type"), {f: F.col(f) for f in fields}, F.col("user_id"), F.col("_keys"))
    return df.withColumns(made | {"keyversion": F.col("_keys.keyversion")}).drop("_keys", "user_id", *fields)
