"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash.  It starts with one
bucket; only a bucket over the byte limit splits, on the next bit, until every
shard fits.  The split decisions need byte counts by hash prefix alone, so they
are made on a histogram of fixed width (a map-side combined group-by), rolled up
over depths as rows; only histogram cells that are still too large are refined
with more bits.  Rows are moved once, when the shards are written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BITS = 60
LIMIT = 2 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of md5 of the key as text; a null key counts as ''."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _cells(rows: DataFrame, bits: int) -> DataFrame:
    return rows.groupBy(F.shiftright("h", BITS - bits).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows"))


def _leaves(cells: DataFrame, bits: int, low: int, limit: int) -> DataFrame:
    """(cell, depth, n_bytes, n_rows): the bucket that each cell ends in, for depths from ``low`` to ``bits``."""
    steps = cells.select("cell", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"), F.col("n_bytes").alias("b"), F.col("n_rows").alias("r"))
    steps = steps.withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
    sizes = steps.groupBy("depth", "prefix").agg(F.sum("b").alias("n_bytes"), F.sum("r").alias("n_rows"))
    fit = steps.select("cell", "depth", "prefix").join(sizes, ["depth", "prefix"]).where((F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == bits))
    return fit.groupBy("cell").agg(F.min(F.struct("depth", "n_bytes", "n_rows")).alias("x")).select("cell", "x.*")


def extendible_shards(df: DataFrame, key: str, size: Column, limit: int = LIMIT) -> DataFrame:
    """``df`` with ``shard`` (``b`` and the hash prefix in bits), ``depth``, ``n_bytes`` and ``shard_bytes``.

    * Rows with the same key stay together while their bucket can hold them.
      Where one full hash alone is over the limit, its rows are cut by a running
      sum, ordered by size and row hash, and the cut number follows a ``-``.
    * A single row over the limit has a shard of its own.
    * A null size counts as 0 and a null key as ''; repeated rows each count.
    * An empty table gives no shards.  A column of ``df`` named like an added
      one, or like one that is used on the way, is kept with as many ``_in`` at its end as make it unique.
    """
    added = ["shard", "depth", "n_bytes", "shard_bytes"]
    new = {}
    for c in [c for c in df.columns if c in [*added, "h", "cell", "_rows", "_cut"]]:
        new[c] = f"{c}_in"
        while new[c] in [*df.columns, *[v for x, v in new.items() if x != c]]:
            new[c] += "_in"
    src = df.withColumnsRenamed(new)
    names = src.columns
    k = new.get(key, key)
    rows = src.withColumns({"h": hash_bits(F.col(k)), "n_bytes": F.coalesce(size.cast("long"), F.lit(0).cast("long"))})
    light = rows.select("h", "n_bytes")
    total = light.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    bits, low, parts, rest = min(BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + 5), 0, [], light
    while True:
        leaves = common.stage(_leaves(_cells(rest, bits), bits, low, limit), "shards")
        over = (F.col("n_bytes") > limit) & (F.col("n_rows") > 1)
        parts.append((bits, leaves.where(~over if bits < BITS else F.lit(True))))
        heavy = leaves.where(over).select("cell")
        if bits == BITS or heavy.isEmpty():
            break
        rest = rest.withColumn("cell", F.shiftright("h", BITS - bits)).join(heavy, "cell", "left_semi").select("h", "n_bytes")
        low, bits = bits + 1, min(BITS, bits + 12)
    out = None
    for bits, leaves in parts:
        got = rows.withColumn("cell", F.shiftright("h", BITS - bits)).join(leaves.select("cell", "depth", F.col("n_bytes").alias("shard_bytes"), F.col("n_rows").alias("_rows")), "cell")
        got = got.withColumn("shard", F.concat(F.lit("b"), F.expr(f"substring(lpad(conv(h, 10, 2), {BITS}, '0'), 1, depth)")))
        out = got if out is None else out.unionByName(got)
    fits = out.where((F.col("shard_bytes") <= limit) | (F.col("_rows") == 1))
    same = out.where((F.col("shard_bytes") > limit) & (F.col("_rows") > 1))
    if parts[-1][0] == BITS:
        order = Window.partitionBy("h").orderBy("n_bytes", F.xxhash64(*names))
        same = same.withColumn("_cut", F.floor((F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1) / F.lit(max(1, limit // 2))))
        # a cut spans at most half the limit and the row that crosses its end
        big = F.col("n_bytes") > limit // 2
        same = same.withColumn("_cut", F.when(big, F.concat(F.lit("r"), F.row_number().over(order))).otherwise(F.col("_cut").cast("string")))
        same = same.withColumn("shard", F.concat("shard", F.lit("-"), "_cut"))
        same = same.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("shard"))).drop("_cut")
        fits = fits.unionByName(same)
    return fits.select(*names, *added)


def write_shards(df: DataFrame, key: str, size: Column, path: str, limit: int = LIMIT) -> DataFrame:
    """Write one folder ``shard=...`` per shard and return the written table."""
    done = extendible_shards(df, key, size, limit)
    schema = done.schema
    with common._cleaned_shuffles(df.sparkSession):
        done.repartition("shard").write.partitionBy("shard").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all of ``documents`` by doc_id, write the shards and read each row's place back."""
    docs = common.table(spark, sf_dir, "documents")
    path = f"{common.shared_dir(spark)}/shards-{common.uuid.uuid4().hex}"
    back = write_shards(docs.select("doc_id", "text"), "doc_id", F.octet_length("text"), path)
    return back.select("doc_id", "shard", F.col("depth").cast("int").alias("depth"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "shard_bytes")


SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT depth::INT AS depth, h >> ({BITS} - depth) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM d, range(0, {BITS + 1}) r(depth) GROUP BY 1, 2),
f AS (SELECT * FROM s WHERE shard_bytes <= {LIMIT} OR n = 1)
SELECT doc_id, shard, depth, n_bytes, shard_bytes FROM (
  SELECT doc_id, 'b' || substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, depth, n_bytes, shard_bytes,
         row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
  FROM d JOIN f ON f.p = d.h >> ({BITS} - depth)) WHERE k = 1
"""
