"""Helpers that the corpus operators share: staging, byte views and hashing.

Staging
    Intermediate results that more than one later job reads are written as
    Parquet under the folder named by ``spark.checkpoint.dir`` and read again.
    That cuts lineage, survives lost executors and needs no local folder.

Hashing
    Work inside tasks is vectorised over slices of about 256 kB of UTF-8, so
    memory stays flat whatever the batch size.  Words are known by 64-bit digests under a key
    that is drawn for each run; where equality decides, words are compared themselves.  Prefix hashes, for strings of under 512 bytes only, are polynomials
    modulo 2**64 over a table of random odd weights per byte; the difference of two prefix
    values, shifted back by the inverse power, is the hash of the bytes between.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
import secrets
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
BLOCK_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


# --------------------------------------------------------------------------
# tables
# --------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark's own reader from any file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the
    master is local, as in tests, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def _cleaned_shuffles(spark: SparkSession):
    """Shuffle files of the statements inside are removed as each one ends."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    with _cleaned_shuffles(spark):
        # row groups are held in memory until they are full
        df.write.option("compression", codec).option("parquet.block.size", BLOCK_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stage = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that no later job reads."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stage)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fits_broadcast(df: DataFrame, row_limit: int) -> bool:
    """True if ``df`` has at most ``row_limit`` rows (counted, not estimated)."""
    return df.limit(row_limit + 1).count() <= row_limit


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, row_limit: int = 1_000_000) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids``.

    The ids are broadcast only when a count shows at most ``row_limit`` of them;
    beyond that the semi join shuffles both sides.
    """
    right = F.broadcast(ids) if fits_broadcast(ids, row_limit) else ids.hint("shuffle_hash")
    return df.join(right, key, "left_semi")


def matched(left: DataFrame, found: DataFrame, key: str, row_limit: int = 100_000) -> DataFrame:
    """``left`` joined with ``found``, which has one line for each value of ``key`` and the number of its ``rows`` in ``left``.

    ``found`` is broadcast if a count shows that it is small.  Otherwise only its most frequent keys are, of
    which there are at most 20,000, so that none of them meets in one task.
    """
    if fits_broadcast(found, row_limit):
        return left.join(F.broadcast(found.drop("rows")), key)
    most = (found.agg(F.sum("rows")).first()[0] or 0) // 20_000
    often, rest = found.where(F.col("rows") > most).drop("rows"), found.where(F.col("rows") <= most).drop("rows")
    frequent = left.join(F.broadcast(often), key)
    return frequent.unionByName(left.join(F.broadcast(often.select(key)), key, "left_anti").join(rest.hint("shuffle_hash"), key))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Text rows are large: Arrow batches of the default 10,000 rows would hold tens of MB per worker and task.

    The settings stay in the session, as results are computed later; they change no result.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        old = spark.conf.get(key)
        if not old.isdigit() or int(old) == 0 or int(old) > most:
            spark.conf.set(key, most)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` over row slices of about 256 kB of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    yield out

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by rows so that no slice of several rows exceeds ``most`` bytes of text."""
    n = batch.num_rows
    if not n:
        return
    ends = np.zeros(n + 1, np.int64)
    for col in batch.columns:
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type) or pa.types.is_large_string(col.type):
            ends += flat(col)[1]
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        yield batch.slice(lo, min(hi, n) - lo)
        lo = hi


def in_one_task(bounded: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over all rows of a frame of stated bound, as one pandas frame in one task; no rows, no call.

    An exchange brings the rows there, so that what they come from keeps its own tasks.
    """

    def run(batches):
        import pandas as pd

        parts = [b for b in batches if len(b)]
        if parts:
            yield fn(pd.concat(parts, ignore_index=True))

    return bounded.repartition(1).mapInPandas(run, schema)


# --------------------------------------------------------------------------
# bytes of a column
# --------------------------------------------------------------------------
def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets from 0) of a string or binary column; null counts as empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    big = col.cast(pa.large_binary())
    _, offs, data = big.buffers()
    o = np.frombuffer(offs, np.int64, len(big) + 1, big.offset * 8)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def _table(blank: Callable[[int], bool]) -> np.ndarray:
    return np.array([32 if blank(b) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


#: Bytes of words: lower case, and blanks for space and the controls from tab to carriage return,
#: or for all but letters, digits, underscores and bytes of longer characters.
SPACED = _table(lambda b: b == 32 or 9 <= b <= 13)
PLAIN = _table(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b == 95 or b >= 128))
_WEIGHT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | _U(1)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << int(n).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, _U(base))
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with hash(data[a:b]) = span_hash(p, a, b)."""
    p = np.zeros(len(data) + 1, np.uint64)
    up, _ = _powers(len(data) + 1)
    np.cumsum(_WEIGHT[data] * up[: len(data)], out=p[1:])
    return p


def span_hash(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, down = _powers(len(p))
    return mix((p[b] - p[a]) * down[a] + b.astype(np.uint64) - a.astype(np.uint64))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes under ``table``, start, end, row) of each maximal run of bytes within a row that ``table`` does not make blank."""
    low = table[data]
    n = len(low)
    if not n:
        return low, *[np.zeros(0, np.int64)] * 3
    solid = low != 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offs[(offs > 0) & (offs < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, start, end, np.searchsorted(offs, start, "right") - 1


#: Words whose digests a worker remembers, and the longest ones that it does.
_REMEMBERED, _LONG_WORD = 200_000, 64
_known: dict[bytes, dict[bytes, bytes]] = {}


def word_key() -> bytes:
    """A key for word digests.  The driver draws one for each run and no output holds it, so nobody can build words of one digest."""
    return secrets.token_bytes(16)


def distinct_words(cols: list[pa.Array], table: np.ndarray = SPACED) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """The different words of all ``cols``, and for each of these (places in that list, word offsets by row): words are compared byte by byte."""
    parts = [words(*flat(col), table) for col in cols]
    ends = np.concatenate([[0], *(end - start for _, start, end, _ in parts)]).cumsum()
    solid = np.concatenate([low[low != 32] for low, *_ in parts])
    x = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(solid))]).dictionary_encode()
    code, lo, out = x.indices.to_numpy().astype(np.int64), 0, []
    for col, (_, start, _, row) in zip(cols, parts, strict=True):
        out.append((code[lo : lo + len(start)], np.searchsorted(row, np.arange(len(col) + 1))))
        lo += len(start)
    return x.dictionary.to_pylist(), out


def word_hashes(col: pa.Array, table: np.ndarray = SPACED, key: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(digest of each lower-cased word under ``key``, word offsets by row)."""
    found, [(code, at)] = distinct_words([col], table)
    if key not in _known or len(_known[key]) > _REMEMBERED:
        _known.clear()
    known = _known.setdefault(key, {})
    digests = []
    for w in found:
        d = known.get(w)
        if d is None:
            d = hashlib.blake2b(w, digest_size=8, key=key).digest()
            if len(w) <= _LONG_WORD:
                known[w] = d
        digests.append(d)
    return np.frombuffer(b"".join(digests), "<u8").astype(np.uint64)[code], at


def shingle_numbers(code: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all runs of ``n`` words of each row, from the words' own numbers, with offsets by row: equal for equal runs and no others.

    A row with fewer words, but at least one, has its whole sequence as one.
    """
    row, at, size, soffs = _shingles(woffs, n)
    base = int(code.max(initial=0)) + 2
    number, span = np.zeros(len(row), np.int64), 1
    for j in range(n):
        if span * base >= 1 << 62:
            number = np.unique(number, return_inverse=True)[1]
            span = len(number)
        have = size > j
        word = np.zeros(len(row), np.int64)
        word[have] = code[at[have] + j] + 1
        number, span = number * base + word, span * base
    return number, soffs


def _shingles(woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, number of words) of each run of ``n`` words, and offsets by row."""
    count = np.diff(woffs)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    soffs = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(len(count)), made)
    return row, woffs[row] + np.arange(soffs[-1]) - soffs[row], np.minimum(count[row], n), soffs


def shingle_hashes(wh: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of each row, with offsets by row.

    A row with fewer words, but at least one, has its whole sequence as one.
    """
    _, at, size, soffs = _shingles(woffs, n)
    h = size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    mult = 1
    for j in range(n):
        mult = mult * _BASE % (1 << 64)
        have = size > j
        h[have] += wh[at[have] + j] * _U(mult)
    return mix(h), soffs


# --------------------------------------------------------------------------
# links and components
# --------------------------------------------------------------------------
def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the least node reachable.

    Alternates large-star and small-star steps, each a group-by and a join of
    rows that never outnumber the edges; every round is staged, so no lineage
    builds up.  Each node's neighbours are met by a join with its minimum, never
    collected.  Nulls and self links are ignored; an empty table gives none.
    """
    e = stage(_both(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))).where("a > b").distinct(), "edges")
    for _ in range(rounds):
        # large star: every larger neighbour of u is linked with the least of u and its neighbours
        both = _both(e)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours are linked with the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.withColumnRenamed("m", "b"))
        new = stage(small.distinct(), "star")
        done = new.count() == e.count() and new.exceptAll(e).isEmpty()
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _both(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select("a", "b").unionByName(e.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))


def crc_part(col: Column, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``."""
    return F.crc32(col.cast("string")) % n
