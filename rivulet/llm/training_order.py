"""Training-order materialisation as fixed-stride binary shards.

Texts are tokenised and packed, with an end mark after each text, into sequences
of equal length.  A keyed Feistel permutation over the number of sequences, with
cycle-walking, gives every sequence its global slot; no sort and no table of
random numbers is needed, and any slot can be traced back.  Ranges of slots
are dealt to shards, and each record is written with the same number of bytes, so the record of a
slot starts at a computed place and a reader can resume anywhere.

Numbers of sequences are dense: each staged file part counts its own, and the
running sum of these counts (one row per part) gives the first number of each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEQUENCE = 1024
SHARD_RECORDS = 8192
END_TOKEN = 50256
ROUNDS = 4
#: A record: slot, sequence number (8 bytes each), then the tokens as unsigned 16-bit numbers, all little-endian, and a line end.
HEADER = 16
PACK_BYTES = 6 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _encoder(path: str):
    import base64

    import public_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, public_tokenizers.PATTERN


def sequences(docs: DataFrame, vocabulary: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """(part, k, doc_ids, tokens): packed sequences of each input part.

    ``tokens`` holds ``length`` unsigned 16-bit numbers; ``doc_ids`` names the texts that start or
    go on in it.  Every text, empty and null ones too (null: empty), is followed by one end
    token; the last sequence of a part is filled up with end tokens.
    """
    ranks, pattern = _encoder(vocabulary or default_vocabulary())
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import TaskContext

        ranks, pattern = shared.value
        enc = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        part, k, rest, ids = TaskContext.get().partitionId(), 0, np.zeros(0, np.uint16), []

        def cut(tokens: np.ndarray, own: list, whole: bool):
            """Full sequences of the tokens so far; ``own`` has (place of the first token, id) of each text."""
            nonlocal k
            n = -(-len(tokens) // length) if whole else len(tokens) // length
            at = [p for p, _ in own]
            rows = []
            for i in range(n):
                a, b = i * length, (i + 1) * length
                piece = tokens[a:b]
                if len(piece) < length:
                    piece = np.concatenate([piece, np.full(length - len(piece), END_TOKEN, np.uint16)])
                lo, hi = max(0, int(np.searchsorted(at, a, "right")) - 1), int(np.searchsorted(at, b))
                rows.append((k + i, [d for _, d in own[lo:hi]], piece.astype("<u2").tobytes()))
            k += n
            left = tokens[n * length :]
            lo = max(0, int(np.searchsorted(at, n * length, "right")) - 1)
            keep = [(p - n * length, d) for p, d in own[lo:]] if len(left) else []
            out = None
            if rows:
                out = pa.record_batch([pa.array([part] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.binary())], names=["part", "k", "doc_ids", "tokens"])
            return out, left, keep

        for batch in batches:
            for piece in common.slices(batch):
                texts = piece.column(1).to_pylist()
                found = [enc.encode_ordinary(t) if t else [] for t in texts]
                at = len(rest)
                for d, f in zip(piece.column(0).to_pylist(), found, strict=True):
                    ids.append((at, d))
                    at += len(f) + 1
                rest = np.concatenate([rest, *(np.array([*f, END_TOKEN], np.uint16) for f in found)])
                out, rest, ids = cut(rest, ids, False)
                if out is not None:
                    yield out
        if len(rest):
            yield cut(rest, ids, True)[0]

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, k long, doc_ids array<long>, tokens binary")


def feistel(x: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slots of numbers in 0 .. total-1: a permutation of that range set by ``key``.

    The network permutes the next range of 4**h numbers; an image outside is
    sent through again until it falls inside.
    """
    half = max(1, -(-(max(total, 2) - 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    keys = common.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(common._BASE) + np.uint64(key))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            left, right = right, left ^ (common.mix(right + k) & mask)
        return left << np.uint64(half) | right

    out = once(x.astype(np.uint64))
    while (far := out >= total).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def feistel_slots(df: DataFrame, number: str, total: int, key: int, slot: str = "slot") -> DataFrame:
    """``df`` with the slot of each ``number``; only that column goes to Python, in Arrow batches."""
    permute = F.pandas_udf(lambda x: type(x)(feistel(x.to_numpy(), total, key)), "long")
    return df.withColumn(slot, permute(F.col(number)))


def numbered(staged: DataFrame) -> tuple[DataFrame, int]:
    """``staged`` sequences with dense numbers ``seq`` by (part, k), and their total."""
    counts = staged.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.withColumn("first", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", F.coalesce("first", F.lit(0)).alias("first"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return staged.join(F.broadcast(first), "part").withColumn("seq", F.col("first") + F.col("k")).drop("first"), total


def write_shards(staged: DataFrame, path: str, key: int, length: int = SEQUENCE, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Write the shards under ``path``; returns (seq, slot, shard, place, doc_ids) of every record.

    The shard of a slot is ``slot // shard_records`` and its record starts at
    ``(slot % shard_records) * stride(length)`` bytes of that shard's one file.
    """
    rows, total = numbered(staged)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records of a task that go to one shard, compressed together."""
        held, size = [], 0
        for batch in batches:
            seq = np.asarray(batch.column(0))
            held.append((feistel(seq, total, key), seq, batch.column(1).to_pylist()))
            size += len(seq) * 2 * length
            if size > PACK_BYTES:
                yield _packed(held, shard_records)
                held, size = [], 0
        if size:
            yield _packed(held, shard_records)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The records of one pack at a time."""
        for batch in batches:
            for shard, blob in zip(batch.column("shard"), batch.column("blob"), strict=True):
                rec = _unpacked(blob.as_py(), length)
                slot = rec[:, :8].copy().view("<i8").ravel()
                ends = pa.array(np.arange(0, rec.size + 1, rec.shape[1], dtype=np.int32)).buffers()[1]
                raw = pa.Array.from_buffers(pa.binary(), len(rec), [None, ends, pa.py_buffer(rec)])
                yield pa.record_batch({"shard": pa.array(np.full(len(rec), shard.as_py(), np.int64)), "slot": slot, "raw": raw})

    common.small_batches(staged.sparkSession)
    blobs = rows.select("seq", "tokens").mapInArrow(pack, "shard long, blob binary")
    # a group is one shard, which a fixed number of records bounds
    out = blobs.groupBy("shard").applyInArrow(unpack, "shard long, slot long, raw binary").sortWithinPartitions("shard", "slot")
    with common._cleaned_shuffles(staged.sparkSession):
        out.select("shard", F.col("raw").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").text(path)
    placed = feistel_slots(rows.drop("tokens"), "seq", total, key).withColumn("shard", F.floor(F.col("slot") / shard_records).cast("long"))
    return placed.select("seq", "slot", "shard", (F.col("slot") % shard_records * stride(length)).alias("place"), "doc_ids")


def _packed(held: list, shard_records: int) -> pa.RecordBatch:
    slot, seq = (np.concatenate([h[k] for h in held]) for k in (0, 1))
    tokens = [t for h in held for t in h[2]]
    shard = slot // shard_records
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    cuts = np.append(first, len(order))
    blobs = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = order[a:b]
        raw = slot[at].astype("<i8").tobytes() + seq[at].astype("<i8").tobytes() + b"".join([tokens[i] for i in at])
        blobs.append(zstandard.compress(len(at).to_bytes(8, "little") + raw, 3))
    return pa.record_batch({"shard": names.astype(np.int64), "blob": pa.array(blobs, pa.binary())})


def _unpacked(blob: bytes, length: int) -> np.ndarray:
    """Records as rows of bytes, without the line end."""
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    heads = raw[8 : 8 + 16 * n].reshape(2, n, 8)
    return np.concatenate([heads[0], heads[1], raw[8 + 16 * n :].reshape(n, 2 * length)], axis=1)


def stride(length: int = SEQUENCE) -> int:
    return HEADER + 2 * length + 1


def read_records(spark: SparkSession, path: str, length: int = SEQUENCE, start: int = 0, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """(slot, seq, tokens) from slot ``start`` on; shards before it are not opened."""
    size = stride(length)
    files = spark.read.format("binaryFile").option("basePath", path).load(path)
    if "shard" not in files.columns:  # no shard was written
        files = files.withColumn("shard", F.lit(None).cast("long"))
    files = files.where(F.col("shard") >= start // shard_records).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                data = np.frombuffer(raw.as_buffer(), np.uint8)
                assert len(data) % size == 0, "a shard has a partial record"
                rec = data.reshape(-1, size)
                slot, seq = (rec[:, a : a + 8].copy().view("<i8").ravel() for a in (0, 8))
                keep = slot >= start
                toks = np.ascontiguousarray(rec[keep, HEADER:-1])
                ends = pa.array(np.arange(0, toks.size + 1, 2 * length, dtype=np.int32)).buffers()[1]
                yield pa.record_batch({"slot": slot[keep], "seq": seq[keep], "tokens": pa.Array.from_buffers(pa.binary(), len(toks), [None, ends, pa.py_buffer(toks)])})

    return files.mapInArrow(run, "slot long, seq long, tokens binary")


def op6_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokenise, permute and write all of ``documents``; each record is read back from its shard."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    staged = common.stage(sequences(docs), "sequences", codec="zstd")
    path = f"{common.shared_dir(spark)}/training-{uuid.uuid4().hex}"
    placed = write_shards(staged, path, key=20240229)
    back = read_records(spark, path).select("slot", F.sha2("tokens", 256).alias("tokens_sha256"))
    return common.stage(placed.join(back, "slot").select("slot", "seq", "shard", "place", "doc_ids", "tokens_sha256"), "records")
