"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Texts are tokenised and cut into pieces of at most one sequence.  How many pieces there are
of each length is all that best fit needs: the plan is made over at most ``LIMIT`` counts, with
runs of sequences that are filled alike in place of single ones, and equals best fit
decreasing over all pieces.  Pieces then take the planned slots by their rank among the
pieces of their length.

Ranks need no sort and no exchange of texts: each input part numbers its own pieces of each
length, and the running sum of the counts of the parts before (one row per part and
length) gives the first rank of each.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LIMIT = 2048
END_ID = 0
#: Bytes of text whose units are told apart at a time.
SLICE = 1 << 20
#: Units whose ids a worker remembers (twice as many at most), the longest ones that it does, and units that are encoded in one text.
REMEMBERED, LONG_UNIT, TOGETHER = 200_000, 64, 128
_PLAIN = common._table(lambda b: b == 32 or 9 <= b <= 13)
_PLAIN[65:91] = np.arange(65, 91)  # case is the tokenizer's business
# fixed value: the pattern of pre-tokenizers that cut letters, digits and other characters apart
CUT_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _DIGIT, _OTHER, _WHOLE = 1, 2, 3, 4
#: What a byte is to such a pattern; words with contractions, special tokens, controls or longer characters stay whole.
_KIND = np.array([_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _WHOLE if b < 33 or b == 127 or chr(b) in "'<" else _OTHER for b in range(128)] + [_WHOLE] * 128, np.int8)
_encoders: dict[int, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts; the distinct units of a slice are encoded once.

    For tokenizers that drop white space and let no token cross it, as word BPE does.  Units are the words between blanks, or their
    runs of letters, single digits and other runs where the tokenizer lower-cases and cuts them apart itself.
    """

    def __init__(self, model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.older = Tokenizer.from_str(model), {}, {}
        told = json.loads(model)
        parts = [(told.get(one) or {}).get(many, []) for one, many in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.fine = any(x["type"] == "Lowercase" for x in parts[0]) and any(x.get("pattern") == {"Regex": CUT_APART} for x in parts[1])
        vocab, bpe = self.tokenizer.get_vocab(), told["model"]
        ids = np.arange(max(vocab.values(), default=0) + 1)
        zero = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.zero = ids == zero[0] if len(zero) == 1 else None
        # small letters are what normalizers and cuts leave alone, and each word's last token alone has the suffix
        alone = all(x["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or x.get("pattern") == {"Regex": r"\s+"} for x in parts[0])
        alone &= all(x.get("pattern") == {"Regex": CUT_APART} or (x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"]) for x in parts[1])
        self.letters, suffix = None, bpe.get("end_of_word_suffix")
        if self.fine and alone and bpe["type"] == "BPE" and suffix:
            self.letters = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
            self.last = np.isin(ids, [i for token, i in vocab.items() if token.endswith(suffix)])

    @staticmethod
    def of(model: str) -> Encoder:
        """One for each worker process, with what it remembers."""
        name = hash(model)
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(model)
        return _encoders[name]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets by text)."""
        low, start, end, row = common.words(*common.flat(texts), _PLAIN)
        solid, first = low[low != 32], np.cumsum(end - start) - (end - start)
        if self.fine and len(solid):
            kind, last = _KIND[solid], np.append(first[1:], len(solid))
            held = np.concatenate([[0], np.cumsum(kind == _WHOLE, dtype=np.int32)])
            whole = np.repeat(held[last] > held[first], end - start)
            edge = kind == _DIGIT
            edge[1:] |= kind[1:] != kind[:-1]
            edge &= ~whole
            edge[first] = True
            solid = np.where(whole, solid, common.SPACED[solid])
            many = np.concatenate([[0], np.cumsum(edge, dtype=np.int32)])
            row, first = np.repeat(row, many[last] - many[first]), np.flatnonzero(edge)
        ends = np.append(first, len(solid)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(solid))]).dictionary_encode()
        code, raw = units.indices.to_numpy(), self._of(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, begin = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(size) - size
        each = size[code]
        at = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(at[-1]) + np.repeat(begin[code] - at[:-1], each)]
        return ids, at[np.searchsorted(row, np.arange(len(texts) + 1))]

    def _of(self, units: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        raw = list(map(self.known.get, units))
        new = []
        for i, r in enumerate(raw):
            if r is None:
                r = raw[i] = self.older.get(units[i])
                if r is None:
                    new.append(i)
                else:
                    self.known[units[i]] = r
        if new:
            fresh = self._encoded([units[i] for i in new])
            for i in new:
                u = units[i]
                raw[i] = fresh[u]
                if len(u) <= LONG_UNIT:
                    self.known[u] = fresh[u]
        return raw

    def _encoded(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each unit; short ones go many in one text: small letters without normalizers and cuts, others without a 0 or a special token with a 0 after each."""
        encode = lambda tokenizer, texts: [np.array(x.ids, "<u4") for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        small = [u for u in new if self.letters is not None and len(u) <= LONG_UNIT and u.isalpha() and u.islower()]
        taken = set(small)
        plain = [u for u in new if self.zero is not None and len(u) <= LONG_UNIT and b"0" not in u and b"<" not in u and u not in taken]
        out = {}
        # a mark is the last id of a unit, or the 0 after it
        for tokenizer, units, end, marks, kept in ((self.letters, small, b" ", "last", 4), (self.tokenizer, plain, b" 0 ", "zero", 0)):
            groups = [units[i : i + TOGETHER] for i in range(0, len(units), TOGETHER)]
            for group, ids in zip(groups, encode(tokenizer, [end.join([*g, b""]).decode() for g in groups]) if groups else [], strict=True):
                at = np.flatnonzero(getattr(self, marks)[ids]) * 4
                if len(at) == len(group):
                    raw, lo = ids.tobytes(), 0
                    for u, hi in zip(group, at.tolist(), strict=True):
                        out[u] = raw[lo : hi + kept]
                        lo = hi + 4
        rest = [u for u in new if u not in out]
        return out | {u: ids.tobytes() for u, ids in zip(rest, encode(self.tokenizer, [u.decode() for u in rest]), strict=True)}


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(part, k, doc_id, piece, start, length, ids): the texts of ``docs`` (doc_id, text) as pieces of at most ``limit`` ids.

    A text, null ones too (null: empty), is its ids and ``end_id``.  Only longer ones are cut, and their last piece may be shorter.
    ``ids`` holds little-endian unsigned 32-bit numbers; ``k`` numbers the pieces of one ``part`` and length.
    Further columns are not looked at.  Rows that repeat a doc_id, or have none, are texts of their own.
    """
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, seen = Encoder.of(model.value), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            for x in common.slices(batch, SLICE):
                yield cut(encoder, x, part, seen)

    def cut(encoder: Encoder, x: pa.RecordBatch, part: int, seen: np.ndarray) -> pa.RecordBatch:
        ids, at = encoder.ids(x.column(1))
        n, size = x.num_rows, np.diff(at)
        out = np.full(len(ids) + n, end_id, "<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids
        many = -(-(size + 1) // limit)
        row = np.repeat(np.arange(n), many)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(limit, size[row] + 1 - piece * limit)
        order = np.argsort(length, kind="stable")
        counts = np.bincount(length, minlength=limit + 1)
        k = np.empty(len(row), np.int64)
        k[order] = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        k += seen[length]
        seen += counts
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        raw = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
        return pa.record_batch({"part": np.full(len(row), part, np.int32), "k": k, "doc_id": x.column(0).take(pa.array(row)), "piece": piece.astype(np.int32), "start": piece * limit, "length": length, "ids": raw})

    common.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "part int, k long, doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over counts by length: (length, first rank, number, first sequence, number in each, offset) of each step.

    A step fills a run of sequences that have the same room left, the one that fits best, with as many pieces of one length
    as go in.  Each time a run is filled its room at least halves, and a step splits one run at most, so there are
    under ``4 * limit * log2(limit)`` steps, however many pieces there are.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs of sequences (first, number)
    steps, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        for r in sorted(r for r in room if r >= length and room[r]):
            while left and room[r]:
                rank, left = _fill(steps, room, *room[r].pop(), r, length, rank, left, limit)
            if not left:
                break
        if left:
            n = -(-left // (limit // length))
            _fill(steps, room, used, n, limit, length, rank, left, limit)
            used += n
    return steps


def _fill(steps: list, room: dict, first: int, n: int, r: int, length: int, rank: int, left: int, limit: int) -> tuple[int, int]:
    """Fill the run (first, n) of room ``r``; the new rank and what is left."""
    each = r // length
    take = min(n, -(-left // each))
    number = min(left, take * each)
    steps.append((length, rank, number, first, each, limit - r))
    if take < n:
        room[r].append((first + take, n - take))
    whole, rest = divmod(number, each)
    if whole:
        room[r - each * length].append((first, whole))
    if rest:
        room[r - rest * length].append((first + whole, 1))
    return rank + number, left - number


def placed(cut: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``cut`` (part, k, length, ...; staged, as it is read twice) with sequence_id and offset in place of part and k."""
    spark = cut.sparkSession
    counts = common.stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    base, total = {}, 0
    for length in sorted(totals):
        base[length], total = total, total + totals[length]
    steps = sorted(plan(totals, limit))
    at = np.array([base[s[0]] + s[1] for s in steps], np.int64)
    shared = spark.sparkContext.broadcast((at, np.array(steps, np.int64).reshape(-1, 6)))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, steps = shared.value
        for b in batches:
            rank = np.asarray(b.column("rank"))
            s = steps[np.searchsorted(at, rank, "right") - 1]
            i = rank - at[np.searchsorted(at, rank, "right") - 1]
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(s[:, 3] + i // s[:, 4]), pa.array(s[:, 5] + i % s[:, 4] * s[:, 0])], names=[*keep, "sequence_id", "offset"])

    # the first rank of each part among the pieces of a length, on top of all shorter lengths
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("length")] if base else F.lit(0)
    first = counts.select("part", "length", (F.coalesce(before, F.lit(0)) + shift).alias("first"))
    keep = [c for c in cut.columns if c not in ("part", "k")]
    ranked = cut.join(first, ["part", "length"]).select(*keep, (F.col("first") + F.col("k")).alias("rank"))
    return ranked.mapInArrow(slots, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.select(*keep).schema) + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece of ``docs`` with its ids and its place."""
    return placed(common.stage(pieces(docs, tokenizer, limit, end_id), "pieces", codec="zstd"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, ends): each packed sequence, with the document and the end of each piece in it."""
    x = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("x"))
    ids = F.aggregate("x", F.lit(b""), lambda a, y: F.concat(a, y["ids"]))
    return x.select("sequence_id", ids.alias("ids"), F.transform("x", lambda y: y["doc_id"]).alias("doc_ids"), F.transform("x", lambda y: y["offset"] + y["length"]).alias("ends"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in sequences of 2,048 ids; ids travel as their checksums once they are cut."""
    cut = common.stage(pieces(common.table(spark, sf_dir, "documents").select("doc_id", "text")), "pieces", codec="zstd")
    return placed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
