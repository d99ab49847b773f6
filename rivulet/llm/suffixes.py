"""Exact removal of repeated byte strings by a sparse, distributed suffix sort.

A byte goes if some string of ``length`` bytes that covers it also starts
earlier.  Sorting every suffix would move each text a hundred times over, so
suffixes are sorted only where they can matter:

1. *Anchors.*  Every window of ``length`` bytes names one anchor inside it, the
   place of its least k-gram hash (winnowing).  Equal windows name the same place, so a
   window is compared only with windows whose anchors have the same k-gram.
   Consecutive windows with one anchor form a block.
2. *Counts.*  A block whose k-gram is found nowhere else holds no repeat.  Counts
   are combined before their exchange, so a common k-gram is one row from each task.
   A k-gram with many different blocks (the edges of a common passage differ from text to text) would
   keep one task busy.  Its blocks are cut by ranges of the offset ``o`` of a window before the anchor:
   equal windows of a range share the bytes that all its windows have, which name the cut block
   in place of the k-gram.  Where these names are still too common, blocks are cut into single windows, and
   those of one name are equal.
3. *Suffix runs.*  The other blocks' suffixes (from the anchor on) are sorted in every
   map task.  Blocks with the same bytes stand side by side there: all but the first are repeats as a
   whole, and only the first goes on.  Runs are front-coded (shared prefix length and the rest) and
   exchanged by equal ranges of the k-gram hash.  A tree of losers merges them; it holds each candidate's common
   prefix with the last winner and never compares those bytes again.  The
   merged order comes with its common prefix lengths.
4. *Windows.*  For a window that starts ``o`` bytes before its anchor, suffixes
   with a common prefix of ``length - o`` are neighbours in that order; of those
   with the same ``o`` bytes before the anchor all but the first in
   (document, start) are repeats.

k-grams meet by 64-bit hashes; every repeat is confirmed by its bytes, before the anchor and from it on.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 100
GRAM = 28
#: Bytes of blocks that a task sorts at once.
RUN_BYTES = 12 << 20
_BLOCK = "g long, b long, doc_id long, lo int, off int, n int"
#: A key with more different blocks is cut by ranges of this many offsets, at most so many keys at a time; the others stay whole.
MANY, STEPS, KEYS = 20_000, (9, 1), 1_000_000


# --------------------------------------------------------------------------
# 1. anchors and blocks
# --------------------------------------------------------------------------
def _anchor_blocks(data: np.ndarray, offs: np.ndarray, p: np.ndarray, length: int, gram: int):
    """Blocks of all rows: (row, first window, anchor, last window, k-gram hash), positions in ``data`` of prefix hashes ``p``."""
    n, width = len(data), length - gram + 1
    if n < length:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    start = np.arange(n - gram + 1, dtype=np.int32)
    g = common.span_hash(p, start, start + gram)
    # the first place of the least hash in each window, from windows of half the width
    low, at, size = g, start, 1
    while size < width:
        step = min(size, width - size)
        right = low[step:] < low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    anchor = at.astype(np.int64)
    # windows lie inside one row
    row = np.searchsorted(offs, np.arange(len(anchor)), "right") - 1
    inside = np.arange(len(anchor)) + length <= offs[row + 1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    lo = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    hi = np.flatnonzero(last)
    # the least hash of many is small: mixed again, equal ranges of it hold equal shares
    return row[lo], lo, anchor[lo], hi, common.mix(g[anchor[lo]])


def _cut(row, lo, a, hi, g, p: np.ndarray, step: int, length: int, gram: int):
    """Blocks cut by ranges of ``step`` offsets, each with a hash of the bytes that all windows of the range have."""
    most, least = (a - lo) // step, (a - hi) // step
    k = most - least + 1
    i = np.repeat(np.arange(len(a)), k)
    r = least[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
    begin, end = r * step, np.minimum(r * step + step - 1, length - gram)
    key = common.span_hash(p, a[i] - begin, a[i] + length - end)
    return row[i], np.maximum(lo[i], a[i] - end), a[i], np.minimum(hi[i], a[i] - begin), common.mix(key + (r * (length + 1) + step).astype(np.uint64))


def blocks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, cuts: tuple[tuple[int, np.ndarray], ...] = ()) -> DataFrame:
    """(g, b, doc_id, lo, off, n): k-gram hash, hash of the block, first window, anchor behind it, windows.

    For each (step, keys) of ``cuts`` only blocks of these keys, in ascending order, go on, cut by ranges of ``step`` offsets.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = common.flat(part.column(1))
        p = common.prefix_hash(data)
        made = _anchor_blocks(data, offs, p, length, gram)
        for step, keys in cuts:
            g = made[-1].view(np.int64)
            mine = keys[np.minimum(np.searchsorted(keys, g), len(keys) - 1)] == g
            made = _cut(*(v[mine] for v in made), p, step, length, gram)
        row, lo, a, hi, g = made
        b = common.mix(common.span_hash(p, lo, hi + length) + (a - lo).astype(np.uint64))
        ids = part.column(0).take(pa.array(row))
        return pa.record_batch({"g": g.view(np.int64), "b": b.view(np.int64), "doc_id": ids, "lo": (lo - offs[row]).astype(np.int32), "off": (a - lo).astype(np.int32), "n": (hi - lo + 1).astype(np.int32)})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, _BLOCK)


def repeated_blocks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> list[DataFrame]:
    """Staged (g, doc_id, lo, off, n): blocks whose key is found elsewhere too, cut while it has more than ``many`` different ones."""
    out, cuts = [], []
    for step in (*STEPS, 0):
        made = common.stage(blocks(docs, length, gram, tuple(cuts)), "blocks")
        counts = common.stage(made.groupBy("g").agg(F.count("*").alias("rows")).where("rows > 1"), "grams")
        often, hot = counts.where(F.col("rows") > many), None
        # single windows of one key are equal, and stand for one in each run
        if step and not often.isEmpty():
            kinds = common.matched(made.select("g", "b"), often, "g").groupBy("g", "b").agg(F.lit(1).alias("one")).groupBy("g").agg(F.count("*").alias("kinds"))
            hot = common.stage(kinds.where(F.col("kinds") > many).orderBy(F.desc("kinds"), "g").limit(KEYS).select("g"), "hot")
            keys = np.sort(np.array([r.g for r in hot.collect()], np.int64))  # at most KEYS
            counts = counts.join(hot, "g", "left_anti")
        out.append(common.stage(common.matched(made.drop("b"), counts, "g"), "found"))
        common.unstage(made)
        if hot is None or not len(keys):
            break
        cuts.append((step, keys))
    return out


# --------------------------------------------------------------------------
# 3. front-coded runs and the tree of losers
# --------------------------------------------------------------------------
def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n, k = min(len(a), len(b)), known
    step = 16
    while k < n:
        e = min(n, k + step)
        if a[k:e] == b[k:e]:
            k, step = e, step * 2
        elif step == 1 or e - k == 1:
            return k
        else:
            step = max(1, (e - k) // 2)
            while step > 1 and a[k : k + step] == b[k : k + step]:
                k += step
                step = max(1, min(step, n - k) // 2 or 1)
            if a[k : k + 1] != b[k : k + 1]:
                return k
    return n


def front_decode(lcp: np.ndarray, sizes: np.ndarray, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """(string, common prefix with the string before) of a front-coded run, one at a time."""
    at, last = 0, b""
    for k, n in zip(lcp.tolist(), sizes.tolist(), strict=True):
        e = at + n - k
        last = last[:k] + rest[at:e]
        at = e
        yield last, k


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the string before, string) in sorted order.

    ``runs`` give sorted strings with their common prefixes.  Each node of the tree
    keeps the loser and its common prefix with the string that won there.  With the
    last winner as the common reference, of two challengers the one with the
    longer common prefix is the smaller; only equal prefixes compare bytes, from there on.
    """
    k = 1
    while k < max(1, len(runs)):
        k *= 2
    end = (None, 0)
    runs = [*runs, *[iter(())] * (k - len(runs))]
    string = [next(r, end)[0] for r in runs]
    prefix = [0] * k

    def beats(a: int, b: int) -> bool:
        """True if run a's head is the smaller; the loser's prefix becomes that with the winner."""
        x, y = string[a], string[b]
        if y is None:
            return True
        if x is None:
            return False
        if prefix[a] != prefix[b]:
            return prefix[a] > prefix[b]
        c = common_prefix(x, y, prefix[a])
        less = (x[c : c + 1], a) < (y[c : c + 1], b)
        prefix[b if less else a] = c
        return less

    loser = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        a, b = (a, b) if beats(a, b) else (b, a)
        loser[node] = b
        return a

    win = build(1) if k > 1 else 0
    while string[win] is not None:
        yield win, prefix[win], string[win]
        string[win], prefix[win] = next(runs[win], end)
        node = (win + k) // 2
        while node:
            if not beats(win, loser[node]):
                win, loser[node] = loser[node], win
            node //= 2


# --------------------------------------------------------------------------
# 4. windows of the merged order
# --------------------------------------------------------------------------
def repeated_windows(g: np.ndarray, lcp: np.ndarray, before: np.ndarray, off: np.ndarray, n: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """bool (block x offset): is the window that starts ``o`` before the anchor a repeat?

    Rows are in suffix order.  ``before`` (block x width) has the bytes before the
    anchor, nearest first; ``rank`` orders the blocks by document and start, and blocks of one place, which
    rows that repeat a doc_id bring, have the same rank.
    """
    most = int(off.max(initial=0)) + 1
    out = np.zeros((len(g), most), bool)
    back = np.zeros(len(g), np.uint64)
    power, base = np.uint64(1), np.uint64(common._BASE)
    fresh = np.ones(len(g), bool)
    fresh[1:] = g[1:] != g[:-1]
    for o in range(most):
        if o:
            back = back + common._WEIGHT[before[:, o - 1]] * power
            power = np.uint64(int(power) * int(base) % (1 << 64))
        at = np.flatnonzero((o <= off) & (o > off - n))
        if len(at) < 2:
            continue
        group = np.cumsum(fresh | (lcp < length - o)).astype(np.uint64)[at]
        key = common.mix(common.mix(back[at]) + group)
        order = np.lexsort((rank[at], key))
        new = np.ones(len(order), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rows, first, r = at[order], at[order][lead], rank[at][order]
        later = np.flatnonzero(r > r[lead])
        same = (before[rows[later], :o] == before[first[later], :o]).all(axis=1)
        out[rows[later[same]], o] = True
    return out


# --------------------------------------------------------------------------
# the operator
# --------------------------------------------------------------------------
def _runs(found: DataFrame, docs: DataFrame, length: int, width: int, parts: int) -> DataFrame:
    """Sorted, front-coded runs (bucket, run) of the blocks' suffixes, and repeats (doc_id, start, end) within a run."""
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("g", "lo", "off", "n")).alias("x"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(per_doc, "doc_id").select("doc_id", "text", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[_Spans] = []
        size = 0
        for batch in batches:
            for part in common.slices(batch):
                data, offs = common.flat(part.column(1))
                lists = part.column(2)
                at = np.asarray(lists.offsets)
                g, lo, off, n = (np.asarray(lists.values.field(k))[at[0] : at[-1]] for k in range(4))
                doc = np.repeat(np.asarray(part.column(0)), np.diff(at))
                begin = np.repeat(offs[:-1], np.diff(at)) + lo
                # a row that repeats another's doc_id may be shorter than its blocks
                fits = np.flatnonzero(begin + n + length - 1 <= np.repeat(offs[1:], np.diff(at)))
                for some in np.array_split(fits, -(-len(fits) // 4096) or 1):
                    held.append(_Spans(data, *(v[some] for v in (begin, g, doc, lo, off, n)), length, width))
                    size += held[-1].rows.nbytes
                if size > RUN_BYTES:
                    yield from _flush(held, parts, length, width)
                    held, size = [], 0
        if held:
            yield from _flush(held, parts, length, width)

    common.small_batches(docs.sparkSession)
    return rows.mapInArrow(run, "bucket long, run binary, doc_id long, start long, end long")


class _Spans:
    """Blocks as rows of bytes that sort as they should: hash of the k-gram, suffix, its size, bytes before the anchor and their number."""

    def __init__(self, data: np.ndarray, begin, g, doc, lo, off, n, length: int, width: int):
        self.g, self.doc, self.lo, self.off, self.n = g, doc, lo, off, n
        self.size = 8 + n + length - 1 - off
        k, longest, last = len(g), length + width - 1, max(0, len(data) - 1)
        self.rows = np.zeros((k, 8 + longest + 2 + width + 2), np.uint8)
        if not k:
            return
        self.rows[:, :8] = g.view(np.uint64).byteswap().view(np.uint8).reshape(k, 8)
        at = np.arange(longest, dtype=np.int32)
        anchor = (begin + off).astype(np.int64)[:, None]
        self.rows[:, 8 : 8 + longest] = np.where(at < (self.size - 8)[:, None], data[np.minimum(anchor + at, last)], 0)
        self.rows[:, 8 + longest : 10 + longest] = self.size.astype(">u2").view(np.uint8).reshape(k, 2)
        at = at[:width]
        self.rows[:, 10 + longest : 10 + longest + width] = np.where(at < off[:, None], data[np.maximum(anchor - 1 - at, 0)], 0)
        self.rows[:, -2:] = off.astype(">u2").view(np.uint8).reshape(k, 2)


def _flush(held: list[_Spans], parts: int, length: int, width: int) -> Iterator[pa.RecordBatch]:
    rows, g, doc, lo, off, n, size = (np.concatenate([getattr(h, k) for h in held]) for k in ("rows", "g", "doc", "lo", "off", "n", "size"))
    if not len(g):
        return
    longest = 8 + length + width - 1
    # the k-gram's hash stands for its bytes: its range splits evenly, and equal k-grams stay together
    order = np.lexsort((lo, doc))
    order = order[np.argsort(rows[order].view(f"S{rows.shape[1]}").ravel(), kind="stable")]
    rows, g, doc, lo, off, n, size = (v[order] for v in (rows, g, doc, lo, off, n, size))
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1))
    lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = np.flatnonzero(~new & ((doc != doc[lead]) | (lo != lo[lead])))
    cols = ["bucket", "run", "doc_id", "start", "end"]
    if len(again):
        s = lo[again].astype(np.int64)
        yield pa.record_batch([pa.nulls(len(again), pa.int64()), pa.nulls(len(again), pa.binary()), pa.array(doc[again].astype(np.int64)), pa.array(s), pa.array(s + n[again] + length - 1)], names=cols)
    rows, g, doc, lo, off, n, size = (v[new] for v in (rows, g, doc, lo, off, n, size))
    bucket = ((g.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    apart = rows[1:, :longest] != rows[:-1, :longest]
    lcp = np.append(0, np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), longest), np.minimum(size[1:], size[:-1])))
    lcp[edge[:-1]] = 0
    at = np.arange(longest)
    runs = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        rest = rows[a:b, :longest][(at >= lcp[a:b, None]) & (at < size[a:b, None])]
        heads = rows[a:b, longest + 2 : longest + 2 + width][at[:width] < off[a:b, None]]
        cut = [lcp.astype(np.int16), size.astype(np.int16), doc.astype(np.int64), lo.astype(np.int32), off.astype(np.int16), n.astype(np.int16)]
        runs.append(zlib.compress(b"".join([np.int64(b - a).tobytes(), *(v[a:b].tobytes() for v in cut), rest.tobytes(), heads.tobytes()]), 1))
    none = pa.nulls(len(runs), pa.int64())
    yield pa.record_batch([pa.array(bucket[edge[:-1]]), pa.array(runs, pa.binary()), none, none, none], names=cols)


class _Run:
    """A run as it was packed: columns, bytes before the anchors, and strings one at a time."""

    def __init__(self, blob: bytes):
        raw = zlib.decompress(blob)
        k = int(np.frombuffer(raw, np.int64, 1)[0])
        at, cols = 8, []
        for kind in (np.int16, np.int16, np.int64, np.int32, np.int16, np.int16):
            cols.append(np.frombuffer(raw, kind, k, at))
            at += k * np.dtype(kind).itemsize
        lcp, size, self.doc, self.lo, self.off, self.n = cols
        tail = int((size.astype(np.int64) - lcp).sum())
        self.strings = front_decode(lcp, size, raw[at : at + tail])
        self.heads = np.frombuffer(raw, np.uint8, offset=at + tail)
        self.head_at = np.concatenate([[0], np.cumsum(self.off, dtype=np.int64)])


#: Merged blocks that are looked at together; a k-gram with more has all of its blocks at once.
AT_ONCE = 16_384


def _merge(length: int):
    """(doc_id, start, end) of the removed stretches of one bucket."""
    kind = [("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]

    def found(runs: list[_Run], which: list[int], place: list[int], lcp: list[int]) -> pa.Table:
        which, place, lcp = np.array(which), np.array(place), np.array(lcp) - 8
        doc, lo, off, n = (np.zeros(len(which), np.int64) for _ in range(4))
        heads: list = [None] * len(which)
        for r in np.unique(which).tolist():
            at, run = np.flatnonzero(which == r), runs[r]
            i = place[at]
            doc[at], lo[at], off[at], n[at] = run.doc[i], run.lo[i], run.off[i], run.n[i]
            for a, k in zip(at.tolist(), i.tolist(), strict=True):
                heads[a] = run.heads[run.head_at[k] : run.head_at[k + 1]]
        width = int(off.max(initial=0))
        before = np.zeros((len(which), width), np.uint8)
        before[np.arange(width) < off[:, None]] = np.concatenate(heads) if width else 0
        anchor = lo + off
        order = np.lexsort((anchor, doc))
        rank = np.empty(len(which), np.int64)
        rank[order] = np.cumsum(np.append(True, (np.diff(doc[order]) != 0) | (np.diff(anchor[order]) != 0)))
        hit = repeated_windows(np.cumsum(lcp < 0), lcp, before, off, n, rank, length)
        i, o = np.nonzero(hit)
        start = anchor[i] - o
        order = np.lexsort((start, doc[i]))
        d, s = doc[i][order], start[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(d)) - 1 if len(d) else first
        return pa.table([d[first], s[first], s[last] + length], schema=pa.schema(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [_Run(b.as_py()) for batch in batches for b in batch.column("run")]
        seen, held = [0] * len(runs), ([], [], [])
        for r, k, _ in merge_runs([x.strings for x in runs]):
            if k < 8 and len(held[0]) >= AT_ONCE:
                yield from found(runs, *held).to_batches()
                held = ([], [], [])
            for h, v in zip(held, (r, seen[r], k), strict=True):
                h.append(v)
            seen[r] += 1
        if held[0]:
            yield from found(runs, *held).to_batches()

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY) -> DataFrame:
    """(doc_id, start, end): byte stretches, which may overlap, of repeats in ``docs`` (doc_id, text).

    ``many`` bounds the different blocks of one key in a task; it changes no byte that is covered.
    """
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    staged = repeated_blocks(docs, length, gram, many)
    found = functools.reduce(DataFrame.unionByName, staged)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // 100_000))
    runs = common.stage(_runs(found, docs, length, length - gram + 1, parts), "runs", codec="uncompressed")
    for x in staged:
        common.unstage(x)
    merged = runs.where("bucket is not null").select("bucket", "run").repartition(parts, "bucket").groupBy("bucket").applyInArrow(_merge(length), "doc_id long, start long, end long")
    return runs.where("bucket is null").select("doc_id", "start", "end").unionByName(merged)


def kept_bytes(docs: DataFrame, keep: list[str], length: int = LENGTH, gram: int = GRAM, text: str = "", many: int = MANY) -> DataFrame:
    """Columns ``keep`` with n_bytes, n_removed, n_spans and kept (binary): ``docs`` without repeats.

    Matches never cross rows.  Null texts count as empty and texts under ``length``
    bytes stay whole.  Rows without a doc_id stay whole and repeat nothing.  With ``text``, kept is
    a string column of that name instead, without the parts of characters that a cut leaves.
    Rows that share a doc_id are one document: what starts at the same place of both is no repeat, so a repeated
    row stays whole, and the union of their removals applies to each, cut to its length.  An
    empty table gives no rows; a kept column named like an added one gives way to it.
    """
    spans = repeated_spans(docs, length, gram, many)
    per_doc = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_x")).withColumnRenamed("doc_id", "_id")
    added = ["n_bytes", "n_removed", "n_spans", text or "kept"]
    keep = [c for c in keep if c not in added]
    src = docs.select(*keep, F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_t"))
    rows = src.join(per_doc, src["_d"] == per_doc["_id"], "left").select(*keep, "_t", "_x")
    schema = rows.select(*keep, *(F.lit(0).cast("long").alias(c) for c in added[:3]), F.lit("" if text else b"").alias(added[3])).schema

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, offs = common.flat(part.column("_t"))
        x = part.column("_x")
        at, s, e = np.asarray(x.offsets), np.asarray(x.values.field(0)), np.asarray(x.values.field(1))
        nb, nr, ns, kept = [], [], [], []
        for i in range(part.num_rows):
            own = data[offs[i] : offs[i + 1]]
            mark = np.zeros(len(own) + 1, np.int32)
            a, b = s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]
            if len(a):
                np.add.at(mark, np.minimum(a, len(own)), 1)
                np.add.at(mark, np.minimum(b, len(own)), -1)
            gone = np.cumsum(mark[:-1]) > 0
            nb.append(len(own))
            nr.append(int(gone.sum()))
            ns.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(own) else 0)
            left = own[~gone].tobytes()
            kept.append(left.decode("utf-8", "ignore") if text else left)
        return pa.record_batch([*[part.column(c) for c in keep], pa.array(nb, pa.int64()), pa.array(nr, pa.int64()), pa.array(ns, pa.int64()), pa.array(kept, pa.string() if text else pa.binary())], names=[*keep, *added])

    return common.map_arrow(rows, run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` without byte strings of 100 that start earlier."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = kept_bytes(docs, ["doc_id"])
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
