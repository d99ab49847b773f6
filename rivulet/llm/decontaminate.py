"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on hashed seeds of shared tokens.  Each
candidate pair is then tiled: the longest common runs of unmarked tokens, found
with running Karp-Rabin hashes, are marked first and never overlap.  The share
of an item's tokens under tiles is its coverage, so passages whose parts were
put in another order are found too.

The seeds of the benchmark are held against the documents inside one narrow
pass when a count shows that they are few; otherwise all seeds are joined.
Texts move only for candidate documents.  Seeds only name candidates; tiles are runs of tokens
that are equal themselves.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_TILE = 5
COVERAGE = 0.5
SEED_LIMIT = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _tokens(*cols: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the tokens, offsets by row) of each column: one number for each token in all of them, spread over 64 bits."""
    return [(common.mix(code.astype(np.uint64)), at) for code, at in common.distinct_words([pc.utf8_lower(c) for c in cols], common.PLAIN)[1]]


def _seeds(col: pa.Array, sizes: tuple[int, ...], secret: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    wh, at = common.word_hashes(pc.utf8_lower(col), common.PLAIN, secret)
    return [common.shingle_hashes(wh, at, n) for n in sizes]


def _seed_rows(df: DataFrame, key: str, sizes: tuple[int, ...], secret: bytes, matter: np.ndarray | None = None) -> DataFrame:
    """(key, seed) of each text, distinct within the text; ``matter``: the sorted seeds that matter, sent to each executor once."""
    shared = None if matter is None else df.sparkSession.sparkContext.broadcast(matter)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows, seeds, only = [], [], None if shared is None else shared.value
        for h, at in _seeds(part.column(1), sizes, secret):
            r = np.repeat(np.arange(part.num_rows), np.diff(at))
            if only is not None:
                hit = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h if len(only) else np.zeros(len(h), bool)
                r, h = r[hit], h[hit]
            rows.append(r)
            seeds.append(h)
        both = np.unique(np.rec.fromarrays([np.concatenate(rows), np.concatenate(seeds)]))
        return pa.record_batch({key: part.column(0).take(pa.array(both.f0)), "seed": both.f1.view(np.int64)})

    return common.map_arrow(df.select(F.col(key).cast("long").alias(key), "text"), run, f"{key} long, seed long")


def tile(item: np.ndarray, text: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first, of at least ``least`` tokens.

    The search length falls from pass to pass.  A pass finds all unmarked matches of at least its length and takes
    them from a queue, longest first; one that a tile covers in part goes back as its free
    pieces, each at its own length.  Of equally long matches the one with the smaller starts is marked first.
    """
    free_i, free_t = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles, s = [], least
    while s * 4 <= min(len(item), len(text)):
        s *= 4
    while s >= least:
        queue = _matches(item, text, free_i, free_t, s)
        heapq.heapify(queue)
        while queue:
            k, i, t = heapq.heappop(queue)
            free = free_i[i : i - k] & free_t[t : t - k]
            if free.all():
                free_i[i : i - k] = free_t[t : t - k] = False
                tiles.append((i, t, -k))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], free, [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= s:
                    heapq.heappush(queue, (a - b, i + a, t + a))
        s = s // 4
    return tiles


def _matches(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal unmarked matches (-length, starts) of at least ``s`` tokens, by running hashes of length ``s``."""
    hi, ht = _rolling(item, s), _rolling(text, s)
    open_i, open_t = _open(free_i, s), _open(free_t, s)
    places: dict[int, list[int]] = {}
    for i in np.flatnonzero(open_i):
        places.setdefault(int(hi[i]), []).append(int(i))
    cand = np.flatnonzero(open_t)
    if not places or not len(cand):
        return []
    cand = cand[np.isin(ht[cand], np.fromiter(places, np.uint64, len(places)))]
    out = []
    for t in map(int, cand):
        for i in places[int(ht[t])]:
            if i and t and free_i[i - 1] and free_t[t - 1] and item[i - 1] == text[t - 1]:
                continue  # part of the match that starts one token before
            k = 0
            while i + k < len(item) and t + k < len(text) and free_i[i + k] and free_t[t + k] and item[i + k] == text[t + k]:
                k += 1
            if k >= s:
                out.append((-k, i, t))
    return out


def _rolling(x: np.ndarray, s: int) -> np.ndarray:
    if len(x) < s:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(x) - s + 1, np.uint64)
    # doubling: the hash of s tokens from hashes of powers of two
    power, width, done, at = x.astype(np.uint64), 1, 0, h
    mult = {1: _MULT}
    while width <= s:
        if s & width:
            at = at * mult[width] + power[done : done + len(h)]
            done += width
        if width * 2 <= s:
            m = mult[width]
            power = power[: len(power) - width] * m + power[width:]
        with np.errstate(over="ignore"):
            mult[width * 2] = mult[width] * mult[width]
        width *= 2
    return at


def _open(free: np.ndarray, s: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(free)])
    return c[s:] - c[:-s] == s if len(free) >= s else np.zeros(0, bool)


def coverage(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, seed_limit: int = SEED_LIMIT) -> DataFrame:
    """(doc_id, item_id, coverage) of every document and item that share a tile.

    ``docs`` (doc_id, text), ``benchmark`` (item_id, text).  Tokens are lower-cased
    runs of letters, digits and underscores.  An item shorter than ``least`` tokens is one seed as a whole; items
    and texts without tokens match nothing.  Items of the same text count
    as the one with the smallest id.  Rows with a null id or text take no part.  Repeated doc_ids give the
    highest coverage of their rows.
    """
    items = benchmark.where("item_id is not null and text is not null").groupBy("text").agg(F.min("item_id").cast("long").alias("item_id"))
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes, secret = tuple(range(1, least + 1)), common.word_key()
    seeds = common.stage(_seed_rows(items, "item_id", (least,), secret), "seeds")
    distinct = seeds.select("seed").distinct()
    only = None
    if common.fits_broadcast(distinct, seed_limit):
        only = np.sort(distinct.toPandas()["seed"].to_numpy(np.int64).view(np.uint64))
    lens = sorted({least, *_short_lengths(items, sizes)})
    pairs = common.stage(_seed_rows(docs, "doc_id", tuple(lens), secret, only).join(seeds, "seed").select("doc_id", "item_id").distinct(), "pairs")
    texts = common.semi_by_id(docs, pairs.select("doc_id").distinct(), "doc_id").withColumnRenamed("text", "doc_text")
    rows = pairs.join(texts, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        (a, x), (b, y) = _tokens(part.column(2), part.column(3))
        got = []
        for k in range(part.num_rows):
            item, text = a[x[k] : x[k + 1]], b[y[k] : y[k + 1]]
            tiles = tile(item, text, min(least, max(1, len(item))))
            got.append(sum(t[2] for t in tiles) / len(item) if len(item) else 0.0)
        return pa.record_batch([part.column(0), part.column(1), pa.array(got, pa.float64())], names=["doc_id", "item_id", "coverage"])

    done = common.map_arrow(rows.select("doc_id", "item_id", "item_text", "doc_text"), run, "doc_id long, item_id long, coverage double")
    return done.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage")).where("coverage > 0")


def _short_lengths(items: DataFrame, sizes: tuple[int, ...]) -> list[int]:
    """Token counts below the tile length that occur among the items: at most a handful of numbers."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        n = np.unique(np.diff(_tokens(part.column(0))[0][1]))
        return pa.record_batch({"n": n[(n > 0) & (n < sizes[-1])].astype(np.int64)})

    return [r.n for r in common.map_arrow(items.select("text"), run, "n long").distinct().collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, item_id and coverage of the best item, n_items at the threshold."""
    found = coverage(docs, benchmark, least)
    best = found.groupBy("doc_id").agg(F.max(F.struct("coverage", (-F.col("item_id")).alias("m"))).alias("x"), F.count_if(F.col("coverage") >= threshold).alias("n_items"))
    best = best.select("doc_id", F.col("x.coverage").alias("coverage"), (-F.col("x.m")).alias("item_id"), "n_items")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    out = ids.join(best, "doc_id", "left")
    return out.select("doc_id", (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def op1_greedy_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` held against all of ``benchmark``."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
