"""Exact Jaccard similarity join on word n-grams, with its components.

Prefix filtering: two sets that are similar enough must share a token among the
first few of both under one global order.  Prefixes are extended, and the index
holds single tokens for rare classes and combinations of k tokens for frequent
ones, k growing with the frequency; candidates are then verified on whole texts.

Tokens are ordered by frequency, rare ones first.  Let a set of n tokens share
``a`` of them at least with a similar one of m.  The first shared token has a place of
at most ``n - a + 1`` in both.  If it is rare, the single index finds the pair.  If
not, all shared tokens are frequent, and the first two of them have places of at most ``n - a + 1``
and ``n - a + 2``: small sets are indexed by any two tokens at such places.  For large sets
these would be many.  But at most ``n + m - 2a`` others lie between the shared tokens, so that among the first ``(n + m - 2a + 1)(k - 1) + 1`` shared ones some k stand
side by side in both orders: the index of k neighbours finds the pair, with
prefixes that are longer by as much and as many entries as the prefix has tokens.

How groups stay small:

* equal sets are one class before anything is joined;
* each class is first linked with a few leaders of its min-hash buckets (stars,
  never all pairs) and verified; the components of these links
  count as one when token frequencies are taken, so the tokens of a large group
  of near copies are rare;
* a class with enough tokens of its own component among its least ones shares
  none of these with other classes of the kind, so it needs no index entry; only
  the weak rest reads its whole token sets again, and is indexed;
* a set with more rare tokens than similar ones may lack has no frequent entry,
  and entries carry how many tokens can still be shared, which joins check.

Words are known by 64-bit digests and sets by digests of 128 bits, under a key that is drawn for each
run, so that nobody can build words or sets of one digest.  A token's class depends on the token alone, and links are
only ever accepted by comparing whole sets word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Tokens found in this many components are indexed with their neighbours: k grows by one each time their number grows eightfold.
FREQUENT, GROWTH, MOST_K = 8, 8, 4
#: Pairs whose smaller set has at most so many tokens meet by any two tokens of their prefixes, larger ones by k neighbours.
SMALL = 160
#: Min-hash bands that name the buckets of the first links, values in each, and leaders of a bucket.
BANDS, BAND_VALUES, LEADERS = 5, 4, 8
#: Tokens of one component beyond those that a similar set may lack.
SLACK = 4
#: Parity bits of sets that meet their leaders, and of sets that are indexed.
NARROW, WIDE = 256, 1024
ID_LIMIT = 1_000_000


def _sets(texts: pa.Array, n: int, key: bytes) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    h, at = common.shingle_hashes(*common.word_hashes(texts, key=key), n)
    return _distinct(h.view(np.int64), at)


def _word_sets(n: int, *cols: pa.Array) -> list[list[np.ndarray]]:
    """The same of each column with numbers that only equal shingles share, in all columns."""
    codes = common.distinct_words(list(cols))[1]
    code, offs = np.concatenate([c for c, _ in codes]), [np.zeros(1, np.int64)]
    for _, at in codes:
        offs.append(at[1:] + offs[-1][-1])
    sets, lo, out = _distinct(*common.shingle_numbers(code, np.concatenate(offs), n)), 0, []
    for c in cols:
        out.append(sets[lo : lo + len(c)])
        lo += len(c)
    return out


def _distinct(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        s = np.sort(h[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])] if b > a else s)
    return out


_TURN = np.random.default_rng(11).integers(1, 1 << 63, BANDS * BAND_VALUES, np.uint64) | np.uint64(1)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """One number per set and band: a hash of the least values of the set under ``BAND_VALUES`` multipliers."""
    size = np.array([len(s) for s in sets], np.int64)
    some = np.flatnonzero(size)
    low = np.zeros((len(_TURN), len(sets)), np.uint64)
    if len(some):
        flat = np.concatenate(sets).view(np.uint64)
        first = (np.cumsum(size) - size)[some]
        for k, t in enumerate(_TURN):
            low[k, some] = np.minimum.reduceat(flat * t, first)
    h = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(sets), axis=1)
    for k in range(BAND_VALUES):
        h = common.mix(h + low[k::BAND_VALUES])
    return h.T.view(np.int64)


def _bits(sets: list[np.ndarray], width: int) -> np.ndarray:
    """``width`` bits per set: the parity of its tokens by hash.  Two sets differ in as many tokens as bits at least."""
    out = np.zeros((len(sets), width), np.uint8)
    for i, s in enumerate(sets):
        out[i] = np.bincount((common.mix(s.view(np.uint64) ^ np.uint64(BANDS)) >> np.uint64(65 - width.bit_length())).astype(np.int64), minlength=width) & 1
    return np.packbits(out, axis=1).view(np.int64)


def _near(num: int, den: int, width: int) -> Column:
    """Over n_sh and bits, and the same with a 2 at their ends: the bits allow for the threshold."""
    apart = [F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(width // 64)]
    return F.lit(den + num) * sum(apart[1:], apart[0]) <= F.lit(den - num) * (F.col("n_sh") + F.col("n_sh2"))


def _node(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def spare(n: np.ndarray | int, num: int, den: int):
    """Most tokens of a set of ``n`` that a similar set can lack."""
    return n - -(-num * n // den)


def _spare(n: Column, num: int, den: int) -> Column:
    return n - F.ceil(F.lit(num) * n / F.lit(den)).cast("long")


def token_sets(docs: DataFrame, n: int, num: int, den: int, key: bytes, whole: bool = False) -> DataFrame:
    """(doc_id, node, n_sh, bands, bits, toks): node identifies the set under ``key``; toks are its least hashes, all of them if ``whole``."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = _sets(part.column(1), n, key)
        size = np.array([len(s) for s in sets], np.int64)
        most = size if whole else np.minimum(size, (spare(size, num, den) + 1) * 3 // 2 + 8)
        toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(most)]).astype(np.int32)), pa.array(np.concatenate([s[:m] for s, m in zip(sets, most, strict=True)])))
        bands = pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(_bands(sets)).ravel()), BANDS).cast(pa.list_(pa.int64()))
        width = WIDE if whole else NARROW
        bits = pa.FixedSizeListArray.from_arrays(pa.array(_bits(sets, width).ravel()), width // 64).cast(pa.list_(pa.int64()))
        return pa.record_batch({"doc_id": part.column(0), "node": pa.array([_node(s) for s in sets], pa.binary()), "n_sh": size, "bands": bands, "bits": bits, "toks": toks})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, node binary, n_sh long, bands array<long>, bits array<long>, toks array<long>")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, num: int, den: int, key: bytes, repeated: bool) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold; texts are read for their classes only.

    Sets are compared by their words.  Only with ``repeated`` ids, which bring other texts along, does the digest under ``key`` tell which text is
    meant.  A class with many pairs has one row for each in the join by ``a``, which Spark's adaptive execution splits.
    """
    pairs = common.stage(pairs.select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
    ids = common.stage(classes.join(nodes, "nid", "left_semi").select("nid", "node", F.col("rep").alias("doc_id")), "nodes")
    right = F.broadcast(ids) if common.fits_broadcast(ids, ID_LIMIT) else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(right, "doc_id")
    end = lambda k: texts.select(F.col("nid").alias(k), F.col("node").alias(f"n{k}"), F.col("text").alias(f"t{k}"))
    both = pairs.join(end("b"), "b").join(end("a"), "a")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, first, at = np.unique(np.asarray(part.column(0)), return_index=True, return_inverse=True)
        rows, keep = np.arange(part.num_rows), []
        if repeated:  # an id that repeats with other texts brings sets of other classes
            mine = [[_node(x) == name for x, name in zip(_sets(part.column(c), n, key), part.column(c - 1).to_pylist(), strict=True)] for c in (3, 5)]
            rows, first, at = rows[np.logical_and(*mine)], rows, rows
        # rows of one class stand together, and its set is made once
        left, right = _word_sets(n, part.column(3).take(pa.array(first)), part.column(5))
        for i in rows.tolist():
            x, y = left[at[i]], right[i]
            same = len(np.intersect1d(x, y, assume_unique=True))
            if den * same >= num * (len(x) + len(y) - same):
                keep.append(i)
        kept = pa.array(keep, pa.int64())
        return pa.record_batch({"a": part.column(0).take(kept), "b": part.column(1).take(kept)})

    return common.stage(common.map_arrow(both.select("a", "b", "na", "ta", "nb", "tb"), run, "a long, b long").distinct(), "links")


def similarity_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Sets are linked when ``den * intersection >= num * union``; component_id is the
    smallest doc_id that links reach.  Null and empty texts have no shingles and
    stand alone; a text of fewer than ``n`` words has its whole sequence as its
    one shingle.  Rows without a doc_id get a null component and link with
    nothing.  Rows that repeat a doc_id count as linked.  Further columns are not
    looked at.  An empty table gives no rows.
    """
    return row_components(docs, n, num, den).select("doc_id", "n_shingles", "component_id")


def row_components(docs: DataFrame, n: int, num: int, den: int, by_id: bool = True, key: bytes | None = None) -> DataFrame:
    """doc_id, n_shingles, node, comp and component_id of each row; comp is null where the row stands alone.

    Rows that repeat a doc_id count as linked only if ``by_id``.  ``key`` is that of the nodes; without one it is drawn.
    """
    key = key or common.word_key()
    made = common.stage(token_sets(docs, n, num, den, key), "tokens")
    t1 = common.stage(made.select("doc_id", "node", "n_sh"), "rows")
    rows = t1.where("n_sh > 0 and doc_id is not null").select("doc_id", "node", "n_sh")
    repeated = bool(rows.groupBy("doc_id").agg((F.min("node") != F.max("node")).alias("x")).where("x").head(1))
    # small numbers stand for sets from here on; staged, they stay the same
    classes = common.stage(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_sh").alias("n_sh")).withColumn("nid", F.monotonically_increasing_id()), "classes")
    chosen = made.where("n_sh > 0").join(classes.select("node", F.col("rep").alias("doc_id"), "nid"), ["doc_id", "node"])
    chosen = common.stage(chosen.dropDuplicates(["doc_id", "node"]).select("nid", F.col("n_sh").cast("int").alias("n_sh"), "bands", "bits", "toks"), "sets")
    common.unstage(made)

    # stars: every member of a bucket meets its few leaders; other ones lead in each band
    band = chosen.where("n_sh > 1").select("nid", "n_sh", "bits", F.posexplode("bands").alias("b", "key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("nid", "b"), "nid"))
    lead = band.withColumn("at", place).where(F.col("at") <= LEADERS).select("key", *[F.col(c).alias(f"{c}2") for c in ("nid", "n_sh", "bits")])
    fits = F.lit(den) * F.least("n_sh", "n_sh2") >= F.lit(num) * F.greatest("n_sh", "n_sh2")
    stars = band.join(lead, "key").where((F.col("nid") != F.col("nid2")) & fits & _near(num, den, NARROW)).select(F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b"))
    links = verified(stars, classes, docs, n, num, den, key, repeated)
    linked = common.stage(common.connected_components(links).select(F.col("node").alias("nid"), "component"), "linked")
    firsts = chosen.join(linked, "nid", "left").select("nid", F.coalesce("component", "nid").alias("cid"), "n_sh", "toks")

    # tokens of several components among the least ones of each set
    tok = firsts.select("nid", "cid", F.explode("toks").alias("token"))
    mixed = tok.groupBy("token").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
    mixed = common.stage(mixed.select("token", "rows"), "mixed")
    shared = common.stage(common.matched(tok.select("nid", "token"), mixed, "token").select("nid", "token"), "shared")
    lacks = shared.groupBy("nid").agg(F.count("*").alias("s"))
    size = firsts.select("nid", "cid", "n_sh", F.size("toks").alias("m")).join(lacks, "nid")
    # a set of one token has no similar set but itself
    weak = common.stage(size.where((F.col("m") - F.col("s") < _spare(F.col("n_sh"), num, den) + 1) & (F.col("n_sh") > 1)).select("nid", "cid", "n_sh"), "weak")
    more = []
    if not weak.isEmpty():
        more.append(verified(_candidates(docs, classes, weak, shared, firsts, n, num, den, key), classes, docs, n, num, den, key, repeated))
    named = rows.join(classes.select("node", "nid"), "node")
    if by_id and repeated:
        several = named.groupBy("doc_id").agg(F.min("nid").alias("a"), F.max("nid").alias("z")).where("a <> z").select("doc_id", "a")
        more.append(common.stage(named.join(several, "doc_id").where("a <> nid").select("a", F.col("nid").alias("b")).distinct(), "id-links"))
    more = [x for x in more if not x.isEmpty()]
    if more:
        for x in more:
            links = links.unionByName(x)
        linked = common.connected_components(links).select(F.col("node").alias("nid"), "component")
    comps = classes.join(linked, "nid", "left").select("node", "rep", F.coalesce("component", "nid").alias("comp"))
    least = comps.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_node = comps.select("node", "comp").join(least, "comp").select("node", "comp", "component_id")
    out = t1.select("doc_id", "n_sh", F.when(F.col("doc_id").isNotNull() & (F.col("n_sh") > 0), F.col("node")).alias("node"))
    if by_id:
        # a row without shingles goes with the others of its doc_id
        bare = t1.where("n_sh = 0 and doc_id is not null").select("doc_id").distinct()
        other = common.stage(rows.join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("node").alias("other")), "bare")
        if not other.isEmpty():
            out = out.join(other, "doc_id", "left").select("doc_id", "n_sh", F.coalesce("node", "other").alias("node"))
    out = out.join(of_node, "node", "left")
    return out.select("doc_id", F.col("n_sh").alias("n_shingles"), "node", "comp", F.coalesce("component_id", "doc_id").alias("component_id"))


def longest_k(num: int, den: int) -> int:
    """Most neighbours that two similar sets surely share: k with (d + 1)(k - 1) + 1 <= d * num / (den - num) for every d >= 1."""
    return max(1, min(MOST_K, den // (2 * (den - num)))) if num < den else 1


def index_entries(n: int, tokens: np.ndarray, counts: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """(key, most tokens that may still be shared) of a set of ``n``.

    ``tokens`` are those of several components, in order, and ``counts`` their numbers of components.
    """
    alone, lacked, most_k = n - len(tokens), spare(n, num, den), longest_k(num, den)
    rare, u = int(np.searchsorted(counts, FREQUENT)), tokens.view(np.uint64)
    singles = max(0, min(rare, lacked + 1 - alone))
    keys = common.mix(u[:singles] ^ np.uint64(1)).view(np.int64).tolist()
    out = [(k, n - alone - i) for i, k in enumerate(keys)]
    if alone + rare > lacked or rare == len(tokens):
        return out
    if n * num <= SMALL * den and most_k > 1:
        # the first two shared tokens, at their places in the prefix
        at = np.arange(rare, min(len(tokens), lacked + 2 - alone))
        i, j = (at[x] for x in np.triu_indices(len(at), 1))
        key = common.mix(common.mix(np.uint64(2) + u[i]) + u[j])
        free = np.minimum(n - alone - i, n - alone - j + 1)
        out += zip(key.view(np.int64).tolist(), free.tolist(), strict=True)
    if n <= SMALL and most_k > 1:
        return out
    # others of the largest similar set lie between the shared tokens
    between = den * n // num - n
    last = min(len(tokens), lacked + (between + 1) * (most_k - 1) + 1 - alone)
    k = np.ones(last - rare, np.int64)
    for j in range(1, most_k):
        k += counts[rare:last] >= FREQUENT * GROWTH ** (j - 1)
    for size in np.unique(k).tolist():
        at = rare + np.flatnonzero(k == size)
        at = at[at + size <= len(tokens)]
        h = np.full(len(at), size + 2, np.uint64)
        for j in range(size):
            h = common.mix(h + u[at + j])
        free = n - alone - at if size == 1 else np.full(len(at), n - alone - rare)
        out += zip(h.view(np.int64).tolist(), free.tolist(), strict=True)
    return out


def _candidates(docs: DataFrame, classes: DataFrame, weak: DataFrame, shared: DataFrame, firsts: DataFrame, n: int, num: int, den: int, key: bytes) -> DataFrame:
    """Pairs of different components that may be similar, for the sets whose known tokens don't settle it.

    Weak sets meet each other by their own token frequencies, which are exact, and the
    others by those sets' tokens of one component: a similar set lacks at most
    ``spare`` of them, so all but that many must match.
    """
    named = weak.join(classes.select("nid", "node", F.col("rep").alias("doc_id")), "nid")
    again = common.semi_by_id(docs.select("doc_id", "text"), named.select("doc_id"), "doc_id", ID_LIMIT)
    full = token_sets(again, n, num, den, key, whole=True).select("node", "bits", "toks").join(named.select("node", "nid", "cid", "n_sh"), "node")
    full = common.stage(full.dropDuplicates(["node"]).select("nid", "cid", "n_sh", "bits", "toks"), "weak-sets")
    toks = full.select("nid", "cid", F.explode("toks").alias("token"))
    counts = toks.groupBy("token", "cid").agg(F.count("*").alias("rows")).groupBy("token").agg(F.count("*").alias("c"), F.sum("rows").alias("rows"))
    counts = common.stage(counts.where("c > 1"), "counts")
    met = common.matched(toks, counts, "token").groupBy("nid").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("x"))
    # a set with more tokens of its own than a similar one may lack meets no other
    met = full.select("nid", "cid", "n_sh").join(met, "nid").where(F.col("n_sh") - F.size("x") <= _spare(F.col("n_sh"), num, den))

    def entries(part: pa.RecordBatch) -> pa.RecordBatch:
        x = part.column(3)
        at, c, t = np.asarray(x.offsets), np.asarray(x.values.field(0)), np.asarray(x.values.field(1))
        got = [index_entries(size, t[a:b], c[a:b], num, den) for size, a, b in zip(part.column(2).to_pylist(), at[:-1], at[1:], strict=True)]
        row = pa.array(np.repeat(np.arange(part.num_rows), [len(g) for g in got]))
        flat = np.array([e for g in got for e in g], np.int64).reshape(-1, 2)
        return pa.record_batch([*[part.column(k).take(row) for k in range(3)], pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32))], names=["nid", "cid", "n_sh", "key", "free"])

    index = common.stage(common.map_arrow(met.select("nid", "cid", "n_sh", "x"), entries, "nid long, cid long, n_sh int, key long, free int"), "index")
    # a key of one component links nothing new; nor does an entry whose set is too small or too large for all others of the key
    keys = index.groupBy("key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.min("n_sh").alias("least"), F.max("free").alias("freest"), F.count("*").alias("rows")).where("lo <> hi").drop("lo", "hi")
    reach = lambda free, size: F.lit(den + num) * free >= F.lit(num) * size
    index = common.matched(index, common.stage(keys, "keys"), "key").where(reach(F.least("free", "freest"), F.col("n_sh") + F.col("least"))).drop("least", "freest")
    index = index.join(full.select("nid", "bits"), "nid")

    fits = F.lit(den) * F.least("n_sh", "n_sh2") >= F.lit(num) * F.greatest("n_sh", "n_sh2")
    cross = (F.col("cid") != F.col("cid2")) & fits
    ends = [F.least("nid", "nid2").alias("a"), F.greatest("nid", "nid2").alias("b")]
    twin = index.select("key", *[F.col(c).alias(f"{c}2") for c in ("nid", "cid", "n_sh", "bits", "free")])
    by_key = index.join(twin, "key").where(cross & _near(num, den, WIDE) & reach(F.least("free", "free2"), F.col("n_sh") + F.col("n_sh2")) & F.expr("nid < nid2")).select(*ends)

    # a few more of the others' tokens of one component than a similar set may lack; both sides have their rows of tokens as arrays until the exchange
    gone = shared.groupBy("nid").agg(F.collect_set("token").alias("gone"))
    own = firsts.where("n_sh > 1").join(weak.select("nid"), "nid", "left_anti").join(gone, "nid", "left").select("nid", "cid", "n_sh", F.when(F.col("gone").isNull(), F.col("toks")).otherwise(F.array_except("toks", "gone")).alias("own"))
    own = own.withColumn("own", F.slice("own", 1, _spare(F.col("n_sh"), num, den).cast("int") + 1 + SLACK))
    other = own.select(F.col("nid").alias("nid2"), F.col("cid").alias("cid2"), F.explode("own").alias("token"))
    probe = full.select("nid", "cid", F.explode("toks").alias("token"))
    met = other.join(probe, "token").where("cid <> cid2").groupBy("nid", "nid2").agg(F.count("*").alias("k"))
    met = common.stage(met, "met")
    sizes = own.select(F.col("nid").alias("nid2"), F.col("n_sh").alias("n_sh2"), (F.size("own") - _spare(F.col("n_sh"), num, den)).alias("least"))
    by_own = met.join(sizes, "nid2").where("k >= least").join(full.select("nid", "n_sh"), "nid").where(fits).select(*ends)
    return by_key.unionByName(by_own).distinct()


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all of ``documents`` at three words and a similarity of 0.9."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_components(docs, 3, 90, 100)


#: For small tables: every pair that shares a shingle is compared, so it grows with the square of a shingle's count.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
  FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
  FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT a, b FROM c WHERE 100 * k >= 90 * (na + nb - k)),
r AS (SELECT doc_id AS d, doc_id AS m FROM s UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.d)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.component_id
FROM s JOIN (SELECT d, min(m) AS component_id FROM r GROUP BY d) m ON m.d = s.doc_id
"""
