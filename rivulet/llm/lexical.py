"""Ranked lexical search by presence masks.

Items are a stated query set whose terms, in blocks of bounded size, meet all documents.  One
narrow pass keeps, for each document, its length and its counts of those terms, and the statistics
come from these.  Then every task takes its documents block by block: a term's bitmap says
which documents hold it; the bitmaps of an item's terms, read across, give each document's mask,
and documents of one mask are a group.  The sum of the largest part that each of its terms adds in the block is
the most that a mask can score.  Groups are scored from the highest such maximum down,
until it falls under the item's last place so far: then nothing below can enter.

Last places hold on from block to block, so a task's later blocks score few documents.  A task
gives at most ``k`` rows for each item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows of (item, term) in one block of items; a block is broadcast.
BLOCK_ROWS = 200_000
#: Share of the length in the score, of 100.
LENGTH = 75
_TERM = common._table(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the terms of all texts as bytes, row of each)."""
    low, start, end, row = common.words(*common.flat(texts), _TERM)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(low[low != 32]))]), row


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n) of items (item_id, text); texts of one item_id count as one, repeated rows once."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        terms, row = _terms(part.column(1))
        return pa.record_batch({"item_id": part.column(0).take(pa.array(row)), "term": terms.cast(pa.binary())})

    x = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    return common.map_arrow(x, run, "item_id long, term binary").groupBy("item_id", "term").agg(F.count("*").alias("n"))


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, counts): the number of all terms of each text, and which of ``terms`` (by place) it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    known = []

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if not known:
            known.append(pa.array(shared.value, pa.large_binary()))
        found, row = _terms(part.column(1))
        n = np.bincount(row, minlength=part.num_rows)
        x = found.dictionary_encode()
        code = pc.index_in(x.dictionary, known[0]).fill_null(-1).to_numpy()[x.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
        hit = code >= 0
        key, count = np.unique(row[hit] * len(known[0]) + code[hit], return_counts=True)
        at = pa.array(np.searchsorted(key, np.arange(part.num_rows + 1) * len(known[0])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(at, pa.array(v.astype(np.int32))) for v in (key % max(1, len(known[0])), count)]
        return pa.record_batch({"doc_id": part.column(0), "n": n.astype(np.int64), "terms": lists[0], "counts": lists[1]})

    return common.map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n long, terms array<int>, counts array<int>")


def statistics(post: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents that hold each of the ``n_terms`` terms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(n_terms, np.int64), 0, 0
        for b in batches:
            held += np.bincount(b.column(1).flatten().to_numpy(), minlength=n_terms)
            size = b.column(0).to_numpy()
            n, total = n + int((size > 0).sum()), total + int(size.sum())
        some = np.flatnonzero(held)
        yield pa.record_batch({"term": np.concatenate([some, [-1, -2]]), "n": np.concatenate([held[some], [n, total]])})

    df, found = np.zeros(n_terms, np.int64), {}
    for r in post.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row per term of the block
        if r.term >= 0:
            df[r.term] = r.n
        else:
            found[r.term] = r.n
    return found.get(-1, 0), found.get(-2, 0), df


class _Item:
    """The terms of an item, and its best documents so far."""

    def __init__(self, item_id: int, terms: np.ndarray, weight: np.ndarray, k: int):
        self.item_id, self.terms, self.weight, self.k = item_id, terms, weight, k
        self.score, self.doc, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def cutoff(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def offer(self, score: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.cutoff()
        if good.any():
            s, d, z = (np.concatenate([a, b[good]]) for a, b in ((self.score, score), (self.doc, doc), (self.none, none)))
            order = np.lexsort((d, z, -s))[: self.k]
            self.score, self.doc, self.none = s[order], d[order], z[order]


class _Block:
    """Some documents: a bitmap and the largest part of the score for each term, and the part of each posting."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int, place: np.ndarray):
        ids = batch.column(0)
        self.none, self.doc, self.place = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy(), place
        size, lists = batch.column(1).to_numpy(), batch.column(2)
        self.n = batch.num_rows
        count, term = batch.column(3).flatten().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        doc = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))
        m = 100 - LENGTH + LENGTH * size * n_docs // max(1, n_terms)
        self.part = 10**9 * count // (1000 * count + 8 * m[doc])
        self.terms, at = np.unique(term, return_inverse=True)
        place[self.terms] = np.arange(len(self.terms))
        self.key = doc * len(self.terms) + at
        self.most = np.zeros(len(self.terms), np.int64)
        np.maximum.at(self.most, at, self.part)
        width = -(-self.n // 8)
        self.maps = np.zeros(len(self.terms) * width, np.uint8)
        np.bitwise_or.at(self.maps, at * width + doc // 8, (128 >> (doc % 8)).astype(np.uint8))
        self.maps = self.maps.reshape(-1, width)

    def search(self, item: _Item) -> None:
        row = self.place[item.terms]
        here = (row >= 0) & (item.weight > 0)
        row, weight = row[here], item.weight[here]
        most = weight * self.most[row]
        if most.sum() < item.cutoff():
            return
        bits = np.unpackbits(self.maps[row], axis=1, count=self.n)
        first, group = _masks(bits)
        bound = most @ bits[:, first].astype(np.int64)
        order = np.argsort(-bound, kind="stable")
        members = np.argsort(group, kind="stable")
        edge = np.searchsorted(group[members], np.arange(len(first) + 1))
        lo, width = 0, 8
        while lo < len(order) and bound[order[lo]] >= item.cutoff():
            now = order[lo : lo + width]
            now = now[bound[now] >= item.cutoff()]
            docs = np.concatenate([members[edge[g] : edge[g + 1]] for g in now.tolist()])
            j, d = np.nonzero(bits[:, docs])
            score = np.zeros(len(docs), np.int64)
            np.add.at(score, d, weight[j] * self.part[np.searchsorted(self.key, docs[d] * len(self.terms) + row[j])])
            item.offer(score, self.doc[docs], self.none[docs])
            lo, width = lo + width, width * 2


def _masks(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one column of each distinct mask, number of the mask of each column) of the columns of ``bits`` (term, document)."""
    packed = np.packbits(bits, axis=0)
    words = np.zeros((bits.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    words[:, : len(packed)] = packed.T
    words = words.view(np.uint64)
    group, first = np.zeros(len(words), np.int64), np.zeros(1, np.int64)
    for w in words.T:  # groups so far, split by the next 64 terms
        _, word = np.unique(w, return_inverse=True)
        _, first, group = np.unique(group * len(w) + word, return_index=True, return_inverse=True)
    return first, group


def _block_search(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """(item_id, doc_id, score): the best of each task for the items whose terms are ``rows`` (item_id, term, n)."""
    terms = sorted({bytes(r.term) for r in rows})
    at = {t: i for i, t in enumerate(terms)}
    post = common.stage(postings(docs, terms), "postings", codec="zstd")
    n_docs, n_terms, held = statistics(post, len(terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)
    items: dict[int, list] = {}
    for r in rows:
        items.setdefault(r.item_id, []).append((at[bytes(r.term)], r.n))
    ready = [(i, np.array([t for t, _ in x]), np.array([weight[t] * n for t, n in x], np.int64)) for i, x in sorted(items.items())]
    shared = docs.sparkSession.sparkContext.broadcast(ready)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, place = [_Item(*x, k) for x in shared.value], np.full(len(terms), -1, np.int64)
        for batch in batches:
            block = _Block(batch, n_docs, n_terms, place)
            for item in items:
                block.search(item)
            place[block.terms] = -1
        out = [(np.full(len(x.score), x.item_id), x.doc, x.none, x.score) for x in items]
        ids, doc, none, score = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out, strict=True))
        yield pa.record_batch({"item_id": pa.array(ids, pa.int64()), "doc_id": pa.array(doc, pa.int64(), mask=none.astype(bool)), "score": pa.array(score, pa.int64())})

    return post.where("size(terms) > 0").select("doc_id", "n", "terms", "counts").mapInArrow(run, "item_id long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    Equal scores go by ascending doc_id, a null one last.  Every row of ``docs`` is a document, also where a doc_id repeats; null and empty
    texts have no terms and take no part.  Items without an id, a text or a term give no rows.  Further columns are not looked
    at.  Empty tables give no rows.  Items are taken in blocks of at most ``block_rows`` rows of terms (or of one
    item), each of which reads all documents.
    """
    spark = docs.sparkSession
    found = common.stage(item_terms(items), "item-terms")
    blocks, name = 1, F.xxhash64("item_id")
    largest = found.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while found.groupBy(F.pmod(name, F.lit(blocks)).alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > max(block_rows, largest)).head(1):
        blocks *= 2
    best = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for b in range(blocks):
        rows = found.where(F.pmod(name, F.lit(blocks)) == b).collect()
        if rows:
            best = best.unionByName(_block_search(docs, rows, k))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_presence_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all ``documents`` for every item of ``benchmark``."""
    return ranked(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH i AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)) GROUP BY 1, 2),
t AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM t),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
d AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, n),
m AS (SELECT r, doc_id, 25 + (75 * len(w) * n) // l AS m FROM t, s WHERE len(w) > 0),
x AS (SELECT item_id, r, sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN d USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM x JOIN m USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""
