"""Exact top-k inner-product search by a three-phase uniform threshold.

The dimensions are cut into groups.  For each group a query has one score list, whose
entry for a row is the inner product over the group's dimensions; a score is the sum
of a row's entries.  A task holds one list for a block of queries and a
block of rows, and nothing of the other lists.

1. gather: every task sends its best entries per query.  The leaders of each list are
   looked up in the other lists too, so that their sums are exact, and the ``k``-th best
   sum is a lower bound of the result: the safe cutoff;
2. the cutoff goes to every task (one number per query), which collects the sufficient
   entries: those of at least an even share of the cutoff.  A row without one in any list
   stays under the cutoff;
3. resolve: each list is asked for the entries that the others collected and it did not, so
   that sums are exact; those at or over the cutoff are ranked.

Queries are a stated set and meet all rows in a grid of bounded blocks.  Between phases,
entries travel as arrays, one row for each query, list and block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 4096
ROW_BLOCK = 4096
GROUPS = 2
#: Queries that a task multiplies at a time, and leaders of a list for each place of the result.
AT_ONCE, LEADERS = 256, 4
_LONG = (1 << 63) - 1


def integer_vectors(emb: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v array<double>) of floor(scale * x); null ids, null vectors and null or non-finite components drop out."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # doubles from 2**52 on are whole numbers, which a floor as long would clip
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return emb.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ok).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: whole(F.lit(scale) * x.cast("double"))).alias("v")
    )


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def _numbers(m: np.ndarray, kind: str) -> np.ndarray:
    """Components as numbers whose products and sums are exact."""
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape) if kind == "whole" else m.astype(kind)


def _entries(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """One list for some queries and some rows, as longs; whole numbers of any size are clipped to their range."""
    s = q @ r.T
    return (np.clip(s, -_LONG - 1, _LONG) if s.dtype == object else s).astype(np.int64).reshape(len(q), len(r))


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a block of rows in one order for all lists."""
    ids, name = (np.asarray(table.column(c).combine_chunks()) for c in ("vec_id", "name"))
    order = np.lexsort((name, ids))
    return ids[order], _matrix(table.column("v").combine_chunks())[order]


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, groups: int = GROUPS, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest scores of each query over ``rows``.

    Both inputs are (vec_id, v); further columns are not looked at.  A query's own id is no candidate.  Ties go to the
    smaller vec_id; with fewer candidates than ``k`` all come back.  Shorter vectors count as
    padded with zeros.  Rows that repeat an id with the same vector count once; of
    different vectors under one id the best score counts.  Empty inputs give no rows.
    Scores that fit 53 bits are summed as doubles and those that fit 62 bits as longs, over ``groups`` lists in both cases.
    Where they may be larger, a sum of clipped entries would be wrong: whole numbers of any size are summed over
    one list of all dimensions, and scores beyond the long range are returned as its ends.
    """
    # two inputs may stem from one table; ``name`` tells vectors of one id apart
    own = lambda x: x.select(F.col("vec_id").alias("vec_id"), F.col("v").alias("v")).distinct().withColumn("name", F.xxhash64("vec_id", "v"))
    queries, rows = common.stage(own(queries), "queries"), common.stage(own(rows), "rows")
    size = lambda x: x.select(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0))).first()
    (n_q, dq, mq), (n_r, dr, mr) = size(queries), size(rows)
    dims, qb, rb = max(1, dq, dr), max(1, -(-n_q // query_block)), max(1, -(-n_r // row_block))
    bound = mq * mr * dims
    kind = "float64" if bound < 2**53 else "int64" if bound < 2**62 else "whole"
    m = 1 if kind == "whole" else min(groups, dims)
    cuts = [dims * i // m for i in range(m + 1)]

    v = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("v")))
    parts = F.array(*[F.struct(F.lit(i).alias("list"), F.slice(v, a + 1, b - a).alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])

    def by_list(x: DataFrame) -> DataFrame:
        """Every row once for each list, with that list's part of ``v``."""
        return x.withColumn("x", F.explode(parts)).drop("v").select("*", "x.*").drop("x")

    def cells(x: DataFrame, other: str, copies: int) -> DataFrame:
        """Every row once for each list and each block of the other side."""
        return by_list(x).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    queries, rows = (x.withColumn(b, F.pmod("name", F.lit(n)).cast("int")) for x, b, n in ((queries, "qb", qb), (rows, "rb", rb)))
    r = cells(rows, "qb", qb)
    # queries are joined before they are multiplied by blocks: Spark takes the size of their small file for that of their copies, and would broadcast these
    with_query = lambda x: x.withColumnRenamed("query_id", "vec_id").join(queries.drop("qb").hint("merge"), ["vec_id", "name"])
    cell, one = ["list", "qb", "rb"], ["query_id", "name", "qb", "rb"]
    fields = "query_id long, name long, qb int, rb int, list int, at array<int>, vec_ids array<long>, entries array<long>"

    def ask(queries: DataFrame, choose) -> DataFrame:
        """Entries of every cell; ``choose`` gives (places in the block of rows, entries there) for each of some queries."""

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [[] for _ in range(8)]
            if len(a) and len(b):
                ids, right = _rows(b)
                left, right = (_numbers(x, kind) for x in (_matrix(a.column("v").combine_chunks()), right))
                names = [a.column(c).to_pylist() for c in ("vec_id", "name", "qb", "rb", "list")]
                for lo in range(0, len(a), AT_ONCE):
                    part = a.slice(lo, AT_ONCE)
                    for i, (at, s) in enumerate(choose(part, left[lo : lo + AT_ONCE], right, ids)):
                        if len(at):
                            for c, x in zip(out, [*(n[lo + i] for n in names), at.astype(np.int32), ids[at], s], strict=True):
                                c.append(x)
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["query_id", "name", "qb", "rb", "list", "at", "vec_ids", "entries"])

        return queries.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(run, fields)

    def best(part: pa.Table, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        s, want = _entries(left, right), min(k + 1, len(right))
        for i, (me, at) in enumerate(zip(part.column("vec_id").to_pylist(), np.argpartition(-s.astype(float), want - 1, axis=1)[:, :want], strict=True)):
            at = at[ids[at] != me]
            yield at, s[i, at]

    def asked(part: pa.Table, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        # the named rows alone are multiplied
        for i, x in enumerate(part.column("ask")):
            at = np.asarray(x.values)
            yield at, _entries(left[i : i + 1], right[at])[0]

    def sufficient(part: pa.Table, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        s = _entries(left, right)
        for i, (me, c) in enumerate(zip(part.column("vec_id").to_pylist(), part.column("cutoff").to_pylist(), strict=True)):
            at = np.flatnonzero((s[i] >= (-_LONG - 1 if c is None else -(-c // m))) & (ids != me))
            yield at, s[i, at]

    # 1. leaders of each list, their sums, and the cutoff
    flat = lambda x: x.select(*one, "list", F.explode(F.arrays_zip("at", "vec_ids", "entries")).alias("x")).select(*one, "list", "x.*")
    place = F.row_number().over(Window.partitionBy("query_id", "name", "list").orderBy(F.desc("entries"), "vec_ids"))
    lead = flat(ask(cells(queries, "rb", rb), best)).withColumn("n", place).where(F.col("n") <= LEADERS * k).groupBy(*one).agg(F.collect_set("at").alias("ask"))
    lead = common.stage(lead, "leaders")
    sums = flat(ask(by_list(with_query(lead)), asked))
    sums = sums.groupBy(*one, "at", "vec_ids").agg(F.sum("entries").alias("score")).groupBy("query_id", "vec_ids").agg(F.max("score").alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    cut = common.stage(sums.withColumn("n", nth).where(F.col("n") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")), "cutoffs")

    # 2. sufficient entries
    held = common.stage(ask(cells(queries.join(cut.hint("merge"), "vec_id", "left"), "rb", rb), sufficient), "entries", codec="zstd")

    # 3. what the other lists collected, and the sums
    wanted = held.groupBy(*one).agg(F.collect_list(F.struct("list", "at")).alias("x"))
    there = F.array_distinct(F.flatten(F.transform("x", lambda y: y["at"])))
    here = lambda i: F.flatten(F.transform(F.filter("x", lambda y: y["list"] == F.lit(i)), lambda y: y["at"]))
    lists = F.array(*[F.struct(F.lit(i).alias("list"), F.array_except(there, here(i)).alias("ask")) for i in range(m)])
    wanted = wanted.select(*one, F.explode(lists).alias("y")).select(*one, "y.list", "y.ask").where(F.size("ask") > 0)
    more = ask(with_query(wanted).withColumn("v", F.element_at(parts, F.col("list") + 1)["v"]), asked)
    summed = held.unionByName(more).groupBy(*one).agg(F.collect_list(F.struct("at", "vec_ids", "entries")).alias("x")).join(cut.withColumnRenamed("vec_id", "query_id"), "query_id", "left")

    def total(part: pa.RecordBatch) -> pa.RecordBatch:
        out = [[], [], []]
        for query, x, c in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
            y = x.values
            at, ids, s = (np.concatenate([np.asarray(z.values) for z in y.field(f)]) for f in ("at", "vec_ids", "entries"))
            places, first, which = np.unique(at, return_index=True, return_inverse=True)
            score = np.zeros(len(places), np.int64)
            np.add.at(score, which, s)
            good = np.flatnonzero(score >= (-_LONG - 1 if c is None else c))
            for o, z in zip(out, (np.full(len(good), query), ids[first][good], score[good]), strict=True):
                o.append(z)
        return pa.record_batch({n: np.concatenate(o).astype(np.int64) if o else np.zeros(0, np.int64) for n, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = common.map_arrow(summed.select("query_id", "x", "cutoff"), total, "query_id long, vec_id long, score long").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all other vectors for every vector whose id is divisible by 20."""
    vecs = integer_vectors(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return exact_top_k(vecs.where("vec_id % 20 = 0"), vecs, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], r.v::DOUBLE[])::BIGINT AS score
  FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""
