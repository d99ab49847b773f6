"""Hard negatives by windows of scores, searched in a multiway hyperplane tree (GNAT).

Vectors get one more coordinate so that all have the same length; a query's is 0.  Then the
distance of a query and a row follows from their inner product alone, and a window of scores is an
annulus around the query.  Each node of the tree has a few split points; a row goes to the nearest
one.  For every pair of a split point and a sibling subtree the node stores the least and the largest distance of
its rows.  A query at a known distance from a split point rules a sibling out if, by the triangle
inequality, none of its rows can lie in the annulus.  What is left are leaves, whose rows are scored exactly.

The tree is fitted on a bounded sample, but indexes every row: rows are sent down in one narrow pass,
distance ranges and sizes of leaves are taken over all of them.  Leaves side by side share a cell
of at most ``CELL`` rows; a leaf with more is dealt out over several.  Queries go to the cells that
hold leaves left for them: first to their own, which bounds what can still enter, then to the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Most rows that the tree is fitted on, split points of a node, rows of a leaf (as the sample tells), of a cell, and queries of a block.
SAMPLE, FAN, LEAF, CELL, QUERY_BLOCK = 16_384, 8, 128, 4096, 4096
POSITIVES, NEGATIVES = 5, 3
AT_ONCE = 256
_LONG = (1 << 63) - 1


class Tree:
    """Split points, children and, once rows were sent down, distance ranges of siblings."""

    def __init__(self, sample: np.ndarray, total: int, norm: float, fan: int, leaf: int):
        self.norm, self.fan = norm, fan
        self.splits: list[np.ndarray] = []  # lifted, one matrix per node
        self.children: list[list[int]] = []  # a node, or -1 - leaf
        self.leaves = 0
        rng = np.random.default_rng(13)
        x = self.lift(sample)
        self.root = self._grow(x, np.arange(len(x)), total / max(1, len(x)), leaf, rng)
        shape = (len(self.splits), fan, fan)
        self.low, self.high = np.full(shape, np.inf), np.full(shape, -np.inf)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, self.norm - (x * x).sum(1)))[:, None]], axis=1)

    def _grow(self, x: np.ndarray, at: np.ndarray, each: float, leaf: int, rng: np.random.Generator) -> int:
        pick = self._apart(x[at], rng) if len(at) * each > leaf and len(at) >= 2 * self.fan else np.zeros(0, np.int64)
        if len(pick) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.splits)
        self.splits.append(x[at[pick]])
        self.children.append([])
        near = self.distances(x[at], self.splits[node]).argmin(1)
        self.children[node] = [self._grow(x, at[near == j], each, leaf, rng) for j in range(len(pick))]
        return node

    def _apart(self, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Places of up to ``fan`` different points far from each other, out of three times as many at random."""
        some = rng.permutation(len(x))[: 3 * self.fan]
        far, out = np.full(len(some), np.inf), []
        while len(out) < self.fan and far.max() > self.slack():
            k = int(far.argmax())
            out.append(some[k])
            far = np.minimum(far, self.distances(x[some], x[some[k]][None])[:, 0])
        return np.array(out, np.int64)

    def slack(self) -> float:
        """More than rounding can make of a distance."""
        return 1e-6 * self.norm**0.5

    def distances(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 * self.norm - 2 * (x @ points.T)))

    def down(self, x: np.ndarray, note: bool = False) -> np.ndarray:
        """The leaf of each row; with ``note`` the ranges take in the rows."""
        x, out = self.lift(x), np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out[at] = -1 - node
                continue
            d = self.distances(x[at], self.splits[node])
            near = d.argmin(1)
            for j, child in enumerate(self.children[node]):
                mine = near == j
                if mine.any():
                    m = d.shape[1]
                    if note:
                        self.low[node, :m, j] = np.minimum(self.low[node, :m, j], d[mine].min(0))
                        self.high[node, :m, j] = np.maximum(self.high[node, :m, j], d[mine].max(0))
                    todo.append((child, at[mine]))
        return out

    def left(self, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, places of queries) of all leaves that may hold a row with a score in a window lo..hi (query, window) of a query."""
        base = (q * q).sum(1)[:, None] + self.norm
        near, far = (np.sqrt(np.maximum(0, base - 2 * s.astype(float))) for s in (hi, lo))
        idle, out, todo = lo > hi, [], [(self.root, np.arange(len(q)))]
        while todo:
            node, at = todo.pop()
            if node < 0:
                out.append((-1 - node, at))
                continue
            m = len(self.splits[node])
            d = np.sqrt(np.maximum(0, base[at] - 2 * (q[at] @ self.splits[node][:, :-1].T)))
            for j, child in enumerate(self.children[node]):
                low, high = self.low[node, :m, j], self.high[node, :m, j]
                least = np.maximum(d - high, low - d).max(1)[:, None] - self.slack()
                most = (d + high).min(1)[:, None] + self.slack()
                # a distance that is no number rules nothing out
                live = ~(idle[at] | (least > far[at]) | (most < near[at])).all(1)
                if live.any() and high[0] >= low[0]:
                    todo.append((child, at[live]))
        return out


def integer_rows(emb: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, v, name) of floor(scale * x); null ids, labels and vectors and null or non-finite components drop out, repeated rows count once."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    x = emb.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ok)
    x = x.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: whole(F.lit(scale) * x.cast("double"))).alias("v")).distinct()
    return x.withColumn("name", F.xxhash64("vec_id", "label", "v"))


def _matrix(col: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(len(col), dims)


def _scores(q: np.ndarray, r: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as longs; ``exact`` if doubles hold all sums, else whole numbers of any size, clipped to the long range."""
    if exact:
        return (q @ r.T).astype(np.int64)
    whole = [np.array([int(x) for x in m.ravel()], object).reshape(m.shape) for m in (q, r)]
    return np.clip(whole[0] @ whole[1].T, -_LONG - 1, _LONG).astype(np.int64).reshape(len(q), len(r))


class Index:
    """All rows of a table under a tree, in cells."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, fan: int = FAN, leaf: int = LEAF, cell: int = CELL):
        self.spark = rows.sparkSession
        base = common.stage(rows, "vectors")
        n, dims, norm = base.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(0.0))).first()
        self.dims, self.exact = max(1, dims), norm < 2.0**53
        self.padded = base.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(self.dims) - F.size("v"))))
        taken = self.padded.orderBy("name", "vec_id").limit(sample).select("v").toPandas()["v"]
        self.tree = Tree(np.array(taken.tolist(), float).reshape(-1, self.dims), n, norm, fan, leaf)
        self.rows = common.stage(self._sent_down(), "leaves")
        self._measure()
        self._deal(cell)

    def _sent_down(self) -> DataFrame:
        tree, dims = self.spark.sparkContext.broadcast(self.tree), self.dims

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([*b.columns, pa.array(tree.value.down(_matrix(b.column(2), dims)))], names=[*b.schema.names, "leaf"])

        return common.map_arrow(self.padded.select("vec_id", "label", "v", "name"), run, "vec_id long, label long, v array<double>, name long, leaf int")

    def _measure(self) -> None:
        """Distance ranges over all rows: at most fan x fan rows for each node of the tree."""
        tree, dims = self.spark.sparkContext.broadcast(self.tree), self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tree.value
            t.low[:], t.high[:] = np.inf, -np.inf
            for b in batches:
                t.down(_matrix(b.column(0), dims), note=True)
            at = np.flatnonzero(t.low.ravel() <= t.high.ravel())
            yield pa.record_batch({"at": at, "low": t.low.ravel()[at], "high": t.high.ravel()[at]})

        common.small_batches(self.spark)
        for r in self.rows.select("v").mapInArrow(run, "at long, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
            self.tree.low.ravel()[r["at"]], self.tree.high.ravel()[r["at"]] = r.low, r.high

    def _deal(self, most: int) -> None:
        """Cells for the leaves: (first cell, number of cells) of each, at most one row for each leaf of the tree."""
        sizes = np.zeros(self.tree.leaves, np.int64)
        for r in self.rows.groupBy("leaf").agg(F.count("*").alias("n")).collect():
            sizes[r.leaf] = r.n
        self.cells, cell, held = np.zeros((self.tree.leaves, 2), np.int64), 0, 0
        for leaf, n in enumerate(sizes.tolist()):
            if held and held + n > most:
                cell, held = cell + 1, 0
            self.cells[leaf] = cell, max(1, -(-n // most))
            cell, held = (cell, held + n) if n <= most else (cell + int(self.cells[leaf, 1]), 0)
        of_leaf = self.spark.createDataFrame([(i, *map(int, c)) for i, c in enumerate(self.cells)], "leaf int, first long, many long")
        self.rows = self.rows.join(F.broadcast(of_leaf), "leaf").withColumn("cell", F.col("first") + F.pmod(F.xxhash64("name", "vec_id"), "many")).drop("first", "many")

    def search(self, queries: DataFrame, want: int, same: bool) -> DataFrame:
        """(query, w, vec_id, score, rank): the ``want`` best rows of each window w.

        ``queries``: query (a number of its own), vec_id, label, v, cell (its own), lows and highs (arrays of the windows' ends).  Rows of the
        query's label come in question if ``same``, of other labels if not; never one with its vec_id.  Higher scores come
        first, equal ones by vec_id.
        """
        n_q = queries.count()
        blocks = max(1, -(-n_q // QUERY_BLOCK))
        q = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        own = common.stage(self._visit(q.withColumn("leaves", F.lit(None).cast("array<int>")), want, same, blocks), "own-cells")
        nth = F.row_number().over(Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id"))
        cut = own.withColumn("n", nth).where(F.col("n") == want).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("cut"))
        q = q.join(cut, "query", "left")
        # the last place so far is the least that can enter
        lows = F.transform("lows", lambda lo, w: F.greatest(lo, F.coalesce(F.try_element_at("cut", (w + 1).cast("int")), lo)))
        rest = self._visit(self._left(q.withColumn("lows", lows).drop("cut")), want, same, blocks)
        found = own.unionByName(rest).withColumn("rank", nth)
        return found.where(F.col("rank") <= want)

    def _left(self, q: DataFrame) -> DataFrame:
        """One row for each query and cell, other than its own, with leaves that its windows may reach."""
        tree, dims, cells = self.spark.sparkContext.broadcast(self.tree), self.dims, self.cells

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            col = {c: b.column(c) for c in b.schema.names}
            lens = np.asarray(pa.compute.list_value_length(col["lows"]))
            lo, hi = np.full((b.num_rows, max(1, lens.max(initial=0))), 1, np.int64), np.zeros((b.num_rows, max(1, lens.max(initial=0))), np.int64)
            inside = np.arange(lo.shape[1]) < lens[:, None]
            lo[inside], hi[inside] = np.asarray(col["lows"].flatten()), np.asarray(col["highs"].flatten())
            home, at, cell, leaf = np.asarray(col["cell"]), [], [], []
            for f, who in tree.value.left(_matrix(col["v"], dims), lo, hi):
                for c in range(cells[f, 0], cells[f, 0] + cells[f, 1]):
                    go = who[home[who] != c]
                    at.append(go)
                    cell.append(np.full(len(go), c))
                    leaf.append(np.full(len(go), f))
            at, cell, leaf = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (at, cell, leaf))
            order = np.lexsort((leaf, cell, at))
            at, cell, leaf = at[order], cell[order], leaf[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(cell) != 0)])) if len(at) else np.zeros(0, np.int64)
            out = {c: v.take(pa.array(at[first])) for c, v in col.items()}
            out["cell"] = pa.array(cell[first], pa.int64())
            out["leaves"] = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
            return pa.record_batch(out)

        cols = "query long, vec_id long, label long, v array<double>, cell long, lows array<long>, highs array<long>, block long"
        return common.map_arrow(q.select(*[c.split()[0] for c in cols.split(", ")]), run, cols + ", leaves array<int>")

    def _visit(self, visits: DataFrame, want: int, same: bool, blocks: int) -> DataFrame:
        """(query, w, vec_id, score): up to ``want`` rows for each visit and window; null leaves stand for all of the cell."""
        dims, exact = self.dims, self.exact
        rows = self.rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            out = [[np.zeros(0, np.int64)] for _ in range(4)]
            if len(a) and len(b):
                a, b = (t.combine_chunks() for t in (a, b))
                leaf, ids, label = (np.asarray(b.column(c)) for c in ("leaf", "vec_id", "label"))
                r = _matrix(b.column("v").combine_chunks(), dims)
                q = {c: np.asarray(a.column(c)) for c in ("query", "vec_id", "label")}
                v, lows, highs, leaves = _matrix(a.column("v").combine_chunks(), dims), a.column("lows").to_pylist(), a.column("highs").to_pylist(), a.column("leaves").to_pylist()
                goes: dict = {}
                for i, some in enumerate(leaves):
                    for f in [None] if some is None else some:
                        goes.setdefault(f, []).append(i)
                for f, who in goes.items():
                    here = np.arange(len(leaf)) if f is None else np.flatnonzero(leaf == f)
                    for lo in range(0, len(who), AT_ONCE):
                        for o, x in zip(out, best(q, v, lows, highs, np.array(who[lo : lo + AT_ONCE]), ids[here], label[here], r[here]), strict=True):
                            o.append(x)
            found = [np.concatenate(o) for o in out]
            keep = first_of(found[0], found[1], found[3], found[2])  # of all leaves of the cell
            return pa.table({n: pa.array(x[keep], t) for n, x, t in zip(("query", "w", "vec_id", "score"), found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

        def first_of(query: np.ndarray, w: np.ndarray, score: np.ndarray, ids: np.ndarray) -> np.ndarray:
            """Places of the ``want`` first of each query and window."""
            order = np.lexsort((ids, -score, w, query))
            group = np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(w[order]) != 0)])[: len(order)]
            start = np.flatnonzero(group)
            return order[np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order)))) < want]

        def best(q: dict, v: np.ndarray, lows: list, highs: list, who: np.ndarray, ids: np.ndarray, label: np.ndarray, r: np.ndarray):
            s = _scores(v[who], r, exact)
            fits = (q["label"][who][:, None] == label) == same
            fits &= q["vec_id"][who][:, None] != ids
            parts = []
            for w in range(max(len(lows[i]) for i in who)):
                lo = np.array([lows[i][w] if w < len(lows[i]) else 1 for i in who])
                hi = np.array([highs[i][w] if w < len(highs[i]) else 0 for i in who])
                i, j = np.nonzero(fits & (s >= lo[:, None]) & (s <= hi[:, None]))
                part = [q["query"][who[i]], np.full(len(i), w + 1), ids[j], s[i, j]]
                keep = first_of(part[0], part[1], part[3], part[2])
                parts.append([x[keep] for x in part])
            return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4

        side = ["cell", "block"]
        return visits.groupBy(*side).cogroup(rows.groupBy(*side)).applyInArrow(run, "query long, w int, vec_id long, score long")


def hard_negatives(index: Index, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``anchors``, rows of ``index.rows``.

    An anchor's positives are its ``positives`` best other rows of its label.  For each, the ``negatives`` best rows of other labels with
    50 * positive_score <= 100 * negative_score <= 95 * positive_score come back; a positive with none gives no rows.  Rows that repeat an id with
    another label or vector are rows of their own, but none is compared with its own id.  Scores beyond the long range count as its ends.
    """
    a = common.stage(anchors.withColumn("query", F.monotonically_increasing_id()), "anchors")
    all_ = a.withColumns({"lows": F.array(F.lit(-_LONG - 1)), "highs": F.array(F.lit(_LONG))})
    found = index.search(all_, positives, True).select("query", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("w"))
    found = common.stage(found, "positives")
    s = F.col("positive_score")
    # a negative score has no window; halves and shares without a product that overflows
    low, high = F.expr("positive_score div 2 + positive_score % 2"), F.expr("positive_score div 100 * 95 + (positive_score % 100 * 95) div 100")
    ends = found.withColumns({"low": F.when(s < 0, 1).otherwise(low), "high": F.when(s < 0, 0).otherwise(high)})
    ends = ends.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("x"))
    windows = a.join(ends, "query").withColumns({"lows": F.transform("x", lambda y: y["low"].cast("long")), "highs": F.transform("x", lambda y: y["high"].cast("long"))}).drop("x")
    got = index.search(windows, negatives, False).select("query", "w", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    out = got.join(found, ["query", "w"]).join(a.select("query", F.col("vec_id").alias("anchor_id")), "query")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hyperplane_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of five positives of every row of ``embeddings`` whose vec_id is divisible by 50."""
    emb = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = emb.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    index = Index(integer_rows(moved))
    return hard_negatives(index, index.rows.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
