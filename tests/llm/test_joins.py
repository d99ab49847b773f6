"""Similarity, search, sharding and threads on small tables with all odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.llm import conversations, jaccard, sharding, topk


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=str)


@pytest.mark.parametrize("n, num, seed", [(3, 90, 1), (5, 80, 2), (2, 50, 3)])
def test_components(spark, n, num, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    r = random.Random(seed)
    base = [[r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 90))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1002, " \t\n"), (None, "a b c d"), (1003, "A b"), (1004, "a B")]
    for k in range(110):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice("xyz") + str(r.randint(0, 9))
        rows.append((k, r.choice([" ", "\n"]).join(w + (["boiler", "plate", "line", "of", "words"] if k % 3 == 0 else []))))
    got = jaccard.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, 100).collect()
    assert sorted(map(tuple, got), key=str) == components(rows, n, num, 100)


def test_no_documents(spark):
    assert jaccard.similarity_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_top_k(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(9)], "x") for i in range(60)] + [(60, None, "x"), (61, [1.0, None], "x"), (62, [float("nan")], "x"), (None, [1.0], "x"), (63, [], "x"), (64, [0.5], "x"), (5, [r.uniform(-1, 1) for _ in range(9)], "x")]
    rows[6] = (6, rows[7][1], "x")
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string"))
    got = topk.exact_top_k(v.where("vec_id % 5 = 0"), v, 4, query_block=7, row_block=16).collect()
    vecs = [(x.vec_id, x.v) for x in v.collect()]
    want = []
    for q in sorted({q for q, _ in vecs if q % 5 == 0}):
        best = {}
        for a, x in vecs:
            for b, y in vecs:
                if a == q and b != q:
                    best[b] = max(best.get(b, -(10**18)), int(sum(i * j for i, j in zip(x, y))))
        want += [(q, k + 1, b, s) for k, (b, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:4])]
    assert sorted(map(tuple, got)) == sorted(want)
    none = v.where("vec_id < -5")
    assert topk.exact_top_k(none, v, 3).count() == 0 and topk.exact_top_k(v, none, 3).count() == 0


def test_shards_fit_and_lose_nothing(spark):
    rows = [(i, "x" * (i * 7 % 50), i) for i in range(300)] + [(1, "y" * 500, 0)] + [(7, "same", 1)] * 80 + [(None, None, 2), (None, "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = sharding.extendible_shards(df, "doc_id", F.octet_length("text"), 200).cache()
    assert got.count() == len(rows) and "shard_in" in got.columns
    for s in got.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("shard_bytes").alias("m"), F.count("*").alias("n")).collect():
        assert s.b == s.m and (s.b <= 200 or s.n == 1)
    assert sharding.extendible_shards(df.where("doc_id < 0"), "doc_id", F.octet_length("text"), 200).count() == 0


def test_trees_are_walked_and_ranked(spark):
    rows = [(1, 10, None, "user", "q", 0.0), (1, 11, 10, "assistant", "bad", 1.0), (1, 12, 10, "assistant", "good", 5.0), (1, 13, 12, "user", "more", 0.0), (1, 14, 13, "assistant", None, 0.0), (1, 15, 13, None, "x", 9.0), (2, 20, 99, "assistant", "### a\\b </turn>", None), (3, 30, 31, "user", "loop", 0.0), (3, 31, 30, "user", "loop", 0.0)]
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    paths = {r.leaf: (list(r.path), r.score) for r in conversations.reply_paths(df).collect()}
    assert paths == {11: ([10, 11], 1.0), 14: ([10, 12, 13, 14], 5.0), 15: ([10, 12, 13, 15], 14.0), 20: ([20], 0.0)}
    out = conversations.format_paths(df, best=2).withColumn("t", conversations.read_back(F.col("formatted")))
    got = {(r.conv_id, r.path_rank): [(x.role, x.text) for x in r.t] for r in out.collect()}
    assert got[1, 1] == [("user", "q"), ("assistant", "good"), ("user", "more"), ("", "x")] and got[1, 2][-1] == ("assistant", "")
    assert got[2, 1] == [("assistant", "### a\\b </turn>")]
    assert conversations.reply_paths(df.where("conv_id > 9")).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\#", "####", "### ### </turn>", " </turn>\n### user\nhi </turn>\n", "\\</turn>", "a\nb", "<</turn>>"])
def test_escapes_reverse(spark, text):
    e = spark.range(1).select(conversations.escape(F.lit(text)).alias("e"), conversations.escape_role(F.lit(text)).alias("r"))
    got = e.select("e", conversations.unescape(F.col("e")).alias("u"), "r", conversations.unescape_role(F.col("r")).alias("v")).first()
    assert got.u == text and got.v == text and "\n" not in got.r
    assert " </turn>\n" not in got.e


def test_a_long_thread(spark):
    turns = spark.range(300).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = conversations.format_paths(conversations.thread(turns)).withColumn("t", conversations.read_back(F.col("formatted"))).collect()
    assert len(got) == 1 and [x.text for x in got[0].t] == [str(i) for i in range(300)]


def test_top_k_broadcasts_no_query_for_each_block(spark, monkeypatch):
    r, plans, ask = random.Random(7), [], topk.common.stage
    monkeypatch.setattr(topk.common, "stage", lambda df, *a, **b: plans.append(df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()) or ask(df, *a, **b))
    v = topk.integer_vectors(spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(120)], "vec_id long, embedding array<float>"))
    got = topk.exact_top_k(v.where("vec_id % 5 = 0"), v, 3, query_block=8, row_block=16)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    # the cutoffs, one number for each query, may be broadcast; queries, multiplied by the blocks of rows, may not
    assert len(plans) == 6 and sum(p.count("BroadcastExchange") for p in plans[:-1]) == 0 and plans[-1].count("BroadcastExchange") <= 1
    assert got.count() == 24 * 3
