"""Ranked search on odd rows, many terms and blocks of items, against a plain version."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from rivulet.llm import lexical

from .test_queries import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(rows, items, k):
    bags = [(d, Counter(terms(t))) for d, t in rows]
    size = [sum(b.values()) for _, b in bags]
    n, total = sum(s > 0 for s in size), sum(size)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        found = []
        for (d, b), s in zip(bags, size, strict=True):
            m = 25 + 75 * s * n // max(1, total)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in want.items() if t in b)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def asked(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def same(spark, rows, items, k=10, **how):
    frame = docs(spark, rows).withColumn("n", F.lit("x")).withColumn("terms", F.lit(3)).repartition(3)
    got = lexical.ranked(frame, asked(spark, items).withColumn("term", F.lit("y")), k, **how)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, items, k)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "ABC_def é É"), (5, "abc"), (5, "abc"), (5, "abc abc x"), (None, "abc"), (6, "é\x85é 日本 9a"), (7, "abc " * 40_000 + "z"), (8, "İK \0abc")]
    items = [(1, "abc abc ABC"), (1, "abc abc ABC"), (1, "z"), (2, None), (3, ""), (None, "abc"), (4, "É é 日本 none"), (5, "nothing here")]
    same(spark, rows, items)
    same(spark, rows, items, 2)
    same(spark, rows, [])
    same(spark, [], items)


def test_many_terms_ties_and_blocks(spark):
    r = random.Random(12)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 400}"
    rows = [(k // 2, " ".join(word() for _ in range(r.choice([1, 3, 40, 300])))) for k in range(700)]
    rows += [(9000 + k, "w1 w2 w3") for k in range(300)]  # one mask, one score
    items = [(i, " ".join(word() for _ in range(r.choice([1, 5, 60, 400])))) for i in range(12)] + [(50, "w1 w2"), (51, " ".join(f"w{i}" for i in range(400)))]
    same(spark, rows, items)
    same(spark, rows, items, 3, block_rows=80)
