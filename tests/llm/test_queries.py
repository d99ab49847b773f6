"""The operators' queries against their SQL, and those without SQL against brute force."""

import hashlib

import pytest
from pyspark.sql import functions as F

from rivulet.llm import common, decontaminate, langid, pieces, queries, suffixes, training_order

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    want = oracle.connect(SF).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def cut(rows, length):
    """Every byte string of ``length`` that starts earlier, by a set of all of them."""
    seen, out = set(), []
    for d, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup_of_the_table(spark):
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.queries()["op5_suffix_dedup"](spark, SF).collect())) == cut(rows, 100)


def test_suffix_dedup_of_odd_texts(spark):
    import random

    r = random.Random(5)
    rows = [(1, None), (2, ""), (3, "a" * 700), (4, "é" * 300), (5, "a" * 99), (6, "ab" * 200)]
    rows += [(7 + k, "".join(r.choice("ab") * r.randint(1, 40) for _ in range(r.randint(1, 60)))) for k in range(40)]
    got = suffixes.kept_bytes(docs(spark, rows), ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == cut(rows, 100)
    assert suffixes.kept_bytes(docs(spark, []), ["doc_id"]).count() == 0


def test_suffix_dedup_with_common_kgrams_cut(spark):
    import random

    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [word(400), word(150), "x" * 300]
    rows = [(k, word(r.randint(0, 90)) + r.choice(passages)[r.randint(0, 9) * (k % 2) :] + word(r.randint(0, 90))) for k in range(120)]
    rows += [(200 + k, "".join(r.choice("ab") * r.randint(1, 40) for _ in range(r.randint(1, 60)))) for k in range(20)]
    rows += [(300, None), (301, ""), (302, "a" * 99), (303, passages[0][:100])]
    for many in (1, 8):
        got = suffixes.kept_bytes(docs(spark, rows), ["doc_id"], many=many).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == cut(rows, 100)
    whole, ranges, windows = suffixes.repeated_blocks(docs(spark, rows).where("text is not null"), many=8)
    texts = dict(rows)

    def kinds(found):
        seen = {}
        for b in found.collect():
            seen.setdefault(b.g, set()).add((texts[b.doc_id].encode()[b.lo : b.lo + b.n + 99], b.off))
        return max(map(len, seen.values()))

    assert kinds(whole) <= 8 and kinds(ranges) <= 8 and kinds(windows) == 1


def tiled(item, text, least):
    """Greedy tiling by looking at every pair of places."""
    a, b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                k = 0
                while i + k < len(item) and t + k < len(text) and a[i + k] and b[t + k] and item[i + k] == text[t + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, t)
        k, i, t = best
        if k < least:
            return total
        a[i : i + k] = b[t : t + k] = [False] * k
        total += k


def test_tiles(spark):
    import random

    import numpy as np

    r = random.Random(3)
    for _ in range(150):
        x, y = ([r.randint(0, 3) for _ in range(r.randint(0, n))] for n in (20, 40))
        tiles = decontaminate.tile(np.array(x, np.uint64), np.array(y, np.uint64), 3)
        assert all(x[i : i + k] == y[t : t + k] for i, t, k in tiles) and all(k >= 3 for *_, k in tiles)
        assert sum(k for *_, k in tiles) == tiled(x, y, 3)


def test_reordered_passages_are_found_and_clean_ones_left(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, None), (None, "x"), (4, "")], "item_id long, text string")
    rows = docs(spark, [(1, "Seven EIGHT nine, ten eleven twelve then one two three four five six"), (2, "one two three four is not enough of it"), (3, "a short item here"), (4, None), (None, "short item"), (5, ""), (1, "again")])
    got = {(r.doc_id, r.contaminated, r.item_id) for r in decontaminate.contamination(rows, bench).collect()}
    assert got == {(1, True, 1), (2, False, None), (3, True, 2), (4, False, None), (None, False, None), (5, False, None)}
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    # many seeds: joined without the filter in the pass
    many = {(r.doc_id, r.item_id) for r in decontaminate.coverage(rows, bench, seed_limit=0).where("coverage >= 0.5").collect()}
    assert many == {(1, 1), (3, 2)}


def test_tiling_of_the_tables(spark):
    """The whole query against every pair of places of every document and item that share five tokens."""
    import re

    tokens = lambda t: [w.decode() for w in re.findall(rb"[0-9A-Za-z_\x80-\xff]+", (t or "").lower().encode())]
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    texts = {}
    for r in common.table(spark, SF, "benchmark").orderBy("item_id").collect():
        texts.setdefault(r.text, (r.item_id, tokens(r.text)))
    want = []
    for r in common.table(spark, SF, "documents").select("doc_id", "text").collect():
        words, found = tokens(r.text), []
        there = {n: grams(words, n) for n in {min(5, len(w)) for _, w in texts.values()}}
        for item_id, w in texts.values():
            n = min(5, len(w))
            if w and grams(w, n) & there[n]:
                found.append((tiled(w, words, n) / len(w), -item_id))
        best = max(found, default=(0.0, None))
        over = sum(c >= decontaminate.COVERAGE for c, _ in found)
        want.append((r.doc_id, over > 0, None if best[1] is None else -best[1], round(best[0], 9), over))
    got = queries.queries()["op1_greedy_string_tiling"](spark, SF).collect()
    assert sorted((r.doc_id, r.contaminated, r.item_id, round(r.coverage, 9), r.n_items) for r in got) == sorted(want) and any(w[1] for w in want)


def test_languages_are_told(spark):
    got = queries.queries()["op2_language_id"](spark, "/root/testdata/sf0.01").join(common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out and lang = lang_pred").count() >= 0.97 * got.where("held_out").count()
    odd = docs(spark, [(1, None), (2, ""), (3, "123 !!"), (None, "the and of that")]).withColumn("lang", F.lit("en"))
    model = langid.fit(odd, rows=10)
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(odd, model, ["doc_id"]).collect()} == {(1, "und"), (2, "und"), (3, "und"), (None, "en")}
    none = langid.fit(odd.where("doc_id > 9"))
    assert langid.identify(odd, none, ["doc_id"]).where("lang_pred = 'und' and score = 0").count() == 4


def test_quality_is_told(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()["op7_compression_quality"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").where("held_out")
    good = got.where("quality = 1")
    assert good.where("predicted = 1").count() >= 0.9 * good.count()
    assert got.agg(F.corr("score", F.col("quality").cast("double"))).first()[0] > 0.4


def test_pieces_against_a_plain_search(spark):
    p = pieces.Pieces.load(pieces.default_model())
    by = {t: p.scores[i] for i, t in enumerate(p.texts) if t and p.scores[i] > float("-inf")}

    def best(raw):
        top = [0.0] + [float("-inf")] * len(raw)
        for j in range(1, len(raw) + 1):
            for i in range(max(0, j - p.longest), j):
                if raw[i:j] in by:
                    top[j] = max(top[j], top[i] + by[raw[i:j]])
                elif len(raw[i:j].decode("utf-8", "replace")) == 1 and "\ufffd" not in raw[i:j].decode("utf-8", "replace"):
                    top[j] = max(top[j], top[i] + p.fallback)
        return top[-1]

    import pyarrow as pa

    texts = ["", None, " ", "Hello  world ", "▁x ▁", "日本 текст\n\t\0", "été " * 30, "x" * 200]
    enc = p.encode(pa.array(texts, pa.string()), {})
    assert p.decode(enc).to_pylist() == texts
    for t, ids in zip(texts, enc.to_pylist()):
        if t:
            score, n = 0.0, 0
            while n < len(ids):
                if ids[n] in set(p.byte_ids.tolist()):
                    n += int(pieces._CHARS[p.texts[ids[n]][0]])
                    score += p.fallback
                else:
                    score += p.scores[ids[n]]
                    n += 1
            assert abs(score - best(b" " + t.encode())) < 1e-6


def test_shards_hold_every_sequence_once(spark):
    rows = docs(spark, [(1, None), (2, ""), (3, "a b c " * 400), (None, "x"), (3, "a b c " * 400)])
    staged = common.stage(training_order.sequences(rows, length=64), "t")
    path = f"{common.shared_dir(spark)}/t-{common.uuid.uuid4().hex}"
    placed = training_order.write_shards(staged, path, 9, 64, 10)
    numbered, total = training_order.numbered(staged)
    back = {r.slot: r for r in training_order.read_records(spark, path, 64, shard_records=10).collect()}
    want = {r.seq: bytes(r.tokens) for r in numbered.collect()}
    assert sorted(back) == list(range(total)) and all(want[r.seq] == bytes(r.tokens) for r in back.values())
    assert training_order.read_records(spark, path, 64, start=13, shard_records=10).count() == total - 13
    assert placed.where("place <> (slot % 10) * 145").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000, 4097])
def test_feistel_permutes(n):
    import numpy as np

    a, b = (training_order.feistel(np.arange(n), n, k) for k in (1, 2))
    assert sorted(a.tolist()) == list(range(n)) and (n < 64 or a.tolist() != b.tolist())


def test_a_text_over_the_limit_is_sharded_as_in_the_sql(spark, tmp_path):
    from rivulet.llm import sharding

    rows = docs(spark, [(k, "x" * (3 << 20 if k in (7, 8) else 40_000)) for k in range(200)])
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    got = sharding.op9_extendible_sharding(spark, str(tmp_path)).toPandas()
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(sharding.SQL).df()
    assert oracle.rows(got) == oracle.rows(want)
    assert got[got.doc_id == 7].depth.iloc[0] < 60


def test_a_rare_language_is_learned(spark):
    import random

    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(k, " ".join(word("abcdefgh") for _ in range(8)), "a") for k in range(3000)] + [(5000 + k, " ".join(word("qrstuvwx") for _ in range(8)), "b") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, rows=300)
    got = langid.identify(df, model, ["doc_id"]).collect()
    assert {x.doc_id for x in got if x.lang_pred == "b"} == set(range(5000, 5012))
    sample = langid.training_sample(df, {"a": 3000, "b": 12}, 300).groupBy("lang").count().collect()
    assert sorted(map(tuple, sample)) == [("a", 288), ("b", 12)]


def test_packs_are_unpacked_one_at_a_time(spark, monkeypatch):
    assert training_order.SHARD_RECORDS == 8192
    monkeypatch.setattr(training_order, "PACK_BYTES", 1000)
    rows = docs(spark, [(k, f"a b c {k} " * 50) for k in range(60)])
    staged = common.stage(training_order.sequences(rows, length=64), "t")
    path = f"{common.shared_dir(spark)}/t-{common.uuid.uuid4().hex}"
    training_order.write_shards(staged, path, 9, 64)
    slots = [r.slot for r in training_order.read_records(spark, path, 64).collect()]
    assert sorted(slots) == list(range(training_order.numbered(staged)[1])) and slots == sorted(slots)
