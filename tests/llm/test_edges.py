"""Built-up collisions, odd rows, clashing columns and empty tables of the corpus operators, and whole queries against plain versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import common, conversations, decontaminate, jaccard, langid, pieces, quality, sharding, suffixes, topk, training_order

from .test_joins import components
from .test_queries import SF, cut, docs, tiled


def thue_morse(n, a="a", b="b"):
    """A word and its complement; polynomials modulo a power of two cannot tell them apart from 1,024 letters on."""
    w = a
    while len(w) < n:
        w += w.translate(str.maketrans(a + b, b + a))
    return w, w.translate(str.maketrans(a + b, b + a))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_of_one_polynomial(spark, n):
    x, y = thue_morse(n)
    got = pieces.encoded_and_checked(docs(spark, [(1, f"{x} {y}")])).first()
    assert got.round_trip
    rows = [(1, f"{x} {x} {x} {x}"), (2, f"{y} {y} {y} {y}"), (3, f"{x} {x} {x} {x}")]
    assert [tuple(r) for r in jaccard.similarity_components(docs(spark, rows), 3, 90, 100).orderBy("doc_id").collect()] == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]
    bench = spark.createDataFrame([(1, " ".join([x] * 6))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(docs(spark, [(1, " ".join([x] * 6)), (2, " ".join([y] * 6))]), bench).where("contaminated").collect()} == {1}


def test_words_are_told_by_their_bytes():
    words = ["a", "b", "ab", "ba", "abcdefgh", "abcdefghi", "abcdefghj", "a\0", "é", "x" * 64, "x" * 65, "y" * 300]
    h, at = common.word_hashes(pa.array([" ".join(words), None, "", "A  \tB\n"]))
    assert len(set(h[: len(words)].tolist())) == len(words) and at.tolist() == [0, len(words), len(words), len(words), len(words) + 2]
    assert h[-2:].tolist() == h[:2].tolist()
    plain, _ = common.word_hashes(pa.array(["a,b! AB-é"]), common.PLAIN)
    assert plain.tolist() == [h[0], h[1], h[2], h[8]]


@pytest.mark.parametrize("n, num, small", [(3, 90, 10), (5, 80, 10), (3, 90, 160)])
def test_components_of_near_copies_that_do_not_link(spark, n, num, small, monkeypatch):
    """Many copies with a few edits each share nearly all tokens; large ones meet by neighbours, small ones by pairs."""
    monkeypatch.setattr(jaccard, "FREQUENT", 2)
    monkeypatch.setattr(jaccard, "SMALL", small)
    r = random.Random(num + small)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(70):
        w = base[: r.choice([120, 120, 118, 112])]
        for _ in range(r.randint(1, 5)):
            w = [*w]
            w[r.randrange(len(w))] = f"x{r.randint(0, 5)}"
        rows.append((k, " ".join(w)))
    long = [f"v{r.randint(0, 10**9)}" for _ in range(20_000)]
    rows += [(100, " ".join(long)), (101, " ".join(long[:-300])), (102, " ".join(long[: len(long) // 2]))]
    got = jaccard.similarity_components(docs(spark, rows).withColumn("node", F.lit("x")).withColumn("toks", F.lit(1)), n, num, 100).collect()
    assert sorted(map(tuple, got), key=str) == components(rows, n, num, 100)


def test_every_similar_pair_shares_an_entry():
    """The index alone, over random sets with skewed tokens: no similar pair is without a common key that both sides may use."""
    r = random.Random(8)
    for num, den in ((90, 100), (80, 100), (60, 100)):
        sets = []
        for _ in range(12):
            base = r.sample(range(400), r.randint(6, 150))
            for _ in range(8):
                s = set(base)
                for _ in range(r.randint(0, 8)):
                    s.discard(r.choice(base))
                    s.add(r.randint(0, 420))
                sets.append(s)
        count = {t: sum(t in s for s in sets) for t in range(421)}
        for small in (5, 60, 1000):
            index = []
            jaccard.SMALL, old = small, jaccard.SMALL
            for s in sets:
                toks = sorted((count[t], t) for t in s if count[t] > 1)
                index.append(dict(jaccard.index_entries(len(s), np.array([t for _, t in toks], np.int64), np.array([c for c, _ in toks]), num, den)))
            jaccard.SMALL = old
            for i, x in enumerate(sets):
                for j in range(i):
                    y, k = sets[j], len(x & sets[j])
                    if x != y and den * k >= num * (len(x) + len(y) - k):
                        assert any((den + num) * min(f, index[j].get(key, -1)) >= num * (len(x) + len(y)) for key, f in index[i].items())


def test_parity_bits_never_say_too_much():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 300, n)) for n in (0, 1, 40, 90, 90, 200)]
    for width in (jaccard.NARROW, jaccard.WIDE):
        bits = np.unpackbits(jaccard._bits(sets, width).view(np.uint8), axis=1)
        assert bits.shape == (6, width) and all((bits[i] != bits[j]).sum() <= len(np.setxor1d(sets[i], sets[j])) for i in range(6) for j in range(6))


def test_tiles_of_long_items():
    r = random.Random(13)
    for case in range(250):
        x, y = ([r.randint(0, 2 + case % 4) for _ in range(r.randint(30, n))] for n in (60, 90))
        if case % 3 == 0:
            y = y[:20] + x[10:40] + y[20:] + x[:25]
        tiles = decontaminate.tile(np.array(x, np.uint64), np.array(y, np.uint64), 3 + case % 3)
        assert sum(k for *_, k in tiles) == tiled(x, y, 3 + case % 3)


def test_contamination_against_all_pairs(spark):
    r = random.Random(2)
    word = lambda: r.choice("abcdefgh") * r.randint(1, 3)
    items = [(i, " ".join(word() for _ in range(r.randint(3, 40)))) for i in range(12)]
    rows = []
    for d in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        if d % 2:
            part = r.choice(items)[1].split()
            at = r.randint(0, len(w))
            w[at:at] = part[len(part) // 2 :] + [word()] + part[: len(part) // 2]
        rows.append((d, " ".join(w)))
    want = {}
    for d, t in rows:
        for i, s in items:
            x, y = s.split(), t.split()
            k = tiled(x, y, min(decontaminate.MIN_TILE, len(x)))
            if k:
                want[d, i] = round(k / len(x), 9)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("seed", F.lit(1))
    got = {(x.doc_id, x.item_id): round(x.coverage, 9) for x in decontaminate.coverage(docs(spark, rows).withColumn("item_id", F.lit(7)), bench).collect()}
    assert got == want


def test_a_repeated_row_is_no_repeat(spark):
    r = random.Random(1)
    text = " ".join(str(r.randint(0, 10**6)) for _ in range(60))
    x = docs(spark, [(1, text), (1, text), (2, text), (3, "é" + text)]).withColumn("start", F.lit(5))
    got = sorted((a.doc_id, a.n_bytes, a.n_removed) for a in suffixes.kept_bytes(x, ["doc_id", "start"]).collect())
    n = len(text)
    assert got == [(1, n, 0), (1, n, 0), (2, n, n), (3, n + 2, n)]
    many = [(k, text + str(k % 9)) for k in range(300)]
    got = suffixes.kept_bytes(docs(spark, many), ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == cut(many, 100)


def test_huge_and_clashing_vectors(spark):
    rows = [(1, [1e30, 0.0]), (2, [1e30, 1.0]), (3, [-1e30, 2.0]), (4, [0.25, 3.0])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "v": F.lit(2)}))
    assert v.where("vec_id = 1").first().v[0] == 64e30
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(v, v, 2).collect()}
    assert got[1, 1] == (2, 2**63 - 1) and got[3, 1] == (1, -(2**63)) and got[4, 1][0] == 1
    few = topk.integer_vectors(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "vec_id long, embedding array<double>"))
    got = sorted(map(tuple, topk.exact_top_k(few.where("vec_id = 4"), few, 20).collect()))
    assert got == [(4, k + 1, 3 - k, 4 * 64 * (3 - k) * 64 + 64 * 64) for k in range(4)]


def test_sums_between_doubles_and_the_long_range(spark):
    """Products of 60 bits: doubles would round them, and two lists still add up."""
    r = random.Random(9)
    rows = [(i, [float(r.randint(-(2**23), 2**23) * 64) for _ in range(5)]) for i in range(30)]
    rows += [(100, rows[0][1]), (101, [rows[0][1][0] + 64.0, *rows[0][1][1:]])]
    v = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scale=1)
    got = topk.exact_top_k(v.where("vec_id % 10 = 0"), v, 6, row_block=12).collect()
    want, big = [], 0
    for q, x in rows:
        if q % 10 == 0:
            s = sorted((-sum(int(a) * int(b) for a, b in zip(x, y)), i) for i, y in rows if i != q)
            want += [(q, k + 1, i, -n) for k, (n, i) in enumerate(s[:6])]
            big = max(big, -s[0][0])
    assert sorted(map(tuple, got)) == sorted(want) and big > 2**53


def test_sequences_of_the_table_as_a_plain_tokeniser_packs_them(spark):
    import tiktoken

    ranks, pattern = training_order._encoder(training_order.default_vocabulary())
    enc = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    got = sorted(training_order.op6_training_order(spark, SF).collect(), key=lambda r: r.seq)
    table = common.table(spark, SF, "documents").select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
    n, want = training_order.SEQUENCE, []
    for p in sorted({r.p for r in table}):
        tokens, owner = [], []
        for r in table:
            if r.p == p:
                t = [*enc.encode_ordinary(r.text or ""), training_order.END_TOKEN]
                tokens += t
                owner += [r.doc_id] * len(t)
        for a in range(0, len(tokens), n):
            piece = tokens[a : a + n] + [training_order.END_TOKEN] * (a + n - len(tokens))
            want.append((hashlib.sha256(np.array(piece, "<u2").tobytes()).hexdigest(), list(dict.fromkeys(owner[a : a + n]))))
    assert [(r.tokens_sha256, r.doc_ids) for r in got] == want
    slots = training_order.feistel(np.arange(len(want)), len(want), 20240229).tolist()
    assert [(r.slot, r.shard, r.place) for r in got] == [(s, s // 8192, s % 8192 * training_order.stride()) for s in slots]


def test_no_records_of_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert training_order.op6_training_order(spark, str(tmp_path)).count() == 0


def test_shards_beside_columns_of_their_names(spark):
    rows = [(k, "x" * 30, k, k, k, k, k, k) for k in range(40)] + [(7, "y" * 300, 0, 0, 0, 0, 0, 0)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long, shard_in long, _rows long, _cut long, cell long, depth long")
    got = sharding.extendible_shards(df, "doc_id", F.octet_length("text"), 200)
    assert got.count() == 42 and got.where("shard_in_in is null or shard_in is null or _rows_in is null").count() == 0
    keyed = sharding.extendible_shards(df, "shard", F.octet_length("text"), 200)
    assert keyed.count() == 42 and keyed.where("shard_bytes > 200").count() == 2


def plain_buckets(t):
    """Buckets of all n-grams of a text, one by one."""
    chars, last, out = [], False, []
    for c in (t or "").lower():
        if c.isalpha():
            chars.append(c)
        elif last:
            chars.append(" ")
        last = c.isalpha()
    for size in (1, 2, 3):
        for i in range(len(chars) - size + 1):
            h = ord(chars[i])
            for c in chars[i + 1 : i + size]:
                h = (h * 0x100000001B3 + ord(c)) % 2**64
            out.append(int(common.mix(np.array([(h + (size << 56)) % 2**64], np.uint64))[0] >> np.uint64(48)))
    return out


def test_scores_of_a_small_language_model(spark):
    model = langid.Model(["a", "b"], np.random.default_rng(5).normal(0, 3, (2, langid.BUCKETS)).astype(np.float32), np.array([0.2, -0.1]))
    texts = ["Hello wörld 12 x", "", None, "日本語 text", "z" * 100_000, "ab " * 3, "--", "ends in letters", "(starts otherwise", "x", "1 y"]

    def plain(t):
        at = plain_buckets(t)
        if not at:
            return "und", 0.0
        p = np.exp(sum(model.table[:, b].astype(float) for b in at) / len(at) + model.bias)
        p /= p.sum()
        return model.langs[int(p.argmax())], float(p.max())

    df = docs(spark, list(enumerate(texts))).withColumns({"score": F.lit("s"), "lang_pred": F.lit("l")})
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, model, ["doc_id", "score"]).collect()}
    for i, t in enumerate(texts):
        lang, score = plain(t)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-6


def plain_fit(rows, epochs=3):
    """Follow-the-regularised-leader over one weight at a time, and the temperature by trying the grid."""
    from math import exp, log, sqrt

    langs = sorted({lang for *_, lang in rows if lang})
    texts = [plain_buckets(t) for _, t, _ in rows]
    df = {}
    for b in (b for bs in texts for b in set(bs)):
        df[b] = df.get(b, 0) + 1
    idf = lambda b: log((1 + len(rows)) / (1 + df[b])) + 1
    data = []
    for lang, bs in sorted(((lang, t or ""), plain_buckets(t)) for _, t, lang in rows if lang):
        if bs:
            data.append(({**{b: bs.count(b) / len(bs) * idf(b) * 50 for b in sorted(set(bs))}, "bias": 1.0}, langs.index(lang[0])))
    order = np.random.default_rng(7).permutation(len(data))
    held, used = [data[i] for i in order[::5]], [data[i] for k, i in enumerate(order) if k % 5]
    z, n = {}, {}

    def weight(b, k):
        x = z.get((b, k), 0.0)
        return 0.0 if abs(x) <= 0.02 else -(x - (0.02 if x > 0 else -0.02)) / ((0.1 + sqrt(n[b, k])) / 0.5 + 0.05)

    def shares(s):
        e = [exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    logits = lambda x: [sum(v * weight(b, k) for b, v in x.items()) for k in range(len(langs))]
    for x, y in used * epochs:
        p = shares(logits(x))
        for k in range(len(langs)):
            for b, v in x.items():
                g, old, w = v * (p[k] - (k == y)), n.get((b, k), 0.0), weight(b, k)
                n[b, k] = old + g * g
                z[b, k] = z.get((b, k), 0.0) + g - (sqrt(n[b, k]) - sqrt(old)) / 0.5 * w
    found = [(logits(x), y) for x, y in held]
    # the sample holds every row, so all languages weigh the same
    loss = lambda t: -sum(log(max(shares([v / t for v in s])[y], 1e-12)) for s, y in found)
    t = min(np.geomspace(0.05, 20, 121), key=loss)
    return langs, {(b, k): weight(b, k) * idf(b) * 50 / t for b, k in z if b != "bias"}, [weight("bias", k) / t - log(len(langs)) for k in range(len(langs))]


def test_the_fit_of_a_small_language_model(spark):
    r = random.Random(12)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 5)))
    kinds = {"a": "abcdexyz", "b": "cdefgxyz", "c": "efghiéz"}
    rows = [(k, " ".join(word(kinds[lang]) for _ in range(r.randint(1, 6))), lang) for k in range(75) for lang in ["abc"[k % 3]]]
    rows += [(100, None, "a"), (101, "", "b"), (102, "12 --", "c"), (103, rows[0][1], None), (104, rows[1][1], "b")]
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    before = spark.conf.get(key)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    langs, table, bias = plain_fit(rows)
    want = np.zeros((3, langid.BUCKETS))
    for (b, k), w in table.items():
        want[k, b] = w
    assert model.langs == langs and np.allclose(model.table, want, rtol=1e-4, atol=1e-6) and np.count_nonzero(want)
    assert np.allclose(model.bias, bias, rtol=1e-6) and spark.conf.get(key) == before


def test_junk_languages_do_not_widen_the_model(spark):
    rows = [(k, "some words of one language", "a") for k in range(9)] + [(20 + k, "other letters qqq zzz", "b") for k in range(6)]
    rows += [(100 + k, f"junk {k}", f"junk-{k:03d}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df, languages=2).langs == ["a", "b"]
    assert langid.fit(df, languages=3).langs == ["a", "b", "junk-000"]


def test_scores_of_a_small_quality_model(spark):
    import zstandard

    r = random.Random(4)
    word = lambda letters: "".join(r.choice(letters) for _ in range(6))
    rows = [(k, " ".join(word("abcdef") if k % 2 else word("uvwxyz") for _ in range(40))) for k in range(120)]
    labels = spark.createDataFrame([(k, k % 2, 1) for k in range(120)] + [(5, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, label int, text int")
    model = quality.fit(docs(spark, rows), labels)
    odd = [(200, None), (201, ""), (None, "abc"), (202, "a" * 300_000), (1, rows[1][1]), (1, rows[1][1])]
    df = docs(spark, rows + odd).withColumns({"score": F.lit("s"), "predicted": F.lit("p")})
    got = quality.classify(df, model, ["doc_id", "score"]).collect()
    assert len(got) == 126 and got[120].score == got[121].score
    size = lambda d, t: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(t.encode()))
    for g, (_, t) in list(zip(got, rows, strict=False))[:20]:
        b, a = size(model.bad, t), size(model.good, t)
        assert abs(g.score - 1 / (1 + np.exp(-(model.slope * (b - a) / (a + b) + model.offset)))) < 1e-6
        assert (g.score > 0.5) == bool(g.doc_id % 2)
    none = quality.fit(docs(spark, rows), labels.where("doc_id < 0"))
    assert {x.score for x in quality.classify(docs(spark, rows), none, ["doc_id"]).collect()} == {0.5}
    assert quality.classify(docs(spark, []), model, ["doc_id"]).count() == 0


def test_the_training_sample_is_fetched_by_its_own_tasks(spark):
    """Labelled texts are read in parallel; only the bounded sample goes to one task."""
    labels = spark.createDataFrame([(1, 1)], "doc_id long, label int")
    seen = []
    old = common.in_one_task
    quality.common.in_one_task = lambda df, fn, schema: seen.append(old(df, fn, schema)) or seen[-1]
    try:
        quality.fit(common.table(spark, SF, "documents"), labels)
    finally:
        quality.common.in_one_task = old
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and "REPARTITION_BY_NUM" in plan


def test_pieces_of_the_table_give_its_texts_back(spark):
    got = {r.doc_id: r for r in pieces.op8_sentencepiece(spark, SF).collect()}
    p = pieces.Pieces.load(pieces.default_model())
    table = common.table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(table)
    for r in table:
        g = got[r.doc_id]
        assert g.round_trip and g.n_pieces == len(g.ids or []) and b"".join(p.texts[i] for i in g.ids or [])[1:] == (r.text or "").encode()


def test_odd_conversations(spark):
    kind = "conv_id long, turn long, role string, text string, node string"
    rows = [(None, 1, "user", "x", "n"), (1, 1, "user", "a", "n"), (1, 1, "user", "b", "n"), (1, 2, "assistant", None, "n"), (2, None, "user", "z", "n"), (3, 1, None, "r" * 100_000, "n")]
    df = spark.createDataFrame(rows, kind)
    out = conversations.format_paths(conversations.thread(df)).withColumn("t", conversations.read_back(F.col("formatted"))).collect()
    found = {r.conv_id: [x.text for x in r.t] for r in out}
    assert sorted(found[1][:2]) == ["a", "b"] and found[1][2] == "" and found[3] == ["r" * 100_000]
    assert conversations.format_paths(conversations.thread(df.where("conv_id > 9"))).count() == 0


def same_digest(mask=(1 << 64) - 1):
    """Two different words of 16 letters that an unkeyed chain of public bijections over eight bytes at a time cannot tell apart."""
    m = lambda h: int(common.mix(np.array([h], np.uint64))[0])
    start, r = m((16 * 0xD6E8FEB86659FD93 + 1) & mask), random.Random(1)
    letters = b"abcdefghijklmnopqrstuvwxyz"
    plain = lambda v: all(97 <= b <= 122 for b in v.to_bytes(8, "little"))
    heads: dict[int, int] = {}
    # the second halves differ by what the first halves make; high bits of a byte of a letter are alike, so heads are sorted by these
    for _ in range(400_000):
        head = int.from_bytes(bytes(r.choices(letters, k=8)), "little")
        left = m(start ^ head)
        other = heads.setdefault(left & 0xE0E0E0E0E0E0E0E0 & 0xFFFF_FFFF_FFFF_FFFF, head)
        if other != head:
            apart = m(start ^ other) ^ left
            tail = int.from_bytes(b"mmmmmmmm", "little")
            for t in (tail, int.from_bytes(b"hhhhhhhh", "little"), int.from_bytes(b"pppppppp", "little"), int.from_bytes(b"eeeeeeee", "little"), int.from_bytes(b"ssssssss", "little")):
                if plain(t ^ apart):
                    return (head.to_bytes(8, "little") + (t ^ apart).to_bytes(8, "little")).decode(), (other.to_bytes(8, "little") + t.to_bytes(8, "little")).decode()
    return None


CRAFTED = [("pfzfigsaadaabaaa", "pphtbiyjnxctxzws")]


@pytest.mark.parametrize("x, y", CRAFTED + [p for p in [same_digest()] if p])
def test_words_built_to_have_one_digest(spark, x, y):
    import corpus_pipeline

    rows = [(1, " ".join([x] * 30)), (2, " ".join([y] * 30)), (3, " ".join([x] * 30)), (4, " ".join([x, y] * 40)), (5, " ".join([y, x] * 40))]
    for n, num in ((3, 90), (5, 80)):
        got = jaccard.similarity_components(docs(spark, rows), n, num, 100).collect()
        assert sorted(map(tuple, got), key=str) == components(rows, n, num, 100)
    bench = spark.createDataFrame([(1, " ".join([y] * 6))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contamination(docs(spark, rows[:3]), bench).where("contaminated").collect()} == {2}
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows[:3]), "").collect()} == {1, 2}


def test_equal_digests_are_told_apart_by_words(spark, monkeypatch):
    """Even digests that are all alike for two words link nothing and tile nothing."""
    real = common.word_hashes
    twin = lambda col, table=common.SPACED, key=b"": real(pa.array([None if t is None else t.replace("right", "wrong") for t in col.to_pylist()]), table, b"")
    monkeypatch.setattr(common, "word_hashes", twin)
    text = [f"w{i}" for i in range(60)]
    a, b = pa.array([" ".join(["right", *text])]), pa.array([" ".join(["wrong", *text])])
    assert jaccard._sets(a, 3, b"")[0].tolist() == jaccard._sets(b, 3, b"")[0].tolist()
    (x,), (y,) = jaccard._word_sets(3, a, b)
    assert len(x) == len(y) == 59 and len(np.intersect1d(x, y)) == 58
    (p, _), (q, _) = decontaminate._tokens(a, b)
    assert p[0] != q[0] and (p[1:] == q[1:]).all()


def test_shingle_numbers_of_any_length():
    r = random.Random(2)
    rows = [[r.randint(0, 4) for _ in range(r.randint(0, 12))] for _ in range(40)]
    code, offs = np.array([w for x in rows for w in x]) * 10**7, np.cumsum([0, *map(len, rows)])
    for n in (1, 2, 3, 5, 9):
        got, at = common.shingle_numbers(code, offs, n)
        want = [tuple(x[i : i + n]) for x in rows for i in range(max(len(x) - n + 1, min(1, len(x))))]
        assert len(got) == len(want) == at[-1]
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(got.tolist())) == len(set(want))
