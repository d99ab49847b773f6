"""Packing against a plain tokenizer and plain best fit over documents."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rivulet.llm import common, packing, queries

from .test_queries import SF, docs

TEXTS = [
    None, "", " \n\t ", "one", "One  one two three", "it's we'll 'S", "<|endoftext|>x <|startoftext|>", "é ́a ΣΣ ÅÅ", "a" * 5000, "x y " * 3000,
    "\x1c\x85​ mixed\x0bvertical\x0cfeed", "日本語 テキスト 12345", "🙂🙂 🙂", "b \0 c",
]


def plain(rows, limit):
    """{(doc_id, piece): (start, length, checksum)} by encoding whole texts."""
    from tokenizers import Tokenizer

    tok, out = Tokenizer.from_file(packing.default_tokenizer()), {}
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for a in range(0, len(ids), limit):
            part = np.array(ids[a : a + limit], "<u4")
            out[d, a // limit] = (a, len(part), zlib.crc32(part.tobytes()))
    return out


def fitted(lengths, limit):
    """Number of sequences of best fit decreasing, piece by piece."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= x]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - x)
        else:
            room.append(limit - x)
    return len(room)


def gapless(rows, limit):
    """True if the pieces (sequence, offset, length) lie end to end from 0 in each sequence."""
    at = {}
    for s, o, n in sorted(rows):
        if o != at.get(s, 0) or o + n > limit:
            return False
        at[s] = o + n
    return True


def test_the_whole_query(spark):
    got = queries.queries()["op11_best_fit_packing"](spark, SF).collect()
    rows = [tuple(r) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = plain(rows, packing.LIMIT)
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert gapless([(r.sequence_id, r.offset, r.length) for r in got], packing.LIMIT)
    assert len({r.sequence_id for r in got}) == fitted([n for _, n, _ in want.values()], packing.LIMIT)


@pytest.mark.parametrize("limit", [1, 7, 64])
def test_odd_texts(spark, limit):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    frame = docs(spark, rows).withColumn("part", F.lit("x")).withColumn("length", F.lit(1)).repartition(3)
    got = packing.pack(frame, limit=limit).collect()
    want = plain(rows, limit)
    assert {(r.doc_id, r.piece): (r.start, r.length, zlib.crc32(bytes(r.ids))) for r in got} == want and len(got) == len(want)
    assert gapless([(r.sequence_id, r.offset, r.length) for r in got], limit)
    assert len({r.sequence_id for r in got}) == fitted([n for _, n, _ in want.values()], limit)


def test_sequences_repeats_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d"), (2, None), *[(9, "same words here")] * 50]
    packed = packing.pack(docs(spark, rows), limit=8)
    packed = common.stage(packed, "packed")
    assert packed.count() == len(rows) and packed.where("doc_id is null").count() == 1
    whole = packing.sequences(packed).collect()
    assert sum(len(s.ids) for s in whole) == 4 * packed.agg(F.sum("length")).first()[0]
    for s in whole:
        assert 4 * s.ends[-1] == len(s.ids) <= 32 and len(s.doc_ids) == len(s.ends)
    assert packing.pack(docs(spark, [])).count() == 0


def test_plan_equals_best_fit_decreasing():
    r = random.Random(3)
    for _ in range(60):
        limit = r.choice([5, 16, 50])
        counts = {n: r.choice([0, 1, 2, 9, 400]) for n in r.sample(range(1, limit + 1), r.randint(1, limit))}
        counts = {n: c for n, c in counts.items() if c}
        steps = packing.plan(counts, limit)
        slots, ranks = [], {}
        for n, rank, number, first, each, offset in steps:
            assert rank == ranks.get(n, 0)
            ranks[n] = rank + number
            slots += [(first + i // each, offset + i % each * n, n) for i in range(number)]
        assert ranks == counts and gapless(slots, limit)
        assert len({s for s, _, _ in slots}) == fitted([n for n, c in counts.items() for _ in range(c)], limit)
    big = packing.plan({n: 10**9 + n for n in range(1, 2049)}, 2048)
    assert len(big) < 4 * 2048 * 11


def test_units_give_the_ids_of_whole_texts():
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        model = f.read()
    encoder, plain_, r = packing.Encoder(model), Tokenizer.from_str(model), random.Random(1)
    signs = [*"abzAZ019 '<>|_-.,\n\t\x0b\x1c\x1f\x7f\0sStTreRElLdDmM", *"éÉ́Σİß日 \x85٣½🙂​Å０", "'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    for fine in (True, False):
        encoder.fine, encoder.known = fine, {}
        ids, at = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in plain_.encode_batch(texts, add_special_tokens=False)]


def test_small_letters_skip_normalizers_and_cuts():
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    whole, asked, r = encoder.tokenizer, [], random.Random(2)

    class Seen:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return whole.encode_batch_fast(texts, **more)

    encoder.tokenizer = Seen()
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.choice([1, 2, 5, 9, 64, 65]))) for _ in range(5000)]
    for texts, seen in ((words, {w for w in words if len(w) > packing.LONG_UNIT}), (["Words, WORDS 1x"], {", 0 1 0 "}), (["éa", "w</w>", "</w>"], {"éa 0 ", "w</w>", "</w>"})):
        asked.clear()
        ids, at = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in whole.encode_batch(texts, add_special_tokens=False)]
        assert set(asked) == seen
