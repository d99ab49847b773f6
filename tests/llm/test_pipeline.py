"""The pipeline against plain versions of its stages, and odd documents."""

from pyspark.sql import functions as F

import corpus_pipeline
from rivulet.llm import common

from .test_joins import components
from .test_queries import cut

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = common.table(spark, SF, "documents")
    first = common.stage(corpus_pipeline.language(spark, docs, SF), "t")
    assert first.columns == docs.columns and first.count() >= 0.98 * docs.count()
    second = common.stage(corpus_pipeline.near_duplicates(spark, first, SF), "t")
    rows = [tuple(r) for r in first.select("doc_id", "text").collect()]
    assert {r.doc_id for r in second.collect()} == {d for d, _, c in components(rows, 5, 80, 100) if d == c}
    third = common.stage(corpus_pipeline.repeated_passages(spark, second, SF), "t")
    rows = [tuple(r) for r in second.select("doc_id", "text").collect()]
    assert {(d, n - k) for d, n, k, *_ in cut(rows, 100)} >= {(r.doc_id, len(r.text.encode())) for r in third.collect() if "�" not in r.text and len(r.text.encode()) == len(r.text)}
    fourth = common.stage(corpus_pipeline.benchmark_free(spark, third, SF), "t")
    items = [" ".join(r.text.lower().split()) for r in common.table(spark, SF, "benchmark").collect()]
    assert not [r.doc_id for r in fourth.collect() if any(i in " ".join(r.text.lower().split()) for i in items)]
    last = corpus_pipeline.token_ids(spark, fourth, SF)
    assert last.where("round_trip").count() == last.count() == fourth.count()


def test_odd_documents(spark):
    text = "the and of that with for this was are is the and of to in by "
    rows = [(1, text * 3, "en", 1), (2, None, None, 0), (3, "", "en", 0), (None, text * 4, "en", 2), (1, text * 3, "en", 1), (4, "12 34", "en", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").withColumns({"score": F.lit("s"), "kept": F.lit("k"), "lang_pred": F.lit("p")})
    for d in (docs, docs.where("doc_id > 99")):
        for name, stage in corpus_pipeline.STAGES:
            d = common.stage(stage(spark, d, SF), name)
            if name != "token_ids":
                assert d.columns == docs.columns
                assert d.where("score <> 's' or kept <> 'k' or lang_pred <> 'p'").count() == 0


def test_different_texts_under_one_id(spark):
    import random

    from rivulet.llm import jaccard

    r = random.Random(4)
    one, two, three = (" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(60)) for _ in range(3))
    rows = [(2, one), (5, two), (5, one), (7, two + " z"), (8, three), (8, three.upper()), (5, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = jaccard.similarity_components(docs, 5, 80, 100).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == [(2, 2), (5, 2), (5, 2), (5, 2), (7, 2), (8, 8), (8, 8), (9, 9)]
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    texts = [(r.doc_id, r.text.lower()) for r in kept.collect()]
    assert sorted(texts) == sorted([(2, one), (5, two), (8, three), (5, ""), (9, "")])
