"""From raw documents to token ids in five stages.

Each stage takes the documents that its predecessor kept, as a table, and its
decisions take effect: later stages see only what it left.  All but the last
return the columns of ``documents``.

Nulls and odd rows: texts that are null or have no letters are rejected by the
first stage; rows without a doc_id pass the stages that compare documents; an empty
table stays empty; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import common, decontaminate, jaccard, langid, pieces, suffixes

#: A language is accepted from this calibrated probability on.
CERTAIN = 0.5


def _without(docs: DataFrame, ids: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``docs`` whose doc_id is not among ``ids``; these are broadcast only if a count shows at most ``limit``."""
    right = F.broadcast(ids) if common.fits_broadcast(ids, limit) else ids
    return docs.join(right, "doc_id", "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; the classifier learns from the labelled rows of ``docs``."""
    model = langid.fit(docs.select("doc_id", "text", "lang").where("lang is not null"))
    mark = langid.identify(docs.withColumnsRenamed({"lang_pred": "_lang_pred", "score": "_score"}), model, [{"lang_pred": "_lang_pred", "score": "_score"}.get(c, c) for c in docs.columns])
    kept = mark.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= CERTAIN)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id.

    Different texts under one doc_id are different rows; where the smallest doc_id repeats in a group,
    the least SHA-256 of the text stays.
    """
    key = common.word_key()
    groups = common.stage(jaccard.row_components(docs.select("doc_id", "text"), 5, 80, 100, by_id=False, key=key).select("doc_id", "node", "comp", "component_id"), "groups")
    again = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return _without(docs, groups.where("doc_id <> component_id").select("doc_id").distinct())
    again = common.stage(again, "again")
    left = _without(docs, groups.where("doc_id <> component_id").select("doc_id").union(again).distinct()).select(*docs.columns)
    # rows of repeated ids are told apart by their sets of shingles
    sub = common.stage(docs.join(again, "doc_id", "left_semi").select("*", F.monotonically_increasing_id().alias("_row")), "repeated")
    sets = jaccard.token_sets(sub.select(F.col("_row").alias("doc_id"), "text"), 5, 80, 100, key).select(F.col("doc_id").alias("_row"), "node", "n_sh")
    sets = sub.select("_row", "doc_id", F.sha2("text", 256).alias("sha")).join(sets, "_row")
    found = sets.join(groups.where("doc_id = component_id and comp is not null").select("doc_id", "node", "comp").distinct(), ["doc_id", "node"])
    first = found.groupBy("comp").agg(F.min(F.struct("doc_id", "sha", "_row")).alias("x")).select("x._row")
    kept = first.unionByName(sets.where("n_sh = 0").select("_row"))
    return left.unionByName(sub.join(kept, "_row", "left_semi").select(*docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings of 100 that start earlier; parts of characters that a cut leaves go too."""
    keep = [c for c in docs.columns if c != "text"]
    names = {c: f"_{c}" for c in ("n_bytes", "n_removed", "n_spans") if c in keep}
    done = suffixes.kept_bytes(docs.withColumnsRenamed(names), [names.get(c, c) for c in keep], text="text")
    out = done.drop("n_bytes", "n_removed", "n_spans").withColumnsRenamed({v: k for k, v in names.items()})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold half or more of a benchmark item."""
    bench = common.table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate.coverage(docs.select("doc_id", "text"), bench)
    bad = common.stage(found.where(F.col("coverage") >= decontaminate.COVERAGE).select("doc_id").distinct(), "contaminated")
    return _without(docs, bad).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, their number, and whether they decode to the text again."""
    return pieces.encoded_and_checked(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark_free),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return docs
