"""Language identification with a sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three letters,
runs of other characters count as one blank).  Document frequencies are counted over
every training row; the regression is trained on a bounded sample of labelled
rows with follow-the-regularised-leader and elastic-net penalties, and a
temperature, fitted on sample rows that the weights have not seen, calibrates
the probabilities.

Scoring is one narrow pass: a table lookup per n-gram and a sum per text, over
whole texts in slices, with a model of fixed width.
"""

from __future__ import annotations

import contextlib
import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: Bounds of the training sample: its rows, and the languages that are learned, the most frequent ones.  With more than
#: 24 of these, each still has places for ``LEAST_ROWS``, so that it never takes more than 25,600 rows.
TRAIN_ROWS, TRAIN_LANGUAGES = 2400, 256
LEAST_ROWS = 100
UNKNOWN = "und"
_SCALE = 50.0


@functools.cache
def _letters() -> np.ndarray:
    t = np.zeros(0x110000, bool)
    t[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
    return t


def _grams(texts: list[str | None]):
    """Yield (bucket index of every n-gram, offsets by text) for each order, and letters by text at last."""
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in low])
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.concatenate([[0], np.cumsum(size)])
    alpha = _letters()[np.minimum(cp, 0x10FFFF)] if len(cp) else np.zeros(0, bool)
    after = np.append(False, alpha[:-1])[: len(alpha)]
    after[ends[:-1][size > 0]] = False
    keep = alpha | after  # one blank after each run of letters, of the same text
    row = np.repeat(np.arange(len(low)), size)[keep]
    c = np.where(alpha, cp, 32)[keep].astype(np.uint64)
    offs = np.searchsorted(row, np.arange(len(low) + 1))
    letters = np.add.reduceat(np.append(alpha, False).astype(np.int64), np.minimum(ends[:-1], len(alpha))) * (size > 0) if len(low) else size
    h = np.zeros(len(c), np.uint64)
    out = []
    for n in range(1, max(ORDERS) + 1):
        if n > len(c):
            break
        h = (h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :]) if n > 1 else c
        if n in ORDERS:
            same = row[: len(c) - n + 1] == row[n - 1 :]
            idx = (common.mix(h + np.uint64(n << 56)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[same]
            out.append((idx, np.searchsorted(row[: len(c) - n + 1][same], np.arange(len(low) + 1))))
    return out, letters


def _by_text(texts):
    """(all bucket indexes, offsets) with the orders of each text together."""
    parts, letters = _grams(texts)
    for i in range(len(texts)):
        got = [idx[o[i] : o[i + 1]] for idx, o in parts]
        yield np.concatenate(got) if got else np.zeros(0, np.int64), letters[i]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(number of texts that hold each bucket, number of texts) over all rows."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for part in common.slices(batch):
                for idx, _ in _by_text(part.column(0).to_pylist()):
                    seen = np.zeros(BUCKETS, bool)
                    seen[idx] = True
                    df += seen
                    n += 1
        at = np.flatnonzero(df)
        yield pa.record_batch({"bucket": np.append(at, -1), "n": np.append(df[at], n)})

    common.small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS)
    inner = rows[rows.bucket >= 0]
    out[inner.bucket.to_numpy()] = inner.n.to_numpy()
    return out, int(rows.n[rows.bucket < 0].sum())


class FTRL:
    """Per-coordinate FTRL-proximal for softmax regression; L1 zeroes weights, L2 shrinks the others."""

    def __init__(self, coordinates: int, classes: int, alpha: float = 0.5, beta: float = 0.1, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros((coordinates, classes)), np.zeros((coordinates, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        old = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - old) / self.alpha * w


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language: weight times idf and scale, divided by the temperature
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts, letters = _grams(texts)
        n = np.zeros(len(texts))
        s = np.zeros((len(texts), len(self.langs)))
        for idx, offs in parts:
            n += np.diff(offs)
            for k in range(len(self.langs)):
                run = np.concatenate([[0.0], np.cumsum(self.table[k][idx], dtype=np.float64)])
                s[:, k] += run[offs[1:]] - run[offs[:-1]]
        p = _softmax(s / np.maximum(n, 1)[:, None] + self.bias) if self.langs else np.zeros((len(texts), 1))
        best = p.argmax(axis=1)
        ok = (letters > 0) & bool(self.langs)
        return [self.langs[b] if g else UNKNOWN for b, g in zip(best, ok, strict=True)], np.where(ok, p.max(axis=1), 0.0)


def share_out(counts: list[int], rows: int) -> int:
    """Most rows of each language so that all together take ``rows``; what small ones leave goes to the others."""
    left, counts = rows, sorted(counts)
    for i, c in enumerate(counts):
        each = left // (len(counts) - i)
        if c > each:
            return max(each, min(rows, LEAST_ROWS))
        left -= c
    return max(counts, default=0)


def training_sample(labelled: DataFrame, counts: dict[str, int], rows: int) -> DataFrame:
    """(lang, text) of the rows with the smallest id hashes of each language of ``counts``, as many as ``share_out`` gives."""
    most = share_out(list(counts.values()), rows)
    first = Window.partitionBy("lang").orderBy("_h")
    x = labelled.where(F.col("lang").isin(list(counts))).select("lang", "text", F.xxhash64("doc_id", "text").alias("_h"))
    # the bounds come from hashes alone, so few texts are sorted
    ends = x.select("lang", "_h").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).groupBy("lang").agg(F.max("_h").alias("_end"))
    x = x.join(F.broadcast(ends), "lang").where(F.col("_h") <= F.col("_end"))
    return x.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select("lang", "text")


@contextlib.contextmanager
def _ranks_cut_early(spark: SparkSession, most: int):
    """Ranks of up to ``most`` are cut before the exchange in the statements inside."""
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, max(int(old), most))
        yield
    finally:
        spark.conf.set(key, old)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS, epochs: int = 3, languages: int = TRAIN_LANGUAGES) -> Model:
    """Train on (doc_id, text, lang).

    The ``languages`` most frequent values of lang are learned (ties by name), so that junk values do not widen the
    model; document frequencies count every row.
    The sample is bounded by ``rows``, or ``LEAST_ROWS`` for each language if that is more, and dealt out evenly to the languages, so that a
    rare one is learned too; in each it is the labelled rows with the smallest id hash, so it is
    the same on every run.  It is trained on in one task, and weights come back; the bias and the
    temperature are corrected to the true shares of the languages.
    Weights are kept for the buckets that occur in the sample, and those that the penalty leaves come back.
    Every fifth row of it is kept for the temperature.  Without any labelled row
    with letters the model knows no language.
    """
    df, total = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + df)) + 1
    top = labelled.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    counts = {r.lang: r["count"] for r in top.collect()}
    sample = training_sample(labelled, counts, rows)

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["lang", "text"], na_position="first", ignore_index=True)
        langs = sorted(pdf.lang.unique())
        true = np.array([counts[k] for k in langs], float)
        weight = true / pdf.lang.value_counts().reindex(langs).to_numpy()
        weight /= weight.sum()
        data = []
        for lang, text in zip(pdf.lang, pdf.text, strict=True):
            for idx, _ in _by_text([text]):
                at, c = np.unique(idx, return_counts=True)
                if len(at):
                    data.append((np.append(at, BUCKETS), np.append(c / c.sum() * idf[at] * _SCALE, 1.0), langs.index(lang)))
        places = np.unique(np.concatenate([[BUCKETS], *(at for at, *_ in data)]).astype(np.int64))
        data = [(np.searchsorted(places, at), x, k) for at, x, k in data]
        order = np.random.default_rng(7).permutation(len(data))
        held = [data[i] for i in order[::5]]
        used = [data[i] for k, i in enumerate(order) if k % 5] or held
        model = FTRL(len(places), max(1, len(langs)))
        for _ in range(epochs):
            for x in used:
                model.step(*x)
        w = model.weights()
        logits = np.array([x @ w[at] for at, x, _ in held]).reshape(len(held), -1)
        y = np.array([k for *_, k in held], int)
        ts = np.geomspace(0.05, 20, 121)
        loss = [-(np.log(np.maximum(_softmax(logits / t + np.log(weight))[np.arange(len(y)), y], 1e-12)) * weight[y]).mean() if len(y) else 0 for t in ts]
        t = float(ts[int(np.argmin(loss))])
        inner = places[:-1]
        table = (w[:-1] * idf[inner, None] * _SCALE / t).T.astype(np.float32)
        left = [np.flatnonzero(row) for row in table]
        return pd.DataFrame({"lang": langs, "bias": w[-1, : len(langs)] / t + np.log(weight), "at": [inner[i].tobytes() for i in left], "w": [row[i].tobytes() for row, i in zip(table, left, strict=True)]})

    with _ranks_cut_early(labelled.sparkSession, share_out(list(counts.values()), rows)):
        got = common.in_one_task(sample, train, "lang string, bias double, at binary, w binary").toPandas().sort_values("lang")
    table = np.zeros((len(got), BUCKETS), np.float32)
    for row, at, w in zip(table, got["at"], got.w, strict=True):
        row[np.frombuffer(at, np.int64)] = np.frombuffer(w, np.float32)
    return Model(list(got.lang), table, got.bias.to_numpy())


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score.

    Null texts and texts without letters get ``und`` and 0; every other row gets a
    learned language with its calibrated probability.  Rows are never dropped, so
    repeated rows repeat.  Columns of ``keep`` that clash are left as they are in the input
    and the prediction wins.
    """
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = src.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = shared.value.predict(part.column("_text").to_pylist())
        return pa.record_batch([*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return common.map_arrow(src, run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text; every fifth id by checksum is held out of training."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(common.crc_part(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit(docs.where(~held & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model, ["doc_id", "held_out"])
