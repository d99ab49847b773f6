"""Quality classification by compression.

One zstandard dictionary is built from good and one from bad labelled texts.  A
text that resembles the good ones compresses better with the good dictionary;
the difference of both sizes over their sum is calibrated to a probability by a
logistic curve fitted on labelled rows that built no dictionary.

Scoring is one narrow pass over whole texts; the model is two dictionaries of
fixed size and two numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bound of the labelled sample, in rows of each class.
TRAIN_ROWS = 1200
DICT_BYTES = 112_640
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def __post_init__(self):
        self.tools = None

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.offset

    def __setstate__(self, s):
        self.good, self.bad, self.slope, self.offset = s
        self.tools = None

    def difference(self, texts: list[bytes]) -> np.ndarray:
        """(bad size - good size) / (bad size + good size); 0 for an empty text."""
        if self.tools is None:
            self.tools = []
            for d in (self.good, self.bad):
                data = zstandard.ZstdCompressionDict(d) if d else None
                if data:
                    data.precompute_compress(level=LEVEL)
                self.tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False))
        g, b = (np.array([len(c.compress(t)) for t in texts], float) for c in self.tools)
        return np.where([len(t) > 0 for t in texts], (b - g) / np.maximum(g + b, 1), 0.0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.difference(texts) + self.offset, -30, 30)))


def _dictionary(texts: list[bytes]) -> bytes:
    texts = [t for t in texts if t]
    if not texts:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICT_BYTES:]  # too little text to train on: raw content serves as the dictionary


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge."""
    s = x.std() or 1.0
    a = np.stack([x / s, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * np.maximum(p * (1 - p), 1e-9)[:, None]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / s), float(w[1])


def fit(texts: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Train on (doc_id, text) and (doc_id, label 0 or 1).

    The sample has the ``rows`` ids of each class with the smallest hash; it is
    trained on in one task.  Two thirds build the dictionaries, the rest the
    curve, weighted back to the classes' shares among all labelled rows.
    An id with several labels counts by their mean; null labels and ids are left
    out.  Without labels every score is 0.5.
    """
    lab = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    share = {r.label: r["count"] for r in lab.groupBy("label").count().collect()}
    picked = None
    for y in (0, 1):
        x = lab.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = x if picked is None else picked.unionByName(x)
    sample = texts.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most 2 * rows ids

    def train(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text"], ignore_index=True)
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in pdf.text]
        y = pdf.label.to_numpy()
        place = np.zeros(len(pdf), int)
        for k in (0, 1):
            place[y == k] = np.arange((y == k).sum())
        build = (place % 3 != 2) | (np.where(y == 1, (y == 1).sum(), (y == 0).sum()) < 6)
        m = Model(_dictionary([t for t, b, k in zip(raw, build, y, strict=True) if b and k == 1]), _dictionary([t for t, b, k in zip(raw, build, y, strict=True) if b and k == 0]), 0.0, 0.0)
        rest = np.flatnonzero(~build) if (~build).any() else np.arange(len(pdf))
        slope, offset = _logistic(m.difference([raw[i] for i in rest]), y[rest].astype(float))
        have = [max(1, (y[rest] == k).sum()) for k in (0, 1)]
        offset += np.log(max(share.get(1, 0), 1) / have[1]) - np.log(max(share.get(0, 0), 1) / have[0])
        return pd.DataFrame({"good": [m.good], "bad": [m.bad], "slope": [slope], "offset": [offset]})

    got = common.in_one_task(sample, train, "good binary, bad binary, slope double, offset double").collect()
    return Model(bytes(got[0].good), bytes(got[0].bad), got[0].slope, got[0].offset) if got else Model(b"", b"", 0.0, 0.0)


def classify(docs: DataFrame, model: Model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``keep`` of ``docs`` with score and predicted.

    Null and empty texts score the curve's value at no difference.  Rows are
    never dropped; a kept column named like an added one gives way to it.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = src.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value.score([t or b"" for t in part.column("_text").cast(pa.large_binary()).to_pylist()])
        return pa.record_batch([*[part.column(c) for c in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return common.map_arrow(src, run, schema)


def op7_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; every fourth id by checksum is held out of training."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    held = F.coalesce(common.crc_part(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs, labels.where(~held))
    return classify(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
