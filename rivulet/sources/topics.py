"""A topic kept as Parquet files, read by offset ranges: in batch from low to high offsets, or as a stream.

Files lie in ``partition=<n>`` folders and have a column ``offset``; their footers tell which offsets they hold, so that planning reads
footers alone and each task the row groups of its range.  What the source holds at planning is the end of a read: rows that
come later belong to the next one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset long, key string, value binary"
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("key", pa.string()), ("value", pa.binary())])


@dataclass
class Segment(InputPartition):
    """A file of one partition and the offsets of it that are wanted, the last one not included."""

    path: str
    partition: int
    low: int
    end: int


def segments(path: str) -> list[Segment]:
    """All files of a topic with the offsets that they hold, from their footers."""
    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    out = []
    for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        found = re.search(r"/partition=(\d+)/[^/]+\.parquet$", f.path)
        if not found:
            continue
        meta = pq.read_metadata(f.path, filesystem=system)
        at = meta.schema.names.index("offset")
        stats = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
        if stats:
            out.append(Segment(f.path, int(found[1]), min(s.min for s in stats), max(s.max for s in stats) + 1))
    return sorted(out, key=lambda s: (s.partition, s.low))


def ends(found: list[Segment]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in found:
        out[s.partition] = max(out.get(s.partition, 0), s.end)
    return out


def between(found: list[Segment], start: dict[int, int], stop: dict[int, int]) -> list[Segment]:
    """The parts of segments from ``start`` to before ``stop``; partitions that ``start`` does not name begin at their low end, those that ``stop`` does not name have no rows."""
    out = [Segment(s.path, s.partition, max(s.low, start.get(s.partition, 0)), min(s.end, stop.get(s.partition, 0))) for s in found]
    return [s for s in out if s.low < s.end]


def rows(path: str, s: Segment) -> Iterator[pa.RecordBatch]:
    system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    # row groups outside the range are skipped by their statistics
    t = pq.read_table(s.path, filesystem=system, partitioning=None, columns=["offset", "key", "value"], filters=(pc.field("offset") >= s.low) & (pc.field("offset") < s.end))
    t = t.append_column("partition", pa.array([s.partition] * len(t), pa.int32())).select(_ARROW.names).cast(_ARROW)
    yield from t.to_batches(max_chunksize=10_000)


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.start, self.stop = options["path"], _told(options, "startingOffsets"), _told(options, "endingOffsets")

    def partitions(self) -> list[Segment]:
        found = segments(self.path)
        return between(found, self.start, ends(found) | self.stop) or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from rows(self.path, partition) if partition.path else ()


class _Stream(DataSourceStreamReader):
    """Offsets of the stream are the ends of its partitions, as text keys."""

    def __init__(self, options: dict):
        self.path, self.start = options["path"], _told(options, "startingOffsets")

    def initialOffset(self) -> dict:
        return {str(p): o for p, o in self.start.items()}

    def latestOffset(self) -> dict:
        return {str(p): o for p, o in sorted(ends(segments(self.path)).items())}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        return between(segments(self.path), {int(p): o for p, o in start.items()}, {int(p): o for p, o in end.items()}) or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        yield from rows(self.path, partition) if partition.path else ()


class TopicFiles(DataSource):
    """``topic_files``: options path, startingOffsets and endingOffsets (JSON objects of partition and offset; batch: up to what is there if unset)."""

    @classmethod
    def name(cls) -> str:
        return "topic_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Batch:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def _told(options: dict, key: str) -> dict[int, int]:
    given = {k.lower(): v for k, v in options.items()}.get(key.lower())
    return {int(p): int(o) for p, o in json.loads(given).items()} if given else {}


def read(spark: SparkSession, path: str, start: dict[int, int] | None = None, stop: dict[int, int] | None = None) -> DataFrame:
    """The records (partition, offset, key, value) of a topic's offset ranges."""
    spark.dataSource.register(TopicFiles)
    return spark.read.format("topic_files").options(path=path, startingOffsets=json.dumps(start or {}), endingOffsets=json.dumps(stop or {})).load()


def stream(spark: SparkSession, path: str, start: dict[int, int] | None = None) -> DataFrame:
    """The records of a topic as a stream; a micro-batch goes up to what is there when it is planned."""
    spark.dataSource.register(TopicFiles)
    return spark.readStream.format("topic_files").options(path=path, startingOffsets=json.dumps(start or {})).load()


def write(records: DataFrame, path: str, mode: str = "append") -> None:
    """Records (partition, offset, key, value) as files of a topic; a range of a partition's offsets goes to one file."""
    x = records.select(F.col("partition").cast("int").alias("partition"), "offset", F.col("key").cast("string").alias("key"), F.col("value").cast("binary").alias("value"))
    x.repartitionByRange("partition", "offset").sortWithinPartitions("partition", "offset").write.mode(mode).partitionBy("partition").parquet(path)


def held(spark: SparkSession, path: str) -> DataFrame:
    """(partition, low, end) of what the source holds: one row for each partition."""
    low: dict[int, int] = {}
    found = segments(path)
    for s in found:
        low[s.partition] = min(low.get(s.partition, s.low), s.low)
    return spark.createDataFrame([(p, low[p], e) for p, e in ends(found).items()], "partition int, low long, end long")


def drained(records: DataFrame, there: DataFrame) -> DataFrame:
    """(partition, low, end, read_to, gaps, drained) for every partition that the source ``held``: ``gaps`` counts offsets that a read did not give although it went past them."""
    got = records.groupBy("partition").agg((F.max("offset") + 1).alias("read_to"), F.count_distinct("offset").alias("n"))
    x = there.join(got, "partition", "left").withColumns({"read_to": F.coalesce("read_to", "low"), "n": F.coalesce("n", F.lit(0))})
    return x.select("partition", "low", "end", "read_to", (F.col("read_to") - F.col("low") - F.col("n")).alias("gaps"), (F.col("read_to") >= F.col("end")).alias("drained"))
