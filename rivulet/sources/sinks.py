"""Sinks: published events, dead letters, ledgers, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_records(events: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, value) records: the rest of the columns as JSON."""
    return events.select(F.col(key).alias("key"), F.to_json(F.struct(*(columns or [c for c in events.columns if c != key]))).alias("value"))


def publish(records: DataFrame, topic: str, servers: str) -> None:
    """Write (key, value) to a topic; needs the Kafka connector.  Delivery is at least once."""
    records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_files(records: DataFrame, path: str, partitions: int, mode: str = "append") -> None:
    """The same records as files, all of a key in one of ``partitions`` files."""
    records.repartition(partitions, "key").write.mode(mode).parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def report(summary: DataFrame, groups: DataFrame, path: str, shown: int = 8, samples: DataFrame | None = None, failures: int = 5) -> None:
    """A one-row summary, with its first ``failures`` apart, and the groups: the first ``shown`` by name beside the whole table; ``samples`` of keys if given."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    groups.orderBy("group").limit(shown).coalesce(1).write.mode("overwrite").json(f"{path}/first")
    if "failures" in summary.columns:
        summary.select("verdict", F.slice("failures", 1, failures).alias("failures"), F.greatest(F.size("failures") - failures, F.lit(0)).alias("more")).coalesce(1).write.mode("overwrite").json(f"{path}/failures")
    if samples is not None:
        samples.coalesce(1).write.mode("overwrite").json(f"{path}/samples")
