"""Tables of a stream that become visible epoch by epoch, all tables of an epoch at once.

An epoch's rows are written to folders that nobody reads yet, read back and checked; then one manifest that names these
folders is renamed into place.  Readers go by manifests alone, so a failed check, a failed write or a driver that is killed in
between shows them nothing, and an epoch that has its manifest is never written again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..staging import delete


class Log:
    """The committed epochs under ``path``; one stream writes, any number of sessions read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifest(self, epoch: int) -> str:
        return f"{self.path}/_commits/{epoch:012d}.json"

    def has(self, epoch: int) -> bool:
        at, fs = self._fs(self._manifest(epoch))
        return fs.exists(at)

    def epochs(self) -> list[int]:
        """Committed epochs, in order."""
        at, fs = self._fs(f"{self.path}/_commits")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifests(self, before: int | None = None, last: bool = False) -> list[dict]:
        """What the committed epochs say, of all ``before`` an epoch or only the ``last`` of these."""
        found = [e for e in self.epochs() if before is None or e < before]
        rows = [r.value for e in (found[-1:] if last else found) for r in self.spark.read.text(self._manifest(e), wholetext=True).collect()] if last else []
        if not last and found:
            rows = [r.value for r in self.spark.read.text([self._manifest(e) for e in found], wholetext=True).collect()]
        return sorted((json.loads(x) for x in rows), key=lambda m: m["epoch"])

    def write(self, epoch: int, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> bool:
        """Write the tables of an epoch, ``check`` them as they were written (it raises), and commit; False if the epoch was committed before."""
        if self.has(epoch):
            return False
        mine = f"{epoch:012d}-{uuid.uuid4().hex}"
        told = {"epoch": epoch, "tables": {n: {"path": f"{n}/{mine}", "schema": df.schema.jsonValue()} for n, df in tables.items()}}
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{name}/{mine}")
            if check:
                check({n: self._read([told], n) for n in tables})
            self._publish(epoch, json.dumps(told))
        except BaseException:
            for name in tables:
                delete(self.spark, f"{self.path}/{name}/{mine}")
            raise
        return True

    def _publish(self, epoch: int, text: str) -> None:
        pending, fs = self._fs(f"{self.path}/_commits/.{epoch:012d}-{uuid.uuid4().hex}")
        out = fs.create(pending)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(pending, self._fs(self._manifest(epoch))[0]):
            raise RuntimeError(f"epoch {epoch} was not committed")

    def _read(self, manifests: list[dict], name: str) -> DataFrame | None:
        there = [m["tables"][name] for m in manifests if name in m["tables"]]
        if not there:
            return None
        return self.spark.read.schema(T.StructType.fromJson(there[-1]["schema"])).parquet(*[f"{self.path}/{t['path']}" for t in there])

    def read(self, name: str, before: int | None = None) -> DataFrame | None:
        """All committed rows of a table; None if there is none yet."""
        return self._read(self.manifests(before), name)

    def last(self, name: str, before: int | None = None) -> DataFrame | None:
        """The rows of the last committed epoch alone, for tables that hold a state."""
        return self._read(self.manifests(before, last=True), name)

    def sweep(self) -> int:
        """Delete folders that no manifest names, which killed writers left; to be called while no stream writes."""
        named = {t["path"] for m in self.manifests() for t in m["tables"].values()}
        at, fs = self._fs(self.path)
        gone = 0
        for table in [x.getPath() for x in fs.listStatus(at) if x.isDirectory() and not x.getPath().getName().startswith(("_", "."))] if fs.exists(at) else []:
            for x in fs.listStatus(table):
                if f"{table.getName()}/{x.getPath().getName()}" not in named:
                    gone += fs.delete(x.getPath(), True)
        return gone
