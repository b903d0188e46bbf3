"""Tables of a warehouse folder, replaced together: readers see all of the old tables or all of the new ones.

Each table lies in a folder of its own per version. A small file, ``CURRENT``, names the folder of every table; it is written
beside and renamed over the old one in one step, after all data are written, so that a job that fails or is lost before
leaves everything as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

RUNS = "source string, scope string, started_at timestamp, finished_at timestamp, rows_written int, status string, error string"


class Store:
    """The warehouse at ``root``, a folder all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.root).getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def folders(self) -> dict[str, str]:
        """Table to its folder under the root; empty before the first commit."""
        if not self._fs.exists(self._path("CURRENT")):
            return {}
        return json.loads(self.spark.read.text(str(self._path("CURRENT")), wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.folders()[name]}")

    def commit(self, tables: Mapping[str, DataFrame], partition: Mapping[str, Sequence[str]] = {}) -> None:
        """Write the tables and make them current together; tables not named stay. Folders replaced are removed afterwards.

        If a write fails, what was written is removed and the old tables stay current. One writer at a time.
        """
        old = self.folders()
        made: dict[str, str] = {}
        try:
            for name, rows in tables.items():
                made[name] = f"{name}/{uuid.uuid4().hex}"
                writer = rows.write.mode("errorifexists")
                (writer.partitionBy(*partition[name]) if partition.get(name) else writer).parquet(f"{self.root}/{made[name]}")
            staged = self._path(f"CURRENT.{uuid.uuid4().hex}")
            stream = self._fs.create(staged, True)
            stream.write(bytearray(json.dumps(old | made).encode()))
            stream.close()
            rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
            over = self.spark.sparkContext._gateway.new_array(rename, 1)
            over[0] = rename.OVERWRITE
            self._hadoop.FileContext.getFileContext(self._path().toUri(), self._conf).rename(staged, self._path("CURRENT"), over)
        except Exception:
            for folder in made.values():
                self._fs.delete(self._path(folder), True)
            raise
        for name in made.keys() & old.keys():
            self._fs.delete(self._path(old[name]), True)

    def run(self, source: str, scope: str, load: Callable[[], tuple[Mapping[str, DataFrame], int]]) -> int:
        """Run ``load``, commit its tables and append the outcome to the log of runs; the number of rows written.

        A failure is logged with its message and raised again; no table changes then.
        """
        began = datetime.now(timezone.utc)
        try:
            tables, written = load()
            self.commit(tables)
        except Exception as failure:
            self._log(source, scope, began, None, "failed", str(failure)[:2000])
            raise
        self._log(source, scope, began, written, "success", None)
        return written

    def _log(self, source: str, scope: str, began: datetime, written: int | None, status: str, error: str | None) -> None:
        row = (source, scope, began, datetime.now(timezone.utc), written, status, error)
        self.spark.createDataFrame([row], RUNS).write.mode("append").parquet(f"{self.root}/ingestion_runs")

    def runs(self) -> DataFrame:
        """The log of runs."""
        return self.spark.read.schema(RUNS).parquet(f"{self.root}/ingestion_runs")


def replace_percentiles(store: Store, groups: DataFrame, rows: DataFrame) -> None:
    """Peer groups and percentiles, replaced together."""
    store.commit({"peer_groups": groups, "player_percentiles": rows}, {"player_percentiles": ["season"]})


def replace_vectors(store: Store, vectors: DataFrame) -> None:
    """Player vectors, replaced as a whole."""
    store.commit({"player_vectors": vectors})
