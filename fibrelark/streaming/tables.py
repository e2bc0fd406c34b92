"""A table of incidents that a stream upserts, safe against replayed batches.

A micro-batch is written to a folder of its own number, and counts once its marker is in the
log. A batch that is replayed after a failure overwrites its own folder, or changes nothing if
its marker is there; so every batch takes effect exactly once. Readers see the batches of the
log only, and of each incident the row of its latest batch. ``compact`` folds them into one
base. Markers are created through Hadoop's file system, without overwriting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from fibrelark.operators.incidents import COLUMNS, INCIDENT


class IncidentTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):  # noqa: ANN202
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _mark(self, kind: str, number: int) -> None:
        files, where = self._at(f"{kind}/{number:020d}")
        if not files.exists(where):
            files.create(where, False).close()

    def _marked(self, kind: str) -> list[int]:
        files, where = self._at(kind)
        return sorted(int(s.getPath().getName()) for s in files.listStatus(where)) if files.exists(where) else []

    def _delete(self, name: str) -> None:
        files, where = self._at(name)
        files.delete(where, True)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """Takes a micro-batch; made for foreachBatch."""
        base = self._marked("_base")
        if batch_id in self._marked("_log") or (base and batch_id <= base[-1]):
            return
        # A closure and a snapshot of one incident may come together: the closure is later.
        order = F.struct(F.col("status") == "CLOSED", F.col("end_time"), F.col("max_score"))
        rows = batch.select(*COLUMNS).groupBy("incident_id").agg(F.max_by(F.struct(*COLUMNS), order).alias("r")).select("r.*")
        rows.write.mode("overwrite").parquet(f"{self.path}/delta-{batch_id:020d}")
        self._mark("_log", batch_id)

    def read(self) -> DataFrame:
        """The latest row of every incident."""
        base = self._marked("_base")
        parts = [(b, f"delta-{b:020d}") for b in self._marked("_log") if not base or b > base[-1]]
        parts += [(base[-1], f"base-{base[-1]:020d}")] if base else []
        found = self.spark.createDataFrame([], f"{INCIDENT}, batch long")
        for number, name in parts:
            found = found.unionByName(self.spark.read.schema(INCIDENT).parquet(f"{self.path}/{name}").withColumn("batch", F.lit(number).cast("long")))
        return found.groupBy("incident_id").agg(F.max_by(F.struct(*COLUMNS), "batch").alias("r")).select("r.*")

    def compact(self) -> None:
        """Folds all batches of the log into one base; a failure between its steps loses nothing."""
        done, before = self._marked("_log"), self._marked("_base")
        if not done:
            return
        last = max([done[-1], *before])
        if not before or last > before[-1]:
            self.read().write.mode("overwrite").parquet(f"{self.path}/base-{last:020d}")
            self._mark("_base", last)
        for number in done:
            if number <= last:
                self._delete(f"delta-{number:020d}")
                self._delete(f"_log/{number:020d}")
        for number in before:
            if number < last:
                self._delete(f"base-{number:020d}")
                self._delete(f"_base/{number:020d}")


def write_incidents(updates: DataFrame, table: IncidentTable, checkpoint: str, **trigger: bool | str) -> StreamingQuery:
    """Starts a query that upserts incident updates into the table."""
    writer = updates.writeStream.foreachBatch(table.upsert).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
