"""Orphan references over a stream: every micro-batch is a delivery that moves the keyed state on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.references import COMPACT, LOGS, OrphanState, Reference


class OrphanStream:
    """Keeps the logs of one reference's state in a shared folder: each micro-batch adds a folder with its own rows, and reaches to its newest loaded_at.

    Events have the columns side (child or parent), id, key, loaded_at and deleted_at. A micro-batch that was already applied (a restart repeats the last one) is
    applied again to what was before it, so the state is the same as if it had come once. Every COMPACT batches a folder holds the whole
    state instead (a base); folders before the base before it are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, field: str):
        self.spark, self.folder, self.ref = spark, folder.rstrip("/"), Reference(field, "id", "key")

    def _path(self, *parts):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete micro-batches that are kept, oldest first."""
        fs, root = self._fs(), self._path()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and fs.exists(self._path(n, "_done")))

    def _bases(self) -> list[int]:
        return [v for v in self.versions() if self._fs().exists(self._path(v, "_base"))]

    def state(self, version: int | None = None) -> OrphanState:
        """The state after a micro-batch, the newest if none is given; the empty state before the first."""
        known = [v for v in self.versions() if version is None or v <= version]
        if not known:
            return OrphanState()
        start = max((b for b in self._bases() if b <= known[-1]), default=known[0])
        logs = {name: self.spark.read.parquet(*(f"{self.folder}/{v}/{name}" for v in known if v >= start)) for name in LOGS}
        return OrphanState(**logs, version=known[-1] + 1)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """One delivery: for foreachBatch()."""
        before = [v for v in self.versions() if v < batch_id]
        state = self.state(before[-1]) if before else OrphanState()
        state.version = batch_id
        batch = batch.persist()
        try:
            child, parent = batch.where("side = 'child'"), batch.where("side = 'parent'")
            base = bool(before) and batch_id % COMPACT == 0
            reached = batch.agg(F.max("loaded_at").alias("t")).first()["t"]
            rows = state.step(self.ref, child, parent, reached)
            for name in LOGS:
                log = rows[name]
                if base:
                    log = getattr(state, name).unionByName(log)
                log.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/{name}")
        finally:
            batch.unpersist()
        fs = self._fs()
        if base:
            fs.create(self._path(batch_id, "_base"), True).close()
        fs.create(self._path(batch_id, "_done"), True).close()
        kept = [b for b in self._bases() if b < batch_id]
        for old in before if kept else ():
            if old < kept[-1]:
                fs.delete(self._path(old), True)

    def start(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run over a stream of events until it is stopped; all available data, then stop."""
        return events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, time: str, value: str, key: str, length: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """(start, key, n, total) per window of event time: rows that come once the watermark (the newest time less ``lateness``) has passed their window are left out, and so are rows without a time.

    Null values count as rows and add nothing; a window of null values has total 0.
    """
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, lateness)
    sums = rows.groupBy(F.window(time, length).alias("_w"), key).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"))
    return sums.select(F.col("_w.start").alias("start"), key, "n", "total")
