"""Late-event counters over a stream: each micro-batch's registers are added to a log of states that merge without conflict.

Exactly-once needs no transaction: a micro-batch writes to a folder of its own number, so a retry replaces what it wrote,
and merging is idempotent. Nothing is given up behind a watermark: a record that arrives very late is counted as dropped,
and a redelivery, however late, is known by its id. A micro-batch writes only itself; ``compact`` folds the log into one
state from time to time, and may be lost or repeated at any point without harm.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tapeline.operators import late
from tapeline.scratch import delete


class CounterLog:
    """A log of register states below a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def parts(self) -> list[str]:
        """Folders of states that were written in full."""
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = jvm_path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(jvm_path(self.path)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(jvm_path(self.path))]
        return sorted(n for n in found if fs.exists(jvm_path(f"{self.path}/{n}/_SUCCESS")))

    def add(self, delta: DataFrame, number: int) -> None:
        """Add a micro-batch's registers; the same number again replaces them."""
        late.merge(delta).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")

    def state(self) -> DataFrame:
        """All registers merged: one row per record."""
        return late.merge(self._all(self.parts()))

    def _all(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], late.REGISTERS)
        return self.spark.read.schema(late.REGISTERS).parquet(*(f"{self.path}/{p}" for p in parts))

    def compact(self) -> None:
        """Fold what is there into one state."""
        parts = self.parts()
        if len(parts) > 1:
            late.merge(self._all(parts)).write.parquet(f"{self.path}/merged-{uuid.uuid4().hex}")
            for part in parts:
                delete(self.spark, f"{self.path}/{part}")


def run_counters(deliveries: DataFrame, log: CounterLog, checkpoint: str, compact_every: int = 100) -> StreamingQuery:
    """Add a stream of deliveries to ``log``; ends when what is available has been added."""

    def count(batch: DataFrame, number: int) -> None:
        log.add(late.registers(batch), number)
        if number % compact_every == compact_every - 1:
            log.compact()

    return deliveries.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
