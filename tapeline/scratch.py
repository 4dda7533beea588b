"""Tables in the cluster's shared folder, used to cut lineage.

A table that is written out and read back survives the loss of any executor, unlike a local checkpoint. The folder is
the one the session names in ``spark.checkpoint.dir`` or by ``SparkContext.setCheckpointDir``. Where neither is set, a
local session gets a temporary folder of its machine; on a cluster that is an error, since executors don't share one.

An operator drops the tables its result doesn't read. Those that a result still reads last until ``release`` or the end
of the session, at which the session's folder is removed.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOT = "spark.tapeline.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below the shared one; raises on a cluster that names none."""
    root = spark.conf.get(_ROOT, None)
    if root is None:
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if base is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("no shared folder: set spark.checkpoint.dir to one that all executors reach")
            base = tempfile.mkdtemp(prefix="tapeline-")
        root = f"{base.rstrip('/')}/tapeline-{uuid.uuid4().hex}"
        spark.conf.set(_ROOT, root)
        atexit.register(_at_end, spark)
    return root


def _at_end(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # noqa: BLE001  the session is gone already, and its folder with it or left to the cluster
        pass


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def forget_shuffles(spark: SparkSession) -> None:
    """Let executors remove the shuffle files of finished jobs, which they keep until the driver drops those jobs' plans.

    For loops of many jobs, whose files would pile up otherwise.
    """
    gc.collect()
    spark._jvm.System.gc()


class Scratch:
    """Keeps the tables of one run; ``drop`` those no live plan reads any more, or leave a ``with`` block to drop all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self._paths = spark, label, {}

    def cut(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """Write ``df`` and return it read back: same rows, no lineage. Runs one job."""
        path = new_path(self.spark, self.label)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            entry = self._paths.pop(id(table), None)
            if entry:
                delete(self.spark, entry[1])

    def drop_all(self, but: tuple[DataFrame, ...] = ()) -> None:
        """Drop every table except those in ``but``."""
        kept = {id(t) for t in but}
        self.drop(*(t for k, (t, _) in list(self._paths.items()) if k not in kept))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop_all()


def release(spark: SparkSession) -> None:
    """Remove every scratch table of this session, once its results have been consumed."""
    root = spark.conf.get(_ROOT, None)
    if root is not None:
        delete(spark, root)
        spark.conf.unset(_ROOT)
