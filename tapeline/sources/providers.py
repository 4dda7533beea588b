"""Data sources behind one interface: file-backed providers, a fallback chain, and an incremental event feed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class FileProvider:
    """Tables below a folder, one format each; ``capabilities`` names the tables it can give."""

    name: str
    root: str
    formats: dict[str, str] = field(default_factory=dict)
    schemas: dict[str, StructType] = field(default_factory=dict)

    @property
    def capabilities(self) -> set[str]:
        return {*self.formats}

    def read(self, spark: SparkSession, table: str, until: str | None = None) -> DataFrame:
        """A table, only what was available at ``until``; the filter and the columns used reach the scan."""
        kind = self.formats[table]
        reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}))
        if table in self.schemas:
            reader = reader.schema(self.schemas[table])
        rows = reader.load(f"{self.root}/{table}.{kind}")
        return rows.where(F.col("available_at") <= F.lit(until).cast("timestamp")) if until else rows


def fallback(spark: SparkSession, providers: Sequence[FileProvider], table: str, usable: str) -> tuple[str, DataFrame] | None:
    """The first provider, in order, whose table is not empty and fulfils ``usable`` in every row; None if there is none."""
    for provider in providers:
        if table not in provider.capabilities:
            continue
        rows = provider.read(spark, table)
        if not rows.isEmpty() and rows.where(~F.coalesce(F.expr(usable), F.lit(False))).isEmpty():
            return provider.name, rows
    return None


def event_feed(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; offsets are kept in the query's checkpoint, so each item is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def manifest(spark: SparkSession, path: str, facts: dict[str, object]) -> str:
    """JSON of ``facts`` and a digest of each file below ``path`` (name, length); as small as the number of files."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files, found = fs.listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString().removeprefix(target.toString()), int(f.getLen())))
    found.sort()
    digest = hashlib.sha256(json.dumps(found).encode()).hexdigest()
    return json.dumps({**facts, "files": len(found), "bytes": sum(n for _, n in found), "digest": digest}, sort_keys=True)
