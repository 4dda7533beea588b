"""Write rules as plans: what a table holds after a batch; plain Parquet has no merge, so each rewrites what it returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert_positive(stored: DataFrame, batch: DataFrame, keys: Sequence[str], positive: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Field-preserving upsert: a positive new value wins, else the stored one stays; optional fields take the new value unless null."""
    o, n = stored.alias("o"), batch.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, on, "full_outer")
    cols = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    cols += [F.when(F.col(f"n.{c}") > 0, F.col(f"n.{c}")).otherwise(F.coalesce(f"o.{c}", f"n.{c}")).alias(c) for c in positive]
    cols += [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in optional]
    return joined.select(*cols)


def append_new(stored: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Idempotent append: batch rows whose key is stored already are skipped; of repeated batch rows one is taken."""
    return stored.unionByName(batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def skip_unchanged(rows: DataFrame, keys: Sequence[str], order: Sequence, payload: Sequence[str]) -> DataFrame:
    """Rows whose payload differs from the row before (nulls equal), the first of each key included."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(F.lit(1)).over(w).isNotNull()
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_same", same).where("not _same").drop("_same")


def conflicts(rows: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keys stored with more than one payload: must be empty before an immutable write."""
    return rows.groupBy(*keys).agg(F.countDistinct(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).alias("n_payloads")).where("n_payloads > 1")


def write_partitioned(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Hive-partitioned Parquet, clustered by the partition columns so that each task opens few files."""
    rows.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(path)
