"""Writers: partitioned tables, idempotent merges, surrogate keys, snapshots and backups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pastframe.operators.topk import latest_per_key
from pastframe.sources.ordered import running_total


def backup_table(df: DataFrame, root: str, table: str, date_tag: str, partition_col: str | None = None) -> str:
    """root/backup_date=<tag>/<table>, one file set per partition; a repeat of the same tag replaces it."""
    path = f"{root}/backup_date={date_tag}/{table}"
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_col) if partition_col else w).parquet(path)
    return path


def list_backups(spark: SparkSession, root: str, limit: int | None = None) -> list[str]:
    """The tags under root, latest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    tags = sorted((n.removeprefix("backup_date=") for n in names if n.startswith("backup_date=")), reverse=True)
    return tags[:limit]


def append_new(target: DataFrame | None, batch: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of the batch to append: one per key (the first by `order`, else any), keys of the target left out."""
    one = latest_per_key(batch, keys, order, first=True) if order else batch.dropDuplicates(keys)
    return one if target is None else one.join(target.select(*keys).distinct(), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The target after the batch: the batch's latest row per key wins, other rows stay."""
    new = latest_per_key(batch, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> None:
    """Partitioned Parquet; overwriting replaces only the partitions that df holds."""
    df.repartition(*by).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def assign_surrogate_ids(dim: DataFrame, new_values: DataFrame, value: str, id_col: str) -> DataFrame:
    """The dimension with the next ids for values that it lacks, in the order of the values, counted over range partitions."""
    fresh = new_values.select(value).where(F.col(value).isNotNull()).distinct().join(dim, value, "left_anti")
    top = dim.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
    placed = running_total(fresh, [F.col(value)], "__before", name="surrogate-ids")
    rows = placed.crossJoin(F.broadcast(top)).select((F.col("__top") + F.col("__before") + 1).cast(dim.schema[id_col].dataType).alias(id_col), value)  # one row
    return dim.select(id_col, value).unionByName(rows)


def write_run_snapshot(df: DataFrame, root: str, run_ts: str, kind: str, model: str | None = None) -> str:
    """A feature frame or a model's predictions under the key of its run."""
    path = f"{root}/run_ts={run_ts}/kind={kind}" + (f"/model={model}" if model else "")
    df.write.mode("overwrite").parquet(path)
    return path
