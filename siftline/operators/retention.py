"""Retention by metadata: tables laid out by the day on which a job was created.

Days before the cutoff's day are dropped as folders, without reading or writing a row.  Only the cutoff's own day is
rewritten, and only its partition, and so are the rows of other tables that belong to jobs of that day: they are laid out
by the job's day too, so a cascade prunes to the same partitions.  Files of later days stay as they are.

Dropping a folder is done before the cutoff's day is written; a run that stops between can be repeated.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "created_day"
_NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def write_by_day(jobs: DataFrame, path: str) -> None:
    """Jobs by their day of creation."""
    jobs.withColumn(DAY, F.to_date("created_at")).write.partitionBy(DAY).parquet(path)


def write_children(rows: DataFrame, jobs: DataFrame, path: str, key: str = "job_id", parent_key: str = "id") -> None:
    """Rows that belong to jobs, by their job's day; rows without a job have no place in the table."""
    days = jobs.select(F.col(parent_key).alias(key), F.to_date("created_at").alias(DAY))
    rows.join(days, key).write.partitionBy(DAY).parquet(path)


def days(spark: SparkSession, path: str) -> dict[date | None, str]:
    """The folders of a table by day; None is the folder of rows without one."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory()]
    own = [n.removeprefix(f"{DAY}=") for n in names if n.startswith(f"{DAY}=")]
    return {None if n == _NO_DAY else date.fromisoformat(n): f"{path}/{DAY}={n}" for n in own}


def drop_old_days(spark: SparkSession, path: str, before: date) -> list[str]:
    """Deletes the folders of days before a day, and of rows without one; the deleted folders."""
    gone = [folder for day, folder in days(spark, path).items() if day is None or day < before]
    for name in gone:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, {DAY} date").parquet(path)


def _replace_day(rows: DataFrame, path: str) -> None:
    rows.write.partitionBy(DAY).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def retain(spark: SparkSession, jobs_path: str, jobs: str, before: datetime, children: dict[str, str] | None = None, key: str = "job_id", parent_key: str = "id") -> None:
    """Drops jobs created before the cutoff and, by cascade, their rows in ``children`` (path: columns) (SNK-19, SNK-20, SNK-24)."""
    edge = before.date()
    for path in (*(children or {}), jobs_path):
        drop_old_days(spark, path, edge)
    of_day = F.col(DAY) == F.lit(edge)
    held = _read(spark, jobs_path, jobs).where(of_day)
    kept = held.where(F.col("created_at") >= F.lit(before).cast(held.schema["created_at"].dataType))
    if edge not in days(spark, jobs_path) or held.count() == kept.count():
        return
    for path, columns in (children or {}).items():
        if edge in days(spark, path):
            rows = _read(spark, path, columns).where(of_day)
            _emptied_or_replaced(spark, rows.join(kept.select(F.col(parent_key).alias(key)), key, "left_semi").select(*rows.columns), path, edge)
    _emptied_or_replaced(spark, kept, jobs_path, edge)


def _emptied_or_replaced(spark: SparkSession, rows: DataFrame, path: str, edge: date) -> None:
    """Writes a day's rows anew; a day of which nothing is left loses its folder, as an overwrite of nothing keeps it."""
    if not rows.isEmpty():
        _replace_day(rows, path)
        return
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(days(spark, path)[edge])
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
