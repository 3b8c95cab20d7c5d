"""Helpers shared by the corpus operators: table access, durable staging, text expressions."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that every contract here means by "white space".
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes up to which a side may be broadcast after it was counted; beyond them, the side is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20

_roots: dict[str, SparkSession] = {}
#: Paths of staged tables that are still there.
made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_by_value(module: str) -> None:
    """Python workers get this module's functions inside the task, so it need not be on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def scratch(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (tests on one machine) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = next((r for r, s in _roots.items() if s is spark), None)
        if base is None:
            base = "file://" + tempfile.mkdtemp(prefix="waymark-")
            _roots[base] = spark
    return f"{base.rstrip('/')}/waymark-{sc.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Staged:
    """A table written once to the shared folder: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, name: str, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(self.path)
        made.append(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """For tables that no DataFrame returned to the caller reads any more."""
        release(self.spark, [self.path])


def release(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        delete(spark, path)
        if path in made:
            made.remove(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


@atexit.register
def _release() -> None:
    import shutil

    for root in _roots:
        shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


def settled(df: DataFrame) -> DataFrame:
    """``df``, staged unless its rows come from files without a shuffle: a task that is run again then
    numbers its rows as before."""
    return stage(df, "settled") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def ranked(values: DataFrame, column: str, nulls_first: bool = False) -> DataFrame:
    """Adds ``rank``: 0, 1, ... in the order of a column of distinct values. Ranks come from range
    partitions and their counts, so no task sees all values."""
    order = F.col(column).asc_nulls_first() if nulls_first else F.col(column).asc_nulls_last()
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(values.repartitionByRange(n, order).withColumn("pid", F.spark_partition_id()), "ranged")
    ahead = ranged.groupBy("pid").agg(F.count("*").alias("c")).withColumn("ahead", F.sum("c").over(Window.orderBy("pid")) - F.col("c")).drop("c")
    place = F.row_number().over(Window.partitionBy("pid").orderBy(order)) - 1
    out = ranged.withColumn("place", place).join(F.broadcast(ahead), "pid")  # one row for each partition
    return out.withColumn("rank", F.col("place") + F.col("ahead")).drop("pid", "place", "ahead")


def own(name: str) -> str:
    """A column name that no caller's table has."""
    return f"__waymark_{name}"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to hold at most ``rows`` rows and, written out as
    JSON, ``size`` bytes; else as it is. Reads ``df`` once, so that callers pass staged tables."""
    head = df.limit(rows + 1).select(F.octet_length(F.to_json(F.struct("*"))).alias("b"))
    n, total = head.agg(F.count("*"), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df
