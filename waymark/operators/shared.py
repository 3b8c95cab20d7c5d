"""A folder that the driver and all executors share, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; on one machine, where that is not set, a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="waymark-")
    return f"{base.rstrip('/')}/waymark-{sc.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def parquet_batches(path: str, rows: int):
    """Record batches of at most ``rows`` rows of the Parquet files below a path, read by whoever calls."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else f"file://{path}")
    for x in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda x: x.path):
        if x.path.endswith(".parquet"):
            with store.open_input_file(x.path) as f:
                yield from pq.ParquetFile(f).iter_batches(rows)
