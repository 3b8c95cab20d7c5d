"""Reading image folders and manifests; writing the engine's artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions.scalars import PREPROCESS_EXTENSIONS, extension_of, parent_of, stem_of
from waymark.operators import images
from waymark.operators.manifest import MANIFEST_SCHEMA

#: Formats that the JVM's readers decode; others are listed but rejected on reading.
READABLE = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "wbmp")


def list_files(spark: SparkSession, root: str, extensions=PREPROCESS_EXTENSIONS) -> DataFrame:
    """(path, length, modified) of every file below ``root`` with an allowed extension; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified")).where(extension_of("path").isin(*extensions))


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """(image_id, location, height, width, rgb): the folder name is the class; unreadable files drop out."""
    raw = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    origin = F.col("image.origin")
    return images.from_spark_images(raw, parent_of(origin), F.concat_ws("/", parent_of(origin), stem_of(origin)))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """With ``augmented`` as text, for ``truthy`` to read."""
    return spark.read.schema(MANIFEST_SCHEMA).option("header", "true").csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").option("header", "true").csv(path)


def write_split(train: DataFrame, test: DataFrame, path: str) -> None:
    """train and test as CSV folders below ``path``, each record saying whether it is augmented."""
    for name, side in (("train", train), ("test", test)):
        side = side if "augmented" in side.columns else side.withColumn("augmented", F.lit(False))
        side.write.mode("overwrite").option("header", "true").csv(f"{path}/{name}")


def write_table(df: DataFrame, path: str) -> None:
    """Descriptors, labels, codebooks and indexes are Parquet tables."""
    df.write.mode("overwrite").parquet(path)


def write_metadata(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def available(spark: SparkSession, root: str, artifacts: dict[str, list[str]]) -> list[str]:
    """The methods of ``artifacts`` (method -> file names) of which every file is there."""
    return [m for m, names in artifacts.items() if all(exists(spark, f"{root}/{n}") for n in names)]
