"""Stratified train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scalars import shuffle_key


def stratified_split(records: DataFrame, ratio: float, seed: int = 42, key: str = "image_id", location: str = "location") -> DataFrame:
    """Adds ``split``. Of n records of a location, ceil(n * ratio) go to test, at least one and at most
    n - 1; a single record stays in train."""
    if not 0 < ratio < 1:
        raise ValueError("the test ratio must lie between 0 and 1")
    w = Window.partitionBy(location)
    place = F.row_number().over(w.orderBy(shuffle_key(seed, key), key))
    n = F.count(F.lit(1)).over(w)
    tests = F.when(n > 1, F.least(F.greatest(F.ceil(n * F.lit(ratio).cast("double")), F.lit(1)), n - 1)).otherwise(0)
    return records.withColumn("split", F.when(place <= tests, "test").otherwise("train"))


def train_with_augmented(train: DataFrame, augmented: DataFrame) -> DataFrame:
    """Originals of the training side, said not to be augmented, and the augmented records."""
    both = train.withColumn("augmented", F.lit(False)).unionByName(augmented.withColumn("augmented", F.lit(True)), allowMissingColumns=True)
    return both.withColumn("augmented", F.coalesce("augmented", F.lit(False)))


def split_summary(train: DataFrame, test: DataFrame, location: str = "location") -> DataFrame:
    """(location, train, test): locations of either side."""
    a = train.groupBy(location).agg(F.count("*").alias("train"))
    b = test.groupBy(location).agg(F.count("*").alias("test"))
    return a.join(b, location, "full_outer").select(location, F.coalesce("train", F.lit(0)).alias("train"), F.coalesce("test", F.lit(0)).alias("test"))
