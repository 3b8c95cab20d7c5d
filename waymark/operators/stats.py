"""Dataset statistics over per-image records (location, filename, height, width, mean_r, mean_g,
mean_b, brightness)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DARK, BRIGHT = 60, 220


def location_stats(images: DataFrame) -> DataFrame:
    """Per location: count, size ranges and means, channel means, and the mean and population deviation
    of all channel means together."""
    pooled = images.select("location", F.explode(F.array("mean_r", "mean_g", "mean_b")).alias("c")).groupBy("location").agg(F.avg("c").alias("pixel_mean"), F.stddev_pop("c").alias("pixel_std"))
    sizes = [f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return images.groupBy("location").agg(F.count("*").alias("n_images"), *sizes, *[F.avg(c).alias(c) for c in ("mean_r", "mean_g", "mean_b")]).join(pooled, "location")


def overall_stats(images: DataFrame) -> DataFrame:
    """One row: images, locations, the smallest and largest location, mean brightness, dark and bright
    images. Ties between locations go to the first by name."""
    per = images.groupBy("location").agg(F.count("*").alias("n"), F.sum("brightness").alias("b"), F.count_if(F.col("brightness") < DARK).alias("dark"), F.count_if(F.col("brightness") > BRIGHT).alias("bright"))
    ends = per.agg(
        F.sum("n").alias("n_images"), F.count("*").alias("n_locations"), F.min(F.struct("n", "location")).alias("lo"), F.max("n").alias("max_images"),
        (F.sum("b") / F.sum("n")).alias("mean_brightness"), F.sum("dark").alias("n_dark"), F.sum("bright").alias("n_bright"), F.min(F.struct((-F.col("n")).alias("m"), "location")).alias("hi"),
    )
    return ends.select("n_images", "n_locations", F.col("lo.n").alias("min_images"), F.col("lo.location").alias("min_location"), "max_images", F.col("hi.location").alias("max_location"), "mean_brightness", "n_dark", "n_bright")


def outliers(images: DataFrame) -> DataFrame:
    """Images that are too dark or too bright, with ``kind``."""
    kind = F.when(F.col("brightness") < DARK, "dark").when(F.col("brightness") > BRIGHT, "bright")
    return images.withColumn("kind", kind).where("kind IS NOT NULL")


def read_counts(listed: DataFrame, readable: DataFrame) -> DataFrame:
    """One row: files listed and images read."""
    return listed.agg(F.count("*").alias("n_listed")).crossJoin(F.broadcast(readable.agg(F.count("*").alias("n_read"))))


def report_lines(overall: DataFrame, per_location: DataFrame) -> DataFrame:
    """(line_no, line) of the text report: totals, then a line per location."""
    titles = {"n_images": "Total images", "n_locations": "Locations", "mean_brightness": "Mean brightness", "n_dark": "Dark images", "n_bright": "Bright images"}
    said = [F.struct(F.lit(i).alias("line_no"), F.concat(F.lit(f"{t}: "), F.col(c).cast("string")).alias("line")) for i, (c, t) in enumerate(titles.items())]
    head = overall.select(F.inline(F.array(*said)))
    place = F.row_number().over(Window.orderBy("location")) + len(titles) - 1
    return head.unionByName(per_location.select(place.alias("line_no"), F.format_string("%s: %d images", "location", "n_images").alias("line")))
