"""Visual codebooks and the global vectors made with them."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vectors
from waymark.functions.scalars import shuffle_key


def sample_per_image(local: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` local descriptors (image_id, local_id, vec) of each image."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(shuffle_key(seed, F.concat_ws("/", "image_id", "local_id")), "local_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def fit(sample: DataFrame, k: int, seeds=(1, 2, 3, 4, 5), iterations: int = 100, tolerance: float = 0.2) -> DataFrame:
    """(word_id, centroid): the best of several k-means runs. Fit once and store the table.

    Equal vectors are one weighted point. With no more points than words, the points are the words.
    """
    points = sample.groupBy("vec").agg(F.count("*").cast("double").alias("weight")).cache()
    try:
        n = points.count()
        if n <= k:
            rows = points.orderBy("vec").collect()
            rows = [(i, [float(x) for x in r["vec"]]) for i, r in enumerate(rows)]
        else:
            data = points.select(array_to_vector("vec").alias("features"), "weight")
            mode = "k-means||" if n > 20 * k else "random"  # the parallel start may find too few centres among few points
            models = [KMeans(k=k, maxIter=iterations, tol=tolerance, seed=s, initMode=mode, weightCol="weight").fit(data) for s in seeds]
            best = min(models, key=lambda m: m.summary.trainingCost)
            rows = [(i, [float(x) for x in c]) for i, c in enumerate(best.clusterCenters())]
    finally:
        points.unpersist()
    return sample.sparkSession.createDataFrame(rows, "word_id int, centroid array<double>")


def assign(rows: DataFrame, codebook: DataFrame, metric: str = "l2") -> DataFrame:
    """Adds ``word_id``, the best word for each row's ``vec``; ties go to the smaller id.

    The codebook rides along as one broadcast array, so no row is multiplied and nothing is shuffled.
    """
    words = codebook.agg(F.array_sort(F.collect_list(F.struct(F.col("word_id").alias("word"), "centroid"))).alias("words"))
    sign = 1 if metric == "l2" else -1
    scored = F.transform("words", lambda w: F.struct((vectors.score(metric, F.col("vec"), w["centroid"]) * sign).alias("s"), w["word"].alias("word")))
    return rows.crossJoin(F.broadcast(words)).withColumn("word_id", F.array_min(scored)["word"]).drop("words")


def bow(local: DataFrame, codebook: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, descriptor): word counts over the codebook, scaled to length 1. Images without any
    local descriptor (given by ``images``) get zeros."""
    size = codebook.agg(F.max("word_id") + 1).first()[0]
    counts = assign(local, codebook).groupBy("image_id", "word_id").agg(F.count("*").alias("n"))
    each = counts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", F.col("n").cast("double")))).alias("m"))
    if images is not None:
        each = images.select("image_id").join(each, "image_id", "left")
    full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0.0)))
    return each.select("image_id", full.alias("v")).select("image_id", vectors.l2_normalize_guarded("v").alias("descriptor"))


def vlad(local: DataFrame, codebook: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(image_id, descriptor): residual sums per word, each scaled to length 1, then all together.

    Residuals are summed element by element, (image, word, place) first, which combines before the
    shuffle; words without descriptors are zeros.
    """
    size, dim = codebook.agg(F.max("word_id") + 1, F.max(F.size("centroid"))).first()
    near = assign(local, codebook).join(F.broadcast(codebook), "word_id")
    terms = near.select("image_id", "word_id", F.posexplode(F.zip_with("vec", "centroid", lambda x, c: x.cast("double") - c.cast("double"))).alias("at", "r"))
    sums = terms.groupBy("image_id", "word_id", "at").agg(F.sum("r").alias("r"))
    parts = sums.groupBy("image_id", "word_id").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("p"))
    parts = parts.select("image_id", "word_id", F.col("p.r").alias("v")).select("image_id", "word_id", vectors.l2_normalize_guarded("v").alias("v"))
    each = parts.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("word_id", "v"))).alias("m"))
    if images is not None:
        each = images.select("image_id").join(each, "image_id", "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    full = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i), zeros)))
    return each.select("image_id", full.alias("v")).select("image_id", vectors.l2_normalize_guarded("v").alias("descriptor"))
