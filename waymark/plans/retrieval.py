"""Whole plans: building a searchable database, answering queries, evaluating, and the result grid."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import features, registry
from waymark.operators import codebook, images, ivf, knn, metrics
from waymark.sources import images as store

#: Sizes of codebooks, and samples per image, of each kind of local feature.
WORDS = {"sift": 64, "orb": 64, "anyloc": 32}
SAMPLES = {"sift": 50, "orb": 50, "anyloc": 64}
EVALUATED = (1, 3, 5, 10)
KEYPOINTS = {"sift": features.keypoint_gradients, "orb": features.binary_corners}
TOP_K = 5


def stored_codebook(spark: SparkSession, path: str, sample: Callable[[], DataFrame] | None, k: int, rebuild: bool = False) -> DataFrame:
    """The stored codebook, or one fitted to ``sample()`` and stored; without ``sample`` it must be there."""
    if sample is None and not store.exists(spark, path):
        raise ValueError(f"no codebook at {path}: extract the database first")
    if sample is not None and (rebuild or not store.exists(spark, path)):
        store.write_table(codebook.fit(sample(), k), path)
    return spark.read.parquet(path)


def extract(pictures: DataFrame, key: str, root: str, model: Callable | None = None, rebuild: bool = False, fit: bool = True) -> DataFrame:
    """(image_id, location, vec) of one method, its codebook kept below ``root``. Queries are encoded with
    ``fit`` false: by the database's codebook, which must be there.

    "sift" and "anyloc" give VLAD, "orb" bags of words, over the local features; "dinov2" and "cnn"
    take ``model`` as the model. Without ``model``, "sift" uses gradient histograms around scale-space
    extrema and "orb" binary comparisons around corners.
    """
    m = registry.method(key)
    if m.codebook_stem is None:
        if model is None:
            raise ValueError(f"{key} needs a model")
        return images.encode(pictures, model)
    if key == "anyloc" and model is None:
        raise ValueError("anyloc needs a model that gives patch tokens")
    local = images.encode_patches(pictures, model) if key == "anyloc" else images.local_features(pictures, model or KEYPOINTS[key])
    words = stored_codebook(pictures.sparkSession, f"{root}/{m.codebook_stem}_codebook", (lambda: codebook.sample_per_image(local, SAMPLES[key])) if fit else None, WORDS[key], rebuild)
    made = (codebook.bow if key == "orb" else codebook.vlad)(local, words, pictures.select("image_id"))
    return made.join(pictures.select("image_id", "location"), "image_id").select("image_id", "location", F.col("descriptor").alias("vec"))


def build_index(descriptors: DataFrame, key: str, index_type: str = "flat", nlist: int = 64, nprobe: int = 10):
    """A function (queries, k) -> results."""
    return ivf.build(descriptors.select(F.col("image_id").alias("item_id"), "vec"), index_type, registry.method(key).metric, nlist, nprobe)


def index_metadata(descriptors: DataFrame, key: str, index_type: str = "flat", nlist: int = 64, nprobe: int = 10, hnsw_m: int = 32, vec: str = "vec") -> DataFrame:
    """One row; requested list numbers next to those that the index gets."""
    m, size = registry.method(key), metrics.index_megabytes(descriptors, vec)
    only = lambda kind, v: F.lit(v if index_type == kind else None).cast("int")
    lists = F.greatest(F.lit(1), F.least(F.lit(nlist), F.col("vectors"))).cast("int")
    return size.select(
        F.lit(key).alias("method"), F.lit(m.display).alias("method_display"), F.lit(index_type).alias("index_type"), F.lit(m.metric).alias("metric"), "vectors", "dimension",
        F.lit(registry.descriptor_name(key)).alias("descriptor_file"), F.lit(registry.label_name(key)).alias("label_file"), F.lit(registry.index_name(key, index_type)).alias("index_file"),
        F.col("index_mb").alias("serialized_index_mb"), only("ivf", nlist).alias("nlist"), only("ivf", nprobe).alias("nprobe"), only("hnsw", hnsw_m).alias("hnsw_m"),
        F.when(F.lit(index_type == "ivf"), lists).alias("adjusted_nlist"), F.when(F.lit(index_type == "ivf"), F.least(F.lit(max(1, nprobe)), lists)).cast("int").alias("adjusted_nprobe"),
    )


def extraction_metadata(database: DataFrame, data_dir: str, include_augmented: bool, seed: int, methods: list[str]) -> DataFrame:
    split = "originals_plus_augmentations" if include_augmented else "originals_only"
    return database.agg(F.count("*").alias("n_images")).select(F.lit(data_dir).alias("data_dir"), "n_images", F.lit(split).alias("database_split"), F.lit(seed).alias("seed"), F.array(*map(F.lit, methods)).alias("methods"))


def answer(queries: DataFrame, database: DataFrame, k: int = TOP_K, metric: str = "l2") -> DataFrame:
    """Results with their location, rank and the vote over them."""
    locations = database.select("item_id", "location")
    found = knn.knn(queries, database, k, metric)
    return found.join(locations, "item_id").join(knn.majority_vote(found, locations), "query_id")


def evaluate_method(key: str, queries: DataFrame, search: Callable, locations: DataFrame, ks=EVALUATED, encode_ms: float | None = None) -> DataFrame:
    """One row of the evaluation table. Queries: (query_id, gt_location, vec); one search at the
    largest k serves all of them. Latency is the wall clock of the search, per query."""
    began = time.perf_counter()
    found = search(queries.select("query_id", "vec"), max(ks)).cache()
    n = max(1, queries.count())
    found.count()
    search_ms = (time.perf_counter() - began) * 1000 / n
    out = metrics.evaluate(found, locations, queries.select("query_id", "gt_location"), ks)
    return out.select(F.lit(registry.method(key).display).alias("method"), "*", F.lit(search_ms).alias("search_ms"), F.lit(encode_ms).cast("double").alias("encode_ms"), F.lit(search_ms + (encode_ms or 0.0)).alias("latency_ms"))


def result_grid(results: DataFrame, locations: DataFrame, truth: DataFrame, paths: DataFrame, name: str, length: int = 22) -> DataFrame:
    """(method, query_id, col, image_id, location, score, is_correct, path, label): the cells of a
    result picture; a missing path is a blank tile."""
    cells = results.join(locations, "item_id").join(truth, "query_id", "left").join(paths, "item_id", "left")
    return cells.select(
        F.lit(name).alias("method"), "query_id", F.col("rank").alias("col"), F.col("item_id").alias("image_id"), "location", "score",
        F.coalesce(F.col("location") == F.col("gt_location"), F.lit(False)).alias("is_correct"), "path", F.substring(F.col("item_id").cast("string"), 1, length).alias("label"),
    )
