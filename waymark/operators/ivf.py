"""Inverted-list and hashing indexes."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import vectors
from waymark.operators import codebook, knn
from waymark.operators.knn import direct

INDEX_TYPES = ("flat", "ivf", "hnsw")


def adjusted(nlist: int, nprobe: int, rows: int) -> tuple[int, int]:
    """Lists and probes that an index of so many rows gets."""
    lists = max(1, min(nlist, rows))
    return lists, max(1, min(nprobe, lists))


def assign_lists(database: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """Adds ``list_id``: the best centroid of (list_id, centroid)."""
    return codebook.assign(database, centroids.select(F.col("list_id").alias("word_id"), "centroid"), metric).withColumnRenamed("word_id", "list_id")


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """(query_id, vec, list_id): the lists to search for each query."""
    pairs = queries.select("query_id", "vec").crossJoin(F.broadcast(centroids.select("list_id", "centroid")))
    scored = pairs.select("query_id", "vec", "list_id", vectors.score(metric, "vec", "centroid").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(vectors.best_first(metric), "list_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= nprobe).select("query_id", "vec", "list_id")


def search(queries: DataFrame, lists: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, item_id, score) among the probed lists of ``lists`` (item_id, vec, list_id).

    The centroids, the index's own small model, are held by the driver; the probed list ids become a static
    filter, so that a table partitioned by list_id is read only where it is probed. Rows of a list meet
    the queries that probe it with one matrix product for each Arrow batch, so nothing but the best k per
    query and task is shuffled, however many rows one list holds.
    """
    rows = centroids.select("list_id", "centroid").orderBy("list_id").collect()
    ids, centres = [r["list_id"] for r in rows], np.array([r["centroid"] for r in rows], np.float64)

    def probed(matrix: np.ndarray) -> dict[int, np.ndarray]:
        sign = 1 if metric == "l2" else -1
        scores = np.stack([sign * direct(metric, matrix, np.broadcast_to(c, matrix.shape)) for c in centres], 1)
        best = np.argsort(scores, axis=1, kind="stable")[:, :nprobe]
        return {x: at for n, x in enumerate(ids) if len(at := np.flatnonzero((best == n).any(1)))}

    return knn.scan(queries, lists, k, metric, probed)


def train(database: DataFrame, nlist: int, nprobe: int, metric: str = "l2", seeds=(1,)) -> tuple[DataFrame, DataFrame, int]:
    """(lists, centroids, nprobe) of an index fitted to the database."""
    lists, probes = adjusted(nlist, nprobe, database.count())
    words = codebook.fit(database.select("vec"), lists, seeds=seeds)
    centroids = words.select(F.col("word_id").alias("list_id"), "centroid")
    return assign_lists(database, centroids, metric), centroids, probes


def write_lists(lists: DataFrame, path: str) -> None:
    lists.repartition("list_id").write.mode("overwrite").partitionBy("list_id").parquet(path)


def lsh_search(queries: DataFrame, database: DataFrame, k: int, width: float = 0.5, tables: int = 8, reach: float = 1.2) -> DataFrame:
    """Approximate neighbours by random projections, scored exactly; stands in for a graph index.

    Queries with fewer than k hits, zero vectors among them, are answered exactly instead.
    """
    as_vector = lambda df, i: df.select(i, "vec", array_to_vector("vec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7)
    d, q = as_vector(database, "item_id"), as_vector(queries, "query_id")
    near = model.fit(d).approxSimilarityJoin(q, d, reach, "apart")
    scored = near.select(F.col("datasetA.query_id").alias("query_id"), F.col("datasetB.item_id").alias("item_id"), vectors.sq_l2("datasetA.vec", "datasetB.vec").alias("score"))
    found = knn.ranked(scored, k, "l2").select("query_id", "rank", "item_id", "score")
    full = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    rest = knn.knn(queries.join(full, "query_id", "left_anti"), database, k, "l2")
    return found.join(full, "query_id", "left_semi").unionByName(rest)


def build(database: DataFrame, index_type: str = "flat", metric: str = "l2", nlist: int = 64, nprobe: int = 10):
    """A function (queries, k) -> results over the database."""
    if index_type == "flat":
        return lambda queries, k: knn.knn(queries, database, k, metric)
    if index_type == "ivf":
        lists, centroids, probes = train(database, nlist, nprobe, metric)
        return lambda queries, k: search(queries, lists, centroids, k, probes, metric)
    if index_type == "hnsw":
        if metric != "l2":  # projections are Euclidean; on unit vectors both orders agree
            return lambda queries, k: lsh_search(queries, database, k).withColumn("score", 1 - F.col("score") / 2)
        return lambda queries, k: lsh_search(queries, database, k)
    raise ValueError(f"unknown index type {index_type!r}")
