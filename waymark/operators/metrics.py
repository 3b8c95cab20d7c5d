"""Ranking metrics over search results.

``results``: (query_id, rank, item_id, score); ``locations``: (item_id, location); ``truth``:
(query_id, gt_location), where a null or empty location has no ground truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def relevant_counts(locations: DataFrame) -> DataFrame:
    return locations.groupBy("location").agg(F.count("*").alias("n_relevant"))


def eligible(truth: DataFrame, locations: DataFrame) -> DataFrame:
    """(query_id, gt_location, n_relevant) of queries with a ground truth that the database holds."""
    counts = relevant_counts(locations).withColumnRenamed("location", "gt_location")
    return truth.where("gt_location IS NOT NULL AND CAST(gt_location AS STRING) <> ''").join(counts, "gt_location").select("query_id", "gt_location", "n_relevant")


def hits(results: DataFrame, locations: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, rank, hit) of every result; without a ground truth nothing is a hit."""
    same = results.join(locations, "item_id").join(truth, "query_id")
    return same.select("query_id", "rank", F.coalesce((F.col("location") == F.col("gt_location")) & (F.col("gt_location").cast("string") != ""), F.lit(False)).alias("hit"))


def topk_hits(hit_rows: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """(query_id, hit_<k>...): whether one of the first k results is right, from one search."""
    return hit_rows.groupBy("query_id").agg(*[F.coalesce(F.max(F.col("hit") & (F.col("rank") <= k)), F.lit(False)).alias(f"hit_{k}") for k in ks])


def average_precision(hit_rows: DataFrame, totals: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, ap) for the queries of ``totals`` (query_id, n_relevant): precisions at the hits,
    summed and divided by the hits that were possible within the cutoff."""
    rows = hit_rows.where(F.col("rank") <= k) if k else hit_rows
    running = F.sum(F.col("hit").cast("long")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    at_hits = rows.withColumn("precision", F.when(F.col("hit"), running / F.col("rank")))
    sums = at_hits.groupBy("query_id").agg(F.sum("precision").alias("got"), F.count("*").alias("cutoff"))
    possible = F.least(F.col("n_relevant"), F.coalesce("cutoff", F.lit(0)))
    return totals.join(sums, "query_id", "left").select("query_id", F.when(possible > 0, F.coalesce("got", F.lit(0.0)) / possible).otherwise(0.0).alias("ap"))


def evaluate(results: DataFrame, locations: DataFrame, truth: DataFrame, ks=(1, 3, 5, 10)) -> DataFrame:
    """One row: n_queries, map, top<k>_acc, over the eligible queries."""
    totals = eligible(truth, locations)
    rows = hits(results, locations, totals)
    each = average_precision(rows, totals, max(ks)).join(topk_hits(rows, ks), "query_id", "left")
    share = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return each.agg(F.count("*").alias("n_queries"), share("ap").alias("map"), *[share(F.coalesce(F.col(f"hit_{k}").cast("double"), F.lit(0.0))).alias(f"top{k}_acc") for k in ks])


def by_group(results: DataFrame, locations: DataFrame, truth: DataFrame, group: str, ks=(1, 5)) -> DataFrame:
    """Top-k accuracy per ``group`` of the queries (robustness per augmentation)."""
    rows = topk_hits(hits(results, locations, truth), ks).join(truth.select("query_id", group), "query_id")
    return rows.groupBy(group).agg(F.count("*").alias("n_queries"), *[F.avg(F.col(f"hit_{k}").cast("double")).alias(f"top{k}_acc") for k in ks])


def index_megabytes(database: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: vectors, dimension, and the size of that many single-precision numbers."""
    out = database.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size(vec)), F.lit(0)).alias("dimension"))
    return out.withColumn("index_mb", F.col("vectors") * F.col("dimension") * 4 / F.lit(1048576.0))
