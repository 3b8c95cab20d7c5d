"""Exact nearest neighbours.

The default plan scores blocks in one pass over the database. Up to QUERY_BLOCK queries are broadcast, and
the database streams past in Arrow batches; more are written to the shared folder, from which each task
reads them block by block against CHUNK rows of the database that it holds, so the driver never sees
them. The best k per query are found with one matrix product, and only k rows per query and task (or
chunk) are shuffled. The product
picks candidates with a margin above its rounding error; survivors are scored again element by element, so
scores and ties are those of the declarative plan. ``knn_expression`` is that plan, for small inputs and as
a check. Null vectors, of queries or of the database, are left out.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from waymark.functions import vectors
from waymark.operators.shared import fresh_path, parquet_batches

#: Queries of one broadcast; memory is this times the dimension times eight bytes.
QUERY_BLOCK = 4096
#: Rows of the database that meet a block at once.
ROWS_AT_ONCE = 1024
#: Rows of the database that a task holds against queries from the shared folder.
CHUNK = 1 << 17
#: Rounding of the product, relative to the squared norms: this times the dimension.
ROUNDING = 8 * float(np.finfo(np.float64).eps)


def ranked(scored: DataFrame, k: int, metric: str, query_id: str = "query_id", item_id: str = "item_id") -> DataFrame:
    """The k best per query with their rank; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(vectors.best_first(metric), item_id))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_expression(queries: DataFrame, database: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, item_id, score) by a broadcast nested loop over the query set."""
    q = queries.select("query_id", F.col("vec").alias("query_vec"))
    pairs = database.select("item_id", "vec").crossJoin(F.broadcast(q))
    scored = pairs.select("query_id", "item_id", vectors.score(metric, "query_vec", "vec").alias("score"))
    return ranked(scored, k, metric).select("query_id", "rank", "item_id", "score")


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def direct(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of row pairs, summed from the first element to the last."""
    terms = (q - x) ** 2 if metric == "l2" else q * x
    return np.add.accumulate(terms, axis=1)[:, -1] if terms.shape[1] else np.zeros(len(terms))


def nearest(q: np.ndarray, x: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, database row, score) of every pair that may be among the k best of its query."""
    product, qq, xx = q @ x.T, (q**2).sum(1), (x**2).sum(1)
    rough = qq[:, None] - 2 * product + xx[None] if metric == "l2" else -product
    if rough.shape[1] > k:
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
        off = ROUNDING * q.shape[1] * (qq + xx.max())  # |q| |x| is no more than half of it
        i, j = np.nonzero(rough <= (edge + 2 * off)[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    return i, j, direct(metric, q[i], x[j])


def without_self(results: DataFrame, k: int) -> DataFrame:
    """The k best results of each query that are not the query itself."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return results.where(F.col("query_id") != F.col("item_id")).withColumn("rank", place).where(F.col("rank") <= k)


def knn(queries: DataFrame, database: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, rank, item_id, score): the exact k nearest of ``database`` (item_id, vec) for each of
    ``queries`` (query_id, vec); squared distance ascending, or inner product descending."""
    return scan(queries, database, k, metric)


def scan(queries: DataFrame, database: DataFrame, k: int, metric: str, probed=None) -> DataFrame:
    """As ``knn``. With ``probed``, the database also has a ``list_id``; the function says of a query matrix
    which rows look into which list: {list_id: rows}, and only those lists are read."""
    if metric not in ("l2", "ip"):
        raise ValueError(f"unknown metric {metric!r}")
    if k < 1:
        raise ValueError("k must be at least 1")
    spark, types = database.sparkSession, dict(database.dtypes)
    queries, database = queries.where("vec IS NOT NULL").select("query_id", "vec"), database.where("vec IS NOT NULL")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(sys.modules[parquet_batches.__module__])
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    columns = ["item_id", "vec", *(["list_id"] if probed else [])]
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item_id {types['item_id']}, score double"
    head = queries.limit(QUERY_BLOCK + 1).collect()
    if len(head) <= QUERY_BLOCK:
        ids, matrix = [r["query_id"] for r in head], np.array([r["vec"] for r in head], np.float64)
        asked = probed(matrix) if probed and head else None
        block = spark.sparkContext.broadcast((ids, matrix, asked))

        def search(batches):
            (ids, q, asked), best = block.value, None
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS_AT_ONCE) if ids else ():
                    best = _better(best, q, batch.slice(at, ROWS_AT_ONCE), asked, k, metric)
            if best is not None:
                yield from _named(best, pa.array(ids, kind)).to_batches()

        read = database.where(F.col("list_id").isin(list(asked))) if asked else database
    else:
        path = fresh_path(spark, "queries")
        queries.write.parquet(path)
        read = database

        def search(batches):
            for chunk in _chunks(batches):
                for block in parquet_batches(path, QUERY_BLOCK):
                    q = _matrix(block.column("vec"))
                    asked, best = probed(q) if probed else None, None
                    for at in range(0, chunk.num_rows, ROWS_AT_ONCE):
                        best = _better(best, q, chunk.slice(at, ROWS_AT_ONCE), asked, k, metric)
                    if best is not None:
                        yield from _named(best, block.column("query_id")).to_batches()

    out = read.select(*columns).mapInArrow(search, schema)
    return ranked(out, k, metric).select("query_id", "rank", "item_id", "score")


def _chunks(batches):
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _better(best: pa.Table | None, q: np.ndarray, part: pa.RecordBatch, asked: dict | None, k: int, metric: str) -> pa.Table | None:
    """The k best of each query among ``best`` and the rows of ``part``."""
    for rows, some in _in_lists(part, asked, len(q)):
        i, j, s = nearest(q[rows], _matrix(some.column("vec")), k, metric)
        found = pa.table({"query_row": rows[i].astype(np.int32), "item_id": some.column("item_id").take(pa.array(j)), "score": s})
        best = _best(found if best is None else pa.concat_tables([best, found]), k, metric)
    return best


def _named(best: pa.Table, ids: pa.Array) -> pa.Table:
    return pa.table({"query_id": ids.take(best.column("query_row").combine_chunks()), "item_id": best.column("item_id"), "score": best.column("score")}).combine_chunks()


def _in_lists(part: pa.RecordBatch, asked: dict | None, n: int):
    """(query rows, database rows) that are to be compared."""
    if asked is None:
        yield np.arange(n), part
        return
    lists = part.column("list_id").to_numpy(zero_copy_only=False)
    for x in np.unique(lists):
        if len(rows := asked.get(int(x), ())):
            yield rows, part.take(pa.array(np.flatnonzero(lists == x)))


def _best(found: pa.Table, k: int, metric: str) -> pa.Table:
    """The k best rows of each query, ties by id."""
    found = found.sort_by([("query_row", "ascending"), ("score", "ascending" if metric == "l2" else "descending"), ("item_id", "ascending")])
    q = found.column("query_row").to_numpy()
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return found.filter(pa.array(place < k))


def majority_vote(results: DataFrame, locations: DataFrame) -> DataFrame:
    """(query_id, predicted, confidence): the most frequent location of a query's results, ties to the
    one that ranks first. ``locations``: (item_id, location)."""
    labelled = results.join(locations, "item_id")
    votes = labelled.groupBy("query_id", "location").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    won = votes.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("first")).alias("r"), "location")).alias("w"), F.sum("n").alias("all"))
    return won.select("query_id", F.col("w.location").alias("predicted"), (F.col("w.n") / F.col("all")).alias("confidence"))
