"""Answering a stream of query vectors against a stored database (an extension: the batch plan, run
for each micro-batch)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from waymark.operators import knn


def answer_stream(queries: DataFrame, database: DataFrame, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, metric: str = "l2") -> StreamingQuery:
    """Each micro-batch of (query_id, vec) is answered exactly; ``sink(results, batch_id)`` stores it
    and must overwrite by batch_id to be exactly-once."""
    return queries.writeStream.foreachBatch(lambda batch, i: sink(knn.knn(batch, database, k, metric), i)).option("checkpointLocation", checkpoint).start()
