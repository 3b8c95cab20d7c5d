"""Near-duplicate images by the Hamming distance of perceptual hashes."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import vectors
from waymark.operators.shared import fresh_path, parquet_batches

THRESHOLD = 8
#: Hashes of a block, which a task compares with others; a small table is cut into SMALL blocks of LEAST or more.
BLOCK, LEAST, SMALL = 1 << 14, 1 << 10, 16
#: Rows and columns of distances computed at once, and pairs that a worker holds.
TILE, HELD = (64, 4096), 1 << 17


def all_pairs(hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b, by comparing every pair: the definition, for checks."""
    a, b = (hashes.select(F.col("id").alias(f"id_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    pairs = a.join(b, F.col("id_a") < F.col("id_b")).withColumn("distance", vectors.hamming("bits_a", "bits_b"))
    return pairs.where(F.col("distance") <= threshold).select("id_a", "id_b", "distance")


def bands(bits: Column | str, n_bits: int, threshold: int) -> Column:
    """threshold + 1 bands (band, value): hashes within the threshold agree in one at least."""
    n = threshold + 1
    ends = [round(i * n_bits / n) for i in range(n + 1)]
    cut = [F.struct(F.lit(i).alias("band"), F.concat_ws("", F.transform(F.slice(bits, ends[i] + 1, ends[i + 1] - ends[i]), lambda x: x.cast("int").cast("string"))).alias("value")) for i in range(n)]
    return F.array(*cut)


def banded_pairs(hashes: DataFrame, n_bits: int, threshold: int = THRESHOLD) -> DataFrame:
    """The same pairs through an equi-join on bands; ``bits`` of null hashes match nothing.

    Equal hashes are one class: copies meet as (smallest id, id) only, so a group of n equal hashes
    yields n - 1 pairs and not n * n. ``expand_classes`` gives all pairs where they are wanted.
    """
    classes = hashes.where("bits IS NOT NULL").groupBy("bits").agg(F.min("id").alias("id"))
    each = classes.select("id", vectors.pack_bits("bits").alias("packed"), F.explode(bands("bits", n_bits, threshold)).alias("b")).select("id", "packed", "b.*")
    a, b = (each.select(F.col("id").alias(f"id_{x}"), F.col("packed").alias(f"packed_{x}"), "band", "value") for x in "ab")
    met = a.join(b, ["band", "value"]).where("id_a < id_b").withColumn("distance", vectors.packed_hamming("packed_a", "packed_b"))
    return met.where(F.col("distance") <= threshold).select("id_a", "id_b", "distance").distinct()


def near_tiles(x: np.ndarray, y: np.ndarray, threshold: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) within the threshold, of words (hash, word); of a block with itself, each pair once."""
    kind = np.uint8 if x.shape[1] < 4 else np.uint32
    for left in range(0, len(x), TILE[0]):
        for right in range(left // TILE[1] * TILE[1] if same else 0, len(y), TILE[1]):
            some, others = x[left : left + TILE[0]], y[right : right + TILE[1]]
            apart = np.bitwise_count(some[:, 0, None] ^ others[None, :, 0]).astype(kind, copy=False)
            for w in range(1, x.shape[1]):
                apart += np.bitwise_count(some[:, w, None] ^ others[None, :, w])
            near = (apart <= threshold).ravel()
            if near.size % 8 == 0:  # eight at a time, as few are near
                at = np.flatnonzero(near.view(np.uint64))[:, None] * 8 + np.arange(8)
                at = at[near[at]]
            else:
                at = np.flatnonzero(near)
            i, j = at // len(others) + left, at % len(others) + right
            once = i < j if same else slice(None)
            yield i[once], j[once], apart.ravel()[at][once].astype(np.int32)


def _by_size(path: str) -> dict[int, tuple[pa.Array, np.ndarray]]:
    """The hashes of a block as {number of bits: (ids, words of 64 bits)}."""
    table, out = pa.Table.from_batches(parquet_batches(path, BLOCK)), {}
    for size in table.column("size").unique().to_pylist():
        rows = table.filter(pc.equal(table.column("size"), size)).combine_chunks()
        words = np.array(rows.column("words").combine_chunks().flatten(), np.uint64).reshape(rows.num_rows, -1)
        words = np.pad(words, ((0, 0), (0, words.shape[1] % 2)))
        out[size] = rows.column("id").combine_chunks(), np.ascontiguousarray(words[:, ::2] << np.uint64(32) | words[:, 1::2])
    return out


def _found(path: str, blocks: list[int], own: int, threshold: int) -> Iterator[pa.Table]:
    """Tables (id_a, id_b, distance) of a block's pairs, about HELD rows each. Of two blocks, one has their
    pairs: the smaller of an odd and an even one, the larger of two alike, so that each has about half."""
    mine = _by_size(f"{path}/block={own}")
    for other in blocks:
        if other != own and (other > own) != bool((other + own) % 2):
            continue
        for size, (names, y) in (mine if other == own else _by_size(f"{path}/block={other}")).items():
            ids, x = mine.get(size, (None, ()))
            held, n = [], 0
            for tile in near_tiles(x, y, threshold, other == own) if len(x) and size else ():
                held.append(tile)
                n += len(tile[0])
                if n >= HELD:
                    yield _named(held, ids, names)
                    held, n = [], 0
            if n:
                yield _named(held, ids, names)


def _named(tiles: list, ids: pa.Array, names: pa.Array) -> pa.Table:
    i, j, distance = (np.concatenate(x) for x in zip(*tiles))
    a, b = ids.take(pa.array(i)), names.take(pa.array(j))
    first = pc.less(a, b)
    return pa.table({"id_a": pc.if_else(first, a, b), "id_b": pc.if_else(first, b, a), "distance": distance}).filter(pc.not_equal(a, b))


def _over_blocks(hashes: DataFrame, schema: str, emit) -> DataFrame:
    """What ``emit(path, blocks, block)`` gives for each block of ``hashes``. The blocks lie in the shared folder, from
    which a task reads its own and then, one after the other, those to compare it with."""
    spark = hashes.sparkSession
    for module in (__name__, parquet_batches.__module__, vectors.__name__):
        cloudpickle.register_pickle_by_value(sys.modules[module])
    n, path = hashes.count(), fresh_path(spark, "hashes")
    dealt = hashes.where("id IS NOT NULL AND bits IS NOT NULL AND NOT exists(bits, b -> b IS NULL)").repartition(max(-(-n // BLOCK), min(SMALL, -(-n // LEAST)), 1))
    words = dealt.select(F.spark_partition_id().alias("block"), "id", F.size("bits").alias("size"), vectors.pack_bits("bits").alias("words"))
    words.write.partitionBy("block").parquet(path)
    made = spark.read.schema(words.schema).parquet(path)
    blocks = sorted(r["block"] for r in made.select("block").distinct().collect())

    def compare(batches):
        for batch in batches:
            for at in batch.column("id").to_pylist():
                yield from emit(path, blocks, blocks[at])

    return spark.range(0, len(blocks), 1, max(len(blocks), 1)).mapInArrow(compare, schema.format(id=dict(hashes.dtypes)["id"]))


def compared_pairs(hashes: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs of ``all_pairs`` by comparing blocks of packed hashes with each other: for thresholds so wide that
    bands would bring most pairs together. Equal hashes are pairs like others."""

    def emit(path, blocks, own):
        for found in _found(path, blocks, own, threshold):
            yield from found.combine_chunks().to_batches()

    return _over_blocks(hashes, "id_a {id}, id_b {id}, distance int", emit)


def first_compared(hashes: DataFrame, threshold: int = THRESHOLD, most: int = 20) -> DataFrame:
    """``first_pairs`` of ``compared_pairs``, whose pairs are counted where they are found: a block gives its first
    ``most`` and their number."""
    order = [("distance", "ascending"), ("id_a", "ascending"), ("id_b", "ascending")]

    def emit(path, blocks, own):
        n, best = 0, None
        for found in _found(path, blocks, own, threshold):
            n += found.num_rows
            if best is not None and best.num_rows == most > 0:
                found = found.filter(pc.less_equal(found.column("distance"), best.column("distance")[-1]))
            best = (found if best is None else pa.concat_tables([best, found])).sort_by(order).slice(0, most)
        if n:
            count = pa.nulls(best.num_rows, pa.int64())
            yield from best.append_column("n", count).combine_chunks().to_batches()
            none = [pa.nulls(1, best.schema.field(c).type) for c in ("id_a", "id_b", "distance")]
            yield pa.RecordBatch.from_arrays([*none, pa.array([n], pa.int64())], ["id_a", "id_b", "distance", "n"])

    rows, path = _over_blocks(hashes, "id_a {id}, id_b {id}, distance int, n long", emit), fresh_path(hashes.sparkSession, "first")
    rows.write.parquet(path)
    rows = hashes.sparkSession.read.schema(rows.schema).parquet(path)
    shown = rows.where("n IS NULL").drop("n").orderBy("distance", "id_a", "id_b").limit(most)
    total = rows.agg(F.sum("n").alias("n_pairs"))
    return shown.crossJoin(F.broadcast(total)).withColumn("n_more", F.greatest(F.col("n_pairs") - most, F.lit(0)))


def class_members(hashes: DataFrame) -> DataFrame:
    """(class_id, id) of every hashed image: the smallest id with an equal hash."""
    rows = hashes.where("bits IS NOT NULL")
    first = rows.groupBy("bits").agg(F.min("id").alias("class_id"))
    return rows.join(first, "bits").select("class_id", "id")


def expand_classes(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """All image pairs that the class pairs and memberships stand for, as ``all_pairs`` lists them."""
    a, b = (members.select(F.col("class_id").alias(f"c_{x}"), F.col("id").alias(f"m_{x}")) for x in "ab")
    across = pairs.join(a, F.col("id_a") == F.col("c_a")).join(b, F.col("id_b") == F.col("c_b"))
    across = across.select(F.least("m_a", "m_b").alias("id_a"), F.greatest("m_a", "m_b").alias("id_b"), "distance")
    within = a.join(b, (F.col("c_a") == F.col("c_b")) & (F.col("m_a") < F.col("m_b"))).select(F.col("m_a").alias("id_a"), F.col("m_b").alias("id_b"), F.lit(0).alias("distance"))
    return across.unionByName(within)


def first_pairs(pairs: DataFrame, most: int = 20) -> DataFrame:
    """What a report shows: the first pairs by distance, and how many more there are."""
    shown = pairs.orderBy("distance", "id_a", "id_b").limit(most)
    total = pairs.agg(F.count("*").alias("n_pairs"))
    return shown.crossJoin(F.broadcast(total)).withColumn("n_more", F.greatest(F.col("n_pairs") - most, F.lit(0)))
