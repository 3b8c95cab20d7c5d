"""Image operators over DataFrames: pixels travel as raw RGB bytes with their dimensions.

``images``: (image_id, location, height, width, rgb). All kernels run per Arrow batch, one image at a
time, so memory is bounded by a batch; narrow batches suit large images (MAX_BATCH).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import features, pixels
from waymark.operators.manifest import AUGMENTATIONS

SCHEMA = "image_id string, location string, height int, width int, rgb binary"
#: Suggested value of spark.sql.execution.arrow.maxRecordsPerBatch for full-size images.
MAX_BATCH = 256


def _ship() -> None:
    cloudpickle.register_pickle_by_value(pixels)
    cloudpickle.register_pickle_by_value(features)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def array_of(row) -> np.ndarray:
    return np.frombuffer(row.rgb, np.uint8).reshape(row.height, row.width, 3)


def _mapped(images: DataFrame, each: Callable, schema: str) -> DataFrame:
    """``each(row, array)`` yields output tuples."""
    _ship()
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([out for row in batch.itertuples(index=False) for out in each(row, array_of(row))], columns=names)

    return images.select("image_id", "location", "height", "width", "rgb").mapInPandas(run, schema)


def from_spark_images(df: DataFrame, location, image_id) -> DataFrame:
    """From Spark's image source (BGR, BGRA or gray bytes); unreadable files are left out."""
    i = "image"
    rows = df.where(F.col(f"{i}.width") > 0).select(image_id.alias("image_id"), location.alias("location"), F.col(f"{i}.height").alias("height"), F.col(f"{i}.width").alias("width"), F.col(f"{i}.nChannels").alias("n"), F.col(f"{i}.data").alias("data"))

    def swap(batches):
        for b in batches:
            rgb = []
            for row in b.itertuples(index=False):
                a = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.n)
                rgb.append((np.repeat(a, 3, 2) if row.n == 1 else a[..., 2::-1]).tobytes())
            yield b.assign(rgb=rgb)[["image_id", "location", "height", "width", "rgb"]]

    return rows.mapInPandas(swap, SCHEMA)


def prepare(images: DataFrame, target: tuple[int, int] = pixels.TARGET, equalize: bool = True) -> DataFrame:
    """Resized, padded and, if asked for, equalised images."""

    def each(row, a):
        out = pixels.resize_and_pad(a, target)
        yield row.image_id, row.location, target[1], target[0], (pixels.equalized(out) if equalize else out).tobytes()

    return _mapped(images, each, SCHEMA)


def augment(images: DataFrame, kinds=AUGMENTATIONS, seed: int = 42) -> DataFrame:
    """Each image and its variants, with ``original``, ``augmented`` and ``aug_type``."""

    def each(row, a):
        yield row.image_id, row.location, row.height, row.width, row.rgb, row.image_id, False, None
        for kind in kinds:
            yield f"{row.image_id}_{kind}", row.location, row.height, row.width, pixels.augmented(a, kind, seed).tobytes(), row.image_id, True, kind

    return _mapped(images, each, SCHEMA + ", original string, augmented boolean, aug_type string")


def image_stats(images: DataFrame) -> DataFrame:
    """Records for ``stats``: size, channel means and their mean."""

    def each(row, a):
        m = a.reshape(-1, 3).mean(0)
        yield row.location, row.image_id, row.height, row.width, float(m[0]), float(m[1]), float(m[2]), float(a.mean())

    return _mapped(images, each, "location string, filename string, height int, width int, mean_r double, mean_g double, mean_b double, brightness double")


def perceptual_hashes(images: DataFrame) -> DataFrame:
    """(id, bits) for ``near_dup``."""
    return _mapped(images, lambda row, a: [(row.image_id, pixels.hash_bits(pixels.gray(a)).tolist())], "id string, bits array<boolean>")


def local_features(images: DataFrame, extract: Callable[[np.ndarray], np.ndarray] = pixels.dense_gradients) -> DataFrame:
    """(image_id, local_id, vec): local descriptors by ``extract(gray image)``; images without any
    yield no row, and get zero vectors from ``codebook.bow`` and ``codebook.vlad``."""
    return _mapped(images, lambda row, a: [(row.image_id, i, v.tolist()) for i, v in enumerate(extract(pixels.gray(a)))], "image_id string, local_id int, vec array<float>")


def encode(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], batch: int = 32) -> DataFrame:
    """(image_id, location, vec): a global descriptor per image, scaled to length 1. ``model`` maps
    (n, 224, 224, 3) inputs to (n, d) outputs and is called on batches of at most ``batch``."""
    _ship()

    def run(batches):
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                out = np.asarray(model(np.stack([pixels.model_input(array_of(r)) for r in part.itertuples(index=False)])), np.float64)
                out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)
                yield part[["image_id", "location"]].assign(vec=list(out.astype(np.float32)))

    return images.select("image_id", "location", "height", "width", "rgb").mapInPandas(run, "image_id string, location string, vec array<float>")


def encode_patches(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], batch: int = 32) -> DataFrame:
    """(image_id, local_id, vec): patch tokens of a model that maps (n, 224, 224, 3) to (n, p, d)."""
    _ship()

    def run(batches):
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                tokens = np.asarray(model(np.stack([pixels.model_input(array_of(r)) for r in part.itertuples(index=False)])), np.float32)
                yield pd.DataFrame([(i, k, v.tolist()) for i, t in zip(part.image_id, tokens) for k, v in enumerate(t)], columns=["image_id", "local_id", "vec"])

    return images.select("image_id", "location", "height", "width", "rgb").mapInPandas(run, "image_id string, local_id int, vec array<float>")
