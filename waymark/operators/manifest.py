"""Selecting database and query records from a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import EXTRACT_EXTENSIONS, IMAGE_MIME_TYPES, QUERY_EXTENSIONS, extension_of, parent_of, shuffle_key, stem_of, truthy

#: The augmentations in the order in which they are made.
AUGMENTATIONS = (
    "aug_bright", "aug_dark", "aug_overexp", "aug_contrast", "aug_lowcontrast", "aug_desat", "aug_vivid", "aug_warm", "aug_cool", "aug_blur", "aug_blur_hard",
    "aug_noise", "aug_jpeg", "aug_flip", "aug_rot5", "aug_rot355", "aug_crop_tl", "aug_crop_br", "aug_zoom", "aug_skew_h", "aug_skew_v",
)
#: The augmentations that stand in for query images.
SYNTHETIC_QUERIES = ("aug_blur", "aug_dark", "aug_bright", "aug_skew_h")
MANIFEST_SCHEMA = "image_id string, location string, filename string, path string, original string, width int, height int, augmented string, aug_type string"


def is_augmented(df: DataFrame) -> Column:
    """Records without the column count as originals."""
    return truthy(F.col("augmented").cast("string")) if "augmented" in df.columns else F.lit(False)


def select_database(manifest: DataFrame, include_augmented: bool = False) -> DataFrame:
    return manifest if include_augmented else manifest.where(~is_augmented(manifest))


def select_synthetic(manifest: DataFrame, aug_types=SYNTHETIC_QUERIES) -> DataFrame:
    return manifest.where(is_augmented(manifest) & F.col("aug_type").isin(*aug_types))


def exclude_indexed(queries: DataFrame, indexed: DataFrame) -> DataFrame:
    """Queries whose image_id is not among the indexed ones; repeated queries stay."""
    return queries.join(indexed.select("image_id"), "image_id", "left_anti")


def indexed_ids(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("image_id")
    for t in tables[1:]:
        out = out.union(t.select("image_id"))
    return out.distinct()


def with_locations(manifest: DataFrame) -> DataFrame:
    """Missing locations become the parent folder."""
    return manifest.withColumn("location", F.coalesce("location", parent_of("path")))


def collect_manifest(manifest: DataFrame, files: DataFrame, skip_augmented: bool = True, extensions=EXTRACT_EXTENSIONS) -> DataFrame:
    """(path, image_id, location, augmented) of records whose file is listed in ``files`` (path) and
    has an allowed extension."""
    rows = with_locations(select_database(manifest, not skip_augmented)).where(extension_of("path").isin(*extensions))
    return rows.join(files.select("path"), "path", "left_semi").select("path", "image_id", "location", is_augmented(rows).alias("augmented"))


def collect_walk(files: DataFrame, skip_augmented: bool = True, extensions=EXTRACT_EXTENSIONS) -> DataFrame:
    """The same from a file listing (path), where no manifest exists."""
    rows = files.where(extension_of("path").isin(*extensions)).withColumn("augmented", F.contains(stem_of("path"), F.lit("aug_")))
    rows = rows.where(~F.col("augmented")) if skip_augmented else rows
    return rows.select("path", F.concat_ws("/", parent_of("path"), stem_of("path")).alias("image_id"), parent_of("path").alias("location"), "augmented")


def expand_augmentations(originals: DataFrame) -> DataFrame:
    """The manifest of a processed dataset: each original (image_id, location, ...) and its 21 variants."""
    variants = F.array(F.lit(None).cast("string"), *[F.lit(a) for a in AUGMENTATIONS])
    each = originals.withColumn("aug_type", F.explode(variants)).withColumn("original", F.col("image_id"))
    made = F.col("aug_type").isNotNull()
    return each.withColumn("augmented", made).withColumn("image_id", F.when(made, F.concat_ws("_", "image_id", "aug_type")).otherwise(F.col("image_id")))


def check_unique(manifest: DataFrame) -> DataFrame:
    """Raises if two files would share an image_id (same stem, other extension)."""
    twice = manifest.groupBy("image_id").count().where("count > 1").select("image_id").limit(5).collect()
    if twice:
        raise ValueError(f"image ids are not unique: {[r[0] for r in twice]}")
    return manifest


def folder_queries(files: DataFrame, root: str, extensions=QUERY_EXTENSIONS) -> DataFrame:
    """(path, gt_location, query_id) of a query folder: class sub-folders, or flat files without truth
    if there are none in sub-folders."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    rows = files.where(extension_of("path").isin(*extensions))
    above = F.element_at(F.split("path", "/"), -3)  # class folders are one level down
    nested = rows.where((parent_of("path") != name) & (above == name)).select("path", parent_of("path").alias("gt_location"), F.concat_ws("/", parent_of("path"), stem_of("path")).alias("query_id"))
    flat = rows.where(parent_of("path") == name).select("path", F.lit(None).cast("string").alias("gt_location"), stem_of("path").alias("query_id"))
    return nested if nested.limit(1).count() else flat


def manifest_queries(manifest: DataFrame, aug_types=SYNTHETIC_QUERIES, files: DataFrame | None = None, extensions=QUERY_EXTENSIONS) -> DataFrame:
    """Synthetic records that are image files, and exist among ``files`` if those are listed."""
    rows = with_locations(select_synthetic(manifest, aug_types)).where(extension_of("path").isin(*extensions))
    if files is not None:
        rows = rows.join(files.select("path").distinct(), "path", "left_semi")
    return rows.select("path", F.col("location").alias("gt_location"), F.col("image_id").alias("query_id"))


def walk_queries(files: DataFrame, aug_types=SYNTHETIC_QUERIES) -> DataFrame:
    """Without a manifest, every augmentation whose name a file's stem contains yields a query."""
    each = files.withColumn("aug", F.explode(F.array(*map(F.lit, aug_types)))).where(F.contains(stem_of("path"), F.col("aug")))
    return each.select("path", parent_of("path").alias("gt_location"), F.concat_ws("/", parent_of("path"), stem_of("path")).alias("query_id"))


def subsample(queries: DataFrame, most: int | None, seed: int = 42, key: str = "query_id") -> DataFrame:
    """A reproducible draw; no limit if ``most`` is empty."""
    return queries.orderBy(shuffle_key(seed, key), key).limit(most) if most else queries


def to_download(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """Listed files that are not there yet."""
    return listing.join(existing.select("path"), "path", "left_anti")


def classify_listing(listing: DataFrame) -> DataFrame:
    """Adds ``kind``: folder, image or other, by MIME type."""
    mime = F.col("mime_type")
    return listing.withColumn("kind", F.when(mime.endswith("folder"), "folder").when(mime.isin(*IMAGE_MIME_TYPES), "image").otherwise("other"))


def lookup_processed(ids: DataFrame, files: DataFrame, extensions=("jpg", "jpeg", "png")) -> DataFrame:
    """(image_id, path): the processed file of each id of the form location/stem, the first extension
    in order; null where there is none."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), extension_of("path"))
    found = files.select("path", F.concat_ws("/", parent_of("path"), stem_of("path")).alias("id"), rank.alias("rank")).where("rank > 0")
    best = found.groupBy("id").agg(F.min_by("path", "rank").alias("path"))
    two_parts = F.size(F.split("image_id", "/")) == 2
    return ids.join(best, two_parts & (F.col("image_id") == F.col("id")), "left").select("image_id", "path")


def summary(manifest: DataFrame) -> DataFrame:
    """One row: records, locations, originals and augmented."""
    made = is_augmented(manifest)
    return manifest.agg(F.count("*").alias("n_records"), F.count_distinct("location").alias("n_locations"), F.count_if(~made).alias("n_originals"), F.count_if(made).alias("n_augmented"))


def batch_queries(files: DataFrame, root: str, extensions=QUERY_EXTENSIONS) -> DataFrame:
    """(path, gt_location, query_id) of every image below a folder; the parent folder is the truth
    unless it is the folder itself."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    parent = parent_of("path")
    rows = files.where(extension_of("path").isin(*extensions))
    return rows.select("path", F.when(~parent.isin(name, "."), parent).alias("gt_location"), stem_of("path").alias("query_id"))


def collect_queries(query_files: DataFrame | None, query_root: str, manifest: DataFrame | None, files: DataFrame | None, indexed: DataFrame | None = None, aug_types=SYNTHETIC_QUERIES, most: int | None = None, seed: int = 42) -> DataFrame:
    """(path, gt_location, query_id): a query folder if there is one, else synthetic queries of the
    manifest, else of the processed files. Synthetic ones that are indexed drop out."""
    if query_files is not None:
        found = folder_queries(query_files, query_root)
    else:
        found = manifest_queries(manifest, aug_types, files) if manifest is not None else walk_queries(files, aug_types)
        if indexed is not None:
            found = found.join(indexed.select(F.col("image_id").alias("query_id")), "query_id", "left_anti").select("path", "gt_location", "query_id")
    return subsample(found, most, seed)


def transfer_counts(log: DataFrame) -> DataFrame:
    """(status, n) of a download log (path, status): downloaded, skipped or failed."""
    return log.groupBy("status").agg(F.count("*").alias("n"))
