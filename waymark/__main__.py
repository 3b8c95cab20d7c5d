"""python -m waymark COMMAND: preprocess, stats, split, extract, index, query, evaluate, demo.

Folders: raw/<location>/<image>, processed images as one Parquet table with manifest.csv beside it,
and a models folder with one table per artifact.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import registry
from waymark.functions.scalars import EXTRACT_EXTENSIONS, extension_of
from waymark.operators import images, ivf, knn, manifest, near_dup, split, stats
from waymark.plans import retrieval
from waymark.session import session
from waymark.sources import images as store

#: Methods whose features need no model.
LOCAL = ("sift", "orb")
SHOWN = 20


def models_of(a) -> dict:
    """Functions given as --model method=module:name; see ``retrieval.extract`` for what they return."""
    out = {}
    for said in filter(None, a.model.split(",")):
        key, _, place = said.partition("=")
        module, _, name = place.partition(":")
        out[registry.method(key).key] = getattr(importlib.import_module(module), name)
    return out


def methods_of(a) -> dict:
    """{method: its model or None} that the options ask for; an error if a model is missing."""
    given = models_of(a)
    keys = registry.resolve_methods(a.method)
    if missing := [k for k in keys if k not in LOCAL and k not in given]:
        raise SystemExit(f"{', '.join(missing)}: needs a model, given as --model {missing[0]}=module:function; without one, ask for {' or '.join(LOCAL)}")
    return {k: given.get(k) for k in keys}


def shown(df: DataFrame, path: str, *order: str) -> None:
    """Writes all rows as CSV and prints the first."""
    df.write.mode("overwrite").option("header", "true").csv(path)
    done = df.sparkSession.read.option("header", "true").csv(path)
    print(f"{done.count()} rows in {path}; the first {SHOWN}:")
    df.orderBy(*order).show(SHOWN, truncate=False)


def processed(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/images")


def preprocess(spark, a) -> None:
    pics = images.prepare(store.read_images(spark, a.raw), (a.width, a.height), not a.no_clahe)
    every = images.augment(pics, () if a.no_aug or a.query_mode else manifest.AUGMENTATIONS, a.seed)
    if a.dry_run:
        print(pics.count(), "images")
        return
    store.write_table(every, f"{a.out}/images")
    done = processed(spark, a.out)
    name = F.concat(F.split_part("image_id", F.lit("/"), F.lit(2)), F.lit(".jpg"))
    records = done.select("image_id", "location", name.alias("filename"), F.concat_ws("/", F.lit(a.out), "location", name).alias("path"), "original", "width", "height", "augmented", "aug_type")
    store.write_manifest(manifest.check_unique(records), f"{a.out}/manifest.csv")
    manifest.summary(records).show()


def show_stats(spark, a) -> None:
    pics = processed(spark, a.data).where("NOT augmented")
    path = f"{a.out}/dataset_stats.csv"
    images.image_stats(pics).write.mode("overwrite").option("header", "true").csv(path)
    records = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    lines = stats.report_lines(stats.overall_stats(records), stats.location_stats(records))
    if not a.no_duplicates:
        hashes = images.perceptual_hashes(pics)
        found = near_dup.first_pairs(near_dup.expand_classes(near_dup.banded_pairs(hashes, 256), near_dup.class_members(hashes)))
        place = F.row_number().over(Window.orderBy("distance", "id_a", "id_b")) + (1 << 30)
        lines = lines.unionByName(found.select(place.alias("line_no"), F.format_string("near duplicates at %d bits: %s %s (%d more)", "distance", "id_a", "id_b", "n_more").alias("line")))
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(f"{a.out}/dataset_report")
    spark.read.text(f"{a.out}/dataset_report").show(SHOWN, truncate=False)


def make_split(spark, a) -> None:
    """Records whose image is there; a missing location is the parent folder's name."""
    records = manifest.with_locations(store.read_manifest(spark, f"{a.data}/manifest.csv")).where(extension_of("path").isin(*EXTRACT_EXTENSIONS))
    records = records.join(processed(spark, a.data).select("image_id").distinct(), "image_id", "left_semi")
    sides = split.stratified_split(manifest.select_database(records).select("path", "image_id", "location"), a.ratio, a.seed)
    train, test = (sides.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    if a.include_aug:
        train = split.train_with_augmented(train, records.where(manifest.is_augmented(records)).select("path", "image_id", "location"))
    store.write_split(train, test, a.out)
    split.split_summary(train, test).orderBy("location").show()


def extract(spark, a) -> None:
    pics, with_made = processed(spark, a.data), a.include_aug and not a.no_aug
    pics = pics if with_made else pics.where("NOT augmented")
    methods = methods_of(a)
    for key, model in methods.items():
        store.write_table(retrieval.extract(pics, key, a.models, model, rebuild=a.rebuild_codebooks), f"{a.models}/{registry.descriptor_name(key)}")
    store.write_metadata(retrieval.extraction_metadata(pics, a.data, with_made, a.seed, list(methods)), f"{a.models}/extraction_metadata.json")


def index(spark, a) -> None:
    for key in registry.resolve_methods(a.method):
        vecs = spark.read.parquet(f"{a.models}/{registry.descriptor_name(key)}")
        name = f"{a.models}/{registry.index_name(key, a.index_type)}"
        if a.index_type == "ivf":
            lists, centres, _ = ivf.train(vecs.withColumnRenamed("image_id", "item_id"), a.nlist, a.nprobe, registry.method(key).metric)
            store.write_table(centres, f"{name}.centroids")
            ivf.write_lists(lists, name)
        else:
            store.write_table(vecs, name)
        store.write_metadata(retrieval.index_metadata(vecs, key, a.index_type, a.nlist, a.nprobe, a.hnsw_m), f"{a.models}/{key}_{a.index_type}_metadata.json")


def searcher(spark, a, key: str):
    """(descriptors, search function) of one method; from its stored index where there is one."""
    vecs = spark.read.parquet(f"{a.models}/{registry.descriptor_name(key)}")
    path = f"{a.models}/{registry.index_name(key, a.index_type)}"
    if a.index_type == "ivf":
        lists, centres = spark.read.parquet(path), spark.read.parquet(f"{path}.centroids")
        return vecs, lambda q, k: ivf.search(q, lists, centres, k, a.nprobe, registry.method(key).metric)
    return vecs, retrieval.build_index(spark.read.parquet(path) if store.exists(spark, path) else vecs, key, a.index_type)


def encoded(pics: DataFrame, a, key: str, model) -> DataFrame:
    vecs = retrieval.extract(pics, key, a.models, model, fit=False)
    return vecs.select(F.col("image_id").alias("query_id"), F.col("location").alias("gt_location"), "vec")


def query_pictures(spark, a) -> DataFrame:
    return images.prepare(store.read_images(spark, a.query), equalize=False)


def query(spark, a) -> None:
    for key, model in methods_of(a).items():
        vecs, search = searcher(spark, a, key)
        places = vecs.select(F.col("image_id").alias("item_id"), "location")
        path = f"{a.out}/{key}_{a.index_type}"
        store.write_table(search(encoded(query_pictures(spark, a), a, key, model), a.k), f"{path}_hits")
        found = spark.read.parquet(f"{path}_hits")
        shown(found.join(places, "item_id"), f"{path}_results", "query_id", "rank")
        shown(knn.majority_vote(found, places), f"{path}_votes", "query_id")


def evaluated_pictures(spark, a, vecs: DataFrame) -> DataFrame:
    """The query folder's images; without one, synthetic variants of the processed images that are not
    indexed. At most --max-queries of them, if that is given."""
    if a.query:
        pics = query_pictures(spark, a)
        return pics.join(manifest.subsample(pics.select("image_id"), a.max_queries, a.seed, "image_id"), "image_id", "left_semi") if a.max_queries else pics
    records = store.read_manifest(spark, f"{a.data}/manifest.csv")
    asked = manifest.collect_queries(None, "", records, None, vecs.select("image_id"), most=a.max_queries or None, seed=a.seed)
    return processed(spark, a.data).join(asked.select(F.col("query_id").alias("image_id")).distinct(), "image_id", "left_semi")


def evaluate(spark, a) -> None:
    ks, out = tuple(int(k) for k in a.k.split(",")), None
    for key, model in methods_of(a).items():
        vecs, search = searcher(spark, a, key)
        queries = encoded(evaluated_pictures(spark, a, vecs), a, key, model)
        row = retrieval.evaluate_method(key, queries, search, vecs.select(F.col("image_id").alias("item_id"), "location"), ks)
        row.show(truncate=False)
        out = row if out is None else out.unionByName(row)
    if a.save:
        out.coalesce(1).write.mode("overwrite").option("header", "true").csv(a.save)


def demo(spark, a) -> None:
    for key, model in methods_of(a).items():
        vecs, search = searcher(spark, a, key)
        q = encoded(query_pictures(spark, a), a, key, model)
        paths = vecs.select(F.col("image_id").alias("item_id"), F.concat(F.col("image_id"), F.lit(".jpg")).alias("path"))
        grid = retrieval.result_grid(search(q, a.k), vecs.select(F.col("image_id").alias("item_id"), "location"), q.select("query_id", "gt_location"), paths, registry.method(key).display)
        shown(grid, f"{a.out}/{key}_{a.index_type}_grid", "query_id", "col")


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="waymark")
    top.add_argument("--master", default="local[*]")
    commands = top.add_subparsers(required=True)

    def command(name, run, *options):
        p = commands.add_parser(name)
        for flag, value in options:
            p.add_argument(flag, **({"action": "store_true"} if value is False else {"default": value, "type": type(value)} if value is not None else {"required": True}))
        p.set_defaults(run=run)

    chosen = [("--models", "models"), ("--method", "both"), ("--model", "")]
    found = [*chosen, ("--index-type", "flat"), ("--nprobe", 10)]
    command("preprocess", preprocess, ("--raw", "data/raw"), ("--out", "data/processed"), ("--width", 640), ("--height", 480), ("--no-clahe", False), ("--no-aug", False), ("--query-mode", False), ("--dry-run", False), ("--seed", 42))
    command("stats", show_stats, ("--data", "data/processed"), ("--out", "results"), ("--no-duplicates", False))
    command("split", make_split, ("--data", "data/processed"), ("--out", "data/splits"), ("--ratio", 0.2), ("--seed", 42), ("--include-aug", False))
    command("extract", extract, ("--data", "data/processed"), *chosen, ("--include-aug", False), ("--no-aug", False), ("--rebuild-codebooks", False), ("--seed", 42))
    command("index", index, *found, ("--nlist", 64), ("--hnsw-m", 32))
    command("query", query, ("--query", None), ("--k", 5), ("--out", "results"), *found)
    command("evaluate", evaluate, ("--query", ""), ("--data", "data/processed"), ("--max-queries", 0), ("--k", "1,3,5,10"), ("--seed", 42), ("--save", ""), *found)
    command("demo", demo, ("--query", None), ("--k", 5), ("--out", "results"), *found)
    a = top.parse_args(argv)
    a.run(session(a.master), a)


if __name__ == "__main__":
    main()
