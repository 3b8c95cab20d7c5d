import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark import catalogue
from waymark.functions import features, pixels, registry, vectors
from waymark.functions.scalars import truthy
from waymark.operators import codebook, images, ivf, knn, manifest, metrics, near_dup, split, stats
from waymark.plans import retrieval
from waymark.sources import images as store


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def ranked(spark, places, truth, total):
    res = spark.createDataFrame([("q", i + 1, i, 0.0) for i in range(len(places))], "query_id string, rank int, item_id int, score double")
    loc = spark.createDataFrame(list(enumerate(places)), "item_id int, location string")
    tr = spark.createDataFrame([("q", truth)], "query_id string, gt_location string")
    return metrics.hits(res, loc, tr), spark.createDataFrame([("q", total)], "query_id string, n_relevant long")


def test_average_precision(spark):
    hits, total = ranked(spark, ["hall", "cafeteria", "hall", "hall"], "hall", 4)
    assert metrics.average_precision(hits, total, 4).first()["ap"] == pytest.approx((1 + 2 / 3 + 3 / 4) / 4)
    hits, total = ranked(spark, ["hall"] * 3, "hall", 20)
    assert metrics.average_precision(hits, total, 3).first()["ap"] == 1.0
    hits, total = ranked(spark, ["hall"] * 3, "hall", 0)
    assert metrics.average_precision(hits, total, 3).first()["ap"] == 0.0


@pytest.mark.parametrize("truth, hit", [(None, False), ("", False), ("cafeteria", False), ("stairs", True)])
def test_topk_hit(spark, truth, hit):
    hits, _ = ranked(spark, ["hall", "stairs"], truth, 1)
    assert metrics.topk_hits(hits, (2,)).first()["hit_2"] is hit


def test_relevant_counts_and_locations(spark):
    ids = spark.createDataFrame([("hall/img001",), ("hall/img002",), ("stairs/img001",), ("flat_label",)], "id string")
    from waymark.functions.scalars import location_of

    assert rows(metrics.relevant_counts(ids.select(location_of("id").alias("location")))) == [("flat_label", 1), ("hall", 2), ("stairs", 1)]


def test_evaluate_nothing(spark):
    out = metrics.evaluate(*(spark.createDataFrame([], s) for s in ("query_id int, rank int, item_id int, score double", "item_id int, location string", "query_id int, gt_location string"))).first()
    assert out["n_queries"] == 0 and out["map"] == 0.0 and out["top5_acc"] == 0.0


def test_truthy(spark):
    df = spark.createDataFrame([(" TRUE ",), ("yes",), ("1",), ("false",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(truthy("c")).collect()] == [True, True, True, False, False, False]


def test_manifest_selection(spark):
    m = spark.createDataFrame([("a/1", "false", None), ("a/1_b", "True", "aug_blur"), ("a/1_w", "true", "aug_warm"), ("a/2", None, None)], "image_id string, augmented string, aug_type string")
    assert rows(manifest.select_database(m), "image_id") == [("a/1",), ("a/2",)]
    assert manifest.select_database(m, True).count() == 4
    assert rows(manifest.select_synthetic(m, ["aug_blur"]), "image_id") == [("a/1_b",)]
    assert rows(manifest.exclude_indexed(m, m.where("image_id = 'a/1'")), "image_id") == [("a/1_b",), ("a/1_w",), ("a/2",)]
    with pytest.raises(ValueError):
        manifest.check_unique(m.union(m))


def test_fallback_walk_sees_written_names(spark):
    files = spark.createDataFrame([("x/hall/a.jpg",), ("x/hall/a_aug_blur.jpg",), ("x/hall/b.tiff",), ("x/hall/a_aug_blur_hard.jpg",)], "path string")
    assert rows(manifest.collect_walk(files), "image_id") == [("hall/a",)]
    assert rows(manifest.walk_queries(files, ["aug_blur"]), "query_id") == [("hall/a_aug_blur",), ("hall/a_aug_blur_hard",)]
    listed = spark.createDataFrame([("hall/a", None, "x/hall/a.jpg", "no"), ("hall/z", "hall", "x/hall/z.jpg", "no")], "image_id string, location string, path string, augmented string")
    assert rows(manifest.collect_manifest(listed, files), "image_id", "location") == [("hall/a", "hall")]


def test_query_folder(spark):
    nested = spark.createDataFrame([("q/hall/a.jpg",), ("q/b.jpg",)], "path string")
    assert rows(manifest.folder_queries(nested, "q")) == [("q/hall/a.jpg", "hall", "hall/a")]
    flat = spark.createDataFrame([("q/b.jpg",)], "path string")
    assert manifest.folder_queries(flat, "q").first() == ("q/b.jpg", None, "b")


def test_registry():
    assert registry.resolve_methods("sift") == ["sift"] and registry.resolve_methods("both") == ["sift", "dinov2"]
    assert registry.resolve_methods("all") == ["sift", "orb", "dinov2", "anyloc", "cnn"]
    assert [registry.index_name(*x) for x in (("sift", "flat"), ("orb", "flat"), ("dinov2", "ivf"), ("anyloc", "hnsw"))] == ["sift_vlad.index", "orb_bow.index", "dinov2_ivf.index", "anyloc_dinov2_vlad_hnsw.index"]
    assert registry.descriptor_name("orb") == "orb_descriptors.npy" and registry.label_name("anyloc") == "anyloc_dinov2_vlad_labels.npy"
    assert registry.codebook_name("sift") == "sift_codebook.npy" and registry.codebook_name("cnn") is None
    with pytest.raises(ValueError):
        registry.resolve_methods("surf")


def test_split_guarantees(spark):
    recs = spark.createDataFrame([(f"{loc}/{i}", loc) for loc, n in (("one", 1), ("two", 2), ("many", 100)) for i in range(n)], "image_id string, location string")
    s = split.stratified_split(recs, 0.55)
    counts = {tuple(r[:2]): r[2] for r in s.groupBy("location", "split").count().collect()}
    assert counts == {("one", "train"): 1, ("two", "train"): 1, ("two", "test"): 1, ("many", "test"): 56, ("many", "train"): 44}
    assert rows(s) == rows(split.stratified_split(recs.repartition(7), 0.55))
    only = split.stratified_split(recs.where("location = 'one'"), 0.5)
    assert rows(split.split_summary(only.where("split = 'train'"), only.where("split = 'test'"))) == [("one", 1, 0)]
    with pytest.raises(ValueError):
        split.stratified_split(recs, 1.0)


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6)).round(1)
    v[10] = v[11] = v[12]  # ties
    v[20] = 0
    db = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "item_id long, vec array<float>")
    return db, db.where("item_id % 7 = 0").withColumnRenamed("item_id", "query_id"), v


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_block_search_is_the_expression(spark, cloud, metric, monkeypatch):
    db, q, _ = cloud
    monkeypatch.setattr(knn, "QUERY_BLOCK", 5)
    got = knn.knn(q, db.repartition(3), 4, metric)
    want = knn.knn_expression(q, db, 4, metric)
    rounded = lambda df: rows(df.withColumn("score", F.round("score", 9)))
    assert rounded(got) == rounded(want)
    assert knn.knn(q, db, 1000, metric).count() == q.count() * 120
    with pytest.raises(ValueError):
        knn.knn(q, db, 4, "cosine")


def test_search_of_nothing(spark, cloud):
    db, q, _ = cloud
    assert knn.knn(q.limit(0), db, 3).count() == 0
    assert knn.knn(q, db.limit(0), 3).count() == 0


def test_index_types(spark, cloud):
    db, q, v = cloud
    exact = {(r[0], r[1]): r[2] for r in knn.knn(q, db, 5).collect()}
    lists, centres, _ = ivf.train(db, 4, 4)
    full = {(r[0], r[1]): r[2] for r in ivf.search(q, lists, centres, 5, 4).collect()}
    assert full == exact
    found = {(r[0], r[1]): r[2] for r in ivf.build(db, "hnsw")(q, 5).collect()}
    assert len(found) == len(exact) and sum(found[k] == exact[k] for k in exact) > 0.5 * len(exact)
    assert ivf.adjusted(64, 10, 3) == (3, 3)
    with pytest.raises(ValueError):
        ivf.build(db, "pq")


def test_vote_prefers_the_first_seen(spark):
    res = spark.createDataFrame([("q", 1, 1, 0.0), ("q", 2, 2, 0.0), ("q", 3, 3, 0.0), ("q", 4, 4, 0.0)], "query_id string, rank int, item_id int, score double")
    loc = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b")], "item_id int, location string")
    assert knn.majority_vote(res, loc).first() == ("q", "b", 0.5)


def test_global_descriptors(spark):
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [50.0, 0.0])], "word_id int, centroid array<double>")
    local = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 2.0]), ("a", 2, [10.0, 3.0])], "image_id string, local_id int, vec array<float>")
    pics = spark.createDataFrame([("a",), ("empty",)], "image_id string")
    bow = {r[0]: r[1] for r in codebook.bow(local, book, pics).collect()}
    assert bow["a"] == pytest.approx([2 / 5**0.5, 1 / 5**0.5, 0]) and bow["empty"] == [0, 0, 0]
    vlad = {r[0]: r[1] for r in codebook.vlad(local, book, pics).collect()}
    assert vlad["a"] == pytest.approx(np.array([1 / 5**0.5, 2 / 5**0.5, 0, 1, 0, 0]) / 2**0.5) and vlad["empty"] == [0] * 6


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(vectors.l2_normalize("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(vectors.l2_normalize_guarded("v")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    assert [r[0] for r in df.select(vectors.median("v")).collect()] == [3.5, 0.0]


def test_banded_pairs_lose_nothing(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2, (40, 256)).astype(bool)
    near = base[rng.integers(0, 40, 60)] ^ (rng.random((60, 256)) < 0.02)
    h = spark.createDataFrame([(i, [bool(x) for x in r]) for i, r in enumerate(np.vstack([base, near, base[:3]]))] + [(999, None)], "id int, bits array<boolean>")
    want = rows(near_dup.all_pairs(h))
    assert want and rows(near_dup.expand_classes(near_dup.banded_pairs(h, 256), near_dup.class_members(h))) == want


@pytest.mark.parametrize("n_bits", [10, 64, 256])
@pytest.mark.parametrize("kind", ["int", "string"])
def test_compared_pairs_lose_nothing(spark, monkeypatch, n_bits, kind):
    """In several blocks, with copies, a repeated id, hashes of other lengths, and nulls."""
    monkeypatch.setattr(near_dup, "LEAST", 16)
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2, (50, n_bits)).astype(bool)
    made = np.vstack([base, base[rng.integers(0, 50, 70)] ^ (rng.random((70, n_bits)) < 0.03), np.repeat(base[:1], 30, 0)])
    data = [(i, [bool(x) for x in r]) for i, r in enumerate(made)] + [(3, [bool(x) for x in base[0]]), (500, [True] * (n_bits - 1)), (501, [True] * (n_bits - 1)), (999, None), (998, [None] * n_bits), (997, [])]
    h = spark.createDataFrame(data, "id int, bits array<boolean>").withColumn("id", F.col("id").cast(kind))
    want = near_dup.all_pairs(h.where("size(bits) > 0"))
    assert want.count() > 500 and rows(near_dup.compared_pairs(h)) == rows(want)
    assert near_dup.first_compared(h).collect() == near_dup.first_pairs(want).collect()
    assert near_dup.first_compared(h.limit(0)).count() == 0


def test_display_cap_counts_copies(spark, tmp_path):
    """Vectors with equal hashes are pairs at distance 0, as in the SQL."""
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v.unionByName(v.where("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 500)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["dup_display_cap"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == con.execute(catalogue.ORACLE_SQL["dup_display_cap"] + " ORDER BY distance, id_a, id_b").fetchall()
    assert [r[:3] for r in got] == [(i, i + 500, 0) for i in range(20)] and got[0][3] > 60


def test_overall_stats_ties(spark):
    df = spark.createDataFrame([("b", "1", 5, 5, 59.0, 59.0, 59.0, 59.0), ("a", "2", 5, 5, 221.0, 221.0, 221.0, 221.0), ("a", "3", 5, 5, 60.0, 60.0, 60.0, 60.0), ("c", "4", 5, 5, 220.0, 220.0, 220.0, 220.0)], "location string, filename string, height int, width int, mean_r double, mean_g double, mean_b double, brightness double")
    out = stats.overall_stats(df).first()
    assert (out["min_location"], out["max_location"], out["n_dark"], out["n_bright"]) == ("b", "a", 1, 1)
    assert stats.report_lines(stats.overall_stats(df), stats.location_stats(df)).count() == 8


def png(path, rgb):
    h, w = rgb.shape[:2]
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + r.tobytes() for r in rgb)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder_to_evaluation(spark, tmp_path):
    rng = np.random.default_rng(1)
    base = {loc: rng.integers(0, 256, (24, 32, 3)).astype(np.uint8) for loc in ("hall", "stairs")}
    for loc, a in base.items():
        for i in range(3):
            png(tmp_path / "raw" / loc / f"img{i}.png", np.clip(a.astype(int) + rng.integers(-8, 9, a.shape), 0, 255).astype(np.uint8))
    (tmp_path / "raw" / "hall" / "broken.png").write_bytes(b"no picture")
    root = f"file://{tmp_path}"
    assert store.list_files(spark, f"{root}/raw").count() == 7
    pics = store.read_images(spark, f"{root}/raw")
    assert rows(pics, "image_id", "height", "width")[0] == ("hall/img0", 24, 32) and pics.count() == 6
    small = images.prepare(pics, (64, 48), equalize=False).cache()
    vecs = retrieval.extract(small, "orb", root).cache()
    assert vecs.count() == 6 and len(vecs.first()["vec"]) == 64
    q = vecs.where("image_id LIKE '%img0'").select(F.col("image_id").alias("query_id"), F.col("location").alias("gt_location"), "vec")
    db = vecs.where("image_id NOT LIKE '%img0'")
    out = retrieval.evaluate_method("orb", q, retrieval.build_index(db, "orb"), db.select(F.col("image_id").alias("item_id"), "location")).first()
    assert out["n_queries"] == 2 and out["top3_acc"] >= out["top1_acc"]
    flat = images.encode(small, lambda x: x.reshape(len(x), -1)[:, ::5000])
    assert np.linalg.norm(flat.first()["vec"]) == pytest.approx(1, abs=1e-5)
    store.write_metadata(retrieval.index_metadata(db, "orb"), f"{root}/meta")
    assert spark.read.json(f"{root}/meta").first()["vectors"] == 4
    assert store.available(spark, root, {"orb": ["orb_codebook"], "sift": ["sift_codebook"]}) == ["orb"]


def test_pixel_kernels():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)
    assert (pixels.augmented(pixels.augmented(a, "aug_flip"), "aug_flip") == a).all()
    assert all(pixels.augmented(a, k).shape == a.shape for k in manifest.AUGMENTATIONS) and len(manifest.AUGMENTATIONS) == 21
    assert (pixels.augmented(a, "aug_warm")[..., 1] == a[..., 1]).all()
    assert (pixels.resize(a, 40, 30) == a).all()
    assert (np.abs(pixels.rotated(a, 0).astype(int) - a) <= 1).all()
    assert pixels.fitted(303, 404) == (360, 480) and pixels.fitted(1280, 960) == (640, 480)
    out = pixels.resize_and_pad(a[:, :10], (64, 48))
    assert out.shape == (48, 64, 3) and (out[:, 0] == pixels.PAD).all()
    m = pixels.dct_matrix(16)
    assert np.allclose(m @ m.T, np.eye(16))
    assert pixels.hash_bits(pixels.gray(a)).sum() == 128
    assert pixels.model_input(a).shape == (224, 224, 3)
    with pytest.raises(ValueError):
        pixels.augmented(a, "aug_none")


def test_stream_is_answered(spark, tmp_path):
    from waymark.streaming.queries import answer_stream

    db = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "item_id long, vec array<float>")
    db.where("item_id < 3").withColumnRenamed("item_id", "query_id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, vec array<float>").parquet(str(tmp_path / "in"))
    run = answer_stream(stream, db, 2, lambda df, i: df.write.mode("overwrite").parquet(str(tmp_path / f"out{i}")), str(tmp_path / "ck"))
    run.processAllAvailable()
    run.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out0")).where("rank = 1"), "query_id", "item_id") == [(0, 0), (1, 1), (2, 2)]


def test_command_line(spark, tmp_path, capsys):
    from waymark.__main__ import main

    rng = np.random.default_rng(1)
    for loc in ("hall", "stairs"):
        a = rng.integers(0, 256, (24, 32, 3)).astype(np.uint8)
        for i in range(3):
            png(tmp_path / "raw" / loc / f"img{i}.png", a)
            png(tmp_path / "query" / loc / f"q{i}.png", a)
    at = lambda x: f"file://{tmp_path}/{x}"
    main(["preprocess", "--raw", at("raw"), "--out", at("done"), "--width", "64", "--height", "48"])
    assert store.read_manifest(spark, at("done/manifest.csv")).count() == 6 * 22
    main(["stats", "--data", at("done"), "--out", at("results")])
    main(["split", "--data", at("done"), "--out", at("split"), "--include-aug"])
    assert spark.read.option("header", "true").csv(at("split/test")).count() == 2
    main(["extract", "--data", at("done"), "--models", at("models"), "--method", "orb"])
    main(["index", "--models", at("models"), "--method", "orb", "--index-type", "ivf", "--nlist", "2"])
    main(["query", "--query", at("query"), "--models", at("models"), "--method", "orb", "--k", "2", "--out", at("results")])
    main(["evaluate", "--query", at("query"), "--models", at("models"), "--method", "orb", "--save", at("eval")])
    main(["demo", "--query", at("query"), "--models", at("models"), "--method", "orb", "--index-type", "ivf", "--nprobe", "2", "--out", at("results")])
    assert spark.read.option("header", "true").csv(at("eval")).first()["n_queries"] == "6"
    assert spark.read.option("header", "true").csv(at("results/orb_flat_results")).count() == 12
    assert spark.read.text(at("results/dataset_report")).where("value LIKE 'Total images: 6'").count() == 1
    assert spark.read.text(at("results/dataset_report")).where("value LIKE 'near duplicates at 0 bits%'").count() == 6
    main(["evaluate", "--data", at("done"), "--models", at("models"), "--method", "orb", "--max-queries", "3", "--k", "1,2", "--save", at("synthetic")])
    made = spark.read.option("header", "true").csv(at("synthetic")).first()
    assert made["n_queries"] == "3" and made["top2_acc"] is not None
    with pytest.raises(SystemExit, match="dinov2"):
        main(["query", "--query", at("query"), "--models", at("models"), "--method", "both", "--out", at("results")])
    with pytest.raises(ValueError, match="no codebook"):
        main(["query", "--query", at("query"), "--models", at("elsewhere"), "--method", "sift", "--out", at("results")]) if store.write_table(spark.read.parquet(at("models/orb_descriptors.npy")), at("elsewhere/sift_vlad_descriptors.npy")) is None else None


def test_search_far_from_the_origin(spark):
    """The matrix product rounds; no true neighbour may be lost by that."""
    rng = np.random.default_rng(4)
    x = 1e6 + rng.normal(size=(300, 16))
    db = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "item_id long, vec array<double>")
    q = spark.createDataFrame([(i, (1e6 + rng.normal(size=16)).tolist()) for i in range(20)] + [(99, None)], "query_id long, vec array<double>")
    same_rows = lambda df: sorted((r["query_id"], r["rank"], r["item_id"]) for r in df.collect())
    want = same_rows(knn.knn_expression(q.where("vec IS NOT NULL"), db.where("vec IS NOT NULL"), 5))
    assert same_rows(knn.knn(q, db, 5)) == want and len(want) == 100


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_probed_lists_are_searched_whole(spark, metric):
    rng = np.random.default_rng(5)
    x, q, c = (rng.normal(size=(n, 4)) for n in (200, 30, 6))
    best = lambda a, b: np.argsort(np.stack([(((v - b) ** 2).sum(1) if metric == "l2" else -(b @ v)) for v in a]), axis=1, kind="stable")
    mine, asked = best(x, c)[:, 0], best(q, c)[:, :2]
    frame = lambda a, i, v: spark.createDataFrame([(n, r.tolist()) for n, r in enumerate(a)], f"{i} long, {v} array<double>")
    centres = frame(c, "list_id", "centroid").withColumn("list_id", F.col("list_id").cast("int"))
    found = ivf.search(frame(q, "query_id", "vec"), ivf.assign_lists(frame(x, "item_id", "vec"), centres, metric), centres, 5, 2, metric)
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in found.collect())
    want = []
    for n, v in enumerate(q):
        rows_ = [i for i in best(v[None], x)[0] if mine[i] in asked[n]][:5]
        want += [(n, k + 1, int(i)) for k, i in enumerate(rows_)]
    assert got == want


def test_crops_keep_their_corner():
    img = np.zeros((100, 100, 3), np.uint8)
    img[:10, :10], img[-10:, -10:] = 255, 128
    tl, br = pixels.augmented(img, "aug_crop_tl"), pixels.augmented(img, "aug_crop_br")
    assert tl[2, 2, 0] > 200 and tl[-3, -3, 0] < 50
    assert br[-3, -3, 0] > 100 and br[2, 2, 0] < 50


def test_image_queries_follow_their_formulas(spark):
    """The registered image queries against NumPy: channel means, resized and augmented pixels, hashes."""
    import hashlib

    from waymark import catalogue

    sf = "/root/testdata/sf0.001"
    pics = {r["image_id"]: np.frombuffer(r["rgb"], np.uint8).reshape(8, 8, 3) for r in catalogue._pictures(spark, sf).collect()}
    for r in catalogue.QUERIES["image_stats"](spark, sf).collect():
        img = next(v for k, v in pics.items() if k.split("/")[-1] == str(r["filename"]).split("/")[-1].split(".")[0])
        assert (r["height"], r["width"]) == (8, 8) and abs(r["mean_r"] - img[..., 0].mean()) < 1e-6 and abs(r["brightness"] - img.mean()) < 1e-3
    for r in catalogue.QUERIES["image_phash"](spark, sf).limit(40).collect():
        bits = pixels.hash_bits(pixels.gray(pics[r["id"]]))
        assert list(r["bits"]) == bits.tolist() and len(bits) == 256
    plain = {"aug_flip": lambda x: x[:, ::-1], "aug_warm": lambda x: np.clip(x.astype(int) + [20, 0, -20], 0, 255).astype(np.uint8), "aug_cool": lambda x: np.clip(x.astype(int) + [-20, 0, 20], 0, 255).astype(np.uint8)}
    seen = 0
    for r in catalogue.QUERIES["image_augment"](spark, sf).collect():
        if r["aug_type"] in plain or not r["augmented"]:
            img = pics[r["original"]]
            img = plain[r["aug_type"]](img) if r["augmented"] else img
            assert r["digest"] == hashlib.sha256(np.ascontiguousarray(img).tobytes()).hexdigest()
            seen += 1
    assert seen == 4 * len(pics)


def test_codebooks_are_at_rest(spark):
    """Each word is the mean of the vectors assigned to it."""
    from waymark import catalogue

    sf = "/root/testdata/sf0.001"
    words = {r[0]: np.array(r[1]) for r in catalogue.QUERIES["kmeans_codebook"](spark, sf).collect()}
    x = np.array([r["vec"] for r in catalogue.vecs(spark, sf).collect()])
    c = np.array([words[i] for i in sorted(words)])
    near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
    assert len(c) == 8 and all(np.abs(x[near == k].mean(0) - c[k]).max() < 0.05 for k in range(8))


def test_many_queries_are_read_from_the_shared_folder(spark, monkeypatch):
    rng = np.random.default_rng(6)
    frame = lambda n, i: spark.createDataFrame([(f"{i}{k}", v.tolist()) for k, v in enumerate(rng.normal(size=(n, 4)))], f"{i} string, vec array<float>")
    q, db = frame(50, "query_id"), frame(300, "item_id").repartition(3)
    want = rows(knn.knn(q, db, 4), "query_id", "rank", "item_id", "score")
    monkeypatch.setattr(knn, "QUERY_BLOCK", 20)
    monkeypatch.setattr(knn, "CHUNK", 40)
    assert rows(knn.knn(q, db, 4), "query_id", "rank", "item_id", "score") == want and len(want) == 200


def test_keypoints_are_found_again_in_a_turned_picture():
    rng = np.random.default_rng(3)
    f = features.gaussian(rng.normal(size=(160, 200)), 4)
    img = ((f - f.min()) / (f.max() - f.min()) * 255).astype(np.uint8)
    a, b = features.keypoint_gradients(img), features.keypoint_gradients(np.rot90(img).copy())
    assert a.shape[1] == 128 and len(a) > 50 and np.allclose(np.linalg.norm(a, axis=1), 1, atol=1e-4)
    assert (((a[:, None] - b[None]) ** 2).sum(2).min(1) < 0.05).mean() > 0.7
    a, b = (np.unpackbits(features.binary_corners(x).astype(np.uint8), axis=1) for x in (img, np.rot90(img).copy()))
    assert a.shape[1] == 256 and len(a) > 50 and ((a[:, None] != b[None]).sum(2).min(1) < 40).mean() > 0.9
    for flat in (np.zeros((8, 8), np.uint8), np.full((64, 64), 7, np.uint8)):
        assert features.keypoint_gradients(flat).shape == (0, 128) and features.binary_corners(flat).shape == (0, 32)
