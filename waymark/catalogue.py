"""The registered queries of the engine with the SQL that defines them.

The vectors of ``embeddings`` whose id is divisible by 100 are the queries, against all vectors but the query
itself; a label stands for a location. A synthetic manifest says that vec_ids not divisible by five are augmented, with the
augmentation types in turn.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import registry, vectors
from waymark.functions.scalars import location_of, shuffle_key
from waymark.operators import codebook, images, ivf, knn, manifest, metrics, near_dup, split, stats
from waymark.plans import retrieval

K = 10
KS = (1, 3, 5, 10)
HASH_BITS, HASH_APART = 64, 18

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), F.col("label").alias("location"))


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries with their ground truth, database)."""
    v = vecs(spark, sf_dir)
    return v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "vec", F.col("location").alias("gt_location")), v


def results(spark: SparkSession, sf_dir: str, metric: str = "l2", k: int = K) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, queries, database)."""
    q, db = sides(spark, sf_dir)
    return knn.without_self(knn.knn(q, db, k + 1, metric), k), q, db


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecs(spark, sf_dir).where("item_id < 8").select(F.col("item_id").cast("int").alias("word_id"), F.col("vec").alias("centroid"))


def synthetic_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, manifest.AUGMENTATIONS))
    v = table(spark, sf_dir, "embeddings")
    made = F.col("vec_id") % 5 != 0
    kind = F.when(made, F.element_at(kinds, (F.col("vec_id") % len(manifest.AUGMENTATIONS) + 1).cast("int")))
    return v.select(F.concat_ws("/", F.col("label"), F.col("vec_id")).alias("image_id"), F.col("label").cast("string").alias("location"), F.when(made, " TRUE ").otherwise("no").alias("augmented"), kind.alias("aug_type"))


_V = "embedding::DOUBLE[]"
_SIDES = f"""q AS (SELECT vec_id AS query_id, label AS gt_location, {_V} AS v FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT vec_id AS item_id, label AS location, {_V} AS v FROM embeddings)"""
_L2 = "list_sum(list_transform(generate_series(1, len({0})), lambda i: ({0}[i] - {1}[i]) * ({0}[i] - {1}[i])))"
_L2QD = _L2.format("q.v", "d.v")
_RESULTS = f"""{_SIDES},
s AS (SELECT query_id, gt_location, item_id, location, {_L2QD} AS score FROM q, d WHERE query_id <> item_id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS rank FROM s) WHERE rank <= {K})"""
_HITS = f"""{_RESULTS}, h AS (SELECT *, coalesce(location = gt_location, false) AS hit FROM r)"""
_AP = f"""{_HITS}, n AS (SELECT location, count(*) AS n FROM d GROUP BY 1),
p AS (SELECT *, sum(hit::INT) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS precision FROM h),
a AS (SELECT query_id, coalesce(sum(precision) FILTER (hit), 0) / least(any_value(n.n), count(*)) AS ap FROM p JOIN n ON n.location = gt_location GROUP BY query_id)"""
_KINDS = "[" + ", ".join(f"'{a}'" for a in manifest.AUGMENTATIONS) + "]"
_MANIFEST = f"""m AS (SELECT label || '/' || vec_id AS image_id, CAST(label AS VARCHAR) AS location, CASE WHEN vec_id % 5 <> 0 THEN ' TRUE ' ELSE 'no' END AS augmented,
CASE WHEN vec_id % 5 <> 0 THEN {_KINDS}[vec_id % {len(manifest.AUGMENTATIONS)} + 1] END AS aug_type FROM embeddings)"""
_MEDIAN = "list_median({0})"
_BITS = f"""b AS (SELECT vec_id AS id, list_transform(v, lambda x: x > m) AS bits FROM (SELECT vec_id, {_V} AS v, list_median({_V}) AS m FROM embeddings))"""
_PAIRS = f"""{_BITS}, p AS (SELECT * FROM (SELECT x.id AS id_a, y.id AS id_b, CAST(list_sum(list_transform(generate_series(1, {HASH_BITS}), lambda i: (x.bits[i] <> y.bits[i])::INT)) AS INT) AS distance
FROM b x JOIN b y ON x.id < y.id) WHERE distance <= {HASH_APART})"""
_WORDS = f"w AS (SELECT CAST(vec_id AS INT) AS word_id, {_V} AS c FROM embeddings WHERE vec_id < 8)"
_ASSIGN = f"""{_WORDS}, l AS (SELECT vec_id, label, {_V} AS v FROM embeddings),
z AS (SELECT * FROM (SELECT l.*, w.word_id, w.c, row_number() OVER (PARTITION BY vec_id ORDER BY {_L2.format('l.v', 'w.c')}, word_id) AS k FROM l, w) WHERE k = 1)"""


# Search


@register(f"WITH {_RESULTS} SELECT query_id, CAST(rank AS INT) AS rank, item_id, round(score, 6) AS score FROM r")
def knn_flat_l2(spark, sf_dir):
    return results(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@register(f"WITH {_SIDES}, s AS (SELECT query_id, item_id, list_inner_product(q.v, d.v) AS score FROM q, d WHERE query_id <> item_id) SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank, item_id, round(score, 6) AS score FROM s) WHERE rank <= {K}")
def knn_flat_ip(spark, sf_dir):
    return results(spark, sf_dir, "ip")[0].withColumn("score", F.round("score", 6))


@register(f"WITH {_RESULTS} SELECT query_id, CAST(rank AS INT) AS rank, item_id, round(score, 6) AS score FROM r")
def knn_expression_l2(spark, sf_dir):
    """The declarative plan of ``knn_flat_l2``."""
    q, db = sides(spark, sf_dir)
    return knn.without_self(knn.knn_expression(q, db, K + 1), K).withColumn("score", F.round("score", 6))


@register(f"WITH {_SIDES}, s AS (SELECT query_id, item_id, {_L2QD} AS score FROM q, d) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INT) AS rank, item_id, round(score, 6) AS score FROM s")
def knn_k_gt_n(spark, sf_dir):
    """k beyond the database returns all of it."""
    q, db = sides(spark, sf_dir)
    return knn.knn(q, db, db.count() + 1).withColumn("score", F.round("score", 6))


_VOTE = f"""{_RESULTS}, v AS (SELECT query_id, location, count(*) AS n, min(rank) AS f FROM r GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, f) AS k, sum(n) OVER (PARTITION BY query_id) AS a FROM v)"""


@register(f"WITH {_VOTE} SELECT query_id, location AS predicted, round(n / a::DOUBLE, 6) AS confidence FROM o WHERE k = 1")
def majority_vote(spark, sf_dir):
    found, _, db = results(spark, sf_dir)
    return knn.majority_vote(found, db.select("item_id", "location")).withColumn("confidence", F.round("confidence", 6))


_CENTRES = f"""c AS (SELECT CAST(vec_id AS INT) AS list_id, {_V} AS c FROM embeddings WHERE vec_id < 8)"""


def _ivf_sql(nprobe: int) -> str:
    return f"""WITH {_SIDES}, {_CENTRES},
a AS (SELECT item_id, v, list_id FROM (SELECT d.item_id, d.v, c.list_id, row_number() OVER (PARTITION BY item_id ORDER BY {_L2.format('d.v', 'c.c')}, list_id) AS k FROM d, c) WHERE k = 1),
p AS (SELECT query_id, v, list_id FROM (SELECT q.query_id, q.v, c.list_id, row_number() OVER (PARTITION BY query_id ORDER BY {_L2.format('q.v', 'c.c')}, list_id) AS k FROM q, c) WHERE k <= {nprobe}),
s AS (SELECT query_id, item_id, {_L2.format('p.v', 'a.v')} AS score FROM p JOIN a USING (list_id) WHERE query_id <> item_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, item_id) AS INT) AS rank, item_id, round(score, 6) AS score FROM s) WHERE rank <= {K}"""


def _ivf(spark, sf_dir, nprobe):
    q, db = sides(spark, sf_dir)
    centres = words(spark, sf_dir).withColumnRenamed("word_id", "list_id")
    return knn.without_self(ivf.search(q, ivf.assign_lists(db, centres), centres, K + 1, nprobe), K).withColumn("score", F.round("score", 6))


@register(_ivf_sql(2))
def ivf_fixed_nprobe(spark, sf_dir):
    return _ivf(spark, sf_dir, 2)


@register(f"WITH {_RESULTS} SELECT query_id, CAST(rank AS INT) AS rank, item_id, round(score, 6) AS score FROM r")
def ivf_full_probe(spark, sf_dir):
    """Probing every list is the exact search."""
    return _ivf(spark, sf_dir, 8)


@register()
def ivf_trained(spark, sf_dir):
    q, db = sides(spark, sf_dir)
    return knn.without_self(ivf.build(db, "ivf", nlist=16, nprobe=12)(q, K + 1), K)  # recall of 0.9 and more, see the README


@register()
def lsh_ann(spark, sf_dir):
    q, db = sides(spark, sf_dir)
    return knn.without_self(ivf.build(db, "hnsw")(q, K + 1), K)


# Metrics


@register(f"WITH {_HITS} SELECT query_id, " + ", ".join(f"bool_or(hit AND rank <= {k}) AS hit_{k}" for k in KS) + " FROM h GROUP BY query_id")
def topk_hits(spark, sf_dir):
    found, q, db = results(spark, sf_dir)
    return metrics.topk_hits(metrics.hits(found, db.select("item_id", "location"), q.select("query_id", "gt_location")), KS)


@register(f"WITH {_AP} SELECT query_id, round(ap, 6) AS ap FROM a")
def ap_at_k(spark, sf_dir):
    found, q, db = results(spark, sf_dir)
    places, truth = db.select("item_id", "location"), q.select("query_id", "gt_location")
    return metrics.average_precision(metrics.hits(found, places, truth), metrics.eligible(truth, places), K).withColumn("ap", F.round("ap", 6))


@register(f"WITH {_AP}, t AS (SELECT query_id, " + ", ".join(f"max(CASE WHEN hit AND rank <= {k} THEN 1.0 ELSE 0.0 END)::DOUBLE AS t{k}" for k in KS) + " FROM h GROUP BY 1) SELECT count(*) AS n_queries, round(avg(ap), 6) AS map, " + ", ".join(f"round(avg(t{k}), 6) AS top{k}_acc" for k in KS) + " FROM a JOIN t USING (query_id)")
def eval_summary(spark, sf_dir):
    found, q, db = results(spark, sf_dir)
    out = metrics.evaluate(found, db.select("item_id", "location"), q.select("query_id", "gt_location"), KS)
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@register("SELECT label AS location, count(*) AS n_relevant FROM embeddings GROUP BY 1")
def relevant_counts(spark, sf_dir):
    return metrics.relevant_counts(sides(spark, sf_dir)[1])


_TRUTH = "CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 7 = 1 THEN -1 ELSE label END"


@register(f"WITH d AS (SELECT label AS location, count(*) AS n_relevant FROM embeddings GROUP BY 1) SELECT vec_id AS query_id, location AS gt_location, n_relevant FROM (SELECT vec_id, {_TRUTH} AS g FROM embeddings) JOIN d ON g = location")
def eligible_queries(spark, sf_dir):
    """Without a ground truth, or with one that the database lacks, a query does not count."""
    db = vecs(spark, sf_dir)
    truth = F.when(F.col("item_id") % 7 == 0, None).when(F.col("item_id") % 7 == 1, -1).otherwise(F.col("location"))
    return metrics.eligible(db.select(F.col("item_id").alias("query_id"), truth.alias("gt_location")), db)


@register(f"WITH {_HITS}, t AS (SELECT query_id, max(CASE WHEN hit AND rank <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS t1, max(CASE WHEN hit AND rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS t5 FROM h GROUP BY 1) SELECT {_KINDS}[query_id % 21 + 1] AS aug_type, count(*) AS n_queries, round(avg(t1), 6) AS top1_acc, round(avg(t5), 6) AS top5_acc FROM t GROUP BY 1")
def robustness_by_aug(spark, sf_dir):
    found, q, db = results(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, manifest.AUGMENTATIONS)), (F.col("query_id") % 21 + 1).cast("int"))
    out = metrics.by_group(found, db.select("item_id", "location"), q.select("query_id", "gt_location", kind.alias("aug_type")), "aug_type")
    return out.withColumns({c: F.round(c, 6) for c in ("top1_acc", "top5_acc")})


# Manifest and split


@register(f"WITH {_MANIFEST} SELECT * FROM m WHERE NOT coalesce(lower(trim(augmented)) IN ('1', 'true', 'yes', 'y'), false)")
def select_database(spark, sf_dir):
    return manifest.select_database(synthetic_manifest(spark, sf_dir))


@register(f"WITH {_MANIFEST} SELECT * FROM m WHERE lower(trim(augmented)) IN ('1', 'true', 'yes', 'y') AND aug_type IN ('aug_blur', 'aug_dark', 'aug_bright', 'aug_skew_h')")
def select_synthetic(spark, sf_dir):
    return manifest.select_synthetic(synthetic_manifest(spark, sf_dir))


@register(f"WITH {_MANIFEST} SELECT * FROM m WHERE lower(trim(augmented)) IN ('1', 'true', 'yes', 'y') AND aug_type IN ('aug_blur', 'aug_dark', 'aug_bright', 'aug_skew_h') AND image_id NOT IN (SELECT image_id FROM m WHERE location IN ('0', '1') UNION SELECT image_id FROM m WHERE location IN ('1', '2'))")
def exclude_indexed(spark, sf_dir):
    m = synthetic_manifest(spark, sf_dir)
    indexed = manifest.indexed_ids(m.where("location IN ('0', '1')"), m.where("location IN ('1', '2')"))
    return manifest.exclude_indexed(manifest.select_synthetic(m), indexed).select("image_id", "location", "augmented", "aug_type")


def _originals(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "doc_id").alias("image_id"), F.col("lang").alias("location"))


@register(f"WITH o AS (SELECT lang || '/' || doc_id AS original, lang AS location, unnest([NULL] || {_KINDS}) AS aug_type FROM documents) SELECT CASE WHEN aug_type IS NULL THEN original ELSE original || '_' || aug_type END AS image_id, location, aug_type, original, aug_type IS NOT NULL AS augmented FROM o")
def augment_manifest(spark, sf_dir):
    return manifest.expand_augmentations(_originals(spark, sf_dir))


_SPLIT = """s AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY location ORDER BY md5('42/' || image_id), image_id) <= CASE WHEN count(*) OVER (PARTITION BY location) > 1
THEN least(greatest(ceil(count(*) OVER (PARTITION BY location) * 0.2::DOUBLE), 1), count(*) OVER (PARTITION BY location) - 1) ELSE 0 END THEN 'test' ELSE 'train' END AS split
FROM (SELECT lang || '/' || doc_id AS image_id, lang AS location FROM documents))"""


def _split(spark, sf_dir):
    return split.stratified_split(_originals(spark, sf_dir), 0.2)


@register(f"WITH {_SPLIT} SELECT image_id, location FROM s WHERE split = 'train'")
def split_train(spark, sf_dir):
    return _split(spark, sf_dir).where("split = 'train'").drop("split")


@register(f"WITH {_SPLIT} SELECT image_id, location FROM s WHERE split = 'test'")
def split_test(spark, sf_dir):
    return _split(spark, sf_dir).where("split = 'test'").drop("split")


@register(f"WITH {_SPLIT} SELECT image_id, location, false AS augmented FROM s WHERE split = 'train' UNION ALL SELECT image_id || '_aug_blur', location, true FROM s WHERE split = 'train'")
def split_with_augmented(spark, sf_dir):
    train = _split(spark, sf_dir).where("split = 'train'").drop("split")
    return split.train_with_augmented(train, train.withColumn("image_id", F.concat("image_id", F.lit("_aug_blur"))))


@register(f"WITH {_SPLIT} SELECT location, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM s GROUP BY 1")
def split_summary(spark, sf_dir):
    s = _split(spark, sf_dir)
    return split.split_summary(s.where("split = 'train'"), s.where("split = 'test'"))


@register("SELECT vec_id AS query_id, label AS gt_location FROM embeddings ORDER BY md5('42/' || vec_id), vec_id LIMIT 20")
def query_subsample(spark, sf_dir):
    return manifest.subsample(vecs(spark, sf_dir).select(F.col("item_id").alias("query_id"), F.col("location").alias("gt_location")), 20)


@register("SELECT url AS path, CASE WHEN page_id % 3 = 0 THEN 'folder' WHEN page_id % 3 = 1 THEN 'image' ELSE 'other' END AS kind FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 4 = 0)")
def resume_listing(spark, sf_dir):
    """What a resumed download has still to fetch, with its kind."""
    p = table(spark, sf_dir, "pages").withColumn("path", F.col("page_id").cast("string"))
    mime = F.when(F.col("page_id") % 3 == 0, "application/x.folder").when(F.col("page_id") % 3 == 1, "image/jpeg").otherwise("text/plain")
    left = manifest.classify_listing(manifest.to_download(p.withColumn("mime_type", mime), p.where("page_id % 4 = 0")))
    return left.select(F.col("url").alias("path"), "kind")


@register(f"WITH {_MANIFEST} SELECT count(*) AS n_records, count(DISTINCT location) AS n_locations, count(*) FILTER (augmented = 'no') AS n_originals, count(*) FILTER (augmented <> 'no') AS n_augmented FROM m")
def manifest_summary(spark, sf_dir):
    return manifest.summary(synthetic_manifest(spark, sf_dir))


_FILES = """f AS (SELECT 'data/processed/' || label || '/' || vec_id || ext AS path, label || '/' || vec_id AS id, ext FROM (SELECT *, CASE WHEN vec_id % 3 = 0 THEN ['.png', '.jpg'] WHEN vec_id % 3 = 1 THEN ['.JPEG', '.txt'] ELSE ['.gif'] END AS e FROM embeddings), unnest(e) AS t(ext))"""


def _files(spark, sf_dir):
    n = F.col("vec_id") % 3
    ends = F.when(n == 0, F.array(F.lit(".png"), F.lit(".jpg"))).when(n == 1, F.array(F.lit(".JPEG"), F.lit(".txt"))).otherwise(F.array(F.lit(".gif")))
    return table(spark, sf_dir, "embeddings").withColumn("ext", F.explode(ends)).select(F.concat(F.lit("data/processed/"), F.col("label"), F.lit("/"), F.col("vec_id"), F.col("ext")).alias("path"))


@register(f"WITH {_FILES} SELECT label || '/' || vec_id AS image_id, CASE vec_id % 3 WHEN 0 THEN 'data/processed/' || label || '/' || vec_id || '.jpg' WHEN 1 THEN 'data/processed/' || label || '/' || vec_id || '.JPEG' END AS path FROM embeddings")
def processed_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.concat_ws("/", "label", "vec_id").alias("image_id"))
    return manifest.lookup_processed(ids, _files(spark, sf_dir))


@register(f"WITH {_FILES} SELECT path, split_part(id, '/', 1) AS gt_location, split_part(id, '/', 2) AS query_id FROM f WHERE lower(ext) IN ('.png', '.jpg', '.jpeg')")
def batch_queries(spark, sf_dir):
    return manifest.batch_queries(_files(spark, sf_dir), "data/query")


@register(f"WITH {_FILES} SELECT path, split_part(id, '/', 1) AS gt_location, id AS query_id FROM f WHERE lower(ext) IN ('.png', '.jpg', '.jpeg')")
def folder_queries(spark, sf_dir):
    return manifest.folder_queries(_files(spark, sf_dir), "data/processed")


@register(f"""WITH {_MANIFEST} SELECT 'p/' || image_id || '.jpg' AS path, location AS gt_location, image_id AS query_id FROM m WHERE augmented <> 'no' AND aug_type IN ('aug_blur', 'aug_dark', 'aug_bright', 'aug_skew_h') AND location <> '3'
ORDER BY md5('42/' || image_id), image_id LIMIT 30""")
def synthetic_queries(spark, sf_dir):
    """The query set of an evaluation without a query folder: synthetic, not indexed, subsampled."""
    m = synthetic_manifest(spark, sf_dir).withColumn("path", F.concat(F.lit("p/"), F.col("image_id"), F.lit(".jpg")))
    return manifest.collect_queries(None, "", m, None, m.where("location = '3'"), most=30)


@register(f"WITH {_FILES} SELECT path, id AS image_id, split_part(id, '/', 1) AS location, false AS augmented FROM f WHERE lower(ext) IN ('.png', '.jpg', '.jpeg')")
def walk_database(spark, sf_dir):
    return manifest.collect_walk(_files(spark, sf_dir))


@register("SELECT CASE WHEN page_id % 7 = 0 THEN 'failed' WHEN page_id % 4 = 0 THEN 'skipped' ELSE 'downloaded' END AS status, count(*) AS n FROM pages GROUP BY 1")
def transfer_counts(spark, sf_dir):
    status = F.when(F.col("page_id") % 7 == 0, "failed").when(F.col("page_id") % 4 == 0, "skipped").otherwise("downloaded")
    return manifest.transfer_counts(table(spark, sf_dir, "pages").select("url", status.alias("status")))


# Vectors, codebooks and global descriptors


@register(f"SELECT vec_id AS item_id, list_transform({_V}, lambda x: round(x / greatest(sqrt(list_inner_product({_V}, {_V})), 1e-8), 6)) AS unit, round(sqrt(list_inner_product({_V}, {_V})), 6) AS norm FROM embeddings")
def l2_normalize(spark, sf_dir):
    return vecs(spark, sf_dir).select("item_id", F.transform(vectors.l2_normalize("vec"), lambda x: vectors.rounded(x, 6)).alias("unit"), vectors.rounded(vectors.l2_norm("vec"), 6).alias("norm"))


@register("SELECT count(*) AS vectors, max(len(embedding))::INT AS dimension, count(*) * max(len(embedding)) * 4 / 1048576.0::DOUBLE AS index_mb FROM embeddings")
def index_memory(spark, sf_dir):
    return metrics.index_megabytes(sides(spark, sf_dir)[1])


@register("""SELECT 'dinov2' AS method, 'DINOv2 ViT-S/14' AS method_display, 'ivf' AS index_type, 'ip' AS metric, count(*) AS vectors, max(len(embedding))::INT AS dimension, 'dinov2_descriptors.npy' AS descriptor_file, 'dinov2_labels.npy' AS label_file,
'dinov2_ivf.index' AS index_file, count(*) * max(len(embedding)) * 4 / 1048576.0::DOUBLE AS serialized_index_mb, 64 AS nlist, 10 AS nprobe, NULL::INT AS hnsw_m, least(64, count(*))::INT AS adjusted_nlist, least(10, count(*))::INT AS adjusted_nprobe FROM embeddings""")
def index_metadata(spark, sf_dir):
    return retrieval.index_metadata(sides(spark, sf_dir)[1], "dinov2", "ivf")


@register("SELECT 'data' AS data_dir, count(*) AS n_images, 'originals_only' AS database_split, 42 AS seed, ['sift', 'orb', 'dinov2', 'anyloc', 'cnn'] AS methods FROM embeddings WHERE vec_id % 5 = 0")
def extraction_metadata(spark, sf_dir):
    return retrieval.extraction_metadata(manifest.select_database(synthetic_manifest(spark, sf_dir)), "data", False, 42, registry.resolve_methods("all"))


@register(f"WITH {_ASSIGN} SELECT vec_id AS item_id, word_id FROM z")
def assign_codeword(spark, sf_dir):
    return codebook.assign(vecs(spark, sf_dir), words(spark, sf_dir)).select("item_id", "word_id")


def _local(spark, sf_dir):
    return vecs(spark, sf_dir).select(F.col("location").alias("image_id"), F.col("item_id").alias("local_id"), "vec")


@register(f"""WITH {_ASSIGN}, n AS (SELECT label, w.word_id, count(z.vec_id) AS n FROM (SELECT DISTINCT label FROM l) CROSS JOIN w LEFT JOIN z USING (label, word_id) GROUP BY 1, 2)
SELECT label AS image_id, word_id AS at, round(n / sqrt(sum(n * n) OVER (PARTITION BY label))::DOUBLE, 6) AS value FROM n""")
def bow_histogram(spark, sf_dir):
    out = codebook.bow(_local(spark, sf_dir), words(spark, sf_dir))
    return out.select("image_id", F.posexplode("descriptor").alias("at", "value")).withColumn("value", F.round("value", 6))


@register(f"""WITH {_ASSIGN}, e AS (SELECT label, word_id, unnest(generate_series(1, 64)) AS i, v, c FROM z), s AS (SELECT label, word_id, i, sum(v[i] - c[i]) AS r FROM e GROUP BY ALL),
u AS (SELECT *, CASE WHEN sum(r * r) OVER (PARTITION BY label, word_id) > 0 THEN r / sqrt(sum(r * r) OVER (PARTITION BY label, word_id)) ELSE r END AS x FROM s),
g AS (SELECT label, w.word_id, t.i, coalesce(x, 0) AS x FROM (SELECT DISTINCT label FROM l) CROSS JOIN w CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS i) t LEFT JOIN u USING (label, word_id, i))
SELECT label AS image_id, CAST(word_id * 64 + i - 1 AS INT) AS at, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM g""")
def vlad(spark, sf_dir):
    out = codebook.vlad(_local(spark, sf_dir), words(spark, sf_dir))
    return out.select("image_id", F.posexplode("descriptor").alias("at", "value")).withColumn("value", F.round("value", 6) + 0.0)


@register("SELECT image_id, local_id FROM (SELECT label AS image_id, vec_id AS local_id, row_number() OVER (PARTITION BY label ORDER BY md5('42/' || label || '/' || vec_id), vec_id) AS k FROM embeddings) WHERE k <= 20")
def sample_local(spark, sf_dir):
    return codebook.sample_per_image(_local(spark, sf_dir), 20).select("image_id", "local_id")


@register()
def kmeans_codebook(spark, sf_dir):
    return codebook.fit(vecs(spark, sf_dir), 8, seeds=(1, 2))


# Statistics and near duplicates


def _hashes(spark, sf_dir):
    return vecs(spark, sf_dir).select(F.col("item_id").alias("id"), vectors.binarize("vec").alias("bits"))


@register(f"WITH {_BITS} SELECT id, bits FROM b")
def binarize_hash(spark, sf_dir):
    return _hashes(spark, sf_dir)


@register(f"WITH {_PAIRS} SELECT * FROM p")
def hamming_near_dups(spark, sf_dir):
    return near_dup.compared_pairs(_hashes(spark, sf_dir), HASH_APART)


@register(f"WITH {_PAIRS} SELECT * FROM p")
def banded_near_dups(spark, sf_dir):
    hashes = _hashes(spark, sf_dir)
    return near_dup.expand_classes(near_dup.banded_pairs(hashes, HASH_BITS, HASH_APART), near_dup.class_members(hashes))


@register(f"WITH {_PAIRS} SELECT id_a, id_b, distance, n_pairs, greatest(n_pairs - 20, 0) AS n_more FROM (SELECT *, row_number() OVER (ORDER BY distance, id_a, id_b) AS k, count(*) OVER () AS n_pairs FROM p) WHERE k <= 20")
def dup_display_cap(spark, sf_dir):
    return near_dup.first_compared(_hashes(spark, sf_dir), HASH_APART)


def _image_records(spark, sf_dir):
    """Documents as images: the language is the location, sizes and channel means follow from ids and lengths."""
    d = table(spark, sf_dir, "documents")
    shade = lambda m: (F.col("n_chars") * m % 256).cast("double")
    rows = d.select(F.col("lang").alias("location"), F.col("doc_id").cast("string").alias("filename"), (F.col("doc_id") % 97 + 200).cast("int").alias("height"), (F.col("doc_id") % 89 + 300).cast("int").alias("width"), shade(1).alias("mean_r"), shade(3).alias("mean_g"), shade(7).alias("mean_b"))
    return rows.withColumn("brightness", (F.col("mean_r") + F.col("mean_g") + F.col("mean_b")) / 3)


_RECORDS = """i AS (SELECT *, (mean_r + mean_g + mean_b) / 3 AS brightness FROM (SELECT lang AS location, CAST(doc_id AS VARCHAR) AS filename, CAST(doc_id % 97 + 200 AS INT) AS height, CAST(doc_id % 89 + 300 AS INT) AS width,
(n_chars % 256)::DOUBLE AS mean_r, (n_chars * 3 % 256)::DOUBLE AS mean_g, (n_chars * 7 % 256)::DOUBLE AS mean_b FROM documents))"""


@register(f"""WITH {_RECORDS}, p AS (SELECT location, round(avg(c), 6) AS pixel_mean, round(stddev_pop(c), 6) AS pixel_std FROM (SELECT location, unnest([mean_r, mean_g, mean_b]) AS c FROM i) GROUP BY 1)
SELECT location, count(*) AS n_images, min(width) AS min_width, max(width) AS max_width, round(avg(width), 6) AS mean_width, min(height) AS min_height, max(height) AS max_height, round(avg(height), 6) AS mean_height,
round(avg(mean_r), 6) AS mean_r, round(avg(mean_g), 6) AS mean_g, round(avg(mean_b), 6) AS mean_b, any_value(pixel_mean) AS pixel_mean, any_value(pixel_std) AS pixel_std FROM i JOIN p USING (location) GROUP BY 1""")
def location_stats(spark, sf_dir):
    out = stats.location_stats(_image_records(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@register(f"""WITH {_RECORDS}, l AS (SELECT location, count(*) AS n FROM i GROUP BY 1)
SELECT (SELECT count(*) FROM i) AS n_images, (SELECT count(*) FROM l) AS n_locations, (SELECT min(n) FROM l) AS min_images, (SELECT location FROM l ORDER BY n, location LIMIT 1) AS min_location, (SELECT max(n) FROM l) AS max_images,
(SELECT location FROM l ORDER BY n DESC, location LIMIT 1) AS max_location, (SELECT round(avg(brightness), 6) FROM i) AS mean_brightness, (SELECT count(*) FROM i WHERE brightness < 60) AS n_dark, (SELECT count(*) FROM i WHERE brightness > 220) AS n_bright""")
def overall_stats(spark, sf_dir):
    return stats.overall_stats(_image_records(spark, sf_dir)).withColumn("mean_brightness", F.round("mean_brightness", 6))


@register(f"WITH {_RECORDS} SELECT location, filename, round(brightness, 6) AS brightness, CASE WHEN brightness < 60 THEN 'dark' ELSE 'bright' END AS kind FROM i WHERE brightness < 60 OR brightness > 220")
def dark_bright(spark, sf_dir):
    return stats.outliers(_image_records(spark, sf_dir)).select("location", "filename", F.round("brightness", 6).alias("brightness"), "kind")


@register(f"WITH {_RECORDS} SELECT count(*) AS n_listed, count(*) FILTER (mean_r > 5) AS n_read FROM i")
def read_counts(spark, sf_dir):
    """Files listed against files read (here: those with any red)."""
    rows = _image_records(spark, sf_dir)
    return stats.read_counts(rows, rows.where("mean_r > 5"))


# Names and presentation


@register("SELECT vec_id AS item_id, split_part(label || '/' || vec_id, '/', 1) AS location FROM embeddings")
def location_from_label(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), location_of(F.concat_ws("/", F.col("label"), F.col("vec_id"))).alias("location"))


_NAMES = [("sift", "sift_vlad", "sift_vlad"), ("orb", "orb", "orb_bow"), ("dinov2", "dinov2", "dinov2"), ("anyloc", "anyloc_dinov2_vlad", "anyloc_dinov2_vlad"), ("cnn", "cnn", "cnn")]


@register(
    " UNION ALL ".join(
        f"SELECT '{m}' AS method, '{t}' AS index_type, '{i}{'' if t == 'flat' else '_' + t}.index' AS index_file, '{d}_descriptors.npy' AS descriptor_file, '{d}_labels.npy' AS label_file" for m, d, i in _NAMES for t in ("flat", "ivf", "hnsw")
    )
)
def index_name(spark, sf_dir):
    rows = [(m, t, registry.index_name(m, t), registry.descriptor_name(m), registry.label_name(m)) for m in registry.resolve_methods("all") for t in registry.INDEX_TYPES]
    return spark.createDataFrame(rows, "method string, index_type string, index_file string, descriptor_file string, label_file string")


@register(f"""WITH {_RESULTS} SELECT 'SIFT+VLAD' AS method, query_id, CAST(rank AS INT) AS col, item_id AS image_id, location, round(score, 6) AS score, location = gt_location AS is_correct,
CASE WHEN item_id % 7 <> 0 THEN 'raw/' || location || '/' || item_id || '.jpg' END AS path, substr(CAST(item_id AS VARCHAR), 1, 22) AS label FROM r""")
def result_grid_cells(spark, sf_dir):
    found, q, db = results(spark, sf_dir)
    paths = db.where("item_id % 7 <> 0").select("item_id", F.format_string("raw/%d/%d.jpg", "location", "item_id").alias("path"))
    out = retrieval.result_grid(found, db.select("item_id", "location"), q.select("query_id", "gt_location"), paths, "SIFT+VLAD")
    return out.withColumn("score", F.round("score", 6))


# Images made from the vectors: each becomes an 8 x 8 gray picture


def _pictures(spark, sf_dir):
    v = vecs(spark, sf_dir)
    shade = F.transform("vec", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.lit(128) + x.cast("double") * 400).cast("int"))))
    hexed = F.concat_ws("", F.transform(shade, lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), 3)))
    return v.select(F.concat_ws("/", F.col("location"), F.col("item_id")).alias("image_id"), F.col("location").cast("string").alias("location"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(hexed).alias("rgb"))


@register()
def image_resize(spark, sf_dir):
    return images.prepare(_pictures(spark, sf_dir), (64, 48)).select("image_id", "height", "width", F.sha2("rgb", 256).alias("digest"))


@register()
def image_augment(spark, sf_dir):
    return images.augment(_pictures(spark, sf_dir)).select("image_id", "original", "augmented", "aug_type", F.sha2("rgb", 256).alias("digest"))


@register()
def image_phash(spark, sf_dir):
    return images.perceptual_hashes(_pictures(spark, sf_dir))


@register()
def image_stats(spark, sf_dir):
    return images.image_stats(_pictures(spark, sf_dir))


@register()
def local_feature_vlad(spark, sf_dir):
    """Pixels to global descriptors: dense gradients, a codebook of the first features, VLAD."""
    pictures = images.prepare(_pictures(spark, sf_dir), (32, 32), equalize=False)
    local = images.local_features(pictures)
    book = local.where("local_id = 0").orderBy(shuffle_key(42, "image_id"), "image_id").limit(8).select((F.row_number().over(_by_image()) - 1).alias("word_id"), F.col("vec").alias("centroid"))
    return codebook.vlad(local, book, pictures.select("image_id"))


def _by_image():
    from pyspark.sql import Window

    return Window.orderBy("image_id")
