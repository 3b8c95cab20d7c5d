"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document draws a deterministic exponential key, -ln(u) / quality weight, with u from a hash of
its id. Within a source, documents are ordered by key and their sizes prefix-summed up to the source's
token budget. Whole epochs come first; the sorted prefix is taken for the rest of the target. The
document at the edge is taken when that lands nearer to the target.

No source is ever sorted in one task: keys are cut into BUCKETS ranges by a monotone map, the
(source, range) sums are prefix-summed, and only the range in which a source's budget ends is sorted.
What the mix takes of a document follows from its source's row of the plan, the last place taken among
them, and the document's own key, so texts are never shuffled. The plan is broadcast if its bytes are
counted to be few.

The quality weight is a column of the caller's choice; without one, longer texts weigh more.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, last in
order; a null id draws by a hash of its text; rows with equal ids, sources and sizes, such as repeated
rows, share a key and are taken or left together; very long texts count whole; an empty table gives an
empty result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Ranges into which each source's key order is cut.
BUCKETS = 4096
SEED = "/mix"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD)), F.lit(0)).cast("long")


def quality_weight(size: Column) -> Column:
    """0.5 for an empty text up to 2.0 from 1,000 words on."""
    return F.lit(0.5) + F.lit(1.5) * F.least(size, F.lit(1000)).cast("double") / F.lit(1000.0)


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED, text: str = "text") -> Column:
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.xxhash64(text).cast("string")))
    digits = F.substring(F.md5(F.concat(name, F.lit(seed))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def bucket_of(key: Column) -> Column:
    return F.floor((F.lit(1.0) - F.exp(-key)) * BUCKETS).cast("int")


def place_of(key: Column, doc_id: Column, size: Column) -> Column:
    """The order of a source's documents."""
    return F.struct(key.alias("key"), doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), size.alias("size"))


def source_weights(sources: DataFrame, cycle: list[int]) -> DataFrame:
    """Adds ``weight``: the cycle, repeated over the sources by code point, null last."""
    turn = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(F.col("rank"), F.lit(len(cycle))) + 1).cast("int"))
    return C.ranked(sources, "source").select("source", "source_size", turn.cast("double").alias("weight"))


def with_targets(sources: DataFrame, share: float, most_epochs: int) -> DataFrame:
    """Adds ``target``: least(most_epochs * size, level * weight), with the level at which targets sum
    to share * all sizes. Each turn returns one row to the driver."""
    cap = F.lit(most_epochs) * F.col("source_size")
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        got = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count(F.when(full & (cap > 0), 1))).first()
        if not got[2]:
            break
        rise = (share * got[0] - got[1]) / got[2]
        if rise <= level:
            break
        level = rise
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def mix_plan(slim: DataFrame, cycle: list[int], share: float, most_epochs: int) -> DataFrame:
    """(s, source_size, target, epochs, edge, last) of each source of ``slim`` (source, size, key, bucket,
    place): documents are taken ``epochs`` times, and once more below bucket ``edge`` and up to ``last`` in it."""
    sources = source_weights(slim.groupBy("source").agg(F.sum("size").alias("source_size")), list(cycle))
    sources = C.stage(with_targets(C.stage(sources, "weights"), share, most_epochs), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("epochs", whole).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "s")

    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
    upto = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket"))
    edges = sums.withColumn("upto", upto).join(plan.select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
    edges = edges.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before"))).alias("e"), F.first("rest").alias("rest"))
    edges = C.stage(edges.select("s", F.col("e.bucket").alias("edge"), F.col("e.before").alias("before"), "rest"), "edges")

    inside = slim.join(C.bounded(edges), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("edge")))
    inside = inside.groupBy("source", "place", "before", "rest").agg(F.sum("size").alias("sum"))
    at = F.sum("sum").over(Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    first = F.col("at") - F.col("sum")
    nearer = (first < F.col("rest")) & (F.col("at") - F.col("rest") <= F.col("rest") - first)
    last = inside.withColumn("at", at).where(nearer).groupBy(F.col("source").alias("of")).agg(F.max("place").alias("last"))
    ends = edges.select(F.col("s").alias("t"), "edge").join(last, F.col("t").eqNullSafe(F.col("of")), "left").select("t", "edge", "last")
    return C.stage(plan.join(ends, F.col("s").eqNullSafe(F.col("t")), "left").select("s", "source_size", "target", "epochs", "edge", "last"), "plan")


def _copies(bucket: Column, place: Column, name=lambda c: c) -> Column:
    epochs, edge, last = (F.col(name(c)) for c in ("epochs", "edge", "last"))
    more = (bucket < edge) | ((bucket == edge) & last.isNotNull() & (place <= last))
    return epochs + F.coalesce(more, F.lit(False)).cast("long")


def _keyed(docs: DataFrame, weight: Column | None) -> DataFrame:
    """(doc_id, source, size, key, bucket, place) of each row."""
    doc_id = F.col("doc_id").cast("long")
    slim = docs.select(doc_id.alias("doc_id"), "source", n_words().alias("size"), "text", *([weight.alias(C.own("weight"))] if weight is not None else []))
    key = sampling_key(F.col("doc_id"), quality_weight(F.col("size")) if weight is None else F.col(C.own("weight")))
    slim = slim.select("doc_id", "source", "size", key.alias("key"))
    return slim.select("*", bucket_of(F.col("key")).alias("bucket"), place_of(F.col("key"), F.col("doc_id"), F.col("size")).alias("place"))


def mix(docs: DataFrame, cycle: list[int] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row."""
    slim = C.stage(_keyed(docs, weight), "mix")
    plan = mix_plan(slim, list(cycle), share, most_epochs)
    rows = slim.join(C.bounded(plan), F.col("source").eqNullSafe(F.col("s")))
    copies = _copies(F.col("bucket"), F.col("place"))
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, cycle: list[int] = (3, 1, 2), share: float = 1.5, most_epochs: int = 2, weight: Column | None = None) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    slim = C.Staged(_keyed(docs, weight), "mix")
    plan = mix_plan(slim.df, list(cycle), share, most_epochs).select(*[F.col(c).alias(C.own(c)) for c in ("s", "epochs", "edge", "last")])
    slim.drop()
    # a row's place in its source is worked out anew from the row itself
    doc_id, size, key = F.col("doc_id").cast("long"), F.col(C.own("size")), F.col(C.own("key"))
    own = docs.withColumn(C.own("size"), n_words())
    own = own.withColumn(C.own("key"), sampling_key(doc_id, quality_weight(size) if weight is None else weight))
    met = own.join(C.bounded(plan), F.col("source").eqNullSafe(F.col(C.own("s"))))
    copies = _copies(bucket_of(key), place_of(key, doc_id, size), C.own).cast("int")
    turns = F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies))).alias(C.own("turn"))
    return met.select(*docs.columns, turns).drop(C.own("turn"))


def op4_mix(spark, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
k AS (SELECT *, -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '/mix'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / (0.5::DOUBLE + 1.5::DOUBLE * least(size, 1000)::DOUBLE / 1000::DOUBLE) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
r AS (SELECT *, 2 * source_size / w::DOUBLE AS ratio, sum(2 * source_size) OVER o - 2 * source_size AS capped, sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE DESC, source DESC) AS left_w,
             (SELECT 1.5 * sum(source_size) FROM s) AS budget FROM s WINDOW o AS (ORDER BY 2 * source_size / w::DOUBLE, source)),
lv AS (SELECT arg_min((budget::DOUBLE - capped::DOUBLE) / left_w::DOUBLE, ratio) AS level FROM r WHERE (budget::DOUBLE - capped::DOUBLE) / left_w::DOUBLE <= ratio),
t AS (SELECT source, source_size, least(2 * source_size::DOUBLE, level * w::DOUBLE) AS target FROM s, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size::DOUBLE) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size::DOUBLE AS rest, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size < rest AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
