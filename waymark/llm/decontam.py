"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

Words are lower-cased runs of letters, digits and non-ASCII characters; shingles are five words, the
whole item where it is shorter. A window as long as an item that shares no shingle with any item of that
length has similarity 0 to all of them, so every window that holds a shared shingle, at whatever place
in it, is fingerprinted, and no other: nothing similar is lost, and clean text yields no window. Each
window and item has a 64-bit SimHash of its shingles, weighted by the roots of their characters.
Fingerprints of equal window size are matched through BLOCKS blocks of BITS bits: of two within the
radius, one block differs in at most NEAR = RADIUS // BLOCKS bits, so an index of each item's block values
and all values that near to them finds every fingerprint within it. At similarity 0.8 the expected
distance is 9.7 bits with a deviation of 2.9, so a radius of 20 leaves out less than one in a thousand
such windows and none of the verbatim ones. The index holds ids and fingerprints only; what passes the
distance test is verified by exact weighted Jaccard similarity of the distinct shingles.

The benchmark's shingles, fingerprints and the places found are broadcast only if counted to be few in
rows and bytes; larger ones are shuffled. Documents are read a second time for their windows, joined by id
and a hash of the text.

Defined results: null or empty texts and items have no words and match nothing; repeated rows and
items are matched like one; rows of one id with different texts, and those with a null id, are judged each
by its own text; windows that reach over a document's ends are clipped; between equally similar windows
the first counts; very long texts are searched whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SHINGLE = 5
RADIUS = 20
BLOCKS, BITS = 8, 8
#: Of BLOCKS blocks that differ in RADIUS bits together, one differs in no more than this.
NEAR = RADIUS // BLOCKS
SIMILARITY = 0.8
#: Matches of this in lower-cased text are words.
TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _hash(w: Column, i: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(w, i + k) for k in range(size)])


def _hashes(w: Column, size: int) -> Column:
    """Hashes of all shingles of ``size`` words by place; none if the text is shorter."""
    there = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: _hash(w, i, size))
    return F.when(F.size(w) >= size, there).otherwise(F.array().cast("array<bigint>"))


def _weighted(w: Column, n: int) -> Column:
    """(hash, characters) of the shingles of ``n`` words by place; none if the text is shorter."""
    chars = lambda i: sum((F.length(F.get(w, i + j)) for j in range(1, n)), F.length(F.get(w, i)))
    there = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.struct(_hash(w, i, n).alias("h"), chars(i).cast("long").alias("g")))
    return F.when(F.size(w) >= n, there).otherwise(F.array().cast("array<struct<h:bigint,g:bigint>>"))


def simhash(shingles: Column) -> Column:
    """64 bits, each the sign of the sum, over the bit in the shingles' hashes, of their weights' roots.

    The angle of two sums follows the cosine of the vectors of roots, which is at least 2J / (1 + J) for
    a weighted Jaccard similarity of J, however uneven the weights are. Roots are taken as whole
    numbers, so that the order of shingles does not matter.
    """
    one = F.lit(1).cast("long")
    rooted = F.transform(shingles, lambda x: F.struct(x["h"].alias("h"), F.round(F.sqrt(x["g"]) * (1 << 20)).cast("long").alias("r")))
    vote = lambda all_, b: F.aggregate(all_, F.lit(0).cast("long"), lambda s, x: s + F.when(F.call_function("shiftright", x["h"], b).bitwiseAND(one) == 1, x["r"]).otherwise(-x["r"]))
    # an array of one, so that the roots are taken once and not for every bit
    bits = F.transform(F.array(rooted), lambda all_: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(vote(all_, b) > 0, F.expr("1L")).otherwise(F.expr("0L"))))
    return F.aggregate(F.get(bits, F.lit(0)), F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("i")), lambda s, x: F.struct(s["v"].bitwiseOR(F.call_function("shiftleft", x, s["i"])).alias("v"), (s["i"] + 1).alias("i")), lambda s: s["v"])


def _block(value: Column, k: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, (k * BITS).cast("int")).bitwiseAND((1 << BITS) - 1)


def _blocks(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: F.struct(k.alias("k"), _block(value, k).alias("v")))


def _near_blocks(value: Column) -> Column:
    """The blocks, and all that differ from them in at most NEAR bits."""
    apart = [sum(1 << b for b in bits) for n in range(NEAR + 1) for bits in combinations(range(BITS), n)]
    masks = F.array(*[F.lit(x).cast("long") for x in apart])
    return F.flatten(F.transform(_blocks(value), lambda b: F.transform(masks, lambda m: F.struct(b["k"].alias("k"), b["v"].bitwiseXOR(m).alias("v")))))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_size, n, w, item, print): items with words, their shingles and fingerprints."""
    rows = benchmark.select("item_id", words().alias("w")).where(F.size("w") > 0).distinct()
    rows = rows.withColumns({"item_size": F.size("w"), "n": F.least(F.size("w"), F.lit(SHINGLE))})
    item = F.when(F.col("n") == 1, _weighted(F.col("w"), 1))
    for n in range(2, SHINGLE + 1):
        item = item.when(F.col("n") == n, _weighted(F.col("w"), n))
    rows = rows.withColumn("item", F.array_distinct(item))
    return rows.withColumn("print", simhash(F.col("item")))


def places_of(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(id, its_mark, places): the (size, start) of every item-sized window that holds a shingle of ``n``
    words which some item of that size has. ``docs``: (doc_id, mark, w)."""
    known = C.stage(items.where(F.col("n") == n).select("item_size", F.explode(_hashes(F.col("w"), n)).alias("item_h")).distinct(), "known")
    each = docs.select("doc_id", "mark", F.posexplode(_hashes(F.col("w"), n)).alias("i", "h"))
    hits = each.join(C.bounded(known), F.col("h") == F.col("item_h")).groupBy("doc_id", "mark", "item_size").agg(F.collect_set("i").alias("at"))
    size = F.col("item_size")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(i - size + n, i))))
    places = F.flatten(F.collect_list(F.transform(starts, lambda x: F.struct(size.alias("size"), x.alias("start")))))
    return hits.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("its_mark")).agg(places.alias("places"))


def windows_of(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(doc_id, mark, size, start, window): the distinct shingles of each of ``places_of``."""
    places = C.stage(places_of(docs, items, n), "places")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its_mark"))
    rows = docs.join(C.bounded(places), same).select("doc_id", "mark", _weighted(F.col("w"), n).alias("all"), "places")
    rows = rows.select("doc_id", "mark", "all", F.explode("places").alias("p"))
    # windows are counted in words: the last shingle of one starts n - 1 words before its end
    begin, end = F.greatest(F.col("p.start"), F.lit(0)), F.least(F.col("p.start") + F.col("p.size") - n + 1, F.size("all"))
    rows = rows.where(end > begin).select("doc_id", "mark", "p.size", "p.start", F.array_distinct(F.slice("all", begin + 1, end - begin)).alias("window"))
    return rows.withColumn("wprint", simhash(F.col("window")))


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), words().alias("w"))


def _leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame | None:
    """As ``leaks``, with the texts' marks; None where no item has words."""
    if radius > RADIUS:
        raise ValueError(f"the index guarantees a radius of at most {RADIUS}")
    items = C.stage(items_of(benchmark.select("item_id", "text")), "items")
    rows = None
    for n in sorted(r["n"] for r in items.select("n").distinct().collect()):  # five at most
        found = windows_of(_marked(docs), items, n)
        rows = found if rows is None else rows.unionByName(found)
    if rows is None:
        return None
    rows = C.stage(rows, "windows")

    index = items.select(F.col("item_id").alias("near_id"), "item_size", "print", F.explode(_near_blocks(F.col("print"))).alias("b")).select("near_id", "item_size", "print", "b.k", "b.v")
    asked = rows.select("*", F.explode(_blocks(F.col("wprint"))).alias("a"))
    met = asked.join(C.bounded(C.stage(index, "index")), (F.col("size") == F.col("item_size")) & (F.col("a.k") == F.col("k")) & (F.col("a.v") == F.col("v")))
    met = met.withColumn("apart", F.col("print").bitwiseXOR(F.col("wprint"))).where(F.bit_count("apart") <= radius)
    # a pair that several blocks find is taken at the first of them
    met = met.where(~F.exists(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda k: (k < F.col("k")) & (F.bit_count(_block(F.col("apart"), k)) <= NEAR)))
    met = met.select("doc_id", "mark", "start", "window", "near_id", F.col("print").alias("near_print"))
    exact = C.bounded(items.select("item_id", "item", "print"))
    met = met.join(exact, F.col("near_id").eqNullSafe(F.col("item_id")) & (F.col("near_print") == F.col("print")))
    weight = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["g"])
    met = met.withColumn("both", weight(F.array_intersect("window", "item"))).withColumn("either", weight(F.array_union("window", "item")))
    good = met.withColumn("similarity", F.col("both") / F.col("either")).where(F.col("similarity") >= similarity)
    start = F.col("start").cast("long")
    best = F.max(F.struct("similarity", (-start).alias("back")))
    out = good.groupBy("doc_id", "mark", "item_id").agg(best.alias("best"), F.count_distinct("start").alias("n_windows"))
    return out.select("doc_id", "mark", "item_id", F.col("best.similarity").alias("similarity"), F.greatest(-F.col("best.back"), F.lit(0)).alias("first_word"), "n_windows")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_windows): each document that holds a passage similar to
    an item, with its best window, where that starts (words from 0), and how many windows are similar."""
    found = _leaks(docs, benchmark, similarity, radius)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long, n_windows long")
    return found.drop("mark")


def without_leaks(docs: DataFrame, benchmark: DataFrame, **law) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage."""
    found = _leaks(docs, benchmark, **law)
    if found is None:
        return docs
    bad = C.stage(found.select(F.col("doc_id").alias(C.own("id")), F.col("mark").alias(C.own("mark"))).distinct(), "leaks")
    return docs.join(C.bounded(bad), F.col("doc_id").cast("long").eqNullSafe(F.col(C.own("id"))) & (F.xxhash64("text") == F.col(C.own("mark"))), "left_anti")


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_CUT = "CASE WHEN len({0}) = 0 THEN [] ELSE list_transform(generate_series(1, len({0}) - least({1}, len({0})) + 1), lambda i: array_to_string({0}[i : i + least({1}, len({0})) - 1], ' ')) END"
#: The same result without fingerprints: all windows that hold a shared shingle, compared exactly.
SQL = rf"""
WITH i AS (SELECT item_id, w, len(w) AS size, least(len(w), 5) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
ish AS (SELECT item_id, size, n, unnest(s) AS s, generate_subscripts(s, 1) AS j FROM (SELECT item_id, size, n, {_CUT.format('w', 'n')} AS s FROM i)),
ds AS (SELECT doc_id, n, w, list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(w[i : i + n - 1], ' ')) AS s FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n),
dsh AS (SELECT doc_id, n, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM ds),
win AS (SELECT DISTINCT doc_id, size, unnest(generate_series(k - 1 - size + n, k - 1)) AS start FROM dsh JOIN (SELECT DISTINCT size, n, s FROM ish) USING (n, s)),
cut AS (SELECT doc_id, size, start, w[greatest(start, 0) + 1 : least(start + size, len(w))] AS x FROM win JOIN d USING (doc_id)),
wset AS (SELECT doc_id, size, start, list_distinct({_CUT.format('x', 'least(size, 5)')}) AS a FROM cut),
iset AS (SELECT item_id, size, list_distinct(list(s)) AS b FROM ish GROUP BY item_id, size),
sim AS (SELECT doc_id, item_id, start, list_sum(list_transform(list_intersect(a, b), lambda t: length(replace(t, ' ', '')))) / list_sum(list_transform(list_distinct(list_concat(a, b)), lambda t: length(replace(t, ' ', ''))))::DOUBLE AS s
        FROM wset JOIN iset USING (size))
SELECT doc_id, item_id, max(s) AS similarity, CAST(greatest(arg_min(start, row(-s, start)), 0) AS BIGINT) AS first_word, count(DISTINCT start) AS n_windows FROM sim WHERE s >= 0.8 GROUP BY ALL
"""
