"""K-d tree sharding: regions of the metadata space are split at distributed weighted medians.

A document's point is (log size, language, source), each dimension scaled to [0, 1] over the corpus,
and a hash of its text and id that breaks ties. Languages and sources count by their rank among the distinct
ones. Every region that is to hold more than one shard is
cut along its widest dimension where the bytes on its left reach their share. The cut comes from
histograms: one aggregate per pass for all regions of a level, at most CELLS rows to the driver,
zooming into the cell of the median until the cut is within TOLERANCE of its share or a single point
is left; heavy points are cut along the tie hash. Points are thus split whatever their weight, so a
hot source, language or group of copies spreads over as many shards as its bytes ask for.

Defined results: a null text has size 1 and crc 0; null languages and sources are the least values of
their dimension; repeated rows with one id and text stay together, whatever shares they make uneven; very
long texts weigh by their bytes and are never cut; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

DIMENSIONS = ("x0", "x1", "x2")
TIE = "tie"
#: Histogram cells over all regions of a level that one pass may return to the driver.
CELLS = 1 << 16
#: A cut may miss its share of a region's bytes by this part of it.
TOLERANCE = 2e-4
#: Regions whose cuts are sought at once; further ones of a level take further passes.
REGIONS_AT_ONCE = 1 << 14
#: Rows of a shard that one task numbers.
SLOT_ROWS = 1 << 20


@dataclass
class Cut:
    """Left are the points with value < at, and those with value == at and tie <= tie."""

    node: int
    dimension: str
    at: float
    tie: float


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def points(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = text_bytes(F.col("text"))
    tie = F.shiftrightunsigned(F.xxhash64(text, F.col("doc_id")), 11).cast("double") / F.lit(float(1 << 53))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.log2(size.cast("double")).alias("x0"), F.col("lang").alias("name1"), F.col("source").alias("name2"), tie.alias(TIE),
    )
    out = C.stage(out, "named")
    for k in (1, 2):
        ranks = C.ranked(out.select(F.col(f"name{k}").alias("value")).distinct(), "value", nulls_first=True)
        ranks = C.bounded(C.stage(ranks.select("value", F.col("rank").cast("double").alias(f"x{k}")), "ranks"))
        out = out.join(ranks, F.col(f"name{k}").eqNullSafe(F.col("value"))).drop("value")
    return out.select("doc_id", "size", "text_crc32", *DIMENSIONS, TIE)


def _scaled(df: DataFrame) -> DataFrame:
    ends = df.agg(*[f(c).alias(f"{n}{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scale = lambda c: (F.col(c) - F.lit(ends["lo" + c])) / F.lit((ends["hi" + c] - ends["lo" + c]) or 1.0)
    return df.withColumns({c: scale(c) for c in DIMENSIONS}) if ends["lox0"] is not None else df


class _Search:
    """The median search of one region along one value; the driver holds only this."""

    def __init__(self, node: int, dimension: str, wanted: float, total: int, lo: float, hi: float, at: float | None = None):
        self.node, self.dimension, self.wanted, self.total = node, dimension, wanted, total
        self.lo, self.hi, self.at, self.before, self.done = lo, hi, at, 0, None

    def advance(self, cells: list) -> None:
        """``cells``: rows (sum, least, most) in the order of their value."""
        upto = self.before
        for row in cells:
            if upto + row["sum"] >= self.wanted:
                near = min((abs(upto - self.wanted), False), (abs(upto + row["sum"] - self.wanted), True))
                if near[0] <= TOLERANCE * self.total:
                    self._cut(row["most"] if near[1] else row["least"], near[1])
                elif row["least"] < row["most"]:
                    self.lo, self.hi, self.before = row["least"], row["most"], upto
                elif self.at is None:
                    self.at, self.lo, self.hi, self.before = row["most"], 0.0, 1.0, upto
                else:
                    self._cut(row["most"], near[1])
                return
            upto += row["sum"]
        self._cut(cells[-1]["most"] if cells else self.hi, True)

    def _cut(self, value: float, included: bool) -> None:
        if self.at is None:
            self.done = Cut(self.node, self.dimension, value, 2.0 if included else -1.0)
        else:
            self.done = Cut(self.node, self.dimension, self.at, value if included else value - 2.0**-53)


def _cuts(rows: DataFrame, shares: dict[int, float]) -> list[Cut]:
    """A cut for each region in ``shares``: what part of its bytes goes left."""
    if len(shares) > REGIONS_AT_ONCE:
        some = list(shares)[:REGIONS_AT_ONCE]
        return _cuts(rows, {n: shares[n] for n in some}) + _cuts(rows, {n: x for n, x in shares.items() if n not in set(some)})
    spark = rows.sparkSession
    asked = F.broadcast(spark.createDataFrame([(n,) for n in shares], "node long"))
    wide = rows.join(asked, "node").groupBy("node").agg(F.sum("size").alias("sum"), *[f(c).alias(f"{n}{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
    open_ = []
    for r in wide:
        widest = max(DIMENSIONS, key=lambda c: r["hi" + c] - r["lo" + c])
        open_.append(_Search(r["node"], widest, shares[r["node"]] * r["sum"], r["sum"], r["lo" + widest], r["hi" + widest]))
    found: list[Cut] = []
    while open_:
        bins = max(16, CELLS // len(open_))
        sought = [(s.node, DIMENSIONS.index(s.dimension) + 1, s.lo, s.hi, s.at) for s in open_]
        here = rows.join(F.broadcast(spark.createDataFrame(sought, "node long, d int, lo double, hi double, at double")), "node")
        along = F.element_at(F.array(*DIMENSIONS), F.col("d"))
        here = here.withColumn("v", F.when(F.col("at").isNull(), along).when(along == F.col("at"), F.col(TIE))).where("v BETWEEN lo AND hi")
        cell = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
        got = here.groupBy("node", cell.alias("cell")).agg(F.sum("size").alias("sum"), F.min("v").alias("least"), F.max("v").alias("most")).collect()
        cells: dict[int, list] = {}
        for r in sorted(got, key=lambda r: r["cell"]):
            cells.setdefault(r["node"], []).append(r)
        for s in open_:
            s.advance(cells.get(s.node, []))
        found += [s.done for s in open_ if s.done]
        open_ = [s for s in open_ if not s.done]
    return found


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """Adds ``shard`` (0 to shards - 1). A region of k shards gives k // 2 to its left."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    spark = rows.sparkSession
    rows, before = rows.withColumn("node", F.lit(0).cast("long")), None
    open_, leaves = {0: (0, shards)}, []  # region -> its first shard, how many it holds
    while open_:
        leaves += [(n, first) for n, (first, k) in open_.items() if k == 1]
        split = {n: x for n, x in open_.items() if x[1] > 1}
        cuts = _cuts(rows, {n: (k // 2) / k for n, (_, k) in split.items()}) if split else []
        if cuts:
            table = spark.createDataFrame([(c.node, DIMENSIONS.index(c.dimension) + 1, c.at, c.tie) for c in cuts], "node long, d int, at double, upto double")
            along = F.element_at(F.array(*DIMENSIONS), F.col("d"))
            left = (along < F.col("at")) | ((along == F.col("at")) & (F.col(TIE) <= F.col("upto")))
            child = 2 * F.col("node") + F.when(left, 1).otherwise(2)
            rows = rows.join(C.bounded(table), "node", "left").withColumn("node", F.when(F.col("d").isNull(), F.col("node")).otherwise(child)).drop("d", "at", "upto")
            staged = C.Staged(rows, "regions")
            rows = staged.df
            if before:
                before.drop()
            before = staged
        open_ = {}
        for c in cuts:  # a region without a cut has no rows
            first, k = split[c.node]
            open_ |= {2 * c.node + 1: (first, k // 2), 2 * c.node + 2: (first + k // 2, k - k // 2)}
    table = spark.createDataFrame(leaves, "node long, shard int")
    return rows.join(C.bounded(table), "node").drop("node") if leaves else rows.withColumn("shard", F.lit(0)).drop("node")


def with_slots(rows: DataFrame) -> DataFrame:
    """Adds ``slot``: 0, 1, ... within each shard. Shards are numbered in parts, a part per task."""
    rows = C.stage(rows, "shards")
    parts = F.lit(max(1, -(-rows.count() // SLOT_ROWS) * 8))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), parts))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("c"))
    ahead = counts.withColumn("ahead", F.sum("c").over(Window.partitionBy("shard").orderBy("part")) - F.col("c")).drop("c")
    place = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("place", place).join(C.bounded(ahead), ["shard", "part"]).withColumn("slot", (F.col("place") + F.col("ahead")).cast("long"))


def shard_documents(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    Give the number of leaves, or ``target_bytes`` that no leaf should much exceed.
    """
    rows = C.stage(_scaled(C.stage(points(docs), "points")), "scaled")
    if target_bytes:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    out = with_slots(assign(rows, shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents"), 8)
