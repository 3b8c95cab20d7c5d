"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (h1, h2, n_docs, keeper) in buckets of the 128-bit line hash, each bucket one file sorted
by it: lines that were new with a batch of documents, in how many of its documents each was met, and the
largest doc_id among them. All runs of a store have the same buckets, so a new batch, shuffled into
buckets once, is merge-anti-joined with every run without a further shuffle or sort. What no run holds
becomes a run of level 0; as soon as a level holds ``fanout`` runs they are merged, bucket by bucket, into
one run of the next level, so a store of n batches has O(fanout * log n) runs and rewrites each entry
O(log n) times.

``dedup_lines`` feeds batches from the largest doc_ids down. A line is then new in the batch of its
largest doc_id, which is the one that keeps it; later sightings only count.

Defined results: a null or empty text is one empty line; each row is a document, so repeated rows
count one by one and share their fate; rows of one id with different texts lose lines each by itself; a null
doc_id is smaller than any other; other columns, whatever their names, are ignored; a very long line is
just hashed, and very long texts are rewritten whole; an empty table gives an empty result.
"""

from __future__ import annotations


import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

STRIP = b" \t\n\x0b\x0c\r"
OCCURRENCES = "doc_id long, mark long, h1 long, h2 long"
#: Entries of a bucket, as far as the engine's limit on the number of buckets lets.
BUCKET_ROWS, MOST_BUCKETS = 1 << 17, 100_000


def line_key(line: bytes) -> bytes:
    """White space stripped, A-Z lower-cased (bytes.lower changes nothing else)."""
    return line.strip(STRIP).lower()


def key_hash(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.large_binary()).to_pylist()]


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, mark, h1, h2): each row's distinct line keys of at least ``least`` code points; the mark is a
    hash of the text."""
    C.ship_by_value(__name__)

    def emit(batches):
        for batch in batches:
            ids, marks, one, two = [], [], [], []
            for doc, mark, text in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), _texts(batch)):
                found = {key_hash(k) for k in {line_key(x) for x in text.split(b"\n")} if long_enough(k, least)}
                ids += [doc] * len(found)
                marks += [mark] * len(found)
                one += [h[0] for h in found]
                two += [h[1] for h in found]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, marks, one, two)], ["doc_id", "mark", "h1", "h2"])

    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(emit, OCCURRENCES)


class Run:
    """A table (h1, h2, n_docs, keeper) in the shared folder, bucketed and sorted by (h1, h2). ``rows`` must
    already lie in those buckets, so that each task writes one file."""

    def __init__(self, rows: DataFrame, buckets: int):
        self.spark, self.path = rows.sparkSession, C.fresh_path(rows.sparkSession, "run")
        self.name = "waymark_" + self.path.rsplit("-", 1)[1]
        rows.select("h1", "h2", "n_docs", "keeper").write.bucketBy(buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.path).saveAsTable(self.name)
        self.df = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        C.delete(self.spark, self.path)


class RunStore:
    """Levelled runs in the shared folder. ``levels[k]`` lists the runs of level k, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int = 8):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.fanout, self.buckets, self.levels = spark, fanout, buckets, []
        # lets a bucket of one sorted file count as sorted
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")

    @property
    def runs(self) -> list[Run]:
        return [run for level in self.levels for run in level]

    def batch(self, occurrences_: DataFrame) -> Run:
        """The keys of a batch (doc_id, h1, h2: each document's keys once), shuffled into the buckets. Each Arrow
        batch is combined first, so that a line in a third of all documents reaches its bucket as a few rows."""
        C.ship_by_value(__name__)

        def combine(batches):
            for batch in batches:
                t = pa.Table.from_batches([batch]).group_by(["h1", "h2"]).aggregate([("h1", "count"), ("doc_id", "max")])
                yield from t.select(["h1", "h2", "h1_count", "doc_id_max"]).rename_columns(["h1", "h2", "n", "most"]).to_batches()

        few = occurrences_.select("h1", "h2", "doc_id").mapInArrow(combine, "h1 long, h2 long, n long, most long")
        dealt = few.repartition(self.buckets, "h1", "h2")
        return Run(dealt.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("most").alias("keeper")), self.buckets)

    def unseen(self, batch: Run) -> DataFrame:
        """Rows of ``batch`` whose line no run holds: a merge anti-join per run, bucket by bucket."""
        out = batch.df
        for run in self.runs:
            out = out.join(run.df.hint("merge"), ["h1", "h2"], "left_anti")
        return out

    def admit(self, batch: Run) -> DataFrame:
        """Adds what is new in ``batch`` as a run of level 0 and returns the rest, which runs hold already."""
        new = Run(self.unseen(batch), self.buckets)
        again = C.stage(batch.df.join(new.df.hint("merge"), ["h1", "h2"], "left_anti"), "again")
        self._add(new, 0)
        return again

    def _add(self, run: Run, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._add(self._merged(old), level + 1)

    def _merged(self, old: list[Run]) -> Run:
        """One run of several without a shuffle: no line is in two of them, so a full outer merge join of
        two leaves each row whole."""
        while len(old) > 1:
            a, b = old[0].df, old[1].df.withColumnsRenamed({"n_docs": "n", "keeper": "k"})
            both = a.join(b.hint("merge"), ["h1", "h2"], "full_outer")
            run = Run(both.select("h1", "h2", F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("keeper", "k").alias("keeper")), self.buckets)
            for x in old[:2]:
                x.drop()
            old = [run, *old[2:]]
        return old[0]

    def compact(self) -> DataFrame:
        """Merges everything into one run and returns it."""
        if len(self.runs) > 1:
            self.levels = [[] for _ in self.levels] + [[self._merged(self.runs)]]
        return self.runs[0].df

    def drop(self) -> None:
        for run in self.runs:
            run.drop()
        self.levels = []


def first_seen(store: RunStore, docs: DataFrame, least: int = 20) -> DataFrame:
    """Incremental use: the (doc_id, h1, h2) of ``docs`` that no earlier batch had, kept in the
    largest doc_id of this batch; they are then added to the store."""
    batch = store.batch(occurrences(docs, least))
    new = C.stage(store.unseen(batch).select("h1", "h2", F.col("keeper").alias("doc_id")), "new")
    store.admit(batch)
    batch.drop()
    return new


def _rewrite(joined: DataFrame, least: int) -> DataFrame:
    """Drops from each text the lines listed in ``drop`` (h1, h2 pairs packed by 16 bytes)."""

    def emit(batches):
        for batch in batches:
            out = []
            for doc, text, gone in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("gone").to_pylist()):
                lines = text.split(b"\n")
                kept = lines
                if gone:
                    gone = {(x["h1"], x["h2"]) for x in gone}
                    kept = [x for x in lines if not (long_enough(k := line_key(x), least) and key_hash(k) in gone)]
                out.append((doc, len(lines), len(lines) - len(kept), b"\n".join(kept)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.large_binary()).cast(pa.large_string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return joined.mapInArrow(emit, "doc_id long, n_lines long, n_dropped long, kept string")


def dedup_lines(docs: DataFrame, least: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): lines whose key has ``least`` code points and is in
    ``min_docs`` documents stay only in the largest doc_id that has them.

    The line hashes are extracted in one pass over the texts and staged by batch: ranges of doc_id with
    about as many documents, the largest first. The runs say who keeps a line; together with the later
    sightings they give the counts, and one join by doc_id takes the lines that go out of the texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shares = [k / batches for k in range(1, batches)]
    ends = (docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None) or []
    batch = sum((F.coalesce(F.col("doc_id") <= end, F.lit(True)).cast("int") for end in ends), F.lit(0))
    occ = C.Staged(occurrences(docs, least).withColumn("batch", batch), "lines", partition_by="batch")
    store = RunStore(docs.sparkSession, fanout, max(1, min(MOST_BUCKETS, occ.df.count() // BUCKET_ROWS)))
    often = None
    for k in range(batches):
        keys = store.batch(occ.df.where(F.col("batch") == k))
        again = store.admit(keys).withColumn("keeper", F.lit(None).cast("long"))
        often = again if often is None else often.unionByName(again)
        keys.drop()
    often = often.unionByName(store.compact()).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    often = C.stage(often.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "often")
    store.drop()
    gone = occ.df.join(C.bounded(often), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy(F.col("doc_id").alias("id"), F.col("mark").alias("its_mark")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("its_mark"))
    return _rewrite(docs.join(C.bounded(C.stage(gone, "gone")), same, "left").select("doc_id", "text", "gone"), least)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
