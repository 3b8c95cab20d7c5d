"""Quality rules with cross-document line frequency, in DataFrame operations only.

Base rules look at one document: its words, symbols, repeated lines and repeated 3-word windows. The
method then hashes normalised lines and counts, for each host (the documents' source), the distinct
documents that hold a line; exact copies count as one, so that a copied document does not condemn
itself. Lines in more documents of a host than its limit are removed from all but the first of them, and
documents left with less than ``min_left`` of their words are rejected. The first is the smallest doc_id
among those that pass the base rules, so that no line is lost to the corpus with a document that goes
anyway. A host's limit is the part ``max_share`` of its distinct texts, ``max_docs`` at least, so that
it means the same whatever the host's size.

Texts are read once, for the per-document figures and the hash and words of each line; what follows
works on those. The figures come from arrays within the row, without a shuffle: 3-word windows are
compared by 64-bit hashes, sorted next to each other as packed (hash part, place) numbers.

Defined results: a null or empty text has no words and fails; a null host is a host of its own;
repeated rows are judged one by one alike, and rows of one id with different texts each by its own; a null
id is never the first; very long texts are judged whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

SYMBOLS = "#*$%&|<>"
#: Places within a text take 24 bits of a packed window; the hash parts take the upper 40. Longer texts
#: sort pairs of numbers instead.
PLACE_BITS = 24
MAX_DOCS, MAX_SHARE = 20, 0.01
MIN_LEFT = 0.2


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _packed(windows: Column, shift: int) -> Column:
    """Ascending (40 bits of the window's hash, its place) numbers."""
    part = (lambda h: F.shiftleft(h, PLACE_BITS)) if shift else (lambda h: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS))
    return F.sort_array(F.transform(windows, lambda h, i: part(h).bitwiseOR(i.cast("long"))))


def _met_again(packed: str) -> Column:
    """Places whose hash part the number before or after has too."""
    a = F.col(packed)
    n = F.size(a)
    same = lambda x, i: (i >= 0) & (i < n) & (F.shiftright(F.get(a, i), PLACE_BITS) == F.shiftright(x, PLACE_BITS))
    hits = F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1))
    return F.transform(hits, lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1))


def _met_again_paired(windows: Column) -> Column:
    """The same for texts of any length."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    # an array of one, so that the pairs are sorted once and not for every look
    hits = F.transform(F.array(pairs), lambda a: F.filter(a, lambda x, i: ((i > 0) & (F.get(a, i - 1)["h"] == x["h"])) | ((i < F.size(a) - 1) & (F.get(a, i + 1)["h"] == x["h"]))))
    return F.sort_array(F.transform(F.get(hits, F.lit(0)), lambda x: x["i"]))


def base_figures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and _lines to ``docs``."""
    text = _text()
    out = docs.withColumns({
        "_words": F.regexp_extract_all(text, F.lit(C.WORD), F.lit(0)),
        "_lines": F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(C.SPACES)) != ""),
        "word_chars": F.length(F.translate(text, C.SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
    })
    w = F.col("_words")
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumns({"_windows": windows, "n_words": F.size(w).cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    # only texts in which some window comes back need the places
    again = F.size(F.array_distinct("_windows")) < F.size("_windows")
    none = F.array().cast("array<bigint>")
    out = out.withColumn("_some", F.when(again, F.col("_windows")).otherwise(none)).drop("_windows", "_words")
    packs = F.size("_some") <= (1 << PLACE_BITS)
    out = out.withColumns({"_p0": F.when(packs, _packed(F.col("_some"), 0)).otherwise(none), "_p1": F.when(packs, _packed(F.col("_some"), 1)).otherwise(none)})
    # two independent 40-bit parts must agree, which leaves no chance to a false pair
    both = F.sort_array(F.array_intersect(_met_again("_p0"), _met_again("_p1")))
    out = out.withColumn("_at", F.when(packs, both).otherwise(_met_again_paired(F.col("_some")))).drop("_p0", "_p1", "_some")
    at = F.col("_at")
    step = F.transform(at, lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))))
    out = out.withColumn("n_repeat_words", F.aggregate(step, F.lit(0).cast("long"), lambda s, x: s + x)).drop("_at")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))


def line_hash(line: Column) -> Column:
    """Of the line in lower case with white space and digits evened out."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(line, F.lit(C.SPACES))), "[0-9]+", "0"), "[\\x20\\x09-\\x0D]+", " ")
    return F.xxhash64(plain)


FIGURES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _figured(docs: DataFrame, host: str) -> DataFrame:
    """One staged row for each row of ``docs``: _rid, _mark (a hash of the text), _host, the figures, and _at,
    the (hash, words) of each line that is not blank."""
    rows = base_figures(docs.select("doc_id", "text", F.col(host).alias("_host"), F.xxhash64(_text()).alias("_mark")))
    each = F.transform("_lines", lambda x: F.struct(line_hash(x).alias("h"), F.regexp_count(x, F.lit(C.WORD)).alias("w")))
    return C.stage(rows.select(F.monotonically_increasing_id().alias("_rid"), "_mark", "_host", *FIGURES, each.alias("_at")), "figures")


def common_lines(figured: DataFrame, max_docs: int, max_share: float) -> DataFrame:
    """(_h, _l, _first): lines that more distinct texts of a host hold than its limit, and the smallest
    id among the documents with the line that pass the base rules."""
    limits = C.stage(figured.groupBy("_host").agg(F.greatest(F.lit(float(max_docs)), F.lit(max_share) * F.count_distinct("_mark")).alias("limit")), "limits")
    hashes = F.array_distinct(F.transform("_at", lambda x: x["h"]))
    rows = figured.select("_host", "_mark", F.when(~F.col("base_failed"), F.col("doc_id")).alias("passing"), F.explode(hashes).alias("_l"))
    # one row for each text first, as hosts and lines may be hot
    counts = rows.groupBy("_host", "_l", "_mark").agg(F.min("passing").alias("passing")).groupBy("_host", "_l").agg(F.count("*").alias("n"), F.min("passing").alias("_first"))
    counts = counts.where(F.col("n") > max_docs).join(C.bounded(limits.withColumnRenamed("_host", "_h")), F.col("_host").eqNullSafe(F.col("_h")))
    return C.stage(counts.where(F.col("n") > F.col("limit")).select("_h", "_l", "_first"), "common")


def _judged(docs: DataFrame, max_docs: int, max_share: float, min_left: float, host: str) -> DataFrame:
    """One row per row of ``docs`` with _mark, _host, the figures, n_common_lines, words_left and kept."""
    rows = _figured(docs, host)
    common = C.bounded(common_lines(rows, max_docs, max_share))
    lines = rows.select("_rid", "_host", "doc_id", F.explode("_at").alias("x"))
    lost = lines.join(common, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("x.h") == F.col("_l"))).where(~F.col("doc_id").eqNullSafe(F.col("_first")))
    sums = lost.groupBy(F.col("_rid").alias("_of")).agg(F.count("*").alias("_n"), F.sum("x.w").alias("_w"))
    zero = F.lit(0).cast("long")
    out = rows.join(sums, F.col("_rid") == F.col("_of"), "left").select("_mark", "_host", *FIGURES, F.coalesce("_n", zero).alias("n_common_lines"), (F.col("n_words") - F.coalesce("_w", zero)).alias("words_left"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("words_left") >= F.lit(min_left) * F.col("n_words")))


def judge_quality(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, host: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_common_lines, words_left, kept) for every row."""
    return _judged(docs, max_docs, max_share, min_left, host).drop("_mark", "_host")


def keep_good(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT, host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are not rejected, as they are. The verdict follows from id, host and text."""
    bad = _judged(docs, max_docs, max_share, min_left, host).where(~F.col("kept"))
    bad = C.stage(bad.select(F.col("doc_id").alias(C.own("id")), F.col("_host").alias(C.own("host")), F.col("_mark").alias(C.own("mark"))).distinct(), "rejected")
    same = F.col("doc_id").eqNullSafe(F.col(C.own("id"))) & F.col(host).eqNullSafe(F.col(C.own("host"))) & (F.xxhash64(_text()) == F.col(C.own("mark")))
    return docs.join(C.bounded(bad), same, "left_anti")


def remove_common(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, host: str = "source") -> DataFrame:
    """(doc_id, text): texts without the lines above the limit (joined back in their order)."""
    common = C.bounded(common_lines(_figured(docs, host), max_docs, max_share))
    split = docs.select("doc_id", F.col(host).alias("_host"), F.split(_text(), "\n", -1).alias("_all"))
    rows = C.stage(split.select(F.monotonically_increasing_id().alias("_rid"), "*"), "split").select("_rid", "doc_id", "_host", F.posexplode("_all").alias("_i", "_x"))
    left = rows.join(common, F.col("_host").eqNullSafe(F.col("_h")) & (line_hash(F.col("_x")) == F.col("_l")) & (F.trim(F.col("_x"), F.lit(C.SPACES)) != ""), "left")
    kept = left.groupBy("_rid", "doc_id").agg(F.sort_array(F.collect_list(F.when(F.col("_l").isNull() | F.col("doc_id").eqNullSafe(F.col("_first")), F.struct("_i", "_x")))).alias("_k"))
    return kept.select("doc_id", F.concat_ws("\n", F.col("_k._x")).alias("text"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    out = judge_quality(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_lines", "words_left")


_W = r"[^\x20\x09-\x0D]+"
_TRIM = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_W}') AS w, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents),
f AS (SELECT doc_id, source, text, w, list_filter(all_lines, lambda x: {_TRIM.format('x')} <> '') AS lines FROM d),
win AS (SELECT doc_id, i, row(w[i], w[i + 1], w[i + 2]) AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM f)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
b AS (SELECT f.doc_id, source, text, lines, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(cov.n, 0) > 50 * len(w) AS base_failed
      FROM f LEFT JOIN cov USING (doc_id)),
l AS (SELECT doc_id, source, text, base_failed, unnest(lines) AS x FROM b),
n AS (SELECT doc_id, source, text, base_failed, len(regexp_extract_all(x, '{_W}')) AS c, regexp_replace(regexp_replace(lower({_TRIM.format('x')}), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS k FROM l),
hosts AS (SELECT source, greatest({MAX_DOCS}, {MAX_SHARE}::DOUBLE * count(DISTINCT text)) AS most FROM b GROUP BY source),
held AS (SELECT source, k, count(DISTINCT text) AS texts, min(doc_id) FILTER (NOT base_failed) AS first FROM n GROUP BY source, k),
common AS (SELECT held.source, k, first FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE texts > most),
lost AS (SELECT n.doc_id, CAST(sum(n.c) AS BIGINT) AS w, count(*) AS n FROM n JOIN common ON n.source IS NOT DISTINCT FROM common.source AND n.k = common.k WHERE n.doc_id IS DISTINCT FROM first GROUP BY n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - coalesce(lost.w, 0) >= {MIN_LEFT} * n_words AS kept,
       coalesce(lost.n, 0) AS n_common_lines, n_words - coalesce(lost.w, 0) AS words_left
FROM b LEFT JOIN lost USING (doc_id)
"""
