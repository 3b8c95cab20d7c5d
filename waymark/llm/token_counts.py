"""Token counts of a SentencePiece BPE model, counted once per distinct pre-token.

No piece of the model holds a space mark after another character (checked on loading), so merges never
reach over the start of a run of spaces. A text with the leading space that the library adds thus
falls into pre-tokens, each a run of spaces (or their mark U+2581) and what follows up to the next
run, and its token count is the sum over them. Pieces are counted once per distinct pre-token, joined
to the pre-token frequencies of each document, and summed; ids are never kept.

Pre-tokens above a frequency that at most FREQUENT of them reach, with FREQUENT_BYTES in all, are joined by
broadcast (both are counted); all others meet their counts by a shuffle join, as (row, pre-token, frequency).

Defined results: a null or empty text has 0 bytes and tokens; each row is counted by itself, repeated
rows too; a text without spaces is one pre-token, however long; ties between frequencies change nothing; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Distinct pre-tokens whose counts may be broadcast, and bytes of them.
FREQUENT, FREQUENT_BYTES = 1 << 19, 16 << 20
PRE_TOKEN = "[ \\u2581]+[^ \\u2581]*"


def load(model: bytes):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor()
    sp.LoadFromSerializedProto(model)
    return sp


def check_model(model: bytes) -> None:
    """Raises where the model's pieces could join two pre-tokens or its text is rewritten first."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or any(p.type == 4 for p in proto.pieces):
        raise ValueError("the model rewrites white space or has user-defined symbols")
    if any("▁" in p.piece.lstrip("▁") for p in proto.pieces):
        raise ValueError("the model has pieces that reach over the start of a run of spaces")


def count_pieces(words: DataFrame, model: bytes) -> DataFrame:
    """(piece, freq, n_tokens) of distinct pre-tokens (piece, freq)."""
    C.ship_by_value(__name__)
    shared = words.sparkSession.sparkContext.broadcast(model)

    def emit(batches):
        sp = load(shared.value)
        base = len(sp.encode("x"))  # a letter in front takes the library's own leading space
        for batch in batches:
            found = sp.encode([f"x{p}" for p in batch.column("piece").to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("freq"), pa.array([len(x) - base for x in found], pa.int64())], ["piece", "freq", "n_tokens"])

    return words.select("piece", "freq").mapInArrow(emit, "piece string, freq long, n_tokens long")


def _least_frequent(vocabulary: DataFrame, most: int) -> int:
    """The lowest power of two that at most ``most`` pre-tokens, and bytes within bounds, reach in
    frequency (64 rows to the driver)."""
    steps = vocabulary.groupBy(F.floor(F.log2("freq")).alias("k")).agg(F.count("*").alias("count"), F.sum(F.octet_length("piece")).alias("bytes")).orderBy(F.desc("k")).collect()
    total, size, least = 0, 0, 62
    for row in steps:
        total, size = total + row["count"], size + row["bytes"]
        if total > most or size > FREQUENT_BYTES:
            break
        least = row["k"]
    return 1 << least


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row."""
    with open(model_path, "rb") as f:
        model = f.read()
    check_model(model)
    docs = C.settled(docs.select("doc_id", "text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(PRE_TOKEN), F.lit(0)))
    words = docs.select(F.explode(pieces).alias("piece")).groupBy("piece").agg(F.count("*").alias("freq"))
    vocabulary = C.stage(count_pieces(words, model), "pieces")
    least = _least_frequent(vocabulary, frequent)
    known = vocabulary.where(F.col("freq") >= least).select(F.col("piece").alias("p"), F.col("n_tokens").alias("n"))
    rare = vocabulary.where(F.col("freq") < least).select(F.col("piece").alias("p"), F.col("n_tokens").alias("n"))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), pieces.alias("pieces"))
    # the empty pre-token in front is there for every row; only it carries the row's columns
    each = rows.select("rid", "doc_id", "n_bytes", F.explode(F.concat(F.array(F.lit("")), "pieces")).alias("piece"))
    each = each.join(F.broadcast(known), F.col("piece") == F.col("p"), "left")
    is_row, is_rare = F.col("piece") == "", (F.col("piece") != "") & F.col("p").isNull()
    # what is summed already gets a key of its own, so that no join partition gathers it
    key = F.when(is_rare, F.col("piece")).otherwise(F.concat(F.lit("\x00"), F.col("rid").cast("string")))
    freq = each.groupBy("rid", key.alias("key")).agg(
        F.max(F.when(is_row, F.col("doc_id"))).alias("doc_id"), F.max(F.when(is_row, F.col("n_bytes"))).alias("n_bytes"), F.sum(F.col("n")).alias("known"), F.count("*").alias("freq")
    )
    summed = freq.join(rare, F.col("key") == F.col("p"), "left").withColumn("tokens", F.coalesce(F.col("known"), F.col("n") * F.col("freq"), F.lit(0)))
    out = summed.groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
