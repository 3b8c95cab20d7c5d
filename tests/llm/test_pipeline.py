"""The pipeline's rows against a brute-force version of its stages on a small corpus."""

import collections
import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from waymark.llm import _common, quality


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def corpus(rng):
    word = lambda: f"{rng.choice('abcdefghij')}{rng.choice('klmnopq')}{rng.randint(0, 300)}z"
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, text(rng.randint(20, 50))) for i in range(5)]
    docs = [text(rng.randint(30, 200)) for _ in range(60)]
    docs += [docs[k % 7] for k in range(10)] + [docs[k] + " " + text(2) for k in range(5)]
    docs += [text(40) + " " + bench[k][1] + "\n" + text(30) for k in range(5)]
    docs += ["one two three " * 40]
    return [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(docs)], bench


def brute(table, bench):
    def base_ok(t):
        w = words(t)
        win = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for k in range(3)}
        return len(w) >= 50 and 100 * len(again) <= 50 * len(w)

    kept = [r for r in table if base_ok(r[1])]
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [words(lower(r[1]))] for k in range(len(w) - 4)} for r in kept}
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    kept = [r for r in kept if find(r[0]) == r[0]]
    kept = [r for r in kept if not any(" ".join(words(b)) in " ".join(words(r[1])) for _, b in bench)]
    return {r[0] for r in kept}


def test_pipeline(spark, tmp_path):
    table, bench = corpus(random.Random(11))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), schema)
        seen.append(docs.count())
    want = brute(table, bench)
    assert {r["doc_id"] for r in docs.collect()} == want and seen[0] > seen[1] > seen[2] == len(want)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()
    sizes, taken = collections.Counter(), collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(words(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(words(r["text"]))
    assert all(n <= 2 * sizes[s] for s, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 400
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r["doc_id"] for r in mixed)
    assert {r["shard"] for r in out} == set(range(corpus_pipeline.SHARDS))


def test_stages_take_an_empty_corpus(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert quality.MAX_DOCS > 1


def test_stages_take_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join(f"{rng.choice('abcdefg')}{rng.randint(0, 999_999)}" for _ in range(n))
    a, b, c, d, leak, other, longest, item = text(80), text(90), text(70), text(100), text(60), text(60), text(60_000), text(30)
    table = [(None, a, None, None, None), (7, b, "en", "s", 1), (7, c, "en", "s", 1), (8, b, "en", "s", 1), (9, None, "en", "s", 1), (10, "", None, None, 1), (None, None, None, None, None), (11, d, "de", None, 0), (11, d, "de", None, 0), (12, longest, "en", "s", 1), (13, f"{leak} {item}", "en", "s", 1), (7, f"{item} {other}", "en", "t", 1)]
    clash = ["mark", "kept", "node", "size", "key", "s", "epochs", "edge", "last", "id", "group", "copies", "value"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(table, schema).withColumns({x: F.lit(x) for x in clash})
    spark.createDataFrame([(1, item), (2, None), (None, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = _common.stage(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        left.append(collections.Counter((r["doc_id"], r["text"]) for r in docs.collect()))
    kept = [(None, a), (7, b), (7, c), (11, d), (12, longest)]
    leaks = [(13, f"{leak} {item}"), (7, f"{item} {other}")]
    assert left[0] == collections.Counter([*kept, *leaks, (8, b), (11, d)])
    assert left[1] == collections.Counter([*kept, *leaks]) and left[2] == collections.Counter(kept)
    mixed = _common.stage(corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)), "t")
    assert mixed.columns == docs.columns
    taken = collections.Counter((r["doc_id"], r["text"]) for r in mixed.collect())
    assert set(taken) <= set(kept) and max(taken.values()) <= 2 and taken == collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect())
    out = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(i for (i, _), n in taken.items() for _ in range(n))
