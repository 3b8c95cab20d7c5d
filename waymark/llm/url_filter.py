"""URL filter: a trie over reversed host labels, then path segments.

A rule is (action, host, path). It fits its host and every subdomain when the URL's path starts with
the rule's path. The most specific host wins, then the longest path; block wins over allow for the
same entry. URLs without any fitting rule get ``default``.

Defined results: a null URL or one without ``://`` has empty host and path and gets the default; an
empty table gives an empty result; repeated rows are judged one by one; rules that repeat an entry count
once, those that contradict each other block; very long urls are matched whole; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Serialised size up to which a trie is broadcast; larger rule sets are matched by a join.
MAX_TRIE_BYTES = 64 << 20

Rule = tuple[str, str, str]


class UrlTrie:
    """``node`` = [children by host label, path node]; ``path node`` = [children by whole segment,
    entries by the beginning of the next segment]."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: list = [{}, None]
        for action, host, path in rules:
            self.add(action, host, path)

    def add(self, action: str, host: str, path: str) -> None:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        node = self.root
        for label in reversed(host.lower().split(".")):
            node = node[0].setdefault(label, [{}, None])
        if node[1] is None:
            node[1] = [{}, {}]
        at = node[1]
        *whole, begun = path.split("/")
        for segment in whole:
            at = at[0].setdefault(segment, [{}, {}])
        if at[1].get(begun, ("", ""))[0] != "block":
            at[1][begun] = (action, f"{host}{path}")


def _longest_path(at: list, path: str) -> tuple[str, str] | None:
    best = None
    for segment in path.split("/"):
        for size in sorted({len(x) for x in at[1]}, reverse=True):
            if len(segment) >= size and (hit := at[1].get(segment[:size])):
                best = hit
                break
        at = at[0].get(segment)
        if at is None:
            break
    return best


def match(root: list, host: str, path: str) -> tuple[str, str] | None:
    """(action, rule) of the longest fitting rule below a trie's root."""
    best, node = None, root
    for label in reversed(host.split(".")):
        node = node[0].get(label)
        if node is None:
            break
        if node[1] is not None:
            best = _longest_path(node[1], path) or best
    return best


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path; both empty without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumns({"host": C.ascii_lower(part(1)), "path": part(2)})


def _by_trie(pages: DataFrame, trie: UrlTrie) -> DataFrame:
    C.ship_by_value(__name__)
    shared = pages.sparkSession.sparkContext.broadcast(trie.root)  # plain lists: workers need no class of ours

    @F.pandas_udf("action string, rule string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([match(shared.value, h, p) or (None, None) for h, p in zip(host, path)], columns=["action", "rule"])

    return pages.withColumn("hit", judge("host", "path"))


def _by_join(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """For rule sets too large to broadcast: distinct (host, path) pairs meet the rules on host
    suffix and whole leading segments, both sides shuffled."""
    lead = lambda p: F.regexp_extract(p, r"(?s)^(.*/)?", 0)
    best = rules.groupBy(F.lower("rule_host").alias("suffix"), "rule_path").agg(F.max(F.struct("action", "rule_host")).alias("r"))
    best = best.select("suffix", "rule_path", lead(F.col("rule_path")).alias("lead"), F.col("r.action").alias("action"), F.concat(F.col("r.rule_host"), F.col("rule_path")).alias("rule"))
    seen = pages.select("host", "path").distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    leads = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.concat_ws("/", F.slice(parts, 1, i)), F.when(i > 0, "/").otherwise("")))
    asked = seen.select("host", "path", F.explode(suffixes).alias("suffix")).select("*", F.explode(F.array_distinct(leads)).alias("lead"))
    hits = asked.join(best, ["suffix", "lead"]).where(F.startswith("path", "rule_path"))
    won = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("suffix").alias("h"), F.length("rule_path").alias("p"), "action", "rule")).alias("w"))
    won = won.select("host", "path", F.struct(F.col("w.action").alias("action"), F.col("w.rule").alias("rule")).alias("hit"))
    return pages.join(won, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every row.

    ``rules`` is a list of (action, host, path), or a DataFrame (action, rule_host, rule_path) of any size.
    They are broadcast as a trie while that is under MAX_TRIE_BYTES, a DataFrame once its texts are counted
    to be a sixteenth of that at most; larger sets are joined.
    """
    pages = with_host_path(pages.select(id_col, url), url)
    if isinstance(rules, DataFrame):
        size = rules.agg(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 16)).first()[0] or 0
        if size <= MAX_TRIE_BYTES // 16:
            rules = [tuple(r) for r in rules.select("action", "rule_host", "rule_path").collect()]
    if isinstance(rules, list):
        trie = UrlTrie(rules)
        if len(pickle.dumps(trie)) <= MAX_TRIE_BYTES:
            judged = _by_trie(pages, trie)
        else:
            judged = _by_join(pages, pages.sparkSession.createDataFrame(rules, "action string, rule_host string, rule_path string"))
    else:
        judged = _by_join(pages, rules)
    return judged.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.action", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(C.table(spark, sf_dir, "pages"), RULES)


SQL = """
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (SELECT u.page_id, u.host, u.path, r.action, r.h || r.p AS rule,
               row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h) DESC NULLS LAST, length(r.p) DESC) AS k
        FROM u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM hit WHERE k = 1
"""
