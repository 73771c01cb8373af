"""URL filter (operator 6): a trie over reversed host labels, each with a trie over path segments; the longest rule decides, be it allow or block.

A rule fits its host and all subdomains if the url's path starts with the rule's. The longest rule is that with most host labels, and of those with equally many that with the longest path; of two rules
for the same place the block wins. The trie is a broadcast variable of MAX_RULES rules at most; larger rule sets are dealt by host and joined with the urls' host suffixes, with the same results.
Null urls and urls without "://" have empty host and path and fit no rule; such rows, repeated rows and empty tables give one result row per input row. Of a long url each character is looked at once
a stored length. A column named like the result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import spread_join, stage

#: Above this a rule set doesn't go to every executor as one object.
MAX_RULES = 500_000
JUDGED = "host string, path string, rule string, verdict string"

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    cut = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return host.translate(LOWER), slash + path


class Trie:
    """next: host labels from the right; paths: a node over path segments. A path's last segment is a prefix, so it is kept in ends, and lengths are those of the ends, longest first."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            node["paths"] = at = node["paths"] or {"next": {}, "ends": {}, "lengths": []}
            *whole, last = path.split("/")
            for s in whole:
                at = at["next"].setdefault(s, {"next": {}, "ends": {}, "lengths": []})
            if at["ends"].get(last, ("",))[0] != "block":
                at["ends"][last] = (verdict, host.translate(LOWER) + path)
                at["lengths"] = sorted({*at["lengths"], len(last)}, reverse=True)

    @staticmethod
    def longest_path(at: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for s in segments:
            for k in at["lengths"]:
                if k <= len(s) and (hit := at["ends"].get(s[:k])) is not None:
                    best = hit
                    break
            if (at := at["next"].get(s)) is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        if not host:
            return None
        segments, node, best = path.split("/"), self.root, None
        for label in reversed(host.split(".")):
            if (node := node["next"].get(label)) is None:
                break
            if node["paths"] is not None:
                best = self.longest_path(node["paths"], segments) or best
        return best


def judge(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", into: str = "judged") -> DataFrame:
    """Adds a struct (host, path, rule, verdict) under the name into. rules: (verdict, host, path), a table with these columns or an iterable."""
    spark = pages.sparkSession
    if isinstance(rules, DataFrame):
        table = rules.select("verdict", "host", "path")
        listed = [tuple(r) for r in table.limit(MAX_RULES + 1).collect()]
    else:
        listed = list(rules)
        table = None if len(listed) <= MAX_RULES else spark.createDataFrame(listed, "verdict string, host string, path string")
    if len(listed) > MAX_RULES:
        return judge_by_join(pages, table, url, default, into)
    held = spark.sparkContext.broadcast(Trie(listed))

    @F.pandas_udf(JUDGED)
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = held.value
        for urls in batches:
            out = []
            for u in urls:
                host, path = split_url(u)
                hit = trie.find(host, path)
                out.append((host, path, hit[1] if hit else None, hit[0] if hit else default))
            yield pd.DataFrame(out, columns=["host", "path", "rule", "verdict"], dtype=object)

    return pages.withColumn(into, look.asNondeterministic()(F.col(url).cast("string")))


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str, default: str, into: str) -> DataFrame:
    """The same for rule sets of any size: each url's host suffixes meet the rules of that host. Hosts that many urls share, such as a top-level one, aren't dealt to one task."""

    @F.pandas_udf("host string, path string")
    def cut(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_url(u) for u in urls], columns=["host", "path"], dtype=object)

    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = stage(rules.select("verdict", low.alias("suffix"), F.col("path").alias("rule_path")), "url-rules")
    urls = stage(pages.select(F.col(url).cast("string").alias("_u")).distinct().withColumn("_c", cut.asNondeterministic()("_u")).select("_u", "_c.*"), "url-hosts")
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    each = stage(urls.where("host != ''").select("_u", "path", suffix.alias("suffix")), "url-suffixes")
    fits = spread_join(each, known, "suffix", many=True).where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.size(F.split("suffix", r"\.")).alias("n"), F.length("rule_path").alias("k"), (F.col("verdict") == "block").alias("b"), F.concat("suffix", "rule_path").alias("rule"), F.col("verdict").alias("verdict"))
    best = fits.groupBy("_u").agg(F.max(rank).alias("r"))
    found = urls.join(best, "_u", "left").select("_u", F.struct("host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict")).alias("_j"))
    key = lambda c: F.concat(F.when(F.col(c).isNull(), "n").otherwise("u"), F.coalesce(c, F.lit("")))
    rows = pages.withColumn("_k", key(url))
    got = spread_join(rows, stage(found.select(key("_u").alias("_k"), "_j"), "url-judged"), "_k", "left")
    return got.withColumn(into, F.col("_j")).select(*(c for c in pages.columns if c != into), into)
