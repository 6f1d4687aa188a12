"""URL filter: allow and block entries in a trie over reversed host labels and path, the longest match decides.

An entry names a host with all its subdomains and a path prefix. Among the entries that fit a URL the one with more host
labels wins, then the one with the longer path; of two equal entries block wins. A URL that no entry fits gets the
``default`` verdict (allow, since the entries list what is known to be bad and its exceptions).

The trie is broadcast to one scan of the urls. Its size is proven first: up to ``TRIE_CHARS`` characters of rules.
Longer lists are looked up by a hash join on (host suffix, path prefix) instead, with the same result.

Defined results: a null URL and one without ``://`` have an empty host and path and fit no entry; the host keeps a port
or user name, as the contract reads it; repeated rows give repeated rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of rules up to which the trie is broadcast (a few hundred bytes of memory each at most).
TRIE_CHARS = 2_000_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A to Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Host labels from the last to the first, then the path in segments; the last segment of an entry is a prefix."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment + "/", {})
            ends = node.setdefault("", {})
            by_length = ends.setdefault(len(last), {})
            if by_length.get(last, ("", "allow"))[1] == "allow":
                by_length[last] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(entry, verdict) of the longest entry that fits."""
        node, best = self.root, None
        for label in reversed(host.split(".")):
            node = node.get(label) if label != "/" else None
            if node is None:
                break
            best = self._path(node.get("/"), path) or best
        return best

    def _path(self, node: dict | None, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            if node is None:
                break
            # only lengths at which an entry of this node ends are tried, the longest first
            for n, ends in sorted(node.get("", {}).items(), reverse=True):
                if n <= len(segment) and segment[:n] in ends:
                    best = ends[segment[:n]]
                    break
            node = node.get(segment + "/") if i < len(segments) - 1 else None
        return best


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """``urls(url, ...)`` with ``host``, ``path``, ``rule`` (host and path of the entry, or null) and ``verdict``.

    ``rules`` are (host, path, "allow" or "block"). Columns of these names in ``urls`` are replaced.
    """
    if sum(len(h) + len(p) for h, p, _ in rules) > TRIE_CHARS:
        return judge_by_join(urls, urls.sparkSession.createDataFrame(rules, "host string, path string, verdict string"), default)
    spark = urls.sparkSession
    trie = spark.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def look(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in parts:
            found = [trie.value.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"])

    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = parts.withColumn("_found", look("host", "path"))
    return parts.withColumns({"rule": F.col("_found.rule"), "verdict": F.col("_found.verdict")}).drop("_found")


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for any number of rules: distinct (host, path) pairs meet the rules in a hash join.

    A pair is looked up under each suffix of its host, the rules of a host are tried by prefix.
    """
    parts = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = parts.select("host", "path").distinct().withColumn("_suffix", F.explode(suffix))
    r = rules.select(F.col("host").alias("_suffix"), F.col("path").alias("_prefix"), F.col("verdict").alias("_verdict")).distinct()
    fit = asked.join(r, "_suffix").filter(F.startswith("path", F.col("_prefix")))
    order = F.struct(F.size(F.split("_suffix", "\\.")), F.length("_prefix"), F.col("_verdict") == "block")
    best = fit.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("_suffix", "_prefix").alias("rule"), F.col("_verdict").alias("verdict")), order).alias("_best"))
    best = best.withColumnsRenamed({"host": "_host", "path": "_path"})
    out = parts.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce("_best.verdict", F.lit(default))}).drop("_host", "_path", "_best")
