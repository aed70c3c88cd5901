"""URL filters: a trie over reversed host labels and path segments, broadcast to the executors.

A node per host label, from the top-level domain down; below the node of a rule's host, a node per path segment. The
most host labels win, then the longest path; of an allow and a block entry for the same host and path, block wins.

A list of more than MAX_RULES rules is not broadcast: each url is joined with the rules by its host's suffixes and its
path's leading segments, as many as the rules have, and the same precedence picks among those that fit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.shared import free_name, ship, stored

#: Most rules that are broadcast as a trie, some 200 MB.
MAX_RULES = 500_000

#: Rules of the registered query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lower-cased) and path; both empty if there is none."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    host, slash, path = rest.partition("/")
    return host.translate(UPPER), slash + path


class Trie:
    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.top: dict = {}
        ended: dict[int, dict] = {}
        for verdict, host, path in rules:
            node = self.top
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})
            ended[id(node)] = node
            if ends.get(last, ("", ""))[0] != "block":
                ends[last] = (verdict, host + path)
        for node in ended.values():
            node["lengths"] = sorted({len(last) for last in node["ends"]}, reverse=True)

    @staticmethod
    def _along(node: dict, segments: list[str]) -> tuple[str, str] | None:
        """The longest rule that starts the path, below the node of a host."""
        best = None
        for k, segment in enumerate(segments):
            for n in node.get("lengths", ()):
                if n <= len(segment) and (found := node["ends"].get(segment[:n])):
                    best = found
                    break
            node = node.get(("path", segment)) if k + 1 < len(segments) else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        node, best, segments = self.top, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._along(node, segments) or best
        return best


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (null if none fits), verdict (the rule's, else the default).

    A null url and one without :// have an empty host and path and take the default. An empty table gives no rows, an
    empty list of rules the default everywhere; repeated rows are each judged; other columns are not read. Long urls cost
    in proportion to their length: of a segment only the beginnings are tried that are as long as a rule's.
    """
    rules = list(rules)
    spark = pages.sparkSession
    ship(spark)
    kind = dict(pages.dtypes)[id_col]
    if len(rules) > MAX_RULES:
        return by_join(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), as_table(spark, rules), default)
    trie = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, found, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                best = trie.value.find(host, path)
                hosts.append(host)
                paths.append(path)
                found.append(best[1] if best else None)
                verdicts.append(best[0] if best else default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(id_col, url_col).mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


def as_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, rule_host string, rule_path string")


def by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """url_filter() for rules (verdict, rule_host, rule_path) of any number; pages are (page_id, url)."""
    judged = verdicts(pages.select("url").distinct(), rules, default).withColumnRenamed("url", "judged")
    return pages.join(judged, F.col("url").eqNullSafe(F.col("judged"))).select("page_id", "host", "path", "rule", "verdict")


def verdicts(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """(url, host, path, rule, verdict) of distinct urls."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    url = F.coalesce("url", F.lit(""))
    urls = urls.withColumns({"host": F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), upper, lower), "path": F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)})
    labels, segments = F.split("rule_host", r"\."), F.split("rule_path", "/")
    keyed = rules.withColumns({"labels": F.size(labels), "depth": F.size(segments) - 1}).withColumn("whole", F.array_join(F.slice(segments, 1, F.col("depth")), "/"))
    keyed = stored(keyed, "rules")
    most = keyed.agg(F.max("labels").alias("labels"), F.max("depth").alias("depth")).first()
    host, path = F.split("host", r"\."), F.split("path", "/")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size(host), F.lit(most["labels"]))), lambda k: F.array_join(F.slice(host, -k, k), ".")))
    prefix = F.explode(F.transform(F.sequence(F.lit(0), F.least(F.size(path) - 1, F.lit(most["depth"]))), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(path, 1, k), "/").alias("whole"))))
    tried = urls.withColumn("rule_host", suffix).withColumn("p", prefix).select("url", "path", "rule_host", "p.depth", "p.whole")
    fits = tried.join(keyed, ["rule_host", "depth", "whole"]).where(F.startswith("path", "rule_path"))
    best = fits.groupBy("url").agg(F.max(F.struct("labels", F.length("rule_path").alias("length"), (F.col("verdict") == "block").alias("block"), "verdict", F.concat("rule_host", "rule_path").alias("rule"))).alias("best"))
    return urls.join(best, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """The rows of pages, all columns, whose url is allowed; nulls, repeats and empty tables as in url_filter()."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        urls = pages.select(F.col(url_col).cast("string").alias("url")).distinct()
        name = free_name(pages, "allowed_url")
        judged = verdicts(urls, as_table(pages.sparkSession, rules), "allow").where("verdict = 'allow'").select(F.col("url").alias(name))
        return pages.join(judged, F.col(url_col).eqNullSafe(F.col(name)), "left_semi")
    ship(pages.sparkSession)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("boolean")
    def fits(urls):
        found = urls.map(lambda url: trie.value.find(*split_url(url)))
        return found.map(lambda best: best is None or best[0] == "allow")

    return pages.where(fits(F.col(url_col)))
