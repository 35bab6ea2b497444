"""Operator 1, URL filters: a broadcast trie over reversed host labels, then path segments.

Defined results: a null url, or one without `://`, has an empty host and path and no rule; no matching rule gives
`default`.  Of several matching rules the longest (code points of host and path) wins; equal lengths: the longer
host, then block.  Repeated rows stay repeated; only the id and url columns are read, whatever else there is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: A rule list of more nodes (host labels, path segments and a last part a rule; about 300 bytes each in a Python worker,
#: so 90 MB) isn't broadcast as a trie; it is joined on host suffixes instead.
MOST_TRIE_NODES = 300_000


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    at = min(ends, default=len(rest))
    host = rest[:at].encode().lower().decode()
    tail = rest[at:]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return host, tail[: min(ends, default=len(tail))]


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class Trie:
    """Host labels from the last to the first; under each host, its path's whole segments, then a last part of one."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.root: dict = {}
        for verdict, rule in sorted(rules, key=lambda r: r[0] != "allow"):  # a block entry replaces an equal allow entry
            host, path = split_rule(rule)
            node = self.root
            for label in reversed(host.encode().lower().decode().split(".")) if host else ():
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})  # no label holds a slash: below it are path segments
            *whole, part = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            # the path's last part may end within a segment: parts are kept by their length
            node.setdefault("\0", {}).setdefault(len(part), {})[part] = (verdict, rule)

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        best, key = None, (-1, -1, False)
        node, hosts = self.root, []
        if "/" in node:
            hosts.append((0, node["/"]))
        length = -1
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            length += len(label) + 1
            if "/" in node:
                hosts.append((length, node["/"]))
        segments = path.split("/")
        for n, below in hosts:
            at = 0
            for segment in segments:
                for size, parts in below.get("\0", {}).items():
                    found = parts.get(segment[:size]) if size <= len(segment) else None
                    if found is not None:
                        now = (n + at + size, n, found[0] == "block")
                        if now > key:
                            best, key = found, now
                at += len(segment) + 1
                below = below.get(segment)
                if below is None:
                    break
        return best


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_trie_nodes: int = MOST_TRIE_NODES) -> DataFrame:
    """(id, host, path, rule, verdict) of every row; rules are (allow or block, host and path prefix)."""
    if sum(3 + r.count("/") + r.partition("/")[0].count(".") for _, r in rules) > most_trie_nodes:
        return _filter_by_join(df, rules, id_col, url_col, default)
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                found = trie.value.longest(host, path)
                hosts.append(host)
                paths.append(path)
                names.append(found and found[1])
                verdicts.append(found[0] if found else default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))], names=[id_col, "host", "path", "rule", "verdict"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(url_col)).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


#: The capitals that hosts lose; others, such as Ü, stay as they are.
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _filter_by_join(df: DataFrame, rules: Sequence[tuple[str, str]], id_col: str, url_col: str, default: str) -> DataFrame:
    """The same for rule lists too large to broadcast: distinct urls meet the rules on each suffix of their host."""
    spark = df.sparkSession
    rows = [(*split_rule(r), r, v) for v, r in rules]
    table = spark.createDataFrame(rows, "rule_host string, rule_path string, rule string, verdict string").withColumn("rule_host", F.translate("rule_host", _CAPITALS, _CAPITALS.lower()))
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*", 0), F.lit(""))
    urls = df.select(F.col(url_col).alias("u"), F.translate(host, _CAPITALS, _CAPITALS.lower()).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        urls.distinct().select("u", "path", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))).alias("rule_host"))
        .join(table, "rule_host").where(F.expr("startswith(path, rule_path)"))
        .groupBy("u").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.length("rule_host"), F.col("verdict") == "block")).alias("best"))
    )
    out = df.select(F.col(id_col), F.col(url_col).alias("u")).join(best, "u", "left")
    host_path = [F.coalesce(F.translate(F.regexp_extract(F.expr("if(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '')"), r"^([^/?#]*)([^?#]*)", i), *case), F.lit("")).alias(n) for i, n, case in ((1, "host", (_CAPITALS, _CAPITALS.lower())), (2, "path", ("", "")))]
    return out.select(id_col, *host_path, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'),
         ('block', 'net/fr/', 'net', '/fr/')
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
       (SELECT max_by(rule, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(verdict, length(rule)) FROM rules WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)), 'allow') AS verdict
FROM parts
"""
