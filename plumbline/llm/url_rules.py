"""Operator 6: URL filters by a sort-merge range join.

A host is written label by label from the right with a dot after each, so a rule
for a host and its subdomains covers one interval of the sorted keys. Each task
sorts its own rows and sweeps rows and rules together, keeping a stack of the
active nested rules; under a host, path prefixes form a chain that is searched
from the last path not above the row's. The longest rule (host and path
together, then host) wins. Nothing is shuffled, so a hot host costs nothing.

Rules are shipped in passes of at most ``rules_per_pass``; larger sets take more
passes over the rows' keys, and the better of two passes' rules stays.

Defined results: a null url or one without "://" has an empty host and path and
fits no rule; such rows, and rows that fit none, get ``default``. Repeated rows
are judged each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: verdict, host, path prefix
Rule = tuple[str, str, str]
#: The rules of the registered query.
RULES: list[Rule] = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
RULES_PER_PASS = 200_000


def reversed_host(host: str) -> str:
    return "".join(f"{label}." for label in reversed(host.split("."))) if host else ""


class PathRules:
    """Path prefixes of one host, each with its longest proper prefix among them."""

    def __init__(self, key: str, rules: list[tuple[str, str, str]]):
        self.key = key
        unique = {path: (verdict, rule) for path, verdict, rule in reversed(rules)}  # the first of equal rules counts
        self.paths = sorted(unique)
        self.found = [unique[p] for p in self.paths]
        self.below: list[int] = []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.below.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> tuple[str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.below[i]
        return self.found[i] if i >= 0 else None


def by_host(rules: Sequence[Rule]) -> list[PathRules]:
    """The rules sorted by their hosts' keys."""
    hosts: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in rules:
        host = host.translate({c: c + 32 for c in range(65, 91)})
        hosts.setdefault(reversed_host(host), []).append((path, verdict, host + path))
    return [PathRules(k, hosts[k]) for k in sorted(hosts)]


def sweep(rows: Iterator[tuple[str, str]], hosts: list[PathRules]) -> Iterator[tuple[str, str] | None]:
    """For each (key, path) in ascending order of keys: the (verdict, rule) of the longest rule that fits."""
    stack: list[PathRules] = []
    at = 0
    for key, path in rows:
        while stack and not key.startswith(stack[-1].key):
            stack.pop()
        while at < len(hosts) and hosts[at].key <= key:
            if key.startswith(hosts[at].key):
                stack.append(hosts[at])
            at += 1
        best = None
        for node in reversed(stack):  # the longest host first, so it wins ties
            found = node.longest(path)
            if found and (best is None or len(found[1]) > len(best[1])):
                best = found
        yield best


def with_parts(df: DataFrame, url_col: str) -> DataFrame:
    """Adds _host, _path and the sort key _key."""
    at = F.locate("://", F.col(url_col))
    rest = F.when(at > 0, F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    df = df.withColumn("_rest", F.coalesce(rest, F.lit("")))
    df = df.withColumn("_host", ascii_lower(F.regexp_extract("_rest", "^([^/?#]*)", 1))).withColumn("_path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
    key = F.when(F.col("_host") == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split("_host", r"\.", -1)), "."), F.lit(".")))
    return df.withColumn("_key", key).drop("_rest")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = tuple(RULES), id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_per_pass: int = RULES_PER_PASS) -> DataFrame:
    """Per row: the id, host, path, the rule that fits best (null if none) and the verdict."""
    kind = pages.schema[id_col].dataType.simpleString()
    df = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url").drop("url")
    df = df.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.col("_key").alias("key"))
    df = df.sortWithinPartitions("key", "path")
    for first in range(0, max(1, len(rules)), rules_per_pass):
        part = list(rules[first : first + rules_per_pass])

        def run(frames: Iterator[pd.DataFrame], part: list[Rule] = part) -> Iterator[pd.DataFrame]:
            frame: list[pd.DataFrame] = []

            def rows() -> Iterator[tuple[str, str]]:
                for pdf in frames:
                    frame.append(pdf)
                    yield from zip(pdf["key"], pdf["path"], strict=True)

            found, done = [], 0
            for best in sweep(rows(), by_host(part)):
                found.append(best)
                if len(found) == len(frame[0]):
                    pdf = frame.pop(0)
                    kept = [(old, v) if new is None or (isinstance(old, str) and len(old) >= len(new[1])) else (new[1], new[0]) for new, old, v in zip(found, pdf["rule"], pdf["verdict"], strict=True)]
                    yield pdf.assign(rule=pd.Series([r for r, _ in kept], index=pdf.index, dtype=object), verdict=[v for _, v in kept])
                    found, done = [], done + len(pdf)

        df = df.mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string, key string")
    return df.drop("key")


#: The registered query in DuckDB's SQL.
ORACLE = r"""
with parts as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
rules as (
  select * from (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) t(verdict, host, path)),
fits as (
  select s.page_id, s.host, s.path, max_by(r.host || r.path, length(r.host || r.path)) as rule, max_by(r.verdict, length(r.host || r.path)) as verdict
  from split s left join rules r on (s.host = r.host or suffix(s.host, '.' || r.host)) and prefix(s.path, r.path)
  group by all)
select page_id, coalesce(host, '') as host, coalesce(path, '') as path, rule, coalesce(verdict, 'allow') as verdict from fits
"""
