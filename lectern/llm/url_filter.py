"""URL allow and block lists as a trie over reversed host labels, then path segments.

The trie is built from the rules and broadcast to the Python workers, if its rules are at most
BROADCAST_RULES; a longer list is joined instead: every URL is exploded into its possible rule keys,
which are equi-joined with the rules, and the longest match is kept.

A rule is "host" or "host/segment/segment" with an action. It matches that host and its subdomains,
and paths that begin with those whole segments. The longest match wins: more host labels first, then
more path segments; at the very same node an allow entry wins over a block entry. A URL that matches
nothing is allowed.

Defined cases
- Scheme, user info, port, query, fragment, a host's trailing dot and case, and empty path segments
  don't count. The path is compared as it is, in its own case, without percent-decoding.
- A null or empty URL, or one without a host, matches nothing: allowed, matched_rule null.
- Repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
- Rules that normalize to the same entry are one; an entry without a host is an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, tidy

BROADCAST_RULES = 1_000_000

#: The rules of the registered query: spam and advertising hosts are blocked, a few parts of them allowed.
RULES: list[tuple[str, str]] = [
    ("block", "spam-farm.example.com"), ("block", "spam-farm.example.org"), ("block", "spam-farm.example.net"),
    ("block", "casino-win.example.com"), ("block", "casino-win.example.org"), ("block", "casino-win.example.net"),
    ("block", "free-bets.example.com"), ("block", "free-bets.example.org"), ("block", "free-bets.example.net"),
    ("block", "ads-track.example.com"), ("block", "ads-track.example.org"), ("block", "ads-track.example.net"),
    ("block", "cheap-pills.example.com"), ("block", "cheap-pills.example.org"), ("block", "cheap-pills.example.net"),
    ("block", "adult-x.example.com"), ("block", "adult-x.example.org"), ("block", "adult-x.example.net"),
    ("allow", "www.spam-farm.example.com/en"), ("block", "www.spam-farm.example.com/en/7"), ("allow", "m.casino-win.example.com/fr"),
    ("block", "tionsh.example.com/de"), ("allow", "blog.tionsh.example.com"), ("block", "example.org/es"), ("allow", "ththor.example.org/es"),
]


def parse_url(url: str | None) -> tuple[str, list[str]]:
    """(lower-case host or "", path segments)."""
    s = (url or "").strip()
    if "://" in s:
        s = s.split("://", 1)[1]
    elif s.startswith("//"):
        s = s[2:]
    for mark in "?#":
        s = s.split(mark, 1)[0]
    host, _, path = s.partition("/")
    host = host.rpartition("@")[2]
    if host.startswith("["):
        host = host.partition("]")[0] + "]"
    else:
        host = host.partition(":")[0]
    return host.lower().rstrip("."), [p for p in path.split("/") if p]


def build_trie(rules: Iterable[tuple[str, str]]) -> dict:
    root: dict = {}
    for action, entry in rules:
        if action not in ("allow", "block"):
            raise ValueError(f"unknown action {action!r}")
        host, path = parse_url(entry)
        if not host:
            raise ValueError(f"rule {entry!r} has no host")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        for segment in path:
            node = node.setdefault(("/", segment), {})
        name = "/".join([host, *path])
        if node.get(None, ("block",))[0] != "allow":
            node[None] = (action, name)
    return root


def match(trie: dict, url: str | None) -> tuple[str, str] | None:
    """(action, rule) of the longest match."""
    host, path = parse_url(url)
    if not host:
        return None
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        best = node.get(None) or best
        if any(isinstance(k, tuple) for k in node):
            deep = node
            for segment in path:
                deep = deep.get(("/", segment))
                if deep is None:
                    break
                best = deep.get(None) or best
    return best


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(page_id, url, allowed, matched_rule) of every row; the cases are defined above."""
    need(pages, id_col, url_col)
    rules = RULES if rules is None else rules
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    trie = build_trie(rules)
    if len(rules) > broadcast_rules:
        return _joined(rows, rules)
    shared = rows.sparkSession.sparkContext.broadcast(trie)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            found = [match(tree, u) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f is None or f[0] == "allow" for f in found], pa.bool_()), pa.array([f and f[1] for f in found], pa.string())],
                ["page_id", "url", "allowed", "matched_rule"],
            )

    kind = dict(rows.dtypes)["page_id"]
    return rows.mapInArrow(tidy(decide), f"page_id {kind}, url string, allowed boolean, matched_rule string")


def _joined(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The same by an equi-join with the rules, for lists too long to broadcast."""
    named = {}
    for action, entry in rules:
        host, path = parse_url(entry)
        name = "/".join([host, *path])
        if named.get(name) != "allow":
            named[name] = action
    table = rows.sparkSession.createDataFrame([(n, a, len(n.split("/")[0].split(".")), n.count("/")) for n, a in named.items()], "rule string, action string, labels int, segments int")

    @F.pandas_udf("array<string>")
    def keys(urls):
        def of(u):
            host, path = parse_url(u)
            labels = host.split(".") if host else []
            return ["/".join([".".join(labels[k:]), *path[:j]]) for k in range(len(labels)) for j in range(len(path) + 1)]

        return urls.map(of)

    distinct = rows.select("url").where("url is not null").distinct()
    hits = distinct.withColumn("rule", F.explode(keys("url"))).join(table, "rule")
    w = Window.partitionBy("url").orderBy(F.desc("labels"), F.desc("segments"))
    best = hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("url", "action", F.col("rule").alias("matched_rule"))
    return rows.join(best, "url", "left").select("page_id", "url", F.coalesce(F.col("action") == "allow", F.lit(True)).alias("allowed"), "matched_rule")


def url_sql() -> str:
    """DuckDB SQL for url_filter over pages with RULES."""
    values = ", ".join(f"('{a}', '{e}')" for a, e in RULES)
    return rf"""
WITH r AS (SELECT column0 AS action, column1 AS rule, split_part(column1, '/', 1) AS rh,
        CASE WHEN position('/' IN column1) > 0 THEN substr(column1, position('/' IN column1)) ELSE '' END AS rp FROM (VALUES {values}) v(column0, column1)),
p AS (SELECT row_number() OVER () AS rid, page_id, url,
        rtrim(lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
        regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, '/' || trim(regexp_replace(path, '/+', '/', 'g'), '/') || '/' AS np FROM p),
m AS (SELECT q.rid, r.rule, r.action, row_number() OVER (PARTITION BY q.rid ORDER BY length(rh) - length(replace(rh, '.', '')) DESC,
        length(rp) - length(replace(rp, '/', '')) DESC) AS k
      FROM q JOIN r ON (q.host = r.rh OR ends_with(q.host, '.' || r.rh)) AND (r.rp = '' OR starts_with(q.np, r.rp || '/')))
SELECT q.page_id, q.url, coalesce(m.action = 'allow', true) AS allowed, m.rule AS matched_rule FROM q LEFT JOIN m ON q.rid = m.rid AND m.k = 1
"""
