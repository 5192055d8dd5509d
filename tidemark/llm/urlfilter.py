"""URL filters (operator 1): a trie over reversed host labels, then path segments.

A rule names a host and the beginning of a path; it fits its host and every subdomain. A url walks down the trie from the
last label of its host to the first. Each node on the way may hold a trie of path segments; there a rule's last, perhaps
unfinished, segment is compared as a prefix. The longest rule wins: more host labels first, then the longer path; a block
and an allow entry for one host and path give block. Without a rule the verdict is the default.

The trie is broadcast; it is built on the driver, in time that grows with the rules, from a list that MAX_RULES and
MAX_CHARACTERS bound (larger lists are refused).

Defined cases: a null url, or one without "://", has an empty host and path and gets the default verdict; a rule with an
empty host fits only such urls' empty host and is refused; hosts compare as they stand after A-Z are lower-cased, ports
and user names included; urls of any length are read whole; columns named like an added one are replaced; empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField

from .common import replacing, table, with_arrays

ALLOW, BLOCK = "allow", "block"
MAX_RULES, MAX_CHARACTERS = 2_000_000, 100_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass
class PathNode:
    below: dict[str, PathNode] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)  # beginning of the next segment -> (rule, verdict)
    lengths: dict[int, int] = field(default_factory=dict)  # of those beginnings -> how many
    _longest_first: list[int] | None = None

    def add(self, segments: list[str], rule: str, verdict: str) -> None:
        node = self
        for s in segments[:-1]:
            node = node.below.setdefault(s, PathNode())
        last = segments[-1]
        if last not in node.ends:
            node.lengths[len(last)] = node.lengths.get(len(last), 0) + 1
            node._longest_first = None
        if last not in node.ends or verdict == BLOCK:
            node.ends[last] = (rule, verdict)

    def longest_first(self) -> list[int]:
        if self._longest_first is None:
            self._longest_first = sorted(self.lengths, reverse=True)
        return self._longest_first

    def longest(self, segments: list[str]) -> tuple[str, str] | None:
        found, node = None, self
        for s in segments:
            for n in node.longest_first():
                if (hit := node.ends.get(s[:n])) is not None and n <= len(s):
                    found = hit
                    break
            if (node := node.below.get(s)) is None:
                break
        return found


@dataclass
class HostNode:
    below: dict[str, HostNode] = field(default_factory=dict)
    paths: PathNode | None = None


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path), both empty for null and for what has no "://"."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    if slash < 0:
        return rest[:end].translate(LOWER), ""
    return rest[:slash].translate(LOWER), rest[slash:end]


class UrlTrie:
    def __init__(self, rules: Iterable[tuple[str, str]], default: str = ALLOW):
        """rules: (verdict, host/path), like ("block", "com/en/")."""
        self.root, self.default, count, characters = HostNode(), default, 0, 0
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            if verdict not in (ALLOW, BLOCK) or not host:
                raise ValueError(f"not a rule: {verdict} {rule}")
            count, characters = count + 1, characters + len(rule)
            if count > MAX_RULES or characters > MAX_CHARACTERS:
                raise ValueError(f"more than {MAX_RULES} rules or {MAX_CHARACTERS} characters")
            node = self.root
            for label in reversed(host.translate(LOWER).split(".")):
                node = node.below.setdefault(label, HostNode())
            node.paths = node.paths or PathNode()
            node.paths.add((slash + path).split("/"), rule, verdict)

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """(rule that decides or None, verdict)."""
        found, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            if (node := node.below.get(label)) is None:
                break
            if node.paths is not None and (hit := node.paths.longest(segments)) is not None:
                found = hit
        return found or (None, self.default)


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """pages with host, path, rule and verdict."""
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules, default))
    added = ("host", "path", "rule", "verdict")
    pages = replacing(pages, *added)
    where = pages.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(where).to_pylist()]
            found = [trie.value.judge(*p) for p in parts]
            yield batch, [pa.array([x[k] for x in rows], pa.string()) for rows in (parts, found) for k in (0, 1)]

    return with_arrays(pages, run, [StructField(c, StringType()) for c in added])


# ---------------------------------------------------------------- query
RULES = [(BLOCK, "com/en/"), (ALLOW, "example.com/en/7"), (ALLOW, "net/de/"), (BLOCK, "example.net/de/8"), (BLOCK, "org/es/")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    found = judge_urls(table(spark, sf_dir, "pages").select("page_id", F.col("url")), RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = rf"""
WITH r(verdict, host, path) AS (VALUES {", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}')" for v, r in RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
m AS (SELECT h.rid, r.host || r.path AS rule, verdict,
             row_number() OVER (PARTITION BY h.rid ORDER BY length(r.host) - length(replace(r.host, '.', '')) DESC, length(r.path) DESC) AS n
      FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN (SELECT * FROM m WHERE n = 1) USING (rid)"""
