"""URL allow and block rules (operator 10): a trie over reversed host labels, with a
trie over path segments at each host, broadcast to the tasks that read the urls.

A rule has a host and a path.  It fits its host and all subdomains when the url's path
starts with the rule's.  Of the fitting rules the longest wins, counted over host and path
together (of equally long ones that with the longer host); a rule listed as both allow and
block blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import with_fields

# The trie is broadcast: more rule text than this is refused.
MAX_RULE_CHARS = 64_000_000
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Iterable[tuple[str, str]]) -> list[Rule]:
    """(action, 'host/path') pairs to rules; a text without '/' has an empty path.  A-Z in
    hosts are lower-cased, as in the urls' hosts."""
    out = []
    for action, text in lines:
        host, slash, path = text.partition("/")
        out.append(Rule(action, host.translate(_LOWER), slash + path))
    return out


class Trie:
    """Host nodes: ``next`` by label (from the last label on), ``paths`` = path node.
    Path nodes: ``next`` by whole segment, ``ends`` = {start of a segment: rule}."""

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {"next": {}, "paths": None}
        for r in rules:
            if r.action not in ("allow", "block"):
                raise ValueError(f"unknown action {r.action!r}")
            node = self.root
            for label in reversed(r.host.split(".")) if r.host else ():
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}}
            node = node["paths"]
            *whole, last = r.path.split("/")
            for segment in whole:
                node = node["next"].setdefault(segment, {"next": {}, "ends": {}})
            old = node["ends"].get(last)
            if old is None or r.action == "block":
                node["ends"][last] = (r.name, r.action)

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule text, action) of the longest fitting rule, or (None, None)."""
        segments = path.split("/")
        node, found = self.root, self._path(self.root, segments)
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            here = self._path(node, segments)
            if here and (found is None or len(here[0]) >= len(found[0])):
                found = here
        return found or (None, None)

    @staticmethod
    def _path(host_node: dict, segments: list[str]):
        node, found = host_node["paths"], None
        for i, segment in enumerate(segments):
            if node is None:
                break
            ends = node["ends"]
            if ends:
                # a rule's last segment is a start of the url's segment
                found = next((ends[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in ends), found)
            node = node["next"].get(segment) if i + 1 < len(segments) else None
        return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if null or without '://'."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules: Iterable[Rule], default: str = "allow", url_col: str = "url",
          prefix: str = "") -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict (the rule's, else ``default``).

    All rows stay, repeated ones too; a null url, or one without '://', has an empty
    host and path.  Other columns pass through; a column that already has one of the
    four names is replaced (or pass ``prefix``).  An empty table gives an empty result, no
    rules give ``default`` everywhere.
    """
    names = [prefix + n for n in ("host", "path", "rule", "verdict")]
    df, schema = with_fields(df, url_col, **{n: T.StringType() for n in names})
    rules = list(rules)
    if sum(len(r.name) for r in rules) > MAX_RULE_CHARS:
        raise ValueError("too many rules to broadcast")
    trie = df.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for b in batches:
            n = b.num_columns
            found = [find(h, p) for h, p in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f[0] for f in found], type=pa.string()),
                 pa.array([f[1] or default for f in found], type=pa.string())], names=[*b.schema.names, *names[2:]])

    host, path = host_and_path(F.col(url_col))
    return df.withColumns({names[0]: host, names[1]: path}).mapInArrow(run, schema)
