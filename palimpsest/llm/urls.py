"""URL filters: allow and block entries in one trie over reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    found = _URL.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


@dataclass
class _Node:
    hosts: dict[str, "_Node"] = field(default_factory=dict)
    paths: dict[str, "_Node"] = field(default_factory=dict)
    #: Ends of rules within the next segment: (its beginning, rule, verdict), the longest first.
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class UrlTrie:
    """``rules``: (host, path, verdict). A rule fits its host and all subdomains of it, where the url's
    path begins with the rule's. Of the rules that fit, the one with most host labels wins, then the one
    with the longest path; of equal rules, ``block``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _Node()
        for host, path, verdict in sorted(set(rules), key=lambda r: (r[2] != "block", r)):
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.hosts.setdefault(label, _Node())
            *whole, last = path.split("/")
            for segment in whole:
                node = node.paths.setdefault(segment, _Node())
            node.ends.append((last, host + path, verdict))
            node.ends.sort(key=lambda e: -len(e[0]))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.hosts.get(label)
            if node is None:
                break
            found = self._down(node, path) or found
        return found

    @staticmethod
    def _down(node: _Node, path: str) -> tuple[str, str] | None:
        found, segments = None, path.split("/")
        for k, segment in enumerate(segments):
            for begin, rule, verdict in node.ends:
                if segment.startswith(begin):
                    found = (rule, verdict)
                    break
            if k == len(segments) - 1 or segment not in node.paths:
                break
            node = node.paths[segment]
        return found


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rule_bytes: int = 256 << 20) -> DataFrame:
    """``id_col, host, path, rule, verdict`` of each row of ``pages``; other columns are not read.

    A url that no rule fits (also null or empty ones, and those without ``://``) has the verdict
    ``default`` and a null rule. Rows with a null id, and repeated rows, are judged like others.
    The trie is broadcast; a list of more than ``max_rule_bytes`` characters is refused.
    """
    rules = list(rules)
    if sum(len(h) + len(p) for h, p, _ in rules) > max_rule_bytes:
        raise ValueError(f"the rules have more than {max_rule_bytes} characters; raise max_rule_bytes only if the executors can hold them")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = trie.value.match
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [match(h, p) or (None, default) for h, p in parts]
            columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
