"""URL filters: a trie over reversed host labels and path segments; the longest fitting rule decides.

A rule names a host, which stands for all its subdomains, and a path prefix. The trie is keyed by the host's labels
from the last to the first and then by the path's whole segments; a rule whose path ends within a segment hangs at
the segment before, with the beginning it asks for. The trie is built once and broadcast; it is as large as the rules, which
are a parameter and do not grow with the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from spanwise.llm import common

#: Verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path; both empty for null or without '://'."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((k for k in (rest.find("/"), rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    host, path = rest[:end].translate(LOWER), rest[end:]
    for sign in "?#":
        path = path.partition(sign)[0]
    return host, path


class Trie:
    """Nodes are numbers, the root 0. edges: (node, label) to node; rules: node to its rules (beginning of the next segment,
    verdict, rule, host's length). A flat trie can be sent however deep it is."""

    def __init__(self, rules):
        self.edges: dict[tuple[int, str], int] = {}
        self.rules: dict[int, list[tuple[str, str, str, int]]] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host = host.translate(LOWER)
            *whole, last = path.split("/")
            node = 0
            # no label has a slash: after it come segments
            for label in (*(reversed(host.split(".")) if host else ()), "/", *whole):
                node = self.edges.setdefault((node, label), len(self.edges) + 1)
            self.rules.setdefault(node, []).append((last, verdict, host + path, len(host)))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict: of the rules that fit, the one with the longest text; of equals the longer host, then block."""
        best, found = None, (None, None)
        hosts, edge = [0], self.edges.get
        if host:
            for label in reversed(host.split(".")):
                node = edge((hosts[-1], label))
                if node is None:
                    break
                hosts.append(node)
        segments = path.split("/")
        for node in hosts:
            node = edge((node, "/"))
            for segment in segments:
                if node is None:
                    break
                for begins, verdict, rule, n in self.rules.get(node, ()):
                    rank = (len(rule), n, verdict == "block")
                    if segment.startswith(begins) and (best is None or rank > best):
                        best, found = rank, (rule, verdict)
                node = edge((node, segment))
        return found


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every URL's host, path, rule (null if none fits) and verdict (the default if none fits).

    Null URLs and those without '://' have empty host and path, which only rules with an empty host can fit. Repeated
    rows give repeated results; null ids stay null; an empty table gives none; other columns are left out.
    """

    shared = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        trie = shared.value
        for batch in batches:
            split = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [trie.match(*x) for x in split]
            yield {
                id_col: batch.column(0), "host": [h for h, _ in split], "path": [p for _, p in split],
                "rule": [r for r, _ in found], "verdict": [v or default for _, v in found],
            }

    schema = f"`{id_col}` {common.type_of(pages, id_col)}, host string, path string, rule string, verdict string"
    return common.map_batches(pages, [id_col, url_col], run, schema)
