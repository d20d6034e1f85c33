"""Tables in HTML: rows and sizes as expressions, and tree edit similarity."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_VOID = frozenset(("br", "img", "hr", "input", "col"))


def table_rows(html: Column) -> Column:
    """Each row's cell texts joined by `` | ``; rows without text are left out."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\s+", " "))
    return F.filter(F.transform(rows, lambda r: F.array_join(F.transform(cells(r), plain), " | ")), lambda r: F.regexp_replace(r, "[ |]", "") != "")


def table_size(html: Column) -> Column:
    """struct<n_rows,n_columns>; a row is as wide as its column spans."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    span = lambda t: F.greatest(F.coalesce(F.nullif(F.regexp_extract(t, r'(?i)colspan="?(\d{1,4})', 1), F.lit("")).cast("int"), F.lit(1)), F.lit(1))
    wide = F.transform(rows, lambda r: F.aggregate(F.regexp_extract_all(r, F.lit(r"(?i)<t[dh](?:\s[^>]*)?>"), F.lit(0)), F.lit(0), lambda s, t: s + span(t)))
    return F.struct(F.size(rows).alias("n_rows"), F.coalesce(F.array_max(wide), F.lit(0)).alias("n_columns"))


class _Node:
    __slots__ = ("tag", "spans", "content", "children")

    def __init__(self, tag: str, spans: tuple[int, int] | None) -> None:
        self.tag, self.spans, self.content, self.children = tag, spans, [], []


class _Reader(HTMLParser):
    """The first table right below ``body``, and how many elements it holds."""

    def __init__(self) -> None:
        super().__init__()
        self.path: list[str] = []
        self.open: list[_Node] = []
        self.table: _Node | None = None
        self.done, self.cell_depth, self.count = False, 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if not self.done:
            if self.cell_depth:
                self.count += 1
                self.open[-1].content.append(f"<{tag}>")
                self.cell_depth += tag not in _VOID
            elif self.open or tag == "table" and self.path[-1:] == ["body"]:
                found = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit()}
                node = _Node(tag, (found.get("colspan", 1), found.get("rowspan", 1)) if tag == "td" else None)
                if self.open:
                    self.open[-1].children.append(node)
                    self.count += 1
                else:
                    self.table = node
                if tag not in _VOID:
                    self.open.append(node)
                    self.cell_depth = int(tag == "td")
        if tag not in _VOID:
            self.path.append(tag)

    def handle_data(self, data: str) -> None:
        if self.cell_depth and not self.done:
            self.open[-1].content += data

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.path:
            return
        while self.path:
            last = self.path.pop()
            if self.cell_depth > 1:
                self.open[-1].content.append(f"</{last}>")
                self.cell_depth -= 1
            elif self.open and not self.done:
                self.open.pop()
                self.cell_depth = 0
                self.done = not self.open
            if last == tag:
                return


def _read(html: str | None) -> tuple[_Node | None, int]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.table, reader.count


def _edits(a: list[str], b: list[str]) -> int:
    if a == b:
        return 0
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def _change(a: _Node, b: _Node, texts: bool) -> float:
    if a.tag != b.tag or a.spans != b.spans:
        return 1.0
    longest = max(len(a.content), len(b.content)) if texts and a.tag == "td" else 0
    return _edits(a.content, b.content) / longest if longest else 0.0


def _postorder(root: _Node) -> tuple[list[_Node], list[int], list[int]]:
    """Nodes bottom up, each one's leftmost leaf, and the key roots: the last node of each leftmost leaf."""
    nodes, leaves = [], []

    def walk(node: _Node) -> int:
        first = [walk(c) for c in node.children]
        nodes.append(node)
        leaves.append(first[0] if first else len(nodes) - 1)
        return leaves[-1]

    walk(root)
    return nodes, leaves, sorted({leaf: i for i, leaf in enumerate(leaves)}.values())


def tree_distance(one: _Node, two: _Node, texts: bool = True) -> float:
    """Least cost of making one ordered tree into the other (Zhang and Shasha 1989); adding or removing a node costs 1."""
    (a, la, ka), (b, lb, kb) = _postorder(one), _postorder(two)
    tree = np.zeros((len(a), len(b)))
    for i in ka:
        for j in kb:
            p, q = la[i], lb[j]
            forest = np.zeros((i - p + 2, j - q + 2))
            forest[:, 0], forest[0, :] = np.arange(i - p + 2), np.arange(j - q + 2)
            for x in range(p, i + 1):
                for y in range(q, j + 1):
                    u, v = x - p + 1, y - q + 1
                    shorter = min(forest[u - 1, v], forest[u, v - 1]) + 1
                    if la[x] == p and lb[y] == q:
                        forest[u, v] = tree[x, y] = min(shorter, forest[u - 1, v - 1] + _change(a[x], b[y], texts))
                    else:
                        forest[u, v] = min(shorter, forest[la[x] - p, lb[y] - q] + tree[x, y])
    return float(tree[-1, -1])


def _similarity(predicted: str | None, truth: str | None, texts: bool) -> float:
    (a, n), (b, m) = _read(predicted), _read(truth)
    if a is None or b is None:
        return 0.0
    if predicted == truth or not max(n, m):
        return 1.0
    return 1.0 - tree_distance(a, b, texts) / max(n, m)


def table_similarity(predicted: Column, truth: Column, texts: bool = True) -> Column:
    """1 - tree edit distance over the larger number of elements; 0 where either has no table right below its body.

    With ``texts`` a cell's change costs the normalised edit distance of its characters and inner tags; without,
    the structure alone counts.  Two tables without elements are equal.
    """

    @pandas_udf("double")
    def run(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series([_similarity(x, y, texts) for x, y in zip(one, two, strict=True)], dtype="float64")

    return run(predicted, truth)
