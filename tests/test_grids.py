"""Spanned tables against plain versions: places, full grids, round trips, records; blanks and odd markup."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import grids
from quire.operators.records import html_tokens


def _html(rng, rows):
    cell = lambda: "<td" + rng.choice(["", "", ' colspan="2"', ' rowspan="2"', ' rowspan="3" colspan="2"']) + f">{rng.choice(['a', 'b c', '', 'x&amp;y', '<b>q</b>'])}</td>"
    return "<table>" + "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 4))) + "</tr>" for _ in range(rows)) + "</table>"


def plain_grid(rows):
    """rows: [[(text, rowspan, colspan)]]; what spans down comes where the columns before it are filled."""
    out, rest = [], []
    for cells in [*rows, None]:
        while True:
            line, after, waiting = [], [], list(rest)
            for text, high, wide in cells or ():
                while waiting and waiting[0][0] <= len(line):
                    c, t, n = waiting.pop(0)
                    line.append(t)
                    after += [(c, t, n - 1)] * (n > 1)
                for _ in range(wide):
                    after += [(len(line), text, high - 1)] * (high > 1)
                    line.append(text)
            line += [t for _, t, _ in waiting]
            rest = after + [(c, t, n - 1) for c, t, n in waiting if n > 1]
            out += [line] if line else []
            if cells is not None or not rest:
                break
    return out


def _of(spark, texts, use):
    table = spark.createDataFrame(list(enumerate(texts)), "i int, html string")
    return {r.i: r.x for r in table.select("i", grids.cells(F.col("html")).alias("rows")).select("i", use(F.col("rows")).alias("x")).collect()}


def test_grids(spark):
    rng = random.Random(3)
    texts = [_html(rng, rng.randint(0, 4)) for _ in range(300)]
    cells = _of(spark, texts, lambda r: r)
    for i, got in _of(spark, texts, grids.grid).items():
        assert got == plain_grid([[(c.text, c.rowspan, c.colspan) for c in row] for row in cells[i]]), texts[i]


def test_grids_as_pandas_reads_them(spark):
    pytest.importorskip("lxml")
    texts = ['<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>', "<table><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"]
    for i, got in _of(spark, texts, lambda r: grids.squared(grids.grid(r))).items():
        assert got == pd.read_html(texts[i], header=None)[0].fillna("").astype(str).values.tolist()


def test_places_and_round_trip(spark):
    """A full table's structure comes back from its places; cells never share a place."""
    rng = random.Random(4)

    def full():
        """A grid cut into spans by merging free rectangles."""
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        owner = [[None] * m for _ in range(n)]
        rows = []
        for i in range(n):
            line = []
            for j in range(m):
                if owner[i][j]:
                    continue
                w, h = rng.choice([1, 1, 2]), rng.choice([1, 1, 2])
                w = max(k for k in range(1, min(w, m - j) + 1) if all(owner[i][j + x] is None for x in range(k)))
                h = min(h, n - i)
                for x in range(i, i + h):
                    for y in range(j, j + w):
                        owner[x][y] = True
                line.append("<td" + (f' colspan="{w}"' if w > 1 else "") + (f' rowspan="{h}"' if h > 1 else "") + "></td>")
            rows.append("<tr>" + "".join(line) + "</tr>")
        return "<tbody>" + "".join(rows) + "</tbody>"

    texts = [full() for _ in range(150)]
    for i, got in _of(spark, texts, lambda r: F.array_join(grids.structure(grids.placements(r)), "")).items():
        assert got == texts[i]
    for placed in _of(spark, texts, grids.placements).values():
        seen = [(x, y) for p in placed for x in range(p.row, p.row + p.rowspan) for y in range(p.col, p.col + p.colspan)]
        assert len(seen) == len(set(seen))
    same = spark.createDataFrame([(t,) for t in texts], "t string").select(F.array_join(html_tokens(F.col("t"), True), "").alias("a"), "t").collect()
    assert all(r.a == r.t for r in same)


def test_blank_and_odd_tables(spark):
    texts = [None, "", "<table></table>", "<tr></tr>", '<tr><td rowspan="2">a</td></tr>', "<TR><TH COLSPAN='2'>&lt;b&gt;</TH></TR>", '<tr><td colspan="0">a</td><td>b</td></tr>', "<tr><td>k：v</td><td></td><td>p</td></tr>"]
    got = _of(spark, texts, grids.grid)
    assert [got[i] for i in range(8)] == [[], [], [], [], [["a"], ["a"]], [["<b>", "<b>"]], [["b"]], [["k：v", "", "p"]]]
    assert _of(spark, texts, lambda r: F.array_join(grids.structure(grids.placements(r)), ""))[4] == '<tbody><tr><td rowspan="2"></td></tr><tr></tr></tbody>'
    found = _of(spark, texts, lambda r: grids.pairs(grids.squared(grids.grid(r))))
    assert [(p.key, p.value) for p in found[7]] == [("k", "v")] and found[0] == [] and [(p.key, p.value) for p in found[5]] == [("<b>", "<b>")]
