"""Table repair and the composed matcher against plain versions over random tables."""

import math
import random
import re

from pyspark.sql import functions as F

from quire.functions import table_tokens
from quire.functions.geometry import Box
from quire.operators import table_matching

SPANS = (r' rowspan="\d+" colspan="\d+"', r' colspan="\d+" rowspan="\d+"', r' rowspan="\d+"', r' colspan="\d+"')


def plain_head(html):
    found = re.search("<thead>(.*?)</thead>", html)
    if not found:
        return html
    head = found[0]
    spanned = re.findall("|".join(f"<td{s}>" for s in SPANS), head)
    if not spanned:
        out = head.replace("<td>", "<td><b>").replace("</td>", "</b></td>").replace("<b><b>", "<b>").replace("</b></b>", "</b>")
    else:
        out = head
        for s in set(spanned):
            out = out.replace(s, s + "<b>")
        out = re.sub("(</b>)+", "</b>", re.sub("(<b>)+", "<b>", out.replace("</td>", "</b></td>"))).replace("<td>", "<td><b>").replace("<b><b>", "<b>")
    out = out.replace("<td><b></b></td>", "<td></td>")
    for cell in re.findall("|".join([*[f"<td{s}>.+?</td>" for s in SPANS], "<td>.*?</td>"]), out):
        if cell.count("<b>") > 1 or cell.count("</b>") > 1:
            out = out.replace(cell, cell.replace("<b>", "").replace("</b>", "").replace("<td>", "<td><b>").replace("</td>", "</b></td>"))
    for lone in re.findall("|".join(f"<td></td>{s}></b></td>" for s in SPANS), out):
        out = out.replace(lone, lone.replace("<td></td>", "<td").replace("></b></td>", "></td>"))
    return html.replace(head, out)


def test_heads(spark):
    rng = random.Random(2)
    parts = ["<td>", "</td>", "<b>", "</b>", "a", " ", "<td></td>", '<td colspan="2">', '<td rowspan="3" colspan="12">', '<td></td> rowspan="2"></b></td>', '<td></td> colspan="1" rowspan="2"></b></td>', "<td><b>x</b> <b>y</b></td>", "</tr><tr>", " ", "\n"]
    texts = ["", "<thead></thead>", "<tbody></tbody>"] + ["<thead><tr>" + "".join(rng.choices(parts, k=rng.randint(0, 12))) + "</tr></thead><tbody><td>" + rng.choice(parts) + rng.choice(["", "<thead><td>q</td></thead>"]) for _ in range(1500)]
    got = {r.i: r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", table_tokens.bold_heads(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_head(t), t
    assert spark.createDataFrame([(None,)], "t string").select(table_tokens.bold_heads(F.col("t")).alias("x")).first().x is None


def plain_match(boxes, cells):
    """boxes: [(id, box)], cells: [box] without empty ones; pairs by rule, and the sizes of new rows."""
    centre = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
    inside = lambda b, c: c[0] <= centre(b)[0] <= c[2] and c[1] <= centre(b)[1] <= c[3]

    def hull(b, c):
        points = sorted({(x, y) for r in (b, c) for x in (r[0], r[2]) for y in (r[1], r[3])})
        half = lambda ps: [*_chain(ps)]
        ring = half(points)[:-1] + half(points[::-1])[:-1]
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))) / 2

    def _chain(ps):
        out = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    pairs = [(i, j, 1) for i, b in boxes for j, c in enumerate(cells) if inside(b, c)]
    left = [(i, b) for i, b in boxes if i not in {p[0] for p in pairs}]
    for i, b in left:
        shares = [max(0, min(b[2], c[2]) - max(b[0], c[0])) * max(0, min(b[3], c[3]) - max(b[1], c[1])) / hull(b, c) if hull(b, c) else 0 for c in cells]
        if shares and max(shares) > 0:
            pairs.append((i, shares.index(max(shares)), 2))
    left = [(i, b) for i, b in boxes if i not in {p[0] for p in pairs}]
    free = [j for j in range(len(cells)) if j not in {p[1] for p in pairs}]
    for j in free if left else ():
        pairs.append((min(left, key=lambda x: (math.dist(centre(x[1]), centre(cells[j])), x[0]))[0], j, 3))
    left = [(i, *centre(b)) for i, b in boxes if i not in {p[0] for p in pairs}]
    rows = []
    for x in left:
        for r in rows:
            if abs(r[0][2] - x[2]) < 3:
                r.append(x)
                break
        else:
            rows.append([x])
    rows = sorted([sorted(r, key=lambda x: x[1]) for r in rows], key=lambda r: r[0][2])
    pairs += [(i, len(cells) + n, 4) for n, (i, *_) in enumerate(x for r in rows for x in r)]
    return sorted(pairs), [len(r) for r in rows]


def _page(rng):
    box = lambda w: (lambda x, y: (x, y, x + rng.randint(1, w), y + rng.randint(1, 12)))(rng.randint(0, 90), rng.randint(0, 90))
    return [(i, box(12)) for i in range(rng.randint(0, 14))], [(0, 0, 0, 0) if rng.random() < 0.1 else box(25) for _ in range(rng.choice([0, 1, 4, 8]))]


def test_matches(spark):
    rng = random.Random(5)
    pages = {p: _page(rng) for p in range(150)}
    boxes = spark.createDataFrame([(p, i, *b, f"t{i}") for p, (found, _) in pages.items() for i, b in found], "page_id int, box_id long, x1 int, y1 int, x2 int, y2 int, text string")
    cells = spark.createDataFrame([(p, j, *c) for p, (_, made) in pages.items() for j, c in enumerate(made)], "page_id int, box_id long, x1 int, y1 int, x2 int, y2 int")
    got = {}
    for r in table_matching.matches(boxes, cells).collect():
        got.setdefault(r.page_id, []).append((r.box_id, r.cell_id, r.rule))
    for p, (found, made) in pages.items():
        assert sorted(got.get(p, [])) == plain_match(found, [c for c in made if sum(c)])[0]
    assert table_matching.matches(boxes.limit(0), cells).count() == 0


def test_tables(spark):
    """A cut table grows rows for boxes that no cell takes; one with its end does not; cells without text go."""
    boxes = spark.createDataFrame([(1, 0, 1, 1, 3, 3, "a"), (1, 1, 50, 50, 52, 52, "b"), (1, 2, 60, 50, 62, 52, "<b>c</b>"), (1, 3, 40, 80, 42, 82, None), (2, 0, 1, 1, 3, 3, "a"), (2, 1, 2, 2, 4, 4, "x")], "page_id int, box_id long, x1 int, y1 int, x2 int, y2 int, text string")
    cells = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (2, 0, 0, 0, 10, 10), (2, 1, 100, 100, 110, 110)], "page_id int, box_id long, x1 int, y1 int, x2 int, y2 int")
    tokens = spark.createDataFrame([(1, ["<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>", "<tbody>", "<eb></eb>"]), (2, ["<tbody>", "<tr>", "<td></td>", "<td></td>", "</tr>", "</tbody>"]), (3, ["<tbody>", "<td></td>"])], "page_id int, tokens array<string>")
    got = {r.page_id: r.html[len("<html><body><table>") : -len("</table></body></html>")] for r in table_matching.tables(boxes, cells, tokens).collect()}
    assert got[1] == '<thead><tr><td colspan="2"><b>a</b></td></tr></thead><tbody><td></td><tr><td>b</td><td><b>c</b></td></tr><tr><td></td></tr></tbody>'
    assert got[2] == "<tbody><tr><td>a x</td></tr></tbody>" and got[3] == "<tbody></tr></tbody>"


def test_hull(spark):
    rows = spark.createDataFrame([(0, 0, 2, 2, 1, 1, 3, 3), (0, 0, 4, 4, 1, 1, 2, 2), (0, 0, 1, 1, 2, 0, 3, 1), (0, 2, 1, 3, 2, 0, 3, 1)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    assert [r.h for r in rows.select(Box.of("a_").hull_area(Box.of("b_")).alias("h")).collect()] == [8.0, 16.0, 3.0, 5.0]


def test_parts_are_spread(spark, sf_dir):
    """A small file of parts is a task for each core at least, in every query over them."""
    from quire.plans import grids, labels, structures

    for rows in (labels.names, labels.id_rows, grids.spanned, structures.tables):
        assert rows(spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_are_dealt_by_their_rows(spark, sf_dir, monkeypatch):
    """More rows are more tasks, not larger ones: pairs of a page's boxes and cells are sorted in memory."""
    from quire.plans import registry, tables

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in ("table_rules", "matched_tables"):
        whole = sorted(tables.QUERIES[name](spark, sf_dir).collect(), key=str)
        with monkeypatch.context() as m:
            m.setattr(registry, "TASK_ROWS", 500)
            dealt = tables.QUERIES[name](spark, sf_dir)
            assert dealt.rdd.getNumPartitions() >= rows / 500 > spark.sparkContext.defaultParallelism
            assert sorted(dealt.collect(), key=str) == whole
