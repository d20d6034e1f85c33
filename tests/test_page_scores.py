"""Polygon areas against a fine raster; page scores against plain versions over random pages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import page_scores, polygons
from quire.operators.polygons import Shape


def _raster(shapes, n=700):
    """The shared area by points: a point is inside where a line from it crosses the sides an odd number of times."""
    ys, xs = np.meshgrid((np.arange(n) + 0.5) / n * 10, (np.arange(n) + 0.5) / n * 10, indexing="ij")
    out = np.ones(xs.shape, bool)
    for p in shapes:
        inside = np.zeros(xs.shape, bool)
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
            if y1 != y2:
                inside ^= ((y1 > ys) != (y2 > ys)) & (xs < x1 + (ys - y1) / (y2 - y1) * (x2 - x1))
        out &= inside
    return out.sum() * (10 / n) ** 2


def test_areas_of_any_polygons():
    rng = np.random.default_rng(0)
    for _ in range(25):
        a, b = (rng.uniform(0, 10, (rng.integers(3, 9), 2)) for _ in range(2))
        assert abs(polygons.shared_area(a, b) - _raster([a, b])) < 0.25
        assert abs(polygons.enclosed_area(a) - _raster([a])) < 0.25
        assert abs(polygons.shared_area(a, b) - polygons.shared_area(b[::-1], a)) < 1e-9


def test_concave_polygons():
    comb = np.array([(0, 0), (7, 0), (7, 5), (6, 5), (6, 1), (4, 1), (4, 5), (3, 5), (3, 1), (1, 1), (1, 5), (0, 5)], float)
    bar = np.array([(0, 3), (7, 3), (7, 4), (0, 4)], float)
    assert polygons.enclosed_area(comb) == 19 and polygons.shared_area(comb, bar) == 3 and polygons.shared_area(comb, comb) == 19
    assert polygons.overlap(comb, bar) == 3 / 23 and Shape(bar).corners is not None and Shape(comb).corners is None
    assert polygons.shared_area(bar, bar + 100) == 0 and polygons.shared_area(bar, bar + np.array([0, 1])) == 0


def test_simple_polygons():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert polygons.simple(square) and polygons.simple(np.array([(0, 0), (1, 0), (2, 0), (2, 2), (0, 2)], float))
    for bad in ([(0, 0), (2, 2), (2, 0), (0, 2)], [(0, 0), (2, 0), (1, 0)], [(0, 0), (2, 0), (2, 2), (2, 3), (2, 1), (0, 2)], [(0, 0), (4, 0), (2, 0), (0, 2)], [(0, 0), (0, 0), (1, 1)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]):
        assert not polygons.simple(np.array(bad, float))


def test_hulls():
    assert sorted(map(tuple, polygons.hull(np.array([(0, 0), (2, 2), (2, 0), (0, 2), (1, 1)], float)))) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert len(polygons.hull(np.array([(0, 0), (1, 1), (2, 2)], float))) < 3


def plain_deteval(true, got):
    """true, got: [(box, text)] of rectangles; as the rules say, one pair after another."""
    area = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    both = lambda a, b: max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    out = [b for b, t in true if not t]
    true, got = [x for x in true if x[1]], [x for x in got if all(both(x[0], o) / (area(x[0]) + 1) <= 0.5 for o in out)]
    n, m = len(true), len(got)
    c = [[np.round(both(g[0], d[0]) / area(g[0]), 2) for d in got] for g in true]
    p = [[np.round(both(g[0], d[0]) / area(d[0]), 2) for d in got] for g in true]
    free_t, free_d = [True] * n, [True] * m
    r = pr = hits = 0.0
    same = lambda i, j: true[i][1].lower() == got[j][1].strip().lower()
    for i in range(n):
        cs, ps = [j for j in range(m) if c[i][j] > 0.7], [j for j in range(m) if p[i][j] > 0.6]
        if len(cs) == 1 and len(ps) == 1 and sum(c[k][cs[0]] > 0.7 for k in range(n)) == 1 and sum(p[k][ps[0]] > 0.6 for k in range(n)) == 1:
            r, pr, hits = r + 1, pr + 1, hits + same(i, cs[0])
            free_t[i] = free_d[cs[0]] = False
    for i in range(n):
        if not free_t[i] or sum(x > 0 for x in c[i]) < 2:
            continue
        parts = [j for j in range(m) if p[i][j] >= 0.6 and free_d[j]]
        worth = (1.0 if c[i][parts[0]] >= 0.7 else 0) if len(parts) == 1 else (0.8 if sum(c[i][j] for j in parts) >= 0.7 else 0)
        if worth:
            free_t[i] = False
            for j in parts:
                free_d[j] = False
            r, pr, hits = r + worth, pr + len(parts) * worth, hits + same(i, parts[0])
    for j in range(m):
        if not free_d[j] or sum(p[i][j] > 0 for i in range(n)) < 2:
            continue
        parts = [i for i in range(n) if c[i][j] >= 0.6 and free_t[i]]
        worth = (1.0 if p[parts[0]][j] >= 0.6 and c[parts[0]][j] >= 0.7 else 0) if len(parts) == 1 else (0.8 if sum(p[i][j] for i in parts) >= 0.6 else 0)
        if worth:
            free_d[j] = False
            for i in parts:
                free_t[i] = False
            r, pr, hits = r + len(parts) * worth, pr + worth, hits + any(same(i, j) for i in parts)
    return n, m, round(r, 6), round(pr, 6), int(hits)


def _rows(spark, pages, which):
    rows = [(p, k, [float(v) for v in (b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3])], t) for p, sides in pages.items() for k, (b, t) in enumerate(sides[which])]
    return spark.createDataFrame(rows, "page_id int, box_id int, polygon array<double>, text string")


def _pages(seed, n):
    rng = random.Random(seed)
    words = ["ab", "AB", "b ", "", "Ｘy"]

    def page():
        true = [((x := rng.randint(0, 60)), (y := rng.randint(0, 30)), x + rng.randint(4, 30), y + rng.randint(4, 10)) for _ in range(rng.randint(0, 6))]
        got = []
        for x1, y1, x2, y2 in true:
            mid = (x1 + x2) // 2
            got += rng.choice([[], [(x1, y1, x2, y2)], [(x1 + 1, y1, x2 + 1, y2 + 1)], [(x1, y1, mid, y2), (mid, y1, x2, y2)], [(x1, y1, x2 + 25, y2)]])
        return [(b, rng.choice(words)) for b in true], [(b, rng.choice(words)) for b in got]

    return {p: page() for p in range(n)}


def test_deteval(spark):
    pages = _pages(3, 200)
    got = {r.page_id: (r.truths, r.detections, round(r.recalled, 6), round(r.precise, 6), r.hits) for r in page_scores.deteval_counts(_rows(spark, pages, 0), _rows(spark, pages, 1)).collect()}
    for p, (true, found) in pages.items():
        if true or found:
            assert got[p] == plain_deteval(true, found), p
    total = page_scores.deteval_scores(page_scores.deteval_counts(_rows(spark, pages, 0), _rows(spark, pages, 1))).first()
    assert (total.truths, total.hits) == (sum(v[0] for v in got.values()), sum(v[4] for v in got.values()))
    empty = _rows(spark, pages, 0).limit(0)
    none = page_scores.deteval_scores(page_scores.deteval_counts(empty, empty)).first()
    assert (none.recall, none.f_score, none.sequence_error) == (0, 0, 1)
    parts = page_scores.deteval_counts(_rows(spark, pages, 0), _rows(spark, pages, 1), whole=False)
    assert parts.agg(F.sum("hits").alias("h")).first().h == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_end_to_end(spark):
    pages = _pages(4, 150)
    truth, found = _rows(spark, pages, 0).withColumn("ignored", F.col("box_id") % 4 == 3), _rows(spark, pages, 1)
    got = {r.page_id: (r.hits, r.truths, r.detections, r.edits, r.letters) for r in page_scores.end_to_end_counts(truth, found, blanks=False).collect()}
    plain = lambda t: "".join(chr(ord(c) - 65248) if 65281 <= ord(c) <= 65374 else c for c in t).replace(" ", "")
    for p, (true, seen) in pages.items():
        if not true:
            assert p not in got
            continue
        iou = lambda a, b: (lambda i: i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i))(max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1])))
        met, t_used, f_used = sorted((-iou(a, b), i, j) for i, (a, _) in enumerate(true) for j, (b, _) in enumerate(seen) if iou(a, b) >= 0.5), set(), set()
        hits = truths = edits = letters = 0
        count = len(seen)
        for _, i, j in met:
            if i in t_used or j in f_used:
                continue
            t_used.add(i)
            f_used.add(j)
            if i % 4 == 3:
                count -= 1
                continue
            a, b = plain(true[i][1]), plain(seen[j][1])
            hits, truths, edits, letters = hits + (a == b), truths + 1, edits + plain_distance(a, b), letters + len(a)
        rest = [len(t) for i, (_, t) in enumerate(true) if i not in t_used and i % 4 != 3]
        edits += sum(rest) + sum(len(t) for j, (_, t) in enumerate(seen) if j not in f_used)
        assert got[p] == (hits, truths + len(rest), count, edits, letters + sum(rest)), p
    total = page_scores.end_to_end_scores(page_scores.end_to_end_counts(truth, found), 150).first()
    assert 0 < total.precision < 1 and 0 < total.f_score < 1 and total.edits_per_page == total.edits / 150


def test_labels_count(spark):
    box = lambda x: [float(v) for v in (x, 0, x + 10, 0, x + 10, 10, x, 10)]
    schema = "page_id int, box_id int, polygon array<double>, text string, label string"
    truth = spark.createDataFrame([(1, 0, box(0), "A b", "q"), (1, 1, box(20), "c", "Answer"), (1, 2, box(40), "d", "other"), (2, 0, box(0), "z", "q")], schema)
    found = spark.createDataFrame([(1, 0, box(1), "a b", "Q"), (1, 1, box(20), "c", "question"), (1, 2, box(40), "d", "OTHERS"), (1, 3, box(90), None, "q")], schema)
    use = lambda **how: tuple(page_scores.labelled_counts(truth, found, **how).first())[1:]
    assert use() == (0, 2, 3, 1, 4) and use(case=False) == (0, 2, 3, 0, 4) and use(labels=False) == (1, 2, 3, 1, 4) and use(background=True) == (1, 3, 4, 1, 5)
    assert page_scores.labelled_counts(truth, found).count() == 1


def test_polygon_counts(spark):
    """Polygons that cross themselves, ignored ones and what lies in them do not count; concave ones do."""
    schema = "page_id int, box_id int, polygon array<double>, ignored boolean"
    hook = [0.0, 0.0, 10.0, 0.0, 10.0, 2.0, 2.0, 2.0, 2.0, 10.0, 0.0, 10.0]
    bow = [20.0, 20.0, 30.0, 30.0, 30.0, 20.0, 20.0, 30.0]
    square = lambda x: [float(v) for v in (x, 50, x + 10, 50, x + 10, 60, x, 60)]
    truth = spark.createDataFrame([(1, 0, hook, None), (1, 1, bow, False), (1, 2, square(0), True), (1, 3, square(40), False)], schema)
    found = spark.createDataFrame([(1, 0, hook, None), (1, 1, bow, None), (1, 2, square(1), None), (1, 3, square(41), None), (1, 4, square(42), None)], schema)
    assert tuple(page_scores.polygon_counts(truth, found).first()) == (1, 2, 2, 3)


def test_pages_are_scored_together(monkeypatch):
    """Several pages are one batch, and upright rectangles are measured in flat arrays, without a shape for each."""
    monkeypatch.setattr(polygons, "Shape", None)
    box = lambda x: [float(v) for v in (x, 0, x + 10, 0, x + 10, 10, x, 10)]
    kind = pa.list_(pa.struct([("k", pa.int64()), ("p", pa.list_(pa.float64()))]))
    side = lambda pages: page_scores.Side(pa.array([[{"k": k, "p": box(x)} for k, x in enumerate(p)] for p in pages], kind))
    one, two = page_scores._pairs(side([[0, 20], [], [0, 3]]), side([[20, 1], [5], [2]]), 0.5)
    assert set(zip(one, two, strict=True)) == {(1, 0), (0, 1), (3, 3)}
    assert page_scores._split_and_merged(2, 1, [(0, 0, 1.0, 0.5), (1, 0, 1.0, 0.5)]) == (1.6, 0.8, [([0, 1], [0])])
