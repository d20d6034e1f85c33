"""Suppression and merging over pages taken together, and rounding as SQL does it."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import polygons
from quire.plans.registry import rounded


def test_rounding_next_to_halves(spark):
    """455.75624999999997 times ten thousand is a half, though its digits are below one."""
    rng = random.Random(1)
    values = [455.75624999999997, 0.5, 1.00005, -2.00015, *(float(np.nextafter(rng.randrange(1, 10**7) / 16, 0)) for _ in range(300)), *((2 * rng.randrange(10**6) + 1) / 20000 for _ in range(300))]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"), 4).alias("v")).collect()]
    assert got[0] == 455.7563 and got == [duckdb.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchall()[0][0] for v in values]


def _polygon(rng):
    x, y, w, h = rng.randint(0, 20), rng.randint(0, 20), rng.randint(1, 15), rng.randint(1, 15)
    kinds = ([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], [(x, y), (x, y + h), (x + w, y + h), (x + w, y)], [(x, y), (x + w, y + 1), (x + w + 2, y + h), (x, y + h + 1)], [(x, y), (x + w, y), (x + w, y + h), (x + w / 2, y + h / 2), (x, y + h)])
    return np.array(rng.choice(kinds), float)


def _plain(shapes, scores, most):
    kept = []
    for i in sorted(range(len(scores)), key=lambda i: (scores[i], i), reverse=True):
        if all(polygons.overlap(shapes[i], shapes[k]) <= most for k in kept):
            kept.append(i)
    return kept


def _plain_merged(shapes, scores, most):
    out = []
    for g, s in zip(shapes, scores, strict=True):
        if out and len(out[-1][0]) == len(g) and polygons.overlap(g, out[-1][0]) > most:
            p, t = out[-1]
            out[-1] = ((s * g + t * p) / (s + t), s + t)
        else:
            out.append((g, s))
    return [p for p, _ in out], [s for _, s in out]


def test_pages_together(spark, monkeypatch):
    """Rectangles in either direction, slanted and concave polygons; upright ones alone make no shape of their own."""
    rng = random.Random(2)
    pages = {p: ([_polygon(rng) for _ in range(n)], [rng.choice([0.1, 0.5, 0.7, 0.9]) for _ in range(n)]) for p in range(60) for n in [rng.randint(1, 9)]}
    rows = spark.createDataFrame([(p, k, s.reshape(-1).tolist(), v) for p, (shapes, scores) in pages.items() for k, (s, v) in enumerate(zip(shapes, scores, strict=True))], "page_id int, box_id long, polygon array<double>, score double")
    got, joined = ({(r.page_id, r.box_id): r for r in use(rows, 0.1).collect()} for use in (polygons.suppressed, polygons.merged_and_suppressed))
    assert set(got) == {(p, k) for p, (shapes, scores) in pages.items() for k in _plain(shapes, scores, 0.1)}
    want = {}
    for p, (shapes, scores) in pages.items():
        whole, sums = _plain_merged(shapes, scores, 0.1)
        want |= {(p, k + 1): (whole[k].reshape(-1).tolist(), sums[k]) for k in _plain(whole, sums, 0.1)}
    assert set(joined) == set(want)
    assert all(joined[k].polygon == pytest.approx(p) and joined[k].score == pytest.approx(s) for k, (p, s) in want.items())
    monkeypatch.setattr(polygons, "Shape", None)
    upright = [np.array([(x, 0), (x + 4, 0), (x + 4, 4), (x, 4)], float) for x in (0, 1, 9)]
    assert polygons.standard(upright, np.array([0.5, 0.7, 0.6]), 0.3) == [1, 2]
    assert [len(p) for p in polygons.merged(upright, np.array([1.0, 1.0, 1.0]), 0.3)] == [2, 2]
