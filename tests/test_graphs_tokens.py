"""Token chunks and relations, linked boxes, paths, quads and outlines against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import contours, graphs, token_chunks

SEGMENTS = "doc int, nth int, id long, label string, ids array<int>"


def test_chunks_and_relations(spark):
    rng = random.Random(1)
    docs = {d: [(n, n * 3 + d, rng.choice(["question", "Answer", "OTHER", "header", None]), [rng.randint(0, 99) for _ in range(rng.randint(0, 6))]) for n in range(rng.randint(0, 9))] for d in range(60)}
    links = {d: [(rng.choice(s)[1], rng.choice([*s, (0, 999)])[1]) for _ in range(8)] if (s := docs[d]) else [] for d in docs}
    table = spark.createDataFrame([(d, *s[:2], *s[2:]) for d, rows in docs.items() for s in rows], SEGMENTS)
    pairs = spark.createDataFrame([(d, a, b) for d, ls in links.items() for a, b in ls] + [(0, None, 1)], "doc int, a long, b long")
    whole = token_chunks.with_relations(token_chunks.sequences(table, "doc", "nth", "id", "label", "ids"), pairs, "doc", "a", "b")
    got = {(r.doc, r.chunk): r for r in token_chunks.chunks(whole, 7, "doc", empty=True).collect()}
    for d, rows in docs.items():
        ids, entities, place = [], [], {}
        for _, key, label, tokens in rows:
            if tokens and (label or "other").upper() not in ("OTHER", "OTHERS", "IGNORE"):
                place[key] = len(entities)
                entities.append((key, len(ids), len(ids) + len(tokens), label.upper()))
            ids += tokens
        relations = set()
        for a, b in links[d]:
            ends = [entities[place[x]] for x in (a, b) if x in place]
            if len(ends) == 2 and {ends[0][3], ends[1][3]} == {"QUESTION", "ANSWER"}:
                head, tail = sorted(ends, key=lambda e: e[3] != "QUESTION")
                relations.add((place[head[0]], place[tail[0]], min(head[1], tail[1]), max(head[2], tail[2])))
        for chunk, at in enumerate(range(0, len(ids), 7)):
            own = [i for i, e in enumerate(entities) if at <= e[1] < at + 7 and at <= e[2] < at + 7]
            r = got.pop((d, chunk))
            assert r.ids == ids[at : at + 7]
            assert [tuple(e) for e in r.entities] == [(entities[i][0], entities[i][1] - at, entities[i][2] - at, entities[i][3]) for i in own]
            assert [tuple(x) for x in r.relations] == [(own.index(h), own.index(t), s - at, e - at) for h, t, s, e in sorted(relations) if at <= s < at + 7 and at <= e < at + 7]
    assert not got
    assert token_chunks.chunks(whole, 7, "doc").where(F.size("entities") == 0).count() == 0


def plain_components(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    """Chains, stars, rings, single nodes, loops and repeated links, on several pages."""
    rng = random.Random(2)
    pages = {0: [(i, i + 1) for i in range(40)], 1: [(0, i) for i in range(1, 30)], 2: [(i, (i + 1) % 12) for i in range(12)] * 2, 3: [], 4: [(5, 5)], 5: [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]}
    links = spark.createDataFrame([(p, a, b) for p, ls in pages.items() for a, b in ls] + [(1, None, 3)], "page_id int, a int, b int")
    nodes = spark.createDataFrame([(p, n) for p in pages for n in range(61)], "page_id int, node int")
    got = {}
    for r in graphs.components(links, nodes).collect():
        got.setdefault(r.page_id, {})[r.node] = r.root
    for p, ls in pages.items():
        assert got[p] == plain_components(ls, range(61))


def test_large_groups_are_cut(spark):
    rng = random.Random(3)
    scored = {(a, b): round(rng.random(), 2) for a in range(25) for b in rng.sample(range(25), 2) if a < b}
    links = spark.createDataFrame([(0, a, b, s) for (a, b), s in scored.items()], "page_id int, a int, b int, score double")
    nodes = spark.createDataFrame([(0, n) for n in range(25)], "page_id int, node int")
    want, left, level = {}, set(range(25)), 0.2
    while left:
        found = plain_components([e for e, s in scored.items() if s >= level and left.issuperset(e)], left)
        last = round(level + 0.2, 9) > 1.0
        sizes = {r: sum(x == r for x in found.values()) for r in found.values()}
        small = {n: r for n, r in found.items() if last or sizes[r] <= 3}
        want |= {n: (r, level) for n, r in small.items()}
        left, level = left - set(small), round(level + 0.2, 9)
    cut = graphs.split_components(links, nodes, 3, 0.2, 0.2)
    assert {r.node: (r.root, r.level) for r in cut.collect()} == want
    kept = {r.node for r in graphs.without_singles(cut).collect()}
    assert kept == {n for n, (r, _) in want.items() if sum(x[0] == r for x in want.values()) > 1}
    labels = {r.root: r.label for r in graphs.numbered(cut).collect()}
    assert labels == {r: i for i, r in enumerate(sorted({r for r, _ in want.values()}))}


def test_link_scores(spark):
    links = spark.createDataFrame([(0, 1, 7, 3, 0.8), (0, 2, 3, 7, 0.4), (0, 3, 7, 3, 0.2), (0, 4, 3, 9, 0.9), (0, 5, 3, 99, 1.0)], "page_id int, nth int, a int, b int, score double")
    centres = spark.createDataFrame([(0, 3, 0.0, 0.0), (0, 7, 30.0, 40.0), (0, 9, 30.0, 41.0)], "page_id int, node int, x double, y double")
    assert {(r.a, r.b): round(r.score, 9) for r in graphs.link_scores(links, centres).collect()} == {(3, 7): 0.4, (3, 9): 0.0}


@pytest.mark.parametrize("points, want", [([(0, 0)], [0]), ([(0, 0), (10, 0), (1, 0)], [1, 2, 0]), ([(5, 0), (0, 0), (11, 0), (6, 0)], [2, 3, 0, 1]), ([(0, 0), (1, 0), (-1, 0)], [2, 0, 1])])
def test_paths(points, want):
    assert graphs.path(np.array(points, float)) == want


def test_paths_of_groups(spark):
    rng = np.random.default_rng(5)
    spots = [(g, n, *rng.integers(0, 40, 2).tolist()) for g in range(12) for n in range(rng.integers(1, 9))]
    groups = spark.createDataFrame([(0, g, g * 100 + n) for g, n, _, _ in spots], "page_id int, root int, node int")
    centres = spark.createDataFrame([(0, g * 100 + n, x, y) for g, n, x, y in spots], "page_id int, node int, x int, y int")
    got = {}
    for r in graphs.paths(groups, centres).orderBy("root", "nth").collect():
        got.setdefault(r.root, []).append(r.node - r.root * 100)
    for g in range(12):
        own = np.array([(x, y) for h, _, x, y in spots if h == g], float)
        assert got[g] == graphs.path(own) and sorted(got[g]) == list(range(len(own)))


def test_quads_take_pixels(spark):
    pixels = spark.createDataFrame([(0, 1, 1, 0.9, 0, 0), (0, 9, 9, 0.9, 8, 8), (0, 5, 5, 0.1, 0, 0), (0, 5, 5, 0.6, 0, 0), (1, 0, 0, 1.0, 0, 0)], "page_id int, x int, y int, score double, dx int, dy int")
    quads = spark.createDataFrame([(0, 7, [[0, 0], [2, 0], [2, 2], [0, 2]]), (0, 8, [[8, 8], [10, 8], [10, 10], [8, 10]]), (0, 9, None)], "page_id int, quad int, points array<array<int>>")
    assert sorted((r.x, r.y, r.quad) for r in contours.nearest_quads(pixels, quads, 0.5).collect()) == [(1, 1, 7), (5, 5, 7), (9, 9, 7)]


def test_outlines(spark):
    rng = np.random.default_rng(6)
    rows = [(rng.normal(0, 30, 2 * k + 1).tolist(), rng.normal(0, 30, 2 * k + 1).tolist()) for k in (0, 1, 5, 5)]
    got = [r.o for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(contours.fourier_outline(F.col("a"), F.col("b"), 20).alias("o")).collect()]
    for (a, b), outline in zip(rows, got, strict=True):
        k = len(a) // 2
        points = [sum(complex(a[i], b[i]) * np.exp(2j * math.pi * (i - k) * t / 20) for i in range(2 * k + 1)) for t in range(20)]
        assert outline == [int(v) for p in points for v in (p.real, p.imag)]
    assert spark.createDataFrame([([], [])], "a array<double>, b array<double>").select(contours.fourier_outline(F.col("a"), F.col("b")).alias("o")).first().o is None


@pytest.mark.parametrize("page_rows", [1 << 18, 40])
def test_pages_are_cut_in_one_pass(spark, monkeypatch, page_rows):
    """Small pages start no rounds of joins, however many levels there are; large ones give the same groups by joins."""
    rng = random.Random(11)
    links = {(p, *sorted(rng.sample(range(20), 2))): round(rng.random(), 2) for p in range(12) for _ in range(3 + 3 * p)}
    table = spark.createDataFrame([(p, a, b, s) for (p, a, b), s in links.items()] + [(0, None, 1, 1.0), (1, 3, 99, 1.0), (2, 4, 4, None)], "page_id int, a int, b int, score double")
    nodes = spark.createDataFrame([(p, n) for p in range(12) for n in range(20)], "page_id int, node int").repartition(3)
    if page_rows > 40:
        monkeypatch.setattr(graphs, "components", None)
    got = {(r.page_id, r.node): (r.root, round(r.level, 9)) for r in graphs.split_components(table, nodes, 3, 0.2, 0.2, 0.9, page_rows=page_rows).collect()}
    for p in range(12):
        left, level = set(range(20)), 0.2
        while left:
            found = plain_components([(a, b) for (q, a, b), s in links.items() if q == p and s >= level and {a, b} <= left], left)
            for n in sorted(left):
                if list(found.values()).count(found[n]) <= 3 or round(level + 0.2, 9) > 0.9:
                    assert got.pop((p, n)) == (found[n], level)
                    left.discard(n)
            level = round(level + 0.2, 9)
    assert not got


def test_short_paths_need_no_arrays(monkeypatch):
    """Small groups go the same way as with arrays, ties included."""
    rng = random.Random(12)
    shapes = [[(rng.randint(0, 3) / 2, rng.randint(0, 3) / 2) for _ in range(n)] for n in (1, 2, 3, 4, 9, 16) for _ in range(20)]
    want = [graphs._long_path(np.array(s)) for s in shapes]
    monkeypatch.setattr(graphs, "_long_path", None)
    assert [graphs.path(s) for s in shapes] == want


def test_linked_groups_need_no_rounds(spark, monkeypatch):
    """Scores, groups and paths of whole pages: the same as step by step, by joins too, and pages dealt already stay whole."""
    rng = random.Random(13)
    raw = [(p, n, rng.randint(0, 19), rng.randint(0, 22), rng.choice([round(rng.random(), 2)] * 9 + [None])) for p in range(14) for n in range(9 * p)] + [(1, 500, None, None, 1.0), (2, None, 3, 4, 0.5), (None, 0, 1, 2, 1.0)]
    spots = [(p, n, rng.randint(0, 9) * 20.0, rng.randint(0, 9) * 20.0) for p in range(14) for n in range(20)]
    links = spark.createDataFrame(raw, "page_id int, nth int, a long, b int, score double").repartition(5, "page_id")
    centres = spark.createDataFrame(spots, "page_id int, node int, x double, y double").repartition(3, "page_id")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    scores = graphs._scores_by_joins(links, centres, 90.0, "page_id", "nth")
    cut = graphs.split_components(scores, centres, 3, 0.2, 0.2, 0.9)
    want = [rows(df) for df in (scores, cut, graphs.paths(cut, centres))]
    for page_rows in (60, 1 << 18):
        if page_rows > 60:
            monkeypatch.setattr(graphs, "_scores_by_joins", None)
            monkeypatch.setattr(graphs, "kept", None)
        assert rows(graphs.link_scores(links, centres, 90.0, page_rows=page_rows)) == want[0]
        for walk in (False, True):
            assert rows(graphs.linked_groups(links, centres, 90.0, 3, 0.2, 0.2, 0.9, walk, page_rows=page_rows)) == want[1 + walk]


def test_paths_of_one_size_are_walked_together():
    rng = np.random.default_rng(14)
    for size in (2, 3, 4, 9):
        x, y = rng.integers(0, 4, (2, 30, size)) / 2
        assert graphs._orders(x, y).tolist() == [graphs.path(list(zip(a, b))) for a, b in zip(x.tolist(), y.tolist())]
