"""Registered queries of linked boxes, of pixels and quads, and of outlines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import contours, graphs
from quire.plans.queries import _BOXES, page_boxes
from quire.plans.registry import registered

QUERIES, SQL, query = registered()

LEVELS = (0.3, 0.5, 0.7, 0.9)
MOST = 4
_NEAR = 140.0
_LINKS = f"""{_BOXES}, raw AS (SELECT b.page_id, b.box_id * 4 + v.n AS nth, b.box_id AS p, b.box_id + v.d AS q, ((b.x1 * 13 + b.y1 * 7 + v.n * 31) % 100) / 100.0::DOUBLE AS score FROM boxes b, (VALUES (0, 1), (1, 1), (2, 2), (3, 5)) AS v(n, d)),
centres AS (SELECT page_id, box_id AS node, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y FROM boxes),
met AS (SELECT r.page_id, nth, p AS a, q AS b, CASE WHEN sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > {_NEAR} THEN 0.0 ELSE score END AS score FROM raw r JOIN centres a ON a.page_id = r.page_id AND a.node = r.p JOIN centres b ON b.page_id = r.page_id AND b.node = r.q),
links AS MATERIALIZED (SELECT page_id, a, b, list_reduce(list(score::DOUBLE ORDER BY nth), lambda m, x: (m + x) / 2) AS score FROM met GROUP BY page_id, a, b)"""


def _level(i: int) -> str:
    """SQL of the components at a level among what the level before left too large."""
    nodes = "SELECT page_id, node FROM centres" if i == 0 else f"SELECT page_id, node FROM sized{i - 1} WHERE n > {MOST}"
    return f"""left{i} AS MATERIALIZED ({nodes}), both{i} AS MATERIALIZED (SELECT l.page_id, a, b FROM links l SEMI JOIN left{i} x ON x.page_id = l.page_id AND x.node = l.a SEMI JOIN left{i} y ON y.page_id = l.page_id AND y.node = l.b WHERE score >= {LEVELS[i]}),
way{i} AS (SELECT page_id, a AS u, b AS v FROM both{i} UNION ALL SELECT page_id, b, a FROM both{i}),
reach{i}(page_id, node, seen) AS (SELECT page_id, node, node FROM left{i} UNION SELECT r.page_id, r.node, w.v FROM reach{i} r JOIN way{i} w ON w.page_id = r.page_id AND w.u = r.seen),
roots{i} AS MATERIALIZED (SELECT page_id, node, min(seen) AS root FROM reach{i} GROUP BY 1, 2), sized{i} AS MATERIALIZED (SELECT r.*, count(*) OVER (PARTITION BY page_id, root) AS n FROM roots{i} r)"""


_SPLIT = f"{_LINKS}, " + ", ".join(_level(i) for i in range(len(LEVELS))) + ", groups AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT page_id, node, root, {v}::DOUBLE AS level FROM sized{i}" + (f" WHERE n <= {MOST}" if i + 1 < len(LEVELS) else "") for i, v in enumerate(LEVELS)) + ")"


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links with a score each, and nodes with their centres."""
    found = page_boxes(spark, sf_dir)
    steps = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(d).alias("d")) for n, d in ((0, 1), (1, 1), (2, 2), (3, 5))])
    raw = found.select("*", F.explode(steps).alias("s")).select("page_id", (F.col("box_id") * 4 + F.col("s.n")).alias("nth"), F.col("box_id").alias("b"), (F.col("box_id") + F.col("s.d")).alias("a"), (((F.col("x1") * 13 + F.col("y1") * 7 + F.col("s.n") * 31) % 100) / 100).alias("score"))
    centres = found.select("page_id", F.col("box_id").alias("node"), ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    return raw, centres


@query("link_scores", f"WITH {_LINKS} SELECT page_id, a, b, round(score, 9) AS score FROM links")
def link_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.link_scores(*_tables(spark, sf_dir), _NEAR).withColumn("score", F.round("score", 9))


@query("split_groups", f"WITH RECURSIVE {_SPLIT}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY root) - 1 AS label, count(*) OVER (PARTITION BY page_id, root) AS m FROM groups) SELECT page_id, node, root, level, label::INTEGER AS label FROM ranked WHERE m > 1")
def split_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of at most four boxes where links allow, numbered by page, without single boxes."""
    groups = graphs.kept(graphs.linked_groups(*_tables(spark, sf_dir), _NEAR, MOST, LEVELS[0], 0.2, LEVELS[-1]))
    return graphs.without_singles(graphs.numbered(groups)).select("page_id", "node", "root", "level", "label")


@query("group_paths", f"""WITH RECURSIVE {_SPLIT}, ps AS MATERIALIZED (SELECT g.page_id, root, list(c.x ORDER BY g.node) AS xs, list(c.y ORDER BY g.node) AS ys, list(g.node ORDER BY g.node) AS ns FROM groups g JOIN centres c ON c.page_id = g.page_id AND c.node = g.node GROUP BY 1, 2),
walk(page_id, root, done, rest) AS (
  SELECT page_id, root, [1::BIGINT], range(2, len(ns) + 1) FROM ps UNION ALL
  SELECT page_id, root, CASE WHEN f.d <= l.d THEN [-f.i] || done ELSE done || [-l.i] END, list_filter(rest, lambda i: i <> CASE WHEN f.d <= l.d THEN -f.i ELSE -l.i END) FROM (
    SELECT w.page_id, w.root, done, rest, list_sort(list_transform(rest, lambda i: {{'d': (xs[i] - xs[done[1]]) * (xs[i] - xs[done[1]]) + (ys[i] - ys[done[1]]) * (ys[i] - ys[done[1]]), 'i': -i}}))[1] AS f,
      list_sort(list_transform(rest, lambda i: {{'d': (xs[i] - xs[done[len(done)]]) * (xs[i] - xs[done[len(done)]]) + (ys[i] - ys[done[len(done)]]) * (ys[i] - ys[done[len(done)]]), 'i': -i}}))[1] AS l
    FROM walk w JOIN ps p ON p.page_id = w.page_id AND p.root = w.root WHERE len(rest) > 0)),
ends AS (SELECT page_id, root, done FROM walk WHERE len(rest) = 0)
SELECT e.page_id, e.root, ns[done[k]] AS node, (k - 1)::INTEGER AS nth FROM (SELECT *, unnest(range(1, len(done) + 1)) AS k FROM ends) e JOIN ps p ON p.page_id = e.page_id AND p.root = e.root""")
def group_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.linked_groups(*_tables(spark, sf_dir), _NEAR, MOST, LEVELS[0], 0.2, LEVELS[-1], walk=True)


@query("nearest_quads", f"""WITH {_BOXES}, px AS (SELECT page_id, x1 AS x, y1 AS y, (box_id * 7) % 40 - 20 AS dx, (x1 * 3) % 30 - 15 AS dy FROM f WHERE score > 0.2), qs AS (SELECT page_id, box_id AS quad, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM o WHERE box_id % 2 = 0)
SELECT page_id, x, y, quad FROM (SELECT p.rowid_ AS r, p.page_id, x, y, quad, row_number() OVER (PARTITION BY p.page_id, rowid_ ORDER BY (x - dx - cx) * (x - dx - cx) + (y - dy - cy) * (y - dy - cy), quad) AS n FROM (SELECT *, row_number() OVER () AS rowid_ FROM px) p JOIN qs ON qs.page_id = p.page_id) WHERE n = 1""")
def nearest_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_boxes(spark, sf_dir)
    pixels = found.where("kind = 'F'").select("page_id", F.col("x1").alias("x"), F.col("y1").alias("y"), "score", ((F.col("box_id") * 7) % 40 - 20).alias("dx"), ((F.col("x1") * 3) % 30 - 15).alias("dy"))
    corners = F.array(*[F.array(a, b) for a in ("x1", "x2") for b in ("y1", "y2")])
    quads = found.where("kind = 'O' AND box_id % 2 = 0").select("page_id", F.col("box_id").alias("quad"), corners.alias("points"))
    return contours.nearest_quads(pixels, quads, 0.2)


@query("fourier_outlines", """WITH c AS (SELECT vec_id, list_transform(embedding[1:11], lambda v: v::DOUBLE * 100) AS a, list_transform(embedding[12:22], lambda v: v::DOUBLE * 100) AS b FROM embeddings),
t AS (SELECT *, unnest(range(0, 20)) AS t FROM c)
SELECT vec_id, string_agg(x || ',' || y, ';' ORDER BY t) AS outline FROM (SELECT vec_id, t, trunc(list_sum(list_transform(range(1, 12), lambda i: a[i] * cos(2 * pi() / 20 * (((i - 6) * t) % 20 + 20) % 20) - b[i] * sin(2 * pi() / 20 * (((i - 6) * t) % 20 + 20) % 20))))::INTEGER AS x,
  trunc(list_sum(list_transform(range(1, 12), lambda i: a[i] * sin(2 * pi() / 20 * (((i - 6) * t) % 20 + 20) % 20) + b[i] * cos(2 * pi() / 20 * (((i - 6) * t) % 20 + 20) % 20))))::INTEGER AS y FROM t) GROUP BY vec_id""".replace("pi() / 20 * (((i - 6) * t) % 20 + 20) % 20", "pi() / 20 * ((((i - 6) * t) % 20 + 20) % 20)"))
def fourier_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of 20 points from the vectors' first components."""
    hundredfold = lambda at: F.transform(F.slice("embedding", at, 11), lambda v: v.cast("double") * 100)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    outline = contours.fourier_outline(hundredfold(1), hundredfold(12), 20)
    return table.select("vec_id", outline.alias("o")).select("vec_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda t: F.concat(F.get("o", 2 * t).cast("string"), F.lit(","), F.get("o", 2 * t + 1).cast("string"))), ";").alias("outline"))
