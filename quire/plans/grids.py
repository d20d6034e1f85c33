"""Registered queries of spanned tables, over tables written from the parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import grids
from quire.plans.registry import registered, spread

QUERIES, SQL, query = registered()

#: Tables of three or four rows: spans to the right, downwards and both, side by side and below one another, short rows, entities.
_TOP = """CASE k % 6 WHEN 0 THEN '<td rowspan="2">' || name || '：</td><td>x  y</td><td colspan="2">&amp;z</td>' WHEN 1 THEN '<td colspan="3">' || name || '</td><td rowspan="3">b</td>' WHEN 2 THEN '<th>地址：' || name || '</th><th></th><th>c</th><th>d</th>'
 WHEN 3 THEN '<td rowspan="3" colspan="2">' || name || '</td><td>e</td><td rowspan="2">f</td>' WHEN 4 THEN '<td rowspan=''2''>g</td><td rowspan="2">h</td><td> <b>' || name || '</b> </td><td>i</td>' ELSE '<td>' || name || '</td><td>j</td>' END"""
_NEXT = """CASE k % 4 WHEN 0 THEN '<td>m</td><td>n</td>' WHEN 1 THEN CASE k % 6 WHEN 3 THEN '<td>o</td>' ELSE '<td colspan="2">o</td><td rowspan="2">p</td>' END WHEN 2 THEN '<td>q</td>' ELSE '<td rowspan="2">r</td><td>s</td>' END"""
_HTML = f"""'<table><tr>' || {_TOP} || '</tr><tr>' || {_NEXT} || '</tr><tr>' || CASE k % 5 WHEN 0 THEN '<td>t</td>' WHEN 1 THEN '<td>u</td><td>v</td><td>w</td>' WHEN 2 THEN '<td colspan="2">y</td>' ELSE '<td>电话</td><td>' || brand || '</td>' END || '</tr>' || CASE k % 3 WHEN 0 THEN '<tr><td>' || brand || '</td><td>2</td></tr>' ELSE '' END || '</table>'"""

_CELLS = f"""tabs AS MATERIALIZED (SELECT p_partkey AS id, {_HTML.replace('k %', 'p_partkey %').replace('name', 'p_name').replace('brand', 'p_brand')} AS html FROM part),
trs AS (SELECT id, i - 1 AS r, x[i] AS tr FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM (SELECT id, regexp_extract_all(html, '(?s)<tr>(.*?)</tr>', 1) AS x FROM tabs))),
tds AS (SELECT id, r, i, y[i] AS td FROM (SELECT *, unnest(range(1, len(y) + 1)) AS i FROM (SELECT id, r, regexp_extract_all(tr, '(?s)<t[dh][^>]*>.*?</t[dh]>') AS y FROM trs))),
cells AS MATERIALIZED (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY r, i) AS n, r, coalesce(try_cast(regexp_extract(td, 'rowspan=.(\\d+)', 1) AS INTEGER), 1) AS rs, coalesce(try_cast(regexp_extract(td, 'colspan=.(\\d+)', 1) AS INTEGER), 1) AS cs,
    trim(regexp_replace(replace(regexp_replace(td, '<[^>]*>', '', 'g'), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM tds),
walk(id, n, r, col, placed) AS (
  SELECT DISTINCT id, 0::BIGINT, -1::BIGINT, 0::BIGINT, CAST([] AS STRUCT(r BIGINT, c BIGINT, rs BIGINT, cs BIGINT, t VARCHAR)[]) FROM cells UNION ALL
  SELECT id, n, r, spot + cs, placed || [{{'r': r, 'c': spot, 'rs': rs::BIGINT, 'cs': cs::BIGINT, 't': text}}] FROM (
    SELECT id, n, r, rs, cs, text, placed, list_min(list_filter([start] || list_transform(held, lambda p: p.c + p.cs), lambda x: x >= start AND len(list_filter(held, lambda p: p.c <= x AND x < p.c + p.cs)) = 0)) AS spot FROM (
      SELECT c.id, c.n, c.r, c.rs, c.cs, c.text, w.placed, CASE WHEN c.r = w.r THEN w.col ELSE 0 END AS start, list_filter(w.placed, lambda p: p.r < c.r AND c.r < p.r + p.rs) AS held FROM walk w JOIN cells c ON c.id = w.id AND c.n = w.n + 1))),
placed AS MATERIALIZED (SELECT id, p.r AS r, p.c AS c, p.rs AS rs, p.cs AS cs, p.t AS t FROM (SELECT id, unnest(arg_max(placed, n)) AS p FROM walk GROUP BY id)),
spots AS MATERIALIZED (SELECT id, i, j FROM (SELECT id, unnest(range(0, max(r + rs))) AS i, max(c + cs) AS w FROM placed GROUP BY id), LATERAL (SELECT unnest(range(0, w)) AS j)),
grid AS MATERIALIZED (SELECT s.id, i, j, p.t, p.r, p.c, p.rs, p.cs FROM spots s LEFT JOIN placed p ON p.id = s.id AND p.r <= i AND i < p.r + p.rs AND p.c <= j AND j < p.c + p.cs)"""


def spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, html)."""
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).selectExpr("p_partkey AS k", "p_name AS name", "p_brand AS brand")
    return rows.select(F.col("k").alias("id"), F.expr(_HTML.replace("''2''", "\\'2\\'")).alias("html"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanned(spark, sf_dir).select("id", grids.cells(F.col("html")).alias("rows"))


@query("placed_cells", f"WITH RECURSIVE {_CELLS} SELECT id, r::INTEGER AS row, c::INTEGER AS col, rs::INTEGER AS rowspan, cs::INTEGER AS colspan, t AS text FROM placed")
def placed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", F.inline(grids.placements(F.col("rows"))))


@query("table_grids", f"""WITH RECURSIVE {_CELLS} SELECT id, string_agg(line, chr(10) ORDER BY i) AS grid FROM (SELECT id, i, string_agg(t, '|' ORDER BY j) AS line FROM grid WHERE t IS NOT NULL GROUP BY id, i) GROUP BY id""")
def table_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(grids.grid(F.col("rows")), lambda r: F.array_join(r, "|"))
    return _rows(spark, sf_dir).select("id", F.array_join(lines, "\n").alias("grid"))


@query("grid_tokens", f"""WITH RECURSIVE {_CELLS}, toks AS (SELECT id, i, j, CASE WHEN t IS NULL OR rs = 1 AND cs = 1 THEN '<td></td>' WHEN r = i AND c = j THEN '<td' || CASE WHEN cs > 1 THEN ' colspan="' || cs || '"' ELSE '' END || CASE WHEN rs > 1 THEN ' rowspan="' || rs || '"' ELSE '' END || '></td>' ELSE '' END AS tok FROM grid)
SELECT id, '<tbody>' || string_agg(line, '' ORDER BY i) || '</tbody>' AS tokens FROM (SELECT id, i, '<tr>' || string_agg(tok, '' ORDER BY j) || '</tr>' AS line FROM toks GROUP BY id, i) GROUP BY id""")
def grid_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _rows(spark, sf_dir).select("id", grids.placements(F.col("rows")).alias("placed"))
    return placed.select("id", F.array_join(grids.structure(F.col("placed")), "").alias("tokens"))


@query("grid_records", rf"""WITH RECURSIVE {_CELLS}, near AS (SELECT id, i, t, row_number() OVER (PARTITION BY id, i ORDER BY j) - 1 AS j FROM grid WHERE t IS NOT NULL), wide AS (SELECT id, max(j) + 1 AS w FROM near GROUP BY id),
two AS (SELECT id, i, j // 2 AS k, coalesce(max(t) FILTER (WHERE j % 2 = 0), '') AS a, coalesce(max(t) FILTER (WHERE j % 2 = 1), '') AS b, any_value(w) AS w FROM near JOIN wide USING (id) GROUP BY id, i, j // 2),
kv AS (SELECT id, i, k, CASE WHEN b = '' AND regexp_matches(a, '^[^:：;；]*[:：;；].') THEN regexp_extract(a, '^([^:：;；]*)', 1) ELSE a END AS key, CASE WHEN b = '' AND regexp_matches(a, '^[^:：;；]*[:：;；].') THEN trim(regexp_extract(a, '^[^:：;；]*[:：;；](.*)$', 1)) ELSE b END AS value FROM two WHERE 2 * k + 1 < w),
named AS (SELECT id, i, k, regexp_replace(trim(key), '[:：;；\s]+$', '') AS key, value FROM kv)
SELECT id, key, arg_max(value, i * 100 + k) AS value FROM named WHERE key <> '' GROUP BY id, key""")
def grid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys and values of each table; of equal keys the last counts."""
    found = _rows(spark, sf_dir).select("id", F.posexplode(grids.pairs(grids.squared(grids.grid(F.col("rows"))))).alias("nth", "p"))
    return found.groupBy("id", F.col("p.key").alias("key")).agg(F.max_by("p.value", "nth").alias("value"))
