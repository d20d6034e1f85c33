"""Registered queries of table repair and of the composed table matcher, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import table_tokens
from quire.operators import table_matching
from quire.plans.queries import _BOXES, _PAIRS, page_boxes
from quire.plans.registry import page_tasks, registered, spread

QUERIES, SQL, query = registered()

#: Heads as a recogniser may give them: with and without spans, bold twice, lone spans, empty cells, line separators; some tables have none.
_HEAD = """CASE p_partkey % 9 WHEN 0 THEN '<td>' || p_name || '</td><td></td>' WHEN 1 THEN '<td colspan="2">' || p_name || '</td><td>x</td>' WHEN 2 THEN '<td><b>' || p_name || '</b></td><td> </td>'
 WHEN 3 THEN '<td></td> rowspan="2"></b></td><td>' || p_name || '</td>' WHEN 4 THEN '<td rowspan="2" colspan="3"></td><td><b>a</b><b>' || p_name || '</b></td><td></td> colspan="12"></b></td>'
 WHEN 5 THEN '<td><b>a</b> <b>b</b></td><td>' || chr(8232) || '<b>c</b><b>d</b></td>' WHEN 6 THEN '<td colspan="2" rowspan="10"><b>' || p_name || '</b></td><td></td>' WHEN 7 THEN '<td><b><b>' || p_name || '</b></b></td>' ELSE '' END"""
_HTML = f"""CASE WHEN p_partkey % 11 = 0 THEN '<tbody><tr><td>' || p_brand || '</td></tr></tbody>' ELSE '<thead><tr>' || {_HEAD} || '</tr></thead><tbody><tr><td><b>' || p_brand || '</b><b>z</b></td></tr></tbody>' END"""
_S = r"""(?: rowspan="\d+" colspan="\d+"| colspan="\d+" rowspan="\d+"| rowspan="\d+"| colspan="\d+")"""
_TD = r"""<td rowspan="\d+" colspan="\d+">[^\n]+?</td>|<td colspan="\d+" rowspan="\d+">[^\n]+?</td>|<td rowspan="\d+">[^\n]+?</td>|<td colspan="\d+">[^\n]+?</td>|<td>[^\n]*?</td>"""


def _puts(text: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        text = f"replace({text}, '{a}', '{b}')"
    return text


_BARE = _puts("c", ("<b>", ""), ("</b>", ""))
_ONE = f"CASE WHEN length(c) - length(replace(c, '<b>', '')) > 3 OR length(c) - length(replace(c, '</b>', '')) > 4 THEN {_puts(_BARE, ('<td>', '<td><b>'), ('</td>', '</b></td>'))} ELSE c END"
_PLAIN = _puts("head", ("<td>", "<td><b>"), ("</td>", "</b></td>"), ("<b><b>", "<b>"), ("</b></b>", "</b>"))
_SPANNED = _puts(f"""regexp_replace(regexp_replace({_puts(f"regexp_replace(head, '(<td{_S}>)', '{chr(92)}1<b>', 'g')", ('</td>', '</b></td>'))}, '(<b>)+', '<b>', 'g'), '(</b>)+', '</b>', 'g')""", ("<td>", "<td><b>"), ("<b><b>", "<b>"))


def _bold(rows: str) -> str:
    """SQL that puts ``bold`` beside ``id`` and ``html`` of ``rows``."""
    return f"""heads AS (SELECT *, regexp_extract(html, '<thead>[^\\n]*?</thead>') AS head FROM {rows}),
bolded AS (SELECT *, replace(CASE WHEN regexp_matches(head, '<td{_S}>') THEN {_SPANNED} ELSE {_PLAIN} END, '<td><b></b></td>', '<td></td>') AS b FROM heads),
single AS (SELECT *, list_reduce(list_transform(regexp_extract_all(b, '{_TD}'), lambda c: [c, {_ONE}]), lambda out, p: [replace(out[1], p[1], p[2]), ''], [b, ''])[1] AS s FROM bolded),
repaired AS (SELECT *, CASE WHEN head = '' THEN html ELSE replace(html, head, regexp_replace(s, '<td></td>({_S})></b></td>', '<td{chr(92)}1></td>', 'g')) END AS bold FROM single)"""


@query("repaired_heads", f"WITH t AS (SELECT p_partkey AS id, {_HTML} AS html FROM part), {_bold('t')} SELECT id, bold FROM repaired")
def repaired_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), F.expr(_HTML.replace("chr(8232)", "' '")).alias("html"))
    return rows.select("id", table_tokens.bold_heads(F.col("html")).alias("bold"))


_HULL = """((greatest(f.x2, o.x2) - least(f.x1, o.x1)) * (greatest(f.y2, o.y2) - least(f.y1, o.y1)))::DOUBLE - (greatest(-(f.x1 - o.x1) * (f.y1 - o.y1), 0) + greatest((f.x2 - o.x2) * (f.y1 - o.y1), 0) + greatest((f.x1 - o.x1) * (f.y2 - o.y2), 0) + greatest(-(f.x2 - o.x2) * (f.y2 - o.y2), 0))::DOUBLE / 2"""
_RULES = f"""{_BOXES}, {_PAIRS}, cells AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id) - 1 AS cell_id FROM o),
first AS MATERIALIZED (SELECT p.page_id, p.box_id, c.cell_id FROM pairs p JOIN cells c ON c.page_id = p.page_id AND c.box_id = p.other WHERE cx BETWEEN ox1 AND ox2 AND cy BETWEEN oy1 AND oy2),
left1 AS MATERIALIZED (SELECT * FROM f ANTI JOIN first USING (page_id, box_id)),
second AS MATERIALIZED (
  SELECT page_id, box_id, cell_id FROM (SELECT f.page_id, f.box_id, o.cell_id, (least(f.x2, o.x2) - greatest(f.x1, o.x1)) * (least(f.y2, o.y2) - greatest(f.y1, o.y1)) / ({_HULL}) AS v FROM left1 f JOIN cells o ON f.page_id = o.page_id AND f.x1 < o.x2 AND o.x1 < f.x2 AND f.y1 < o.y2 AND o.y1 < f.y2)
  QUALIFY row_number() OVER (PARTITION BY page_id, box_id ORDER BY v DESC, cell_id) = 1),
left2 AS MATERIALIZED (SELECT * FROM left1 ANTI JOIN second USING (page_id, box_id)),
free AS (SELECT * FROM cells ANTI JOIN (SELECT page_id, cell_id FROM first UNION SELECT page_id, cell_id FROM second) USING (page_id, cell_id)),
third AS MATERIALIZED (
  SELECT page_id, box_id, cell_id FROM (SELECT b.page_id, b.box_id, c.cell_id, sqrt(((b.x1 + b.x2) / 2.0 - (c.x1 + c.x2) / 2.0) * ((b.x1 + b.x2) / 2.0 - (c.x1 + c.x2) / 2.0) + ((b.y1 + b.y2) / 2.0 - (c.y1 + c.y2) / 2.0) * ((b.y1 + b.y2) / 2.0 - (c.y1 + c.y2) / 2.0)) AS d FROM left2 b JOIN free c ON b.page_id = c.page_id)
  QUALIFY row_number() OVER (PARTITION BY page_id, cell_id ORDER BY d, box_id) = 1),
left3 AS MATERIALIZED (SELECT page_id, box_id, (x1 + x2) / 2.0 AS x, (y1 + y2) / 2.0 AS y, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS n FROM left2 ANTI JOIN third USING (page_id, box_id)),
grouped(page_id, n, ys, g) AS (
  SELECT DISTINCT page_id, 0::BIGINT, CAST([] AS DOUBLE[]), 0::BIGINT FROM left3 UNION ALL
  SELECT page_id, n, CASE WHEN spot IS NULL THEN ys || [y] ELSE ys END, coalesce(spot, len(ys) + 1) FROM (
    SELECT l.page_id, l.n, ys, l.y, list_position(list_transform(ys, lambda v: abs(v - l.y) < 3), true) AS spot FROM grouped r JOIN left3 l ON l.page_id = r.page_id AND l.n = r.n + 1)),
rows1 AS (SELECT l.*, g, first_value(y) OVER (PARTITION BY l.page_id, g ORDER BY x, l.n) AS row_y, count(*) OVER (PARTITION BY l.page_id, g) AS row_cells, row_number() OVER (PARTITION BY l.page_id, g ORDER BY x, l.n) AS nth FROM left3 l JOIN grouped r ON r.page_id = l.page_id AND r.n = l.n),
fourth AS (
  SELECT r.page_id, box_id, coalesce(c.n, 0) + row_number() OVER (PARTITION BY r.page_id ORDER BY row_y, g, nth) - 1 AS cell_id, CASE WHEN nth = 1 THEN row_cells END AS row_cells
  FROM rows1 r LEFT JOIN (SELECT page_id, count(*) AS n FROM cells GROUP BY 1) c ON c.page_id = r.page_id),
matched AS MATERIALIZED (
  SELECT page_id, box_id, cell_id, 1 AS rule, CAST(NULL AS BIGINT) AS row_cells FROM first UNION ALL SELECT page_id, box_id, cell_id, 2, NULL FROM second UNION ALL SELECT page_id, box_id, cell_id, 3, NULL FROM third UNION ALL SELECT page_id, box_id, cell_id, 4, row_cells FROM fourth)"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in tasks of bounded size: what meets on a page is several times its rows, and is sorted by one window after another."""
    return page_boxes(spark, sf_dir, page_tasks(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def _sides(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    return found.where("kind = 'F'"), found.where("kind = 'O'")


@query("table_rules", f"WITH RECURSIVE {_RULES} SELECT page_id, box_id, CAST(cell_id AS BIGINT) AS cell_id, rule, CAST(row_cells AS INTEGER) AS row_cells FROM matched")
def table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_matching.matches(*_sides(_boxes(spark, sf_dir)))


#: A page's tokens: head and body of plain cells, cut off before the end on two pages of three.
_TOKENS = "CASE page_id % 2 WHEN 0 THEN '<thead>|<tr>|<td></td>|<td>|</td>|<td| colspan=\"2\"|>|</td>|</tr>|</thead>|' ELSE '' END || '<tbody>|<tr>|' || repeat('<td></td>|', CAST(page_id % 7 AS INT)) || CASE page_id % 3 WHEN 0 THEN '<eb></eb>|</tr>|</tbody>' WHEN 1 THEN '<td></td>' ELSE '<td></td>|</tr>' END"
_BOX_TEXT = "CASE box_id % 4 WHEN 0 THEN '<b>' || label || '</b>' WHEN 1 THEN label ELSE label || CAST(box_id AS {s}) END"
_MERGED = """regexp_replace(joined, '<td\\|( colspan="2")\\|>\\|</td>', '<td\\1></td>', 'g')"""


@query("matched_tables", f"""WITH RECURSIVE {_RULES},
texts AS (SELECT page_id, cell_id, max(row_cells) AS row_cells, CASE WHEN bool_and(t LIKE '<b>%') THEN '<b>' || replace(replace(string_agg(t, ' ' ORDER BY rule, box_id), '<b>', ''), '</b>', '') || '</b>' ELSE string_agg(t, ' ' ORDER BY rule, box_id) END AS t FROM (SELECT m.*, {_BOX_TEXT.format(s='VARCHAR')} AS t FROM matched m JOIN f USING (page_id, box_id)) GROUP BY 1, 2),
by_page AS (SELECT page_id, list(cell_id ORDER BY cell_id) AS ids, list(t ORDER BY cell_id) AS ts, list(row_cells ORDER BY cell_id) FILTER (WHERE row_cells IS NOT NULL) AS new_rows FROM texts GROUP BY 1),
tokens AS (SELECT page_id, {_TOKENS} AS joined FROM (SELECT DISTINCT page_id FROM boxes)),
longer AS (SELECT t.page_id, ids, ts, CASE WHEN joined LIKE '%</tbody>' THEN joined ELSE joined || CASE WHEN joined LIKE '%|<td></td>' THEN '|</tr>' ELSE '' END || coalesce(array_to_string(list_transform(new_rows, lambda n: '|<tr>' || repeat('|<td></td>', n::INT) || '|</tr>'), ''), '') || '|</tbody>' END AS joined FROM tokens t LEFT JOIN by_page USING (page_id)),
listed AS (SELECT page_id, coalesce(ids, []) AS ids, coalesce(ts, []) AS ts, string_split({_MERGED}, '|') AS toks FROM longer),
placed AS (SELECT page_id, ids, ts, toks[i] AS tok, i, CASE WHEN toks[i] LIKE '<td%' THEN sum(CASE WHEN toks[i] LIKE '<td%' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) - 1 END AS n FROM (SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM listed)),
put AS (SELECT page_id AS id, string_agg(CASE WHEN n IS NULL THEN replace(tok, '<eb></eb>', '<td></td>') ELSE replace(tok, '><', '>' || ts[list_position(ids, n)] || '<') END, '' ORDER BY i) AS html FROM placed WHERE n IS NULL OR (n < len(ids) AND list_contains(ids, n)) GROUP BY 1),
{_bold('put')} SELECT id AS page_id, '<html><body><table>' || bold || '</table></body></html>' AS html FROM repaired""")
def matched_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    found, cells = _sides(boxes)
    pages = boxes.select("page_id").distinct().select("page_id", F.split(F.expr(_TOKENS), r"\|").alias("tokens"))
    return table_matching.tables(found.withColumn("text", F.expr(_BOX_TEXT.format(s="STRING"))), cells, pages)
