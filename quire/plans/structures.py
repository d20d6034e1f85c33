"""Registered queries of table tokens, token labels and point lists, over tables written from the parts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import structures
from quire.functions.geometry import Box
from quire.plans.queries import _BOXES, page_boxes
from quire.plans.registry import registered, spread

QUERIES, SQL, query = registered()

#: Tokens joined by ``|``: plain cells, cells in two tokens, one or two spans, tokens of empty cells.
_TOKENS = """'<tbody>|<tr>|' || repeat('<td></td>|', CAST(p_size % 3 AS INT)) || CASE p_partkey % 5 WHEN 0 THEN '<td| colspan="2"|>|</td>|' WHEN 1 THEN '<td| rowspan="2"| colspan="3"|>|</td>|' WHEN 2 THEN '<td>|</td>|' WHEN 3 THEN '<eb2></eb2>|<eb9></eb9>|' ELSE '' END || '</tr>|</tbody>'"""
_TABLE = f"t AS (SELECT p_partkey AS id, p_name AS name, {_TOKENS} AS joined FROM part)"


def tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.expr(_TOKENS).alias("joined"))
    return rows.withColumn("tokens", F.split("joined", r"\|"))


@query("structure_tokens", f"""WITH {_TABLE} SELECT id, replace(replace(replace(joined, '<td| colspan="2"|>|</td>', '<td colspan="2"></td>'), '<td| rowspan="2"| colspan="3"|>|</td>', '<td rowspan="2" colspan="3"></td>'), '', '') AS spans,
  replace(joined, '<td>|</td>', '<td></td>') AS cells, replace(replace(joined, '<eb2></eb2>', '<td><b> </b></td>'), '<eb9></eb9>', '<td><i></i></td>') AS filled, replace(replace(replace(joined, '|', ''), '<tbody>', ''), '</tbody>', '') = '<tr><td></td></tr>' AS same FROM t""")
def structure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.array(*map(F.lit, ("<thead>", "<tr>", "<td></td>", "</tr>", "</thead>")))
    return tables(spark, sf_dir).select(
        "id", F.array_join(structures.spans_merged(F.col("tokens")), "|").alias("spans"), F.array_join(structures.cells_merged(F.col("tokens")), "|").alias("cells"),
        F.array_join(F.transform("tokens", structures.empty_cells), "|").alias("filled"), structures.same_structure(F.col("tokens"), target, sections=False).alias("same"),
    )


@query("table_pages", f"""WITH {_TABLE}, x AS (SELECT id, name, replace(joined, '|', '') AS html, CASE id % 3 WHEN 0 THEN '<b> </b>' ELSE '<b>' || name || '</b>' END AS cell FROM t)
SELECT id, '<html><body><table>' || CASE WHEN id % 3 = 0 THEN html WHEN strpos(html, '<td>') > 0 AND id % 5 = 2 THEN replace(html, '<td></td></tr>', '<td>' || cell || '</td></tr>') WHEN id % 5 = 0 THEN replace(html, ' colspan="2">', ' colspan="2">' || cell) WHEN id % 5 = 1 THEN replace(html, ' colspan="3">', ' colspan="3">' || cell) ELSE html END || '</table></body></html>' AS html FROM x""")
def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("if(id % 3 = 0, '<b> </b>', '<b>' || name || '</b>')")
    return tables(spark, sf_dir).select("id", structures.table_html(F.col("tokens"), F.array(cell)).alias("html"))


_NAMES = "['question', 'Answer', 'other', 'header']"
_IDS = "['O', 'B-QUESTION', 'I-QUESTION', 'B-ANSWER', 'I-ANSWER', 'B-HEADER', 'I-HEADER']"


@query("token_labels", f"""WITH w AS (SELECT p_partkey AS id, string_split(p_name, '') AS tokens, ['question', 'answer', 'Ignore', 'HEADER', 'none'][p_partkey % 5 + 1] AS label FROM part)
SELECT id, array_to_string(CASE WHEN upper(label) = 'IGNORE' THEN list_transform(tokens, lambda x: 0) WHEN list_contains({_IDS}, 'B-' || upper(label)) THEN list_transform(range(1, len(tokens) + 1), lambda k: list_position({_IDS}, CASE k WHEN 1 THEN 'B-' ELSE 'I-' END || upper(label)) - 1) END, ',') AS labels,
  array_to_string(list_transform(range(1, 13), lambda k: CASE WHEN k <= len(tokens) THEN length(tokens[k]) ELSE 9 END), ',') AS ids, array_to_string(list_transform(range(1, 13), lambda k: CASE WHEN k <= len(tokens) THEN 1 ELSE 0 END), ',') AS mask, array_to_string(tokens[1:5], '') AS chunk FROM w""")
def token_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), F.filter(F.split("p_name", ""), lambda c: c != "").alias("tokens"), F.expr("element_at(array('question', 'answer', 'Ignore', 'HEADER', 'none'), cast(p_partkey % 5 + 1 as int))").alias("label"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    row = structures.padded(F.transform("tokens", F.length), 12, 9)
    return rows.select("id", text(structures.token_labels(F.col("label"), F.col("tokens"), ["question", "Answer", "other", "header"])).alias("labels"), text(row["ids"]).alias("ids"), text(row["mask"]).alias("mask"), F.array_join(structures.first_chunk(F.col("tokens"), 5), "").alias("chunk"))


@query("ordered_corners", f"""WITH {_BOXES} SELECT page_id, box_id, x1 || ',' || y1 || ';' || x2 || ',' || y1 || ';' || x2 || ',' || y2 || ';' || x1 || ',' || y2 AS corners, x1 || ',' || y1 || ';' || x2 || ',' || y2 || repeat(';' || x2 || ',' || y2, CAST(box_id % 3 AS INT)) AS filled FROM boxes""")
def ordered_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners in any order come clockwise; two points are filled up to as many as asked for."""
    corners = Box.of().corners()
    mixed = F.concat(F.slice(corners, (F.col("box_id") % 4 + 1).cast("int"), F.lit(4)), F.slice(corners, F.lit(1), (F.col("box_id") % 4).cast("int")))
    two = F.array(F.array("x1", "y1"), F.array("x2", "y2"))
    text = lambda points: F.array_join(F.transform(points, lambda p: F.concat_ws(",", p[0].cast("string"), p[1].cast("string"))), ";")
    return page_boxes(spark, sf_dir).select("page_id", "box_id", text(structures.clockwise(mixed)).alias("corners"), text(structures.filled_points(two, F.col("box_id") % 3 + 2)).alias("filled"))


_VOCABULARY = ("sos", "<tr>", "<td>", "</td>", "<td></td>", "</tr>", "eos")
_VOCABULARY_SQL = "[" + ", ".join(f"'{v}'" for v in _VOCABULARY) + "]"


@query("decoded_structures", f"""WITH r AS (SELECT p_partkey AS id, list_transform(range(0, 10), lambda k: CAST((p_partkey * 5 + k * (p_partkey % 6 + 1)) % 7 AS BIGINT)) AS ids, list_transform(range(0, 10), lambda k: ((p_partkey + k) % 8) / 8.0) AS scores FROM part),
k AS (SELECT *, list_filter(range(1, 11 ), lambda j: j - 1 < coalesce(list_min(list_filter(range(1, 10), lambda k: ids[k + 1] = 6)), 10) AND ids[j] NOT IN (0, 6)) AS places FROM r)
SELECT id, coalesce(array_to_string(list_transform(places, lambda j: {_VOCABULARY_SQL}[ids[j] + 1]), ''), '') AS tokens, round(CAST(list_sum(list_transform(places, lambda j: scores[j])) AS DOUBLE) / len(places), 6) AS score, coalesce(array_to_string(list_transform(list_filter(places, lambda j: ids[j] IN (2, 4)), lambda j: j - 1), ','), '') AS cells FROM k""")
def decoded_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(9))
    ids = F.transform(places, lambda k: ((F.col("p_partkey") * 5 + k * (F.col("p_partkey") % 6 + 1)) % 7).cast("int"))
    rows = spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), ids.alias("ids"), F.transform(places, lambda k: ((F.col("p_partkey") + k) % 8) / 8.0).alias("scores"))
    found = rows.select("id", structures.decoded_structure(F.col("ids"), F.col("scores"), list(_VOCABULARY), 6, (0, 6)).alias("d"))
    return found.select("id", F.array_join("d.tokens", "").alias("tokens"), F.round("d.score", 6).alias("score"), F.array_join(F.col("d.cells").cast("array<string>"), ",").alias("cells"))
