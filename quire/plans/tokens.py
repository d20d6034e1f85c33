"""Registered queries of token chunks and relations, over segments made from the order lines, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import token_chunks
from quire.plans.queries import _BOXES, page_boxes
from quire.plans.registry import registered

QUERIES, SQL, query = registered()

MOST = 16
_LABEL = "CASE box_id % 5 WHEN 0 THEN 'question' WHEN 1 THEN 'Answer' WHEN 2 THEN 'other' WHEN 3 THEN 'Question' ELSE 'header' END"
#: Links between neighbours, in both directions and twice, and some to segments that are no entity or not there.


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, box_id, label, ids): up to five tokens each, numbered by page and place."""
    n = ((F.col("x1") + F.col("box_id")) % 6).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: (F.col("box_id") * 10 + k).cast("int")))
    return page_boxes(spark, sf_dir).select("page_id", "box_id", F.expr(_LABEL).alias("label"), ids.alias("ids"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, 0), (3, 1), (0, 2), (4, 0))])
    return page_boxes(spark, sf_dir).where("box_id % 3 = 0").select("page_id", "box_id", F.explode(steps).alias("s")).select("page_id", (F.col("box_id") + F.col("s.a")).alias("a"), (F.col("box_id") + F.col("s.b")).alias("b"))


_DOCS = f"""{_BOXES}, seg AS MATERIALIZED (SELECT page_id, box_id, upper({_LABEL}) AS label, (x1 + box_id) % 6 AS n FROM boxes WHERE (x1 + box_id) % 6 > 0),
spans AS MATERIALIZED (SELECT *, sum(n) OVER w - n AS s, sum(n) OVER w AS e FROM seg WINDOW w AS (PARTITION BY page_id ORDER BY box_id)),
ents AS MATERIALIZED (SELECT page_id, box_id, label, s, e, row_number() OVER (PARTITION BY page_id ORDER BY box_id) - 1 AS spot FROM spans WHERE label <> 'OTHER'),
linked AS (SELECT DISTINCT page_id, least(box_id + a, box_id + b) AS a, greatest(box_id + a, box_id + b) AS b FROM boxes, (VALUES (0, 1), (1, 0), (3, 1), (0, 2), (4, 0)) AS v(a, b) WHERE box_id % 3 = 0),
rels AS MATERIALIZED (
  SELECT x.page_id, CASE WHEN x.label = 'QUESTION' THEN x.spot ELSE y.spot END AS head, CASE WHEN x.label = 'QUESTION' THEN y.spot ELSE x.spot END AS tail, least(x.s, y.s) AS s, greatest(x.e, y.e) AS e
  FROM linked l JOIN ents x ON x.page_id = l.page_id AND x.box_id = l.a JOIN ents y ON y.page_id = l.page_id AND y.box_id = l.b WHERE (x.label = 'QUESTION' AND y.label = 'ANSWER') OR (x.label = 'ANSWER' AND y.label = 'QUESTION'))"""


@query("token_relations", f"WITH {_DOCS} SELECT page_id, head::INTEGER AS head, tail::INTEGER AS tail, s::INTEGER AS start_index, e::INTEGER AS end_index FROM rels")
def token_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_chunks.sequences(segments(spark, sf_dir), "page_id", "box_id", "box_id", "label", "ids")
    return token_chunks.with_relations(docs, links(spark, sf_dir), "page_id", "a", "b").select("page_id", F.inline("relations"))


@query("token_chunks", f"""WITH {_DOCS}, toks AS (SELECT page_id, s + k - 1 AS i, box_id * 10 + k AS id FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM spans)),
parts AS (SELECT page_id, i // {MOST} AS chunk, string_agg(id::VARCHAR, ',' ORDER BY i) AS ids FROM toks GROUP BY 1, 2),
own AS (SELECT page_id, s // {MOST} AS chunk, spot, s % {MOST} AS ls, e - s // {MOST} * {MOST} AS le, label, row_number() OVER (PARTITION BY page_id, s // {MOST} ORDER BY spot) - 1 AS near FROM ents WHERE s // {MOST} = e // {MOST}),
listed AS (SELECT page_id, chunk, string_agg(ls || '-' || le || label, ',' ORDER BY spot) AS entities FROM own GROUP BY 1, 2),
tied AS (SELECT r.page_id, r.s // {MOST} AS chunk, string_agg(h.near || '>' || t.near || ':' || r.s % {MOST} || '-' || (r.e - r.s // {MOST} * {MOST}), ',' ORDER BY r.head, r.tail) AS relations FROM rels r JOIN own h ON h.page_id = r.page_id AND h.spot = r.head JOIN own t ON t.page_id = r.page_id AND t.spot = r.tail WHERE r.s // {MOST} = r.e // {MOST} GROUP BY 1, 2)
SELECT page_id, chunk::INTEGER AS chunk, ids, entities, coalesce(relations, '') AS relations FROM parts JOIN listed USING (page_id, chunk) LEFT JOIN tied USING (page_id, chunk)""")
def all_token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_chunks.sequences(segments(spark, sf_dir), "page_id", "box_id", "box_id", "label", "ids")
    cut = token_chunks.chunks(token_chunks.with_relations(docs, links(spark, sf_dir), "page_id", "a", "b"), MOST, "page_id")
    text = lambda c, of: F.array_join(F.transform(c, of), ",")
    return cut.select(
        "page_id", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), text("entities", lambda e: F.concat(e["start"], F.lit("-"), e["end"], e["label"])).alias("entities"),
        text("relations", lambda r: F.concat(r["head"], F.lit(">"), r["tail"], F.lit(":"), r["start_index"], F.lit("-"), r["end_index"])).alias("relations"),
    )
