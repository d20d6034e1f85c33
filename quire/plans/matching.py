"""Registered queries of box matching, scores by threshold, and small text rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import phrases
from quire.functions.geometry import Box, bounds, centre_to_corners, corners_to_centre
from quire.operators import boxes, matching, metrics, polygons
from quire.plans.notices import FIXTURE, normal
from quire.plans.queries import _BOXES, _PAIRS, page_boxes
from quire.plans.registry import registered, rounded

QUERIES, SQL, query = registered()


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = page_boxes(spark, sf_dir)
    return found.where("kind = 'F'"), found.where("kind = 'O'")


_IOU = "CAST(inter AS DOUBLE) / CAST(fa + oa - inter AS DOUBLE)"


@query("overlap_matches", f"""WITH {_BOXES}, {_PAIRS} SELECT page_id, box_id, other AS cell_id, round({_IOU}, 9) AS iou FROM (SELECT *, row_number() OVER (PARTITION BY page_id, box_id ORDER BY {_IOU} DESC, other) AS n FROM pairs WHERE inter > 0) WHERE n = 1""")
def overlap_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.overlap_rule(*_sides(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


_FAR = "sqrt(CAST((cx - (ox1 + ox2) / 2.0) * (cx - (ox1 + ox2) / 2.0) + (cy - (oy1 + oy2) / 2.0) * (cy - (oy1 + oy2) / 2.0) AS DOUBLE))"


@query("distance_matches", f"""WITH {_BOXES}, {_PAIRS} SELECT page_id, other AS cell_id, box_id, round({_FAR}, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY page_id, other ORDER BY {_FAR}, box_id) AS n FROM pairs) WHERE n = 1""")
def distance_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.distance_rule(*_sides(spark, sf_dir)).withColumn("distance", F.round("distance", 6))


_CENTRES = "centred AS (SELECT page_id, box_id, other AS cell_id FROM pairs WHERE cx BETWEEN ox1 AND ox2 AND cy BETWEEN oy1 AND oy2)"


@query("virtual_cells", f"""WITH {_BOXES}, {_PAIRS}, {_CENTRES}, left_over AS (SELECT f.page_id, f.box_id FROM f ANTI JOIN centred c ON c.page_id = f.page_id AND c.box_id = f.box_id)
SELECT l.page_id, l.box_id, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY l.page_id ORDER BY l.box_id) - 1 AS BIGINT) AS cell_id FROM left_over l LEFT JOIN (SELECT page_id, count(*) AS n FROM o GROUP BY 1) c ON c.page_id = l.page_id""")
def virtual_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cells = _sides(spark, sf_dir)
    return matching.virtual_cells(boxes.unmatched(found, boxes.centres_inside(found, cells).select("page_id", "box_id").distinct()).select("page_id", "box_id"), cells)


@query("cell_texts", f"""WITH {_BOXES}, {_PAIRS}, {_CENTRES}, t AS (SELECT c.page_id, c.cell_id, c.box_id, CASE WHEN f.label = 'A' THEN '<b>' || f.label || '</b>' ELSE f.label END AS text FROM centred c JOIN f ON f.page_id = c.page_id AND f.box_id = c.box_id)
SELECT page_id, cell_id, string_agg(CAST(box_id AS VARCHAR), ',' ORDER BY box_id) AS boxes, CASE WHEN count(*) = count(*) FILTER (WHERE text LIKE '<b>%') THEN '<b>' || replace(replace(string_agg(text, ' ' ORDER BY box_id), '<b>', ''), '</b>', '') || '</b>' ELSE string_agg(text, ' ' ORDER BY box_id) END AS text FROM t GROUP BY 1, 2""")
def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, cells = _sides(spark, sf_dir)
    texts = found.select("page_id", "box_id", F.expr("if(label = 'A', '<b>' || label || '</b>', label)").alias("text"))
    return matching.cell_texts(boxes.centres_inside(found, cells), texts).withColumn("boxes", F.array_join(F.col("boxes").cast("array<string>"), ","))


@query("covered_shares", f"WITH {_BOXES}, {_PAIRS} SELECT page_id, box_id, other AS region_id, round(CAST(inter AS DOUBLE) / oa, 9) AS share FROM pairs WHERE inter > 0")
def covered_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.covered_share(*_sides(spark, sf_dir)).withColumn("share", F.round("share", 9))


_FOLD = """list_reduce(list_transform(found, lambda x: [x]), lambda kept, b: CASE WHEN {clash} THEN kept ELSE kept || b END, CAST([] AS STRUCT({fields})[]))"""
_INTER = "greatest(least(a.x2, b[1].x2) - greatest(a.x1, b[1].x1), 0) * greatest(least(a.y2, b[1].y2) - greatest(a.y1, b[1].y1), 0)"
_SIZE = "greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0)"


def _kept(order: str, by: str, clash: str, most: str = "") -> str:
    fields = "s DOUBLE, k BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    entry = f"CAST(ROW({order}, box_id, x1, y1, x2, y2) AS STRUCT({fields}))"
    return f"ranked AS (SELECT {by}, list_sort(list({entry})){most} AS found FROM boxes GROUP BY {by}), folded AS (SELECT {by}, unnest({_FOLD.format(clash=clash, fields=fields)}) AS b FROM ranked)"


@query("suppressed_boxes", f"""WITH {_BOXES}, {_kept('-score', 'page_id', f"len(list_filter(kept, lambda a: {_INTER} > 0.5 * ({_SIZE.format('a')} + {_SIZE.format('b[1]')} - {_INTER}))) > 0", '[1:200]')} SELECT page_id, b.k AS box_id FROM folded""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.suppress(page_boxes(spark, sf_dir))


@query("outermost_regions", f"""WITH {_BOXES}, {_kept('-((x2 - x1) * (y2 - y1))', 'page_id, label', f"b[1].s < 0 AND len(list_filter(kept, lambda a: {_INTER} >= 0.95 * -b[1].s)) > 0")} SELECT page_id, label, b.k AS box_id FROM folded""")
def outermost_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.outermost(page_boxes(spark, sf_dir))


def _counted(where: str = "true") -> str:
    pairs = "STRUCT(g BIGINT, d BIGINT)"
    return f"""met AS (SELECT page_id, list_sort(list(CAST(ROW(other, box_id) AS {pairs}))) AS found FROM pairs JOIN f USING (page_id, box_id) WHERE inter > 0 AND {_IOU} > 0.5 AND {where} GROUP BY page_id),
folded AS (SELECT page_id, len(list_reduce(list_transform(found, lambda x: [x]), lambda kept, b: CASE WHEN len(list_filter(kept, lambda a: a.g = b[1].g OR a.d = b[1].d)) > 0 THEN kept ELSE kept || b END, CAST([] AS {pairs}[])))::BIGINT AS matched FROM met),
counted AS (SELECT p.page_id, coalesce(matched, 0) AS matched, truths, detections FROM (SELECT page_id, count(*) FILTER (WHERE kind = 'O') AS truths, count(*) FILTER (WHERE kind = 'F' AND {where}) AS detections FROM boxes GROUP BY 1) p LEFT JOIN folded USING (page_id))"""


_RATIOS = "sum(matched)::BIGINT AS matched, sum(truths)::BIGINT AS truths, sum(detections)::BIGINT AS detections, CASE WHEN sum(detections) = 0 THEN 0 ELSE sum(matched) / sum(detections)::DOUBLE END AS precision, CASE WHEN sum(truths) = 0 THEN 0 ELSE sum(matched) / sum(truths)::DOUBLE END AS recall"
_HMEAN = "CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS hmean"


@query("detection_counts", f"WITH {_BOXES}, {_PAIRS}, {_counted()} SELECT page_id, matched, truths, detections FROM counted")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.greedy_matches(page_boxes(spark, sf_dir), F.col("kind") == "O")


@query("detection_scores", f"WITH {_BOXES}, {_PAIRS}, {_counted()}, s AS (SELECT {_RATIOS} FROM counted) SELECT *, {_HMEAN} FROM s")
def detection_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detection(detection_counts(spark, sf_dir))


THRESHOLDS = (0.2, 0.4, 0.6, 0.8)
_EACH = " UNION ALL ".join(f"SELECT * FROM (WITH {_counted(f'score >= {t}')} SELECT {t}::DOUBLE AS threshold, {_RATIOS} FROM counted)" for t in THRESHOLDS)


@query("threshold_scores", f"WITH {_BOXES}, {_PAIRS}, s AS ({_EACH}) SELECT *, {_HMEAN} FROM s")
def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection scores of what scores at least each threshold."""
    found = page_boxes(spark, sf_dir)
    levels = found.withColumn("threshold", F.explode(F.array(*map(F.lit, THRESHOLDS)))).where("kind = 'O' or score >= threshold").withColumn("spot", F.struct("threshold", "page_id"))
    counts = metrics.greedy_matches(levels, F.col("kind") == "O", page="spot").withColumn("threshold", F.col("spot.threshold"))
    return metrics.detection(counts, "threshold")


_BOXED = "(x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, x2 - x1 AS w, y2 - y1 AS h"


@query("box_forms", f"""WITH {_BOXES}, c AS (SELECT page_id, box_id, x1, y1, x2, y2, {_BOXED} FROM boxes)
SELECT page_id, box_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, w, h, CAST(cx - w / 2.0 AS DOUBLE) AS bx1, CAST(cy + h / 2.0 AS DOUBLE) AS by2, greatest(x1 - 5, 0) AS px1, least(y2 + 5, 500) AS py2, x1 AS rx1, y2 AS ry2 FROM c""")
def box_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to centre and back, padding inside a page, the rectangle around corners."""
    box = Box.of()
    mid = corners_to_centre(box)
    back, padded, around = centre_to_corners(mid), box.padded(5, F.lit(900), F.lit(500)), bounds(box.corners())
    return page_boxes(spark, sf_dir).select(
        "page_id", "box_id", mid.x1.cast("double").alias("cx"), mid.y1.cast("double").alias("cy"), mid.x2.alias("w"), mid.y2.alias("h"), back.x1.cast("double").alias("bx1"), back.y2.cast("double").alias("by2"),
        padded.x1.alias("px1"), padded.y2.alias("py2"), around["x1"].alias("rx1"), around["y2"].alias("ry2"),
    )


@query("vector_shares", "SELECT vec_id, round(norm, 6) AS norm, round(e[1] / list_sum(e), 9) AS first, round(list_max(e) / list_sum(e), 9) AS most FROM (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS norm, list_transform(embedding, lambda v: exp(v::DOUBLE - list_max(embedding)::DOUBLE)) AS e FROM embeddings)")
def vector_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    share = phrases.softmax(F.col("embedding"))
    return table.select("vec_id", F.round(phrases.norm2(F.col("embedding")), 6).alias("norm"), share.alias("s")).select("vec_id", "norm", F.round(F.col("s")[0], 9).alias("first"), F.round(F.array_max("s"), 9).alias("most"))


_WORDS = "CASE k % 8 WHEN 0 THEN '号' WHEN 1 THEN '12楼' WHEN 2 THEN 'ab9' WHEN 3 THEN '支行' WHEN 4 THEN '北京市海淀区' WHEN 5 THEN '' WHEN 6 THEN '甲:乙' ELSE '行' END"
_SAID = "'经办人：王' || CAST(c % 9 AS STRING) || '五，证件号码：11010' || CAST(c AS STRING) || ' Yes'"


@query("fragments", rf"""WITH w AS (SELECT k, c, {_WORDS} AS word FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders)), x AS (SELECT *, '中国银' || word AS whole FROM w)
SELECT k AS id, word <> '' AND length(word) <= 4 AND NOT regexp_matches(word, '[:：]') AND (word IN ('号', '支行', '行') OR regexp_full_match(word, '[a-zA-Z0-9]+') OR regexp_full_match(word, '\d+[号室楼层区]')) AS fragment,
  CASE WHEN word = '' THEN 0.0 WHEN regexp_matches(whole, '(?:支行|分行|银行|公司|有限公司|号|室|楼|层|省|市|区|县|镇)$') THEN 1.0 WHEN word IN ('行', '司', '号', '室', '楼', '层', '省', '市', '区') THEN 0.6 ELSE 0.1 END::DOUBLE AS completes FROM x""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k").selectExpr("k", f"{_WORDS} AS word")
    return rows.select(F.col("k").alias("id"), phrases.is_fragment(F.col("word")).alias("fragment"), phrases.completion(F.lit("中国银"), F.col("word")).alias("completes"))


@query("text_rules", rf"""WITH w AS (SELECT k, c, {_SAID} AS said, 'C:\dir/' || CAST(c AS VARCHAR) || ' a（b).Tar.GZ' AS path, CASE k % 3 WHEN 0 THEN ' YES ' WHEN 1 THEN 'on' ELSE 'no' END AS flag FROM (SELECT o_orderkey AS k, o_custkey AS c FROM orders))
SELECT k AS id, coalesce(array_to_string(list_reverse(regexp_extract_all(said, '(?s)[a-zA-Z0-9 :*./%+-]+|.')), ''), '') AS mirrored, translate(regexp_replace(lower(trim(said)), '[\s\x{{3000}}]+', '', 'g'), '：:，,。；;（）()[]【】“”"''-_/', '') AS bare,
  regexp_extract(said, '经办人(?:姓名)?[：:\s]*([\x{{4e00}}-\x{{9fa5}}A-Za-z·]{{2,30}})', 1) AS handler_raw, regexp_extract(said, '证件号码[：:\s]*([0-9Xx*]{{6,25}})', 1) AS number, lower(trim(flag)) IN ('1', 'true', 'yes', 'y', 'on') AS flag,
  sha256(said) AS digest, lower(regexp_replace(regexp_extract(path, '([^/\\]*)$', 1), '\.[^.]*$', '')) AS stem FROM w""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS k", "o_custkey AS c").withColumn("said", F.expr(_SAID))
    rows = rows.withColumn("path", F.concat(F.lit("C:\\dir/"), F.col("c").cast("string"), F.lit(" a（b).Tar.GZ"))).withColumn("flag", F.expr("CASE k % 3 WHEN 0 THEN ' YES ' WHEN 1 THEN 'on' ELSE 'no' END"))
    found, said = phrases.handler(F.col("said")), F.col("said")
    return rows.select(
        F.col("k").alias("id"), phrases.mirrored(said).alias("mirrored"), phrases.bare_text(said).alias("bare"), F.coalesce(found["name"], F.lit("")).alias("handler_raw"), found["number"].alias("number"),
        phrases.as_boolean(F.col("flag")).alias("flag"), phrases.digest(said).alias("digest"), phrases.stem(F.col("path")).alias("stem"),
    )


@query("first_items", rf"""WITH w AS ({FIXTURE}), x AS (SELECT doc_id, trim(replace(asked, '（2）、', '2、'), E' \n') AS t FROM w)
SELECT doc_id, 1 AS number, regexp_extract(t, '^([^;；。]*[;；。])', 1) AS item, regexp_replace(t, '^[^;；。]*[;；。]\s*', '') AS rest FROM x""")
def first_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).select("doc_id", F.regexp_replace(F.replace("asked", F.lit("（2）、"), F.lit("2、")), r"\A\s+|\s+\z", "").alias("t"))
    found = phrases.first_numbered(F.replace("t", F.lit("；"), F.lit(";")))
    return rows.select("doc_id", found["number"].alias("number"), F.replace(found["item"], F.lit(";"), F.lit("；")).alias("item"), F.replace(found["rest"], F.lit(";"), F.lit("；")).alias("rest"))


def page_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes as four corners, with scores that are distinct on a page."""
    found = page_boxes(spark, sf_dir)
    return found.select("page_id", "box_id", F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2").cast("array<double>").alias("polygon"), (F.col("score") + F.col("box_id") / 1000).alias("score"))


_ENTRY = "STRUCT(s DOUBLE, k BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE)"
_LAPS = f"{_INTER} > {{0}} * ({_SIZE.format('a')} + {_SIZE.format('b[1]')} - {_INTER})"


def _list_of(fields: str, order: str) -> str:
    return f"list(CAST(ROW({fields}) AS {_ENTRY}) ORDER BY {order})"


@query("suppressed_polygons", f"""WITH {_BOXES}, r AS (SELECT page_id, {_list_of('score + box_id / 1000.0, box_id, x1, y1, x2, y2', 'score + box_id / 1000.0 DESC, box_id')} AS found FROM boxes GROUP BY 1),
folded AS (SELECT page_id, unnest({_FOLD.format(clash=f"len(list_filter(kept, lambda a: {_LAPS.format(0.3)})) > 0", fields='s DOUBLE, k BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE')}) AS b FROM r) SELECT page_id, b.k AS box_id, round(b.s, 6) AS score FROM folded""")
def suppressed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.suppressed(page_polygons(spark, sf_dir), 0.3).select("page_id", "box_id", F.round("score", 6).alias("score"))


_LAST = "kept[len(kept)]"
_MET = _LAPS.format(0.1).replace("a.", f"{_LAST}.")
_MIX = "((b[1].s * b[1].{0} + " + _LAST + ".s * " + _LAST + ".{0}) / (b[1].s + " + _LAST + ".s))"


@query("merged_polygons", f"""WITH {_BOXES}, r AS (SELECT page_id, {_list_of('score + box_id / 1000.0, box_id, x1, y1, x2, y2', 'box_id')} AS found FROM boxes GROUP BY 1),
m AS (SELECT page_id, list_reduce(list_transform(found, lambda x: [x]), lambda kept, b: CASE WHEN {_MET} THEN kept[1:len(kept) - 1] || [CAST(ROW(b[1].s + {_LAST}.s, {_LAST}.k, {', '.join(_MIX.format(c) for c in ('x1', 'y1', 'x2', 'y2'))}) AS {_ENTRY})] ELSE kept || b END) AS merged FROM r),
mo AS (SELECT page_id, list_reverse_sort(list_transform(range(1, len(merged) + 1), lambda i: CAST(ROW(merged[i].s, i, merged[i].x1, merged[i].y1, merged[i].x2, merged[i].y2) AS {_ENTRY}))) AS found FROM m),
folded AS (SELECT page_id, unnest({_FOLD.format(clash=f"len(list_filter(kept, lambda a: {_LAPS.format(0.1)})) > 0", fields='s DOUBLE, k BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE')}) AS b FROM mo) SELECT page_id, b.k AS box_id, round(b.s, 6) AS score, round(b.x1, 4) AS x1, round(b.y2, 4) AS y2 FROM folded""")
def merged_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = polygons.merged_and_suppressed(page_polygons(spark, sf_dir), 0.1)
    return found.select("page_id", "box_id", rounded(F.col("score"), 6).alias("score"), rounded(F.col("polygon")[0], 4).alias("x1"), rounded(F.col("polygon")[5], 4).alias("y2"))


@query("softened_polygons")
def softened_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores decay by what the better ones overlap; tests hold it against a plain version."""
    return polygons.softened(page_polygons(spark, sf_dir), 0.2)
