"""Registered queries of page scores, over true and found texts made from the boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import page_scores
from quire.plans.queries import _BOXES, page_boxes
from quire.plans.registry import registered

QUERIES, SQL, query = registered()

_MID = "SELECT *, CAST(floor((x1 + x2) / 2) AS INT) AS mid, box_id % 5 AS way FROM {o}"
#: True texts: whole ones, some in two halves, some ignored.  Found ones: the same moved, in two halves, joined, somewhere else or missing.
_TRUE = f"""SELECT page_id, box_id * 2 + h AS box_id, CASE WHEN way = 2 AND h = 1 THEN mid + 1 ELSE x1 END AS x1, y1, CASE WHEN way = 2 AND h = 0 THEN mid ELSE x2 END AS x2, y2,
  CASE way WHEN 4 THEN '' ELSE label || CAST(box_id % 3 AS VARCHAR(9)) || ' b' END AS text, way = 4 AS ignored, CASE box_id % 6 WHEN 0 THEN 'other' WHEN 1 THEN 'Answer' ELSE 'question' END AS label
FROM ({_MID}) AS b CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) AS halves WHERE h = 0 OR way = 2"""
_FOUND = f"""SELECT page_id, box_id * 2 + h AS box_id, CASE WHEN way = 1 AND h = 1 THEN mid + 1 WHEN way = 3 THEN x1 + 30 ELSE x1 + CAST(box_id % 4 AS INT) * 3 END AS x1, y1 + 1 AS y1, CASE WHEN way = 1 AND h = 0 THEN mid ELSE x2 + 2 END AS x2, y2 + 1 AS y2,
  CASE box_id % 4 WHEN 0 THEN lower(label) || CAST(box_id % 3 AS VARCHAR(9)) || ' b' WHEN 1 THEN label || 'xy' WHEN 2 THEN ' ' || label || CAST(box_id % 3 AS VARCHAR(9)) || ' b ' ELSE label || CAST(box_id % 3 AS VARCHAR(9)) || ' b' END AS text, CASE box_id % 7 WHEN 0 THEN 'O' WHEN 1 THEN 'ANSWER' ELSE 'Question' END AS label
FROM ({_MID}) AS b CROSS JOIN (SELECT 0 AS h UNION ALL SELECT 1 AS h) AS halves WHERE (h = 0 OR way = 1) AND NOT (way = 3 AND box_id % 2 = 0)"""
_SIDES = f"{_BOXES}, truth0 AS MATERIALIZED ({_TRUE.format(o='o')}), found0 AS MATERIALIZED ({_FOUND.format(o='o')})"
_BOTH = """greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"""
_AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(page_id, box_id, polygon, text, label), true ones with ``ignored``."""
    page_boxes(spark, sf_dir).where("kind = 'O'").createOrReplaceTempView("quire_true_boxes")
    shaped = lambda rows: rows.select(*[c for c in rows.columns if c not in ("x1", "y1", "x2", "y2")], F.array("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2").cast("array<double>").alias("polygon"))
    return tuple(shaped(spark.sql(q.format(o="quire_true_boxes"))) for q in (_TRUE, _FOUND))


_SHARED = _BOTH.format(a="t", b="f")
_OUT = f"out AS (SELECT DISTINCT f.page_id, f.box_id FROM found0 f JOIN truth0 t ON t.page_id = f.page_id AND t.ignored AND {_SHARED} / ({_AREA.format('f')} + {{more}})::DOUBLE > 0.5)"
_COUNTS = f"""{_SIDES}, {_OUT.format(more='1.0')},
ts AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS t FROM truth0 WHERE text <> ''),
fs AS MATERIALIZED (SELECT * REPLACE (trim(text) AS text), row_number() OVER (PARTITION BY page_id ORDER BY box_id) AS f FROM found0 ANTI JOIN out USING (page_id, box_id)),
cells AS MATERIALIZED (SELECT t.page_id, t.t, f.f, round_even({_SHARED} / {_AREA.format('t')}::DOUBLE, 2) AS c, round_even({_SHARED} / {_AREA.format('f')}::DOUBLE, 2) AS p FROM ts t JOIN fs f USING (page_id)),
good AS (SELECT *, sum((c > 0.7)::INT) OVER r AS ct, sum((p > 0.6)::INT) OVER r AS pt, sum((c > 0.7)::INT) OVER d AS cf, sum((p > 0.6)::INT) OVER d AS pf FROM cells WINDOW r AS (PARTITION BY page_id, t), d AS (PARTITION BY page_id, f)),
ones AS (SELECT page_id, t, max(f) FILTER (WHERE c > 0.7) AS f FROM good GROUP BY page_id, t HAVING max(ct) = 1 AND max(pt) = 1 AND max(cf) FILTER (WHERE c > 0.7) = 1 AND max(pf) FILTER (WHERE p > 0.6) = 1),
per AS (SELECT page_id, list(t) AS o1, list(f) AS o2 FROM ones GROUP BY 1),
grid AS MATERIALIZED (
  SELECT page_id, n, m, tt, ft, c, p, coalesce(o1, []) AS o1, coalesce(o2, []) AS o2
  FROM (SELECT page_id, count(*) AS n, list(text ORDER BY t) AS tt FROM ts GROUP BY 1) FULL JOIN (SELECT page_id, count(*) AS m, list(text ORDER BY f) AS ft FROM fs GROUP BY 1) USING (page_id)
  LEFT JOIN (SELECT page_id, list(c ORDER BY t) AS c, list(p ORDER BY t) AS p FROM (SELECT page_id, t, list(c ORDER BY f) AS c, list(p ORDER BY f) AS p FROM cells GROUP BY 1, 2) GROUP BY 1) USING (page_id) LEFT JOIN per USING (page_id)),
folded(page_id, k, lt, lf, r, pr, hits) AS (
  SELECT page_id, 0::BIGINT, list_transform(range(1, n + 1), lambda t: NOT list_contains(o1, t)), list_transform(range(1, m + 1), lambda f: NOT list_contains(o2, f)), len(o1)::DOUBLE, len(o1)::DOUBLE,
    len(list_filter(range(1, len(o1) + 1), lambda i: lower(tt[o1[i]]) = lower(ft[o2[i]])))::BIGINT FROM grid WHERE n > 0 AND m > 0
  UNION ALL
  SELECT page_id, k, CASE WHEN worth > 0 THEN list_transform(lt, lambda x, i: x AND NOT list_contains(gone_t, i)) ELSE lt END, CASE WHEN worth > 0 THEN list_transform(lf, lambda x, i: x AND NOT list_contains(gone_f, i)) ELSE lf END,
    r + worth * len(gone_t), pr + worth * len(gone_f), hits + CASE WHEN worth > 0 AND len(list_filter(gone_t, lambda i: lower(tt[i]) = lower(ft[gone_f[1]]))) > 0 THEN 1 ELSE 0 END
  FROM (
    SELECT *, CASE WHEN k <= n THEN [k] ELSE parts END AS gone_t, CASE WHEN k <= n THEN parts ELSE [k - n] END AS gone_f,
      CASE WHEN NOT ready THEN 0.0 WHEN len(parts) = 1 THEN CASE WHEN k <= n AND c[k][parts[1]] >= 0.7 OR k > n AND p[parts[1]][k - n] >= 0.6 AND c[parts[1]][k - n] >= 0.7 THEN 1.0 ELSE 0.0 END
        WHEN k <= n AND coalesce(list_sum(list_transform(parts, lambda f: c[k][f])), 0) >= 0.7 OR k > n AND coalesce(list_sum(list_transform(parts, lambda t: p[t][k - n])), 0) >= 0.6 THEN 0.8 ELSE 0.0 END::DOUBLE AS worth
    FROM (
      SELECT s.page_id, s.k + 1 AS k, lt, lf, r, pr, hits, n, m, tt, ft, c, p,
        CASE WHEN s.k < n THEN lt[s.k + 1] AND len(list_filter(c[s.k + 1], lambda x: x > 0)) >= 2 ELSE lf[s.k + 1 - n] AND len(list_filter(p, lambda x: x[s.k + 1 - n] > 0)) >= 2 END AS ready,
        CASE WHEN s.k < n THEN list_filter(range(1, m + 1), lambda f: p[s.k + 1][f] >= 0.6 AND lf[f]) ELSE list_filter(range(1, n + 1), lambda t: c[t][s.k + 1 - n] >= 0.6 AND lt[t]) END AS parts
      FROM folded s JOIN grid g ON g.page_id = s.page_id WHERE s.k < n + m))),
counted AS (SELECT page_id, coalesce(n, 0) AS truths, coalesce(m, 0) AS detections, coalesce(r, 0.0) AS recalled, coalesce(pr, 0.0) AS precise, coalesce(hits, 0) AS hits FROM (SELECT DISTINCT page_id FROM truth0 UNION SELECT page_id FROM found0)
  LEFT JOIN grid USING (page_id) LEFT JOIN (SELECT page_id, arg_max(r, k) AS r, arg_max(pr, k) AS pr, arg_max(hits, k) AS hits FROM folded GROUP BY 1) USING (page_id))"""


@query("deteval_counts", f"WITH RECURSIVE {_COUNTS} SELECT page_id, truths, detections, round(recalled, 6) AS recalled, round(precise, 6) AS precise, hits FROM counted")
def deteval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = page_scores.deteval_counts(*sides(spark, sf_dir))
    return got.withColumn("recalled", F.round("recalled", 6)).withColumn("precise", F.round("precise", 6))


@query("deteval_scores", f"""WITH RECURSIVE {_COUNTS}, s AS (SELECT sum(truths)::DOUBLE AS t, sum(detections)::DOUBLE AS d, sum(recalled) AS r, sum(precise) AS p, sum(hits)::DOUBLE AS h FROM counted)
SELECT t::BIGINT AS truths, d::BIGINT AS detections, round(r, 6) AS recalled, h::BIGINT AS hits, round(r / t, 6) AS recall, round(p / d, 6) AS precision, round(2 * (p / d) * (r / t) / (p / d + r / t), 6) AS f_score, round(1 - h / r, 6) AS sequence_error, round(h / t, 6) AS recall_e2e, round(h / d, 6) AS precision_e2e, round(2 * (h / d) * (h / t) / (h / d + h / t), 6) AS f_score_e2e FROM s""")
def deteval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = page_scores.deteval_scores(page_scores.deteval_counts(*sides(spark, sf_dir)))
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in got.dtypes])


_IOU = f"({_SHARED}) / ({_AREA.format('t')} + {_AREA.format('f')} - {_SHARED})::DOUBLE"
_DEALT = "STRUCT(far DOUBLE, t BIGINT, f BIGINT)"


def _matched(truth: str, found: str) -> str:
    """SQL of ``pairs2`` (page_id, t, f): one-to-one, the best first."""
    return f"""met AS (SELECT page_id, list_sort(list(CAST(ROW(-iou, t, f) AS {_DEALT}))) AS x FROM (SELECT t.page_id, t.box_id AS t, f.box_id AS f, {_IOU} AS iou FROM {truth} t JOIN {found} f USING (page_id)) WHERE iou >= 0.5 GROUP BY 1),
pairs2 AS MATERIALIZED (SELECT page_id, b.t AS t, b.f AS f FROM (SELECT page_id, unnest(list_reduce(list_transform(x, lambda v: [v]), lambda kept, b: CASE WHEN len(list_filter(kept, lambda a: a.t = b[1].t OR a.f = b[1].f)) > 0 THEN kept ELSE kept || b END, CAST([] AS {_DEALT}[]))) AS b FROM met))"""


_E2E = f"""{_SIDES}, {_matched('truth0', 'found0')},
lines AS (
  SELECT page_id, CASE WHEN t.text = f.text THEN 1 ELSE 0 END AS hit, 1 AS truth, 1 AS detection, levenshtein(t.text, f.text) AS edits, length(t.text) AS letters FROM (SELECT p.page_id, {{trim}} AS text, p.t, p.f FROM pairs2 p JOIN truth0 x ON x.page_id = p.page_id AND x.box_id = p.t WHERE NOT x.ignored) t JOIN (SELECT page_id, box_id, {{trim}} AS text FROM found0 x) f USING (page_id) WHERE f.box_id = t.f
  UNION ALL SELECT page_id, 0, 1, 0, length(text), length(text) FROM truth0 x WHERE NOT ignored AND NOT EXISTS (SELECT 1 FROM pairs2 p WHERE p.page_id = x.page_id AND p.t = x.box_id)
  UNION ALL SELECT page_id, 0, 0, 1, length(text), 0 FROM found0 x WHERE NOT EXISTS (SELECT 1 FROM pairs2 p WHERE p.page_id = x.page_id AND p.f = x.box_id)),
pages AS (SELECT DISTINCT page_id FROM truth0),
counted AS (SELECT page_id, coalesce(sum(hit), 0)::BIGINT AS hits, coalesce(sum(truth), 0)::BIGINT AS truths, coalesce(sum(detection), 0)::BIGINT AS detections, coalesce(sum(edits), 0)::BIGINT AS edits, coalesce(sum(letters), 0)::BIGINT AS letters FROM pages LEFT JOIN lines USING (page_id) GROUP BY 1)"""
_BLANKLESS = "replace(x.text, ' ', '')"
_TOTALS = """SELECT sum(hits)::BIGINT AS hits, sum(truths)::BIGINT AS truths, sum(detections)::BIGINT AS detections, sum(edits)::BIGINT AS edits, sum(letters)::BIGINT AS letters, round(sum(hits) / (sum(detections) + 1e-9), 6) AS precision, round(sum(hits) / (sum(truths) + 1e-9), 6) AS recall,
  round(2 * (sum(hits) / (sum(detections) + 1e-9)) * (sum(hits) / (sum(truths) + 1e-9)) / (sum(hits) / (sum(detections) + 1e-9) + sum(hits) / (sum(truths) + 1e-9) + 1e-9), 6) AS f_score, round(1 - sum(edits) / (sum(letters) + 1e-9), 6) AS character_accuracy, round(sum(edits) / (sum(truths) + 1e-9), 6) AS edits_per_text,
  round(sum(edits) / {pages}, 6) AS edits_per_page FROM counted"""


@query("end_to_end_counts", f"WITH {_E2E.format(trim='x.text')} SELECT * FROM counted")
def end_to_end_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scores.end_to_end_counts(*sides(spark, sf_dir))


def _totals(counts: DataFrame, truth: DataFrame) -> DataFrame:
    pages = truth.select("page_id").distinct().count()
    got = page_scores.end_to_end_scores(counts, pages)
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in got.dtypes])


@query("end_to_end_scores", f"WITH {_E2E.format(trim=_BLANKLESS)} {_TOTALS.format(pages='(SELECT count(*) FROM pages)')}")
def end_to_end_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without blanks."""
    truth, found = sides(spark, sf_dir)
    return _totals(page_scores.end_to_end_counts(truth, found, blanks=False), truth)


_KIE = f"""{_SIDES}, named_t AS MATERIALIZED (SELECT * REPLACE (upper(label) AS label) FROM truth0 WHERE upper(label) NOT IN ('O', 'OTHER', 'OTHERS') AND page_id IN (SELECT page_id FROM found0)), named_f AS MATERIALIZED (SELECT * REPLACE (upper(label) AS label) FROM found0 WHERE upper(label) NOT IN ('O', 'OTHER', 'OTHERS')),
{_matched('named_t', 'named_f')},
lines AS (
  SELECT p.page_id, CASE WHEN t.text = f.text AND t.label = f.label THEN 1 ELSE 0 END AS hit, 1 AS truth, 1 AS detection, levenshtein(lower(t.text), lower(f.text)) AS edits, length(t.text) AS letters FROM pairs2 p JOIN named_t t ON t.page_id = p.page_id AND t.box_id = p.t JOIN named_f f ON f.page_id = p.page_id AND f.box_id = p.f
  UNION ALL SELECT page_id, 0, 1, 0, length(text), length(text) FROM named_t x WHERE NOT EXISTS (SELECT 1 FROM pairs2 p WHERE p.page_id = x.page_id AND p.t = x.box_id)
  UNION ALL SELECT page_id, 0, 0, 1, length(text), 0 FROM named_f x WHERE NOT EXISTS (SELECT 1 FROM pairs2 p WHERE p.page_id = x.page_id AND p.f = x.box_id)),
counted AS (SELECT page_id, sum(hit)::BIGINT AS hits, sum(truth)::BIGINT AS truths, sum(detection)::BIGINT AS detections, sum(edits)::BIGINT AS edits, sum(letters)::BIGINT AS letters FROM lines GROUP BY 1)"""


@query("labelled_scores", f"WITH {_KIE} {_TOTALS.format(pages='(SELECT count(DISTINCT page_id) FROM truth0)')}")
def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with labels, in any case of letters."""
    truth, found = sides(spark, sf_dir)
    return _totals(page_scores.labelled_counts(truth, found, case=False), truth)


@query("polygon_counts", f"""WITH {_SIDES}, {_OUT.format(more='0')}, care AS (SELECT * FROM truth0 WHERE NOT ignored), got AS (SELECT * FROM found0 ANTI JOIN out USING (page_id, box_id)),
met AS (SELECT page_id, list_sort(list(CAST(ROW(0, t, f) AS {_DEALT}))) AS x FROM (SELECT t.page_id, t.box_id AS t, f.box_id AS f FROM care t JOIN got f USING (page_id) WHERE {_IOU} > 0.5) GROUP BY 1),
folded AS (SELECT page_id, len(list_reduce(list_transform(x, lambda v: [v]), lambda kept, b: CASE WHEN len(list_filter(kept, lambda a: a.t = b[1].t OR a.f = b[1].f)) > 0 THEN kept ELSE kept || b END, CAST([] AS {_DEALT}[]))) AS matched FROM met)
SELECT page_id, coalesce(max(matched), 0)::BIGINT AS matched, count(*) FILTER (WHERE side = 1) AS truths, count(*) FILTER (WHERE side = 2) AS detections FROM (SELECT page_id, 0 AS side FROM truth0 UNION ALL SELECT page_id, 0 FROM found0 UNION ALL SELECT page_id, 1 FROM care UNION ALL SELECT page_id, 2 FROM got) LEFT JOIN folded USING (page_id) GROUP BY page_id""")
def polygon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_scores.polygon_counts(*sides(spark, sf_dir))
