"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import forms, geometry, text
from quire.functions.geometry import Box
from quire.operators import boxes, layout, metrics, records, sequences

EVENTS = ("view", "click", "signup", "purchase", "error")
_EVENTS_SQL = "list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) - 1"
RULES = [("licence", "Licensed", 3.0), ("licence", "License", 2.0), ("legal", "copyright", 3.0), ("table", " | ", 2.0), ("table", "|", 1.0), ("marks", "***", 2.0), ("marks", "%%%", 2.0), ("shout", "!!", 3.0)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_boxes(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Order lines as boxes on pages, dealt by page to ``tasks`` if given."""
    line = _read(spark, sf_dir, "lineitem")
    x1, y1 = (F.col("l_partkey") * 7) % 600, (F.col("l_suppkey") * 13 + F.col("l_linenumber") * 37) % 400
    paged = line.withColumn("page_id", F.expr("l_orderkey div 4"))
    placed = (paged.repartition(tasks, "page_id") if tasks else paged).withColumn("x1", x1).withColumn("y1", y1)
    order = Window.partitionBy("page_id").orderBy("y1", "x1", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    return placed.select(
        "page_id", F.row_number().over(order).cast("long").alias("box_id"), "x1", "y1", (F.col("x1") + 40 + F.col("l_quantity").cast("int") * 4).alias("x2"), (F.col("y1") + 20 + F.col("l_linenumber") * 2).alias("y2"),
        (F.col("l_discount") * 10).alias("score"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("kind"),
    )


_BOXES = """boxes AS MATERIALIZED (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY y1, x1, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS box_id,
    x1, y1, x1 + 40 + CAST(l_quantity AS INT) * 4 AS x2, y1 + 20 + l_linenumber * 2 AS y2, l_discount * 10 AS score, l_returnflag AS label, l_linestatus AS kind
  FROM (SELECT l_orderkey // 4 AS page_id, (l_partkey * 7) % 600 AS x1, (l_suppkey * 13 + l_linenumber * 37) % 400 AS y1, * FROM lineitem)
), f AS MATERIALIZED (SELECT * FROM boxes WHERE kind = 'F'), o AS MATERIALIZED (SELECT * FROM boxes WHERE kind = 'O')"""
_PAIRS = """pairs AS (
  SELECT f.page_id, f.box_id AS box_id, o.box_id AS other,
    greatest(least(f.x2, o.x2) - greatest(f.x1, o.x1), 0) * greatest(least(f.y2, o.y2) - greatest(f.y1, o.y1), 0) AS inter,
    (f.x2 - f.x1) * (f.y2 - f.y1) AS fa, (o.x2 - o.x1) * (o.y2 - o.y1) AS oa,
    abs(f.x1 - o.x1) + abs(f.y1 - o.y1) AS d1, abs(f.x2 - o.x2) + abs(f.y2 - o.y2) AS d2,
    (f.x1 + f.x2) / 2.0 AS cx, (f.y1 + f.y2) / 2.0 AS cy, o.x1 AS ox1, o.y1 AS oy1, o.x2 AS ox2, o.y2 AS oy2
  FROM f JOIN o ON f.page_id = o.page_id)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = page_boxes(spark, sf_dir)
    return found.where("kind = 'F'"), found.where("kind = 'O'")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_position(F.array(*map(F.lit, EVENTS)), F.col("event_type")) - 1
    return _read(spark, sf_dir, "events").withColumn("id", ids)


def whole_text_pairs(docs: DataFrame, chunk: int = 1024) -> DataFrame:
    """(source, t, next): each document's whole text and that of its source's next document.

    Windows are over chunks of ids, so a large source is many groups; each chunk's last text meets the first of
    the source's next chunk.
    """
    rows = docs.select("source", "doc_id", F.expr(f"doc_id div {chunk}").alias("chunk"), F.coalesce("text", F.lit("")).alias("t"))
    inside = rows.withColumn("next", F.lead("t").over(Window.partitionBy("source", "chunk").orderBy("doc_id", "t")))
    ends = rows.groupBy("source", "chunk").agg(F.max(F.struct("doc_id", "t")).alias("last"), F.min(F.struct("doc_id", "t")).alias("first"))
    across = ends.select("source", F.col("last.t").alias("t"), F.lead("first.t").over(Window.partitionBy("source").orderBy("chunk")).alias("next"))
    return inside.select("source", "t", "next").unionByName(across).where("next is not null")


def line_pairs(docs: DataFrame) -> DataFrame:
    """(source, t, next): the lines of each document and those in the same places of its source's next one, whole."""
    both = whole_text_pairs(docs).select("source", F.split("t", "\n").alias("a"), F.split("next", "\n").alias("b"))
    places = F.sequence(F.lit(1), F.least(F.size("a"), F.size("b")))
    return both.select("source", "a", "b", F.explode(places).alias("i")).select("source", F.expr("a[i - 1]").alias("t"), F.expr("b[i - 1]").alias("next"))


# DuckDB's edit distance is one of bytes: for it, each letter of the tables' languages is a control character of its own.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CONTROLS = "".join(map(chr, (*range(1, 9), *range(14, 27))))
_LINE_PAIRS = f"""docs AS (SELECT doc_id, source, string_split(translate(coalesce(text, ''), '{_LETTERS}', '{_CONTROLS}'), chr(10)) AS a FROM documents),
two AS (SELECT source, a, lead(a) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM docs), pairs AS (SELECT source, unnest(a[1:len(b)]) AS t, unnest(b[1:len(a)]) AS next FROM two WHERE b IS NOT NULL)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@_query("match_regions", f"""WITH {_BOXES}, {_PAIRS}, ranked AS (
  SELECT page_id, box_id, other AS region_id, CAST(inter AS DOUBLE) / fa AS share, row_number() OVER (PARTITION BY page_id, box_id ORDER BY CAST(inter AS DOUBLE) / fa DESC, other) AS n FROM pairs WHERE inter > 0)
SELECT page_id, box_id, region_id, share FROM ranked WHERE n = 1 AND share >= 0.5""")
def match_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.match_regions(*_sides(spark, sf_dir))


@_query("unmatched_boxes", f"""WITH {_BOXES}, {_PAIRS}
SELECT f.page_id, f.box_id FROM f ANTI JOIN (SELECT page_id, box_id FROM pairs WHERE CAST(inter AS DOUBLE) / fa >= 0.5) p ON p.page_id = f.page_id AND p.box_id = f.box_id""")
def unmatched_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, regions = _sides(spark, sf_dir)
    return boxes.unmatched(found, boxes.match_regions(found, regions)).select("page_id", "box_id")


@_query("match_cells", f"""WITH {_BOXES}, {_PAIRS}
SELECT page_id, box_id, cell_id FROM (SELECT page_id, box_id, other AS cell_id,
  row_number() OVER (PARTITION BY page_id, box_id ORDER BY 1 - CAST(inter AS DOUBLE) / CAST(fa + oa - inter AS DOUBLE), d1 + d2 + least(d1, d2), other) AS n FROM pairs) WHERE n = 1""")
def match_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.match_cells(*_sides(spark, sf_dir))


@_query("centres_inside", f"WITH {_BOXES}, {_PAIRS} SELECT page_id, box_id, other AS cell_id FROM pairs WHERE cx BETWEEN ox1 AND ox2 AND cy BETWEEN oy1 AND oy2")
def centres_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.centres_inside(*_sides(spark, sf_dir))


_LINES = """lined AS (
  SELECT *, sum(CASE WHEN gap < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY cy, box_id ROWS UNBOUNDED PRECEDING) AS line
  FROM (SELECT *, abs(cy - lag(cy) OVER (PARTITION BY page_id ORDER BY cy, box_id)) AS gap FROM (SELECT *, (y1 + y2) / 2.0 AS cy FROM boxes))
), numbered AS (SELECT *, row_number() OVER (PARTITION BY page_id, line ORDER BY x1, box_id) AS nth FROM lined)"""


@_query("text_lines", f"WITH {_BOXES}, {_LINES} SELECT page_id, box_id, CAST(line AS BIGINT) AS line, CAST(nth AS INT) AS nth FROM numbered")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.text_lines(page_boxes(spark, sf_dir)).select("page_id", "box_id", "line", "nth")


@_query("line_texts", f"""WITH {_BOXES}, {_LINES}, spaced AS (
  SELECT *, x1 - lag(x2) OVER (PARTITION BY page_id, line ORDER BY nth) AS room FROM numbered)
SELECT page_id, CAST(line AS BIGINT) AS line, string_agg(repeat(' ', CAST(CASE WHEN nth = 1 THEN 0 WHEN room > 20 THEN greatest(1, floor(room / 10.0 / 2)) ELSE 1 END AS INT)) || label, '' ORDER BY nth) AS text FROM spaced GROUP BY page_id, line""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.line_texts(boxes.text_lines(page_boxes(spark, sf_dir)), "label")


@_query("page_envelopes", f"WITH {_BOXES} SELECT page_id, label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes GROUP BY page_id, label")
def page_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.envelope(page_boxes(spark, sf_dir), "page_id", "label")


@_query("scaled_boxes", f"""WITH {_BOXES} SELECT page_id, box_id, x1 * 1000 // 900 AS x1, y1 * 1000 // 500 AS y1, x2 * 1000 // 900 AS x2, y2 * 1000 // 500 AS y2 FROM boxes""")
def scaled_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = Box.of().scaled(F.lit(900), F.lit(500))
    return page_boxes(spark, sf_dir).select("page_id", "box_id", box.x1.alias("x1"), box.y1.alias("y1"), box.x2.alias("x2"), box.y2.alias("y2"))


@_query("polygon_areas", f"WITH {_BOXES} SELECT page_id, box_id, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area FROM boxes")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_boxes(spark, sf_dir).select("page_id", "box_id", F.abs(geometry.polygon_area(F.transform(Box.of().corners(), lambda p: F.transform(p, lambda v: v.cast("double"))))).alias("area"))


@_query("collapsed_sequences", f"""WITH s AS (SELECT user_id, ts, {_EVENTS_SQL} AS id, value, lag({_EVENTS_SQL}) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT user_id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts) AS ids, round(avg(value), 6) AS confidence FROM s WHERE (before IS NULL OR before <> id) AND id <> 0 GROUP BY user_id""")
def collapsed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sequences.collapse_rows(_events(spark, sf_dir), "user_id", "ts", "id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", F.col("id").cast("string").alias("id")))), lambda x: x["id"])
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(ids, ",").alias("ids"), F.round(F.avg("value"), 6).alias("confidence"))


@_query("label_runs", f"""WITH s AS (SELECT user_id, ts, {_EVENTS_SQL} AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS spot, lag({_EVENTS_SQL}) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
g AS (SELECT *, sum(CASE WHEN before = id THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT user_id, CAST(run AS BIGINT) AS run, id, min(spot) AS first, count(*) AS n, min(spot) + count(*) // 2 AS middle FROM g GROUP BY user_id, run, id""")
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.runs(_events(spark, sf_dir), "user_id", "ts", "id")


@_query("rolling_median", "SELECT user_id, ts, round(median(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS median FROM events")
def rolling_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.rolling_median(_read(spark, sf_dir, "events"), "user_id", "ts", "value", 20).select("user_id", "ts", F.round("median", 6).alias("median"))


@_query("majority_label", f"""WITH c AS (SELECT user_id, {_EVENTS_SQL} AS id, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, id, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, id) AS r FROM c) WHERE r = 1""")
def majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.majority(_events(spark, sf_dir), ["user_id"], "id")


@_query("recognition_scores", f"""WITH {_LINE_PAIRS}
SELECT source, count(*) AS n, count(*) FILTER (WHERE t = next) AS correct, count(*) FILTER (WHERE t = next) / (count(*) + 1e-5) AS acc,
  round(1 - sum(CASE WHEN greatest(length(t), length(next)) = 0 THEN 0.0 ELSE levenshtein(t, next) / CAST(greatest(length(t), length(next)) AS DOUBLE) END) / (count(*) + 1e-5), 6) AS similarity FROM pairs GROUP BY source""")
def recognition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.whole_text_recognition(line_pairs(_read(spark, sf_dir, "documents")), "t", "next", "source").withColumn("similarity", F.round("similarity", 6))


@_query("whole_text_scores")
def whole_text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recognition_scores on whole texts as they are, in one piece each."""
    docs = _read(spark, sf_dir, "documents")
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-docs.count() // 1024))
    pairs = whole_text_pairs(docs).repartition(tasks)  # time goes by the square of a text's length, not by bytes
    return metrics.whole_text_recognition(pairs, "t", "next", "source").withColumn("similarity", F.round("similarity", 6))


@_query("class_scores", """WITH c AS (SELECT quality AS p, toxic AS t FROM labels),
k AS (SELECT DISTINCT p AS class FROM c UNION SELECT DISTINCT t FROM c),
s AS (SELECT class, (SELECT count(*) FROM c WHERE p = class AND t = class) AS hits, (SELECT count(*) FROM c WHERE p = class) AS predicted, (SELECT count(*) FROM c WHERE t = class) AS truth FROM k)
SELECT class, hits, predicted, truth, CASE WHEN hits = 0 THEN 0.0 ELSE 2 * (hits / CAST(greatest(predicted, 1) AS DOUBLE)) * (hits / CAST(greatest(truth, 1) AS DOUBLE)) / (hits / CAST(greatest(predicted, 1) AS DOUBLE) + hits / CAST(greatest(truth, 1) AS DOUBLE)) END AS f1 FROM s""")
def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_scores(_read(spark, sf_dir, "labels"), "quality", "toxic")


@_query("class_accuracy", "SELECT lang, count(*) FILTER (WHERE quality = toxic) AS correct, count(*) AS n, count(*) FILTER (WHERE quality = toxic) / (count(*) + 1e-5) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(_read(spark, sf_dir, "labels").join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "quality", "toxic", "lang")


@_query("relation_scores", """WITH e AS (SELECT user_id, event_type AS tail, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS head, day(ts) AS d FROM events),
r AS (SELECT DISTINCT user_id, head, tail, d % 2 AS odd FROM e WHERE head IS NOT NULL),
m AS (SELECT user_id, head, tail, max(odd) AS p, max(1 - odd) AS t FROM r GROUP BY user_id, head, tail),
s AS (SELECT user_id, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM m GROUP BY user_id),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM s)
SELECT user_id, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, p, r, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM q""")
def relation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts")
    found = _read(spark, sf_dir, "events").select("user_id", F.lag("event_type").over(by).alias("head"), F.col("event_type").alias("tail"), (F.dayofmonth("ts") % 2).alias("odd")).where("head is not null")
    return metrics.relations(found.where("odd = 1"), found.where("odd = 0"), ["user_id", "head", "tail"], "user_id")


@_query("vector_psnr", """WITH p AS (SELECT a.vec_id, a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
x AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM p WHERE b IS NOT NULL),
m AS (SELECT vec_id, sum((CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) * (CAST(a AS DOUBLE) - CAST(b AS DOUBLE))) / count(*) AS mse FROM x GROUP BY vec_id)
SELECT vec_id, round(20 * log10(255.0 / sqrt(mse)), 6) AS psnr FROM m""")
def vector_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = table.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return table.join(after, "vec_id").select("vec_id", F.round(metrics.peak_signal(F.col("embedding"), F.col("b")), 6).alias("psnr"))


@_query("class_centres", "SELECT label, spot, round(avg(CAST(v AS DOUBLE)), 9) AS centre, count(*) AS n FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS spot FROM embeddings) GROUP BY label, spot")
def class_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("spot", "v"))
    return parts.groupBy("label", "spot").agg(F.round(F.avg(F.col("v").cast("double")), 9).alias("centre"), F.count(F.lit(1)).alias("n"))


_DEALT = "md5('5:' || CAST(doc_id AS VARCHAR)), doc_id"


@_query("sampled_documents", f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_DEALT}) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE nth <= round(n * 0.3)")
def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.sampled(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 0.3, 5)


@_query("split_documents", f"""SELECT doc_id, CASE WHEN share < 0.6 THEN 'train' WHEN share < 0.8 THEN 'val' ELSE 'test' END AS part
FROM (SELECT doc_id, (row_number() OVER (PARTITION BY source ORDER BY {_DEALT}) - 1) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS share FROM documents)""")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.split(_read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", (6, 2, 2), 5).select("doc_id", "part")


@_query("ratio_batches", f"""WITH {_BOXES}, b AS (SELECT page_id, box_id, label, (x2 - x1) / CAST(y2 - y1 AS DOUBLE) AS ratio, (row_number() OVER (PARTITION BY label ORDER BY (x2 - x1) / CAST(y2 - y1 AS DOUBLE), page_id, box_id) - 1) // 6 AS batch FROM boxes)
SELECT page_id, box_id, label, batch, round(avg(ratio) OVER (PARTITION BY label, batch), 6) AS mean_ratio FROM b""")
def ratio_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = page_boxes(spark, sf_dir).withColumn("ratio", (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")).cast("double")).select("page_id", "box_id", "label", "ratio")
    return sequences.batched(sized, ["ratio", "page_id", "box_id"], 6, "ratio", "label").select("page_id", "box_id", "label", "batch", F.round("mean_ratio", 6).alias("mean_ratio"))


@_query("last_value_records", "SELECT user_id, event_type, arg_max(props, ts) AS props FROM events GROUP BY user_id, event_type")
def last_value_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.last_wins(_read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "props"), ["user_id", "event_type"], "ts", "props")


@_query("lines_without_repeats", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY nth) AS before FROM l)
SELECT doc_id, nth, line FROM b WHERE before IS NULL OR before <> line""")
def lines_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.without_repeats(records.lines(_read(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "nth", "line")


@_query("html_token_counts", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*[^>]*>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, '^</?[a-zA-Z][a-zA-Z0-9]*') || '>' AS token, count(*) AS n FROM t GROUP BY 1, 2""")
def html_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(records.html_tokens(F.col("html"))).alias("token")).groupBy("page_id", "token").agg(F.count(F.lit(1)).alias("n"))


_BLOCK_TAGS = r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table)\b[^>]*>"
_PLAIN_HTML = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '{_BLOCK_TAGS}', chr(10), 'g'), '(?i)</t[dh]>', chr(9), 'g'), '<[^>]+>', ' ', 'g')"
for _entity, _plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _PLAIN_HTML = f"replace({_PLAIN_HTML}, '{_entity}', '{_plain}')"


@_query("html_texts", f"""WITH l AS (SELECT page_id, list_filter(list_transform(string_split({_PLAIN_HTML}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '') AS kept FROM pages)
SELECT page_id, coalesce(array_to_string(list_filter(kept, lambda x, i: i = 1 OR kept[i - 1] <> x), chr(10)), '') AS text FROM l""")
def html_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", records.html_text(F.col("html")).alias("text"))


@_query("suffixed_names", """SELECT user_id, ts, CASE WHEN n = 0 THEN event_type ELSE event_type || '_' || n END AS unique_name
FROM (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) - 1 AS n FROM events)""")
def suffixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.suffixed(_read(spark, sf_dir, "events"), "user_id", "ts", "event_type").select("user_id", "ts", "unique_name")


def _contains(word: str, weight: float) -> str:
    return f"CASE WHEN contains(text, '{word}') THEN {weight} ELSE 0.0 END"


_TYPES = list(dict.fromkeys(t for t, _, _ in RULES))
_SCORES = " UNION ALL ".join(f"SELECT doc_id, {i} AS i, '{t}' AS type, CAST({' + '.join(_contains(w, v) for k, w, v in RULES if k == t)} AS DOUBLE) AS score FROM documents" for i, t in enumerate(_TYPES))


@_query("classified_documents", f"""WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM s),
w AS (SELECT a.doc_id, a.type, a.score, b.score AS next FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.n = 1 AND b.n = 2)
SELECT doc_id, CASE WHEN score >= 3 THEN type ELSE 'unknown' END AS type, score, round(CASE WHEN score >= 3 THEN least(0.99, CAST(0.55 AS DOUBLE) + score / 30 + (score - next) / 50) ELSE 0.25 END, 6) AS confidence FROM w""")
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.classified(_read(spark, sf_dir, "documents"), RULES, "doc_id", "text")


@_query("alphanumeric_texts", "SELECT doc_id, lower(regexp_replace(text, '[^0-9A-Za-z]', '', 'g')) AS plain FROM documents")
def alphanumeric_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", text.alphanumeric(F.col("text")).alias("plain"))


@_query("escaped_texts", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS safe FROM pages""")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", text.escaped(F.col("html")).alias("safe"))


_NEAR = """met AS (SELECT a.page_id, a.box_id AS a, b.box_id AS b, (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
FROM boxes a JOIN boxes b ON a.page_id = b.page_id AND a.box_id < b.box_id AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
e AS (SELECT page_id, a, b FROM met WHERE i / CAST(s - i AS DOUBLE) >= 0.3)"""


@_query("linked_boxes", f"""WITH RECURSIVE {_BOXES}, {_NEAR}, d AS (SELECT page_id, a, b FROM e UNION ALL SELECT page_id, b, a FROM e),
r AS (SELECT page_id, a AS node, a AS seen FROM d UNION SELECT r.page_id, r.node, d.b FROM r JOIN d ON d.page_id = r.page_id AND d.a = r.seen)
SELECT page_id, node, min(seen) AS root FROM r GROUP BY page_id, node""")
def linked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda p: page_boxes(spark, sf_dir).select("page_id", *[F.col(c).alias(f"{p}{c}") for c in ("box_id", "x1", "y1", "x2", "y2")])
    one, two = Box.of("a_"), Box.of("b_")
    met = side("a_").join(side("b_"), "page_id").where((F.col("a_box_id") < F.col("b_box_id")) & one.overlaps(two)).where(one.iou(two) >= 0.3)
    return layout.linked_groups(met.select("page_id", F.col("a_box_id").alias("a"), F.col("b_box_id").alias("b")))


@_query("pair_geometry", f"""WITH {_BOXES}, s AS MATERIALIZED (SELECT *, x2 - x1 + 1 AS w, greatest(y2 - y1 + 1, 1) AS h FROM boxes)
SELECT a.page_id, a.box_id AS a_box_id, b.box_id AS b_box_id, round((b.x1 - a.x1) / 10.0::DOUBLE, 6) AS dx, round((b.y1 - a.y1) / 10.0::DOUBLE, 6) AS dy, round(a.w / a.h::DOUBLE, 6) AS aspect, round(b.h / a.h::DOUBLE, 6) AS height_ratio, round(b.w / a.h::DOUBLE, 6) AS width_ratio
FROM s a JOIN s b ON a.page_id = b.page_id""")
def pair_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.pair_geometry(page_boxes(spark, sf_dir))
    return out.select("page_id", "a_box_id", "b_box_id", *[F.round(c, 6).alias(c) for c in ("dx", "dy", "aspect", "height_ratio", "width_ratio")])


@_query("reading_order", f"""WITH {_BOXES}, r AS (SELECT page_id, list_sort(list(CAST(ROW(y1, x1, box_id) AS STRUCT(y BIGINT, x BIGINT, k BIGINT)))) AS found FROM boxes GROUP BY page_id),
placed AS (SELECT page_id, list_reduce(list_transform(found, lambda v: [v]), lambda s, b: s[1:coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN abs(b[1].y - s[i].y) < 10 AND b[1].x < s[i].x THEN 0 ELSE i END)), 0)] || b || s[coalesce(list_max(list_transform(range(1, len(s) + 1), lambda i: CASE WHEN abs(b[1].y - s[i].y) < 10 AND b[1].x < s[i].x THEN 0 ELSE i END)), 0) + 1:]) AS ordered FROM r)
SELECT page_id, unnest(ordered).k AS box_id, CAST(unnest(range(0, len(ordered))) AS INT) AS nth FROM placed""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reading_order(page_boxes(spark, sf_dir))


@_query("key_values", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM documents),
c AS (SELECT doc_id, nth, trim(line) AS line, regexp_extract(trim(line), '^([^:;：；]*)[:;：；]((?s:.+))$', ['k', 'v']) AS f FROM l),
p AS (SELECT doc_id, nth, regexp_replace(trim(CASE WHEN f.v <> '' THEN f.k ELSE line END), '[:：;；\\s]+$', '') AS key, CASE WHEN f.v <> '' THEN trim(f.v) ELSE '' END AS value FROM c)
SELECT doc_id, CAST(nth AS INTEGER) AS nth, key, value FROM p WHERE key <> ''""")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records.lines(_read(spark, sf_dir, "documents"), "doc_id", "text")
    # exploding has each line read once, where a filter and two fields would read it three times
    found = F.filter(F.array(forms.key_value(F.col("line"), F.lit(""))), lambda f: f.isNotNull())
    return rows.select("doc_id", "nth", F.explode(found).alias("f")).select("doc_id", "nth", "f.key", "f.value")
