"""Annotated forms: two public layouts of nested JSON read as rows of boxes with links, and written as label lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators.layout import reading_order

WORDS = "array<struct<box:array<double>,text:string>>"
FORM = f"form array<struct<id:bigint,text:string,label:string,words:{WORDS},linking:array<array<bigint>>>>"
DOCUMENTS = "documents array<struct<img:struct<fname:string>,document:array<struct<id:bigint,text:string,label:string,box:array<double>,linking:array<array<bigint>>>>>>"
ANNOTATION = "array<struct<transcription:string,label:string,points:array<array<double>>,id:bigint,linking:array<array<bigint>>>>"
#: A word that begins this far before the end of the one before it is on a new line; boxes less than that apart in height are level.
BACK, LEVEL = 10, 20


def _corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(F.array(x1, y1), F.array(x2, y1), F.array(x2, y2), F.array(x1, y2))


def word_lines(words: Column) -> Column:
    """array<words>: a form entry's words cut where the next one goes back; lines whose first word is empty are left out."""

    def step(lines: Column, w: Column) -> Column:
        last = F.element_at(lines, -1)
        back = w["box"][0] + BACK <= F.element_at(last, -1)["box"][2]
        return F.when((F.size(lines) == 0) | back, F.concat(lines, F.array(F.array(w)))).otherwise(F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat(last, F.array(w)))))

    return F.filter(F.aggregate(words, F.array().cast(f"array<{WORDS}>"), step), lambda line: line[0]["text"] != "")


def word_forms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, anns) of files with a ``form`` whose entries hold words: one annotation for each line of an entry's words.

    Annotations are numbered anew in the order of entries and lines, and come in reading order.  A link joins all
    lines of its two entries; links to entries without lines are left out, as are entries without text or words.
    ``path`` is the file's name as an image's.  A file that doesn't parse, or has no such entry, has no row.
    """
    read = spark.read.schema(FORM).option("multiLine", "true").json(paths)
    name = F.concat(F.regexp_replace(F.substring_index(F.col("_metadata.file_path"), "/", -1), r"\.json\z", ""), F.lit(".png"))
    entries = read.select(name.alias("path"), F.posexplode("form").alias("nth", "e")).where(F.col("e.text").isNotNull() & (F.size("e.words") > 0))
    lines = entries.select("path", "nth", F.col("e.id").alias("old"), F.col("e.label").alias("label"), F.col("e.linking").alias("linking"), F.posexplode(word_lines(F.col("e.words"))).alias("line", "words"))
    edge = lambda k, of: of(F.transform("words", lambda w: w["box"][k]))
    new = (F.row_number().over(Window.partitionBy("path").orderBy("nth", "line")) - 1).cast("bigint")
    found = lines.select(
        "path", new.alias("id"), "old", "label", "linking", F.array_join(F.transform("words", lambda w: F.coalesce(w["text"], F.lit(""))), " ").alias("transcription"),
        edge(0, F.array_min).alias("x1"), edge(1, F.array_min).alias("y1"), edge(2, F.array_max).alias("x2"), edge(3, F.array_max).alias("y2"),
    )
    ids = found.groupBy("path", "old").agg(F.array_sort(F.collect_list("id")).alias("ids")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("old", "ids"))).alias("ids"))
    pairs = F.flatten(F.transform("linking", lambda x: F.flatten(F.transform(F.try_element_at("ids", x[0]), lambda a: F.transform(F.try_element_at("ids", x[1]), lambda b: F.array(a, b))))))
    known = F.filter(F.col("linking"), lambda x: F.map_contains_key("ids", x[0]) & F.map_contains_key("ids", x[1]))
    linked = found.join(ids, "path").withColumn("linking", F.coalesce(known, F.array().cast("array<array<bigint>>"))).withColumn("linking", pairs)
    placed = linked.join(reading_order(found, LEVEL, True, "path", "id"), ["path", "id"])
    annotation = F.struct("nth", "transcription", "label", _corners(*map(F.col, ("x1", "y1", "x2", "y2"))).alias("points"), "id", "linking")
    gathered = placed.groupBy("path").agg(F.array_sort(F.collect_list(annotation)).alias("a"))
    return gathered.select("path", F.transform("a", lambda a: F.struct(*[a[c].alias(c) for c in ("transcription", "label", "points", "id", "linking")])).alias("anns"))


def boxed_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, anns) of files with ``documents`` whose entries have one box each, in their order; ids and links stay."""
    found = spark.read.schema(DOCUMENTS).json(paths).select(F.explode("documents").alias("d"))
    box = lambda e: _corners(*[e["box"][k] for k in range(4)])
    return found.select(F.col("d.img.fname").alias("path"), F.transform("d.document", lambda e: F.struct(e["text"].alias("transcription"), e["label"].alias("label"), box(e).alias("points"), e["id"].alias("id"), e["linking"].alias("linking"))).alias("anns"))


def write_form_lines(rows: DataFrame, path: str) -> None:
    """(path, anns) to ``path<TAB>json`` lines."""
    rows.select(F.concat_ws("\t", "path", F.to_json("anns")).alias("value")).write.text(path)


def form_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, anns) of such lines; a line that doesn't parse has null annotations."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(paths).select(F.get(parts, F.lit(0)).alias("path"), F.from_json(F.get(parts, F.lit(1)), ANNOTATION).alias("anns"))
