"""Label files: readers with explicit schemas and the writers that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "array<struct<transcription:string, points:array<array<double>>, label:string, difficult:boolean, score:double>>"
TABLE = "filename string, html struct<structure:struct<tokens:array<string>>, cells:array<struct<tokens:array<string>, bbox:array<double>>>>"
#: Transcriptions that mark a box to be ignored.
IGNORED = ("*", "###")


def detection_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, anns, error): ``path<TAB>json`` lines; a line that doesn't parse keeps its text in ``error``."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(paths).select(F.get(parts, F.lit(0)).alias("path"), F.from_json(F.get(parts, F.lit(1)), ANNOTATION).alias("anns"), "value")
    return rows.select("path", "anns", F.when(F.col("anns").isNull(), F.col("value")).alias("error"))


def annotations(rows: DataFrame) -> DataFrame:
    """(path, nth, text, points, ignored): one row for each annotated box."""
    return rows.select("path", F.posexplode("anns").alias("nth", "a")).select("path", "nth", F.col("a.transcription").alias("text"), F.col("a.points").alias("points"), F.col("a.transcription").isin(*IGNORED).alias("ignored"))


def recognition_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, label); a path that is a JSON list gives one of its entries, chosen by the line's hash."""
    parts = F.split("value", "\t", 2)
    listed = F.from_json(F.get(parts, F.lit(0)), "array<string>")
    path = F.when(F.get(parts, F.lit(0)).startswith("["), F.get(listed, F.pmod(F.xxhash64("value"), F.size(listed)).cast("int"))).otherwise(F.get(parts, F.lit(0)))
    return spark.read.text(paths).select(path.alias("path"), F.get(parts, F.lit(1)).alias("label"))


def sized_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, label, ratio) of lines that end in width and height."""
    parts = F.split("value", "\t")
    return spark.read.text(paths).select(parts[0].alias("path"), parts[1].alias("label"), (parts[2].cast("double") / parts[3].cast("double")).alias("ratio"))


def tables(spark: SparkSession, paths: str | list[str], most_tokens: int | None = None) -> DataFrame:
    """(filename, tokens, cells) of JSON lines; nested columns that a query doesn't use aren't parsed."""
    rows = spark.read.schema(TABLE).json(paths).select("filename", F.col("html.structure.tokens").alias("tokens"), F.col("html.cells").alias("cells"))
    return rows if most_tokens is None else rows.where(F.size("tokens").between(1, most_tokens))


def write_detection_lines(rows: DataFrame, path: str) -> None:
    """(path, anns) back to ``path<TAB>json`` lines."""
    rows.select(F.concat_ws("\t", "path", F.to_json("anns")).alias("value")).write.text(path)


def crops(rows: DataFrame) -> DataFrame:
    """(crop, text): names of the crops of all boxes that aren't difficult."""
    flat = rows.select("path", F.posexplode("anns").alias("nth", "a")).where(~F.coalesce(F.col("a.difficult"), F.lit(False)))
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*\z", "")
    return flat.select(F.format_string("crop_img/%s_crop_%d.jpg", name, F.col("nth")).alias("crop"), F.col("a.transcription").alias("text"))
