"""Line dedup without Python: range-partitioned line hashes, first occurrences, keep bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SPACE_CHARS, ascii_lower, own_rows, row_key, scratch, spread_join

#: Parts into which the occurrences of one line are dealt while its documents are counted.
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """A row for each line long enough: 128 hash bits of its key, its document and its place."""
    line = (
        docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line"))
        .select("id", "rk", "pos", F.btrim("line", F.lit(SPACE_CHARS)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .withColumn("key", ascii_lower(F.col("line")))
    )
    return line.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(5), F.col("key")).alias("h2"), "id", "rk", "pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Which lines of each document stay, as compressed bitmaps: (id, rk, words).

    ``words`` is an array of (word, drop): bit b of ``drop`` says that line 64*word+b goes; words without a bit
    are left out, and documents that lose nothing have no row.  A line goes if its key (stripped of ASCII white
    space, A-Z lower-cased) has at least ``min_chars`` code points, is in at least ``min_docs`` documents, and
    its document isn't the one with the largest id among them.

    Lines' hashes are range-partitioned together with a salt made of the document, sorted by document and place
    within each range, and streamed: the first line of a key in a document counts that document.  Counts of the
    salted parts are added up, and the lines of very frequent keys meet those counts by broadcast, so no task ever
    holds all of a frequent line.
    """
    found = scratch(_occurrences(docs, id_col, text_col, min_chars), "lines")
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    by_doc = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("id").desc(), "pos")
    first = F.when(F.row_number().over(by_doc) == 1, 1).when(F.lag("id").over(by_doc).eqNullSafe(F.col("id")), 0).otherwise(1)
    held = (
        salted.repartitionByRange("h1", "h2", "salt")
        .withColumn("first", first)
        .groupBy("h1", "h2")
        .agg(F.sum("first").alias("n"), F.max("id").alias("last"), F.count(F.lit(1)).alias("lines"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "last", "lines")
    )
    goes = spread_join(found, scratch(held, "held"), ["h1", "h2"], "lines").where(~F.col("id").eqNullSafe(F.col("last")))
    bits = goes.groupBy("id", "rk", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
    return bits.groupBy("id", "rk").agg(F.array_sort(F.collect_list(F.struct("word", "drop"))).alias("words"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as a struct ``q_own``, with ``q_text``, ``q_lines``, ``q_kept`` (what stays) and ``q_dropped`` (a count)."""
    keyed = own_rows(docs, q_id=F.col(id_col), q_text=F.col(text_col), q_rk=row_key(F.col(id_col), F.col(text_col)))
    marks = bitmaps.select(F.col("id").alias("q_id2"), F.col("rk").alias("q_rk2"), F.col("words").alias("q_words"))
    joined = keyed.join(marks.hint("shuffle_hash"), (F.col("q_rk") == F.col("q_rk2")) & F.col("q_id").eqNullSafe(F.col("q_id2")), "left")
    # one bit word for each 64 lines, then a look-up by place
    dense = F.expr("transform(sequence(0, cast((size(q_lines) - 1) div 64 as int)), w -> coalesce(try_element_at(map_from_entries(q_words), w), 0L))")
    kept = F.expr("array_join(filter(q_lines, (line, i) -> shiftright(q_dense[cast(i div 64 as int)], i % 64) & 1L = 0), '\\n')")
    return (
        joined.withColumn("q_lines", _lines(F.col("q_text")))
        .withColumn("q_dense", F.when(F.col("q_words").isNotNull(), dense))
        .withColumn("q_kept", F.when(F.col("q_words").isNull(), F.coalesce(F.col("q_text"), F.lit(""))).otherwise(kept))
        .withColumn("q_dropped", F.coalesce(F.expr("aggregate(q_words, 0L, (n, w) -> n + bit_count(w.drop))"), F.lit(0).cast("long")))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """``docs`` with their text cut down to the lines that stay; other columns, of any name, as they were.

    A null text stays null.  A document all of whose lines go has an empty text.  An empty table gives an empty
    table; equal rows lose equal lines; rows without id are one document.
    """
    out = with_bitmaps(docs, keep_bitmaps(docs, id_col, text_col, **limits), id_col, text_col)
    text = F.when(F.col("q_text").isNotNull(), F.col("q_kept"))
    return out.select(*[text.alias(c) if c == text_col else F.col("q_own").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """A row for each document: lines before, lines dropped and the SHA-256 of what stays; see ``dedup_lines``."""
    out = with_bitmaps(docs.select(id_col, text_col), keep_bitmaps(docs, id_col, text_col, **limits), id_col, text_col)
    return out.select(F.col("q_id").alias(id_col), F.size("q_lines").cast("long").alias("n_lines"), F.col("q_dropped").alias("n_dropped"), F.sha2(F.col("q_kept").cast("binary"), 256).alias("kept_sha256"))
