"""Operators on boxes of pages: matching, lines, reading order, suppression.

All are keyed by page, so they shuffle once on it; a page's boxes are few, however many pages there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box

_CORNERS = ("x1", "y1", "x2", "y2")


def _sides(left: DataFrame, right: DataFrame, page: str, key: str) -> tuple[DataFrame, DataFrame]:
    a = left.select(page, F.col(key).alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in _CORNERS])
    b = right.select(page, F.col(key).alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in _CORNERS])
    return a, b


def match_regions(boxes: DataFrame, regions: DataFrame, least: float = 0.5, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, box, region, share): each box's region by the largest share of the box inside it, if at least ``least``.

    Ties go to the region with the smaller key.  Boxes without area or region have no row.
    """
    a, b = _sides(boxes, regions, page, key)
    one, two = Box.of("a_"), Box.of("b_")
    pairs = a.join(b, page).where(one.overlaps(two)).withColumn("share", one.intersection(two).cast("double") / one.area().cast("double"))
    best = pairs.groupBy(page, "a_id").agg(F.max(F.struct("share", (-F.col("b_id")).alias("b"))).alias("best"))
    return best.where(F.col("best.share") >= least).select(page, F.col("a_id").alias("box_id"), (-F.col("best.b")).alias("region_id"), F.col("best.share").alias("share"))


def unmatched(boxes: DataFrame, matches: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    return boxes.join(matches.select(page, F.col("box_id").alias(key)), [page, key], "left_anti")


def match_cells(boxes: DataFrame, cells: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, box, cell): the cell of least (1 - IoU, corner distance), ties to the smaller key; every box gets one."""
    a, b = _sides(boxes, cells, page, key)
    one, two = Box.of("a_"), Box.of("b_")
    pairs = a.join(b, page).withColumn("far", F.struct((1 - one.iou(two)).alias("gap"), one.corner_distance(two).alias("distance"), F.col("b_id").alias("cell")))
    return pairs.groupBy(page, "a_id").agg(F.min("far").alias("best")).select(page, F.col("a_id").alias("box_id"), F.col("best.cell").alias("cell_id"))


def centres_inside(boxes: DataFrame, cells: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, box, cell): all pairs where the box's centre lies in the cell, edges included."""
    a, b = _sides(boxes, cells, page, key)
    return a.join(b, page).where(Box.of("b_").holds(*Box.of("a_").centre())).select(page, F.col("a_id").alias("box_id"), F.col("b_id").alias("cell_id"))


def text_lines(boxes: DataFrame, step: int = 20, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """``boxes`` with ``line`` (from 1) and ``nth`` (from 1, by x): a new line starts where the centre drops by ``step`` from the box before."""
    down = Window.partitionBy(page).orderBy("cy", key)
    lined = boxes.withColumn("cy", (F.col("y1") + F.col("y2")) / 2)
    lined = lined.withColumn("gap", F.abs(F.col("cy") - F.lag("cy").over(down)))
    lined = lined.withColumn("line", F.sum(F.when(F.col("gap") < step, 0).otherwise(1)).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    return lined.withColumn("nth", F.row_number().over(Window.partitionBy(page, "line").orderBy("x1", key))).drop("cy", "gap")


def line_texts(lines: DataFrame, text_col: str, char_width: int = 10, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, line, text): a line's texts joined by as many spaces as their gaps allow, at least one."""
    along = Window.partitionBy(page, "line").orderBy("nth")
    gap = F.col("x1") - F.lag("x2").over(along)
    spaces = F.when(F.col("nth") == 1, 0).when(gap > 2 * char_width, F.greatest(F.lit(1), F.floor(gap / char_width / 2).cast("int"))).otherwise(1)
    padded = lines.withColumn("q_spaces", spaces).withColumn("piece", F.concat(F.expr("repeat(' ', q_spaces)"), F.col(text_col)))
    return padded.groupBy(page, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "piece"))), lambda x: x.piece), "").alias("text"))


def suppress(boxes: DataFrame, overlap: float = 0.5, page: str = "page_id", key: str = "box_id", score: str = "score", most: int = 200) -> DataFrame:
    """(page, box): greedy suppression by score, within the ``most`` best of a page; ties to the smaller key.

    A fold over each page's sorted boxes: a box stays if no box that stays overlaps it by more.
    """
    entry = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in _CORNERS])
    ranked = boxes.groupBy(page).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, most).alias("found"))
    area = "(greatest({0}.x2 - {0}.x1, 0D) * greatest({0}.y2 - {0}.y1, 0D))"
    inter = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0D) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0D))"
    clash = f"{inter} > {overlap}D * ({area.format('a')} + {area.format('b')} - {inter})"
    kept = F.expr(f"aggregate(found, slice(found, 1, 0), (kept, b) -> case when exists(kept, a -> {clash}) then kept else concat(kept, array(b)) end)")
    return ranked.select(page, F.explode(kept).alias("b")).select(page, F.col("b.k").alias("box_id"))


def outermost(regions: DataFrame, share: float = 0.95, page: str = "page_id", label: str = "label", key: str = "box_id") -> DataFrame:
    """(page, label, box): regions without those that a larger surviving one of their label covers to ``share``."""
    entry = F.struct((-Box.of().area()).cast("double").alias("s"), F.col(key).alias("k"), *[F.col(c).cast("double").alias(c) for c in _CORNERS])
    ranked = regions.groupBy(page, label).agg(F.array_sort(F.collect_list(entry)).alias("found"))
    inter = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0D) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0D))"
    kept = F.expr(f"aggregate(found, slice(found, 1, 0), (kept, b) -> case when b.s < 0 and exists(kept, a -> {inter} >= {share}D * -b.s) then kept else concat(kept, array(b)) end)")
    return ranked.select(page, label, F.explode(kept).alias("b")).select(page, label, F.col("b.k").alias("box_id"))


def envelope(boxes: DataFrame, *by: str) -> DataFrame:
    return boxes.groupBy(*by).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))
