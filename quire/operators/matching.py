"""Rules that give boxes to cells, all keyed by page: largest overlap, least distance, virtual cells, joined texts, thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.functions.phrases import shared_bold
from quire.operators.boxes import _sides


def overlap_rule(boxes: DataFrame, cells: DataFrame, page: str = "page_id", key: str = "box_id", hull: bool = False) -> DataFrame:
    """(page, box, cell, iou): each box's cell of largest IoU, the first of equals; boxes that meet none have no row.

    ``hull`` measures the intersection against the convex hull of both instead of their union.
    """
    a, b = _sides(boxes, cells, page, key)
    one, two = Box.of("a_"), Box.of("b_")
    met = a.join(b, page).where(one.overlaps(two)).withColumn("x", F.struct((one.hull_iou(two) if hull else one.iou(two)).alias("iou"), (-F.col("b_id")).alias("cell")))
    return met.groupBy(page, "a_id").agg(F.max("x").alias("x")).select(page, F.col("a_id").alias("box_id"), (-F.col("x.cell")).alias("cell_id"), F.col("x.iou").alias("iou"))


def distance_rule(boxes: DataFrame, cells: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, cell, box, distance): for each cell the box whose centre is nearest to its own, the first of equals."""
    a, b = _sides(boxes, cells, page, key)
    (ax, ay), (bx, by) = Box.of("a_").centre(), Box.of("b_").centre()
    far = F.sqrt(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)).cast("double"))
    return a.join(b, page).groupBy(page, F.col("b_id").alias("cell_id")).agg(F.min(F.struct(far.alias("distance"), F.col("a_id").alias("box_id"))).alias("x")).select(page, "cell_id", "x.box_id", "x.distance")


def virtual_cells(unmatched: DataFrame, cells: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, box, cell): boxes that no cell took, in order of their key, each with a new cell numbered behind the page's own."""
    counts = cells.groupBy(page).agg(F.count(F.lit(1)).alias("cells"))
    nth = F.row_number().over(Window.partitionBy(page).orderBy(key)) - 1
    return unmatched.withColumn("nth", nth).join(counts, page, "left").select(page, F.col(key).alias("box_id"), (F.coalesce("cells", F.lit(0)) + F.col("nth")).cast("long").alias("cell_id"))


def cell_texts(matches: DataFrame, texts: DataFrame, page: str = "page_id", between: str = " ") -> DataFrame:
    """(page, cell, boxes, text): the cells' boxes in order, and their texts joined (one bold text if all are bold)."""
    met = matches.join(texts, [page, "box_id"])
    found = met.groupBy(page, "cell_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "text"))).alias("x"))
    return found.select(page, "cell_id", F.transform("x", lambda v: v["box_id"]).alias("boxes"), shared_bold(F.transform("x", lambda v: v["text"]), between).alias("text"))


def covered_share(boxes: DataFrame, regions: DataFrame, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, box, region, share): overlapping pairs with the part of the region that the box covers; regions without area have none."""
    a, b = _sides(boxes, regions, page, key)
    one, two = Box.of("a_"), Box.of("b_")
    return a.join(b, page).where(one.overlaps(two) & (two.area() > 0)).select(page, F.col("a_id").alias("box_id"), F.col("b_id").alias("region_id"), (one.intersection(two).cast("double") / two.area().cast("double")).alias("share"))


