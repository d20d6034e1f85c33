"""Recognised text boxes put into the cells of a recognised table, by one rule after another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.geometry import Box
from quire.functions.phrases import shared_bold
from quire.functions.structures import spans_merged
from quire.functions.table_tokens import bold_heads, closed, filled, with_new_rows

#: Boxes whose centres lie less than this apart in height share a row.
ROW_HEIGHT = 3


def _rows(found: Column) -> Column:
    """array<array<box>> of boxes in order: each joins the first row whose first box is level with it, or begins one.

    Rows come by the height of their leftmost box, a row's boxes from the left; ties in the order of the boxes.
    """
    one = "struct<box:bigint,x:double,y:double>"

    def step(rows: Column, b: Column) -> Column:
        level = F.transform(rows, lambda r, i: F.when(F.abs(r[0]["y"] - b["y"]) < ROW_HEIGHT, i))
        at = F.array_min(level)
        grown = F.transform(rows, lambda r, i: F.when(i == at, F.concat(r, F.array(b))).otherwise(r))
        return F.when(at.isNotNull(), grown).otherwise(F.concat(rows, F.array(F.array(b))))

    rows = F.aggregate(found, F.array().cast(f"array<array<{one}>>"), step)
    by_x = F.transform(rows, lambda r: F.array_sort(F.transform(r, lambda b, i: F.struct(b["x"].alias("x"), i.alias("i"), b["box"].alias("box"), b["y"].alias("y")))))
    by_y = F.array_sort(F.transform(by_x, lambda r, i: F.struct(r[0]["y"].alias("y"), i.alias("i"), r.alias("r"))))
    return F.transform(by_y, lambda r: F.transform(r["r"], lambda b: b["box"]))


def _found(boxes: DataFrame, cells: DataFrame, page: str, text: Column) -> DataFrame:
    """(page, box_id, cell_id, rule, row_cells, text); see ``matches``.

    Both sides are dealt by page once, or not at all if they come so in equally many tasks: all that follows, windows over
    a page's boxes and cells, stays where it is.  Windows of one order share a sort; pairs of boxes that are settled go
    before cells are looked at.
    """
    corners = ("x1", "y1", "x2", "y2")
    real = cells.where(F.col("x1") + F.col("y1") + F.col("x2") + F.col("y2") != 0)
    nth = F.row_number().over(Window.partitionBy(page).orderBy("box_id")) - 1
    b = real.select(page, nth.cast("long").alias("cell"), F.count(F.lit(1)).over(Window.partitionBy(page)).alias("cells"), *[F.col(c).alias(f"b_{c}") for c in corners])
    a = boxes.select(page, F.col("box_id").cast("long").alias("box"), text.alias("text"), *[F.col(c).alias(f"a_{c}") for c in corners])
    one, two = Box.of("a_"), Box.of("b_")
    (x, y), (bx, by) = one.centre(), two.centre()
    none = F.lit(False)
    pairs = a.join(b, page, "left").select(
        page, "box", "text", "cell", "cells", x.cast("double").alias("x"), y.cast("double").alias("y"), F.coalesce(two.holds(x, y), none).alias("inside"),
        F.when(one.overlaps(two), one.hull_iou(two)).alias("iou"), F.sqrt(((x - bx) * (x - bx) + (y - by) * (y - by)).cast("double")).alias("far"),
    )
    of_box, of_cell = Window.partitionBy(page, "box"), Window.partitionBy(page, "cell")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    by_share = of_box.orderBy(F.desc_nulls_last("iou"), "cell")
    best = pairs.withColumns({"any": F.max("inside").over(by_share.rowsBetween(*whole)), "nth": F.row_number().over(by_share)})
    second = best.withColumn("second", ~F.col("any") & (F.col("iou") > 0) & (F.col("nth") == 1)).withColumn("second", F.coalesce("second", none)).withColumn("box_taken", F.col("any") | F.max("second").over(of_box))
    nearest = of_cell.orderBy("box_taken", "far", "box")
    free = second.where(F.col("inside") | F.col("second") | ~F.col("box_taken")).withColumns({"cell_taken": F.max(F.col("inside") | F.col("second")).over(nearest.rowsBetween(*whole)), "near": F.row_number().over(nearest)})
    third = free.withColumn("third", ~F.col("box_taken") & ~F.col("cell_taken") & F.col("cell").isNotNull() & (F.col("near") == 1))
    ruled = third.withColumn("left", ~F.col("box_taken") & (F.col("nth") == 1))
    rule = F.when(F.col("inside"), 1).when(F.col("second"), 2).when(F.col("third"), 3)
    near, left = F.collect_set(F.when(F.col("third"), F.col("box"))), F.array_sort(F.collect_list(F.when(F.col("left"), F.struct("box", "x", "y"))))
    by_page = ruled.where(rule.isNotNull() | F.col("left")).groupBy(page).agg(
        F.collect_list(F.when(rule.isNotNull(), F.struct("box", "cell", rule.alias("rule"), F.lit(None).cast("int").alias("row_cells"), "text"))).alias("met"),
        F.filter(left, lambda b: ~F.array_contains(near, b["box"])).alias("over"), F.map_from_entries(F.collect_list(F.when(F.col("left"), F.struct("box", "text")))).alias("texts"), F.coalesce(F.max("cells"), F.lit(0)).alias("cells"),
    )
    rows = by_page.select(page, "met", "texts", "cells", _rows(F.col("over")).alias("rows"))
    heads = F.transform("rows", lambda r: F.transform(r, lambda b, i: F.struct(b.alias("box"), F.when(i == 0, F.size(r)).alias("row_cells"))))
    new = F.transform(F.flatten(heads), lambda h, i: F.struct(h["box"].alias("box"), (F.col("cells") + i).cast("long").alias("cell"), F.lit(4).alias("rule"), h["row_cells"].alias("row_cells"), F.try_element_at("texts", h["box"]).alias("text")))
    return rows.select(page, F.inline(F.concat("met", new))).select(page, F.col("box").alias("box_id"), F.col("cell").alias("cell_id"), "rule", "row_cells", "text")


def matches(boxes: DataFrame, cells: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, box, cell, rule, row_cells): which cells take which boxes.

    1: the box's centre is in the cell.  2: of the boxes left, each goes to the cell of largest overlap (of both hulls'
    common one).  3: each cell left takes the nearest box left.  4: boxes left over are dealt in rows to new cells,
    numbered behind the table's own; a row's first box says how many cells it has.  Cells are numbered from 0 by their
    key; cells whose corners add up to zero don't count.  ``boxes`` and ``cells`` have page, box_id and corners, keys
    are distinct within a page, and pages are not null.  A task sorts all pairs of its pages: large tables should come
    dealt by page in tasks of bounded size.
    """
    return _found(boxes, cells, page, F.lit(None).cast("string")).drop("text")


def tables(boxes: DataFrame, cells: DataFrame, tokens: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, html): each table of structure tokens with the texts of its boxes in it and its head in bold.

    ``boxes`` have a text besides, ``tokens`` are (page, tokens).  A cell's texts stand in the order of the rules, then
    of the boxes.  Pages without tokens give nothing; pages without boxes an empty frame of their tokens.
    """
    met = _found(boxes, cells, page, F.coalesce("text", F.lit("")))
    texts = met.groupBy(page, "cell_id").agg(
        F.array_sort(F.collect_list(F.struct("rule", "box_id", "text"))).alias("x"), F.max("row_cells").alias("row_cells")
    ).select(page, "cell_id", "row_cells", shared_bold(F.transform("x", lambda v: v["text"])).alias("text"))
    by_page = texts.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("cell_id").cast("int").alias("cell"), "text", "row_cells"))).alias("x"))
    entry = F.transform("x", lambda v: F.struct(v["cell"].alias("k"), v["text"].alias("v")))
    new = F.transform(F.filter("x", lambda v: v["row_cells"].isNotNull()), lambda v: v["row_cells"])
    read = by_page.select(page, F.map_from_entries(entry).alias("texts"), new.alias("new"))
    joined = tokens.select(page, "tokens").join(read, page, "left")
    none = F.array().cast("array<struct<k:int,v:string>>")
    whole = spans_merged(closed(with_new_rows(F.col("tokens"), F.coalesce("new", F.array().cast("array<int>")))))
    body = bold_heads(filled(whole, F.coalesce("texts", F.map_from_entries(none))))
    return joined.select(page, F.concat(F.lit("<html><body><table>"), body, F.lit("</table></body></html>")).alias("html"))
