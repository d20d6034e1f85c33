"""Relations of boxes on a page: reading order, pairwise geometry, groups of linked boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reading_order(boxes: DataFrame, step: int = 10, first_stays: bool = False, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, key, nth from 0): from top to bottom, boxes less than ``step`` apart from left to right.

    Boxes come by (y1, x1, key); each moves up past neighbours that lie right of it and within ``step``.
    ``first_stays`` keeps the topmost box in its place.  The fold is over the boxes of one page.
    """
    found = boxes.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("y1").alias("y"), F.col("x1").alias("x"), F.col(key).alias("k")))).alias("found"))
    least = 1 if first_stays else 0
    spot = f"greatest(least({least}, size(s)), coalesce(array_max(transform(s, (b, i) -> if(abs(x.y - b.y) < {step} and x.x < b.x, 0, i + 1))), 0))"
    ordered = F.expr(f"aggregate(found, slice(found, 1, 0), (s, x) -> concat(slice(s, 1, {spot}), array(x), slice(s, {spot} + 1, size(s))))")
    return found.select(page, F.posexplode(ordered).alias("nth", "b")).select(page, F.col("b.k").alias(key), "nth")


def pair_geometry(boxes: DataFrame, norm: float = 10.0, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """Every ordered pair of a page: offsets over ``norm``, the first's aspect, and the second's sizes over its height."""
    side = lambda p: boxes.select(page, *[F.col(c).alias(f"{p}{c}") for c in (key, "x1", "y1", "x2", "y2")])
    size = lambda p: (F.col(f"{p}x2") - F.col(f"{p}x1") + 1, F.greatest(F.col(f"{p}y2") - F.col(f"{p}y1") + 1, F.lit(1)))
    (aw, ah), (bw, bh) = size("a_"), size("b_")
    return side("a_").join(side("b_"), page).select(
        page, f"a_{key}", f"b_{key}", ((F.col("b_x1") - F.col("a_x1")) / norm).alias("dx"), ((F.col("b_y1") - F.col("a_y1")) / norm).alias("dy"),
        (aw / ah).alias("aspect"), (bh / ah).alias("height_ratio"), (bw / ah).alias("width_ratio"),
    )


def linked_groups(edges: DataFrame, page: str = "page_id", a: str = "a", b: str = "b") -> DataFrame:
    """(page, node, root): boxes that edges join, directly or not, under their smallest; boxes without edges are left out.

    A page's edges are folded one by one: the larger of two labels gives way to the smaller.
    """
    found = edges.groupBy(page).agg(F.collect_set(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))).alias("e"))
    nodes = found.withColumn("n", F.expr("transform(array_distinct(concat(e.a, e.b)), v -> struct(v as node, v as label))"))
    label = "filter(s, v -> v.node = x.{0})[0].label"
    one, two = label.format("a"), label.format("b")
    folded = F.expr(f"aggregate(e, n, (s, x) -> transform(s, v -> struct(v.node as node, if(v.label = greatest({one}, {two}), least({one}, {two}), v.label) as label)))")
    return nodes.select(page, F.explode(folded).alias("v")).select(page, "v.node", F.col("v.label").alias("root"))
