"""Pixels dealt to quads by predicted centres, and outlines from Fourier coefficients."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import let


def nearest_quads(pixels: DataFrame, quads: DataFrame, least: float, page: str = "page_id") -> DataFrame:
    """(page, x, y, quad): the quad whose centre is nearest to where a pixel says its text's centre is.

    ``pixels`` are (page, x, y, score, dx, dy): those above ``least`` point at (x - dx, y - dy).  ``quads`` are (page,
    quad, points); a centre is the points' mean.  Of quads as near the first counts.  A page's quads come as one array,
    as they are few; pixels stay where they are but for a join on the page.  Pages without quads have no rows.
    """
    mean = lambda k: F.aggregate(F.transform("points", lambda p: p[k].cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size("points")
    centres = quads.where(F.size("points") > 0).groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col("quad"), mean(0).alias("x"), mean(1).alias("y")))).alias("centres"))
    met = pixels.where(F.col("score") > least).join(centres, page)
    px, py = F.col("x") - F.col("dx"), F.col("y") - F.col("dy")
    far = lambda c: (px - c["x"]) * (px - c["x"]) + (py - c["y"]) * (py - c["y"])
    nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(far(c).alias("far"), i.alias("i"), c["quad"].alias("quad"))))
    return met.select(page, "x", "y", nearest["quad"].alias("quad"))


def fourier_outline(real: Column, imaginary: Column, points: int = 50) -> Column:
    """array<int> x, y, x, y, ...: ``points`` places of the outline whose coefficients stand in the order -k to k; fractions are cut off.

    A point is the sum of all coefficients turned by their frequency.  ``points`` is at least as many as coefficients.
    """
    n = F.size(real)
    k = ((n - 1) / 2).cast("int")
    turns = F.sequence(F.lit(0), F.lit(points - 1))

    def at(t: Column) -> Column:
        angle = lambda i: F.lit(2 * math.pi / points) * F.pmod((i - k) * t, F.lit(points))
        terms = F.zip_with(F.transform(real, lambda v, i: F.struct(v.cast("double").alias("a"), F.cos(angle(i)).alias("c"), F.sin(angle(i)).alias("s"))), imaginary, lambda p, b: F.struct((p["a"] * p["c"] - b * p["s"]).alias("x"), (p["a"] * p["s"] + b * p["c"]).alias("y")))
        total = lambda ts, c: F.aggregate(ts, F.lit(0.0), lambda s, v: s + v[c]).cast("int")
        return let(terms, lambda ts: F.array(total(ts, "x"), total(ts, "y")))

    return F.when(n > 0, F.flatten(F.transform(turns, at)))
