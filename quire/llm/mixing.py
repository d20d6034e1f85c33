"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch, words_of

#: Bits of a document's place in its source's order, and bits of each of the two histograms over them.
PLACE_BITS, STEP_BITS = 48, 12
#: Sources up to which the plan is broadcast; beyond, it is joined by a skew-aware shuffle.
BROADCAST_SOURCES = 10_000


def place(id_col: str, seed: int) -> Column:
    """A document's seeded place in [0, 2**48): its digits come from MD5, which any engine has."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Water-filling over (source, source_size): adds ``target`` (double).

    Sources in code point order, null last, weigh ``weights`` in turn.  In order of the level at which they
    fill up, a source is clamped at ``epochs`` times its size if its share of what the clamped ones before it
    leave would exceed that; the first that fits gives the level of all others.  The table has a row for each
    source, so the running sums see no document.
    """
    ranked = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * epochs)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    level = (
        ranked.withColumn("used", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("rest_weight", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("used")).cast("double") / F.col("rest_weight").cast("double"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap").cast("double"))
        .withColumn("nth", F.row_number().over(order))
    )
    first = F.min(F.when(F.col("open"), F.struct("nth", "level"))).over(whole)
    chosen = level.withColumn("first", first)
    target = F.when(F.col("first").isNull() | (F.col("nth") < F.col("first.nth")), F.col("cap").cast("double")).otherwise(F.col("first.level") * F.col("weight"))
    return chosen.select("source", "source_size", target.alias("target"))


def _narrow(sizes: DataFrame, plan: DataFrame, low: int, name: str) -> DataFrame:
    """Adds to each source's plan the histogram cell in which its fractional repetition ends, and what is left there."""
    cell = F.shiftright("place", low).bitwiseAND((1 << STEP_BITS) - 1)
    cells = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("cell")) - F.col("n")  # at most 2**STEP_BITS rows each
    held = _with_plan(cells.withColumn("before", before), plan.select("source", "rest")).where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    found = held.select(F.col("source").alias("s"), F.col("cell").alias(name), (F.col("rest") - F.col("before")).alias("left"))
    joined = plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.withColumn("rest", F.coalesce("left", "rest")).drop("s", "left")


def _with_plan(rows: DataFrame, plan: DataFrame, broadcast: bool = False) -> DataFrame:
    named = plan.withColumnRenamed("source", "q_source")
    return rows.join(F.broadcast(named) if broadcast else named, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), place(id_col, seed).alias("place"))


def mixture(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> tuple[DataFrame, bool]:
    """The plan: a row for each source with its target, whole repetitions, and where its fractional one ends.

    Documents stand in seeded order within their source; the fractional repetition takes them in that order
    until its words are used up.  Two histograms of 4096 cells find the end to one part in 16 million, so
    only the documents of one cell are ever put in order.
    """
    totals = scratch(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    quota = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0).cast("long"))
    plan = targets(totals, weights, epochs).withColumn("whole", whole).withColumn("rest", quota - F.col("whole") * F.col("source_size"))
    plan = scratch(_narrow(sizes, plan, PLACE_BITS - STEP_BITS, "cell1"), "plan1")
    few = plan.count() <= BROADCAST_SOURCES
    within = _with_plan(sizes, plan.select("source", "cell1"), few).where(F.shiftright("place", PLACE_BITS - STEP_BITS) == F.col("cell1")).drop("cell1")
    return scratch(_narrow(within, plan, PLACE_BITS - 2 * STEP_BITS, "cell2"), "plan2"), few


def taken(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """``rows`` (with id, source, size, place) with ``whole``, ``part`` (words of the fractional repetition) and the targets."""
    planned = _with_plan(rows, plan, few)
    high = F.shiftright("place", PLACE_BITS - 2 * STEP_BITS)
    end = F.when(F.col("cell1").isNull(), F.lit(-1).cast("long")).otherwise(F.col("cell1") * (1 << STEP_BITS) + F.coalesce("cell2", F.lit(-1)))
    planned = planned.withColumn("q_side", F.signum((high - end).cast("double")).cast("int"))
    clear = planned.where(F.col("q_side") != 0).withColumn("part", F.when(F.col("q_side") < 0, F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("source").orderBy("place", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    edge = planned.where(F.col("q_side") == 0).withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    return clear.unionByName(edge).drop("q_side", "cell1", "cell2", "rest")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 11) -> DataFrame:
    """The mixed corpus: each document as often as the mix takes it, with the columns of ``docs``.

    The one document of a source at which the fractional repetition ends comes with its first words only, joined
    by single spaces.  Documents without words take no part; a null text counts as one, a null source is a source
    of its own.  Equal rows are documents of their own; an empty table gives an empty one.
    """
    sizes = scratch(sized(docs, id_col, text_col, source_col, seed), "sizes")
    plan, few = mixture(sizes, weights, epochs)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("q_row")
    rows = docs.select(own, F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words_of(F.col(text_col))).cast("long").alias("size"), place(id_col, seed).alias("place"))
    found = taken(rows.where(F.col("size") > 0), plan, few)
    lengths = F.concat(F.array_repeat(F.col("size"), F.col("whole").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    text = F.col(f"q_row.`{text_col}`")
    copies = found.select("q_row", "size", F.explode(lengths).alias("length"))
    cut = F.when(F.col("length") == F.col("size"), text).otherwise(F.array_join(F.slice(words_of(text), F.lit(1), F.col("length").cast("int")), " "))
    return copies.select(*[cut.alias(c) if c == text_col else F.col(f"q_row.`{c}`").alias(c) for c in docs.columns])


def shares(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 11) -> DataFrame:
    """A row for each document: its size, its source's size and target, and how many of its words the mix takes."""
    sizes = scratch(sized(docs, id_col, text_col, source_col, seed), "sizes")
    plan, few = mixture(sizes, weights, epochs)
    found = taken(sizes, plan, few)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))
