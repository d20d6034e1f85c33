"""Label sequences: collapsing, runs, encoding, batching, sampling and splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.graphs import kept


def collapsed(ids: Column, scores: Column, ignored: tuple[int, ...] = (0,), merge: bool = True) -> Column:
    """Array form: struct(ids, score) of a sequence without repeats and ignored ids; score is the kept ones' mean, 0 for none."""
    pairs = F.arrays_zip(ids.alias("i"), scores.alias("s"))
    stays = F.filter(F.transform(pairs, lambda p, k: F.struct(p["i"].alias("i"), p["s"].alias("s"), (F.lit(False) if not merge else (k > 0) & (F.get(ids, k - 1) == p["i"])).alias("again"))), lambda p: ~p["again"] & ~p["i"].isin(*ignored))
    total = F.aggregate(stays, F.lit(0.0), lambda a, p: a + p["s"])
    return F.struct(F.transform(stays, lambda p: p["i"]).alias("ids"), F.when(F.size(stays) > 0, total / F.size(stays)).otherwise(F.lit(0.0)).alias("score"))


def collapse_rows(rows: DataFrame, key: str, order: str, label: str, blank: int = 0) -> DataFrame:
    """Row form: rows whose label differs from the one before in their sequence and isn't blank."""
    by = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("q_before", F.lag(label).over(by)).where((F.col("q_before").isNull() | (F.col("q_before") != F.col(label))) & (F.col(label) != blank)).drop("q_before")


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(key, run, label, first, n, middle): maximal runs of equal labels; places count from 0."""
    by = Window.partitionBy(key).orderBy(order)
    marked = rows.withColumn("q_at", F.row_number().over(by) - 1).withColumn("q_new", F.when(F.lag(label).over(by) == F.col(label), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("q_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    found = numbered.groupBy(key, "run", label).agg(F.min("q_at").alias("first"), F.count(F.lit(1)).alias("n"))
    return found.withColumn("middle", F.col("first") + F.expr("n div 2"))


def rolling_median(rows: DataFrame, key: str, order: str, value: str, width: int) -> DataFrame:
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(1 - width, 0)
    return rows.withColumn("median", F.expr(f"percentile({value}, 0.5)").over(frame))


def majority(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """The most frequent label of each group; ties to the smallest."""
    counts = rows.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col(label)).alias("l"))).alias("x")).select(*by, (-F.col("x.l")).alias(label), F.col("x.n").alias("n"))


def encoded(text: Column, alphabet: str, length: int, first: int = 1, pad: int = 0, begin: int | None = None, end: int | None = None, unknown: int | None = None) -> Column:
    """Ids of a text's characters, padded to ``length``; null for empty, too long, or wholly unknown texts.

    ``first`` is the alphabet's first id; marks for the begin, the end and unknown characters are optional.
    """
    known = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i + first)])
    ids = F.filter(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(known, c), F.lit(unknown).cast("int"))), lambda i: i.isNotNull())
    ints = lambda x: F.array() if x is None else F.array(F.lit(x))
    whole = F.concat(ints(begin).cast("array<int>"), ids, ints(end).cast("array<int>"))
    return F.when((F.length(text) > 0) & (F.length(text) <= length) & (F.size(ids) > 0) & (F.size(whole) <= length), F.concat(whole, F.array_repeat(F.lit(pad), length - F.size(whole))))


def decoded(ids: Column, alphabet: str, first: int = 1, stop: int | None = None) -> Column:
    """Text of ids; ids outside the alphabet are passed over, ``stop`` ends it."""
    letters = F.array(*map(F.lit, alphabet))
    upto = ids if stop is None else F.when(F.array_contains(ids, stop), F.slice(ids, F.lit(1), (F.array_position(ids, stop) - 1).cast("int"))).otherwise(ids)
    return F.array_join(F.transform(F.filter(upto, lambda i: i.between(first, first + len(alphabet) - 1)), lambda i: letters[i - first]), "")


def batched(rows: DataFrame, order: list[str], size: int, ratio: str, by: str) -> DataFrame:
    """``rows`` with ``batch`` (from 0, within ``by``) and the batch's mean ratio.

    Rows are dealt by ranges of their place and written with the range's number; they are counted inside a range and
    ranges are added up, so that a value of ``by`` is spread over as many tasks.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = kept(rows.repartitionByRange(tasks, by, *order).withColumn("q_range", F.spark_partition_id()))
    counts = placed.groupBy(F.col(by).alias("q_by"), F.col("q_range").alias("q_at")).agg(F.count(F.lit(1)).alias("q_rows"))
    before = F.coalesce(F.sum("q_rows").over(Window.partitionBy("q_by").orderBy("q_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = counts.select("q_by", "q_at", before.alias("q_before"))
    nth = F.row_number().over(Window.partitionBy(by, "q_range").orderBy(*order)) - 1
    numbered = placed.withColumn("q_nth", nth).join(F.broadcast(ranges), F.col(by).eqNullSafe(F.col("q_by")) & (F.col("q_range") == F.col("q_at")))
    numbered = numbered.withColumn("batch", F.floor((F.col("q_before") + F.col("q_nth")) / size).cast("long")).drop("q_by", "q_at", "q_before", "q_nth", "q_range")
    return numbered.withColumn("mean_ratio", F.avg(ratio).over(Window.partitionBy(by, "batch")))


def _dealt(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def ranked(rows: DataFrame, source: str, key: str, seed: int) -> DataFrame:
    """``rows`` with ``q_nth`` (from 1) and ``q_n``: a row's place in its source's seeded order, and the source's rows.

    The order's first 12 bits cut each source into 4096 cells; places are counted inside a cell and cells are added
    up, so a source of any size is spread over as many tasks.
    """
    keyed = rows.withColumn("q_cell", F.conv(F.substring(_dealt(key, seed), 1, 3), 16, 10).cast("int"))
    by = Window.partitionBy("q_source")
    counts = keyed.groupBy(F.col(source).alias("q_source"), F.col("q_cell").alias("q_cell2")).agg(F.count(F.lit(1)).alias("q_rows"))
    before = F.coalesce(F.sum("q_rows").over(by.orderBy("q_cell2").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.withColumn("q_before", before).withColumn("q_n", F.sum("q_rows").over(by))
    met = keyed.join(cells, F.col(source).eqNullSafe(F.col("q_source")) & (F.col("q_cell") == F.col("q_cell2")))
    inside = F.row_number().over(Window.partitionBy(source, "q_cell").orderBy(_dealt(key, seed), key))
    return met.withColumn("q_nth", F.col("q_before") + inside).drop("q_cell", "q_cell2", "q_source", "q_rows", "q_before")


def sampled(rows: DataFrame, source: str, key: str, ratio: float, seed: int) -> DataFrame:
    """round(n * ratio) rows of each source, the first in a seeded order that no partitioning changes."""
    return ranked(rows, source, key, seed).where(F.col("q_nth") <= F.round(F.col("q_n") * ratio)).drop("q_nth", "q_n")


def split(rows: DataFrame, source: str, key: str, parts: tuple[int, int, int], seed: int) -> DataFrame:
    """``rows`` with ``part``: train, val or test by a row's place in its source's seeded order against cumulated shares."""
    share, total = (F.col("q_nth") - 1) / F.col("q_n"), sum(parts)
    part = F.when(share < parts[0] / total, "train").when(share < (parts[0] + parts[1]) / total, "val").otherwise("test")
    return ranked(rows, source, key, seed).withColumn("part", part).drop("q_nth", "q_n")
