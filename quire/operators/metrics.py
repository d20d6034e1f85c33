"""Scores of predictions: additive counters first, ratios last, so that partial aggregation does the work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import alphanumeric, edit_distance, similarity


def ratio(part: Column, whole: Column, eps: float = 0.0) -> Column:
    """part / (whole + eps), zero where that is zero."""
    return F.when(whole + eps == 0, F.lit(0.0)).otherwise(part.cast("double") / (whole.cast("double") + eps))


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def accuracy(rows: DataFrame, predicted: str, target: str, *by: str, eps: float = 1e-5) -> DataFrame:
    got = rows.groupBy(*by).agg(F.count_if(F.col(predicted) == F.col(target)).alias("correct"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("acc", ratio(F.col("correct"), F.col("n"), eps))


def recognition(rows: DataFrame, predicted: str, target: str, *by: str, plain: bool = False, spaces: bool = True, eps: float = 1e-5) -> DataFrame:
    """(n, correct, acc, similarity): exact matches and mean edit similarity, on request of ASCII alphanumerics or without spaces."""
    a, b = F.col(predicted), F.col(target)
    if not spaces:
        a, b = F.replace(a, F.lit(" "), F.lit("")), F.replace(b, F.lit(" "), F.lit(""))
    if plain:
        a, b = alphanumeric(a), alphanumeric(b)
    got = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(a == b).alias("correct"), F.sum(1 - similarity(a, b)).alias("distance"))
    return got.select(*by, "n", "correct", ratio(F.col("correct"), F.col("n"), eps).alias("acc"), (1 - ratio(F.col("distance"), F.col("n"), eps)).alias("similarity"))


def whole_text_recognition(rows: DataFrame, predicted: str, target: str, by: str, eps: float = 1e-5) -> DataFrame:
    """What ``recognition`` gives, of texts of any length: the cost is that of a 64th of the edit table.  Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            far = [edit_distance(a, b) / max(len(a), len(b), 1) for a, b in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a == b for a, b in pairs], pa.bool_()), pa.array(far, pa.float64())], names=[by, "same", "far"])

    kind = rows.schema[by].dataType.simpleString()
    texts = rows.select(by, *[F.coalesce(c, F.lit("")).alias(n) for c, n in ((predicted, "a"), (target, "b"))])
    got = texts.mapInArrow(run, f"{by} {kind}, same boolean, far double").groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("correct"), F.sum("far").alias("distance"))
    return got.select(by, "n", "correct", ratio(F.col("correct"), F.col("n"), eps).alias("acc"), (1 - ratio(F.col("distance"), F.col("n"), eps)).alias("similarity"))


def class_scores(rows: DataFrame, predicted: str, target: str) -> DataFrame:
    """(class, hits, predicted, truth, f1) of a confusion table; counts below one count as one."""
    cells = rows.groupBy(F.col(predicted).alias("p"), F.col(target).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.col("p").alias("class"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("hits"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("truth"))
    sides = sides.unionByName(cells.select(F.col("t").alias("class"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("predicted"), F.col("n").alias("truth")))
    got = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "truth")])
    p, r = F.col("hits") / F.greatest("predicted", F.lit(1)), F.col("hits") / F.greatest("truth", F.lit(1))
    return got.withColumn("f1", harmonic(p, r))


def relations(predicted: DataFrame, truth: DataFrame, key: list[str], by: str) -> DataFrame:
    """(by, tp, fp, fn, p, r, f1) of two sets of tuples."""
    sides = predicted.select(*key).distinct().withColumn("p", F.lit(1)).unionByName(truth.select(*key).distinct().withColumn("t", F.lit(1)), allowMissingColumns=True)
    met = sides.groupBy(*key).agg(F.coalesce(F.max("p"), F.lit(0)).alias("p"), F.coalesce(F.max("t"), F.lit(0)).alias("t"))
    got = met.groupBy(by).agg(F.sum(F.col("p") * F.col("t")).alias("tp"), F.sum(F.col("p") * (1 - F.col("t"))).alias("fp"), F.sum((1 - F.col("p")) * F.col("t")).alias("fn"))
    got = got.withColumn("p", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("r", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return got.withColumn("f1", harmonic(F.col("p"), F.col("r")))


def detection(counters: DataFrame, *by: str) -> DataFrame:
    """From per-page counters (matched, truths, detections) to precision, recall and their harmonic mean."""
    got = counters.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("matched", "truths", "detections")])
    got = got.withColumn("precision", ratio(F.col("matched"), F.col("detections"))).withColumn("recall", ratio(F.col("matched"), F.col("truths")))
    return got.withColumn("hmean", harmonic(F.col("precision"), F.col("recall")))


def peak_signal(a: Column, b: Column, peak: float = 255.0) -> Column:
    """PSNR of two arrays; infinite for equal ones."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    mse = squares / F.size(a)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(peak / F.sqrt(mse)))


def greedy_matches(boxes: DataFrame, truth: Column, least: float = 0.5, page: str = "page_id", key: str = "box_id") -> DataFrame:
    """(page, matched, truths, detections): one-to-one matches in (truth, detection) order with IoU above ``least``.

    Candidates are found by a join on the page; the order-bound choice is a fold over a page's few candidates.
    """
    from quire.functions.geometry import Box

    side = lambda p, keep: boxes.where(keep).select(page, *[F.col(c).alias(f"{p}{c}") for c in (key, "x1", "y1", "x2", "y2")])
    g, d = side("g_", truth), side("d_", ~truth)
    one, two = Box.of("g_"), Box.of("d_")
    met = g.join(d, page).where(one.overlaps(two)).where(one.iou(two) > least)
    folded = met.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(f"g_{key}").alias("g"), F.col(f"d_{key}").alias("d")))).alias("found"))
    fold = F.expr("aggregate(found, slice(found, 1, 0), (kept, x) -> case when exists(kept, k -> k.g = x.g or k.d = x.d) then kept else concat(kept, array(x)) end)")
    totals = boxes.groupBy(page).agg(F.count_if(truth).alias("truths"), F.count_if(~truth).alias("detections"))
    return totals.join(folded.select(page, F.size(fold).cast("long").alias("matched")), page, "left").select(page, F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), "truths", "detections")
