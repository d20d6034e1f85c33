"""What each of several filters removes, alone and behind the others, in every order of application."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Words, chunks, column_bytes, scratch

#: The five filters, one bit each: few words, few distinct words, many capitals, symbols, an earlier document's text.
LETTERS = "ABCDE"
#: Bytes of text that are judged at once.
CHUNK = 1 << 23
_SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))


def own_failures(texts: pa.Array) -> np.ndarray:
    """Bits of the filters that look at one text alone; ``texts`` are UTF-8 bytes, a null is an empty text."""
    flat, starts = column_bytes(texts)
    found = Words(texts)
    n = np.diff(found.starts)
    text = np.repeat(np.arange(len(n)), n)
    seen = np.unique(text * max(1, len(found.distinct)) + found.which) // max(1, len(found.distinct))
    distinct = np.bincount(seen, minlength=len(n))

    def per_text(which: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(which))
        return upto[starts[1:]] - upto[starts[:-1]]

    points, capitals, symbols = per_text((flat & 0xC0) != 0x80), per_text((flat >= 65) & (flat <= 90)), per_text(_SYMBOL[flat])
    return (n < 50) * 1 + (100 * distinct < 65 * n) * 2 + (100 * capitals > 5 * points) * 4 + (symbols > 0) * 8


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: Column | None = None) -> DataFrame:
    """(part, id, mask, n): how many documents of a part and an id fail just the filters in ``mask``.

    Documents are range-sorted by their text's fingerprint, text and id, so that each meets its predecessor and a
    large group of copies lies over many tasks.  A text is an earlier one's copy if its id is above the first id of
    its text.  Where a fingerprint reaches a task's first or last row, its first id may lie in another task: these
    few texts are compared on their own, in full, so equal fingerprints of unlike texts do no harm.

    Bounds are drawn from fingerprints and ids alone: no text goes to the driver.  Null texts are empty texts.  A
    null id is no smaller than any other and has no smaller one.  Rows that share id and text are not each other's
    copies.  An empty table has no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")) if part is None else part
    # the row's number keeps rows apart that share text and id, so that no range has to hold them all
    rows = docs.select(F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"), F.col(f"`{id_col}`").alias("id"), part.alias("part"), F.monotonically_increasing_id().alias("number"))
    dealt = rows.repartitionByRange("mark", F.asc_nulls_last("id"), "number")
    ordered = dealt.sortWithinPartitions("mark", "text", F.asc_nulls_last("id")).select("mark", "text", "id", "part")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        head = mark = text = least = None
        #: texts of the fingerprint at hand, and of the first one: number, fingerprint, text, first id
        open_texts: list[tuple] = []
        edges: list[tuple] = []
        names = ["task", "number", "id", "part", "mask", "mark", "text"]

        def out(ids: list, parts: pa.Array, masks: np.ndarray, numbers: list) -> pa.RecordBatch:
            none = pa.nulls(len(ids))
            return pa.RecordBatch.from_arrays([pa.array([task] * len(ids), pa.int32()), pa.array(numbers, pa.int64()), ids, parts, pa.array(masks, pa.int32()), none.cast(pa.int64()), none.cast(pa.binary())], names=names)

        for batch in batches:
            for piece in chunks(batch, 1, CHUNK):
                masks = own_failures(piece.column(1)).astype(np.int64)
                marks, ids = piece.column(0).to_pylist(), piece.column(2).to_pylist()
                numbers: list[int | None] = []
                for i, (m, x) in enumerate(zip(marks, ids, strict=True)):
                    here = None
                    if m != mark:
                        if mark is not None and mark == head:
                            edges += open_texts
                        open_texts, head = [], m if head is None else head
                    if m != mark or text != (here := piece.column(1)[i].as_py()):
                        number += 1
                        mark, text, least = m, piece.column(1)[i].as_py() if here is None else here, x
                        open_texts.append((number, mark, text, least))
                    if x is not None and x != least:
                        masks[i] |= 16
                        numbers.append(None)
                    else:
                        numbers.append(number if m == head and x is not None else None)
                yield out(piece.column(2), piece.column(3), masks, numbers)
        for k, m, t, x in [*edges, *open_texts]:
            yield pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([k], pa.int64()), pa.array([x], ordered_id), pa.array([None], pa.string()), pa.array([None], pa.int32()), pa.array([m], pa.int64()), pa.array([t], pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    ordered_id = to_arrow_type(rows.schema["id"].dataType)
    told = scratch(ordered.mapInArrow(run, f"task int, number bigint, id {kind}, part string, mask int, mark bigint, text binary"), "failures")
    counted = told.where("mark IS NULL").groupBy("part", "id", "mask", "task", "number").agg(F.count(F.lit(1)).alias("n"))
    # texts at the edges of tasks: two a task as a rule
    edges = told.where("mark IS NOT NULL").select("task", "number", "id", "mark", "text")
    first = edges.groupBy("mark", "text").agg(F.min("id").alias("least"))
    late = edges.join(first, ["mark", "text"]).where("id > least").select("task", "number", F.lit(16).alias("late"))
    merged = counted.join(late, ["task", "number"], "left").withColumn("mask", F.col("mask").bitwiseOR(F.coalesce("late", F.lit(0))))
    return merged.groupBy("part", "id", "mask").agg(F.sum("n").alias("n"))


def counters(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by what they fail, and how many of them labels call good or toxic.

    A document without labels, or with a null id, is neither; where an id has several rows of labels, any of them
    counts.
    """
    says = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"))
    found = failed.join(says, "id", "left")
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def interactions(counted: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step, out of additive counters by mask.

    Bit i of a mask is the filter ``letters[i]``; at most six filters, whose orders are 720.  What a step removes
    depends on the set of filters before it and not on their order, so each pair of such a set and a filter is summed
    once for a part, and orders take their steps from these.
    """
    if not 1 <= len(letters) <= 6:
        raise ValueError("one to six filters")
    spark, k = counted.sparkSession, len(letters)
    pairs = [(s, 1 << f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    weigh = {s: factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1")) for s, _ in pairs}
    pair = F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(own).alias("own"), F.lit(weigh[s]).alias("orders")) for s, own in pairs]))
    mask, before, own = F.col("mask"), F.col("pair.before"), F.col("pair.own")
    alive, fails = mask.bitwiseAND(before) == 0, mask.bitwiseAND(own) != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    sums = counted.select("*", pair.alias("pair")).groupBy("part", before.alias("before"), own.alias("own"), F.col("pair.orders").alias("orders")).agg(
        total(alive & ~fails).alias("kept"), total(alive & fails).alias("removed"), total(~alive & fails).alias("redundant"), total(mask == own).alias("unique_fails"), total(alive & fails, "good").alias("good_lost"), total(alive & fails, "toxic").alias("toxic_lost")
    )
    shares = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = [("".join(o), i + 1, sum(1 << letters.index(x) for x in o[:i]), 1 << letters.index(o[i])) for o in permutations(letters) for i in range(k)]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, before int, own int"))  # at most 720 orders of six steps
    return sums.join(shares, ["part", "own"]).join(orders, ["before", "own"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole documents, by source; see ``failures``, ``counters`` and ``interactions``."""
    return interactions(scratch(counters(failures(docs), labels), "counters"))
