"""Running scores over a stream of predictions."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quire.functions.text import edit_distance
from quire.operators.metrics import accuracy

#: What a ratio's whole is raised by, so that none is divided by zero.
EPS = 1e-5
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCORES = "run string, seq bigint, final boolean, n bigint, acc double, similarity double, smooth double"


def running_accuracy(stream: DataFrame, predicted: str, target: str, epoch: str, name: str, checkpoint: str) -> StreamingQuery:
    """A table in memory with the accuracy of each epoch so far; a new epoch key takes the place of a reset."""
    return accuracy(stream, predicted, target, epoch).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


class RecognitionScores(StatefulProcessor):
    """A run's counters since its last reset, and its last losses, as state of the stream.

    Rows are (seq, predicted, target, loss, reset).  They count in the order of ``seq`` within a batch; after a row that
    asks for a reset the scores so far are final and the counters start anew.  Losses go on over resets.
    """

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n bigint, correct bigint, distance double")
        self.losses = handle.getListState("losses", "loss double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, correct, distance = self.totals.get() if self.totals.exists() else (0, 0, 0.0)
        losses = [x[0] for x in self.losses.get()] if self.losses.exists() else []
        out: list[tuple] = []

        def scores(seq: int, final: bool) -> tuple:
            return key[0], seq, final, n, correct / (n + EPS), 1 - distance / (n + EPS), median(losses) if losses else None

        last = None
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            a, b = ("" if v is None or v != v else v for v in (r.predicted, r.target))
            n, correct, distance = n + 1, correct + (a == b), distance + edit_distance(a, b) / max(len(a), len(b), 1)
            if r.loss is not None and r.loss == r.loss:
                losses = [*losses, float(r.loss)][-self.window :]
            last = int(r.seq)
            if r.reset is not None and r.reset == r.reset and bool(r.reset):
                out.append(scores(last, True))
                n, correct, distance = 0, 0, 0.0
        if not out or out[-1][1] != last:
            out.append(scores(last, False))
        self.totals.update((n, correct, distance))
        if losses:
            self.losses.put([(x,) for x in losses])
        yield pd.DataFrame(out, columns=["run", "seq", "final", "n", "acc", "similarity", "smooth"])

    def close(self) -> None:
        pass


def recognition_scores(stream: DataFrame, run: str, seq: str, predicted: str, target: str, loss: str, reset: str, window: int = 20) -> DataFrame:
    """A stream of (run, seq, final, n, acc, similarity, smooth): each run's scores after each batch, and final ones at resets.

    Exact matches and edit similarities are over all rows since the last reset, ``smooth`` is the median of the last
    ``window`` losses.  State is kept for each run by the state store (RocksDB: the session's provider is set to it)
    and survives a restart from the checkpoint.  Null texts are empty, null losses are passed over, null runs are left
    out; of rows with one ``seq`` in a batch the order of arrival counts.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = stream.where(F.col(run).isNotNull()).select(F.col(run).cast("string").alias("run"), F.col(seq).cast("long").alias("seq"), F.col(predicted).cast("string").alias("predicted"), F.col(target).cast("string").alias("target"), F.col(loss).cast("double").alias("loss"), F.col(reset).cast("boolean").alias("reset"))
    return rows.groupBy("run").transformWithStateInPandas(RecognitionScores(window), SCORES, "Append", "None")
