"""Approximate nearest neighbours by randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch

#: Vectors whose codes are a row; vectors and queries that meet in one cell, at most about.
BLOCK, CELL, QUERIES = 4096, 1 << 17, 1024
#: Bits of a code for each component; standard errors that the bounds allow (outside lies less than one in a hundred).
RATIO, ERRORS = 8, 2.5
#: Vectors with components over so many times the median one's largest have no part in the centre.
USUAL = 8


def rotation(dim: int, width: int, seed: int) -> np.ndarray:
    """``dim`` random orthonormal rows of ``width`` components; every task makes the same ones."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:dim]


def width_of(dim: int) -> int:
    """Bits of a code: RATIO for each component, in whole bytes."""
    return -(-dim * RATIO // 8) * 8


def turned(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated unit residuals to the centre, and the residuals' lengths."""
    residual = vectors - centre
    # a component may be too large to be squared
    most = np.maximum(np.abs(residual).max(axis=1, initial=0), 1e-300)[:, None]
    scaled = residual / most
    length = np.sqrt((scaled**2).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / np.maximum(length, 1e-300)[:, None] @ turn, length * most[:, 0]


def encoded(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes: packed signs of the rotated unit residuals, and the correction scalars norm and fit.

    ``fit`` is the inner product of a residual's unit vector with its own code, by which an estimate is divided;
    its distance from 1 gives the estimate's error.
    """
    unit, norm = turned(vectors, centre, turn)
    return np.packbits(unit > 0, axis=1), norm, np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1]), 1e-9)


def bounds(bits: np.ndarray, norm: np.ndarray, fit: np.ndarray, units: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of coded vectors (rows) to queries (columns).

    ``units`` are the queries' rotated unit residuals, ``norms`` their lengths.
    Where a length is beyond what can be squared, nothing is known: the bounds are infinite.
    """
    width = units.shape[1]
    signs = np.unpackbits(bits, axis=1, count=width).astype(np.float32) * 2 - 1
    product = (signs @ units.T.astype(np.float32)).astype(np.float64) / (np.sqrt(width) * fit)[:, None]
    error = ERRORS * (np.sqrt(np.maximum(0.0, 1 - fit**2)) / fit / np.sqrt(max(1, width - 1)))[:, None]
    near, far = np.minimum(1.0, product + error), np.maximum(-1.0, product - error)
    with np.errstate(over="ignore", invalid="ignore"):
        both, scale = (norm**2)[:, None] + norms**2, 2 * norm[:, None] * norms
        low, high = both - scale * near, both - scale * far
    return np.where(np.isfinite(low), low, -np.inf), np.where(np.isfinite(high), high, np.inf)


class Nearest:
    """Candidates of a cell's queries among code blocks that pass by; memory is that of the candidates' bounds."""

    def __init__(self, ids: np.ndarray, units: np.ndarray, norms: np.ndarray, k: int) -> None:
        self.ids, self.units, self.norms, self.k = ids, units, norms, k
        self.best = np.full((k, len(ids)), np.inf)
        self.held: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def meet(self, ids: np.ndarray, bits: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> None:
        """A vector may be among the nearest if its lower bound is not above the k-th smallest upper bound."""
        low, high = bounds(bits, norm, fit, self.units, self.norms)
        own = ids[:, None] == self.ids
        low[own], high[own] = np.inf, np.inf
        self.best = np.partition(np.concatenate([self.best, high]), self.k - 1, axis=0)[: self.k]
        x, q = np.nonzero((low <= self.best.max(axis=0)) & (low < np.inf))
        self.held.append((q, ids[x], low[x, q], high[x, q]))
        self.waiting += len(x)
        if self.waiting > 4_000_000:
            self._sift()

    def _sift(self) -> None:
        if self.held:
            q, ids, low, high = (np.concatenate(c) for c in zip(*self.held, strict=True))
            keep = low <= self.best.max(axis=0)[q]
            self.held = [(q[keep], ids[keep], low[keep], high[keep])]
            self.waiting = int(keep.sum())

    def candidates(self) -> tuple[np.ndarray, ...]:
        self._sift()
        q, ids, low, high = self.held[0] if self.held else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0))
        return self.ids[q], ids, low, high


def _packed(vectors: DataFrame, dim: int, centre: np.ndarray, seed: int, at_once: int, code: bool) -> DataFrame:
    """Blocks of at most ``at_once`` vectors in a row each, as bytes: ids and norms, and codes with fits or rotated units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = rotation(dim, width_of(dim), seed)
        ids, rows, number = [], [], TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal ids, rows, number
            number += 1
            all_ids, all_rows = np.concatenate(ids), np.concatenate(rows)
            if code:
                body, norm, fit = encoded(all_rows, centre, turn)
            else:
                (body, norm), fit = turned(all_rows, centre, turn), np.empty(0)
                body = body.astype(np.float32)
            ids, rows = [], []
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (all_ids, body, norm, fit)]], names=["block", "ids", "body", "norm", "fit"])

        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                if sum(map(len, ids)) + part.num_rows > at_once:
                    yield out()
                ids.append(part.column(0).to_numpy())
                rows.append(part.column(1).flatten().to_numpy().reshape(-1, dim).astype(np.float64))
        if ids:
            yield out()

    return vectors.mapInArrow(run, "block bigint, ids binary, body binary, norm binary, fit binary")


def sound_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors without null or non-finite components and not all zero, once for each distinct row."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.where(good).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _candidates(rows: DataFrame, asked: DataFrame, dim: int, centre: np.ndarray, seed: int, k: int, sides: tuple[int, int]) -> DataFrame:
    """(query_id, id, low, high): per cell of the grid vectors x queries, what the codes can't rule out.

    Only codes travel to the cells, and each cell holds its own queries and no others.
    """
    width, (v, q) = width_of(dim), sides
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    slot = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("long")
    codes = _packed(rows, dim, centre, seed, BLOCK, True).withColumn("row", slot(v)).withColumn("column", spread(q)).withColumn("kind", F.lit(1))
    wanted = _packed(asked, dim, centre, seed, QUERIES, False).withColumn("row", spread(v)).withColumn("column", slot(q)).withColumn("kind", F.lit(0))
    cells = wanted.unionByName(codes).repartition(v * q, "row", "column").sortWithinPartitions("row", "column", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, nearest = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if nearest is not None:
                found = nearest.candidates()
                for at in range(0, len(found[0]), 100_000):
                    part = [c[at : at + 100_000] for c in found]
                    yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.float64()), pa.array(part[3], pa.float64())], names=["query_id", "id", "low", "high"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["row"], r["column"]) != cell:
                    yield from out()
                    cell, queries, nearest = (r["row"], r["column"]), [], None
                ids, norm = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["norm"])
                if r["kind"] == 0:
                    queries.append((ids, np.frombuffer(r["body"], np.float32).reshape(-1, width), norm))
                elif queries:
                    if nearest is None:
                        nearest = Nearest(*(np.concatenate(c) for c in zip(*queries, strict=True)), k)
                    nearest.meet(ids, np.frombuffer(r["body"], np.uint8).reshape(len(ids), -1), norm, np.frombuffer(r["fit"]))
        yield from out()

    return cells.select("row", "column", "kind", "ids", "body", "norm", "fit").mapInArrow(run, "query_id bigint, id bigint, low double, high double")


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def search(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, seed: int = 7, cell: int = CELL, at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows of ``table`` by Euclidean distance.

    All rows are coded once, against the mean of all but a few far larger ones.  Codes and queries meet in cells of about ``cell`` vectors and
    ``at_once`` queries.  What the bounds leave there is cut once more by each query's k-th smallest upper bound
    over all cells; only for what is left are the original vectors fetched and measured.

    Ties go to the smaller id.  A query doesn't find its own id; rows of unlike length from the most frequent one,
    and vectors that are null, zero or not finite, take no part; equal rows count once.  With few rows a query has
    fewer than k; an empty table gives an empty result; other columns are not read.
    """
    spark = table.sparkSession
    sound = sound_vectors(table, id_col, vector_col)
    stats = sound.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("dim").desc()).limit(1).collect()
    if not stats:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, n = stats[0]["dim"], stats[0]["n"]
    rows = scratch(sound.where(F.size("v") == dim).distinct(), "vectors")
    # the mean of what isn't far larger than half of all: a few huge vectors would draw it away from the rest
    sized = rows.withColumn("most", F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    usual = sized.agg(F.percentile_approx("most", 0.5)).first()[0]
    centre = np.array(sized.where(F.col("most") <= min(USUAL * usual, 1e150)).select([F.avg(F.col("v")[i].cast("double")) for i in range(dim)]).first(), float)
    centre = np.nan_to_num(centre)
    asked = scratch(sound_vectors(queries, id_col, vector_col).where(F.size("v") == dim).distinct(), "queries")
    sides = -(-n // cell), max(1, -(-asked.count() // at_once))
    found = scratch(_candidates(rows, asked, dim, centre, seed, k, sides), "candidates")
    by_bound = Window.partitionBy("query_id").orderBy("high")
    edge = found.select("query_id", "high", F.row_number().over(by_bound).alias("n")).where(F.col("n") <= k).groupBy("query_id").agg(F.max("high").alias("edge"), F.count(F.lit(1)).alias("n"))
    left = found.join(edge, "query_id").where((F.col("low") <= F.col("edge")) | (F.col("n") < k)).select("query_id", "id")
    measured = (
        left.join(rows.hint("shuffle_hash"), "id")
        .join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).hint("shuffle_hash"), "query_id")
        .select("query_id", F.col("id").alias("vec_id"), distance(F.col("v"), F.col("q")).alias("score"))
    )
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return measured.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(table: DataFrame) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100, against all rows; see ``search``."""
    return search(table, table.where(F.col("vec_id") % 100 == 0))
