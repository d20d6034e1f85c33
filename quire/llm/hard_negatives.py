"""Hard negatives of anchors by inner product, found exactly through one-dimensional distance keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import scratch, spread_join

#: Pivots, and vectors drawn to place them; vectors of an annulus at least, and annuli at most (their directory goes to every task).
PIVOTS, SAMPLE, BLOCK, ANNULI = 32, 2048, 1024, 1 << 15
#: Queries that are planned at once; queries that meet an annulus in one task at most; annuli of the first round, and their growth.
PLANNED, TOGETHER, FIRST, GROWTH = 256, 1 << 17, 4, 4
#: Squared lengths up to this have exact inner products in doubles.
EXACT = 1 << 52
LONG = (1 << 63) - 1


def ints_of(components: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x) of each finite double, exactly."""
    return [(Fraction(x) * scale).__floor__() for x in components.tolist()]


def _long_product(a: list[int], b: list[int]) -> int:
    """Inner product over the components that both have, or the nearest 64-bit integer."""
    return max(-LONG, min(LONG, sum(x * y for x, y in zip(a, b, strict=False))))


def _packed(rows: DataFrame, dim: int, scale: int) -> DataFrame:
    """(id, label, odd, z, length, key): each distinct row with its vector as bytes and a key of label and vector.

    ``z`` holds 32-bit integers, or the doubles themselves where a row is odd: of another length than ``dim``, or too
    long for exact doubles.  ``length`` is the squared length of the integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten().to_numpy()
            starts = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
            sizes = np.diff(starts)
            z: list[bytes | None] = [None] * len(lists)
            odd, length = sizes != dim, np.zeros(len(lists), np.int64)
            full = np.flatnonzero(~odd)
            if len(full):
                with np.errstate(over="ignore"):
                    scaled = flat[starts[full][:, None] + np.arange(dim)] * scale
                    large = ~((scaled**2).sum(axis=1) <= EXACT / 4)
                whole = np.floor(np.where(large[:, None], 0, scaled))
                length[full] = (whole**2).sum(axis=1)
                for i, r in zip(full.tolist(), whole.astype(np.int32), strict=True):
                    z[i] = r.tobytes()
                odd[full] = large
            for i in np.flatnonzero(odd).tolist():
                z[i] = (flat[starts[i] : starts[i + 1]] + 0.0).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odd), pa.array(z, pa.binary()), pa.array(length)], names=["id", "label", "odd", "z", "length"])

    made = rows.select("id", "label", "v").mapInArrow(run, "id bigint, label bigint, odd boolean, z binary, length bigint").distinct()
    return made.withColumn("key", F.unhex(F.sha2(F.concat(F.encode(F.concat_ws(":", "label", "odd", F.lit("")), "UTF-8"), "z"), 256)))


def _classes(packed: DataFrame, ids: int) -> DataFrame:
    """One row for each key, with the ``ids`` smallest ids that hold it.

    No search needs more of them, since all rows of a class score alike and ties go to smaller ids.
    """
    least = packed.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("nth") <= ids)
    return least.groupBy("key").agg(*[F.first(c).alias(c) for c in ("label", "odd", "z", "length")], F.array_sort(F.collect_list("id")).alias("ids"))


class Space:
    """The augmented space: each vector gets one more component that brings it to the greatest length.

    There the squared distance of a vector to a query is |q|^2 + M^2 - 2 <q, x>: nearest is best, and a range of
    scores is an annulus.
    """

    def __init__(self, most: float, sample: np.ndarray, dim: int) -> None:
        self.most, self.dim = most, dim
        #: distances are told apart no finer than this, which is far above their error
        self.slack = 1e-6 * (1 + np.sqrt(most))
        x = self.raised(sample)
        rng = np.random.default_rng(5)
        self.pivots = x[rng.permutation(len(x))[: min(PIVOTS, len(x))]] if len(x) else np.zeros((1, dim + 1))
        for _ in range(4 if len(x) else 0):
            near = self._apart(x, self.pivots).argmin(axis=1)
            self.pivots = np.stack([x[near == p].mean(axis=0) if (near == p).any() else self.pivots[p] for p in range(len(self.pivots))])

    def raised(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(0, self.most - (x**2).sum(axis=1)))])

    @staticmethod
    def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T))

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """Distances of vectors to all pivots."""
        return self._apart(self.raised(x), self.pivots)

    def asked_from(self, x: np.ndarray) -> np.ndarray:
        """Distances of queries to all pivots; a query has nothing in the component that is added.

        Each round works these out again and goes on where the last one stopped, so they are summed row by row: a
        matrix product's last bits depend on which rows it holds.
        """
        return np.sqrt(((x[:, None, :] - self.pivots[:, :-1]) ** 2).sum(axis=2) + self.pivots[:, -1] ** 2)

    def radius(self, length: float, score: int) -> float:
        """The distance at which vectors have this score with a query of that squared length."""
        return float(np.sqrt(max(0.0, length + self.most - 2.0 * score)))


def _keyed(classes: DataFrame, space: Space) -> DataFrame:
    """Classes with their key: the nearest pivot and the distance to it; odd rows have pivot -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = batch.column(2).to_numpy(zero_copy_only=False)
            pivot, dist = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            if not odd.all():
                far = space.to_pivots(np.frombuffer(b"".join(z for z, o in zip(batch.column(3).to_pylist(), odd, strict=True) if not o), np.int32).reshape(-1, space.dim).astype(float))
                pivot[~odd] = far.argmin(axis=1)
                dist[~odd] = far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(dist)], names=["key", "label", "odd", "z", "ids", "pivot", "dist"])

    return classes.select("key", "label", "odd", "z", "ids").mapInArrow(run, "key binary, label bigint, odd boolean, z binary, ids array<bigint>, pivot int, dist double")


def _annuli(keyed: DataFrame, at_most: int) -> DataFrame:
    """Annuli of at most ``at_most`` classes in the order of (pivot, distance), one in a row."""
    ordered = keyed.repartitionByRange("pivot", "dist", "key").sortWithinPartitions("pivot", "dist", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[dict] = []
        number = TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            nonlocal held, number
            number += 1
            bytes_of = lambda values, kind: pa.array([np.array(values, kind).tobytes()], pa.binary())
            row = [pa.array([number], pa.int64()), pa.array([held[0]["pivot"]], pa.int32()), pa.array([held[0]["dist"]], pa.float64()), pa.array([held[-1]["dist"]], pa.float64()), pa.array([b"".join(r["z"] for r in held)], pa.binary())]
            row += [bytes_of([len(r["z"]) for r in held], np.int64), bytes_of([r["label"] for r in held], np.int64), bytes_of([len(r["ids"]) for r in held], np.int64), bytes_of([x for r in held for x in r["ids"]], np.int64)]
            held = []
            return pa.RecordBatch.from_arrays(row, names=["annulus", "pivot", "near", "far", "body", "sizes", "labels", "n_ids", "ids"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= at_most or held[0]["pivot"] != r["pivot"]):
                    yield out()
                held.append(r)
        if held:
            yield out()

    return ordered.select("pivot", "dist", "z", "label", "ids").mapInArrow(run, "annulus bigint, pivot int, near double, far double, body binary, sizes binary, labels binary, n_ids binary, ids binary")


_ASKED = ("odd", "keys", "body", "labels", "q", "win", "high", "low", "best")


def _plan(queries: DataFrame, space: Space, directory: tuple[np.ndarray, ...], round_: int) -> DataFrame:
    """What each annulus is asked this round, and how far each window of a query has been searched then.

    A query's lower bound for an annulus is the triangle inequality's.  A window whose k-th score is known is
    searched as far as that score's distance, which certifies it; any other as far as the next few annuli.
    """
    number, pivot, near, far = directory
    known, at = pivot >= 0, np.maximum(pivot, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["annulus", *_ASKED, "key", "told", "done"]

        def planned(rows: list[dict], odd: bool) -> Iterator[pa.RecordBatch]:
            told, asked = [], []
            if odd:
                lower, upper, lengths = np.zeros((len(rows), len(number))), np.full((len(rows), len(number)), np.inf), np.zeros(len(rows))
            else:
                x = np.frombuffer(b"".join(r["z"] for r in rows), np.int32).reshape(-1, space.dim).astype(float)
                lengths, to = (x**2).sum(axis=1), space.asked_from(x)[:, at]
                lower = np.where(known, np.maximum(0, np.maximum(to - far, near - to)), 0)
                upper = np.where(known, to + far, np.inf)
            for i, r in enumerate(rows):
                for w in r["wins"]:
                    inner = -1.0 if odd or w["high"] == LONG else space.radius(lengths[i], w["high"]) - space.slack
                    outer = np.inf if odd or w["low"] == -LONG else space.radius(lengths[i], w["low"]) + space.slack
                    fit = (upper[i] >= inner) & (lower[i] <= outer) & (lower[i] > w["done"])
                    if odd or w["best"] is not None:
                        reach = np.inf if odd else space.radius(lengths[i], w["best"]) + space.slack
                    else:
                        left, some = lower[i][fit], FIRST * GROWTH**round_
                        reach = np.inf if len(left) <= some else float(np.partition(left, some - 1)[some - 1])
                    need = np.flatnonzero(fit & (lower[i] <= reach))
                    told.append((r["key"], w["win"], max(w["done"], reach)))
                    asked.append((need, np.full(len(need), i), np.full(len(need), w["win"]), np.full(len(need), w["high"]), np.full(len(need), w["low"]), np.full(len(need), -LONG if w["best"] is None else w["best"])))
            a, q, win, high, low, best = (np.concatenate(c).astype(np.int64) for c in zip(*asked, strict=True))
            order = np.argsort(a, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else ():
                own, which = np.unique(q[part], return_inverse=True)
                packs = [b"".join(rows[j][c] for j in own) for c in ("key", "z")] + [x.astype(np.int64).tobytes() for x in (np.array([rows[j]["label"] for j in own]), which, win[part], high[part], low[part], best[part])]
                row = [pa.array([int(number[a[part[0]]])], pa.int64()), pa.array([odd]), *[pa.array([x], pa.binary()) for x in packs], pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64())]
                yield pa.RecordBatch.from_arrays(row, names=names)
            keys, windows, done = zip(*told, strict=True)
            none = [pa.nulls(len(told), kind) for kind in (pa.int64(), pa.bool_(), *[pa.binary()] * 8)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(keys, pa.binary()), pa.array(windows, pa.int32()), pa.array(done, pa.float64())], names=names)

        for batch in batches:
            rows = batch.to_pylist()
            plain = [r for r in rows if not r["odd"]]
            for i in range(0, len(plain), PLANNED):
                yield from planned(plain[i : i + PLANNED], False)
            for r in rows:
                if r["odd"]:
                    yield from planned([r], True)

    return queries.select("key", "odd", "label", "z", "wins").mapInArrow(run, f"annulus bigint, odd boolean, {', '.join(f'{c} binary' for c in _ASKED[1:])}, key binary, told int, done double")


class Annulus:
    """The vectors of one annulus, and the best of them for each window of a query."""

    def __init__(self, row: dict, dim: int, scale: int) -> None:
        self.odd, self.scale, self.dim = row["pivot"] < 0, scale, dim
        self.labels, n = np.frombuffer(row["labels"], np.int64), np.frombuffer(row["n_ids"], np.int64)
        ends = np.cumsum(n)
        self.ids, self.first, self.ends = np.frombuffer(row["ids"], np.int64), ends - n, ends
        self.body, self.sizes = row["body"], np.frombuffer(row["sizes"], np.int64)
        if not self.odd:
            self.x = np.frombuffer(row["body"], np.int32).reshape(-1, dim).astype(float)
            self.lengths = (self.x**2).sum(axis=1).astype(np.int64)

    def _lists(self) -> list[list[int]]:
        if not self.odd:
            return self.x.astype(np.int64).tolist()
        at = np.append(0, np.cumsum(self.sizes))
        return [ints_of(np.frombuffer(self.body[a:b]), self.scale) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def scores(self, body: bytes, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of queries (rows) with the vectors, and where the two are equal."""
        if not self.odd and not odd:
            q = np.frombuffer(body, np.int32).reshape(-1, self.dim).astype(float)
            found, own = (q @ self.x.T).astype(np.int64), (q**2).sum(axis=1).astype(np.int64)[:, None]
            return found, (found == own) & (self.lengths == own)
        asked = [ints_of(np.frombuffer(body), self.scale)] if odd else np.frombuffer(body, np.int32).reshape(-1, self.dim).tolist()
        mine = self._lists()
        return np.array([[_long_product(a, b) for b in mine] for a in asked], np.int64).reshape(len(asked), -1), np.array([[a == b for b in mine] for a in asked]).reshape(len(asked), -1)

    def best(self, asked: dict, k: int, same: bool) -> tuple[list, ...]:
        """(key, window, score, id, own) of the ``k`` best in each window; ties go to smaller ids."""
        labels, (scores, own) = np.frombuffer(asked["labels"], np.int64), self.scores(asked["body"], asked["odd"])
        out: tuple[list, ...] = ([], [], [], [], [])
        for q, w, high, low, least in zip(*(np.frombuffer(asked[c], np.int64).tolist() for c in ("q", "win", "high", "low", "best")), strict=True):
            s = scores[q]
            hit = np.flatnonzero(((self.labels == labels[q]) == same) & (s <= high) & (s >= max(low, least)))
            if len(hit) > k:
                hit = hit[s[hit] >= np.partition(s[hit], len(hit) - k)[len(hit) - k]]
            found = sorted((-int(s[j]), int(x), bool(own[q, j])) for j in hit.tolist() for x in self.ids[self.first[j] : self.ends[j]][:k])[:k]
            key = asked["keys"][32 * q : 32 * q + 32]
            for c, values in zip(out, ([key] * len(found), [w] * len(found), [-f[0] for f in found], [f[1] for f in found], [f[2] for f in found]), strict=True):
                c.extend(values)
        return out


def _meet(asked: DataFrame, annuli: DataFrame, slots: int, dim: int, scale: int, k: int, same: bool) -> DataFrame:
    """(key, win, score, id, own): what annuli answer.  A task holds one annulus and lets its queries pass by."""
    spread = F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))
    wanted = annuli.join(asked.select("annulus").distinct(), "annulus", "left_semi").withColumn("slot", spread).withColumn("kind", F.lit(0))
    both = wanted.unionByName(asked.withColumn("slot", F.pmod(F.xxhash64("keys"), F.lit(slots)).cast("int")).withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("annulus", "slot").sortWithinPartitions("annulus", "slot", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["kind"] == 0:
                    held = Annulus(r, dim, scale)
                else:
                    keys, win, score, ids, own = held.best(r, k, same)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(win, pa.int32()), pa.array(score, pa.int64()), pa.array(ids, pa.int64()), pa.array(own, pa.bool_())], names=["key", "win", "score", "id", "own"])

    return dealt.mapInArrow(run, "key binary, win int, score bigint, id bigint, own boolean")


class Index:
    """Classes of equal rows in annuli, and exact searches in them."""

    def __init__(self, keyed: DataFrame, n: int, space: Space, scale: int) -> None:
        self.space, self.scale = space, scale
        self.annuli = scratch(_annuli(keyed, max(BLOCK, -(-n // ANNULI))), "annuli")
        # at most ANNULI rows, one more for each pivot and task
        found = self.annuli.select("annulus", "pivot", "near", "far").toPandas()
        self.directory = tuple(found[c].to_numpy() for c in ("annulus", "pivot", "near", "far"))

    def search(self, queries: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(key, win, score, id, own): the ``k`` best rows in each window (key, win, high, low) of a query.

        ``same`` asks for rows of the query's label, else for those of others.  Rounds scan the annuli by their lower
        bound, a few more each time, until no annulus that is left can hold anything better.
        """
        spark = queries.sparkSession
        slots = max(1, -(-queries.count() // TOGETHER))
        state = windows.select("key", "win", "high", "low", F.lit(-1.0).alias("done"), F.lit(None).cast("bigint").alias("best"))
        found, round_ = spark.createDataFrame([], "key binary, win int, score bigint, id bigint, own boolean"), 0
        by = Window.partitionBy("key", "win").orderBy(F.col("score").desc(), "id")
        while True:
            wins = state.groupBy("key").agg(F.collect_list(F.struct("win", "high", "low", "done", "best")).alias("wins"))
            told = scratch(_plan(queries.join(wins, "key"), self.space, self.directory, round_), "plan")
            asked = told.where("annulus IS NOT NULL").drop("key", "told", "done")
            if asked.isEmpty():
                return found
            met = found.unionByName(_meet(asked, self.annuli, slots, self.space.dim, self.scale, k, same))
            found = scratch(met.withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= k).drop("nth"), "found")
            best = found.groupBy("key", "win").agg(F.min("score").alias("best"), F.count(F.lit(1)).alias("n")).select("key", "win", F.when(F.col("n") >= k, F.col("best")).alias("best"))
            done = told.where("annulus IS NULL").select("key", F.col("told").alias("win"), "done")
            state = windows.select("key", "win", "high", "low").join(done, ["key", "win"]).join(best, ["key", "win"], "left").select("key", "win", "high", "low", "done", "best")
            round_ += 1


def sound_rows(table: DataFrame, id_col: str, label_col: str | Column, vector_col: str) -> DataFrame:
    """(id, label, v): rows with id, label and a vector whose components are all there and finite, as doubles."""
    v = F.col(vector_col)
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    good = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return table.where(good).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.cast("array<double>").alias("v"))


def share_of(score: Column, percent: int, up: bool) -> Column:
    """``percent`` of a score from 0 on, rounded down or up, without overflow."""
    rest = (score % 100) * percent
    return F.expr(f"{percent}L") * F.call_function("div", score, F.lit(100)) + (F.ceil(rest / 100) if up else F.floor(rest / 100))


def mine(rows: DataFrame, is_anchor: Callable[[Column], Column], positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) out of ``rows`` (id, label, v).

    Components become floor(``scale`` * x); scores are inner products, ties go to smaller ids.  An anchor's positives
    are its best ``positives`` other rows of its label; for each, its negatives are the best rows of other labels that
    score ``low`` to ``high`` percent of it.  A positive below 0 has none.

    Rows that are equal in id, label and vector are one row; rows that share an id only are rows of their own.  Inner
    products of vectors of unlike length take the components that both have; scores beyond 64 bits are the nearest
    64-bit integer.  Such vectors, and very long ones, are compared with all others in blocks.  An empty table, or one
    without anchors, gives an empty result.
    """
    spark = rows.sparkSession
    sizes = rows.where(F.size("v") > 0).groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    packed = scratch(_packed(rows, dim, scale), "packed")
    classes = scratch(_classes(packed, max(negatives, positives + 1)), "classes")
    anchors = packed.where(is_anchor(F.col("id"))).select("key", F.col("id").alias("anchor_id"))
    n, most = classes.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0))).first()
    drawn = classes.where("NOT odd").orderBy("key").limit(SAMPLE).select("z").collect()  # keys are hashes
    space = Space(float(most), np.frombuffer(b"".join(r["z"] for r in drawn), np.int32).reshape(-1, dim).astype(float), dim)
    index = Index(_keyed(classes, space), n, space, scale)
    counts = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    queries = scratch(classes.select("key", "odd", "label", "z", (F.size("ids") == 1).alias("single")).join(counts, "key"), "queries")

    whole = queries.select("key", F.lit(0).alias("win"), F.lit(LONG).alias("high"), F.lit(-LONG).alias("low"))
    near = index.search(queries, whole, positives + 1, True)
    ranges = near.join(queries.select("key", "single"), "key").where("score >= 0 AND NOT (own AND single)").select("key", "score").distinct()
    ranges = ranges.select("key", "score", share_of(F.col("score"), high, False).alias("high"), share_of(F.col("score"), low, True).alias("low")).where("low <= high")
    windows = scratch(ranges.withColumn("win", F.row_number().over(Window.partitionBy("key").orderBy("score"))), "windows")
    far = index.search(queries, windows, negatives, False)

    listed = lambda *more: F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", *more)))
    by_score = far.join(windows.select("key", "win", F.col("score").alias("of")), ["key", "win"]).groupBy("key", "of").agg(listed().alias("negatives"))
    found = near.groupBy("key").agg(listed("own").alias("positives")).join(by_score.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("of", "negatives"))).alias("negatives")), "key").join(queries.select("key", "n"), "key")
    own = F.filter("positives", lambda p: ~(p["own"] & (p["id"] == F.col("anchor_id"))))
    pairs = spread_join(anchors, scratch(found, "classes_found"), ["key"], "n").select("anchor_id", "negatives", F.explode(F.slice(own, 1, positives)).alias("p"))
    ranked = pairs.select("anchor_id", "p", F.posexplode(F.try_element_at("negatives", -F.col("p.minus"))).alias("at", "n"))
    return ranked.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.minus")).alias("positive_score"), (-F.col("n.minus")).alias("negative_score"))


def digest(table: DataFrame) -> DataFrame:
    """The stated query: anchors are the rows whose id is divisible by 100, and every seventh id has the next label; see ``mine``."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(sound_rows(table, "vec_id", label, "embedding"), lambda i: i % 100 == 0)
