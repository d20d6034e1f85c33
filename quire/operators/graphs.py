"""Groups of linked boxes: scores of links, components by joins, large ones cut again, paths through a group."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Links between centres farther apart than this count for nothing.
LONGEST = 50.0

#: Links and nodes of a page that is cut in one piece.
PAGE_ROWS = 1 << 18

#: Links and nodes that a task sorts.
TASK_ROWS = 1 << 20

#: Points of a path that is looked for without arrays.
SMALL = 16


@functools.cache
def _own_folder() -> str:
    made = tempfile.mkdtemp(prefix="quire-graphs-")
    atexit.register(shutil.rmtree, made, True)
    return f"file://{made}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in ``spark.checkpoint.dir`` and read back, which ends its lineage; on one machine a temporary folder does."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _own_folder()
    path = f"{folder.rstrip('/')}/quire-graphs-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _whole_pages(rows: DataFrame, page: str, page_rows: int, of: Callable[[pa.Table], pa.RecordBatch], schema: str, large: Callable[[pa.Scalar, pa.Schema], pa.RecordBatch] | None = None, tasks: int | None = None) -> DataFrame:
    """``of`` each run of whole pages, in one pass over rows dealt and sorted by page; a page of more than ``page_rows`` gives ``large`` instead, if there is one.

    Rows are dealt by a hash of the page: a union of tables that are dealt by the page itself counts as dealt (Spark 4.1), but
    adaptive plans merge its sides' partitions differently, and pages fall apart.
    """
    tasks = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.where(F.col(page).isNotNull()).repartition(tasks, F.xxhash64(page)).sortWithinPartitions(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        over = None
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            if over is not None:
                whole = whole.filter(pc.not_equal(whole.column(page), over))
            if not len(whole):
                continue
            over = None
            last = whole.column(page)[-1]
            cut = pc.index(whole.column(page), last).as_py()
            if cut:
                yield of(pa.concat_tables([*held, whole.slice(0, cut)]))
                held = []
            elif held and held[-1].column(page)[-1] != last:
                yield of(pa.concat_tables(held))
                held = []
            held.append(whole.slice(cut))
            if large is not None and sum(map(len, held)) > page_rows:
                over = last
                yield large(last, whole.schema)
                held = []
        if held:
            yield of(pa.concat_tables(held))

    return dealt.mapInArrow(run, schema)


def link_scores(links: DataFrame, centres: DataFrame, longest: float = LONGEST, page: str = "page_id", order: str = "nth", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(page, a, b, score): links (page, nth, a, b, score) once in either direction, the smaller end first.

    A link longer than ``longest`` between its ends' centres (page, node, x, y) scores 0.  Scores of one link are
    averaged one after another in the order of ``nth``, so the last weighs half.  Ends without a centre have no link;
    a page has one centre for a node.  Pages are scored whole in one pass; those of more than ``page_rows`` links and
    centres are scored by joins.
    """
    small, large, tasks = _by_size(links, centres, page, page_rows)
    found = _scores_by_pages(*small, longest, page, order, tasks)
    return found if large is None else found.unionByName(_scores_by_joins(*large, longest, page, order))


def _by_size(links: DataFrame, centres: DataFrame, page: str, page_rows: int) -> tuple[tuple, tuple | None, int]:
    """Links and centres of pages of at most ``page_rows`` of both, those of larger ones, if there are any, and tasks enough that none sorts more than memory holds."""
    sizes = links.select(page).unionByName(centres.select(page)).groupBy(page).agg(F.count(F.lit(1)).alias("q_n"))
    most, total = sizes.agg(F.coalesce(F.max("q_n"), F.lit(0)), F.coalesce(F.sum("q_n"), F.lit(0))).first()
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    if most <= page_rows:
        return (links, centres), None, tasks
    large = kept(sizes.where(F.col("q_n") > page_rows).select(page))
    return *(tuple(rows.join(large, page, how) for rows in (links, centres)) for how in ("left_anti", "left_semi")), tasks


def _scores_by_joins(links: DataFrame, centres: DataFrame, longest: float, page: str, order: str) -> DataFrame:
    """``link_scores`` of pages of any size."""
    side = lambda n: centres.select(page, F.col("node").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    turned = links.select(page, F.col(order).alias("n"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("score").cast("double").alias("score"))
    met = turned.join(side("a"), [page, "a"]).join(side("b"), [page, "b"])
    far = F.sqrt(((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))).cast("double"))
    scored = met.withColumn("score", F.when(far > longest, F.lit(0.0)).otherwise(F.col("score")))
    listed = scored.groupBy(page, "a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "score"))).alias("s"))
    return listed.select(page, "a", "b", F.expr("aggregate(slice(s, 2, size(s)), s[0].score, (m, x) -> (m + x.score) / 2)").alias("score"))


def _scores_by_pages(links: DataFrame, centres: DataFrame, longest: float, page: str, order: str, tasks: int) -> DataFrame:
    """``link_scores`` of pages that are scored whole."""
    rows, kinds, wide = _page_rows(links, centres, page, order)
    found = _whole_pages(rows, page, 0, lambda t: _scored(t, page, longest), f"`{page}` {wide[page]}, a {wide['a']}, b {wide['a']}, score double", tasks=tasks)
    return found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in (page, "a", "b")], "score")


def _page_rows(links: DataFrame, centres: DataFrame, page: str, order: str) -> tuple[DataFrame, dict, dict]:
    """Links and centres as rows of one table, the types of links' columns and the table's; a row without ``b`` is a centre, whose coordinates stand in ``score`` and ``y``."""
    number = lambda c: F.col(c).cast("double")
    kinds_of = lambda df: {f: df.schema[f].dataType.simpleString() for f in (page, "n", "a", "b")}
    turned = links.select(page, F.col(order).alias("n"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), number("score").alias("score"), F.lit(None).cast("double").alias("y"))
    kinds = kinds_of(turned)
    spots = centres.select(page, F.lit(None).cast(kinds["n"]).alias("n"), F.col("node").alias("a"), F.lit(None).cast(centres.schema["node"].dataType).alias("b"), number("x").alias("score"), number("y").alias("y"))
    rows = turned.unionByName(spots).where("a is not null")
    return rows, kinds, kinds_of(rows)


def _scored(table: pa.Table, page: str, longest: float) -> pa.RecordBatch:
    """(page, a, b, score) of whole pages."""
    at, pages = _numbers(table.column(page))
    ends, names = _numbers(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], table.schema.field("a").type))
    size, a, b = max(len(names), 1), ends[: len(at)], ends[len(at) :]
    nth = _numbers(table.column("n"))[0]
    first, second = (table.column(c).combine_chunks() for c in ("score", "y"))
    value, y = (c.to_numpy(zero_copy_only=False) for c in (first, second))
    valued, known_y = (pc.is_valid(c).to_numpy(zero_copy_only=False) for c in (first, second))
    spot, link = np.flatnonzero(b < 0), np.flatnonzero(b >= 0)
    keys, own = np.unique(at[spot] * size + a[spot], return_index=True)
    spot = spot[own]
    u, v = at[link] * size + a[link], at[link] * size + b[link]
    i, j = np.searchsorted(keys, u), np.searchsorted(keys, v)
    there = (i < len(keys)) & (j < len(keys))
    there[there] = (keys[i[there]] == u[there]) & (keys[j[there]] == v[there])
    link, i, j = link[there], i[there], j[there]
    order = np.lexsort((value[link], nth[link], j, i))
    link, i, j = link[order], i[order], j[order]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])][: len(i)])
    many = np.diff(np.r_[starts, len(i)])
    mean, some = value[link[starts]], np.ones(len(starts), bool)
    if len(starts):
        some = np.logical_and.reduceat(valued[link], starts)
    more, k = np.flatnonzero(many > 1), 1
    while len(more):
        mean[more] = (mean[more] + value[link[starts[more] + k]]) / 2
        k += 1
        more = more[many[more] > k]
    p, q = spot[i[starts]], spot[j[starts]]
    with np.errstate(invalid="ignore", over="ignore"):
        near = np.sqrt((value[p] - value[q]) ** 2 + (y[p] - y[q]) ** 2) <= longest
    far = valued[p] & valued[q] & known_y[p] & known_y[q] & ~near
    mean[far], some[far] = 0.0, True
    made = [pages.take(pa.array(at[p])), names.take(pa.array(a[p])), names.take(pa.array(a[q])), pa.array(mean, mask=~some)]
    return pa.RecordBatch.from_arrays(made, names=[page, "a", "b", "score"])


def _numbers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones in their order, and those; nulls have place -1."""
    coded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    places = np.empty(len(order) + 1, np.int64)
    places[order], places[-1] = np.arange(len(order)), -1
    return places[pc.fill_null(coded.indices.cast(pa.int64()), len(order)).to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order))


def _least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of ``n`` numbered nodes that links ``a``-``b`` join each to."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def _cut(table: pa.Table, page: str, levels: list[float], most: int) -> pa.RecordBatch:
    """(page, node, root, level) of whole pages: rows with ``b`` are links, the others nodes."""
    at, pages = _numbers(table.column(page))
    ends, names = _numbers(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], table.schema.field("a").type))
    size, a, b = max(len(names), 1), ends[: len(at)], ends[len(at) :]
    node = (b < 0) & (a >= 0)
    keys = np.unique(at[node] * size + a[node])
    root, level = np.arange(len(keys)), np.full(len(keys), levels[0])
    left = np.ones(len(keys), bool)
    score = table.column("score").combine_chunks().fill_null(float("-inf")).to_numpy(zero_copy_only=False)
    link = (a >= 0) & (b >= 0) & (a != b)
    u, v, score = at[link] * size + a[link], at[link] * size + b[link], score[link]
    i, j = np.searchsorted(keys, u), np.searchsorted(keys, v)
    known = (i < len(keys)) & (j < len(keys))
    known[known] = (keys[i[known]] == u[known]) & (keys[j[known]] == v[known])
    i, j, score = i[known], j[known], score[known]
    for now in levels:
        good = (score >= now) & left[i] & left[j]
        found = _least_reached(len(keys), i[good], j[good])
        root[left], level[left] = found[left], now
        left &= np.bincount(found[left], minlength=len(keys))[root] > most
        if not left.any():
            break
    made = [pages.take(pa.array(keys // size)), names.take(pa.array(keys % size)), names.take(pa.array(keys[root] % size)), pa.array(level)]
    return pa.RecordBatch.from_arrays(made, names=[page, "node", "root", "level"])


def _by_pages(links: DataFrame, nodes: DataFrame, levels: list[float], most: int, page: str, page_rows: int) -> DataFrame:
    """(page, node, root, level) by one pass over rows dealt and sorted by page; a page of more than ``page_rows`` is one row without a node."""
    kinds = {f: nodes.schema[f].dataType.simpleString() for f in (page, "node")}
    ends = [F.col(c).cast(kinds["node"]).alias(c) for c in ("a", "b")]
    rows = links.select(page, *ends, F.col("score").cast("double").alias("score")).where("a is not null and b is not null").unionByName(
        nodes.select(page, F.col("node").alias("a"), F.lit(None).cast(kinds["node"]).alias("b"), F.lit(None).cast("double").alias("score")).where("a is not null")
    )

    def large(over: pa.Scalar, schema: pa.Schema) -> pa.RecordBatch:
        kind = schema.field("a").type
        return pa.RecordBatch.from_arrays([pa.array([over.as_py()], schema.field(page).type), pa.nulls(1, kind), pa.nulls(1, kind), pa.nulls(1, pa.float64())], names=[page, "node", "root", "level"])

    schema = f"`{page}` {kinds[page]}, node {kinds['node']}, root {kinds['node']}, level double"
    return _whole_pages(rows, page, page_rows, lambda t: _cut(t, page, levels, most), schema, large)


def components(links: DataFrame, nodes: DataFrame, page: str = "page_id", most_rounds: int = 64) -> DataFrame:
    """(page, node, root): what links (page, a, b) join, directly or not, under its smallest node; nodes without links are their own.

    Each round a node takes the least label around it and then that label's own, so chains shrink by halves.
    Neighbours' minima are aggregated before they are dealt; nothing of a page is gathered.
    """
    known = lambda n: F.col(n).isNotNull()
    both = kept(links.select(page, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(page, F.col("b").alias("u"), F.col("a").alias("v"))).where(known("u") & known("v") & (F.col("u") != F.col("v"))).distinct())
    labels = nodes.select(page, "node").unionByName(both.select(page, F.col("u").alias("node"))).distinct().withColumn("root", F.col("node"))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "v"), [page, "v"]).groupBy(page, F.col("u").alias("node")).agg(F.min("root").alias("near"))
        met = labels.join(near, [page, "node"], "left").select(page, "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        up = met.select(page, F.col("node").alias("root"), F.col("root").alias("up"))
        jumped = kept(met.join(up, [page, "root"], "left").select(page, "node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        labels = jumped.drop("old")
        if jumped.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _levels(least: float, step: float, top: float) -> list[float]:
    levels = [least]
    while round(levels[-1] + step, 9) <= top:
        levels.append(round(levels[-1] + step, 9))
    return levels


def split_components(links: DataFrame, nodes: DataFrame, most: int, least: float, step: float, top: float = 1.0, page: str = "page_id", page_rows: int = PAGE_ROWS) -> DataFrame:
    """(page, node, root, level): components of links that score ``least`` or more, cut again until none has over ``most`` nodes.

    Each time the links inside what is too large must score ``step`` more; beyond ``top`` it stays as it is.  ``level``
    is the score that made the node's component.  Pages are cut whole in one pass; those of more than ``page_rows``
    links and nodes are cut by joins, and nothing of them is gathered.
    """
    levels = _levels(least, step, top)
    cut = kept(_by_pages(links, nodes, levels, most, page, page_rows))
    large = cut.where("node is null").select(page)
    if large.isEmpty():
        return cut
    whole = lambda rows: rows.join(large, page, "left_semi")
    return cut.where("node is not null").unionByName(_split_by_joins(whole(links), whole(nodes), most, levels, page))


def _split_by_joins(links: DataFrame, nodes: DataFrame, most: int, levels: list[float], page: str) -> DataFrame:
    """``split_components`` of pages of any size."""
    links, left = kept(links.select(page, "a", "b", "score")), kept(nodes.select(page, "node"))
    done = None
    for level in levels:
        inside = links.where(F.col("score") >= level)
        found = components(inside.join(left.withColumnRenamed("node", "a"), [page, "a"], "left_semi").join(left.withColumnRenamed("node", "b"), [page, "b"], "left_semi"), left, page)
        sizes = found.groupBy(page, "root").agg(F.count(F.lit(1)).alias("q_n"))
        sized = kept(found.join(sizes, [page, "root"]).select(page, "node", "root", F.lit(level).alias("level"), "q_n"))
        over = sized.where(F.col("q_n") > most)
        last = level == levels[-1] or over.isEmpty()
        small = (sized if last else sized.where(F.col("q_n") <= most)).drop("q_n")
        done = small if done is None else done.unionByName(small)
        if last:
            break
        # what was cut is compared within its old component only: links between components are below the old level
        left = over.select(page, "node")
    return done


def numbered(groups: DataFrame, page: str = "page_id") -> DataFrame:
    """``groups`` with ``label``: its root's place, from 0, among the page's."""
    roots = groups.select(page, "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy(page).orderBy("root")) - 1)
    return groups.join(roots, [page, "root"])


def without_singles(groups: DataFrame, page: str = "page_id") -> DataFrame:
    """``groups`` whose root has at least two nodes."""
    several = groups.groupBy(page, "root").agg(F.count(F.lit(1)).alias("q_n")).where("q_n > 1").select(page, "root")
    return groups.join(several, [page, "root"], "left_semi")


def path(points: np.ndarray | list) -> list[int]:
    """Places of points along a path: from the first point on, the one nearest to either end comes next, at that end.

    The front counts where both are as near; of points that are as near the last comes.
    """
    if len(points) > SMALL:
        return _long_path(np.asarray(points, float))
    left = list(range(1, len(points)))
    out = list(range(len(points)))[:1]
    while left:
        near = []
        for end in (out[0], out[-1]):
            x, y = points[end]
            near.append(min(((points[i][0] - x) ** 2 + (points[i][1] - y) ** 2, -i) for i in left))
        front = near[0][0] <= near[1][0]
        at = -near[0 if front else 1][1]
        left.remove(at)
        out.insert(0 if front else len(out), at)
    return out


def _long_path(points: np.ndarray) -> list[int]:
    left = list(range(1, len(points)))
    out = list(range(len(points)))[:1]
    while left:
        far = [((points[left] - points[end]) ** 2).sum(axis=1) for end in (out[0], out[-1])]
        front = far[0].min() <= far[1].min()
        near = far[0] if front else far[1]
        at = left.pop(int(np.flatnonzero(near == near.min())[-1]))
        out.insert(0 if front else len(out), at)
    return out


def _orders(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``path`` of groups of the same size, one in each row."""
    many, size = x.shape
    rows, left = np.arange(many), np.ones(x.shape, bool)
    left[:, 0] = False
    out = np.zeros((many, 2 * size - 1), np.int64)
    ends = [np.full(many, size - 1), np.full(many, size - 1)]
    for _ in range(size - 1):
        found = []
        for end in ends:
            own = out[rows, end]
            far = np.where(left, (x - x[rows, own, None]) ** 2 + (y - y[rows, own, None]) ** 2, np.inf)
            least = far.min(axis=1)
            found.append((least, size - 1 - np.argmax((left & (far == least[:, None]))[:, ::-1], axis=1)))
        front = found[0][0] <= found[1][0]
        at = np.where(front, found[0][1], found[1][1])
        ends = [ends[0] - front, ends[1] + ~front]
        out[rows, np.where(front, *ends)] = at
        left[rows, at] = False
    return np.take_along_axis(out, ends[0][:, None] + np.arange(size), axis=1)


def _walks(starts: np.ndarray, many: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of all groups' points along their paths; a group begins at ``starts`` and has ``many``."""
    places = np.arange(len(x))
    odd = ~(np.isfinite(x) & np.isfinite(y))
    alone = (many > SMALL) | (np.add.reduceat(odd, starts) > 0 if len(starts) else False)
    for size in np.unique(many[~alone & (many > 1)]).tolist():
        at = starts[~alone & (many == size)][:, None] + np.arange(size)
        places[at] = np.take_along_axis(at, _orders(x[at], y[at]), axis=1)
    for low, n in zip(starts[alone].tolist(), many[alone].tolist(), strict=True):
        places[low : low + n] = [low + i for i in path(list(zip(x[low : low + n].tolist(), y[low : low + n].tolist(), strict=True)))]
    return places


def _grouped(table: pa.Table, page: str, longest: float, levels: list[float], most: int, walk: bool) -> pa.RecordBatch:
    """Whole pages' links scored and their components cut: (page, node, root, level), or (page, root, nth, node) along each one's path."""
    centre = table.filter(pc.is_null(table.column("b")))
    links = _scored(table, page, longest)
    nodes = centre.select([page, "a", "b"]).append_column("score", pa.nulls(len(centre), pa.float64()))
    cut = _cut(pa.concat_tables([pa.Table.from_batches([links]), nodes], promote_options="default"), page, levels, most)
    if not walk:
        return cut
    at, ends = _numbers(centre.column(page))[0], _numbers(centre.column("a"))[0]
    own = np.unique(at * (ends.max(initial=0) + 1) + ends, return_index=True)[1]
    x, y = (centre.column(c).to_numpy()[own] for c in ("score", "y"))
    page_at, root_at = _numbers(cut.column(0))[0], _numbers(cut.column(2))[0]
    order = np.lexsort((root_at, page_at))
    new = np.r_[True, (np.diff(page_at[order]) != 0) | (np.diff(root_at[order]) != 0)][: len(order)]
    starts = np.flatnonzero(new)
    many = np.diff(np.r_[starts, len(order)])
    nth = np.arange(len(order)) - np.repeat(starts, many)
    places = pa.array(order[_walks(starts, many, x[order], y[order])])
    columns = [cut.column(0).take(places), cut.column(2).take(places), pa.array(nth, pa.int32()), cut.column(1).take(places)]
    return pa.RecordBatch.from_arrays(columns, names=[page, "root", "nth", "node"])


def linked_groups(links: DataFrame, centres: DataFrame, longest: float, most: int, least: float, step: float, top: float = 1.0, walk: bool = False, page: str = "page_id", order: str = "nth", page_rows: int = PAGE_ROWS) -> DataFrame:
    """``split_components`` of what ``link_scores`` gives, or on request the ``paths`` through it.

    Pages are dealt once, and scored, cut and walked whole; those of more than ``page_rows`` links and centres by joins.
    A page has one centre for a node.
    """
    small, large, tasks = _by_size(links, centres, page, page_rows)
    rows, _, wide = _page_rows(*small, page, order)
    kind = centres.schema["node"].dataType.simpleString()
    levels = _levels(least, step, top)
    made = f"root {wide['a']}, nth int, node {wide['a']}" if walk else f"node {wide['a']}, root {wide['a']}, level double"
    found = _whole_pages(rows, page, 0, lambda t: _grouped(t, page, longest, levels, most, walk), f"`{page}` {wide[page]}, {made}", tasks=tasks)
    found = found.withColumns({c: F.col(c).cast(kind) for c in ("node", "root")})
    if large is None:
        return found
    cut = split_components(kept(_scores_by_joins(*large, longest, page, order)), large[1], most, least, step, top, page, page_rows)
    return found.unionByName(paths(cut, large[1], page) if walk else cut)


def paths(groups: DataFrame, centres: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, root, node, nth): each group's nodes along ``path``, in the order of their keys to begin with.

    A group's points are gathered: cut large ones with ``split_components`` first.  Nodes without a centre are left out.
    """
    met = groups.join(centres.select(page, "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), [page, "node"])
    listed = met.groupBy(page, "root").agg(F.array_sort(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), "x", "y"))).alias("p"))
    kinds = [listed.schema[c].dataType.simpleString() for c in (page, "root")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, rows = batch.column(2).offsets.to_numpy(), batch.column(2).values
            x, y = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            nodes = rows.field("node").to_numpy()
            places = _walks(starts[:-1], np.diff(starts), x, y)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(nodes[places]))], names=[page, "root", "nodes"])

    found = listed.mapInArrow(run, f"`{page}` {kinds[0]}, root {kinds[1]}, nodes array<bigint>")
    return found.select(page, "root", F.posexplode("nodes").alias("nth", "node"))
