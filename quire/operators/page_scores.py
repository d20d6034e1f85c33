"""Scores of found texts against true ones, page by page: matches depend on what was matched before.

Both sides are rows of polygons (flat arrays of coordinates, in the order of their keys) with texts.  Pages become counters
in one pass after one shuffle; totals add them up and take ratios last.  A page's polygons are few.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import edit_distance, half_width
from quire.operators.metrics import harmonic, ratio
from quire.operators.polygons import Shapes, list_column, meeting

# What counts as covered, as precise, and what a split or merged match is worth.
COVERED, PRECISE, PARTLY, AT_LEAST = 0.7, 0.6, 0.8, 2
NO_LABEL = ("O", "OTHERS", "OTHER")
EPS = 1e-9


class Side:
    """One side's rows of several pages, in the order of their keys: where pages begin, polygons, and columns by name."""

    def __init__(self, values: pa.Array) -> None:
        self.pages, self.rows = list_column(values)
        self.n = len(self.rows)
        starts, coordinates = list_column(self.rows.field("p"))
        self.polygons = (coordinates.to_numpy(zero_copy_only=False), starts)
        self.page = np.repeat(np.arange(len(values)), np.diff(self.pages))

    def shapes(self, hulls: bool = False, whole: bool = False) -> Shapes:
        coordinates, starts = self.polygons
        return Shapes(np.trunc(coordinates) if whole else coordinates, starts, hulls)

    def column(self, name: str) -> list:
        return self.rows.field(name).to_pylist()

    def flags(self, name: str) -> np.ndarray:
        return np.array(self.column(name), bool)

    def totals(self, values: np.ndarray) -> np.ndarray:
        """Sums by page of one number for each row."""
        return np.bincount(self.page, values, len(self.pages) - 1).astype(np.int64)


def _counted(truth: DataFrame, found: DataFrame, page: str, key: str, polygon: str, columns: dict[str, tuple[Column, Column]], use: Callable, counters: dict[str, str], of_truth: bool = False) -> DataFrame:
    """A row of ``counters`` for each page of either side (``of_truth``: of the true one); ``use`` takes both sides of several pages (k, p and ``columns``) and gives each counter's values."""

    def side(rows: DataFrame, name: str, which: int) -> DataFrame:
        fields = [F.col(key).alias("k"), F.col(polygon).cast("array<double>").alias("p"), *[c[which].alias(n) for n, c in columns.items()]]
        return rows.select(page, F.struct(*fields).alias(name))

    # pages are small and costly: they keep to as many tasks as the session deals out
    tasks = int(truth.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = side(truth, "t", 0).unionByName(side(found, "f", 1), allowMissingColumns=True).repartition(tasks, page).groupBy(page).agg(F.array_sort(F.collect_list("t")).alias("t"), F.array_sort(F.collect_list("f")).alias("f"))
    both = both.where(F.size("t") > 0) if of_truth else both
    kind = both.schema[page].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"bigint": pa.int64(), "double": pa.float64()}
        for batch in batches:
            made = use(Side(batch.column(1)), Side(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m, types[t]) for m, t in zip(made, counters.values(), strict=True)]], names=[page, *counters])

    return both.mapInArrow(run, f"`{page}` {kind}, " + ", ".join(f"{n} {t}" for n, t in counters.items()))


def polygon_counts(truth: DataFrame, found: DataFrame, least: float = 0.5, covered: float = 0.5, page: str = "page_id", key: str = "box_id", polygon: str = "polygon", ignored: str = "ignored") -> DataFrame:
    """(page, matched, truths, detections): one-to-one matches of any polygons, in order, of IoU above ``least``.

    Polygons that cross themselves don't count.  A found one of which an ignored true one covers more than ``covered``
    doesn't count either, nor do ignored ones.  ``truth`` has a boolean ``ignored`` (null: false) besides.
    """

    def use(t: Side, f: Side) -> tuple:
        a, b = t.shapes(), f.shapes()
        fit, got, out = a.simple(), b.simple(), t.flags("i")
        i, j, both = meeting(a, t.pages, b, f.pages)
        got[j[fit[i] & out[i] & (both > covered * b.area[j])]] = False
        true = fit & ~out
        good = true[i] & got[j] & (both / (a.area[i] + b.area[j] - both) > least)
        taken, matched = set(), {}
        for x, y in zip(i[good].tolist(), j[good].tolist(), strict=True):
            if x not in matched and y not in taken:
                matched[x] = y
                taken.add(y)
        hits = np.zeros(t.n)
        hits[list(matched)] = 1
        return t.totals(hits), t.totals(true), f.totals(got)

    columns = {"i": (F.coalesce(F.col(ignored), F.lit(False)), F.lit(False))}
    return _counted(truth, found, page, key, polygon, columns, use, {"matched": "bigint", "truths": "bigint", "detections": "bigint"})


def split_and_merged(covered: np.ndarray, precise: np.ndarray) -> tuple[float, float, list[tuple[list[int], list[int]]]]:
    """What recall and precision gain, and which true (rows) and found ones (columns) were matched, by three rules in turn.

    ``covered`` is the part of each true one that each found one covers, ``precise`` the part of each found one that
    lies in each true one.  First pairs that are each other's only good match; then a true one that several found ones
    share; then a found one that holds several true ones.  A match of several is worth 0.8 for each.
    """
    n, m = covered.shape
    t, f = np.nonzero((covered > 0) | (precise > 0))
    return _split_and_merged(n, m, list(zip(t.tolist(), f.tolist(), covered[t, f].tolist(), precise[t, f].tolist(), strict=True)))


def _split_and_merged(n: int, m: int, cells: list[tuple[int, int, float, float]]) -> tuple[float, float, list[tuple[list[int], list[int]]]]:
    """``split_and_merged`` of the cells (true, found, covered, precise) that aren't zero, in their order."""
    rows: list[list[tuple[int, float, float]]] = [[] for _ in range(n)]
    lines: list[list[tuple[int, float, float]]] = [[] for _ in range(m)]
    for t, f, c, p in cells:
        rows[t].append((f, c, p))
        lines[f].append((t, c, p))
    left_t, left_f = [True] * n, [True] * m
    recall = precision = 0.0
    matched: list[tuple[list[int], list[int]]] = []

    def take(ts: list[int], fs: list[int], worth: float) -> None:
        nonlocal recall, precision
        for t in ts:
            left_t[t] = False
        for f in fs:
            left_f[f] = False
        recall, precision = recall + len(ts) * worth, precision + len(fs) * worth
        matched.append((ts, fs))

    for t, row in enumerate(rows):
        c, p = [x[0] for x in row if x[1] > COVERED], [x[0] for x in row if x[2] > PRECISE]
        if len(c) == 1 and len(p) == 1 and sum(x[1] > COVERED for x in lines[c[0]]) == 1 and sum(x[2] > PRECISE for x in lines[p[0]]) == 1:
            take([t], c, 1.0)
    for t, row in enumerate(rows):
        if left_t[t] and sum(x[1] > 0 for x in row) >= AT_LEAST:
            parts = [x for x in row if x[2] >= PRECISE and left_f[x[0]]]
            if len(parts) == 1:
                if parts[0][1] >= COVERED:
                    take([t], [parts[0][0]], 1.0)
            elif functools.reduce(lambda s, x: s + x[1], parts, 0.0) >= COVERED:
                take([t], [x[0] for x in parts], PARTLY)
    for f, line in enumerate(lines):
        if left_f[f] and sum(x[2] > 0 for x in line) >= AT_LEAST:
            parts = [x for x in line if x[1] >= PRECISE and left_t[x[0]]]
            if len(parts) == 1:
                if parts[0][2] >= PRECISE and parts[0][1] >= COVERED:
                    take([parts[0][0]], [f], 1.0)
            elif functools.reduce(lambda s, x: s + x[2], parts, 0.0) >= PRECISE:
                take([x[0] for x in parts], [f], PARTLY)
    return recall, precision, matched


def deteval_counts(truth: DataFrame, found: DataFrame, whole: bool = True, page: str = "page_id", key: str = "box_id", polygon: str = "polygon", text: str = "text") -> DataFrame:
    """(page, truths, detections, recalled, precise, hits): gains of ``split_and_merged`` and matches of equal text.

    True ones without text are ignored, with found ones of which they cover more than half.  With ``whole``, coordinates
    lose their fractions, a found one's area counts one more when it is compared with ignored ones, and shares are
    rounded to hundredths; without, they are taken as they are and texts don't count.  Texts are equal in any case of
    letters; of several true ones in one found one any may be equal, of several found ones the first must be.  Null
    texts are empty; found ones' texts are trimmed.
    """
    more = 1.0 if whole else 0.0

    def use(t: Side, f: Side) -> tuple:
        a, b = t.shapes(whole=whole), f.shapes(whole=whole)
        said_t, said_f = t.column("t"), f.column("t")
        true, got = np.array([x != "" for x in said_t], bool), np.ones(f.n, bool)
        i, j, both = meeting(a, t.pages, b, f.pages)
        over = b.area[j] + more
        hides = ~true[i] & (np.divide(both, over, out=np.zeros_like(both), where=over > 0) > 0.5)
        got[j[hides]] = False
        kept = true[i] & got[j]
        i, j, both = i[kept], j[kept], both[kept]
        of = lambda sizes: np.divide(both, sizes, out=np.zeros_like(both), where=sizes > 0)
        covered, precise = of(a.area[i]), of(b.area[j])
        if whole:
            covered, precise = np.round(covered, 2), np.round(precise, 2)
        truths, detections = t.totals(true), f.totals(got)
        # places among a page's true and found ones that count
        nth = lambda side, on: np.cumsum(on) - 1 - np.concatenate([[0], np.cumsum(on)])[side.pages[:-1]][side.page] if side.n else np.empty(0, np.int64)
        cells = list(zip(nth(t, true)[i].tolist(), nth(f, got)[j].tolist(), covered.tolist(), precise.tolist(), strict=True))
        upto = np.searchsorted(t.page[i], np.arange(len(truths) + 1)).tolist()
        texts_t, texts_f = [x for x in said_t if x], [x for x, on in zip(said_f, got.tolist(), strict=True) if on]
        from_t, from_f = np.concatenate([[0], np.cumsum(truths)]).tolist(), np.concatenate([[0], np.cumsum(detections)]).tolist()
        recalled, exact, hits = [], [], []
        for k, (n, m) in enumerate(zip(truths.tolist(), detections.tolist(), strict=True)):
            recall, precision, matched = _split_and_merged(n, m, cells[upto[k] : upto[k + 1]])
            same = lambda x, y, k=k: texts_t[from_t[k] + x].lower() == texts_f[from_f[k] + y].lower()
            recalled.append(recall)
            exact.append(precision)
            hits.append(sum(any(same(x, fs[0]) for x in ts) for ts, fs in matched) if whole else 0)
        return truths, detections, recalled, exact, hits

    words = F.coalesce(F.col(text), F.lit(""))
    columns = {"t": (words, F.regexp_replace(words, r"\A\s+|\s+\z", ""))}
    return _counted(truth, found, page, key, polygon, columns, use, {"truths": "bigint", "detections": "bigint", "recalled": "double", "precise": "double", "hits": "bigint"})


def deteval_scores(counts: DataFrame, *by: str) -> DataFrame:
    """(truths, detections, recall, precision, f_score, sequence_error, and the same three for texts) of ``deteval_counts``."""
    got = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("truths", "detections", "recalled", "precise", "hits")])
    of = lambda part, whole: ratio(F.col(part), F.col(whole))
    got = got.select("*", of("recalled", "truths").alias("recall"), of("precise", "detections").alias("precision"), of("hits", "truths").alias("recall_e2e"), of("hits", "detections").alias("precision_e2e"))
    wrong = F.when(F.col("recalled") == 0, F.lit(1.0)).otherwise(1 - F.col("hits") / F.col("recalled"))
    return got.select(*by, "truths", "detections", "recalled", "hits", "recall", "precision", harmonic(F.col("precision"), F.col("recall")).alias("f_score"), wrong.alias("sequence_error"), "recall_e2e", "precision_e2e", harmonic(F.col("precision_e2e"), F.col("recall_e2e")).alias("f_score_e2e"))


_COUNTERS = {"hits": "bigint", "truths": "bigint", "detections": "bigint", "edits": "bigint", "letters": "bigint"}


def _pairs(t: Side, f: Side, least: float) -> tuple[list[int], list[int]]:
    """One-to-one pairs of convex hulls of IoU ``least`` or more on each page, the best first; of equals the first."""
    a, b = t.shapes(hulls=True), f.shapes(hulls=True)
    i, j, both = meeting(a, t.pages, b, f.pages)
    near = both / (a.area[i] + b.area[j] - both)
    good = near >= least
    i, j, near = i[good], j[good], near[good]
    order = np.lexsort((j, i, -near))
    one, two = [], []
    seen_t, seen_f = set(), set()
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        if x not in seen_t and y not in seen_f:
            seen_t.add(x)
            seen_f.add(y)
            one.append(x)
            two.append(y)
    return one, two


#: Letters of two texts together whose distance is remembered.
SHORT = 64
_short_distance = functools.lru_cache(1 << 16)(edit_distance)


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    return np.array([_short_distance(x, y) if len(x) + len(y) <= SHORT else edit_distance(x, y) for x, y in zip(a, b, strict=True)], np.int64)


def _unmatched(side: Side, places: list[int]) -> np.ndarray:
    free = np.ones(side.n, bool)
    free[places] = False
    return free


def end_to_end_counts(truth: DataFrame, found: DataFrame, least: float = 0.5, blanks: bool = True, page: str = "page_id", key: str = "box_id", polygon: str = "polygon", text: str = "text", ignored: str = "ignored") -> DataFrame:
    """(page, hits, truths, detections, edits, letters) of the pages that have true texts.

    Matched texts are compared in half-width forms, without ``blanks`` on request; what is left on either side is
    compared with an empty text.  An ignored true one counts nowhere, nor does what it is matched with.  Null texts are
    empty.
    """

    def use(t: Side, f: Side) -> tuple:
        one, two = _pairs(t, f, least)
        said_t, said_f, out = t.column("t"), f.column("t"), t.flags("i")
        counts = [(x, y) for x, y in zip(one, two, strict=True) if not out[x]]
        places = [x for x, _ in counts]
        a, b = [said_t[x] for x in places], [said_f[y] for _, y in counts]
        hits, edits, letters = (np.zeros(t.n, np.int64) for _ in range(3))
        hits[places], edits[places], letters[places] = [x == y for x, y in zip(a, b, strict=True)], _distances(a, b), [len(x) for x in a]
        left = _unmatched(t, one) & ~out
        sizes, spare = np.array(t.column("n"), np.int64) * left, np.array(f.column("n"), np.int64) * _unmatched(f, two)
        ignored_ = np.zeros(t.n, np.int64)
        ignored_[one] = out[one]
        return t.totals(hits), t.totals(left) + np.bincount(t.page[places], minlength=len(t.pages) - 1), f.totals(np.ones(f.n)) - t.totals(ignored_), t.totals(edits + sizes) + f.totals(spare), t.totals(letters + sizes)

    said = F.coalesce(F.col(text), F.lit(""))
    plain = half_width(said) if blanks else F.replace(half_width(said), F.lit(" "), F.lit(""))
    columns = {"t": (plain, plain), "n": (F.length(said), F.length(said)), "i": (F.coalesce(F.col(ignored), F.lit(False)), F.lit(False))}
    return _counted(truth, found.where(F.col(page).isNotNull()), page, key, polygon, columns, use, _COUNTERS, of_truth=True)


def labelled_counts(truth: DataFrame, found: DataFrame, least: float = 0.5, labels: bool = True, background: bool = False, spaces: bool = True, case: bool = True, page: str = "page_id", key: str = "box_id", polygon: str = "polygon", text: str = "text", label: str = "label") -> DataFrame:
    """(page, hits, truths, detections, edits, letters) of the pages of found texts that carry labels.

    A hit has the same text, and the same label in any case of letters unless ``labels`` is false; edits are counted
    without ``spaces`` or ``case`` on request.  What is labelled as none counts only with ``background``.
    """

    def use(t: Side, f: Side) -> tuple:
        one, two = _pairs(t, f, least)
        said_t, said_f, name_t, name_f, bare_t, bare_f = (side.column(c) for c in ("t", "l", "e") for side in (t, f))
        hits, edits = np.zeros(t.n, np.int64), np.zeros(t.n, np.int64)
        hits[one] = [said_t[x] == said_f[y] and (not labels or name_t[x] == name_f[y]) for x, y in zip(one, two, strict=True)]
        edits[one] = _distances([bare_t[x] for x in one], [bare_f[y] for y in two])
        sizes = lambda texts: np.array([len(x) for x in texts], np.int64)
        left, spare = sizes(bare_t) * _unmatched(t, one), sizes(bare_f) * _unmatched(f, two)
        return t.totals(hits), t.totals(np.ones(t.n)), f.totals(np.ones(f.n)), t.totals(edits + left) + f.totals(spare), t.totals(sizes(said_t))

    said, named = F.coalesce(F.col(text), F.lit("")), F.upper(F.coalesce(F.col(label), F.lit("")))
    bare = said if spaces else F.replace(said, F.lit(" "), F.lit(""))
    name = F.when(named.isin(*NO_LABEL), NO_LABEL[0]).otherwise(named)
    columns = {"t": (said, said), "e": ((bare if case else F.lower(bare)),) * 2, "l": (name, name)}
    kept = lambda rows: rows if background else rows.where(~named.isin(*NO_LABEL))
    known = truth.join(found.select(page).distinct(), page, "left_semi")
    return _counted(kept(known), kept(found), page, key, polygon, columns, use, _COUNTERS)


def end_to_end_scores(counts: DataFrame, pages: int | Column, *by: str) -> DataFrame:
    """(precision, recall, f_score, character_accuracy, edits_per_text, edits_per_page) of counters; ``pages`` is how many true pages there are."""
    got = counts.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTERS])
    pages = F.lit(pages) if isinstance(pages, int) else pages
    p, r = F.col("hits") / (F.col("detections") + EPS), F.col("hits") / (F.col("truths") + EPS)
    return got.select(
        *by, *_COUNTERS, p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + EPS)).alias("f_score"), (1 - F.col("edits") / (F.col("letters") + EPS)).alias("character_accuracy"),
        (F.col("edits") / (F.col("truths") + EPS)).alias("edits_per_text"), (F.col("edits") / pages).alias("edits_per_page"),
    )
