"""MinHash near-duplicates: a signature-coordinate inverted join with prefixes, then exact sets."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Words, chunks, mixed, own_columns, own_rows, release, scratch, spread_join
from quire.llm.graph import components

#: Coordinates of a signature, and the probability with which a pair at the threshold may agree in too few of them.
COORDINATES, MISSED = 64, 5e-5
#: Similarity in % from which documents are near-duplicates, and that of op1_near_dedup's contract.
SIMILARITY, CONTRACT = 80, 85
#: Postings of one coordinate value that are compared at once, and those that a task gathers.
BLOCK, GATHERED = 512, 4096
#: Bytes of text that are read into sets at once.
CHUNK = 1 << 22

_RANDOM = np.random.default_rng(20240607)
_A = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(16)], np.uint64)


def least_matches(similarity: int) -> int:
    """The most coordinates that may be asked for: a pair at ``similarity`` % has fewer with a probability of MISSED at most.

    Matches are binomial, so this is 42 at 85 % (3.0e-5) and 38 at 80 % (4.3e-5); they only choose what is compared exactly.
    """
    p, tail = similarity / 100, 0.0
    for m in range(COORDINATES):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail > MISSED:
            return max(1, m)
    return COORDINATES


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes; a shorter text is one shingle, a blank one none."""
    found = Words(texts, lower=True)
    words, starts = found.hashes(), found.starts
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _POWERS[k]
    rolled = mixed(rolled)
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mixed((words[a:b] * _POWERS[: b - a]).sum(dtype=np.uint64, keepdims=True) + _POWERS[15 - (b - a)]))
        else:
            out.append(rolled[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of 64 random linear orders over the set."""
    least = np.full(COORDINATES, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = _A[:, None] * shingles[None, at : at + 1024]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def _signed(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                sets = shingle_sets(part.column(1), width)
                marks = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                signs = [signature(s) for s in sets]
                flat = np.concatenate(signs).view(np.int64) if signs else np.empty(0, np.int64)
                small = [mixed(s).astype(np.uint8).tobytes() for s in signs]
                halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * COORDINATES, pa.int32()), pa.array(flat)), pa.array(small, pa.binary())],
                    names=["id", "n", "h1", "h2", "sig", "small"],
                )

    return docs.mapInArrow(run, "id bigint, n bigint, h1 bigint, h2 bigint, sig array<bigint>, small binary")


def _postings(classes: DataFrame, match: int) -> DataFrame:
    """Classes under their prefix of coordinate values, rarest first; ``bits`` marks the coordinates a class posts.

    Two signatures that agree in ``match`` of 64 values share one of the first 64 - match + 1 of either, in any
    common order.  Values that nobody shares come first in that order and need no posting, so a class with s
    shared values has s - match + 1 postings, and none if s is less than ``match``.
    """
    values = classes.select("id", F.posexplode("sig").alias("k", "value"))
    counts = scratch(values.groupBy("value").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held")
    values = spread_join(values, counts, ["value"], "held")
    prefix = values.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("held", "value", "k"))).alias("shared")).where(F.size("shared") >= match)
    prefix = prefix.select("id", F.slice("shared", F.lit(1), F.size("shared") - (match - 1)).alias("first"))
    prefix = prefix.withColumn("bits", F.expr("aggregate(first, 0L, (s, x) -> s | shiftleft(1L, x.k))"))
    return prefix.join(classes.select("id", "n", "small"), "id").select(F.explode("first").alias("first"), "bits", "id", "n", "small").select("first.value", "first.held", "bits", "id", "n", "small")


def _agree(a: dict, b: dict, match: int, similarity: int) -> np.ndarray:
    """How many coordinates the pairs of two groups collide in, if at least ``match``, and sizes are near enough; else 0.

    The coordinates' postings inside the groups are merged one after another.  After 64 - match + 1 of them, the
    prefix, a pair without a collision has no chance; from there on a pair is skipped as soon as the postings that
    are left can't bring it to ``match``, and only pairs that are still open are looked up in the next ones.
    """
    left, right = a["small"], b["small"]
    small, large = np.minimum(a["n"][:, None], b["n"][None, :]), np.maximum(a["n"][:, None], b["n"][None, :])
    found = np.zeros((len(left), len(right)), np.uint8)
    prefix = COORDINATES - match + 1
    for mine, theirs in zip(np.ascontiguousarray(left.T[:prefix]), np.ascontiguousarray(right.T[:prefix]), strict=True):
        found += mine[:, None] == theirs[None, :]
    x, y = np.nonzero((found >= match - (COORDINATES - prefix)) & (100 * small >= similarity * large))
    counts = found[x, y]
    found[:] = 0
    for at in range(prefix, COORDINATES, 8):
        to = min(at + 8, COORDINATES)
        counts = counts + (left[x, at:to] == right[y, at:to]).sum(axis=1, dtype=np.uint8)
        keep = counts + (COORDINATES - to) >= match
        x, y, counts = x[keep], y[keep], counts[keep]
    keep = counts >= match
    found[x[keep], y[keep]] = counts[keep]
    return found


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of equal keys in sorted batches, as lists of slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        change = np.zeros(max(0, batch.num_rows - 1), bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _members(parts: list[pa.RecordBatch], names: list[str]) -> dict:
    table = pa.Table.from_batches(parts)
    out = {n: table.column(n).to_numpy() for n in names}
    out["small"] = np.frombuffer(b"".join(table.column("small").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return out


def _slice(m: dict, a: int, b: int) -> dict:
    return {k: v[a:b] for k, v in m.items()}


def _best_partners(postings: DataFrame, match: int, similarity: int) -> DataFrame:
    """For each class the partner that agrees in most values, among neighbours in its postings: (a, b, m), a row for each b.

    A posting of more than GATHERED classes is dealt by their ids to parts of about so many, each with the posting's
    smallest class, so a value that very many classes share is spread over tasks.  A part's blocks meet themselves
    and its first block.  What the parts do not link, the second step does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, int]] = {}

        def meet(a: dict, b: dict, same: bool) -> None:
            m = _agree(a, b, match, similarity)
            if same:
                m[np.tril_indices(len(m))] = 0
            best = m.argmax(axis=0)
            for j in np.flatnonzero(m.max(axis=0)):
                one, two, n = int(a["id"][best[j]]), int(b["id"][j]), int(m[best[j], j])
                if one != two and n > found.get(two, (0, 0))[0]:
                    found[two] = (n, one)

        def out() -> pa.RecordBatch:
            rows = [(a, b, m) for b, (m, a) in found.items()]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [[], [], []])], names=["a", "b", "m"])

        for parts in _runs(batches, ["value", "part"]):
            members = _members(parts, ["id", "n"])
            for at in range(0, len(members["id"]), BLOCK):
                block = _slice(members, at, at + BLOCK)
                meet(block, block, True)
                if at:
                    meet(_slice(members, 0, BLOCK), block, False)
            if len(found) > 50_000:
                yield out()
        yield out()

    parts = F.ceil(F.col("held") / GATHERED)
    dealt = postings.drop("bits").withColumn("part", F.pmod(F.xxhash64("id"), parts))
    leads = postings.where(F.col("held") > GATHERED).groupBy("value").agg(F.max("held").alias("held"), F.min(F.struct("n", "id", "small")).alias("x"))
    leads = leads.select("value", "held", "x.id", "x.n", "x.small", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    ordered = dealt.unionByName(leads).drop("held").repartition("value", "part").sortWithinPartitions("value", "part", "n", "id")
    pairs = ordered.mapInArrow(run, "a bigint, b bigint, m bigint")
    return pairs.groupBy("b").agg(F.max(F.struct("m", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")


def _owned(value: int, one: dict, two: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs (x, y) this posting looks at: those whose first coordinate that both post and agree in is its own."""
    keep = np.zeros(len(x), bool)
    for at in range(0, len(x), 16384):
        i, j = x[at : at + 16384], y[at : at + 16384]
        shared = (one["sig"][i] == two["sig"][j]) & one["posted"][i] & two["posted"][j]
        keep[at : at + 16384] = one["sig"][i, shared.argmax(axis=1)] == value
    return keep


def _joins(one: dict, two: dict, x: np.ndarray, y: np.ndarray, similarity: int) -> list[tuple[int, int]]:
    """Links among the pairs (x, y) that join components; pairs that are joined already are passed over.

    A set's shingles are flagged once, and the sets of all its partners are counted against the flags.
    """
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    left, right = np.unique(x), np.unique(y)
    sets = [*one["set"][left], *two["set"][right]]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    parts = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
    theirs = dict(zip(right.tolist(), parts[len(left) :], strict=True))
    flags = np.zeros(ids.max() + 1, np.int32)
    found = []
    for i, mine in zip(left.tolist(), parts, strict=False):
        own = find(int(one["component"][i]))
        js = [j for j in y[x == i].tolist() if find(int(two["component"][j])) != own]
        if not js:
            continue
        sizes = np.array([len(theirs[j]) for j in js])
        flags[mine] = 1
        common = np.add.reduceat(flags[np.concatenate([theirs[j] for j in js])], np.cumsum(sizes) - sizes)
        flags[mine] = 0
        for k in np.flatnonzero(100 * common >= similarity * (len(mine) + sizes - common)).tolist():
            p, q = find(own), find(int(two["component"][js[k]]))
            if p != q:
                root[max(p, q)] = min(p, q)
                found.append((int(one["id"][i]), int(two["id"][js[k]])))
    return found


def _other_links(postings: DataFrame, reached: DataFrame, sets: DataFrame, match: int, similarity: int, full: bool = False) -> DataFrame:
    """Links between different components: every pair that agrees in enough values is looked at in one of its postings.

    Postings inside one component are done and go.  In the others, the classes of the posting's main component
    need not meet each other: blocks of the rest meet all blocks, so the work grows with the rest and not with the
    square of a large group.  Each pair of blocks is a group of its own, so a long posting is dealt over many
    tasks.  The sets come along, as 32-bit hashes unless ``full``; a block gives the links that join its
    components, no more of them than members, and not its pairs.
    """
    named = postings.join(reached.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    named = scratch(named, "postings")
    counted = named.groupBy("value", "component").agg(F.count(F.lit(1)).alias("n_in"))
    sides = counted.groupBy("value").agg(F.max(F.struct("n_in", "component")).alias("x"), F.sum("n_in").alias("n_all"))
    sides = sides.where("n_all > x.n_in").select("value", F.col("x.component").alias("main"), (F.col("n_all") <= BLOCK).alias("few"), F.ceil(F.col("x.n_in") / BLOCK).alias("m"), F.ceil((F.col("n_all") - F.col("x.n_in")) / BLOCK).alias("r"))
    open_ones = named.join(sides.hint("merge"), "value")
    in_main, zero = F.col("component") == F.col("main"), F.lit(0).cast("long")
    block = F.when(F.col("few"), zero).when(in_main, F.pmod(F.xxhash64("id"), "m")).otherwise(F.col("m") + F.pmod(F.xxhash64("id"), "r"))
    others = F.when(F.col("few"), F.array(zero)).when(in_main, F.sequence("m", F.col("m") + F.col("r") - 1)).otherwise(F.sequence(zero, F.col("m") + F.col("r") - 1))
    dealt = open_ones.withColumn("block", block).withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _runs(batches, ["value", "i", "j"]):
            members = _members(parts, ["id", "n", "component", "bits", "block", "i", "j"])
            same = members["i"][0] == members["j"][0]
            left = members["block"] == members["i"][0]
            one = {k: v[left] for k, v in members.items()}
            two = one if same else {k: v[~left] for k, v in members.items()}
            counts = _agree(one, two, match, similarity)
            counts[one["component"][:, None] == two["component"][None, :]] = 0
            if same:
                counts[np.tril_indices(len(counts))] = 0
            x, y = np.nonzero(counts)
            if not len(x):
                continue
            table = pa.Table.from_batches(parts)
            value = table.column("value")[0].as_py()
            members["sig"] = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.int64).reshape(-1, COORDINATES)
            members["posted"] = (members["bits"][:, None] >> np.arange(COORDINATES)) & 1 == 1
            members["set"] = np.array([np.frombuffer(s, np.uint64 if full else np.uint32) for s in table.column("shingles").to_pylist()] + [None], object)[:-1]
            one = {k: v[left] for k, v in members.items()}
            two = one if same else {k: v[~left] for k, v in members.items()}
            own = _owned(value, one, two, x, y)
            found = _joins(one, two, x[own], y[own], similarity) if own.any() else []
            yield pa.RecordBatch.from_arrays([pa.array([min(f) for f in found], pa.int64()), pa.array([max(f) for f in found], pa.int64())], names=["a", "b"])

    shapes = sets.select("id", "sig", F.col("shingles" if full else "brief").alias("shingles"))
    rows = dealt.select("value", "i", "j", "block", "id", "n", "bits", "small", "component").join(shapes, "id")
    ordered = rows.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j", "id")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The full sets and signatures of the wanted classes' first documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                sets = shingle_sets(part.column(1), width)
                marks = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(marks[:, 0]), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([np.sort((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary()), pa.array([signature(s).tobytes() for s in sets], pa.binary())], names=["id", "h1", "shingles", "brief", "sig"])

    return docs.join(wanted.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id bigint, h1 bigint, shingles binary, brief binary, sig binary")


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: int = SIMILARITY, match: int | None = None) -> DataFrame:
    """(id, n_shingles, component) of every row: components of the graph that links sets of similarity >= ``similarity`` %.

    Equal sets are one class, which its smallest id stands for.  Classes are posted under their signature's
    coordinate values; prefixes and match counts leave the pairs worth comparing.  First each class is compared,
    on full sets, with the partner that matches it best; that joins most of a group of near copies without its
    pairs.  Then every remaining pair of different components with enough matches is looked at, block by block,
    so no link between components is lost except to the match count's tail; what is found is confirmed on full sets.
    Without ``match`` the count follows from ``similarity``.

    Null and blank texts have no shingles and stand alone, as do rows without id (component null).  Rows that
    share an id are one document.  An empty table gives an empty one; texts are read whole.
    """
    match = least_matches(similarity) if match is None else match
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    signed = scratch(_signed(slim, width), "signed")
    sound = signed.where("n > 0 and id is not null")
    firsts = scratch(sound.groupBy("h1", "h2").agg(F.min("id").alias("first")), "firsts")
    keys = firsts.select(F.col("first").alias("id"), "h1", "h2")
    classes = scratch(sound.join(keys.hint("merge"), ["id", "h1", "h2"]).dropDuplicates(["id"]).select("id", "n", "sig", "small"), "classes")
    postings = scratch(_postings(classes, match), "prefixes")
    release(classes)
    best = scratch(_best_partners(postings, match, similarity), "best")
    wanted = postings.select("id").distinct()
    own = _sets(slim.where("id is not null"), wanted, width).join(keys.select("id", "h1").hint("merge"), ["id", "h1"]).dropDuplicates(["id"])
    sets = scratch(own.select("id", "shingles", "brief", "sig"), "sets")
    links = scratch(_linked(best, sets, similarity), "links")
    release(best)
    reached = components(links)
    for full in (False, True):
        rest = scratch(_other_links(postings, reached, sets, match, similarity, full), "rest")
        more = scratch(_linked(rest, sets, similarity), "more")
        known, found = rest.count(), more.count()
        if found:
            links = links.unionByName(more)
            reached = components(links)
        if found == known:  # else 32 bits have taken two shingles for one, and may have hidden a link behind that
            break
    named = firsts.join(reached.select(F.col("node").alias("first"), "component").hint("merge"), "first", "left").select("h1", "h2", F.coalesce("component", "first").alias("component"))
    found = sound.select("id", "n", "h1", "h2").join(named.hint("merge"), ["h1", "h2"]).select("id", "n", "component")
    alone = signed.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = CONTRACT, **limits: int) -> DataFrame:
    """A row for each document: its set's size, its component, and whether it is the component's first."""
    out = near_duplicates(docs, id_col, text_col, similarity=similarity, **limits)
    return out.select(id_col, "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col(id_col) == F.col("component"), F.lit(True)).alias("kept"))


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: int = SIMILARITY, **limits: int) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group, with all their columns, whatever their names.

    Rows that share that id are one document and stay together; rows without id, and null and blank texts, are in no
    group and stay.  An empty table stays empty.
    """
    kept = digest(docs.select(id_col, text_col), id_col, text_col, similarity, **limits).where("kept").select(F.col(id_col).alias("q_id")).distinct()
    rows = own_rows(docs, q_key=F.col(id_col)).join(kept.hint("shuffle_hash"), F.col("q_key").eqNullSafe(F.col("q_id")), "left_semi")
    return own_columns(rows, docs.columns)
