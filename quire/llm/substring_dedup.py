"""Substring dedup by a relative Lempel-Ziv parse of all documents against content-cut reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import HEAVY_SHARE, Words, mixed, release, row_key, scratch, spread_join

#: Words of the anchors that index blocks, and distinct blocks of an anchor up to which one task parses them.
ANCHOR, CROWD = 10, 2048

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Hashed:
    """Word hashes of a batch of texts, and hashes of any range of words in constant time."""

    def __init__(self, texts: pa.Array, seed: int = 0) -> None:
        found = Words(texts)
        self.words, self.starts = found.hashes(seed), found.starts
        n = len(self.words)
        self.back = _powers(_INVERSE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * _powers(_BASE, n)[:n], dtype=np.uint64, out=self.sums[1:])

    def ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of words a..b-1; equal word sequences have equal ones wherever they stand."""
        return mixed((self.sums[b] - self.sums[a]) * self.back[a])


def blocks(h: Hashed, window: int) -> tuple[np.ndarray, ...]:
    """Cut texts into blocks by content: (text, first word, words, anchor hash, block hash).

    The anchor of a window is its 10-word sequence of least hash, the leftmost of equals.  A block is a run of
    windows with one anchor, so it has at least ``window`` words, any window lies in exactly one, and where two
    texts share a window, its anchor is the same in both.
    """
    n = len(h.words)
    empty = np.empty(0, np.int64)
    if n < window:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    at = np.arange(n - ANCHOR + 1)
    grams = h.ranges(at, at + ANCHOR)
    low = (grams >> np.uint64(28) << np.uint64(28)) | at.astype(np.uint64)  # 36 bits of hash, then the place
    reach, wide = window - ANCHOR + 1, 1
    while wide * 2 <= reach:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if reach > wide:
        low = np.minimum(low[: len(low) - (reach - wide)], low[reach - wide :])
    anchor = (low & np.uint64(2**28 - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(h.starts) - 1), np.diff(h.starts))
    inside = text[: n - window + 1] == text[window - 1 :]
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    # a run ends before the next one starts or before windows that leave the text
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    length = ends - first + window
    return text[first], first - h.starts[text[first]], length, grams[anchor[first]], h.ranges(first, first + length)


def _batches(batches: Iterator[pa.RecordBatch], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            yield batch.slice(at, at_once)


def _block_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            text, start, length, anchor, block = blocks(Hashed(part.column(2)), window)
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(anchor.view(np.int64)), pa.array(block.view(np.int64))], names=["id", "rk", "start", "n", "anchor", "block"])

    return docs.mapInArrow(run, "id bigint, rk bigint, start bigint, n bigint, anchor bigint, block bigint")


def _block_texts(docs: DataFrame) -> DataFrame:
    """The words of the blocks listed in ``open``, joined by single spaces: (anchor, id, rk, start, n, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            rows: list[tuple] = []
            at: list[int] = []
            for i, (text, listed) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                words = (text or b"").split()
                for x in listed:
                    rows.append((x["anchor"], x["start"], x["n"], b" ".join(words[x["start"] : x["start"] + x["n"]])))
                    at.append(i)
            if rows:
                anchor, start, n, held = zip(*rows, strict=True)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), part.column(0).take(take), part.column(1).take(take), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(held, pa.binary())], names=["anchor", "id", "rk", "start", "n", "words"])

    return docs.mapInArrow(run, "anchor bigint, id bigint, rk bigint, start bigint, n bigint, words binary")


class Reference:
    """Blocks of earlier documents that share an anchor, indexed by the hash of each of their windows."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.blocks: list[list[bytes]] = []
        self.index: dict[int, tuple[int, int]] = {}

    def add(self, words: list[bytes], hashes: list[int]) -> None:
        for at, h in enumerate(hashes):
            self.index.setdefault(h, (len(self.blocks), at))
        self.blocks.append(words)

    def factors(self, words: list[bytes], hashes: list[int]) -> list[tuple[int, int]]:
        """The greedy parse of a block: (first word, words) of each factor that is long enough.

        From the left, a window that the index holds is compared word by word and grows as far as the reference
        goes along; that is a factor.  Windows inside it are copied with it.  The search goes on at the first window
        that reaches beyond the factor's end, so what starts inside one factor and ends in the next is found too.
        """
        out, at, window = [], 0, self.window
        while at < len(hashes):
            found = self.index.get(hashes[at])
            if found is not None:
                block, place = self.blocks[found[0]], found[1]
                long = window
                if words[at : at + window] == block[place : place + window]:
                    most = min(len(words) - at, len(block) - place)
                    while long < most and words[at + long] == block[place + long]:
                        long += 1
                    out.append((at, long))
                    at += long - window + 1
                    continue
            at += 1
        return out


def _parsed(blocks_: DataFrame, window: int) -> DataFrame:
    """Blocks of each anchor in the order of their ids, factored against those of smaller ids: (id, rk, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, earlier, waiting = None, Reference(window), []
        for part in _batches(batches, 2048):
            h = Hashed(part.column(5))
            ids, anchors, found = part.column(1).to_pylist(), part.column(0).to_pylist(), []
            begin = part.column(3).to_pylist()
            for i, text in enumerate(part.column(5).to_pylist()):
                if (anchors[i], ids[i]) != last:
                    if last and last[0] == anchors[i]:
                        for held in waiting:
                            earlier.add(*held)
                    else:
                        earlier = Reference(window)
                    waiting, last = [], (anchors[i], ids[i])
                words = text.split()
                place = np.arange(h.starts[i], h.starts[i + 1] - window + 1)
                hashes = h.ranges(place, place + window).tolist()
                found += [(i, begin[i] + a, n) for a, n in earlier.factors(words, hashes)]
                waiting.append((words, hashes))
            if found:
                at, start, n = zip(*found, strict=True)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["id", "rk", "start", "n"])

    ordered = blocks_.repartition("anchor").sortWithinPartitions("anchor", "id", "rk", "start")
    return ordered.mapInArrow(run, "id bigint, rk bigint, start bigint, n bigint")


def _window_hashes(blocks_: DataFrame, window: int) -> DataFrame:
    """Every window of the blocks, as 128 hash bits: (id, rk, at, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches, 2048):
            one, two = Hashed(part.column(5)), Hashed(part.column(5), 1)
            many = np.diff(one.starts) - window + 1
            row = np.repeat(np.arange(part.num_rows), many)
            nth = np.arange(len(row)) - (np.cumsum(many) - many)[row]
            begin, take = one.starts[row] + nth, pa.array(row)
            place = part.column(3).to_numpy()[row] + nth
            yield pa.RecordBatch.from_arrays([part.column(1).take(take), part.column(2).take(take), pa.array(place, pa.int64()), *[pa.array(h.ranges(begin, begin + window).view(np.int64)) for h in (one, two)]], names=["id", "rk", "at", "h1", "h2"])

    return blocks_.mapInArrow(run, "id bigint, rk bigint, at bigint, h1 bigint, h2 bigint")


def duplicate_factors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, crowd: int = CROWD) -> DataFrame:
    """(id, rk, start, n): factors of at least ``window`` words of each document that an earlier document holds too.

    The reference is the whole corpus, cut into blocks by content and indexed by anchor, each distinct block with the
    smallest id that holds it.  A block of a document that the index gives to a smaller id is a factor, copied whole.
    Where texts part, blocks have an anchor in common but not all their words; such blocks, once for each distinct
    one, are parsed greedily against all blocks of their anchor that smaller ids hold, word by word.

    An anchor of more than ``crowd`` distinct blocks would be a task of its own; its blocks' windows are looked up by
    128 hash bits instead, whose smallest ids are aggregated before anything is shuffled.  Only one holder of each
    distinct block is parsed, so a passage of very many documents costs one row for each, and nothing more.
    """
    slim = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("rk"), F.col(text_col).cast("binary").alias("t"))
    rows = scratch(_block_rows(slim, window), "blocks")
    key = ["anchor", "block", "n"]
    index = scratch(rows.groupBy(*key).agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("holders")), "index")
    parted = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    parted = scratch(parted, "parted")
    open_ones = spread_join(index, parted, ["anchor"], "blocks")
    shared = index.where("last > first").withColumn("blocks", F.lit(None).cast("long"))
    wanted = shared.unionByName(open_ones).groupBy(*key).agg(F.min("first").alias("first"), F.max("holders").alias("holders"), F.max("blocks").alias("blocks"))
    met = spread_join(rows, scratch(wanted, "wanted"), key, "holders").where("id > first or blocks is not null")
    met = scratch(met.select("id", "rk", "start", "n", F.when(F.col("id") == F.col("first"), F.col("anchor")).alias("anchor")), "met")
    copied = met.where("anchor is null").select("id", "rk", "start", "n")
    listed = met.where("anchor is not null").groupBy("id", "rk").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("open"))
    named = listed.select(F.col("id").alias("q_id"), F.col("rk").alias("q_rk"), "open")
    holders = slim.join(named.hint("shuffle_hash"), (F.col("rk") == F.col("q_rk")) & (F.col("id") == F.col("q_id"))).select("id", "rk", "t", "open")
    texts = scratch(_block_texts(holders), "texts")
    release(rows, index)
    crowded = parted.where(F.col("blocks") > crowd).select("anchor")
    if crowded.count() <= HEAVY_SHARE:
        crowded = F.broadcast(crowded)
    single = scratch(_parsed(texts.join(crowded, "anchor", "left_anti"), window), "parsed")
    windows = scratch(_window_hashes(texts.join(crowded, "anchor", "left_semi"), window), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("holders")).where("last > first")
    again = spread_join(windows, scratch(firsts, "firsts"), ["h1", "h2"], "holders").where("id > first").select("id", "rk", F.col("at").alias("start"), F.lit(window).cast("long").alias("n"))
    return copied.unionByName(single).unionByName(again)


def with_factors(docs: DataFrame, factors: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_words, n_removed, kept): the words that no factor covers, joined by single spaces."""
    marks = factors.groupBy("id", "rk").agg(F.collect_list(F.struct("start", "n")).alias("found")).select(F.col("id").alias("q_id"), F.col("rk").alias("q_rk"), "found")
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), row_key(F.col(id_col), F.col(text_col)).alias("rk"))
    joined = keyed.join(marks.hint("shuffle_hash"), (F.col("rk") == F.col("q_rk")) & (F.col("id") == F.col("q_id")), "left").select("id", "t", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _batches(batches):
            totals, removed, kept = [], [], []
            starts, offsets = part.column(2), part.column(2).offsets.to_numpy()
            flat = part.column(2).values
            begin, length = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            for i, text in enumerate(part.column(1).to_pylist()):
                words = (text or b"").split()
                if starts[i].is_valid and len(words):
                    a, b = offsets[i], offsets[i + 1]
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, begin[a:b], 1)
                    np.add.at(depth, begin[a:b] + length[a:b], -1)
                    stays = np.cumsum(depth[:-1]) == 0
                    left = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                else:
                    left = words
                totals.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())], names=["id", "n_words", "n_removed", "kept", "kept_sha256"])

    return joined.mapInArrow(run, "id bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id, n_words, n_removed, kept, kept_sha256) of every row, whole texts read.

    Words are split at ASCII white space and compared as they are.  Null and blank texts have no words; rows
    without id lose nothing and cost nobody anything; rows that share an id don't count as earlier than each
    other; an empty table gives an empty one; other columns are not read.
    """
    return with_factors(docs, duplicate_factors(docs, id_col, text_col, window), id_col, text_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """A row for each document: its words, how many go, and the SHA-256 of what stays; see ``dedup_substrings``."""
    out = dedup_substrings(docs, id_col, text_col, window)
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
