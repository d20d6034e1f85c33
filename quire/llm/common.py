"""Pieces shared by the corpus operators: scratch tables, row keys and ASCII word identities."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java class body and as the characters themselves.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` or ``setCheckpointDir`` names it.

    On one machine (a local master) a temporary folder does; a cluster without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{_own_folder()}"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="quire-")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _written.append((spark, path.rsplit("/", 1)[0]))
    return spark.read.schema(df.schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete the files of the given scratch tables, which nothing reads any more."""
    for df in frames:
        for path in {f.rsplit("/", 2)[0] for f in df.inputFiles()}:
            for held in [x for x in _written if x[1].rsplit("/", 1)[-1] == path.rsplit("/", 1)[-1]]:
                _delete(*held)
                _written.remove(held)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; whoever owns the folder clears it
            return


def own_rows(df: DataFrame, **more: Column) -> DataFrame:
    """Each row of ``df`` as one struct, ``q_own``, beside columns of ours: no name of a caller's can clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("q_own"), *[c.alias(n) for n, c in more.items()])


def own_columns(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The caller's columns out of ``q_own``, and ours behind them; ours get an underscore where a name is taken."""
    taken = {c.lower() for c in columns}
    named = []
    for name, column in more.items():
        while name.lower() in taken:
            name += "_"
        named.append(column.alias(name))
    return df.select(*[F.col("q_own").getField(c).alias(c) for c in columns], *named)


#: A key with more than one in so many of all rows is heavy, so there are fewer than so many of them; nor is any with fewer rows than the least.
HEAVY_SHARE, HEAVY_LEAST = 1 << 14, 4096


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, least: int = HEAVY_LEAST) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and in ``weight`` how many rows hold it.

    The rows of heavy keys, however many, meet a broadcast of at most HEAVY_SHARE rows where they are; what is left is
    shuffled, and no key of it fills a task.  Keys are not null.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    edge = max(least, total // HEAVY_SHARE)
    heavy = table.where(F.col(weight) > edge)
    if heavy.isEmpty():
        return rows.join(table.hint("merge"), keys)
    heavy = F.broadcast(heavy)  # fewer than HEAVY_SHARE rows: their weights add up to at most the total
    return rows.join(heavy, keys).unionByName(rows.join(heavy.select(*keys), keys, "left_anti").join(table.where(F.col(weight) <= edge).hint("merge"), keys))


def row_key(*columns: Column) -> Column:
    """64 bits that tell rows apart which share an id; equal rows share it."""
    return F.xxhash64(F.lit(17), *columns)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.  Pure ASCII takes the byte-wise path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The ASCII-white-space-separated words of ``text`` as an array; null and blank give an empty one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+"), F.lit(0))


IS_SPACE = np.isin(np.arange(256), list(SPACE_CHARS.encode()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes of a binary column (a single longer value is a slice of its own)."""
    starts = _offsets(batch.column(column)).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def _offsets(values: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_binary(values.type) else np.int32
    return np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, width)


def column_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array one after another, and where each value starts (one more entry at the end); a null is empty."""
    if values.null_count:
        values = values.fill_null(b"")
    starts = _offsets(values).astype(np.int64)
    data = values.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, starts - starts[0]


class Words:
    """The ASCII-white-space-separated words of a binary array of texts.

    ``which`` numbers the distinct words in the order of the texts, ``starts`` says where each text's words begin
    (one more entry at the end), ``distinct`` holds the words themselves.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        flat, starts = column_bytes(texts)
        if lower:
            flat = _LOWER[flat]
        inside = ~IS_SPACE[flat]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = starts[:-1][starts[:-1] < starts[1:]]
        first[edges] = inside[edges]
        letters = flat[inside]
        upto = np.cumsum(inside)
        at = np.flatnonzero(first)
        offsets = np.append(upto[at] - 1, len(letters)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.which, self.distinct = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.starts = np.searchsorted(at, starts)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, the same in every task."""
        made = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return made[self.which]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
