"""Toxicity by compression distance: windows of a text, compressed with an ordinary and with a toxic zstandard dictionary.

Texts are lower-cased, marks become spaces, and every byte is written as a unit of two (as in UTF-16), so that what a
match saves outweighs what it costs to say where it is.  The ordinary compressor has ordinary text as its dictionary,
the toxic one has a dictionary trained on toxic text in front of the same ordinary text.  What a window of several
words is shorter with the second is what toxic text alone explains of it; a calibrated number of such windows, for
the length of the text, makes it toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, column_bytes

#: Labelled documents that are learned from, at most, and their longest text (code points).
TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_CHARS = 2_000, 4_000, 20_000
#: Bytes of the two dictionaries at most (before they are written in units), words of a window, bytes of a unit.
TOXIC_BYTES, ORDINARY_BYTES, WINDOW, UNIT = 32_768, 1 << 21, 8, 2
#: Bytes of text that are cut into windows at once.
CHUNK = 1 << 22

_PLAIN = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint8)
for _a, _b, _to in ((48, 58, 48), (97, 123, 97), (65, 91, 97)):
    _PLAIN[_a:_b] = np.arange(_b - _a) + _to


def windows(texts: pa.Array, width: int = WINDOW) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words one after another, a space behind each, and windows of ``width`` words: start, length, text.

    The last window of a text is shorter; a text without a letter, digit or non-ASCII byte has none.
    """
    flat, starts = column_bytes(texts)
    plain = _PLAIN[flat]
    inside = plain != 32
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = starts[:-1] < starts[1:]
    first[starts[:-1][filled]] = inside[starts[:-1][filled]]
    last[starts[1:][filled] - 1] = inside[starts[1:][filled] - 1]
    letters = np.flatnonzero(inside)
    word = np.cumsum(first)[letters] - 1
    out = np.full(len(letters) + int(last.sum()), 32, np.uint8)
    out[np.arange(len(letters)) + word] = plain[letters]
    begins = np.flatnonzero(first)
    place = np.searchsorted(letters, begins) + np.arange(len(begins))
    per_text = np.searchsorted(begins, starts)
    many = -(-np.diff(per_text) // width)
    text = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(text)) - (np.cumsum(many) - many)[text]
    start = place[per_text[text] + width * nth] if len(text) else place
    return out.tobytes(), start, np.diff(start, append=len(out)), text


def _units(data: bytes) -> bytes:
    return np.repeat(np.frombuffer(data, np.uint8), UNIT).tobytes()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(
        window_log=24, hash_log=20, chain_log=20, search_log=4, min_match=6, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    held = zstandard.ZstdCompressionDict(_units(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held)


@dataclass
class ToxicityModel:
    """Two dictionaries, the bytes a window must be shorter by to count, and the weights of a text's features."""

    toxic: bytes
    ordinary: bytes
    margin: int
    coefficients: tuple[float, ...]

    def __post_init__(self) -> None:
        self._pair = None

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "margin": self.margin, "coefficients": self.coefficients}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def gains(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each window: how many bytes shorter it is with the toxic dictionary, and its text."""
        data, start, length, text = windows(texts)
        if not len(start) or not self.toxic:
            return np.zeros(len(start), np.int64), text
        if self._pair is None:
            self._pair = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        segments = np.column_stack([start, length]).astype(np.uint64) * np.uint64(UNIT)
        cut = zstandard.BufferWithSegments(_units(data), segments.tobytes())
        one, two = (np.fromiter(map(len, c.multi_compress_to_buffer(cut)), np.int64, len(start)) for c in self._pair)
        return one - two, text

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: 1, windows that gain the margin and their gains (as logarithms), the number of windows."""
        gain, text = self.gains(texts)
        return _features(gain, text, len(texts), self.margin)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.features(texts)[:, :4] @ np.array(self.coefficients))


def _features(gain: np.ndarray, text: np.ndarray, n: int, margin: int) -> np.ndarray:
    hits = np.bincount(text, gain >= margin, n)
    more = np.bincount(text, np.where(gain >= margin, np.minimum(gain, 24), 0), n)
    many = np.bincount(text, minlength=n)
    return np.column_stack([np.ones(n), np.log1p(hits), np.log1p(more), np.log(np.maximum(many, 8) / 8), hits, many])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _apart(texts: list[bytes]) -> list[bytes]:
    """The texts but for those half of whose windows an earlier one has: copies would train and test the same thing."""
    seen: set[int] = set()
    out = []
    for text in texts:
        data, start, length, _ = windows(pa.array([text], pa.binary()))
        own = {xxhash.xxh3_64_intdigest(data[a : a + n]) for a, n in zip(start.tolist(), length.tolist(), strict=True)}
        if own and 2 * len(own & seen) < len(own):
            out.append(text)
        seen |= own
    return out


def _samples(texts: list[bytes], width: int) -> list[bytes]:
    data, start, length, _ = windows(pa.array(texts, pa.binary()), width)
    return [data[a : a + n] for a, n in zip(start.tolist(), length.tolist(), strict=True)]


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; of few samples, which the trainer refuses, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=24, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def learn(toxic: list[bytes], ordinary: list[bytes]) -> ToxicityModel:
    """Two thirds of each class give the dictionaries, the last third calibrates their size, the margin and the score.

    Without examples of both classes the score is the share of toxic ones.
    """
    share = len(toxic) / max(1, len(toxic) + len(ordinary))
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    toxic, ordinary = _apart(toxic), _apart(ordinary)
    own, others = [t for i, t in enumerate(toxic) if i % 3 != 2], [t for i, t in enumerate(ordinary) if i % 3 != 2]
    checks = pa.array([*toxic[2::3], *ordinary[2::3]], pa.binary())
    y = np.array([1.0] * len(toxic[2::3]) + [0.0] * len(ordinary[2::3]))
    if len(set(y.tolist())) < 2:
        return ToxicityModel(b"", b"", 1, (prior, 0.0, 0.0, 0.0))
    base, samples = b"".join(_samples(others, 64))[:ORDINARY_BYTES], _samples(own, 16)
    size, best = sum(map(len, samples)), None
    weight = (1 + np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * len(y)) / 2
    for bytes_ in dict.fromkeys(min(TOXIC_BYTES, max(512, size // part)) for part in (100, 32, 12)):
        model = ToxicityModel(_trained(samples, bytes_), base, 1, ())
        gain, text = model.gains(checks)
        for margin in (1, 2, 3, 5):
            x = _features(gain, text, len(y), margin)[:, :4]
            w = np.zeros(4)
            for _ in range(60):
                p = _sigmoid(x @ w)
                slope, bend = x.T @ (weight * (p - y)) + 0.05 * w, (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
                w -= np.linalg.solve(bend, slope)
            p = np.clip(_sigmoid(x @ w), 1e-6, 1 - 1e-6)
            loss = -np.mean(weight * (y * np.log(p) + (1 - y) * np.log(1 - p)))
            if best is None or loss < best[0] - 1e-4:
                best = (loss, ToxicityModel(model.toxic, base, margin, tuple(map(float, w))))
    return best[1]


def fold(id_col: str) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo 5.  Fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_sample: int = TOXIC_SAMPLE, ordinary_sample: int = ORDINARY_SAMPLE, sample_chars: int = SAMPLE_CHARS) -> ToxicityModel:
    """Learn from a bounded sample of labelled rows that aren't held out: per class the first by a hash of their id.

    At most ``toxic_sample`` and ``ordinary_sample`` ids are drawn; of their documents those of more than
    ``sample_chars`` code points don't train, so the sample may be smaller.  Rows without id or label don't count;
    of several labels of a document the largest does.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 0)).groupBy(F.col(id_col).alias("q_id")).agg(F.max(label_col).alias("q_label"))
    drawn = [known.where(F.col("q_label") == label).orderBy(F.xxhash64(F.lit(6), F.col("q_id")), "q_id").limit(most) for label, most in ((1, toxic_sample), (0, ordinary_sample))]
    chosen = drawn[0].unionByName(drawn[1])  # at most the two samples' ids
    rows = docs.where(F.char_length(text_col) <= sample_chars).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).join(F.broadcast(chosen), F.col("id") == F.col("q_id"))
    got = rows.select("q_label", F.xxhash64(F.lit(6), F.col("id")).alias("h"), "t").collect()
    texts = {label: [bytes(r["t"]) for r in sorted(got, key=lambda r: (r["h"], bytes(r["t"]))) if r["q_label"] == label] for label in (1, 0)}
    return learn(texts[1][:toxic_sample], texts[0][:ordinary_sample])


def scored(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits, windows) of every row.  Null and blank texts have no window, and the score of none."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                x = model.features(part.column(1))
                scores = _sigmoid(x[:, :4] @ np.array(model.coefficients))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(x[:, 4].astype(np.int64)), pa.array(x[:, 5].astype(np.int64))], names=["id", "score", "hits", "windows"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {kind}, score double, hits bigint, windows bigint")


def digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: whether it is held out, its score, the predicted label and the windows that count.

    Equal rows get equal scores, an empty table stays empty, texts are read whole, other columns are not read.
    """
    out = scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
