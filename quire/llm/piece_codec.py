"""SentencePiece ids of whole texts and texts of ids, by a table of distinct marked words."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import chunks, column_bytes, own_columns, own_rows

#: Bytes of text whose words are told apart at once; words that a worker remembers, and their greatest length in bytes.
CHUNK, REMEMBERED, SHORT = 1 << 20, 1 << 17, 64
#: The white space marker, as a character and in UTF-8.
MARKER = "▁"
_MARKER_BYTES = MARKER.encode()


class Codec:
    """Ids of UTF-8 texts by the model file at ``path``, with begin and end ids, and texts of ids.

    A marked word is a run of markers (spaces) with what stands behind it up to the next run.  Where no piece of a
    BPE model holds a marker behind another character, no merge crosses into the next marked word, so its ids don't
    depend on its neighbours.  The same holds in front of ASCII characters that are in no piece (line ends, as a
    rule): they stand alone as byte ids, and words are cut there as well.  Each distinct marked word of many texts
    is segmented once and remembered; ids are joined back by position.

    Where the model is of another kind, or a text holds the marker itself, whole texts go to the library.
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.marker = self.library.bos_id(), self.library.eos_id(), self.library.piece_to_id(MARKER)
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        how, kinds = model.normalizer_spec, model.SentencePiece
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces
        plain &= model.trainer_spec.model_type == model.trainer_spec.BPE and not model.trainer_spec.treat_whitespace_as_suffix
        pieces = [p.piece for p in model.pieces if p.type not in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE)]
        within = re.compile(f"[^{MARKER}]{MARKER}")
        #: whether cutting into marked words is sound for this model
        self.cuts = plain and self.marker != self.library.unk_id() and not any(within.search(p) for p in pieces) and not any(p.type == kinds.USER_DEFINED for p in model.pieces)
        used = set().union(*map(set, pieces)) | {" "}
        self.alone = np.zeros(256, bool)
        self.alone[[b for b in range(128) if chr(b) not in used]] = True
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array([self.begin, *self.library.encode(text.decode()), self.end], np.uint32)

    def _segmented(self, words: list[bytes]) -> list[bytes]:
        """The ids of marked words, as bytes; each word begins with a space, or with a character that stands alone."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = [w for w in words if w not in self.known]
        # the library puts a marker in front of what it is given: a word's own, or one to be dropped again
        given = self.library.encode([(w[1:] if w[0] == 32 else w).decode() for w in new], num_threads=1)
        made = {w: np.array([self.marker] if w == b" " else ids if w[0] == 32 else ids[1:], np.uint32).tobytes() for w, ids in zip(new, given, strict=True)}
        found = [made[w] if w in made else self.known[w] for w in words]
        self.known.update((w, ids) for w, ids in made.items() if len(w) <= SHORT)
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and each text's start (one more entry at the end); a null is an empty text."""
        flat, starts = column_bytes(texts)
        held = flat.tobytes()
        odd = np.zeros(len(texts), bool)
        if not self.cuts or _MARKER_BYTES in held:
            odd = np.array([not self.cuts or _MARKER_BYTES in held[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)], bool)
        filled = (starts[1:] > starts[:-1]) & ~odd
        # each text with the marker that the model puts in front of it
        marked = np.insert(flat, starts[:-1][filled], 32)
        moved = starts + np.append(0, np.cumsum(filled))
        space, alone = marked == 32, self.alone[marked]
        cut = space | alone
        cut[1:] &= ~(space[1:] & space[:-1]) & ~(alone[1:] & alone[:-1])
        cut[moved[:-1][filled]] = True
        cut[np.repeat(odd, np.diff(moved))] = False
        cut[moved[:-1][odd & (np.diff(moved) > 0)]] = True  # one piece, whose ids are not used
        at = np.flatnonzero(cut)
        words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(marked)).astype(np.int64)), pa.py_buffer(marked)])
        first = np.searchsorted(at, moved)
        if odd.any():
            words = pa.array([b" " if o else w for o, w in zip(np.repeat(odd, np.diff(first)).tolist(), words.to_pylist(), strict=True)], pa.large_binary())
        words = words.dictionary_encode()
        which = words.indices.to_numpy().astype(np.int64)
        ids = self._segmented(words.dictionary.to_pylist())
        # begin and end are two more words, around each text's
        n = np.array([*[len(x) // 4 for x in ids], 1, 1], np.int64)
        which = np.insert(which, np.repeat(first, 2)[1:-1], np.tile([len(ids), len(ids) + 1], len(texts))) if len(texts) else which
        first = first + 2 * np.arange(len(first))
        found, begin = np.frombuffer(b"".join([*ids, np.array([self.begin, self.end], np.uint32).tobytes()]), np.uint32), np.cumsum(n) - n
        count = n[which]
        upto = np.append(0, np.cumsum(count))
        out, at = found[np.arange(upto[-1]) + np.repeat(begin[which] - upto[:-1], count)], upto[first]
        if odd.any():
            parts = [self._whole(held[starts[i] : starts[i + 1]]) if odd[i] else out[at[i] : at[i + 1]] for i in range(len(texts))]
            out, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return out, at

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


@functools.cache
def codec(path: str) -> Codec:
    """One for each worker and file."""
    return Codec(path)


def model_path(path: str | None = None) -> str:
    """The model file; without a path, that of the public tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a column ``ids``: the ids of each whole text with begin and end, as little-endian unsigned 32-bit integers.

    ``path`` names the model file on every executor; ``keep`` names the columns to carry along, if not all.  Ids are those of the library without sampling.  A null text
    is empty and has begin and end alone; rows are not compared, so repeated ones stay; an empty table gives an
    empty result.  ``ids`` gets an underscore where that name is taken.  No row leaves its partition.
    """
    path = model_path(path)
    keep = docs.columns if keep is None else keep
    text = F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("q_own"), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                ids, at = codec(path).encode(part.column(1))
                packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column(0), packed.cast(pa.binary())], names=["q_own", "ids"])

    made = rows.mapInArrow(run, f"q_own {rows.schema['q_own'].dataType.simpleString()}, ids binary")
    return own_columns(made, keep, ids=F.col("ids"))


def decode(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with a column ``decoded``: the library's text of the ids, which are packed as ``encode`` packs them.

    Null ids give a null; ``decoded`` gets an underscore where that name is taken.
    """
    path = model_path(path)
    own = own_rows(rows, packed=F.col(f"`{ids_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1, CHUNK):
                texts = [None if x is None else codec(path).decode(np.frombuffer(x.as_buffer(), "<u4")) for x in (v if v.is_valid else None for v in part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["q_own", "decoded"])

    made = own.mapInArrow(run, f"q_own {own.schema['q_own'].dataType.simpleString()}, decoded string")
    return own_columns(made, rows.columns, decoded=F.col("decoded"))


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: how many ids, and the hashes of its ids and of the text they decode to; see ``encode``."""
    coded = decode(encode(docs, path=path, keep=["doc_id"]).select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), path=path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
