"""Hierarchical multi-length packing of token sequences."""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import IS_SPACE, chunks, column_bytes

#: Context sizes of the tiers; the last is the longest window.
TIERS = (256, 512, 1024, 2048)
#: Tokens that a task gathers before it packs them, and sequences of a step group.
POOL, GROUP = 2_000_000, 16
#: Bytes of text whose pieces are told apart at once.
CHUNK = 1 << 23

# White space that is not ASCII's (and the separators of which engines disagree): such texts go to the tokenizer whole.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_HINTS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
# Byte-level BPE's cut of a text into pre-tokens; repetitions are possessive, which changes no match and saves steps.
_CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def _byte_letters() -> dict[int, str]:
    """The character that byte-level BPE writes for each byte: itself where it prints, else the next free one."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Ids:
    """Token ids of UTF-8 texts, those of the tokenizer file at ``path``.

    No pre-token reaches from a word into the white space behind it, so a text is cut before each run of white
    space into pieces whose ids do not depend on what stands around them.  The distinct pieces of many texts are
    found at once, tokenized once, and their ids gathered.  Where the file is plain byte-level BPE whose merges
    stand in the order of their ids, a faster engine reads the same merges; any other file is read piece by piece.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"].encode() for t in parts["added_tokens"]]
        before, model = parts["pre_tokenizer"] or {}, parts["model"]
        unusual = model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")
        plain = not parts["normalizer"] and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model["type"] == "BPE" and not unusual
        self.engine = self._ranked(model) if plain else None
        #: whether cutting at white space is sound
        self.cuts = plain

    def _ranked(self, model: dict):
        byte = {c: b for b, c in _byte_letters().items()}
        merged = [model["vocab"]["".join(m) if not isinstance(m, str) else m.replace(" ", "")] for m in model["merges"]]
        singles = {c for c in model["vocab"] if len(c) == 1}
        if any(a >= b for a, b in zip(merged[:-1], merged[1:], strict=True)) or singles != set(byte) or len(merged) + 256 != len(model["vocab"]) or max(model["vocab"][c] for c in singles) > merged[0]:
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items()}
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        return tiktoken.Encoding("ranked", pat_str=_CUT, mergeable_ranks=ranks, special_tokens={})

    def _whole(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)

    def _tokenized(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each piece one after another, and how many each has."""
        if self.engine is None:
            found = [self._whole(p) for p in pieces.to_pylist()]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(f) for f in found], np.int64)
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset + 1 : pieces.offset + 1 + len(pieces)]
        begin = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset]
        text = bytes(memoryview(pieces.buffers()[2])[begin : ends[-1]]) if len(pieces) else b""
        got = np.array(self.engine.encode_ordinary(text.decode()), np.uint32)
        upto = np.searchsorted(np.cumsum(self.widths[got]), ends - begin, "left") + 1  # a piece's end is a token's end
        return got, np.diff(upto, prepend=0)

    def of(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's start (one more entry at the end).

        Texts are a binary array; a null is an empty text.  ``end`` goes behind each text's ids.
        """
        tail = [] if end is None else [end]
        flat, starts = column_bytes(texts)
        held = flat.tobytes()
        odd = np.zeros(len(texts), bool)
        if not self.cuts or any(x in held for x in (*_HINTS, *self.specials)):
            for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                part = held[a:b]
                odd[i] = not self.cuts or any(s in part for s in self.specials) or _OTHER_SPACE.search(part) is not None
        # pieces: from the start of a text or of a run of white space to the next one
        space = IS_SPACE[flat]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        filled = starts[:-1] < starts[1:]
        cut[starts[:-1][filled]] = True
        at = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(flat)).astype(np.int64)), pa.py_buffer(flat)]).dictionary_encode()
        which, distinct = pieces.indices.to_numpy(), pieces.dictionary
        # pieces that start with a word, or end in white space, would run together with their neighbours
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[: len(distinct) + 1]
        body = np.frombuffer(distinct.buffers()[2], np.uint8) if len(distinct) else flat
        apart = ~IS_SPACE[body[ends[:-1]]] | IS_SPACE[body[ends[1:] - 1]]
        found, n = np.empty(0, np.uint32), np.zeros(len(distinct), np.int64)
        begin = np.zeros(len(distinct), np.int64)
        joint = np.flatnonzero(~apart)
        if len(joint):
            found, n[joint] = self._tokenized(distinct.take(pa.array(joint)))
            begin[joint] = np.cumsum(n[joint]) - n[joint]
        rest = [self._tokenized(distinct.slice(int(i), 1))[0] for i in np.flatnonzero(apart)]
        n[apart] = [len(r) for r in rest]
        begin[apart] = len(found) + np.cumsum(n[apart]) - n[apart]
        found = np.concatenate([found, *rest, np.array(tail, np.uint32)])
        # the end is one more piece behind each text's
        per_text = np.searchsorted(at, starts)
        if tail:
            which = np.insert(which, per_text[1:], len(n))
            n, begin = np.append(n, 1), np.append(begin, len(found) - 1)
            per_text = per_text + np.arange(len(per_text))
        count = n[which]
        upto = np.append(0, np.cumsum(count))
        out = found[np.arange(upto[-1]) + np.repeat(begin[which] - upto[:-1], count)]
        starts_out = upto[per_text]
        if odd.any():
            parts = [np.append(self._whole(held[starts[i] : starts[i + 1]]), np.array(tail, np.uint32)) if odd[i] else out[starts_out[i] : starts_out[i + 1]] for i in range(len(texts))]
            out, starts_out = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
        return out.astype("<u4"), starts_out


@functools.lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    """One for each worker process and file: workers outlive tasks."""
    return Ids(path)


class Packer:
    """Packs pieces (document, start, length) of one task.  ``done`` gets lists of them, each list a sequence.

    Whole windows of the longest tier leave a document first.  What remains is routed to the smallest tier that
    holds it.  Tiers are packed from the longest: a window starts with a piece of its own tier, and its gap is
    filled by the longest pieces that fit, from its tier and then from shorter ones; the last bit of a gap takes
    the head of a short piece.  Windows that stay open wait for the next pool.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers))
        self.by_length: dict[int, deque] = {}
        self.waiting = 0
        self.done: list[list[tuple[int, int, int]]] = []

    def add(self, doc: int, n: int) -> None:
        longest, at = self.tiers[-1], 0
        while n - at >= longest:
            self.done.append([(doc, at, longest)])
            at += longest
        if n > at:
            self._put((doc, at, n - at))

    def _put(self, piece: tuple[int, int, int]) -> None:
        self.by_length.setdefault(piece[2], deque()).append(piece)
        self.waiting += piece[2]

    def _take(self, length: int) -> tuple[int, int, int]:
        piece = (held := self.by_length[length]).popleft()
        self.waiting -= length
        if not held:
            del self.by_length[length]
        return piece

    def pack(self) -> None:
        """Pack all that waits into full windows, the longest tier first, then what is left over."""
        for k in range(len(self.tiers) - 1, -1, -1):
            window, above = self.tiers[k], self.tiers[k - 1] if k else 0
            lengths = sorted(self.by_length)  # kept in step with by_length below
            while lengths and lengths[-1] > above and self.waiting >= window:
                made, room = [], window
                while room:
                    i = bisect.bisect_right(lengths, room) - 1
                    if i < 0:  # nothing fits whole: the head of the shortest fills the gap, its tail waits
                        doc, at, n = self._take(lengths[0])
                        if n not in self.by_length:
                            lengths.pop(0)
                        made.append((doc, at, room))
                        self._put((doc, at + room, n - room))
                        if n - room not in lengths:
                            bisect.insort(lengths, n - room)
                        room = 0
                        continue
                    made.append(self._take(lengths[i]))
                    room -= lengths[i]
                    if lengths[i] not in self.by_length:
                        lengths.pop(i)
                self.done.append(made)

    def close(self) -> None:
        """Cut the left-over, which fills no window, into sequences whose lengths are powers of two: no padding."""
        self.pack()
        left = [p for n in sorted(self.by_length, reverse=True) for p in self.by_length[n]]
        self.by_length, room, made = {}, 0, []
        total = self.waiting
        self.waiting = 0
        for doc, at, n in left:
            while n:
                if not room:
                    room = 1 << (total.bit_length() - 1)
                m = min(n, room)
                made.append((doc, at, m))
                at, n, room, total = at + m, n - m, room - m, total - m
                if not room:
                    self.done.append(made)
                    made = []


def _sequences(batches: Iterator[pa.RecordBatch], task: int, path: str, end_id: int, tiers: tuple[int, ...], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    ids, packer, docs, sequence = ids_of(path), Packer(tiers), [], 0

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        # balance: sequences are dealt to step groups by length, longest first, in turns
        made = sorted(packer.done, key=lambda s: -sum(p[2] for p in s))
        packer.done = []
        groups = max(1, -(-len(made) // GROUP))
        rows: list[tuple] = []
        for i, pieces in enumerate(made):
            number, offset, length = (task << 33) + sequence, 0, sum(p[2] for p in pieces)
            turn, place = divmod(i, groups)
            group = place if turn % 2 == 0 else groups - 1 - place
            for doc, at, n in pieces:
                doc_id, tokens = docs[doc]
                rows.append((doc_id, at, n, zlib.crc32(tokens[at : at + n].tobytes()), len(tokens), number, offset, length, (task << 33) + sequence - i + group))
                offset += n
            sequence += 1
        for a in range(0, len(rows), 20_000):
            part = list(zip(*rows[a : a + 20_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], id_type), *[pa.array(c, pa.int64()) for c in part[1:]]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"])

    def forget() -> None:
        nonlocal docs
        held = sorted({p[0] for d in packer.by_length.values() for p in d})
        new = {old: i for i, old in enumerate(held)}
        docs = [(docs[i][0], docs[i][1].copy()) for i in held]  # copies let the chunks go
        packer.by_length = {n: deque((new[d], a, m) for d, a, m in x) for n, x in packer.by_length.items()}

    held = 0
    for batch in batches:
        for part in chunks(batch, 1, CHUNK):
            flat, starts = ids.of(part.column(1), end_id)
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                tokens = flat[starts[i] : starts[i + 1]]
                packer.add(len(docs), len(tokens))
                docs.append((doc_id, tokens))
                held += len(tokens)
            if held > POOL:
                packer.pack()
                yield from emit()
                forget()
                held = sum(len(d[1]) for d in docs)
    packer.close()
    yield from emit()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """Pieces of packed sequences, a row each: which ids of which document lie where in which sequence.

    Every task packs its own split of the input, so nothing is shuffled and one lost executor repeats its tasks
    only.  A null or empty text is the end id alone; each of several equal rows is packed; an empty table gives
    no piece.  ``sequence_length`` is a tier's or, for a task's last few sequences, a smaller power of two.
    ``step_group`` deals sequences of alike lengths evenly to groups of at most 16.  Long texts are cut into
    whole windows as they come; a task holds about two million tokens.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _sequences(batches, TaskContext.get().partitionId(), tokenizer, end_id, tiers, to_arrow_type(id_type))

    id_type = docs.schema[id_col].dataType
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint, step_group bigint"
    return slim.mapInArrow(run, schema)
