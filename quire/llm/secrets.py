"""Secret scans: patterns propose, structure confirms."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which equal starts are listed: three of the base, two that need a structure.
KINDS = ("assign", "access", "hex", "key", "token")

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
# A DER sequence in hex whose first item is a version; bytes may stand apart by colons, white space or escaped line ends.
_GAP = r"(?::|\s|\\[nrt]){0,8}"
_ANY_HEX = re.compile(rf"(?<![0-9A-Fa-f])30(?={_GAP}(?:[0-7][0-9A-Fa-f]|8[1-4](?:{_GAP}[0-9A-Fa-f]{{2}}){{1,4}}){_GAP}02{_GAP}01{_GAP}0[01])")
_BYTE = re.compile(rf"{_GAP}([0-9A-Fa-f]{{2}})")
_BEGIN, _END = (re.compile(rf"-----{w} ([A-Z0-9 ]*)PRIVATE KEY(?=-----)") for w in ("BEGIN", "END"))
# What base64 of a DER sequence, of an OpenSSH key and of a PEM block starts with; an escaped line end may stand before it.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\[nrt]))(?:M[A-P]|b3BlbnNzaC1r|LS0tLS1CRUdJTi)[A-Za-z0-9+/_-]{8,}")
_BREAKS = r"(?:\s|\\[nrt])*"
_LETTER = re.compile(rf"{_BREAKS}((?:[A-Za-z0-9+_-]|\\?/)+)")
_PADDING = re.compile(rf"{_BREAKS}=(?:{_BREAKS}=)?")
_HEADERS = re.compile(r"\A(?:\s*[A-Za-z0-9-]+:[^\n]*\n(?:[ \t]+[^\n]*\n)*)+")
_CIPHER = re.compile(r"^DEK-Info:\s*[A-Z0-9-]+,\s*((?:[0-9A-Fa-f]{2}){8,})\s*$", re.MULTILINE)
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]{8,})(?![A-Za-z0-9_-]))")
_MAGIC = b"openssh-key-v1\x00"
#: Least lengths of what a pattern without white space matches.
_SHORTEST = 20


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items that fill ``data`` exactly, or None if a length doesn't fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        items.append((tag, data[at : at + n]))
        at += n
    return items


def der_private_key(data: bytes) -> bool:
    """Whether ``data`` is a DER private key: RSA (nine integers), EC (version 1 and octets) or PKCS#8 (version, algorithm, octets)."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30 or not (inner := der_items(top[0][1])):
        return False
    tags = [t for t, _ in inner]
    if inner[0] not in ((0x02, b"\x00"), (0x02, b"\x01")):
        return False
    if len(tags) == 9 and set(tags) == {0x02}:
        return True
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\x01":
        return len(inner[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[:3] == [0x02, 0x30, 0x04]:
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def ssh_private_key(data: bytes) -> bool:
    """Whether ``data`` is an OpenSSH private key: its magic and length-prefixed fields, nested ones too."""
    if not data.startswith(_MAGIC):
        return False
    at, fields = len(_MAGIC), []

    def take() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    for _ in range(3):
        fields.append(take())
    if None in fields:
        return False
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 16 and all(take() for _ in range(keys + 1))


def private_key(data: bytes) -> bool:
    return der_private_key(data) or ssh_private_key(data)


def encrypted_key(data: bytes) -> bool:
    """Whether ``data`` is a DER encrypted PKCS#8 key: an algorithm and octets."""
    top = der_items(data)
    inner = der_items(top[0][1]) if top and len(top) == 1 and top[0][0] == 0x30 else None
    if not inner or [t for t, _ in inner] != [0x30, 0x04] or len(inner[1][1]) < 16:
        return False
    algorithm = der_items(inner[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06


def armoured_key(label: str, body: str) -> bool:
    """Whether the body of a PEM block is a private key: line ends may be escaped, header lines may come first.

    A key under a cipher that a header names can't be parsed; its body must be whole blocks.
    """
    text = re.sub(r"\\[nrt]", "\n", body).replace("\\/", "/")
    headers = _HEADERS.match(text)
    data = _decoded(text[headers.end() :] if headers else text)
    if private_key(data) or label.startswith("ENCRYPTED") and encrypted_key(data):
        return True
    cipher = _CIPHER.search(headers[0]) if headers else None
    return bool(cipher and len(data) >= 32 and len(data) % (len(cipher[1]) // 2) == 0)


def armoured_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of the blocks from a key's beginning to the next end of that label, leftmost, without overlap.

    Ends are found once and looked up, so a text of many beginnings costs no more than its length.
    """
    ends: dict[str, list[int]] = {}
    for m in _END.finditer(text):
        ends.setdefault(m[1], []).append(m.start())
    upto = 0
    for m in _BEGIN.finditer(text) if ends else ():
        known, after = ends.get(m[1], []), m.end() + 5
        k = bisect.bisect_left(known, after)
        if m.start() >= upto and k < len(known):
            upto = known[k] + len("-----END PRIVATE KEY-----") + len(m[1])
            yield m.start(), upto, m[1], text[after : known[k]]


def _hex_key(text: str, at: int) -> int | None:
    """Where the key in hex that starts at ``at`` ends, None if there is none; its own length says how far it goes."""
    head = bytes.fromhex("".join(_bytes_from(text, at, 6)[0]))
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    if size < 40 or 2 * size > len(text) - at:
        return None
    found, end = _bytes_from(text, at, size)
    if len(found) < size or text[end : end + 1] and text[end] in "0123456789abcdefABCDEF":
        return None
    return end if private_key(bytes.fromhex("".join(found))) else None


def _bytes_from(text: str, at: int, n: int) -> tuple[list[str], int]:
    """Up to ``n`` bytes in hex from a place on, and where they end."""
    out: list[str] = []
    while len(out) < n and (m := _BYTE.match(text, at)):
        out.append(m[1])
        at = m.end()
    return out, at


class _Runs:
    """Long runs of wrapped letters that were walked in vain: starts that would decode the same bytes again are passed over."""

    def __init__(self) -> None:
        self.end, self.starts, self.before, self.dead = -1, [], [], set()

    def spent(self, at: int) -> bool:
        """Whether a start reads what an earlier one of the same run has read, with its letters in the same fours."""
        return at < self.end and self._letters(at) % 4 in self.dead

    def walked(self, at: int, end: int, parts: list[tuple[int, int]]) -> None:
        """``parts`` are the places of the run's pieces and how many letters stand before them."""
        if at >= self.end:
            self.end, self.dead = end, set()
            self.starts, self.before = [p for p, _ in parts], [n for _, n in parts]
        self.dead.add(self._letters(at) % 4)

    def _letters(self, at: int) -> int:
        k = max(0, bisect.bisect_right(self.starts, at) - 1)
        return self.before[k] + at - self.starts[k]


def _wrapped(text: str, at: int, runs: _Runs) -> tuple[int, bytes] | None:
    """The key in base64 that starts at ``at``: where it ends, and its bytes; lines may be wrapped, ends escaped.

    How far it goes is written in it: the length of the DER sequence.  OpenSSH keys and PEM blocks go as far as
    their letters do.
    """
    first = _LETTER.match(text, at)[1][:16]
    der = first.startswith("M")
    if der:
        head = _decoded(first[: len(first) // 4 * 4])
        width = head[1] & 0x7F if head[1:2] and head[1] & 0x80 else 0
        if len(head) < 2 + width or width > 4:
            return None
        size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
        wanted = -(-size * 4 // 3)  # letters, without padding
        # what a private key's sequence begins with; anything else isn't read any further
        if wanted > len(text) - at or (len(head) >= 5 + width and (head[2 + width : 4 + width] != b"\x02\x01" or head[4 + width] > 1)):
            return None
    elif runs.spent(at):
        return None
    letters, n, end, parts = [], 0, at, []
    while not der or n < wanted:
        part = _LETTER.match(text, end)
        if part is None or not der and part.start(1) > end and len(part[1]) < 16:
            break
        got = part[1].replace("\\/", "/")
        if not der:
            parts.append((part.start(1), n))
            if "\\/" in part[1]:  # a letter of two characters: from here on places say less than letters
                parts += [(part.start(1) + m.end(), n + m.end() - i - 1) for i, m in enumerate(re.finditer(r"\\/", part[1]))]
        if der and n + len(got) > wanted:
            return None  # the letters run on behind what the length says
        letters.append(got)
        n, end = n + len(got), part.end()
    if der and n < wanted:
        return None
    if not der:
        runs.walked(at, end, parts)
    padding = _PADDING.match(text, end) if n % 4 else None
    return (padding.end() if padding else end), _decoded("".join(letters))


def signed_token(head: str, body: str) -> bool:
    """Whether ``head`` decodes to a JSON object that names an algorithm, and ``body`` decodes."""
    try:
        header = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def _decoded(text: str) -> bytes:
    """The bytes of base64 in either alphabet, with or without padding; none if it is neither."""
    letters = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(letters + "=" * (-len(letters) % 4), validate=True)
    except (ValueError, binascii.Error):
        return b""


def base_spans(text: str, long_words: bool = True) -> list[tuple[str, int, int]]:
    """Matches of the three patterns, leftmost and without overlap within a kind, short ones dropped."""
    found = []
    low = text.lower()
    if any(name in low for name in _NAMES):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if long_words:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def confirmed_spans(text: str, long_words: bool = True) -> list[tuple[str, int, int]]:
    """Candidates whose decoded bytes have the structure of a private key or of a signed token."""
    found = []
    if "PRIVATE KEY-----" in text:
        found = [("key", a, b) for a, b, label, body in armoured_blocks(text) if armoured_key(label, body)]
    upto, inside, k, runs = 0, list(found), 0, _Runs()
    for m in _BASE64.finditer(text):
        at = m.start()
        while k < len(inside) and inside[k][2] <= at:
            k += 1
        if at < upto or k < len(inside) and inside[k][1] <= at:
            continue
        got = _wrapped(text, at, runs)
        if got and (private_key(got[1]) or any(armoured_key(label, body) for _, _, label, body in armoured_blocks(got[1].decode("latin-1")))):
            upto = got[0]
            found.append(("key", at, upto))
    upto = 0
    for m in _ANY_HEX.finditer(text):
        if m.start() >= upto and (end := _hex_key(text, m.start())):
            upto = end
            found.append(("key", m.start(), end))
    if long_words:
        upto = 0
        for m in _SIGNED.finditer(text):
            if m.start() >= upto and signed_token(m[1], m[2]):
                upto = m.end(3)
                found.append(("token", m.start(), upto))
    return found


def spans(text: str) -> list[tuple[str, int, int]]:
    """All spans by start, then kind; offsets are code points, ends exclusive.

    Keys may be wrapped at any width.  All else that is looked for is at least 20 characters without white space.
    """
    long_words = any(len(w) >= _SHORTEST for w in text.split())
    found = base_spans(text, long_words) + confirmed_spans(text, long_words)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, the spans as an array of (kind, start, end), counts and digests.

    Null and empty texts have none.  Rows are judged one by one: equal rows get equal spans, an empty table stays
    empty, long texts are read whole, and other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                found = spans(text) if text else []
                base = [s for s in found if s[0] in KINDS[:3]]
                counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), [{"kind": k, "start": a, "end": b} for k, a, b in found]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [span]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])

    schema = f"doc_id {kind.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mask`` (overlapping spans by one); other columns as they were.

    Null texts stay null, empty ones empty; equal rows are masked alike; an empty table stays empty; columns of any
    name and type may come along.  Long texts are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text in batch.column(at).to_pylist():
                ranges: list[list[int]] = []
                for _, a, b in spans(text) if text else []:
                    if ranges and a < ranges[-1][1]:
                        ranges[-1][1] = max(ranges[-1][1], b)
                    else:
                        ranges.append([a, b])
                for a, b in reversed(ranges):
                    text = text[:a] + mask + text[b:]
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
