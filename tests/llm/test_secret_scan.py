"""Secret scans of long and awkward texts: time in proportion, keys in hex with gaps, tokens behind dots."""

import base64
import json
import time

import pytest

from quire.llm.secrets import armoured_blocks, spans


def _item(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


KEY = _item(0x30, _item(2, b"\x00") + b"".join(_item(2, bytes([1]) + bytes(range(60 + i))) for i in range(8)))
TOKEN = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (json.dumps({"alg": "HS256"}).encode(), b'{"sub":"1"}', b"signature bytes"))


@pytest.mark.parametrize("gap, width", [("", 0), ("\n", 64), ("\n   ", 32), (":", 2), ("\\n", 40), (" ", 2)])
def test_keys_in_hex(gap, width):
    plain = KEY.hex()
    text = gap.join(plain[i : i + width] for i in range(0, len(plain), width)) if width else plain
    assert [s for s in spans(f"x {text} y") if s[0] == "key"] == [("key", 2, 2 + len(text))]
    assert [s for s in spans(f"x {text.upper() if gap != chr(92) + 'n' else text} deadbeef") if s[0] == "key"] == [("key", 2, 2 + len(text))]
    assert not [s for s in spans(f"x {text[:-2]}") if s[0] == "key"] and not [s for s in spans(f"x {text}0") if s[0] == "key"]


@pytest.mark.parametrize("before", ["", "v.", "v1.local.", "aaaaaaaaaa.", "aaaaaaaaaa.bbbbbbbb.", '"'])
def test_tokens_behind_dots(before):
    assert [s for s in spans(f"{before}{TOKEN}. {TOKEN}") if s[0] == "token"] == [("token", len(before), len(before) + len(TOKEN)), ("token", len(before) + len(TOKEN) + 2, len(before) + 2 * len(TOKEN) + 2)]


def test_blocks_are_those_of_the_pattern():
    import random
    import re

    rng = random.Random(1)
    parts = ["-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "-----END PRIVATE KEY-----", "x\n", "-----", "-----BEGIN ", "RSA ", "PRIVATE KEY"]
    pattern = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----(.*?)-----END \1PRIVATE KEY-----", re.DOTALL)
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert list(armoured_blocks(text)) == [(*m.span(), m[1], m[2]) for m in pattern.finditer(text)], text


@pytest.mark.parametrize("line", ["-----BEGIN RSA PRIVATE KEY-----", base64.b64encode(b"-----BEGIN RSA PRIVATE KEY-----\n").decode().rstrip("="), base64.b64encode(b"openssh-key-v1\0aaaaaaaaaaaaaaaaa").decode().rstrip("="), "aaaaaaaa.bbbbbbbb."])
def test_long_texts_take_their_length(line):
    """Ten megabytes of beginnings without ends."""
    text = (line + "\n") * (10_000_000 // (len(line) + 1))
    began = time.time()
    assert spans(text) == [] and time.time() - began < 30


def test_a_key_behind_false_starts():
    """Starts that lead nowhere do not hide a key behind them, whatever their distance."""
    block = base64.b64encode(b"-----BEGIN PRIVATE KEY-----\n" + base64.b64encode(KEY) + b"\n-----END PRIVATE KEY-----\n").decode()
    false = base64.b64encode(b"-----BEGIN PRIVATE KEY-----").decode()
    for n in range(5):
        text = (false + "\n") * 3 + "A" * (16 + n) + " . " + block
        assert [s for s in spans(text) if s[0] == "key"] == [("key", text.index(block), len(text))]
