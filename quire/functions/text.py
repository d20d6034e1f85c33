"""Text normalisation as column expressions: they stay in generated code and are pushed where Catalyst likes."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Java's ``\s`` leaves out is spelled out.
ANY_SPACE = r"[\s\x{3000}\x{A0}]"
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_DIGITS = ("〇零一二三四五六七八九", "00123456789")


def half_width(text: Column) -> Column:
    """Full-width forms and the ideographic space as ASCII."""
    return F.translate(text, _FULL, _HALF)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once and named, where an expression would repeat it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# The marks that a comparison of texts passes over.
PASSED_OVER = "：:，,。；;（）()[]〖〗<>《》‘’“”\"'-_/|"
HAN = "[\u4e00-\u9fff]"


def match_key(text: Column) -> Column:
    """Lower case without white space and the listed marks: what two spellings of a name have in common."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ANY_SPACE, ""), PASSED_OVER, "")


def squeezed(text: Column) -> Column:
    """Unix line ends, ASCII brackets, colons and semicolons, single spaces, none between ideographs, at most one blank line, trimmed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    out = F.translate(out, "（）：；\u00a0\u3000", "():;  ")
    out = F.regexp_replace(F.regexp_replace(out, f"(?<={HAN})[ \\t]+(?={HAN})", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"\A\s+|\s+\z", "")


def compact(text: Column) -> Column:
    return F.regexp_replace(squeezed(text), ANY_SPACE, "")


def clean_value(text: Column) -> Column:
    """Without colons, commas and semicolons at the edges, spaces single; null when nothing is left."""
    edges = r"[\s\x{3000}\x{A0}:：,，;；]"
    return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, f"\\A{edges}+|{edges}+\\z", ""), r"[ \t]+", " "), r"\A\s+|\s+\z", ""), F.lit(""))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """The cleaned group of the first pattern, in their order, that is found."""
    found = F.lit(None).cast("string")
    for pattern in reversed(patterns):
        found = F.when(text.rlike(pattern), clean_value(F.regexp_extract(text, pattern, group))).otherwise(found)
    return found


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    """The cleaned groups of all matches, once each, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), clean_value)
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull()))


def key_name(text: Column) -> Column:
    """A form's key without the colons and semicolons that trail it."""
    return F.regexp_replace(F.trim(text), r"[:：;；\s]+\z", "")


def alphanumeric(text: Column) -> Column:
    """ASCII letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(text, "[^0-9A-Za-z]", ""))


def escaped(text: Column) -> Column:
    """HTML's five escapes."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def without(text: Column, parts: list[str]) -> Column:
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def spaced_words_joined(text: Column) -> Column:
    """Text recognised letter by letter: three spaces are one, single spaces go."""
    return F.replace(F.replace(F.replace(text, F.lit("   "), F.lit("\x01")), F.lit(" "), F.lit("")), F.lit("\x01"), F.lit(" "))


def display_width(text: Column) -> Column:
    """Characters, of which two ASCII letters, digits or spaces count as one, rounded up."""
    half = F.length(F.regexp_replace(text, "[^A-Za-z0-9 ]", ""))
    return F.length(text) - half + F.ceil(half / F.lit(2)).cast("int")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; two empty texts are equal."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points of texts of any length, bit-parallel (Myers, Hyyrö): a column of the table is one integer."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    start = len(os.path.commonprefix((a, b)))
    a, b = a[start:], b[start:]
    end = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not b:
        return len(a)
    n = len(a)
    full, last = (1 << n) - 1, n - 1
    letters = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    places = {c: int.from_bytes(np.packbits(letters == ord(c), bitorder="little").tobytes(), "little") for c in set(b) & set(a)}
    up, down, found = full, 0, n
    for i, c in enumerate(b):
        eq = places.get(c, 0)
        same = (((eq & up) + up ^ up) | eq | down) & full if eq else down
        less = up & same
        more = down | (full ^ (same | up))
        # bits from the last place on are few: reading them costs nothing, as do those that steps leave beyond it
        found += (more >> last & 1) - (less >> last & 1)
        more = more << 1 | 1
        up = less << 1 | (full ^ (same | more))
        down = more & same
        if not i & 63:
            up &= full
    return found


def ideographic_year(text: Column) -> Column:
    """The four digits, ASCII or ideographic, that a text holds, as an integer; null if there are more or fewer."""
    digits = F.regexp_replace(F.translate(text, *_DIGITS), "[^0-9]", "")
    return F.when(F.length(digits) == 4, digits.cast("int"))


def ideographic_small(text: Column) -> Column:
    """Digits as they are; numerals with a ten, whose parts that are no single digit count as 1 before it and 0 behind; digit by digit; else null."""
    text = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    digit = lambda c, other: F.when(c.rlike(r"\A[〇零一二三四五六七八九]\z"), F.translate(c, *_DIGITS)).otherwise(F.lit(other)).cast("long")
    at = F.instr(text, "十")
    ten = digit(F.substring(text, F.lit(1), at - 1), "1") * 10 + digit(F.substring(text, at + 1, F.length(text)), "0")
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long")).when(at > 0, ten).when(text.rlike(r"\A[〇零一二三四五六七八九]+\z"), F.translate(text, *_DIGITS).try_cast("long"))


def iso_date(text: Column) -> Column:
    """The first date in digits (with 年, ``.``, ``-`` or ``/``) as ISO, else the first in ideographs; null for what is no date."""
    plain = r"(\d{4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?"
    written = r"([〇零一二三四五六七八九\d]{4})年([零一二三四五六七八九十\d]{1,3})月([零一二三四五六七八九十\d]{1,3})日"
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    iso = lambda y, m, d: F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")
    digits = iso(*(part(plain, k).cast("int") for k in (1, 2, 3)))
    return F.when(text.rlike(plain), digits).when(text.rlike(written), iso(ideographic_year(part(written, 1)), ideographic_small(part(written, 2)), ideographic_small(part(written, 3))))


# What stands for an amount of money.
MONEY = r"(?:(人民币)\s*)?(?:￥|¥)?\s*([0-9]{1,3}(?:[,，][0-9]{3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*元"


def money(text: Column) -> Column:
    """array<struct<raw,amount>> of the amounts before the unit."""
    raw, figures = (F.regexp_extract_all(text, F.lit(MONEY), F.lit(k)) for k in (0, 2))
    return F.zip_with(raw, figures, lambda r, n: F.struct(r.alias("raw"), F.translate(n, ",，", "").cast("double").alias("amount")))


def amounts(text: Column) -> Column:
    """All money amounts before the unit, as doubles."""
    return F.transform(money(text), lambda m: m["amount"])
