"""How alike two short texts are by their matching blocks, and how a recognised key meets a form's own."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.phrases import bare_key
from quire.functions.text import let

#: A key is a form's own from this similarity on; the rest of a key behind a value's end from that on.
ALIKE, REST_ALIKE = 0.55, 0.65
#: White space of every script.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def matched_letters(a: Column, b: Column) -> Column:
    """How many characters the matching blocks of two texts hold.

    The longest common run is a block, of equals the one that begins first in ``a``, then in ``b``; what lies before
    and behind it on both sides is searched the same way.  ``b`` is short: each step tries all its runs.
    """
    run = lambda al, ah, bl, bh: F.struct(al.alias("al"), ah.alias("ah"), bl.alias("bl"), bh.alias("bh"))
    part = lambda text, low, high: F.substring(text, low + 1, high - low)

    def longest(r: Column) -> Column:
        """struct<minus,i,j> of the longest common run within a pair of ranges, null for none."""
        within = part(a, r["al"], r["ah"])

        def from_(j: Column) -> Column:
            place = lambda k: F.call_function("instr", within, F.substring(b, j + 1, k))
            return F.array_min(F.transform(F.sequence(F.lit(1), r["bh"] - j), lambda k: let(place(k), lambda p: F.when(p > 0, F.struct((-k).alias("minus"), (r["al"] + p - 1).alias("i"), j.alias("j"))))))

        return F.array_min(F.transform(F.sequence(r["bl"], r["bh"] - 1), from_))

    def step(state: Column, _: Column) -> Column:
        todo, rest = state["todo"], F.slice(state["todo"], F.lit(1), F.greatest(F.size(state["todo"]) - 1, F.lit(0)))
        sides = lambda r, m: F.filter(F.array(run(r["al"], m["i"], r["bl"], m["j"]), run(m["i"] - m["minus"], r["ah"], m["j"] - m["minus"], r["bh"])), lambda x: (x["ah"] > x["al"]) & (x["bh"] > x["bl"]))
        of = lambda r: let(longest(r), lambda m: F.when(m.isNull(), F.struct(rest.alias("todo"), state["total"].alias("total"))).otherwise(F.struct(F.concat(rest, sides(r, m)).alias("todo"), (state["total"] - m["minus"]).alias("total"))))
        return F.when(F.size(todo) == 0, state).otherwise(let(F.element_at(todo, -1), of))

    start = F.struct(F.array(run(F.lit(0), F.length(a), F.lit(0), F.length(b))).alias("todo"), F.lit(0).alias("total"))
    steps = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.aggregate(steps, start, step, lambda s: s["total"]))


def block_similarity(a: Column, b: Column) -> Column:
    """Twice the matched letters over all letters; two empty texts are equal."""
    letters = F.length(a) + F.length(b)
    return F.when(letters == 0, F.lit(1.0)).otherwise(2.0 * matched_letters(a, b) / letters)


def key_similarity(raw: Column, key: Column) -> Column:
    """``block_similarity`` of two bare keys, with a quarter more where the first holds the second and a tenth where it is held; at most 1.

    Nothing is like a key without letters.
    """
    one, two = bare_key(F.regexp_replace(raw, SPACE, "")), bare_key(key)
    of = lambda x: F.when((x["a"] == "") | (x["b"] == ""), F.lit(0.0)).when(x["a"] == x["b"], F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), block_similarity(x["a"], x["b"]) + F.when(x["a"].contains(x["b"]), F.lit(0.25)).when(x["b"].contains(x["a"]), F.lit(0.1)).otherwise(F.lit(0.0)))
    )
    return let(F.struct(one.alias("a"), two.alias("b")), of)


@lru_cache(1 << 16)
def _similarity_row(bare: str, keys: tuple[str, ...]) -> list[float]:
    """What ``key_similarity`` says of a bare text and bare keys; a worker works each text out once."""

    def of(key: str) -> float:
        if not bare or not key:
            return 0.0
        return min(1.0, SequenceMatcher(None, bare, key, autojunk=False).ratio() + (0.25 if key in bare else 0.1 if bare in key else 0.0))

    return [of(k) for k in keys]


def key_similarities(raw: Column, keys: list[str]) -> Column:
    """A text's ``key_similarity`` to each of a form's keys; null for null.

    Forms repeat their keys, so texts go in Arrow batches to workers that remember what they have worked out; the
    column expression would search the blocks of every row anew.
    """
    spare = tuple(re.sub(r"[*\-_．.#@、，,（）()]", "", re.sub("：+$", "", re.sub(r"\s+", "", k).replace(":", "："))) for k in keys)

    @F.pandas_udf("array<double>")
    def rows(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _similarity_row(t, spare))

    return rows(F.when(raw.isNotNull(), bare_key(F.regexp_replace(raw, SPACE, ""))))


def first_best(scores: Column, start: Column | None = None) -> Column:
    """struct<at,score> of the first highest score from place ``start`` (from 0) on; null where nothing is left."""
    start = F.lit(0) if start is None else start
    placed = F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.alias("at")))
    best = F.array_min(F.filter(placed, lambda p: p["at"] >= start))
    return F.when(best.isNotNull(), F.struct(best["at"].alias("at"), (-best["minus"]).alias("score")))


def colon_parts(raw: Column) -> Column:
    """struct<head,tail> of a text cut at its first colon, both trimmed; null without a colon, or where the tail isn't one to four characters."""
    trim = lambda c: F.regexp_replace(c, rf"\A{SPACE}+|{SPACE}+\z", "")
    head, tail = (trim(F.regexp_extract(raw, r"(?s)\A([^:：]*)[:：](.*)\z", k)) for k in (1, 2))
    return F.when(raw.rlike("[:：]") & F.length(tail).between(1, 4), F.struct(head.alias("head"), tail.alias("tail")))
