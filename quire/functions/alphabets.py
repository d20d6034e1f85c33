"""Texts as rows of ids and back, by the rules of the usual recognition heads.

A scheme says which marks its alphabet has, where they stand, what texts are refused and how rows are filled up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

#: The alphabet where none is given; texts are lower-cased for it.
PLAIN = "0123456789abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Scheme:
    """``front`` and ``back`` are the marks before and behind the characters; places count over all of them.

    ``begin``, ``end``, ``pad`` and ``unknown`` name marks; a character that the alphabet lacks is dropped where there
    is no ``unknown``.  ``room``: how much shorter than the limit a text's ids must be; ``longer``: how much longer
    than the limit the filled row is; ``cut``: too long rows are cut instead of refused; ``pad_id``: a filling that is
    no mark.  ``counts_end``: the stated length counts the end.
    """

    front: tuple[str, ...] = ()
    back: tuple[str, ...] = ()
    begin: str | None = None
    end: str | None = None
    pad: str | None = None
    unknown: str | None = None
    room: int = 0
    longer: int = 0
    cut: bool = False
    any_length: bool = False
    pad_id: int | None = None
    counts_end: bool = False
    strict_input: bool = False

    def place(self, mark: str | None, size: int) -> int | None:
        if mark is None:
            return None
        return self.front.index(mark) if mark in self.front else len(self.front) + size + self.back.index(mark)

    def fill(self, size: int) -> int:
        return self.pad_id if self.pad_id is not None else self.place(self.pad, size) or 0


# The marks of each head and their order.
SCHEMES = {
    "ctc": Scheme(front=("blank",), pad="blank"),
    "attention": Scheme(front=("sos",), back=("eos",), begin="sos", end="eos", pad="sos", room=1),
    "seed": Scheme(back=("eos", "padding", "unknown"), end="eos", pad="padding", room=1, counts_end=True),
    "srn": Scheme(back=("sos", "eos"), pad="eos"),
    "sar": Scheme(back=("<UKN>", "<BOS/EOS>", "<PAD>"), begin="<BOS/EOS>", end="<BOS/EOS>", pad="<PAD>", room=2),
    "satrn": Scheme(back=("<UKN>", "<BOS/EOS>", "<PAD>"), begin="<BOS/EOS>", end="<BOS/EOS>", pad="<PAD>", unknown="<UKN>", cut=True, any_length=True),
    "pren": Scheme(front=("<PAD>", "<EOS>", "<UNK>"), end="<EOS>", pad="<PAD>", unknown="<UNK>", strict_input=True),
    "nrtr": Scheme(front=("blank", "<unk>", "<s>", "</s>"), begin="<s>", end="</s>", pad="blank", room=2),
    "vitstr": Scheme(front=("<s>", "</s>"), begin="<s>", end="</s>", pad="<s>", room=1, longer=2),
    "abinet": Scheme(front=("</s>",), end="</s>", pad_id=100, room=1, longer=1),
    "spin": Scheme(front=("sos", "eos"), begin="sos", end="eos", pad="sos", longer=2),
}


def encode(text: Column, scheme: Scheme, limit: int, alphabet: str = PLAIN, lower: bool = True) -> Column:
    """struct<ids,length> of a text; null for one that is empty, too long, or without a known character."""
    size, first = len(alphabet), len(scheme.front)
    known = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i + first)])
    unknown = F.lit(scheme.place(scheme.unknown, size)).cast("int")
    letters = F.filter(F.split(F.lower(text) if lower else text, ""), lambda c: c != "")
    ids = F.filter(F.transform(letters, lambda c: F.coalesce(F.try_element_at(known, c), unknown)), lambda i: i.isNotNull())
    mark = lambda m: F.array().cast("array<int>") if m is None else F.array(F.lit(scheme.place(m, size)))
    width = limit + scheme.longer

    def row(found: Column) -> Column:
        whole = F.concat(mark(scheme.begin), found, mark(scheme.end))
        filled = F.slice(F.concat(whole, F.array_repeat(F.lit(scheme.fill(size)), width)), 1, width)
        fits = F.size(found) > 0
        if not scheme.any_length:
            fits &= F.length(text) < limit if scheme.strict_input else F.length(text) <= limit
        if not scheme.cut:
            fits &= F.size(found) <= limit - scheme.room
        return F.when(fits, F.struct(filled.alias("ids"), (F.size(found) + int(scheme.counts_end)).alias("length")))

    return let(ids, row)


@dataclass(frozen=True)
class Reading:
    """How ids become text: which marks are passed over, which end it, whether repeats merge, and an empty row's score."""

    scheme: str
    skipped: tuple[str, ...] = ()
    stop: str | None = None
    merge: bool = False
    from_second: bool = False
    empty_score: float | None = None
    shows_marks: bool = False


# What each head passes over and where it stops.
READINGS = {
    "ctc": Reading("ctc", skipped=("blank",), merge=True, empty_score=0.0),
    "attention": Reading("attention", skipped=("sos", "eos")),
    "seed": Reading("seed", stop="eos", shows_marks=True),
    "srn": Reading("srn", skipped=("sos", "eos")),
    "sar": Reading("sar", skipped=("<PAD>",), stop="<BOS/EOS>", shows_marks=True),
    "satrn": Reading("satrn", skipped=("<PAD>",), stop="<BOS/EOS>", shows_marks=True),
    "pren": Reading("pren", skipped=("<PAD>", "<UNK>"), stop="<EOS>", empty_score=1.0),
    "nrtr": Reading("nrtr", stop="</s>", shows_marks=True),
    "vitstr": Reading("vitstr", stop="</s>", from_second=True, shows_marks=True),
    "abinet": Reading("abinet", stop="</s>"),
    "spin": Reading("spin", skipped=("sos", "eos")),
}


def decode(ids: Column, scores: Column, reading: Reading, alphabet: str = PLAIN) -> Column:
    """struct<text,score> of a row of ids and their scores; the score is the mean over what is read, null (or a set value) for nothing.

    Ids outside the alphabet are passed over.
    """
    scheme, size = SCHEMES[reading.scheme], len(alphabet)
    names = F.array(*map(F.lit, [*scheme.front, *alphabet, *scheme.back]))
    skipped = [scheme.place(m, size) for m in reading.skipped]
    stop = scheme.place(reading.stop, size)
    first = 2 if reading.from_second else 1
    pairs = F.transform(F.arrays_zip(ids.alias("i"), scores.alias("s")), lambda p, k: F.struct(p["i"].alias("i"), p["s"].alias("s"), (F.get(ids, k - 1) == p["i"]).alias("again")))
    row = F.slice(pairs, first, 1 << 20)

    def read(all_: Column) -> Column:
        kept = all_
        if stop is not None:
            ends = F.array_position(F.transform(all_, lambda p: p["i"]), F.lit(stop))
            kept = F.when(ends > 0, F.slice(all_, F.lit(1), (ends - 1).cast("int"))).otherwise(all_)
        kept = F.filter(kept, lambda p: p["i"].between(0, size + len(scheme.front) + len(scheme.back) - 1) & ~p["i"].isin(*skipped, -1))
        if reading.merge:
            kept = F.filter(kept, lambda p: ~F.coalesce(p["again"], F.lit(False)))
        return let(kept, lambda k: F.struct(F.array_join(F.transform(k, lambda p: F.get(names, p["i"])), "").alias("text"), F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, p: a + p["s"]) / F.size(k)).otherwise(F.lit(reading.empty_score).cast("double")).alias("score")))

    return let(row, read)


def symbols(ids: Column, names: list[str]) -> Column:
    """Symbols up to the row's first smallest id, joined by spaces: how rows that end in zeros are read."""
    table = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.slice(ids, F.lit(1), (F.array_position(ids, F.array_min(ids)) - 1).cast("int")), lambda i: F.get(table, i)), " ")


def occluded(text: Column, place: Column, limit: int, alphabet: str = PLAIN) -> dict[str, Column]:
    """A text without its character at ``place`` (from 0), that character, and the ids (from 1) of all three, filled with 0."""
    rest, hidden = F.concat(F.substring(text, F.lit(1), place), F.substring(text, place + 2, F.length(text))), F.substring(text, place + 1, F.lit(1))
    scheme = Scheme(front=("none",), pad="none")
    filled = lambda t: F.coalesce(encode(t, scheme, limit, alphabet)["ids"], F.array_repeat(F.lit(0), limit))
    length = lambda t: F.coalesce(encode(t, scheme, limit, alphabet)["length"], F.lit(0))
    return {"label": encode(text, scheme, limit, alphabet)["ids"], "label_res": filled(rest), "label_sub": filled(hidden), "length": encode(text, scheme, limit, alphabet)["length"], "length_res": length(rest), "length_sub": length(hidden)}


def best_class(scores: Column, names: list[str] | None = None) -> Column:
    """struct<label,score> of the largest score, the first of equals; labels are places where no names are given."""
    at = F.array_position(scores, F.array_max(scores)).cast("int") - 1
    return F.struct((F.get(F.array(*map(F.lit, names)), at) if names else at).alias("label"), F.array_max(scores).alias("score"))


def id_counts(ids: Column, classes: int) -> Column:
    """How often each id stands in a row."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.size(F.filter(ids, lambda i: i == k)))
