"""Tokens of table structures, token labels and point lists, as expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import let

# What the tokens of empty cells stand for, in the order in which they are put in; style tokens; section tags; labels that are none.
EMPTY_CELLS = (
    ("<eb></eb>", "<td></td>"), ("<eb1></eb1>", "<td> </td>"), ("<eb2></eb2>", "<td><b> </b></td>"), ("<eb3></eb3>", "<td>\u2028\u2028</td>"), ("<eb4></eb4>", "<td><sup> </sup></td>"), ("<eb5></eb5>", "<td><b></b></td>"),
    ("<eb6></eb6>", "<td><i> </i></td>"), ("<eb7></eb7>", "<td><b><i></i></b></td>"), ("<eb8></eb8>", "<td><b><i> </i></b></td>"), ("<eb9></eb9>", "<td><i></i></td>"), ("<eb10></eb10>", "<td><b> \u2028 \u2028 </b></td>"),
)
STYLES = ("<b>", "</b>", "\u2028", " ", "<i>", "</i>")
SECTIONS = ("<thead>", "</thead>", "<tbody>", "</tbody>")
NO_LABEL = ("OTHER", "OTHERS", "IGNORE")

_MARK = "\x01"


def _rewritten(tokens: Column, *rules: tuple[str, str]) -> Column:
    """Tokens after rules over them joined by a mark that no token holds."""
    out = F.array_join(tokens, _MARK)
    for pattern, put in rules:
        out = F.regexp_replace(out, pattern, put)
    return F.split(out, _MARK)


def spans_merged(tokens: Column) -> Column:
    """A cell's opening, its one or two spans and its closing as one token."""
    span = ' (?:col|row)span="?[0-9]+"?'
    return _rewritten(tokens, (f"<td{_MARK}({span})(?:{_MARK}({span}))?{_MARK}>{_MARK}</td>", "<td$1$2></td>"))


def cells_merged(tokens: Column) -> Column:
    """Each ``<td>`` with the token behind it as ``<td></td>``."""
    return _rewritten(tokens, (f"(\\A|{_MARK})<td>(?={_MARK}|\\z)(?:{_MARK}[^{_MARK}]*)?", "$1<td></td>"))


def empty_cells(token: Column) -> Column:
    for name, put in EMPTY_CELLS:
        token = F.replace(token, F.lit(name), F.lit(put))
    return token


def unstyled(text: Column, styles: tuple[str, ...] = STYLES) -> Column:
    for s in styles:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def table_html(tokens: Column, texts: Column) -> Column:
    """A table of structure tokens, the n-th cell's text behind its opening unless it is style alone."""
    opening = lambda t: t.isin("<td>", ">")
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), opening)).alias("n")))
    put = lambda x: F.when(opening(x["t"]), let(F.coalesce(F.get(texts, x["n"] - 1), F.lit("")), lambda c: F.when(unstyled(c) != "", c).otherwise(F.lit("")))).otherwise(F.lit(""))
    return F.concat(F.lit("<html><body><table>"), F.array_join(F.transform(numbered, lambda x: F.concat(x["t"], put(x))), ""), F.lit("</table></body></html>"))


def same_structure(a: Column, b: Column, sections: bool = True) -> Column:
    """Whether two token lists write the same structure, on request without the section tags."""
    one, two = F.array_join(a, ""), F.array_join(b, "")
    return one == two if sections else unstyled(one, SECTIONS) == unstyled(two, SECTIONS)


def label_map(labels: list[str]) -> dict[str, int]:
    """Ids of the begin and inside marks of labels; what is no label has none, 0 is outside."""
    names = ["O"]
    for label in labels:
        if label.upper() not in NO_LABEL:
            names += [f"B-{label}", f"I-{label}"]
    return {n.upper(): i for i, n in enumerate(names)}


def token_labels(label: Column, tokens: Column, labels: list[str]) -> Column:
    """An id for each of ``tokens`` of one segment: begin, then inside; 0 for what is no label, null for an unknown one."""
    known = F.create_map(*[F.lit(x) for name, i in label_map(labels).items() for x in (name, i)])
    first, rest = (F.try_element_at(known, F.concat(F.lit(p), F.upper(label))) for p in ("B-", "I-"))
    n = F.size(tokens)
    return F.when(F.upper(label).isin(*NO_LABEL), F.array_repeat(F.lit(0), n)).when(first.isNotNull() & (n > 0), F.concat(F.array(first), F.array_repeat(rest, n - 1)))


def first_chunk(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def padded(ids: Column, width: int, fill: int = 0) -> Column:
    """struct<ids,mask> of a row filled up to ``width``; longer rows are cut."""
    n = F.least(F.size(ids), F.lit(width))
    return F.struct(F.concat(F.slice(ids, 1, width), F.array_repeat(F.lit(fill), F.lit(width) - n)).alias("ids"), F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n)).alias("mask"))


def clockwise(points: Column) -> Column:
    """Four points from the top left on: least and largest sum of coordinates, between them the rest by difference."""

    def first(ranked: Column, by: Callable[[Column], Column]) -> Column:
        return F.array_min(F.transform(ranked, lambda p: F.struct(by(p).alias("by"), p["i"].alias("i"), p["x"].alias("x"), p["y"].alias("y"))))

    def of(ranked: Column) -> Column:
        ends = F.struct(first(ranked, lambda p: p["x"] + p["y"]).alias("near"), first(ranked, lambda p: -p["x"] - p["y"]).alias("far"))
        return let(ends, lambda e: let(F.filter(ranked, lambda p: (p["i"] != e["near"]["i"]) & (p["i"] != e["far"]["i"])), lambda rest: between(e, rest)))

    def between(ends: Column, rest: Column) -> Column:
        chosen = F.array(ends["near"], first(rest, lambda p: p["y"] - p["x"]), ends["far"], first(rest, lambda p: p["x"] - p["y"]))
        return F.transform(chosen, lambda p: F.array(p["x"], p["y"]))

    return F.when(F.size(points) == 4, let(F.transform(points, lambda p, i: F.struct(p[0].alias("x"), p[1].alias("y"), i.alias("i"))), of))


def filled_points(points: Column, many: Column) -> Column:
    """Points up to ``many``, the last one repeated."""
    return F.concat(points, F.array_repeat(F.element_at(points, -1), F.greatest(many - F.size(points), F.lit(0)).cast("int")))


def decoded_structure(ids: Column, scores: Column, names: list[str], end: int, ignored: tuple[int, ...], cells: tuple[str, ...] = ("<td>", "<td", "<td></td>")) -> Column:
    """struct<tokens,score,cells>: tokens up to the first end behind the first place, their mean score, and the places of cells."""
    table = F.array(*map(F.lit, names))
    pairs = F.transform(F.arrays_zip(ids.alias("i"), scores.alias("s")), lambda p, k: F.struct(p["i"].alias("i"), p["s"].alias("s"), k.alias("k")))
    stop = F.array_min(F.transform(F.filter(pairs, lambda p: (p["k"] > 0) & (p["i"] == end)), lambda p: p["k"]))
    kept = F.filter(pairs, lambda p: (F.coalesce(stop, F.size(ids)) > p["k"]) & ~p["i"].isin(*ignored))
    mean = lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0.0), lambda a, p: a + p["s"]) / F.size(k))
    return let(kept, lambda k: F.struct(F.transform(k, lambda p: F.get(table, p["i"])).alias("tokens"), mean(k).alias("score"), F.transform(F.filter(k, lambda p: F.get(table, p["i"]).isin(*cells)), lambda p: p["k"]).alias("cells")))
