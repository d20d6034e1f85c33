"""Tables with row and column spans: cells to places, places to a full grid, and a grid back to structure tokens, as expressions.

A table is HTML without tables inside its cells.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.forms import key_value
from quire.functions.text import let

_ROWS, _CELLS = r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>", r"(?is)<t[dh](?:\s[^>]*)?>.*?</t[dh]>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def cells(html: Column) -> Column:
    """array<array<struct<text,rowspan,colspan>>>: the rows' cells; a missing span is 1, white space is single."""
    span = lambda c, name: F.coalesce(F.nullif(F.regexp_extract(c, rf"(?i)\A<[^>]*\s{name}\s*=\s*[\"']?(\d{{1,4}})", 1), F.lit("")).cast("int"), F.lit(1))

    def text(c: Column) -> Column:
        out = F.regexp_replace(c, "<[^>]*>", "")
        for name, plain in _ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(plain))
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    of = lambda row: F.transform(F.regexp_extract_all(row, F.lit(_CELLS), F.lit(0)), lambda c: F.struct(text(c).alias("text"), span(c, "rowspan").alias("rowspan"), span(c, "colspan").alias("colspan")))
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(_ROWS), F.lit(1)), of)


_PLACED = "array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>"


def placements(rows: Column) -> Column:
    """array<struct<row,col,rowspan,colspan,text>>: each cell in the first column of its row, from 0, that no span covers; spans of 0 are 1."""
    spans = lambda p: (p["rowspan"] > 1) | (p["colspan"] > 1)

    def place(state: Column, c: Column, row: Column) -> Column:
        held = F.filter(state["placed"], lambda p: spans(p) & (p["row"] <= row) & (row < p["row"] + p["rowspan"]))
        ends = F.concat(F.array(state["col"]), F.transform(held, lambda p: p["col"] + p["colspan"]))
        free = lambda h: F.array_min(F.filter(ends, lambda x: (x >= state["col"]) & ~F.exists(h, lambda p: (p["col"] <= x) & (x < p["col"] + p["colspan"]))))
        high, wide = F.greatest(c["rowspan"], F.lit(1)), F.greatest(c["colspan"], F.lit(1))
        put = lambda col: F.struct((col + wide).alias("col"), F.concat(state["placed"], F.array(F.struct(row.alias("row"), col.alias("col"), high.alias("rowspan"), wide.alias("colspan"), c["text"].alias("text")))).alias("placed"))
        return let(free(held), put)

    def step(placed: Column, r: Column) -> Column:
        start = F.struct(F.lit(0).alias("col"), placed.alias("placed"))
        return F.aggregate(r["cells"], start, lambda s, c: place(s, c, r["row"]), lambda s: s["placed"])

    numbered = F.transform(rows, lambda r, i: F.struct(i.alias("row"), r.alias("cells")))
    return F.aggregate(numbered, F.array().cast(_PLACED), step)


def grid(rows: Column) -> Column:
    """array<array<string>>: every row with a text for each column that a cell spans; rows differ in length where cells are missing.

    What spans down comes as soon as the columns before it are filled; spans that reach below the last row make more
    rows; rows without cells are left out.
    """
    one = "struct<col:int,text:string,left:int>"
    texts = lambda xs: F.transform(xs, lambda x: x["text"])
    less = lambda xs: F.transform(F.filter(xs, lambda x: x["left"] > 1), lambda x: F.struct(x["col"].alias("col"), x["text"].alias("text"), (x["left"] - 1).alias("left")))

    def cell(s: Column, c: Column) -> Column:
        ahead = F.array_min(F.transform(s["rest"], lambda x, k: F.when(x["col"] > s["at"] + k, k)))

        def put(n: Column) -> Column:
            due = F.slice(s["rest"], F.lit(1), n)
            at = s["at"] + n
            own = F.when(c["colspan"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(c["colspan"], F.lit(1)) - 1), lambda j: F.struct((at + j).alias("col"), c["text"].alias("text"), c["rowspan"].alias("left")))).otherwise(F.array().cast(f"array<{one}>"))
            return let(own, lambda o: F.struct(
                (at + F.size(o)).alias("at"), F.slice(s["rest"], n + 1, F.size(s["rest"])).alias("rest"), F.concat(s["texts"], texts(due), texts(o)).alias("texts"), F.concat(s["next"], less(due), less(o)).alias("next")))

        return let(F.coalesce(ahead, F.size(s["rest"])), put)

    def row(state: Column, cs: Column) -> Column:
        none = F.array().cast(f"array<{one}>")
        start = F.struct(F.lit(0).alias("at"), state["rest"].alias("rest"), F.array().cast("array<string>").alias("texts"), none.alias("next"))
        end = lambda s: F.struct(F.concat(state["out"], F.array(F.concat(s["texts"], texts(s["rest"])))).alias("out"), F.concat(s["next"], less(s["rest"])).alias("rest"))
        return F.aggregate(cs, start, cell, end)

    def finish(state: Column) -> Column:
        more = F.coalesce(F.array_max(F.transform(state["rest"], lambda x: x["left"])), F.lit(0))
        below = F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda k: texts(F.filter(state["rest"], lambda x: x["left"] >= k)))).otherwise(F.array().cast("array<array<string>>"))
        return F.filter(F.concat(state["out"], below), lambda r: F.size(r) > 0)

    start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast(f"array<{one}>").alias("rest"))
    return F.aggregate(rows, start, row, finish)


def squared(rows: Column) -> Column:
    """A grid's rows filled with empty texts to the width of the widest."""
    wide = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))))


def structure(placed: Column) -> Column:
    """Structure tokens of placed cells: plain cells in two tokens, spanned ones with their spans; what nothing covers is a plain cell."""
    extent = lambda at, span: F.coalesce(F.array_max(F.transform(placed, lambda p: p[at] + p[span])), F.lit(0))
    words = lambda *tokens: F.array(*map(F.lit, tokens))
    none = F.array().cast("array<string>")
    span = lambda p, name: F.when(p[name] > 1, F.array(F.concat(F.lit(f' {name}="'), p[name].cast("string"), F.lit('"')))).otherwise(none)

    def cell(i: Column, j: Column) -> Column:
        over = F.filter(placed, lambda p: ((p["rowspan"] > 1) | (p["colspan"] > 1)) & (p["row"] <= i) & (i < p["row"] + p["rowspan"]) & (p["col"] <= j) & (j < p["col"] + p["colspan"]))
        of = lambda p: F.when((p["row"] == i) & (p["col"] == j), F.concat(words("<td"), span(p, "colspan"), span(p, "rowspan"), words(">", "</td>"))).otherwise(none)
        return let(F.get(over, F.lit(0)), lambda p: F.when(p.isNull(), words("<td>", "</td>")).otherwise(of(p)))

    upto = lambda n: F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    line = lambda i: F.concat(words("<tr>"), F.flatten(F.transform(upto(extent("col", "colspan")), lambda j: cell(i, j))), words("</tr>"))
    body = F.when(F.size(placed) > 0, F.flatten(F.transform(upto(extent("row", "rowspan")), line))).otherwise(none)
    return F.concat(words("<tbody>"), body, words("</tbody>"))


def pairs(rows: Column) -> Column:
    """array<struct<key,value>> of a squared grid whose columns are keys and values by turns; rows without a key give none."""
    at = lambda r, k: F.coalesce(F.get(r, k), F.lit(""))
    of = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(r) / 2).cast("int"), F.lit(1)) - 1), lambda k: F.when(2 * k + 1 < F.size(r), key_value(at(r, 2 * k), at(r, 2 * k + 1))))
    return F.filter(F.flatten(F.transform(rows, of)), lambda p: p.isNotNull())
