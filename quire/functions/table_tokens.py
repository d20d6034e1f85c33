"""Repairs of recognised tables as text: cells filled by number, spans that stand alone, bold heads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.structures import empty_cells
from quire.functions.text import let

# What a span looks like, in the order in which it is tried.
SPANS = (r' rowspan="\d+" colspan="\d+"', r' colspan="\d+" rowspan="\d+"', r' rowspan="\d+"', r' colspan="\d+"')
END = "</tbody>"

_SPAN = "|".join(SPANS)
#: Any character but a line feed: Java's dot stops at more of them.
_ANY = r"[^\n]"
_CELLS = "|".join([*[f"<td{s}>{_ANY}+?</td>" for s in SPANS], f"<td>{_ANY}*?</td>"])
_HEAD = f"<thead>{_ANY}*?</thead>"


def closed(tokens: Column) -> Column:
    """Tokens up to the first end of the body, with that end."""
    at = F.array_position(tokens, END).cast("int")
    return F.concat(F.when(at > 0, F.slice(tokens, F.lit(1), at - 1)).otherwise(tokens), F.array(F.lit(END)))


def with_new_rows(tokens: Column, rows: Column) -> Column:
    """Tokens with a row of empty cells for each number in ``rows``, where the table was cut off; a table with its end stays."""
    one = lambda n: F.concat(F.array(F.lit("<tr>")), F.array_repeat(F.lit("<td></td>"), n), F.array(F.lit("</tr>")))
    new, last = F.flatten(F.transform(rows, one)), F.element_at(tokens, -1)
    open_row = F.when(last == "<td></td>", F.array(F.lit("</tr>"))).otherwise(F.array().cast("array<string>"))
    return F.when(last == END, tokens).otherwise(F.concat(tokens, open_row, new, F.array(F.lit(END))))


def filled(tokens: Column, texts: Column) -> Column:
    """Tokens as one text, the n-th cell (from 0) with ``texts[n]``; cells without a text are left out.

    So are cells whose number isn't below how many texts there are.  Tokens of empty cells are written out.
    """
    numbered = F.aggregate(
        tokens, F.struct(F.lit(0).alias("n"), F.array().cast("array<struct<t:string,n:int>>").alias("out")),
        lambda s, t: F.struct((s["n"] + t.startswith("<td").cast("int")).alias("n"), F.concat(s["out"], F.array(F.struct(t.alias("t"), F.when(t.startswith("<td"), s["n"]).alias("n")))).alias("out")),
        lambda s: s["out"],
    )
    text = lambda x: F.when(x["n"] < F.size(texts), F.try_element_at(texts, x["n"]))
    kept = F.filter(numbered, lambda x: x["n"].isNull() | text(x).isNotNull())
    put = F.transform(kept, lambda x: F.when(x["n"].isNull(), x["t"]).otherwise(F.replace(x["t"], F.lit("><"), F.concat(F.lit(">"), text(x), F.lit("<")))))
    return F.array_join(F.transform(put, empty_cells), "")


def spans_joined(html: Column) -> Column:
    """A cell and the span that stands alone behind it, with a closing that belongs to neither, as one spanned cell."""
    return F.regexp_replace(html, f"<td></td>({_SPAN})></b></td>", "<td$1></td>")


def one_bold(html: Column) -> Column:
    """Cells with several bold marks get one pair of them; a cell with spans gets its closing only."""
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    bare = lambda c: F.replace(F.replace(c, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit(""))
    new = lambda c: F.when((count(c, "<b>") > 3) | (count(c, "</b>") > 4), F.replace(F.replace(bare(c), F.lit("<td>"), F.lit("<td><b>")), F.lit("</td>"), F.lit("</b></td>"))).otherwise(c)
    return F.aggregate(F.regexp_extract_all(html, F.lit(_CELLS), F.lit(0)), html, lambda out, c: F.replace(out, c, new(c)))


def bold_heads(html: Column) -> Column:
    """The first table head's cells in bold, but for empty ones; what is bold already is so once; see ``one_bold`` and ``spans_joined``."""
    put = lambda c, *pairs: c if not pairs else put(F.replace(c, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:])
    spanned = f"(<td(?:{_SPAN})>)"

    def of(head: Column) -> Column:
        plain = put(head, ("<td>", "<td><b>"), ("</td>", "</b></td>"), ("<b><b>", "<b>"), ("</b></b>", "</b>"))
        opened = put(F.regexp_replace(head, spanned, "$1<b>"), ("</td>", "</b></td>"))
        with_spans = put(F.regexp_replace(F.regexp_replace(opened, "(?:<b>)+", "<b>"), "(?:</b>)+", "</b>"), ("<td>", "<td><b>"), ("<b><b>", "<b>"))
        bold = put(F.when(head.rlike(spanned), with_spans).otherwise(plain), ("<td><b></b></td>", "<td></td>"))
        return F.when(head == "", html).otherwise(F.replace(html, head, spans_joined(one_bold(bold))))

    return let(F.regexp_extract(html, _HEAD, 0), of)
