"""Records of documents: lines, key-value rows, HTML tokens, weighted rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, line), places from 0."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("nth", "line"))


def without_repeats(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one right before."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("q_before", before).where(F.col("q_before").isNull() | (F.col("q_before") != F.col(value))).drop("q_before")


def last_wins(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by(value, order).alias(value))


def first_wins(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The first value that isn't null or empty."""
    return rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*by).agg(F.min_by(value, order).alias(value))


def suffixed(rows: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """Repeated names get _1, _2 and so on."""
    nth = F.row_number().over(Window.partitionBy(by, name).orderBy(order)) - 1
    return rows.withColumn("unique_name", F.when(nth == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), nth.cast("string"))))


def html_tokens(html: Column, spans: bool = False) -> Column:
    """Tags in order without attributes, or with row and column spans only."""
    tags = F.regexp_extract_all(html, F.lit("</?[a-zA-Z][a-zA-Z0-9]*[^>]*>"), F.lit(0))
    bare = lambda t: F.concat(F.regexp_extract(t, "^</?[a-zA-Z][a-zA-Z0-9]*", 0), F.lit(">"))
    if not spans:
        return F.transform(tags, bare)
    kept = lambda t: F.array_join(F.regexp_extract_all(t, F.lit(r"\s(?:row|col)span=\"[0-9]+\""), F.lit(0)), "")
    return F.transform(tags, lambda t: F.concat(F.regexp_extract(t, "^</?[a-zA-Z][a-zA-Z0-9]*", 0), kept(t), F.lit(">")))


def html_text(html: Column) -> Column:
    """Plain text: scripts and styles go, blocks end lines, cells become tabs, other tags spaces, lines are squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table)\b[^>]*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]>", "\t"), "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    kept = F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")
    return F.array_join(F.filter(kept, lambda x, i: (i == 0) | (F.get(kept, i - 1) != x)), "\n")


def cell_html(tokens: Column, texts: Column) -> Column:
    """Structure tokens with the n-th cell's text put behind its opening."""
    numbered = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda x: x.startswith("<td"))).alias("n")))
    return F.array_join(F.transform(numbered, lambda x: F.when(x["t"] == "<td></td>", F.concat(F.lit("<td>"), F.coalesce(F.get(texts, x["n"] - 1), F.lit("")), F.lit("</td>"))).when((x["t"] == "<td>") | (x["t"] == ">"), F.concat(x["t"], F.coalesce(F.get(texts, x["n"] - 1), F.lit("")))).otherwise(x["t"])), "")


def classified(docs: DataFrame, rules: list[tuple[str, str, float]], key: str, text: str, least: float = 3.0) -> DataFrame:
    """(key, type, score, confidence): weighted keywords; the best type, ties to the first listed, ``unknown`` below ``least``.

    Rules are a few dozen literals, so they are part of the expression and no join is needed.
    """
    types = list(dict.fromkeys(t for t, _, _ in rules))
    score = {t: sum((F.when(F.col(text).contains(w), F.lit(v)).otherwise(F.lit(0.0)) for kind, w, v in rules if kind == t), start=F.lit(0.0)) for t in types}
    ranked = F.array_sort(F.array(*[F.struct((-score[t]).alias("s"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(types)]))
    scored = docs.select(key, ranked.alias("r")).select(key, F.col("r")[0]["t"].alias("t"), (-F.col("r")[0]["s"]).alias("best"), (-F.coalesce(F.get(F.col("r"), F.lit(1))["s"], F.lit(0.0))).alias("next"))
    sure = F.col("best") >= least
    confidence = F.least(F.lit(0.99), 0.55 + F.col("best") / 30 + (F.col("best") - F.col("next")) / 50)
    return scored.select(key, F.when(sure, F.col("t")).otherwise("unknown").alias("type"), F.col("best").alias("score"), F.round(F.when(sure, confidence).otherwise(0.25), 6).alias("confidence"))
