"""Fields of forms and notices as column expressions: keys and values, times, deadlines, numbered items, claimed sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import amounts, ideographic_small, iso_date, key_name, let, squeezed

# What must be recognised, in the order in which it is tried.
DEADLINES = (
    r"(?:收到|签收|送达)(?:本通知书|本通知|文书)?之日起\s*([一二三四五六七八九十百\d]+)\s*日",
    r"(?:收到|签收|送达)(?:本通知书|本通知|文书)?后\s*([一二三四五六七八九十百\d]+)\s*日",
    r"判决生效之日起\s*([一二三四五六七八九十百\d]+)\s*日",
    r"送达之日起\s*([一二三四五六七八九十百\d]+)\s*日",
)
TRIGGERS = (("生效", "judgment_effective_date"), ("送达", "service_date"))
OTHER_TRIGGER = "receipt_date"
CLOCK = r"(?:(上午|下午)\s*)?(\d{1,2})\s*[时点:]\s*(\d{1,2})?\s*分?"
UNSURE = r"至(?:实际)?(?:清偿|付清|履行).*日|或查封|或冻结|同等价值|暂计"
ITEM_LINES = r"(?m)(?=^\s*(?:[一二三四五六七八九十]+[、.]|\(?\d+\)?[、.．]))"
ITEMS = r"(?=\s*(?:\d+[.、]|[一二三四五六七八九十]+、))"


def key_value(left: Column, right: Column) -> Column:
    """struct<key,value> of a two-column row; null without a key.

    Where the right cell is empty, the left one is cut at its first colon or semicolon unless that ends it.
    """
    one, two = F.trim(F.coalesce(left, F.lit(""))), F.trim(F.coalesce(right, F.lit("")))

    def parts(row: Column) -> Column:
        at = row["at"]
        cut = (row["two"] == "") & (at > 0) & (at < F.length(row["one"]))
        key = F.when(cut, F.substring(row["one"], F.lit(1), at - 1)).otherwise(row["one"])
        value = F.when(cut, F.trim(F.substring(row["one"], at + 1, F.length(row["one"])))).otherwise(row["two"])
        return F.struct(_trailing(key).alias("key"), value.alias("value"))

    # the first colon or semicolon is looked up in a copy where all are one character
    at = F.instr(F.translate(one, ":：;；", "::::"), ":")
    made = let(F.struct(one.alias("one"), two.alias("two"), at.alias("at")), parts)
    return let(made, lambda f: F.when(f["key"] != "", f))


def _trailing(text: Column) -> Column:
    """``key_name``; the pattern is tried only where something trails."""
    return let(F.trim(text), lambda t: F.when(F.substring(t, -1, 1).rlike(r"[:：;；\s]"), key_name(t)).otherwise(t))


def iso_datetime(text: Column) -> Column:
    """A date with its time of day if it has one; texts without a date come back trimmed, empty ones as null."""
    date, half = iso_date(text), F.regexp_extract(text, CLOCK, 1)
    hour, minute = F.nullif(F.regexp_extract(text, CLOCK, 2), F.lit("")).cast("int"), F.coalesce(F.nullif(F.regexp_extract(text, CLOCK, 3), F.lit("")).cast("int"), F.lit(0))
    day = F.when((half == "下午") & (hour < 12), hour + 12).when((half == "上午") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(None)).when(date.isNull(), F.trim(text)).when(hour.isNull(), date).otherwise(F.format_string("%sT%02d:%02d:00", date, day, minute))


def relative_deadline(text: Column) -> Column:
    """struct<raw,trigger,days> of the first pattern, in their order, that fits; null for none."""

    def of(pattern: str) -> Column:
        raw, days = F.regexp_extract(text, pattern, 0), F.regexp_extract(text, pattern, 1)
        trigger = F.lit(OTHER_TRIGGER)
        for word, name in reversed(TRIGGERS):
            trigger = F.when(raw.contains(word), F.lit(name)).otherwise(trigger)
        plain = F.when(days.rlike(r"\A\d+\z"), F.when(days.rlike(r"\A\d+\z"), days).try_cast("int")).otherwise(ideographic_small(days))
        return F.when(raw != "", F.struct(raw.alias("raw"), trigger.alias("trigger"), plain.alias("days")))

    return F.coalesce(*[of(p) for p in DEADLINES])


def numbered_items(text: Column) -> Column:
    """The text cut before numbered lines, or else before numbers anywhere; null and blank give an empty array."""
    clean = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    return let(squeezed(text), lambda whole: let(clean(F.split(whole, ITEM_LINES)), lambda by_line: F.when(F.size(by_line) > 1, by_line).otherwise(clean(F.split(whole, ITEMS)))))


def claimed_sum(text: Column) -> Column:
    """struct<total,count,requires_review> of the amounts in a claim; null where there are none.

    Running interest, alternatives and provisional figures make a plain sum unsure.
    """
    total = lambda found: F.aggregate(found, F.lit(0.0), lambda s, x: s + x)
    return let(amounts(text), lambda found: F.when(F.size(found) > 0, F.struct(total(found).alias("total"), F.size(found).alias("count"), text.rlike(UNSURE).alias("requires_review"))))
