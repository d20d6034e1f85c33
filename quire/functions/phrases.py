"""Small rules about words, keys, names and fragments, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import clean_value, let

# What the rules look for.
LATIN_RUN = "[a-zA-Z0-9 :*./%+-]+"
FRAGMENTS = ("号", "室", "楼", "层", "行", "司", "公司", "支行", "分行", "省", "市", "区", "县", "镇")
ENDINGS = ("支行", "分行", "银行", "公司", "有限公司", "号", "室", "楼", "层", "省", "市", "区", "县", "镇")
BEGINNINGS = ("行", "司", "号", "室", "楼", "层", "省", "市", "区")
ACTIONS = ("判令", "请求", "责令", "支付", "偿还", "返还", "退还", "赔偿", "承担", "清偿", "解除", "确认", "撤销", "停止", "腾退", "交付", "办理", "查封", "冻结", "扣押", "保全")
YES = ("1", "true", "yes", "y", "on")
HANDLER = (r"经办人(?:姓名)?[：:\s]*([\u4e00-\u9fa5A-Za-z·]{2,30})", (r"经办人(?:证件号码|身份证号码|证件号)?[：:\s]*([0-9Xx*]{6,25})", r"(?:证件号码|身份证号码|证件号)[：:\s]*([0-9Xx*]{6,25})"))


def mirrored(text: Column) -> Column:
    """Text read from the right: runs of Latin letters, digits and their marks keep their order."""
    return F.array_join(F.reverse(F.regexp_extract_all(text, F.lit(f"(?s){LATIN_RUN}|."), F.lit(0))), "")


def bare_text(text: Column) -> Column:
    """Lower case without white space and the marks that recognition adds or loses: for comparing."""
    return F.translate(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[\s\x{3000}]+", ""), "：:，,。；;（）()[]【】“”\"'-_/", "")


def bare_key(text: Column) -> Column:
    """A form's key for comparing: without white space, trailing colons and marks."""
    out = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""), F.lit(":"), F.lit("："))
    return F.regexp_replace(F.regexp_replace(out, "：+\\z", ""), r"[*\-_．.#@、，,（）()]", "")


def is_fragment(text: Column) -> Column:
    """Whether a short text is likely the rest of a value."""
    known = text.isin(*FRAGMENTS) | text.rlike(r"\A[a-zA-Z0-9]+\z") | text.rlike(r"\A\d+[号室楼层区]\z")
    return F.coalesce((text != "") & (F.length(text) <= 4) & ~text.rlike("[:：]") & known, F.lit(False))


def completion(before: Column, prefix: Column) -> Column:
    """How well a prefix completes the value before it: 1 for a known ending, 0.6 for a likely beginning, else 0.1; 0 for none."""
    whole = F.concat(F.coalesce(before, F.lit("")), prefix)
    return F.when(F.coalesce(prefix, F.lit("")) == "", F.lit(0.0)).when(whole.rlike(f"(?:{'|'.join(ENDINGS)})\\z"), F.lit(1.0)).when(prefix.isin(*BEGINNINGS), F.lit(0.6)).otherwise(F.lit(0.1))


def asks_for_action(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "").rlike("|".join(ACTIONS))


def as_boolean(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*YES), F.lit(False))


def safe_name(text: Column) -> Column:
    """The last part of a path, in letters, digits, dots and dashes."""
    return F.regexp_replace(F.regexp_extract(text, r"([^/\\]*)\z", 1), r"[^\w.\-\x{4e00}-\x{9fff}]+", "_")


def stem(path: Column) -> Column:
    """The last part of a path without its ending, lower-cased."""
    return F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", ""))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def shared_bold(texts: Column, between: str = " ") -> Column:
    """Cell texts joined; where every one is bold, they are one bold text."""
    bare = F.transform(texts, lambda t: F.replace(F.replace(t, F.lit("<b>"), F.lit("")), F.lit("</b>"), F.lit("")))
    return F.when((F.size(texts) > 0) & F.forall(texts, lambda t: t.startswith("<b>")), F.concat(F.lit("<b>"), F.array_join(bare, between), F.lit("</b>"))).otherwise(F.array_join(texts, between))


def handler(text: Column) -> Column:
    """struct<name,number> of the person in charge that a free text names."""
    name, numbers = HANDLER
    found = F.lit(None).cast("string")
    for p in reversed(numbers):
        found = F.when(text.rlike(p), F.regexp_extract(text, p, 1)).otherwise(found)
    return F.struct(clean_value(F.nullif(F.regexp_extract(text, name, 1), F.lit(""))).alias("name"), found.alias("number"))


def confidence_level(value: Column, level: Column, confidence: Column) -> Column:
    """Whether a field may be filled in unseen."""
    return F.when(value.isNull() | (value == ""), "not-extracted").when((level == "direct") & (confidence >= 0.82), "safe_autofill").otherwise("review_required")


def first_numbered(text: Column) -> Column:
    """struct<number,item,rest>: the numbered item that a normalised text starts with, up to the ``;`` or ``。`` that ends a line, else up to the next number; null for none."""
    number = r"(?m)^\s*(\d{1,2})\s*[.．、)]\s*"

    def cut(whole: Column) -> Column:
        begins = F.regexp_extract(whole, r"\A\s*(\d{1,2})\s*[.．、)]\s*", 0)
        body = F.substring(whole, F.length(begins) + 1, F.length(whole))
        stop = F.nullif(F.regexp_instr(body, F.lit(r"[;。](?=\s*(?:\n|\z))")), F.lit(0))
        following = F.nullif(F.regexp_instr(F.concat(F.lit("x"), body), F.lit(number)), F.lit(0)) - 1
        end = F.length(begins) + F.coalesce(stop, following - 1)
        return F.when((begins != "") & end.isNotNull(), F.struct(F.regexp_extract(whole, number, 1).cast("int").alias("number"), F.regexp_replace(F.substring(whole, F.lit(1), end), r"\A\s+|\s+\z", "").alias("item"), F.regexp_replace(F.substring(whole, end + 1, F.length(whole)), r"\A[ \n]+", "").alias("rest")))

    return let(text, cut)


def bold_free(tokens: list[str]) -> str:
    """A pattern of the tokens that a comparison of table structures passes over."""
    return "|".join(map(re.escape, tokens))


def softmax(values: Column) -> Column:
    """Shares of exponentials, by the largest value for safety."""
    return let(F.transform(values, lambda v: F.exp(v.cast("double") - F.array_max(values).cast("double"))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def norm2(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
