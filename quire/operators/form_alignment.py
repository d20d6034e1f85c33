"""Recognised rows of a form brought back to the form's own keys, and what slipped into keys back into values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.alignment import ALIKE, REST_ALIKE, SPACE, colon_parts, first_best, key_similarities
from quire.functions.phrases import completion, is_fragment
from quire.functions.text import key_name, let

# The keys of the forms that are told apart, in their order, and what speaks for one of them.
FORM_KEYS = ("收件人姓名", "收件人电话", "收件人地址", "收件人电子邮箱", "名称", "纳税人识别号", "地址", "电话", "银行开户行", "银行账号")
NOT_IN_SHORT_FORM = "收件人地址"
SEEN = 0.7
FULL_FORM_BONUS, FULL_FORM_SIGNS = 5.0, ("收件人地址",)
SHORT_FORM_BONUS, SHORT_FORM_SIGNS = 2.0, ("收件人电子邮箱", "收件人电话")
NAME_MARK, PHONE_MARK = "姓名", "电话"
NAME_KEY = "收件人姓名"
PHONE_TAIL = r"[0-9a-zA-Z\-_+()（）*#@,:：，。一]+\z"


@dataclass(frozen=True)
class Form:
    """A form's keys in their order; ``short`` lacks one of them."""

    keys: tuple[str, ...] = FORM_KEYS
    missing: str = NOT_IN_SHORT_FORM

    def short(self) -> tuple[int, ...]:
        return tuple(i for i, k in enumerate(self.keys) if k != self.missing)


def _is_full(rows: Column, form: Form) -> Column:
    """Whether the rows speak for the full form: the sums of each row's best similarity, and a bonus for keys that are clearly there."""
    pick = lambda s, places: F.greatest(*[F.get(s, F.lit(i)) for i in places])
    total = lambda places: F.aggregate(rows, F.lit(0.0), lambda a, r: a + pick(r["scores"], places))
    seen = lambda k: F.exists(rows, lambda r: F.get(r["scores"], F.lit(form.keys.index(k))) >= SEEN)
    all_seen = lambda keys: F.lit(True) if not keys else seen(keys[0]) & all_seen(keys[1:])
    full, short = all_seen([k for k in FULL_FORM_SIGNS if k in form.keys]), all_seen([k for k in SHORT_FORM_SIGNS if k in form.keys])
    return total(range(len(form.keys))) + F.when(full, F.lit(FULL_FORM_BONUS)).otherwise(0.0) >= total(form.short()) + F.when(~full & short, F.lit(SHORT_FORM_BONUS)).otherwise(0.0)


def _best_places(rows: Column) -> Column:
    """The place of each row's key in the form, null for none: the best from the one before on, else the best of all."""

    def step(state: Column, r: Column) -> Column:
        enough = lambda b: F.when(b["score"] >= ALIKE, b["at"])
        found = F.coalesce(enough(first_best(r["own"], state["next"])), enough(first_best(r["own"])))
        return let(found, lambda at: F.struct(F.coalesce(at + 1, state["next"]).alias("next"), F.concat(state["places"], F.array(at)).alias("places")))

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<int>").alias("places"))
    return F.aggregate(rows, start, step, lambda s: s["places"])


def _repaired(rows: Column) -> Column:
    """array<struct<nth,key,value>> of rows that know their key: what slipped into a key goes back into a value.

    A short piece behind a key's colon belongs to the row's own value; one before a space in front of the key below
    to this row's value, if it completes that.
    """

    def of(r: Column, i: Column) -> Column:
        below = F.get(rows, i + 1)
        value = F.concat(r["value"], F.coalesce(r["suffix"], F.lit("")))
        prefix = F.when(below["suffix"].isNull() & (completion(value, below["prefix"]) >= 0.6), below["prefix"])
        return F.struct(r["nth"].alias("nth"), key_name(F.coalesce(r["expected"], r["raw"])).alias("key"), F.concat(value, F.coalesce(prefix, F.lit(""))).alias("value"))

    return F.transform(rows, of)


def aligned(rows: DataFrame, form: str, order: str, key: str, value: str, of: Form | None = None) -> DataFrame:
    """(form, nth, key, value): each form's rows under the form's own keys, one row for each key, by first place.

    ``order`` numbers a form's rows.  Which of two forms it is, with or without one of the keys, is decided by all rows.
    A row's key is the form's most similar one from the key of the row above on, or of all, from a similarity of 0.55;
    a row that is like none keeps its key.  A key's first value counts, or the first that isn't empty.  Null keys and
    values are empty; rows without a key are left out; a form without rows has none.
    """
    of = of or Form()
    raw, text = (F.coalesce(F.col(c), F.lit("")) for c in (key, value))
    keys = list(of.keys)
    cut = colon_parts(F.col("raw"))
    front = lambda k: F.regexp_extract("raw", rf"(?s)\A{SPACE}*([^{SPACE[1:]}{{1,4}}){SPACE}+([^{SPACE[1:]}.*?){SPACE}*\z", k)
    scored = rows.select(form, F.col(order).alias("nth"), raw.alias("raw"), text.alias("value")).select(
        form, "nth", "raw", "value", key_similarities(F.col("raw"), keys).alias("scores"), cut["tail"].alias("tail"), key_similarities(cut["head"], keys).alias("head_scores"),
        F.nullif(front(1), F.lit("")).alias("front"), key_similarities(F.nullif(front(2), F.lit("")), keys).alias("rest_scores"),
    )
    fields = ("nth", "raw", "value", "scores", "tail", "head_scores", "front", "rest_scores")
    gathered = scored.groupBy(form).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows")).withColumn("full", _is_full(F.col("rows"), of))
    # from here on a row's scores are those of its own form's keys
    own = lambda s, short: F.transform(F.array(*map(F.lit, short)), lambda i: F.get(s, i))
    pick = lambda s: F.when(F.col("full"), s).otherwise(own(s, of.short()))
    table = F.when(F.col("full"), F.array(*map(F.lit, keys))).otherwise(F.array(*[F.lit(keys[i]) for i in of.short()]))
    chosen = gathered.select(form, table.alias("table"), F.transform("rows", lambda r: F.struct(*[r[f].alias(f) for f in ("nth", "raw", "value", "tail", "front")], pick(r["scores"]).alias("own"), pick(r["head_scores"]).alias("heads"), pick(r["rest_scores"]).alias("rests"))).alias("rows"))
    placed = chosen.withColumn("places", _best_places(F.col("rows")))

    def known(r: Column, at: Column) -> Column:
        # a suffix moves where what stands before the colon is like any of the form's keys
        suffix = F.when(at.isNotNull() & is_fragment(r["tail"]) & (F.array_max(r["heads"]) >= ALIKE), r["tail"])
        prefix = F.when(at.isNotNull() & (F.get(r["rests"], at) >= REST_ALIKE), r["front"])
        return F.struct(r["nth"].alias("nth"), r["raw"].alias("raw"), r["value"].alias("value"), F.get(F.col("table"), at).alias("expected"), suffix.alias("suffix"), prefix.alias("prefix"))

    known_rows = placed.select(form, F.zip_with("rows", "places", known).alias("rows"))
    one = known_rows.select(form, F.inline(_repaired(F.col("rows"))))
    first = F.min_by("value", F.struct((F.col("value") == "").alias("empty"), F.col("nth")))
    return one.where("key <> ''").groupBy(form, "key").agg(F.min("nth").alias("nth"), first.alias("value")).select(form, "nth", "key", "value")


def kinds(rows: DataFrame, form: str, order: str, key: str, of: Form | None = None) -> DataFrame:
    """(form, is_full): which of the two forms each one is."""
    of = of or Form()
    scored = rows.select(form, key_similarities(F.coalesce(F.col(key), F.lit("")), list(of.keys)).alias("scores"), F.col(order).alias("nth"))
    gathered = scored.groupBy(form).agg(F.array_sort(F.collect_list(F.struct("nth", "scores"))).alias("rows"))
    return gathered.select(form, _is_full(F.col("rows"), of).alias("is_full"))


def phones_split_off(record: DataFrame, form: str) -> DataFrame:
    """(form, nth, key, value): where a form has no phone, digits at the end of the name's value become one.

    At least seven digits make a phone.  The phone's row, if it is new, comes right behind the name's.
    """
    by = record.groupBy(form).agg(F.max(F.when(F.col("key") == NAME_KEY, F.col("value"))).alias("name"), F.max(F.when(F.col("key") == NAME_KEY, F.col("nth"))).alias("name_nth"), F.max(F.when(F.col("key") == _phone_key(), F.col("value"))).alias("phone"), F.max(F.when(F.col("key") == _phone_key(), F.col("nth"))).alias("phone_nth"))
    tail = F.regexp_extract("name", PHONE_TAIL, 0)
    moved = by.where((F.coalesce("phone", F.lit("")) == "") & (F.regexp_count(tail, F.lit(r"\d")) >= 7)).select(form, F.substring("name", F.lit(1), F.length("name") - F.length(tail)).alias("name"), tail.alias("tail"), "name_nth", "phone_nth")
    kept = record.join(moved.select(form, F.col("name").alias("q_name"), F.col("tail").alias("q_tail")), form, "left")
    changed = kept.select(form, "nth", "key", F.when((F.col("key") == NAME_KEY) & F.col("q_tail").isNotNull(), F.col("q_name")).when((F.col("key") == _phone_key()) & F.col("q_tail").isNotNull(), F.col("q_tail")).otherwise(F.col("value")).alias("value"))
    new = moved.where("phone_nth IS NULL").select(form, F.col("name_nth").alias("nth"), F.lit(_phone_key()).alias("key"), F.col("tail").alias("value"))
    return changed.unionByName(new)


def _phone_key() -> str:
    return NAME_KEY.replace(NAME_MARK, PHONE_MARK)
