"""Documents as token sequences with entities and their relations, cut into chunks of a fixed length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.structures import NO_LABEL
from quire.functions.text import let

# The ends of a relation.
HEAD, TAIL = "QUESTION", "ANSWER"
ENTITY_IDS = {"HEADER": 0, "QUESTION": 1, "ANSWER": 2}

_ENTITY, _RELATION = "array<struct<id:bigint,start:int,end:int,label:string>>", "array<struct<head:int,tail:int,start_index:int,end_index:int>>"


def sequences(segments: DataFrame, doc: str, order: str, key: str, label: str, ids: str) -> DataFrame:
    """(doc, ids, entities): the tokens of a document's segments one after another, and where labelled segments lie.

    An entity is (id, start, end, label), its end behind its last token.  Segments without tokens are left out; those
    whose label stands for none have tokens but no entity.  Null labels stand for none.
    """
    rows = segments.select(doc, F.struct(F.col(order).alias("nth"), F.col(key).cast("long").alias("id"), F.upper(F.coalesce(F.col(label), F.lit(NO_LABEL[0]))).alias("label"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids")).alias("s"))
    gathered = rows.groupBy(doc).agg(F.filter(F.array_sort(F.collect_list("s")), lambda s: F.size(s["ids"]) > 0).alias("s"))

    def step(state: Column, s: Column) -> Column:
        entity = F.struct(s["id"].alias("id"), state["n"].alias("start"), (state["n"] + F.size(s["ids"])).alias("end"), s["label"].alias("label"))
        return F.struct((state["n"] + F.size(s["ids"])).alias("n"), F.when(s["label"].isin(*NO_LABEL), state["e"]).otherwise(F.concat(state["e"], F.array(entity))).alias("e"))

    entities = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.array().cast(_ENTITY).alias("e")), step, lambda x: x["e"])
    return gathered.select(doc, F.flatten(F.transform("s", lambda s: s["ids"])).alias("ids"), entities.alias("entities"))


def with_relations(docs: DataFrame, links: DataFrame, doc: str, a: str, b: str) -> DataFrame:
    """``docs`` with ``relations``: (head, tail, start_index, end_index) of each link between a question and an answer.

    Heads are questions, whichever end of the link they are; head and tail are places among the entities, from 0, and
    the indexes what both together span.  Links count once in either direction; those with an end that is no entity
    don't count.  Relations stand in the order of head and tail.
    """
    ends = F.array_sort(F.array(F.col(a).cast("long"), F.col(b).cast("long")))
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(doc, ends.alias("ends")).distinct().groupBy(doc).agg(F.collect_list("ends").alias("links"))
    met = docs.join(pairs, doc, "left")
    place = F.map_from_entries(F.transform("entities", lambda e, i: F.struct(e["id"], F.struct(i.alias("at"), e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))))

    def relation(one: Column, two: Column) -> Column:
        turned = (one["label"] == TAIL) & (two["label"] == HEAD)
        fits = turned | ((one["label"] == HEAD) & (two["label"] == TAIL))
        head, tail = F.when(turned, two["at"]).otherwise(one["at"]), F.when(turned, one["at"]).otherwise(two["at"])
        return F.when(fits, F.struct(head.alias("head"), tail.alias("tail"), F.least(one["start"], two["start"]).alias("start_index"), F.greatest(one["end"], two["end"]).alias("end_index")))

    found = F.filter(F.transform(F.coalesce("links", F.array().cast("array<array<bigint>>")), lambda x: relation(F.try_element_at("place", x[0]), F.try_element_at("place", x[1]))), lambda r: r.isNotNull())
    return met.withColumn("place", place).select(*docs.columns, F.array_sort(found).alias("relations"))


def chunks(docs: DataFrame, most: int, doc: str, empty: bool = False) -> DataFrame:
    """(doc, chunk, ids, entities, relations): every chunk of at most ``most`` tokens, numbered from 0.

    Entities that lie in one chunk, their end below the next one's start, are counted from its start; relations
    whose whole span does are between places among these.  Chunks without entities are left out unless ``empty``.
    """
    starts = F.when(F.size("ids") > 0, F.sequence(F.lit(0), F.size("ids") - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
    cut = docs.select(doc, "ids", "entities", "relations", F.posexplode(starts).alias("chunk", "at"))
    within = lambda low, high: (low >= F.col("at")) & (low < F.col("at") + most) & (high >= F.col("at")) & (high < F.col("at") + most)
    kept = F.filter(F.transform("entities", lambda e, i: F.struct(e.alias("e"), i.alias("i"))), lambda x: within(x["e"]["start"], x["e"]["end"]))
    local = lambda k: F.transform(k, lambda x: F.struct(x["e"]["id"].alias("id"), (x["e"]["start"] - F.col("at")).alias("start"), (x["e"]["end"] - F.col("at")).alias("end"), x["e"]["label"].alias("label")))
    where = lambda k, n: (F.array_position(F.transform(k, lambda x: x["i"]), n) - 1).cast("int")
    related = lambda k: F.transform(F.filter("relations", lambda r: within(r["start_index"], r["end_index"])), lambda r: F.struct(where(k, r["head"]).alias("head"), where(k, r["tail"]).alias("tail"), (r["start_index"] - F.col("at")).alias("start_index"), (r["end_index"] - F.col("at")).alias("end_index")))
    found = cut.withColumn("x", let(kept, lambda k: F.struct(local(k).alias("entities"), related(k).alias("relations"))))
    out = found.select(doc, "chunk", F.slice("ids", F.col("at") + 1, F.lit(most)).alias("ids"), "x.entities", "x.relations")
    return out if empty else out.where(F.size("entities") > 0)
