"""Registered queries of texts as ids and back, over part names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import alphabets
from quire.functions.alphabets import PLAIN, READINGS, SCHEMES
from quire.plans.registry import registered, spread

QUERIES, SQL, query = registered()

LIMIT = 14
#: Names of every length around the limit, some empty, with characters that no alphabet has.
_NAMES = "CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN upper(p_name) WHEN 2 THEN p_brand || '_x' WHEN 3 THEN '###' ELSE p_name END"
_TABLE = f"names AS (SELECT p_partkey AS id, {_NAMES} AS name FROM part)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), F.expr(_NAMES).alias("name"))


def _encode_sql(name: str) -> str:
    s, size = SCHEMES[name], len(PLAIN)
    unknown = s.place(s.unknown, size)
    other = "NULL" if unknown is None else str(unknown)
    ids = f"list_filter(list_transform(list_filter(string_split(lower(name), ''), lambda c: c <> ''), lambda c: CASE WHEN strpos('{PLAIN}', c) > 0 THEN strpos('{PLAIN}', c) - 1 + {len(s.front)} ELSE {other} END), lambda i: i IS NOT NULL)"
    mark = lambda m: "[]" if m is None else f"[{s.place(m, size)}]"
    width = LIMIT + s.longer
    fits = ["len(ids) > 0"]
    if not s.any_length:
        fits.append(f"length(name) {'<' if s.strict_input else '<='} {LIMIT}")
    if not s.cut:
        fits.append(f"len(ids) <= {LIMIT - s.room}")
    whole = f"list_resize(({mark(s.begin)} || ids || {mark(s.end)})[1:{width}], {width}, {s.fill(size)})"
    return f"WITH {_TABLE}, x AS (SELECT id, name, CAST({ids} AS BIGINT[]) AS ids FROM names) SELECT id, array_to_string({whole}, ',') AS ids, CAST(len(ids) + {int(s.counts_end)} AS BIGINT) AS length FROM x WHERE {' AND '.join(fits)}"


def _put_encoder(name: str) -> None:
    @query(f"encoded_{name}", _encode_sql(name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = names(spark, sf_dir).select("id", alphabets.encode(F.col("name"), SCHEMES[name], LIMIT).alias("e")).where("e is not null")
        return made.select("id", F.array_join(F.col("e.ids").cast("array<string>"), ",").alias("ids"), F.col("e.length").cast("long").alias("length"))


#: Rows of ids and scores as a head might give them: repeats, marks anywhere, ids beyond the alphabet.
_ROWS = "rows AS (SELECT p_partkey AS id, list_transform(range(0, 12), lambda k: CAST((p_partkey * 7 + (k // 2) * (p_partkey % 5 + 1) * 11) % 43 AS BIGINT)) AS ids, list_transform(range(0, 12), lambda k: ((p_partkey + k * 3) % 10) / 10.0) AS scores FROM part)"


def id_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.sequence(F.lit(0), F.lit(11))
    ids = F.transform(places, lambda k: ((F.col("p_partkey") * 7 + F.floor(k / 2) * (F.col("p_partkey") % 5 + 1) * 11) % 43).cast("int"))
    return spread(spark.read.parquet(f"{sf_dir}/part.parquet")).select(F.col("p_partkey").alias("id"), ids.alias("ids"), F.transform(places, lambda k: ((F.col("p_partkey") + k * 3) % 10) / 10.0).alias("scores"))


def _decode_sql(name: str) -> str:
    r, s, size = READINGS[name], SCHEMES[READINGS[name].scheme], len(PLAIN)
    marks = [*s.front, *PLAIN, *s.back]
    table = "[" + ", ".join(f"'{m}'" for m in marks) + "]"
    skipped = ", ".join(str(s.place(m, size)) for m in r.skipped) or "-1"
    stop = s.place(r.stop, size)
    first = 2 if r.from_second else 1
    cut = f"ids[{first}:]" if stop is None else f"CASE WHEN list_contains(ids[{first}:], {stop}) THEN ids[{first}:{first - 1} + list_position(ids[{first}:], {stop}) - 1] ELSE ids[{first}:] END"
    again = "AND (k = 1 OR ids[k] <> ids[k - 1])" if r.merge else ""
    places = f"list_filter(range({first}, {first} + len(cut)), lambda k: ids[k] BETWEEN 0 AND {len(marks) - 1} AND ids[k] NOT IN ({skipped}) {again})"
    empty = "NULL" if r.empty_score is None else str(r.empty_score)
    return f"""WITH {_ROWS}, x AS (SELECT *, {cut} AS cut FROM rows), y AS (SELECT id, list_transform({places}, lambda k: {table}[ids[k] + 1]) AS t, list_transform({places}, lambda k: scores[k]) AS s FROM x)
SELECT id, coalesce(array_to_string(t, ''), '') AS text, round(CASE WHEN len(s) > 0 THEN CAST(list_sum(s) AS DOUBLE) / len(s) ELSE {empty} END, 6) AS score FROM y"""


def _put_decoder(name: str) -> None:
    @query(f"decoded_{name}", _decode_sql(name))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = id_rows(spark, sf_dir).select("id", alphabets.decode(F.col("ids"), F.col("scores"), READINGS[name]).alias("d"))
        return found.select("id", F.col("d.text").alias("text"), F.round("d.score", 6).alias("score"))


for _name in SCHEMES:
    _put_encoder(_name)
for _name in READINGS:
    _put_decoder(_name)


@query("encoded_counts", f"""WITH {_TABLE}, x AS (SELECT id, list_transform(string_split(lower(name), ''), lambda c: strpos('{PLAIN}', c)) AS ids FROM names WHERE length(name) BETWEEN 1 AND {LIMIT}),
y AS (SELECT id, list_filter(ids, lambda i: i > 0) AS ids FROM x)
SELECT id, array_to_string(list_transform(range(0, {len(PLAIN) + 1}), lambda k: CASE WHEN k = 0 THEN {LIMIT} - len(ids) ELSE len(list_filter(ids, lambda i: i = k)) END), ',') AS counts FROM y WHERE len(ids) > 0""")
def encoded_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = names(spark, sf_dir).select("id", alphabets.encode(F.col("name"), SCHEMES["ctc"], LIMIT)["ids"].alias("ids")).where("ids is not null")
    return made.select("id", F.array_join(alphabets.id_counts(F.col("ids"), len(PLAIN) + 1).cast("array<string>"), ",").alias("counts"))


def _plain_ids(text: str) -> str:
    return f"list_filter(list_transform(list_filter(string_split(lower({text}), ''), lambda c: c <> ''), lambda c: strpos('{PLAIN}', c)), lambda i: i > 0)"


@query("occluded_labels", f"""WITH {_TABLE}, x AS (SELECT id, name, id % length(name) AS spot FROM names WHERE length(name) BETWEEN 1 AND {LIMIT}), y AS (SELECT *, substr(name, 1, spot) || substr(name, spot + 2) AS rest, substr(name, spot + 1, 1) AS hidden FROM x)
SELECT id, array_to_string(list_resize({_plain_ids('name')}, {LIMIT}, 0), ',') AS label, array_to_string(list_resize({_plain_ids('rest')}, {LIMIT}, 0), ',') AS label_res, array_to_string(list_resize({_plain_ids('hidden')}, {LIMIT}, 0), ',') AS label_sub,
  len({_plain_ids('name')})::BIGINT AS length, len({_plain_ids('rest')})::BIGINT AS length_res, len({_plain_ids('hidden')})::BIGINT AS length_sub FROM y WHERE len({_plain_ids('name')}) > 0""")
def occluded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names(spark, sf_dir).where(f"length(name) between 1 and {LIMIT}").withColumn("at", F.expr("cast(id % length(name) as int)"))
    made = rows.select("id", *[c.alias(n) for n, c in alphabets.occluded(F.col("name"), F.col("at"), LIMIT).items()]).where("label is not null")
    return made.select("id", *[F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in ("label", "label_res", "label_sub")], *[F.col(n).cast("long").alias(n) for n in ("length", "length_res", "length_sub")])


@query("best_classes", f"""WITH {_ROWS} SELECT id, ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h', 'i', 'j', 'k', 'l'][list_position(scores, list_max(scores))] AS label, CAST(list_max(scores) AS DOUBLE) AS score FROM rows""")
def best_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_rows(spark, sf_dir).select("id", alphabets.best_class(F.col("scores"), list("abcdefghijkl")).alias("b")).select("id", F.col("b.label").alias("label"), F.col("b.score").alias("score"))


@query("symbol_rows", f"""WITH {_ROWS} SELECT id, coalesce(array_to_string(list_transform(ids[1:list_position(ids, list_min(ids)) - 1], lambda i: 's' || i), ' '), '') AS symbols FROM rows""")
def symbol_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_rows(spark, sf_dir).select("id", alphabets.symbols(F.col("ids"), [f"s{i}" for i in range(43)]).alias("symbols"))
