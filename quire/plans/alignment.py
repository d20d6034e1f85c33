"""Registered queries of form alignment, over forms written from the customers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import form_alignment
from quire.plans.registry import registered, spread

QUERIES, SQL, query = registered()

_KEY = "CASE i WHEN 0 THEN '收件人姓名' WHEN 1 THEN '收件人电话' WHEN 2 THEN '收件人地址' WHEN 3 THEN '收件人电子邮箱' WHEN 4 THEN '名称' WHEN 5 THEN '纳税人识别号' WHEN 6 THEN '地址' WHEN 7 THEN '电话' WHEN 8 THEN '银行开户行' WHEN 9 THEN '银行账号' ELSE '名称：' END"
#: Keys as a recogniser may give them: marks, wrong letters, pieces of values before and behind, unknown ones, cut and empty ones.
_RAW = "CASE (c * 7 + i * 3) % 13 WHEN 0 THEN k || '：' WHEN 1 THEN k WHEN 2 THEN replace(replace(k, '件', '伴'), '行', '衍') WHEN 3 THEN k || '：号' WHEN 4 THEN '行 ' || k || '：' WHEN 5 THEN ' * ' || k WHEN 6 THEN '备注' WHEN 7 THEN k || ':A1' WHEN 8 THEN k || '：abcde' WHEN 9 THEN substr(k, 1, 3) WHEN 10 THEN '' WHEN 11 THEN '公司 ' || k WHEN 12 THEN '（' || k || '）.' ELSE NULL END"
_VALUE = "CASE (c + i) % 6 WHEN 0 THEN '' WHEN 1 THEN '中国工商银' WHEN 2 THEN '北京市朝阳区' || CAST(c AS STRING) WHEN 3 THEN NULL WHEN 4 THEN '王五1' || CAST(3800000000 + c AS STRING) ELSE name END"
FIXTURE = f"SELECT c AS form, i AS nth, {_RAW} AS raw, {_VALUE} AS value FROM (SELECT c, i, name, {_KEY} AS k FROM (SELECT c_custkey AS c, c_name AS name, {{explode}} AS i FROM customer) WHERE NOT (i = 2 AND c % 3 = 0))"


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form for each customer: (form, nth, raw, value)."""
    spread(spark.read.parquet(f"{sf_dir}/customer.parquet")).createOrReplaceTempView("quire_customers")
    return spark.sql(FIXTURE.format(explode="explode(sequence(0, 10))").replace("FROM customer", "FROM quire_customers"))


_BEST = "list_sort(list_filter(flatten(list_transform(range(1, length(b) + 1), lambda j: list_transform(range(1, length(b) - j + 2), lambda k: {'minus': -k, 'i': strpos(a, substr(b, j, k)), 'j': j}))), lambda x: x.i > 0))[1]"
_BARE = r"regexp_replace(regexp_replace(replace(regexp_replace(t, '\s+', '', 'g'), ':', '：'), '：+$', ''), '[*\-_．.#@、，,（）()]', '', 'g')"
_FIRST = "({0} - 1 + list_position(own[{0}:], list_max(own[{0}:])))"
_ALIGNED = f"""forms AS MATERIALIZED (SELECT form, nth, coalesce(raw, '') AS raw, coalesce(value, '') AS value, row_number() OVER (PARTITION BY form ORDER BY nth) AS n FROM ({FIXTURE.format(explode='unnest(range(0, 11))').replace('AS STRING', 'AS VARCHAR')})),
cut AS MATERIALIZED (
  SELECT *, CASE WHEN length(tail0) BETWEEN 1 AND 4 THEN tail0 END AS tail, CASE WHEN length(tail0) BETWEEN 1 AND 4 THEN trim(regexp_extract(raw, '^([^:：]*)[:：]', 1)) END AS head,
    nullif(regexp_extract(raw, '^\\s*(\\S{{1,4}})\\s+(\\S.*?)\\s*$', 1), '') AS front, nullif(regexp_extract(raw, '^\\s*(\\S{{1,4}})\\s+(\\S.*?)\\s*$', 2), '') AS rest
  FROM (SELECT *, trim(regexp_extract(raw, '^[^:：]*[:：](.*)$', 1)) AS tail0 FROM forms)),
keys AS (SELECT * FROM (VALUES (1, '收件人姓名'), (2, '收件人电话'), (3, '收件人地址'), (4, '收件人电子邮箱'), (5, '名称'), (6, '纳税人识别号'), (7, '地址'), (8, '电话'), (9, '银行开户行'), (10, '银行账号')) AS v(pos, k)),
texts AS (SELECT t, {_BARE} AS a FROM (SELECT raw AS t FROM cut UNION SELECT head FROM cut UNION SELECT rest FROM cut) WHERE t IS NOT NULL),
pairs AS MATERIALIZED (SELECT t, pos, a, k AS b FROM texts, keys),
ranges(t, pos, a, b, n) AS (
  SELECT t, pos, a, b, 0 FROM pairs UNION ALL
  SELECT t, pos, x.a, x.b, x.n FROM (SELECT t, pos, unnest([{{'a': substr(a, 1, m.i - 1), 'b': substr(b, 1, m.j - 1), 'n': -m.minus}}, {{'a': substr(a, m.i - m.minus), 'b': substr(b, m.j - m.minus), 'n': 0}}]) AS x
    FROM (SELECT t, pos, a, b, {_BEST} AS m FROM ranges WHERE a <> '' AND b <> '') WHERE m IS NOT NULL)),
matched AS (SELECT t, pos, sum(n) AS n FROM ranges GROUP BY t, pos),
sims AS MATERIALIZED (
  SELECT t, list(CASE WHEN a = '' THEN 0 ELSE least(1.0, 2.0 * n::DOUBLE / (length(a) + length(b)) + CASE WHEN contains(a, b) THEN 0.25 WHEN contains(b, a) THEN 0.1 ELSE 0 END) END ORDER BY pos) AS s FROM pairs JOIN matched USING (t, pos) GROUP BY t),
scored AS MATERIALIZED (SELECT c.*, r.s AS scores, h.s AS heads, e.s AS rests FROM cut c JOIN sims r ON r.t = c.raw LEFT JOIN sims h ON h.t = c.head LEFT JOIN sims e ON e.t = c.rest),
chosen AS (
  SELECT form, sum(list_max(scores)) + CASE WHEN max(scores[3]) >= 0.7 THEN 5.0 ELSE 0 END >= sum(greatest(list_max(scores[1:2]), list_max(scores[4:]))) + CASE WHEN max(scores[3]) < 0.7 AND max(scores[4]) >= 0.7 AND max(scores[2]) >= 0.7 THEN 2.0 ELSE 0 END AS is_full FROM scored GROUP BY form),
own AS MATERIALIZED (
  SELECT s.form, n, nth, raw, value, tail, front, CASE WHEN is_full THEN scores ELSE scores[1:2] || scores[4:] END AS own, CASE WHEN is_full THEN heads ELSE heads[1:2] || heads[4:] END AS heads, CASE WHEN is_full THEN rests ELSE rests[1:2] || rests[4:] END AS rests,
    CASE WHEN is_full THEN ks ELSE ks[1:2] || ks[4:] END AS ks FROM scored s JOIN chosen USING (form), (SELECT list(k ORDER BY pos) AS ks FROM keys)),
folded(form, n, place, following) AS (
  SELECT DISTINCT form, 0::BIGINT, NULL::BIGINT, 1::BIGINT FROM own UNION ALL
  SELECT form, n, spot, coalesce(spot + 1, following) FROM (
    SELECT o.form, o.n, f.following, CASE WHEN list_max(own[f.following:]) >= 0.55 THEN {_FIRST.format('f.following')} WHEN list_max(own) >= 0.55 THEN list_position(own, list_max(own)) END AS spot FROM folded f JOIN own o ON o.form = f.form AND o.n = f.n + 1)),
known AS (
  SELECT o.form, o.n, nth, raw, value, ks[place] AS expected,
    CASE WHEN place IS NOT NULL AND list_max(heads) >= 0.55 AND (tail IN ('号', '室', '楼', '层', '行', '司', '公司', '支行', '分行', '省', '市', '区', '县', '镇') OR regexp_full_match(tail, '[a-zA-Z0-9]+') OR regexp_full_match(tail, '[0-9]+[号室楼层区]')) AND NOT regexp_matches(tail, '[:：]') THEN tail END AS suffix,
    CASE WHEN place IS NOT NULL AND rests[place] >= 0.65 THEN front END AS prefix
  FROM own o JOIN folded f ON f.form = o.form AND f.n = o.n),
moved AS (SELECT *, value || coalesce(suffix, '') AS v, CASE WHEN lead(suffix) OVER w IS NULL THEN lead(prefix) OVER w END AS below FROM known WINDOW w AS (PARTITION BY form ORDER BY n)),
repaired AS (
  SELECT form, nth, regexp_replace(trim(coalesce(expected, raw)), '[:：;；\\s]+$', '') AS key,
    v || CASE WHEN regexp_matches(v || below, '(支行|分行|银行|公司|有限公司|号|室|楼|层|省|市|区|县|镇)$') OR below IN ('行', '司', '号', '室', '楼', '层', '省', '市', '区') THEN below ELSE '' END AS value FROM moved),
aligned AS MATERIALIZED (SELECT form, min(nth) AS nth, key, coalesce(arg_min(value, nth) FILTER (WHERE value <> ''), '') AS value FROM repaired WHERE key <> '' GROUP BY form, key)"""


def _of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_alignment.aligned(recognised(spark, sf_dir), "form", "nth", "raw", "value")


@query("aligned_forms", f"WITH RECURSIVE {_ALIGNED} SELECT form, nth, key, value FROM aligned")
def aligned_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _of(spark, sf_dir)


@query("form_phones", rf"""WITH RECURSIVE {_ALIGNED}, sides AS (SELECT form, max(value) FILTER (WHERE key = '收件人姓名') AS name, min(nth) FILTER (WHERE key = '收件人姓名') AS spot, max(value) FILTER (WHERE key = '收件人电话') AS phone, bool_or(key = '收件人电话') AS there FROM aligned GROUP BY form),
tails AS (SELECT *, regexp_extract(name, '[0-9a-zA-Z\-_+()（）*#@,:：，。一]+$') AS tail FROM sides),
split AS (SELECT form, spot, there, tail, substr(name, 1, length(name) - length(tail)) AS name FROM tails WHERE coalesce(phone, '') = '' AND length(regexp_replace(tail, '[^0-9]', '', 'g')) >= 7)
SELECT a.form, a.nth, a.key, CASE WHEN m.form IS NULL THEN value WHEN key = '收件人姓名' THEN m.name WHEN key = '收件人电话' THEN m.tail ELSE value END AS value FROM aligned a LEFT JOIN split m USING (form)
UNION ALL SELECT form, spot, '收件人电话', tail FROM split WHERE NOT there""")
def form_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_alignment.phones_split_off(_of(spark, sf_dir), "form")


@query("form_kinds", f"WITH RECURSIVE {_ALIGNED} SELECT is_full, count(*) AS forms FROM chosen GROUP BY is_full")
def form_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form_alignment.kinds(recognised(spark, sf_dir), "form", "nth", "raw").groupBy("is_full").agg(F.count(F.lit(1)).alias("forms"))
