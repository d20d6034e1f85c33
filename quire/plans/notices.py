"""Registered queries of the court documents' fields, over notices written from the orders, each with its SQL.

The notices' text is one expression that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import forms, notices, text
from quire.functions.text import squeezed
from quire.plans.registry import registered, spread

QUERIES, SQL, query = registered()

_PARTS = """
  SELECT o_orderkey AS k, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS p, CAST(year(o_orderdate) AS STRING) AS y, CAST(month(o_orderdate) AS STRING) AS m, CAST(day(o_orderdate) AS STRING) AS d,
    CASE o_orderkey % 3 WHEN 0 THEN '北京市海淀区人民法院' WHEN 1 THEN '上海市第一中级人民法院' ELSE '广东省高级人民法院' END AS court,
    CASE o_orderkey % 7 WHEN 0 THEN '民初' WHEN 1 THEN '民终' WHEN 2 THEN '执' WHEN 3 THEN '民再' WHEN 4 THEN '民 申' WHEN 5 THEN '刑初' ELSE '民辖终' END AS code,
    CASE o_orderkey % 4 WHEN 0 THEN '买卖合同纠纷' WHEN 1 THEN '民间借贷纠纷' WHEN 2 THEN '仓储运输纠纷' ELSE '合同' END AS cause,
    CASE o_custkey % 4 WHEN 0 THEN '收到本通知书之日起 十五 日' WHEN 1 THEN '判决生效之日起10日' WHEN 2 THEN '送达后三十日' ELSE '改日' END AS due,
    CASE o_custkey % 5 WHEN 0 THEN '被告住所地' WHEN 1 THEN '专属管辖' WHEN 2 THEN '诉讼标的额超过规定' WHEN 3 THEN '级别管辖异议' ELSE '其他' END AS ground,
    CASE o_custkey % 5 WHEN 0 THEN '保险公司出具保函' WHEN 1 THEN '现金担保' WHEN 2 THEN '以房产提供担保' WHEN 3 THEN '担保公司' ELSE '无' END AS pledge
  FROM orders"""
#: line end, and dates in four spellings
_N = "chr(10)"
_DAY = "CASE k % 5 WHEN 0 THEN y || '年' || m || '月' || d || '日' WHEN 1 THEN y || '-' || m || '-' || d WHEN 2 THEN y || '.' || m || '.' || d WHEN 3 THEN '二〇二四年十一月二十三日' ELSE y || ' 年 13 月 ' || d || ' 日' END"
_NUMBER = "'（' || y || '）京0' || CAST(c % 900 + 100 AS STRING) || code || CAST(c AS STRING) || ' 号'"
_PEOPLE = f"""'原告（反诉被告）：甲' || CAST(c % 50 AS STRING) || '公司，住所地：北京市朝阳区' || CAST(c % 99 AS STRING) || '号，法定代表人：张三，经理；联系电话：010-' || CAST(c + 1000000 AS STRING) || '。' || {_N} ||
 '被告：李' || CAST(c % 30 AS STRING) || '，女，汉族，1980年1月2日出生，住上海市，公民身份号码：1101011980' || CAST(c + 10000000 AS STRING) || '。' || {_N}"""
_ASKED = f"""'1、判令被告支付货款人民币' || CAST(p AS STRING) || '.50元；' || {_N} || '（2）、解除合同，赔偿 1,200 元' || CASE k % 2 WHEN 0 THEN '，暂计' ELSE '' END || '。' || {_N}"""
_TEXT = f"""CASE k % 6
 WHEN 0 THEN '民事起诉状' || {_N} || {_NUMBER} || {_N} || {_PEOPLE} || '诉讼请求：' || {_N} || {_ASKED} || '事实与理由' || {_N} || '因' || cause || '，合同编号：HT-' || CAST(c AS STRING) || '，依《中华人民共和国民法典》第五百七十七条。' || {_N} || '证据清单' || {_N} || '一、合同' || {_N} || '此致' || {_N} || court || {_N} || {_DAY}
 WHEN 1 THEN '传  票' || {_N} || court || {_N} || '案号 ' || {_NUMBER} || {_N} || '传票' || {_N} || '被传唤人：王 五' || CAST(c % 20 AS STRING) || {_N} || '传唤事由 开庭' || {_N} || '应到时间：' || y || '年' || m || '月' || d || '日下午' || CAST(c % 11 + 1 AS STRING) || '时20分' || {_N} || '应到处所：第三法庭' || {_N} || '注意事项' || {_N} || '1.准时到庭' || {_N} || '2.携带证件' || {_N} || '审判员：赵六' || {_N} || '书记员 钱七' || {_N} || {_DAY}
 WHEN 2 THEN court || {_N} || '民事判决书' || {_N} || {_NUMBER} || {_N} || {_PEOPLE} || '原告诉被告' || cause || '一案，原告向本院提出诉讼请求：' || {_ASKED} || '经审理查明' || {_N} || '事实如此。' || {_N} || '本院认为' || {_N} || '依《合同法》第十条第二款。' || {_N} || '判决如下：' || {_N} || '一、被告于' || due || '内支付货款。' || {_N} || '二、' || CASE c % 2 WHEN 0 THEN '驳回其他诉讼请求。' ELSE '其余不论。' END || {_N} || '案件受理费' || CAST(c AS STRING) || '元，保全费 20 元。如不服本判决，可在送达之日起十五日内上诉。' || {_N} || '审判长 孙八' || {_N} || {_DAY}
 WHEN 3 THEN '财产保全申请书' || {_N} || '【' || cause || '｜法院：' || court || '｜版式】' || {_N} || '申请人：甲公司，统一社会信用代码：91110000MA' || CAST(c AS STRING) || '。' || {_N} || '被申请人：乙' || {_N} || '保全请求' || {_N} || '冻结存款' || CAST(p AS STRING) || '元' || {_N} || '保全事由：' || {_N} || '防止转移。' || {_N} || '保全证据' || {_N} || '1.流水' || {_N} || '2.合同' || {_N} || '担保方式' || {_N} || pledge || {_N} || {_DAY}
 WHEN 4 THEN '管辖权异议申请书' || {_N} || '申请人（一审被告）：乙' || CAST(c AS STRING) || {_N} || '被申请人（一审原告）：甲公司' || {_N} || '申请事项' || {_N} || '请求移送' || court || '审理' || {_N} || '事实与理由' || {_N} || ground || '。' || {_N} || '此致' || {_N} || '北京市西城区人民法院' || {_N} || {_DAY}
 ELSE '强制执行申请书' || {_N} || '申请执行人：甲公司' || {_N} || '被执行人：乙' || {_N} || '申请事项' || {_N} || '1、支付借款本金人民币' || CAST(p AS STRING) || '元及利息按年利率计算；' || {_N} || '2、支付迟延履行期间加倍债务利息。' || {_N} || '事实与理由' || {_N} || '依据' || {_NUMBER} || '判决，' || due || '内未履行。' || {_N} || '申请执行，执行费用由乙承担。' || {_N} || {_DAY} END"""
FIXTURE = f"SELECT k AS doc_id, {_TEXT} AS text, {_DAY} AS day, due, {_ASKED} AS asked, court, k % 6 AS kind, c FROM ({_PARTS})"


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice for each order: (doc_id, text, day, due, asked, court, kind, c)."""
    spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).createOrReplaceTempView("quire_orders")
    return spark.sql(FIXTURE.replace("FROM orders", "FROM quire_orders"))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices with ``text`` normalised.

    The random column is a barrier: without it each use of the text would repeat its normalisation.
    """
    return written(spark, sf_dir).withColumn("text", squeezed(F.col("text"))).withColumn("q_row", F.monotonically_increasing_id()).where("q_row >= 0").drop("q_row")


_SQUEEZE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate({0}, '（）：；', '():;'), '([\x{{4e00}}-\x{{9fff}}])[ \t]+([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'), '([\x{{4e00}}-\x{{9fff}}])[ \t]+([\x{{4e00}}-\x{{9fff}}])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), E' \n\t')"""
_WITH = f"WITH w AS MATERIALIZED ({FIXTURE}), n AS MATERIALIZED (SELECT * REPLACE ({_SQUEEZE.format('text')} AS text) FROM w)"
_CLEAN = r"nullif(trim(regexp_replace(regexp_replace({0}, '^[\s:：,，;；]+|[\s:：,，;；]+$', '', 'g'), '[ \t]+', ' ', 'g')), '')"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_DIGITS = "translate({0}, '〇零一二三四五六七八九', '00123456789')"


def _small(x: str) -> str:
    one = lambda part, other: f"CASE WHEN regexp_full_match({part}, '[〇零一二三四五六七八九]') THEN CAST({_DIGITS.format(part)} AS BIGINT) ELSE {other} END"
    return f"CASE WHEN regexp_full_match({x}, '[0-9]+') THEN CAST({x} AS BIGINT) WHEN contains({x}, '十') THEN ({one(f'string_split({x}, {chr(39)}十{chr(39)})[1]', 1)}) * 10 + ({one(f'substr({x}, position({chr(39)}十{chr(39)} IN {x}) + 1)', 0)}) WHEN regexp_full_match({x}, '[〇零一二三四五六七八九]+') THEN CAST({_DIGITS.format(x)} AS BIGINT) END"


def _date(x: str) -> str:
    plain, ideo = r"(\d{4})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})\s*日?", r"([〇零一二三四五六七八九\d]{4})年([零一二三四五六七八九十\d]{1,3})月([零一二三四五六七八九十\d]{1,3})日"
    iso = lambda a, b, c: f"strftime(TRY_CAST(lpad({a}, 4, '0') || '-' || lpad({b}, 2, '0') || '-' || lpad({c}, 2, '0') AS DATE), '%Y-%m-%d')"
    part = lambda p, k: f"regexp_extract({x}, '{p}', {k})"
    small = lambda k: f"CAST({_small(part(ideo, k))} AS VARCHAR)"
    return f"CASE WHEN regexp_matches({x}, '{plain}') THEN {iso(part(plain, 1), part(plain, 2), part(plain, 3))} WHEN regexp_matches({x}, '{ideo}') THEN {iso(_DIGITS.format(part(ideo, 1)), small(2), small(3))} END"


@query("notice_texts", rf"""{_WITH} SELECT w.doc_id, n.text AS normal, regexp_replace(n.text, '\s+', '', 'g') AS compact,
  translate(regexp_replace(lower(w.text), '\s+', '', 'g'), '：:，,。；;（）()[]〖〗<>《》‘’“”"''-_/|', '') AS match_key, {_CLEAN.format("'：' || w.due || ' ；,'")} AS cleaned FROM w JOIN n USING (doc_id)""")
def notice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.col("text")
    return written(spark, sf_dir).select("doc_id", squeezed(of).alias("normal"), text.compact(of).alias("compact"), text.match_key(of).alias("match_key"), text.clean_value(F.concat(F.lit("："), F.col("due"), F.lit(" ；,"))).alias("cleaned"))


@query("notice_dates", f"""{_WITH}, x AS (SELECT doc_id, day, {_date('day')} AS date, CASE c % 3 WHEN 0 THEN day || '上午12点' WHEN 1 THEN day || ' 下午 3:05' ELSE ' ' || day || ' ' END AS said,
  CASE c % 8 WHEN 0 THEN '二十三' WHEN 1 THEN '十五' WHEN 2 THEN '二三' WHEN 3 THEN '12345' WHEN 4 THEN '百' WHEN 5 THEN '十' WHEN 6 THEN '二三十' ELSE '七' END AS numeral FROM w)
SELECT doc_id, date, CASE WHEN date IS NULL THEN trim(said) WHEN regexp_matches(said, '上午12点') THEN date || 'T00:00:00' WHEN regexp_matches(said, '下午 3:05') THEN date || 'T15:05:00' ELSE date END AS moment,
  {_small('numeral')} AS number, CASE WHEN length(regexp_replace({_DIGITS.format('day')}, '[^0-9]', '', 'g')) = 4 THEN CAST(regexp_replace({_DIGITS.format('day')}, '[^0-9]', '', 'g') AS INT) END AS year FROM x""")
def notice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE c % 3 WHEN 0 THEN day || '上午12点' WHEN 1 THEN day || ' 下午 3:05' ELSE ' ' || day || ' ' END")
    numeral = F.expr("CASE c % 8 WHEN 0 THEN '二十三' WHEN 1 THEN '十五' WHEN 2 THEN '二三' WHEN 3 THEN '12345' WHEN 4 THEN '百' WHEN 5 THEN '十' WHEN 6 THEN '二三十' ELSE '七' END")
    return written(spark, sf_dir).select("doc_id", text.iso_date(F.col("day")).alias("date"), forms.iso_datetime(said).alias("moment"), text.ideographic_small(numeral).alias("number"), text.ideographic_year(F.col("day")).alias("year"))


@query("notice_deadlines", f"""{_WITH}, x AS (SELECT doc_id, regexp_extract(due, '收到本通知书之日起 十五 日|判决生效之日起10日|送达后三十日') AS raw FROM w)
SELECT doc_id, nullif(raw, '') AS raw, CASE WHEN raw = '' THEN NULL WHEN contains(raw, '生效') THEN 'judgment_effective_date' WHEN contains(raw, '送达') THEN 'service_date' ELSE 'receipt_date' END AS trigger,
  CASE WHEN contains(raw, '十五') THEN 15 WHEN contains(raw, '10') THEN 10 WHEN contains(raw, '三十') THEN 30 END::BIGINT AS days FROM x""")
def notice_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.relative_deadline(F.col("due"))
    return written(spark, sf_dir).select("doc_id", found["raw"].alias("raw"), found["trigger"].alias("trigger"), found["days"].cast("long").alias("days"))


_MONEY_SQL = r"(?:(?:人民币)\s*)?(?:￥|¥)?\s*([0-9]{1,3}(?:[,，][0-9]{3})*(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)\s*元"


@query("notice_sums", f"""{_WITH}, x AS (SELECT doc_id, asked, regexp_extract_all(asked, '{_MONEY_SQL}', 0) AS raw, list_transform(regexp_extract_all(asked, '{_MONEY_SQL}', 1), lambda v: CAST(replace(v, ',', '') AS DOUBLE)) AS v FROM w)
SELECT doc_id, array_to_string(raw, '|') AS raw, round(list_sum(v), 2) AS total, len(v)::BIGINT AS n, contains(asked, '暂计') AS requires_review FROM x""")
def notice_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    claim = forms.claimed_sum(F.col("asked"))
    return written(spark, sf_dir).select("doc_id", F.array_join(F.transform(text.money(F.col("asked")), lambda m: m["raw"]), "|").alias("raw"), F.round(claim["total"], 2).alias("total"), claim["count"].cast("long").alias("n"), claim["requires_review"].alias("requires_review"))


@query("notice_items", rf"""{_WITH}, x AS (SELECT doc_id, {_SQUEEZE.format('asked')} AS t FROM w)
SELECT doc_id, len(p)::BIGINT AS n, array_to_string(p, '|') AS items FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '(?m)^\s*([一二三四五六七八九十]+[、.]|\(?\d+\)?[、.．])', E'\x01\\1', 'g'), E'\x01'), lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '') AS p FROM x)""")
def notice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = forms.numbered_items(F.col("asked"))
    return written(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("items"))


_CASES = rf"""regexp_extract_all(text, '[（(]\s*\d{{4}}\s*[）)]\s*[\x{{4e00}}-\x{{9fff}}A-Za-z0-9\s]{{1,28}}?\s*(?:民再初|民再终|民辖终|民初|民终|民再|民申|民监|民抗|执恢|执异|执|刑初|刑终|行初|行终)\s*\d+\s*号') || regexp_extract_all(text, '[（(]\s*\d{{4}}\s*[）)]\s*[\x{{4e00}}-\x{{9fff}}A-Za-z0-9\s]{{1,40}}?\s*\d+\s*号')"""
_NUMBERED = rf"""cases AS (SELECT *, {_ONCE.format("r")} AS numbers FROM (SELECT *, list_transform({_CASES}, lambda v: regexp_replace(regexp_replace(regexp_replace(translate(trim(regexp_replace(v, '\s+', ' ', 'g')), '()', '（）'), '（\s*', '（', 'g'), '\s*）', '）', 'g'), '\s+号', '号', 'g')) AS r FROM n))"""


@query("notice_cases", f"""{_WITH}, {_NUMBERED} SELECT doc_id, array_to_string(numbers, '|') AS numbers, numbers[1] AS first FROM cases""")
def notice_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.case_numbers(F.col("text"))
    return normal(spark, sf_dir).select("doc_id", F.array_join(found, "|").alias("numbers"), F.get(found, F.lit(0)).alias("first"))


_TYPED = """typed AS (SELECT *, CASE kind WHEN 0 THEN 'civil_complaint' WHEN 1 THEN 'summons' WHEN 2 THEN 'judgment' WHEN 3 THEN 'preservation_application' WHEN 4 THEN 'jurisdiction_objection' ELSE 'enforcement_application' END AS type FROM cases)"""


def _kind() -> F.Column:
    return F.expr("CASE kind WHEN 0 THEN 'civil_complaint' WHEN 1 THEN 'summons' WHEN 2 THEN 'judgment' WHEN 3 THEN 'preservation_application' WHEN 4 THEN 'jurisdiction_objection' ELSE 'enforcement_application' END")


@query("notice_stages", f"""{_WITH}, {_NUMBERED}, {_TYPED}, f AS (SELECT *, regexp_replace(numbers[1], '\\s+', '', 'g') AS b, regexp_replace(text, '\\s+', '', 'g') AS t FROM typed)
SELECT doc_id, CASE WHEN regexp_matches(b, '(?:执恢|执异|执)\\d+号') THEN 'unknown' WHEN contains(b, '民初') THEN 'first_instance' WHEN regexp_matches(b, '民终|民辖终') THEN 'second_instance'
  WHEN contains(b, '民再') THEN 'retrial_first_instance' WHEN regexp_matches(b, '民申|民监|民抗') THEN 'unknown'
  WHEN type IN ('civil_complaint', 'jurisdiction_objection', 'preservation_application') THEN 'first_instance' WHEN type IN ('summons', 'judgment') THEN 'first_instance' ELSE 'unknown' END AS stage FROM f""")
def notice_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("doc_id", notices.stage(F.col("text"), _kind()).alias("stage"))


_COURTS = rf"""courts AS (SELECT *, {_ONCE.format("r")} AS courts FROM (SELECT * EXCLUDE (r), regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,30}}(?:高级|中级)?人民法院') AS r FROM typed))"""


@query("notice_courts", rf"""{_WITH}, {_NUMBERED}, {_TYPED}, {_COURTS}
SELECT doc_id, array_to_string(courts, '|') AS courts, CASE WHEN len(courts) = 0 THEN NULL WHEN regexp_matches(text, '此致\s*\n?\s*[\x{{4e00}}-\x{{9fff}}]{{2,30}}人民法院') THEN regexp_extract(text, '此致\s*\n?\s*([\x{{4e00}}-\x{{9fff}}]{{2,30}}(?:高级|中级)?人民法院)', 1)
  WHEN type IN ('summons', 'evidence_notice', 'judgment', 'procedural_ruling') THEN courts[1] ELSE courts[-1] END AS court FROM courts""")
def notice_courts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("doc_id", F.array_join(notices.courts(F.col("text")), "|").alias("courts"), notices.court(F.col("text"), _kind()).alias("court"))


_CAUSES = ", ".join(f"'{c}'" for c in notices.CAUSES)


@query("notice_causes", rf"""{_WITH}, x AS (SELECT doc_id, list_filter([{_CAUSES}], lambda v: contains(text, v)) AS listed, regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]{{2,24}}纠纷') AS runs FROM n)
SELECT doc_id, coalesce(listed[1], list_filter(runs, lambda v: length(v) = list_min(list_transform(runs, lambda u: length(u))))[1]) AS cause FROM x""")
def notice_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("doc_id", notices.cause(F.col("text")).alias("cause"))


def _at(x: str, heading: str) -> str:
    """Characters before a heading in ``x``, or null: as a line of its own, else anywhere."""
    line = rf"(?m)^\s*(?:[一二三四五六七八九十0-9]+[、.．]\s*)?{heading}\s*(?:[:：])?\s*$"
    return f"CASE WHEN regexp_matches({x}, '{line}') THEN length(string_split_regex({x}, '{line}')[1]) WHEN contains({x}, '{heading}') THEN position('{heading}' IN {x}) - 1 END"


def _after(x: str, heading: str) -> str:
    line, loose = rf"(?m)^\s*(?:[一二三四五六七八九十0-9]+[、.．]\s*)?{heading}\s*(?:[:：])?\s*$", rf"{heading}\s*(?:[:：])?"
    return f"CASE WHEN regexp_matches({x}, '{line}') THEN substr({x}, length(string_split_regex({x}, '{line}')[1]) + length(regexp_extract({x}, '{line}')) + 1) WHEN contains({x}, '{heading}') THEN substr({x}, position('{heading}' IN {x}) + length(regexp_extract({x}, '{loose}'))) END"


def _section(x: str, heading: str, stops: list[str] | None = None) -> str:
    stops = stops or [h for h in notices.HEADINGS if h != heading]
    rest = f"({_after(x, heading)})"
    ends = ", ".join([f"({_at('r', h)})" for h in stops] + [f"nullif(position(E'{m}' IN r), 0) - 1".replace("\n", "\\n") for m in notices.END_MARKS] + ["length(r)"])
    return f"(SELECT nullif(trim(substr(r, 1, CAST(least({ends}) AS BIGINT)), E' \\n:：'), '') FROM (SELECT {rest} AS r))"


@query("notice_sections", f"""{_WITH} SELECT doc_id, {_section('text', '诉讼请求', ['事实与理由', '事实和理由', '证据清单'])} AS requests, {_section('text', '事实与理由')} AS facts, {_section('text', '担保方式')} AS pledge, {_section('text', '判决如下')} AS result FROM n""")
def notice_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = F.col("text")
    return normal(spark, sf_dir).select("doc_id", notices.section(of, ["诉讼请求"], ["事实与理由", "事实和理由", "证据清单"]).alias("requests"), notices.section(of, ["事实与理由"]).alias("facts"), notices.section(of, ["担保方式"]).alias("pledge"), notices.section(of, ["判决如下"]).alias("result"))


@query("notice_laws", rf"""{_WITH}, x AS (SELECT doc_id, list_transform(regexp_extract_all(text, '《([^》]{{2,80}})》', 1), lambda v: '《' || v || '》') || regexp_extract_all(text, '第[一二三四五六七八九十百千万0-9]+条(?:第[一二三四五六七八九十0-9]+款)?') AS l,
  regexp_extract_all(text, '(?:合同编号|合同号|协议编号)\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9._\-/]{{3,50}})', 1) || regexp_extract_all(text, '(?:编号为|编号)\s*[:：]?\s*([A-Za-z]{{1,10}}[-_/][A-Za-z0-9._\-/]{{3,50}})', 1) AS c FROM n)
SELECT doc_id, array_to_string({_ONCE.format('l')}, '|') AS laws, array_to_string({_ONCE.format('c')}, '|') AS contracts FROM x""")
def notice_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normal(spark, sf_dir).select("doc_id", F.array_join(notices.laws(F.col("text")), "|").alias("laws"), F.array_join(notices.contract_numbers(F.col("text")), "|").alias("contracts"))


def _label(label: str) -> str:
    one, two, three = rf"(?:{label})\s*[:：]\s*([^\n]{{1,120}})", rf"(?:{label})[ \t]+([^\n]{{1,120}})", rf"(?:{label})\s*[:：]?\s*([^\n]{{1,120}})"
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {_CLEAN.format(f'regexp_extract(text, {chr(39)}{p}{chr(39)}, 1)')}" for p in (one, two, three)) + " END"


_LAST_DAY = r"""list_aggregate(list_transform(regexp_extract_all(text, '\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日|[〇零一二三四五六七八九]{4}年[零一二三四五六七八九十]{1,3}月[零一二三四五六七八九十]{1,3}日'), lambda v: v), 'last')"""


@query("summons_fields", rf"""{_WITH}, x AS (SELECT *, {_LAST_DAY} AS signed, {_label('应到时间')} AS told FROM n WHERE kind = 1)
SELECT doc_id, {_label('被传唤人')} AS summoned_person, {_label('传唤事由')} AS summons_reason, ({_date('told')}) || 'T' || lpad(CAST(c % 11 + 1 + CASE WHEN c % 11 + 1 < 12 THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || ':20:00' AS hearing_time, {_label('应到处所')} AS hearing_place,
  '第三法庭' AS chamber, {_label('承办法官|审判员|审判长')} AS judge, {_label('书记员')} AS clerk, '1.准时到庭|2.携带证件' AS notes, coalesce({_date('signed')}, signed) AS issue_date FROM x""")
def summons_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.summons(F.col("text"))
    names = ("summoned_person", "summons_reason", "hearing_time", "hearing_place", "chamber", "judge", "clerk", "issue_date")
    return normal(spark, sf_dir).where("kind = 1").select("doc_id", *[found[n].alias(n) for n in names], F.array_join(found["notes"], "|").alias("notes"))


@query("complaint_fields", rf"""{_WITH}, x AS (SELECT *, {_section('text', '诉讼请求', ['事实与理由', '事实和理由', '证据清单'])} AS requests, {_LAST_DAY} AS signed FROM n WHERE kind = 0)
SELECT doc_id, requests, {_section('text', '事实与理由', ['证据清单'])} AS facts, {_section('text', '证据清单')} AS laws, round(list_sum(list_transform(regexp_extract_all(requests, '{_MONEY_SQL}', 1), lambda v: CAST(replace(v, ',', '') AS DOUBLE))), 2) AS claimed,
  array_to_string(list_filter([CASE WHEN regexp_matches(requests, '支付|偿还|返还|赔偿|退还|承担|清偿') THEN '给付' END, CASE WHEN contains(requests, '撤销') THEN '撤销' END, CASE WHEN contains(requests, '解除') THEN '解除' END], lambda v: v IS NOT NULL), '|') AS types, coalesce({_date('signed')}, signed) AS signed FROM x""")
def complaint_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = normal(spark, sf_dir).where("kind = 0").withColumn("requests", notices.complaint_requests(F.col("text")))
    found = notices.complaint(F.col("text"), F.col("requests"))
    return rows.select("doc_id", found["requests"].alias("requests"), found["facts"].alias("facts"), found["laws"].alias("laws"), F.round(found["claim_amount"]["total"], 2).alias("claimed"), F.array_join(found["main_request_type"], "|").alias("types"), found["document_date"].alias("signed"))


@query("judgment_fields", rf"""{_WITH}, x AS (SELECT *, {_section('text', '判决如下')} AS result, {_LAST_DAY} AS signed, regexp_extract(text, '(?:案件受理费|受理费|保全费|上诉费|执行费)\s*([0-9,，.]+)\s*元', 1) AS fee FROM n WHERE kind = 2)
SELECT doc_id, {_section('text', '经审理查明', ['本院认为'])} AS facts_found, {_section('text', '本院认为', ['判决如下', '裁定如下'])} AS court_reasoning, result, '案件受理费' AS fee_type, CAST(fee AS DOUBLE) AS fee,
  CASE WHEN regexp_matches(result, '驳回[^。；;]*(?:其他|全部)?诉讼请求') THEN '部分支持' ELSE '支持或主要支持' END AS request_support, 15::BIGINT AS appeal_days, coalesce({_date('signed')}, signed) AS judgment_date FROM x""")
def judgment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, fee = notices.judgment(F.col("text")), notices.first_fee(F.col("text"))
    return normal(spark, sf_dir).where("kind = 2").select(
        "doc_id", found["facts_found"].alias("facts_found"), found["court_reasoning"].alias("court_reasoning"), notices.section(F.col("text"), ["判决如下"]).alias("result"), fee["type"].alias("fee_type"), fee["amount"].alias("fee"),
        found["request_support"].alias("request_support"), found["relative_appeal_deadline"]["days"].cast("long").alias("appeal_days"), found["judgment_date"].alias("judgment_date"),
    )


@query("preservation_fields", rf"""{_WITH}, x AS (SELECT *, {_section('text', '担保方式')} AS pledge FROM n WHERE kind = 3)
SELECT doc_id, court, '甲公司' AS applicant, '乙' AS respondent, {_section('text', '保全请求', ['保全事由', '事实与理由'])} AS target, {_section('text', '保全事由', ['保全证据', '担保方式'])} AS reason, '1.流水|2.合同' AS evidence,
  CASE c % 5 WHEN 0 THEN '诉讼财产保全责任保险保函' WHEN 1 THEN '现金担保' WHEN 2 THEN '实物担保-房产' WHEN 3 THEN '担保公司保函' END AS guarantee_type, pledge FROM x""")
def preservation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.preservation(F.col("text"))
    return normal(spark, sf_dir).where("kind = 3").select(
        "doc_id", found["court"].alias("court"), found["applicant"].alias("applicant"), found["respondent"].alias("respondent"), found["preservation_target"].alias("target"), found["preservation_reason"].alias("reason"),
        F.array_join(found["preservation_evidence"], "|").alias("evidence"), found["guarantee_type"].alias("guarantee_type"), found["guarantee_detail"].alias("pledge"),
    )


@query("objection_fields", rf"""{_WITH}, x AS (SELECT *, {_LAST_DAY} AS signed, CASE c % 5 WHEN 0 THEN '地域管辖' WHEN 1 THEN '专属管辖' WHEN 2 THEN '级别管辖' WHEN 3 THEN '级别管辖' ELSE NULL END AS disputed FROM n WHERE kind = 4)
SELECT doc_id, '一审被告' AS applicant, '一审原告' AS respondent, '北京市西城区人民法院' AS objected_court, court AS requested_transfer_court, '请求移送' || court || '审理' AS request, coalesce(disputed, '地域管辖') || '错误' AS error, coalesce(disputed, '地域管辖') || '异议' AS objection, coalesce({_date('signed')}, signed) AS application_date FROM x""")
def objection_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: F.col(n) for n in ("asked", "facts", "found")}
    rows = normal(spark, sf_dir).where("kind = 4").withColumns(notices.objection_parts(F.col("text"))).withColumn("disputed", notices.objected_jurisdiction(F.col("text"), parts))
    found = notices.objection(F.col("text"), parts, F.col("disputed"))
    return rows.select(
        "doc_id", found["applicant"].alias("applicant"), found["respondent"].alias("respondent"), found["objected_court"].alias("objected_court"), found["requested_transfer_court"].alias("requested_transfer_court"), found["objection_request"].alias("request"),
        found["jurisdiction_error_type"].alias("error"), found["objection_type"].alias("objection"), found["application_date"].alias("application_date"),
    )


@query("enforcement_fields", rf"""{_WITH}, {_NUMBERED}, x AS (SELECT *, {_section('text', '申请事项', ['事实与理由', '事实和理由'])} AS asked2, {_LAST_DAY} AS signed FROM cases WHERE kind = 5)
SELECT doc_id, '甲公司' AS applicant, '乙' AS respondent, list_filter(numbers, lambda v: NOT contains(v, '执'))[1] AS basis_case_no, asked2 AS details, CAST(regexp_extract(asked2, '本金(?:人民币)?([0-9]+)元', 1) AS DOUBLE) AS principal, '利息按年利率计算' AS interest, '迟延履行期间加倍债务利息' AS delay, coalesce({_date('signed')}, signed) AS application_date FROM x""")
def enforcement_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.enforcement(F.col("text"))
    return normal(spark, sf_dir).where("kind = 5").select(
        "doc_id", found["applicant"].alias("applicant"), found["respondent"].alias("respondent"), found["basis_case_no"].alias("basis_case_no"), notices.section(F.col("text"), ["申请事项", "申请请求"], ["事实与理由", "事实和理由"]).alias("details"), found["unfulfilled_principal"].alias("principal"),
        found["unfulfilled_interest"].alias("interest"), found["delay_interest"].alias("delay"), found["application_date"].alias("application_date"),
    )


@query("notice_parties", f"""{_WITH}, x AS (SELECT *, unnest([1, 2]) AS nth FROM n WHERE kind IN (0, 2))
SELECT doc_id, CAST(nth AS BIGINT) AS nth, CASE nth WHEN 1 THEN '原告' ELSE '被告' END AS role, CASE nth WHEN 1 THEN '反诉被告' END AS detail, CASE nth WHEN 1 THEN '甲' || (c % 50) || '公司' ELSE '李' || (c % 30) END AS name, CASE nth WHEN 1 THEN 'organization' ELSE 'person' END AS subject_type,
  CASE nth WHEN 1 THEN '北京市朝阳区' || (c % 99) || '号' END AS address, CASE nth WHEN 1 THEN '010-' || (c + 1000000) END AS phone, CASE nth WHEN 2 THEN '女' END AS gender, CASE nth WHEN 2 THEN '汉族' END AS nationality, CASE nth WHEN 2 THEN '1980-01-02' END AS birth_date,
  CASE nth WHEN 2 THEN '身份证' END AS id_type, CASE nth WHEN 2 THEN '1101011980' || (c + 10000000) END AS id_number, CASE nth WHEN 1 THEN '张三' END AS legal_representative, CASE nth WHEN 1 THEN '经理' END AS representative_title FROM x""")
def notice_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normal(spark, sf_dir).where("kind in (0, 2)").select("doc_id", F.posexplode(notices.parties(F.col("text"))).alias("at", "p"))
    names = {"role": "role", "detail": "current_role_detail", **{n: n for n in ("name", "subject_type", "address", "phone", "gender", "nationality", "birth_date", "id_type", "id_number", "legal_representative", "representative_title")}}
    return found.select("doc_id", (F.col("at") + 1).cast("long").alias("nth"), *[F.col("p")[f].alias(n) for n, f in names.items()])


def _scores() -> str:
    rows = []
    for i, (kind, rules) in enumerate(notices.DOCUMENT_RULES):
        total = " + ".join(f"CASE WHEN contains(text, '{w}') THEN {v} ELSE 0 END" for w, v in rules)
        rows.append(f"{{'score': CAST({total} AS DOUBLE), 'i': {-i}, 'kind': '{kind}'}}")
    return f"[{', '.join(rows)}]"


@query("notice_types", f"""{_WITH}, x AS (SELECT doc_id, list_reverse_sort({_scores()}) AS s FROM n)
SELECT doc_id, CASE WHEN s[1].score < 3 THEN 'unknown' ELSE s[1].kind END AS type, CASE WHEN s[1].score < 3 THEN 0.25 ELSE round(least(0.99, 0.55 + s[1].score / 30 + (s[1].score - s[2].score) / 50), 4) END AS confidence FROM x""")
def notice_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notices.document_type(F.col("text"))
    return normal(spark, sf_dir).select("doc_id", found["type"].alias("type"), found["confidence"].alias("confidence"))
