"""Fields of court notices and pleadings as column expressions.

``text`` is a text that ``squeezed`` has made, best a column of its own: an expression would be repeated at every use.
Nulls and empty texts give nulls or empty arrays.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.forms import claimed_sum, iso_datetime, numbered_items, relative_deadline
from quire.functions.text import HAN, all_matches, clean_value, first_match, iso_date, let, squeezed

# Names, words and patterns that the rules look for.
CAUSES = ("民间借贷纠纷", "买卖合同纠纷", "房屋租赁合同纠纷", "劳务合同纠纷", "劳务报酬纠纷", "物业服务合同纠纷", "网络购物合同纠纷", "服务合同纠纷", "建设工程施工合同纠纷", "不当得利纠纷", "劳动争议纠纷", "机动车交通事故责任纠纷", "交通事故纠纷", "承揽合同纠纷")
HEADINGS = (
    "诉讼请求", "上诉请求", "申请事项", "申请请求", "答辩请求", "保全请求", "保全标的", "事实与理由", "事实和理由", "上诉事实与理由", "上诉理由", "答辩意见", "答辩要点", "实体答辩意见", "保全事由",
    "证据清单", "举证材料", "保全证据", "担保方式", "经审理查明", "本院经审理查明", "经审查查明", "本院认为", "判决如下", "裁定如下",
)
END_MARKS = ("\n此致", "\n审判长", "\n审 判 长", "\n申请人:", "\n上诉人:", "\n答辩人:", "\n具状人:")
ROLES = ("原告", "被告", "第三人", "申请人", "被申请人", "上诉人", "被上诉人", "答辩人", "被答辩人", "申请执行人", "被执行人", "被传唤人")
PARTY_ENDS = "诉讼请求|上诉请求|申请事项|申请请求|事实与理由|事实和理由|答辩意见|答辩要点|证据清单|保全请求|保全标的|保全事由|保全证据|担保方式|本院认为|经审理查明|判决如下|裁定如下"
COURT = f"({HAN}{{2,30}}(?:高级|中级)?人民法院)"
CASE_NUMBERS = (
    rf"[（(]\s*\d{{4}}\s*[）)]\s*[\u4e00-\u9fffA-Za-z0-9\s]{{1,28}}?\s*(?:民再初|民再终|民辖终|民初|民终|民再|民申|民监|民抗|执恢|执异|执|刑初|刑终|行初|行终)\s*\d+\s*号",
    rf"[（(]\s*\d{{4}}\s*[）)]\s*[\u4e00-\u9fffA-Za-z0-9\s]{{1,40}}?\s*\d+\s*号",
)
CONTRACT_NUMBERS = (r"(?:合同编号|合同号|协议编号)\s*[:：]?\s*([A-Za-z0-9][A-Za-z0-9._\-/]{3,50})", r"(?:编号为|编号)\s*[:：]?\s*([A-Za-z]{1,10}[-_/][A-Za-z0-9._\-/]{3,50})")
LAW, ARTICLE = "《([^》]{2,80})》", "(第[一二三四五六七八九十百千万0-9]+条(?:第[一二三四五六七八九十0-9]+款)?)"
SIGNED = (r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日", "[〇零一二三四五六七八九]{4}年[零一二三四五六七八九十]{1,3}月[零一二三四五六七八九十]{1,3}日")
FEES = r"(案件受理费|受理费|保全费|上诉费|执行费)\s*([0-9,，.]+)\s*元"
REQUEST_WORDS = (
    ("给付", ("支付", "偿还", "返还", "赔偿", "退还", "承担", "清偿")), ("撤销", ("撤销",)), ("改判", ("改判",)), ("发回重审", ("发回重审",)), ("解除", ("解除合同", "解除")), ("确认", ("确认",)),
    ("行为", ("腾退", "交付", "停止", "更换", "办理退货")), ("保全", ("冻结", "查封", "扣押", "保全")),
)
DOCUMENT_RULES = (
    ("civil_complaint", (("民事起诉状", 8.0), ("诉讼请求", 2.0), ("具状人", 1.0))), ("summons", (("传票", 8.0), ("被传唤人", 3.0), ("应到时间", 2.0), ("传唤事由", 2.0))),
    ("evidence_notice", (("举证通知书", 10.0), ("举证期限", 2.0), ("逾期举证", 1.0))), ("jurisdiction_objection", (("管辖权异议申请书", 10.0), ("移送", 2.0), ("无管辖权", 2.0))),
    ("preservation_application", (("财产保全申请书", 10.0), ("保全事由", 2.0), ("担保方式", 1.0))), ("defense", (("民事二审答辩状", 10.0), ("民事答辩状", 9.0), ("答辩意见", 2.0), ("答辩请求", 2.0))),
    ("appeal", (("民事上诉状", 10.0), ("上诉请求", 2.0), ("不服", 1.0), ("上诉人", 1.0))), ("judgment", (("民事判决书", 10.0), ("判决如下", 4.0), ("本院认为", 1.0))),
    ("procedural_ruling", (("民事裁定书", 8.0), ("裁定如下", 3.0), ("转为适用普通程序", 8.0))), ("enforcement_application", (("强制执行申请书", 10.0), ("申请执行", 2.0), ("执行费用", 1.0))),
)
FILED = ("civil_complaint", "jurisdiction_objection", "preservation_application", "defense", "appeal")
ISSUED = ("summons", "evidence_notice", "judgment", "procedural_ruling")
SECOND_PROCEDURE = r"(?:按照|依照|适用)第二审程序|按第二审程序(?:审理|再审)|原来(?:系|是|属于)第二审|原生效(?:判决|裁定).{0,30}(?:民终|第二审)|(?:本院|上级人民法院).{0,20}提审|提审本案"
FIRST_PROCEDURE = r"(?:按照|依照|适用)第一审程序|按第一审程序(?:审理|再审)|原来(?:系|是|属于)第一审|原生效(?:判决|裁定).{0,30}(?:民初|第一审)"
JURISDICTION = (
    ("专属管辖", ("专属管辖", "不动产所在地人民法院管辖", "不动产所在地法院管辖", "不动产纠纷", "港口所在地人民法院管辖", "港口作业纠纷", "遗产所在地人民法院管辖", "主要遗产所在地人民法院管辖", "继承遗产纠纷"), ()),
    ("级别管辖", ("级别管辖", "管辖级别", "越级管辖", "超越级别管辖", "不符合级别管辖", "不属于基层人民法院管辖", "不应由基层人民法院管辖", "应由中级人民法院管辖", "应由高级人民法院管辖", "应由最高人民法院管辖", "超过基层人民法院受理范围", "超过中级人民法院受理范围", "诉讼标的额超过", "标的额超过"),
     (r"(?:本案|该案).{0,20}(?:应当|应由|依法应由)(?:中级|高级|最高)人民法院管辖", r"(?:基层|中级)人民法院.{0,20}(?:无权|不具有|没有)(?:级别)?管辖权", r"(?:诉讼)?标的额.{0,20}(?:超过|超出).{0,20}(?:受理|管辖)(?:范围|标准)")),
    ("地域管辖", ("地域管辖", "被告住所地", "原告住所地", "申请人住所地", "被申请人住所地", "经常居住地", "合同履行地", "合同签订地", "侵权行为地", "侵权结果发生地", "公司住所地", "票据支付地", "保险标的物所在地", "运输始发地", "运输目的地", "财产所在地", "约定管辖", "协议管辖"),
     (r"(?:受诉|原审|该|本)法院.{0,20}(?:无权|不具有|没有)管辖权", r"不属于.{0,30}人民法院管辖", r"应由.{2,30}人民法院管辖", r"移送(?:至|到)?.{2,30}人民法院(?:审理|管辖)")),
)
COMPANY_WORDS = "公司|集团|中心|事务所|委员会|合伙企业|合作社"
PARTY_FIELDS = {
    "phone": [r"(?:联系电话|电话|手机)\s*[:：]?\s*([0-9Xx*\-—()（）]{5,30})"],
    "id_no": [r"(?:公民身份号码|身份证号码|身份证号)\s*[:：]?\s*([0-9Xx*\\\-]{6,30})"],
    "credit_code": [r"统一社会信用代码\s*[:：]?\s*([0-9A-ZxX*]{8,30})"],
    "gender": [r"[,，]\s*([男女])\s*[,，]"],
    "nationality": [f"[,，]\\s*({HAN}{{1,8}}族)\\s*[,，]"],
    "legal_representative": [r"法定代表人\s*[:：]?\s*([^,，。；;\n]{2,40})"],
    "representative_title": [r"法定代表人\s*[:：]?\s*[^,，。；;\n]{2,40}[,，]\s*([^。；;\n]{1,30})"],
    "agent": [r"委托(?:诉讼)?代理人\s*[:：]?\s*([^,，。；;\n]{2,50})"],
}
ADDRESS = [r"(?:住所地|住所|住址|户籍住址|现住址)\s*[:：]?\s*(.*?)(?=[,，]\s*(?:身份证|公民身|统一社会|联系|电话|手机|法定|负责)|[。；;\n]|$)", r"(?:住所地|住所|住址|户籍住址|现住址)\s*[:：]?\s*([^。；;\n]{2,120})"]
BIRTH = r"(\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日)出生"


def _any(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    return text.rlike("|".join(map(re.escape, words)))


def case_numbers(text: Column) -> Column:
    """All case numbers, once each, those with a known kind first."""

    def written(raw: Column) -> Column:
        one = F.translate(F.regexp_replace(raw, r"\s+", " "), "()", "（）")
        return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(one), r"（\s*", "（"), r"\s*）", "）"), r"\s+号", "号")

    return F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CASE_NUMBERS]), written))


def courts(text: Column) -> Column:
    return all_matches(text, COURT)


def court(text: Column, kind: Column) -> Column:
    """The court that is addressed; else the first of a court's own document, the last of any other."""
    addressed = F.regexp_extract(text, rf"此致\s*\n?\s*{COURT}", 1)
    chosen = let(courts(text), lambda found: F.get(found, F.when(kind.isin(*ISSUED), F.lit(0)).otherwise(F.size(found) - 1)))
    return F.when(addressed != "", addressed).otherwise(chosen)


def cause(text: Column) -> Column:
    """The first listed cause that the text holds; else the shortest run of ideographs that ends like one."""
    found = all_matches(text, f"({HAN}{{2,24}}纠纷)")
    shortest = F.array_min(F.transform(found, lambda x, i: F.struct(F.length(x).alias("n"), i.alias("i"), x.alias("x"))))["x"]
    return F.coalesce(*[F.when(text.contains(c), F.lit(c)) for c in CAUSES], shortest)


def heading_at(text: Column, heading: str) -> tuple[Column, Column]:
    """Where a heading starts (from 1) and how long it is: as a line of its own, else anywhere; null for none.

    Texts are asked for the bare heading first: few hold it, and patterns cost far more.
    """
    line = rf"(?m)^\s*(?:[一二三四五六七八九十0-9]+[、.．]\s*)?{re.escape(heading)}\s*(?:[:：])?\s*$"
    loose = rf"{re.escape(heading)}\s*(?:[:：])?"
    there = text.contains(heading)
    own, other = (F.when(there, F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0))) for p in (line, loose))
    return F.coalesce(own, other), F.when(there, F.length(F.when(own.isNotNull(), F.regexp_extract(text, line, 0)).otherwise(F.regexp_extract(text, loose, 0))))


def section(text: Column, headings: list[str], stops: list[str] | None = None) -> Column:
    """What stands under the first of ``headings``, up to the first of ``stops`` (all other known headings) or closing marks."""
    stops = [h for h in HEADINGS if h not in headings] if not stops else stops

    def upto_next(rest: Column) -> Column:
        ends = [heading_at(rest, h)[0] for h in stops] + [F.nullif(F.instr(rest, m), F.lit(0)) for m in END_MARKS]
        return F.nullif(F.btrim(F.substring(rest, F.lit(1), F.least(*ends, F.length(rest) + 1) - 1), F.lit(" \n:：")), F.lit(""))

    starts = F.array(*[F.struct(at.alias("at"), F.lit(i).alias("i"), n.alias("n")) for i, (at, n) in enumerate(heading_at(text, h) for h in headings)])
    first = F.array_min(F.filter(starts, lambda x: x["at"].isNotNull()))
    return let(let(first, lambda x: F.substring(text, x["at"] + x["n"], F.length(text))), upto_next)


def laws(text: Column) -> Column:
    """Named laws, then articles, once each."""
    return F.array_distinct(F.concat(F.transform(all_matches(text, LAW), lambda x: F.concat(F.lit("《"), x, F.lit("》"))), all_matches(text, ARTICLE)))


def contract_numbers(text: Column) -> Column:
    return F.array_distinct(F.concat(*[all_matches(text, p) for p in CONTRACT_NUMBERS]))


def labelled(text: Column, labels: list[str], most: int = 120) -> Column:
    """What follows a label on its line: behind a colon, else behind a space, else at once."""
    one = "|".join(map(re.escape, labels))
    return first_match(text, [rf"(?:{one})\s*[:：]\s*([^\n]{{1,{most}}})", rf"(?:{one})[ \t]+([^\n]{{1,{most}}})", rf"(?:{one})\s*[:：]?\s*([^\n]{{1,{most}}})"])


def party(role: Column, body: Column) -> Column:
    """struct of a party's fields, from its role label and the block behind it."""
    return let(squeezed(body), lambda block: let(_party_name(block), lambda name: _party(role, name, block)))


def _party_name(block: Column) -> Column:
    name = F.regexp_extract(F.regexp_extract(block, r"\A[^\n]*", 0), r"\A[^,，。;；]*", 0)
    return F.substring(F.trim(F.regexp_replace(name, r"\A(?:为|系)", "")), 1, 80)


def _party(role: Column, name: Column, block: Column) -> Column:
    fields = {k: first_match(block, p) for k, p in PARTY_FIELDS.items()}
    code = fields["credit_code"]
    return F.struct(
        F.regexp_replace(role, "[（(].*?[）)]", "").alias("role"), F.nullif(F.regexp_extract(role, "[（(]([^）)]{1,30})[）)]", 1), F.lit("")).alias("current_role_detail"), name.alias("name"),
        F.when(name.rlike(COMPANY_WORDS) | code.isNotNull(), "organization").otherwise("person").alias("subject_type"), first_match(block, ADDRESS).alias("address"), fields["phone"].alias("phone"),
        fields["gender"].alias("gender"), fields["nationality"].alias("nationality"), iso_date(first_match(block, [BIRTH])).alias("birth_date"),
        F.when(code.isNotNull(), "统一社会信用代码").when(fields["id_no"].isNotNull(), "身份证").alias("id_type"), F.coalesce(code, fields["id_no"]).alias("id_number"),
        fields["legal_representative"].alias("legal_representative"), fields["representative_title"].alias("representative_title"), fields["agent"].alias("agent"), block.alias("raw"),
    )


def parties(text: Column) -> Column:
    """array of party structs, one for each role and name: of several the first that has most fields."""
    roles = "|".join(sorted(map(re.escape, ROLES), key=len, reverse=True))
    pattern = rf"(?ms)^\s*((?:{roles})(?:\s*[（(][^）)]{{1,30}}[）)])?)\s*[:：]\s*(.*?)(?=^\s*(?:{roles})\s*(?:[（(][^）)]{{1,30}}[）)])?\s*[:：]|^\s*(?:{PARTY_ENDS})\s*$|\z)"
    head = rf"(?s)\A\s*((?:{roles})(?:\s*[（(][^）)]{{1,30}}[）)])?)\s*[:：]\s*(.*)\z"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.transform(whole, lambda w: F.struct(F.regexp_extract(w, head, 1).alias("r"), F.regexp_extract(w, head, 2).alias("b"))), lambda x: F.trim(x["b"]) != "")
    optional = ("current_role_detail", "address", "phone", "gender", "nationality", "birth_date", "id_type", "id_number", "legal_representative", "representative_title", "agent")
    held = lambda p: F.size(F.array_compact(F.array(*[p[f] for f in optional])))
    same = lambda a, b: (a["p"]["role"] == b["p"]["role"]) & (a["p"]["name"] == b["p"]["name"])
    best = lambda ranked, x: F.array_max(F.transform(F.filter(ranked, lambda y: same(x, y)), lambda y: F.struct(y["n"].alias("n"), (-y["i"]).alias("i"), y["p"].alias("p"))))["p"]
    firsts = lambda ranked: F.filter(ranked, lambda x: ~F.exists(ranked, lambda y: same(x, y) & (y["i"] < x["i"])))
    found = F.filter(F.transform(pairs, lambda x: party(x["r"], x["b"])), lambda p: p["name"] != "")
    ranked = F.transform(found, lambda p, i: F.struct(p.alias("p"), i.alias("i"), held(p).alias("n")))
    return let(ranked, lambda all_: F.transform(firsts(all_), lambda x: best(all_, x)))


def signature_date(text: Column) -> Column:
    """struct<raw,date> of the last date in the text; the raw text where it is none."""
    found = [F.nullif(F.regexp_extract(text, f"(?s)\\A.*({p})", 1), F.lit("")) for p in SIGNED]
    at = [F.when(x.isNotNull(), F.length(F.regexp_extract(text, f"(?s)\\A(.*){p}", 1))) for x, p in zip(found, SIGNED, strict=True)]
    last = F.when(F.coalesce(at[1], F.lit(-1)) > F.coalesce(at[0], F.lit(-1)), found[1]).otherwise(found[0])
    return let(last, lambda x: F.when(x.isNotNull(), F.struct(x.alias("raw"), F.coalesce(iso_date(x), x).alias("date"))))


def first_fee(text: Column) -> Column:
    """struct<type,amount,raw> of the first court fee."""
    raw = F.regexp_extract(text, FEES, 0)
    return F.when(raw != "", F.struct(F.regexp_extract(text, FEES, 1).alias("type"), F.translate(F.regexp_extract(text, FEES, 2), ",，", "").try_cast("double").alias("amount"), raw.alias("raw")))


def request_types(text: Column) -> Column:
    return let(text, lambda t: F.array_compact(F.array(*[F.when(_any(t, words), F.lit(name)) for name, words in REQUEST_WORDS])))


def jurisdiction(text: Column) -> Column:
    """Which jurisdiction is disputed: named outright, else exclusive before level before territory; null for none."""
    def said(whole: Column) -> Column:
        named = [F.when(_any(whole, [f"{k}错误", f"{k}异议"]), F.lit(k)) for k, _, _ in JURISDICTION]
        shown = [F.when(_any(whole, words) | (whole.rlike("|".join(patterns)) if patterns else F.lit(False)), F.lit(k)) for k, words, patterns in JURISDICTION]
        return F.coalesce(*named, *shown)

    return let(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\x{3000}\x{A0}]+", ""), said)


def guarantee(text: Column) -> Column:
    has = text.contains
    return (
        F.when(has("保险") & has("保函"), "诉讼财产保全责任保险保函").when(has("现金保证金") | has("现金担保"), "现金担保").when(has("房产") & has("担保"), "实物担保-房产")
        .when(has("担保公司"), "担保公司保函").when(has("保函"), "保函")
    )


def document_type(text: Column, filename: Column | None = None, hint: Column | None = None) -> Column:
    """struct<type,confidence>: the kind whose words weigh most, the first of equals; below 3 it is unknown.

    Words in the file name weigh 0.35 as much.  A ruling on ordinary procedure is no judgment.
    """
    whole, name = text, F.coalesce(filename, F.lit("")) if filename is not None else F.lit("")
    turned = whole.contains("转为适用普通程序") | (whole.contains("民事裁定书") & whole.contains("普通程序"))
    scores = []
    for i, (kind, rules) in enumerate(DOCUMENT_RULES):
        score = F.when(hint == kind, F.lit(12.0)).otherwise(F.lit(0.0)) if hint is not None else F.lit(0.0)
        for word, weight in rules:
            score = score + F.when(whole.contains(word), F.lit(weight)).when(name.contains(word), F.lit(weight * 0.35)).otherwise(F.lit(0.0))
        if kind == "procedural_ruling":
            score = score + F.when(turned, F.lit(20.0)).otherwise(F.lit(0.0))
        if kind == "judgment":
            score = F.when(turned, F.least(score, F.lit(1.0))).otherwise(score)
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("i"), F.lit(kind).alias("kind")))

    def chosen(ordered: Column) -> Column:
        best, margin = ordered[0], ordered[0]["score"] - ordered[1]["score"]
        sure = F.round(F.least(F.lit(0.99), F.lit(0.55) + best["score"] / 30 + margin / 50), 4)
        return F.struct(F.when(best["score"] < 3, "unknown").otherwise(best["kind"]).alias("type"), F.when(best["score"] < 3, F.lit(0.25)).otherwise(sure).alias("confidence"))

    return let(F.sort_array(F.array(*scores), asc=False), chosen)


def stage(text: Column, kind: Column, numbers: Column | None = None) -> Column:
    """The stage of a trial: the first case number decides; without one that says it, words near the title and the kind do."""
    numbers = case_numbers(text) if numbers is None else numbers
    bare = F.transform(numbers, lambda n: F.regexp_replace(F.translate(n, "（）", "()"), r"\s+", ""))
    whole, head = F.regexp_replace(text, r"\s+", ""), F.substring(text, 1, 1800)
    again = lambda others: (
        F.when(whole.rlike(SECOND_PROCEDURE), "retrial_second_instance").when(whole.rlike(FIRST_PROCEDURE), "retrial_first_instance")
        .when(F.exists(others, lambda x: x.rlike("民终|民辖终")), "retrial_second_instance").otherwise("retrial_first_instance")
    )
    by_words = (
        F.when(kind.isin(*FILED), "first_instance")
        .when(head.contains("再审"), F.when(F.regexp_replace(head, r"\s+", "").rlike("(?:按照|依照|适用)第二审程序|提审"), "retrial_second_instance").otherwise("retrial_first_instance"))
        .when(head.rlike("二审|上诉人"), "second_instance").when(kind.isin(*ISSUED), "first_instance").otherwise("unknown")
    )

    def said(numbers: Column) -> Column:
        first = F.get(numbers, F.lit(0))
        return (
            F.when(first.isNull(), by_words).when(first.rlike(r"(?:执恢|执异|执)\d+号"), "unknown").when(first.contains("民再初"), "retrial_first_instance").when(first.contains("民再终"), "retrial_second_instance")
            .when(first.contains("民初"), "first_instance").when(first.rlike("民终|民辖终"), "second_instance").when(first.contains("民再"), again(F.slice(numbers, 2, 1000))).when(first.rlike("民申|民监|民抗"), "unknown").otherwise(by_words)
        )

    return let(bare, said)


def request_support(requests: Column, judgment: Column) -> Column:
    """Whether a judgment grants what was asked for, by its words; null where either is missing."""
    rejected, granted = judgment.rlike("驳回[^。；;]*(?:其他|全部)?诉讼请求"), judgment.rlike("支付|赔偿|返还|承担|偿还")
    said = F.when(rejected & granted, "部分支持").when(rejected, "不支持/驳回").when(granted, "支持或主要支持").otherwise("无法稳定判断")
    return F.when((F.coalesce(requests, F.lit("")) != "") & (F.coalesce(judgment, F.lit("")) != ""), said)


def first_of_role(found: Column, roles: list[str], field: str = "name") -> Column:
    """A field of the first party of any of ``roles``."""
    return F.get(F.filter(F.transform(F.filter(found, lambda p: p["role"].isin(*roles)), lambda p: p[field]), lambda x: x.isNotNull() & (x != "")), F.lit(0))


def summons(text: Column) -> dict[str, Column]:
    place, hearing, notes = labelled(text, ["应到处所"]), labelled(text, ["应到时间"]), section(text, ["注意事项"], ["承办法官", "审判长", "审判员", "书记员"])
    return {
        "summoned_person": labelled(text, ["被传唤人"]), "summons_reason": labelled(text, ["传唤事由"]), "hearing_time": iso_datetime(hearing), "hearing_place": place,
        "chamber": first_match(place, [f"(第?[一二三四五六七八九十0-9]+(?:审判庭|法庭)|{HAN}{{1,20}}(?:审判庭|法庭))"]), "judge": labelled(text, ["承办法官", "审判员", "审判长"]),
        "judge_phone": labelled(text, ["联系电话", "法官联系方式"]), "clerk": labelled(text, ["书记员"]), "notes": numbered_items(notes), "summoned_address": labelled(text, ["住所地", "住所"]), "issue_date": signature_date(text)["date"],
    }


def complaint_requests(text: Column) -> Column:
    return section(text, ["诉讼请求"], ["事实与理由", "事实和理由", "证据清单"])


def complaint(text: Column, asked: Column | None = None) -> dict[str, Column]:
    """``asked``: ``complaint_requests``, best a column of its own."""
    asked = complaint_requests(text) if asked is None else asked
    return {"requests": asked, "facts": section(text, ["事实与理由", "事实和理由"], ["证据清单"]), "claim_amount": let(asked, claimed_sum), "main_request_type": request_types(asked), "laws": section(text, ["证据清单"]), "document_date": signature_date(text)["date"]}


def evidence_notice(text: Column) -> dict[str, Column]:
    target = F.coalesce(clean_value(F.nullif(F.regexp_extract(text, r"(?:号)\s*\n\s*([^:\n]{1,60})[:：]\s*\n", 1), F.lit(""))), first_match(text, [r"本院受理原告[^\n]{1,40}诉(?:你方|你)"], 0))
    return {
        "notice_target": target, "relative_deadline": relative_deadline(text), "evidence_submission_form": first_match(text, ["(证据材料应当提交复印件[^。]{0,160}。)", "(全部证据需[^。]{0,160}。)", "(证据材料须[^。]{0,160}。)"]),
        "recommended_evidence": first_match(text, ["(?:应当|应|需|须)提交([^。]{3,250}(?:证据|材料|记录|凭证)[^。]{0,100})"]),
        "late_consequences": first_match(text, ["(逾期[^。]{2,180}(?:后果|采纳|罚款|裁判|风险)[^。]{0,80}。?)", "(未能提供证据[^。]{2,180}。)"]), "issue_date": signature_date(text)["date"],
    }


def objection_parts(text: Column) -> dict[str, Column]:
    """What several fields of an objection are read from."""
    return {"asked": section(text, ["申请事项", "申请请求"], ["事实与理由", "事实和理由"]), "facts": section(text, ["事实与理由", "事实和理由"]), "found": parties(text)}


def objection(text: Column, parts: dict[str, Column] | None = None, disputed: Column | None = None) -> dict[str, Column]:
    """``parts``: ``objection_parts``, and ``disputed``: their ``objected_jurisdiction``, best columns of their own."""
    parts = parts or objection_parts(text)
    asked, found = parts["asked"], parts["found"]
    disputed = objected_jurisdiction(text, parts) if disputed is None else disputed
    transfer = let(F.coalesce(asked, text), lambda t: first_match(t, [rf"移送\s*{COURT}\s*审理", rf"移送至\s*{COURT}"]))
    return {
        "applicant": first_of_role(found, ["申请人"], "current_role_detail"), "respondent": first_of_role(found, ["被申请人"], "current_role_detail"), "objected_court": court(text, F.lit("jurisdiction_objection")),
        "requested_transfer_court": transfer, "objection_request": asked, "objection_facts": parts["facts"],
        "jurisdiction_error_type": F.concat(disputed, F.lit("错误")), "objection_type": F.concat(disputed, F.lit("异议")), "application_date": signature_date(text)["date"],
    }


def objected_jurisdiction(text: Column, parts: dict[str, Column]) -> Column:
    return jurisdiction(F.coalesce(F.nullif(F.concat_ws("\n", parts["asked"], parts["facts"]), F.lit("")), text))


def receiving_court(text: Column) -> Column:
    """The court that a line of metadata at the head names."""
    ends = "(?:人民法院|海事法院|知识产权法院|互联网法院|金融法院|铁路运输法院)"
    return first_match(F.substring(F.regexp_replace(text, r"\s+", ""), 1, 500), [f"法院[:：|丨｜]?({HAN}{{2,40}}?{ends})(?=版式|[｜|】\\]]|$)", f"法院[:：|丨｜]?({HAN}{{2,40}}?{ends})", f"({HAN}{{2,40}}?{ends})"])


def preservation(text: Column) -> dict[str, Column]:
    target, pledge, found = section(text, ["保全请求", "保全标的"], ["保全事由", "事实与理由"]), section(text, ["担保方式"]), parties(text)
    return {
        "court": receiving_court(text), "applicant": first_of_role(found, ["申请人"]), "respondent": first_of_role(found, ["被申请人"]), "preservation_target": target, "preservation_amount": claimed_sum(target),
        "preservation_reason": section(text, ["保全事由"], ["保全证据", "担保方式"]), "preservation_evidence": numbered_items(section(text, ["保全证据"], ["担保方式"])), "guarantee_type": guarantee(F.coalesce(pledge, text)), "guarantee_detail": pledge,
    }


def defence(text: Column) -> dict[str, Column]:
    opinion, asked = section(text, ["实体答辩意见", "答辩意见", "答辩要点"], ["举证材料", "答辩请求"]), section(text, ["答辩请求"])
    whole = F.concat(opinion, F.coalesce(F.concat(F.lit("\n答辩请求\n"), asked), F.lit("")))
    return {"defense_opinion": whole, "defense_request": numbered_items(asked), "defense_evidence": numbered_items(section(text, ["举证材料"], ["答辩请求"])), "claim_amount": claimed_sum(opinion)}


def appeal(text: Column) -> dict[str, Column]:
    asked = section(text, ["上诉请求"], ["事实与理由", "上诉事实与理由", "上诉理由"])
    return {
        "original_role": F.concat(F.lit("原审"), first_match(text, [r"上诉人\s*[（(]原审([^）)]{1,20})[）)]"])), "first_instance_court": first_match(text, [f"不服\\s*({HAN}{{2,30}}人民法院)(?:作出|的)?(?:一审)?民事判决", f"不服\\s*({HAN}{{2,30}}人民法院)[^。]{{0,60}}一审判决"]),
        "requests": numbered_items(asked), "facts": section(text, ["上诉事实与理由", "事实与理由", "上诉理由"]), "claim_amount": claimed_sum(asked), "main_request_type": request_types(asked), "laws": laws(text),
    }


def judgment(text: Column) -> dict[str, Column]:
    told = first_match(text, [r"(?s)原告[^。]{0,80}提出诉讼请求\s*[:：]?\s*(.*?)(?=事实与理由|被告[^。]{0,40}(?:答辩|未提出答辩)|经审理查明|本院认为)"])
    asked, result = F.coalesce(told, section(text, ["诉讼请求"], ["事实与理由", "经审理查明", "本院认为"])), section(text, ["判决如下"])
    return {
        "requests": numbered_items(asked), "facts_found": section(text, ["经审理查明", "本院经审理查明"], ["本院认为"]), "court_reasoning": section(text, ["本院认为"], ["判决如下", "裁定如下"]), "judgment_result": numbered_items(result),
        "litigation_fee": first_fee(text), "request_support": request_support(asked, result), "judgment_date": signature_date(text)["date"],
        "relative_appeal_deadline": relative_deadline(F.coalesce(first_match(text, ["(?s)(如不服本判决.*?上诉。?)"]), F.lit(""))), "relative_fulfillment_deadline": relative_deadline(F.coalesce(result, text)),
    }


def ruling(text: Column) -> dict[str, Column]:
    result = F.trim(F.regexp_replace(section(text, ["裁定如下"]), r"(?s)\n?(?:审判员|审判长|书记员)[^\n]*.*\z", ""))
    result = F.trim(F.regexp_replace(result, f"\\n?(?:{SIGNED[0]}|{SIGNED[1]})\\s*\\z", ""))
    return {"ruling_result": numbered_items(result), "ruling_date": signature_date(text)["date"]}


def enforcement(text: Column) -> dict[str, Column]:
    asked, found = section(text, ["申请事项", "申请请求"], ["事实与理由", "事实和理由"]), parties(text)
    where = F.coalesce(asked, text)
    principal = first_match(where, [r"(?:借款本金|本金|货款|工程款|劳务报酬|拖欠工资)\s*(?:人民币)?\s*([0-9,，.]+)\s*元"])
    return {
        "applicant": first_of_role(found, ["申请人", "申请执行人"]), "respondent": first_of_role(found, ["被申请人", "被执行人"]), "basis_case_no": F.get(F.filter(case_numbers(text), lambda x: ~x.contains("执")), F.lit(0)),
        "request_details": numbered_items(asked), "requested_measures": request_types(asked), "execution_facts": section(text, ["事实与理由", "事实和理由"]), "requested_amount": claimed_sum(asked), "unfulfilled_principal": F.translate(principal, ",，", "").try_cast("double"),
        "unfulfilled_interest": first_match(where, [r"((?:逾期|法定|合同约定)?利息[^；;。\n]{0,120})"]), "delay_interest": first_match(where, [r"(迟延履行期间(?:加倍)?债务利息[^；;。\n]{0,120})"]), "application_date": signature_date(text)["date"],
    }


#: The fields of each kind of document, from its normalised text.
KINDS = {"civil_complaint": complaint, "summons": summons, "evidence_notice": evidence_notice, "jurisdiction_objection": objection, "preservation_application": preservation, "defense": defence, "appeal": appeal, "judgment": judgment, "procedural_ruling": ruling, "enforcement_application": enforcement}
