"""Fields of court documents, small rules, heads and samples: nulls, blanks, ties and the rules' corners."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import alphabets, forms, notices, phrases
from quire.functions.text import squeezed
from quire.operators import matching, polygons, sequences
from quire.streaming.scores import running_accuracy


def _of(spark, value, use):
    rows = spark.createDataFrame([(value,)], "text string").select(squeezed(F.col("text")).alias("text"))
    return rows.select(use(F.col("text")).alias("x")).first()["x"]


@pytest.mark.parametrize("blank", [None, "", " \n "])
def test_blank_texts_have_no_fields(spark, blank):
    assert _of(spark, blank, notices.case_numbers) == [] and _of(spark, blank, notices.courts) == [] and _of(spark, blank, notices.laws) == []
    assert _of(spark, blank, notices.cause) is None and _of(spark, blank, notices.signature_date) is None and _of(spark, blank, notices.first_fee) is None
    assert _of(spark, blank, lambda t: notices.section(t, ["诉讼请求"])) is None and _of(spark, blank, notices.parties) == []
    assert _of(spark, blank, notices.jurisdiction) is None and _of(spark, blank, notices.guarantee) is None
    assert tuple(_of(spark, blank, notices.document_type)) == ("unknown", 0.25)


def test_case_numbers_and_stages(spark):
    text = "(2023) 京01民终 12 号，原审（2022）京0105民初1号，又（2023）京01民终12号"
    assert _of(spark, text, notices.case_numbers) == ["（2023） 京01民终 12号", "（2022）京0105民初1号", "（2023）京01民终12号"]
    kind = F.lit("judgment")
    stage = lambda t, k=kind: _of(spark, t, lambda x: notices.stage(x, k))
    assert stage(text) == "second_instance"
    assert stage("（2023）京01民再1号 适用第二审程序") == "retrial_second_instance"
    assert stage("（2023）京01民再1号 原审（2020）京01民终2号") == "retrial_second_instance"
    assert stage("（2023）京01民再1号 原审（2020）京01民初2号") == "retrial_first_instance"
    assert stage("（2023）京01执恢1号") == "unknown" and stage("（2023）京01民申1号") == "unknown"
    assert stage("被上诉人", F.lit("other")) == "second_instance" and stage("再审 提审", F.lit("other")) == "retrial_second_instance"
    assert stage("上诉人", F.lit("appeal")) == "first_instance" and stage("x", F.lit("summons")) == "first_instance" and stage("x", F.lit("other")) == "unknown"


def test_sections_stop_at_headings_and_marks(spark):
    text = "一、诉讼请求\n甲\n乙\n事实与理由：丙\n此致\n北京市海淀区人民法院"
    assert _of(spark, text, lambda t: notices.section(t, ["诉讼请求"])) == "甲\n乙"
    assert _of(spark, text, lambda t: notices.section(t, ["事实与理由", "事实和理由"])) == "丙"
    assert _of(spark, text, lambda t: notices.section(t, ["担保方式"])) is None
    assert _of(spark, text, lambda t: notices.court(t, F.lit("appeal"))) == "北京市海淀区人民法院"


def test_parties_are_kept_once(spark):
    text = "申请人：周凯，男，汉族，1980年1月2日出生，住上海市。\n被申请人（原审原告）：乙公司\n申请事项\n略\n申请人：周凯"
    found = _of(spark, text, notices.parties)
    assert [(p.role, p.name, p.subject_type, p.gender, p.birth_date, p.current_role_detail) for p in found] == [("申请人", "周凯", "person", "男", "1980-01-02", None), ("被申请人", "乙公司", "organization", None, None, "原审原告")]


def test_kinds_have_fields(spark):
    """Every kind's fields can be read off one text, and off an empty one."""
    rows = spark.createDataFrame([("民事答辩状\n答辩意见\n不同意支付 5 元\n举证材料\n1.甲\n2.乙\n答辩请求\n驳回",), ("",), (None,)], "text string")
    out = rows.select(*[c.alias(n) for n, c in notices.KINDS["defense"](F.col("text")).items()]).collect()
    assert out[0].defense_opinion == "不同意支付 5 元\n答辩请求\n驳回" and out[0].defense_evidence == ["1.甲", "2.乙"] and out[0].claim_amount.total == 5.0
    assert out[1].defense_opinion is None and out[2].defense_opinion is None
    ruling = spark.createDataFrame([("民事裁定书\n裁定如下：\n本案转为适用普通程序。\n审判员 甲\n二〇二四年三月五日",)], "text string").select(*[c.alias(n) for n, c in notices.KINDS["procedural_ruling"](F.col("text")).items()]).first()
    assert ruling.ruling_result == ["本案转为适用普通程序。"] and ruling.ruling_date == "2024-03-05"
    appeal = spark.createDataFrame([("上诉人（原审被告）：甲\n上诉请求\n撤销判决，改判\n上诉理由\n不服北京市海淀区人民法院作出民事判决，依《民法典》第十条。",)], "text string").select(*[c.alias(n) for n, c in notices.KINDS["appeal"](F.col("text")).items()]).first()
    assert (appeal.original_role, appeal.first_instance_court, appeal.main_request_type, appeal.laws) == ("原审被告", "北京市海淀区人民法院", ["撤销", "改判"], ["《民法典》", "第十条"])
    notice = spark.createDataFrame([("举证通知书\n（2024）京0105民初1号\n甲公司：\n应当提交借条等证据。逾期举证的，承担不利后果。收到本通知书之日起十五日内。",)], "text string").select(*[c.alias(n) for n, c in notices.KINDS["evidence_notice"](F.col("text")).items()]).first()
    assert (notice.notice_target, notice.relative_deadline.days, notice.recommended_evidence) == ("甲公司", 15, "借条等证据")


def test_items_in_brackets(spark):
    assert _of(spark, "（1）、甲\n（2）、乙", forms.numbered_items) == ["(1)、甲", "(2)、乙"]
    assert _of(spark, None, forms.numbered_items) == []


def test_phrases(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(phrases.mirrored(F.lit("אב ab-1 ג"))) == "ג ab-1 בא"
    assert one(phrases.shared_bold(F.array(F.lit("<b>a</b>"), F.lit("<b>b</b>")))) == "<b>a b</b>" and one(phrases.shared_bold(F.array(F.lit("<b>a</b>"), F.lit("b")))) == "<b>a</b> b"
    assert one(phrases.bare_key(F.lit(" 地 址(a)：: "))) == "地址a" and one(phrases.safe_name(F.lit("/x/a b（c).txt"))) == "a_b_c_.txt"
    assert one(phrases.is_fragment(F.lit(None).cast("string"))) is False and one(phrases.as_boolean(F.lit(None).cast("string"))) is False
    assert one(phrases.asks_for_action(F.lit("判 令 被告"))) is True and one(phrases.confidence_level(F.lit("x"), F.lit("direct"), F.lit(0.8))) == "review_required"


def test_heads_round_trip(spark):
    """What a scheme writes, the reading of its head reads back; blanks, long and unknown texts are refused."""
    rows = spark.createDataFrame([("abc 12",), ("",), (None,), ("x" * 40,), ("###",)], "t string")
    for name, scheme in alphabets.SCHEMES.items():
        got = [r[0] for r in rows.select(alphabets.encode(F.col("t"), scheme, 10)).collect()]
        assert got[0] is not None and got[1] is None and got[2] is None, name
        assert (got[3] is None) == (name != "satrn") and (got[4] is None) == (name not in ("satrn", "pren")), name
        if name in ("attention", "seed", "srn", "pren", "vitstr", "spin"):
            ids = F.array(*map(F.lit, got[0].ids))
            text = spark.range(1).select(alphabets.decode(ids, F.transform(ids, lambda i: F.lit(1.0)), alphabets.READINGS[name])["text"]).first()[0]
            assert text == "abc12", name


def test_samples_of_any_source(spark):
    rows = spark.createDataFrame([(i, ("a", "b", None)[min(2, i % 7)]) for i in range(700)], "id long, source string")
    n = Counter(r.source for r in rows.collect())
    got = Counter(r.source for r in sequences.sampled(rows, "source", "id", 0.3, 1).collect())
    assert got == {s: round(k * 0.3) for s, k in n.items()}
    parts = Counter(r.part for r in sequences.split(rows.where("source = 'a'"), "source", "id", (6, 2, 2), 1).collect())
    assert parts == {"train": 60, "val": 20, "test": 20}
    assert sequences.sampled(rows.limit(0), "source", "id", 0.3, 1).count() == 0


def test_box_rules(spark):
    schema = "page_id long, box_id long, x1 int, y1 int, x2 int, y2 int"
    found = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 50, 50, 60, 60), (2, 1, 0, 0, 4, 4)], schema)
    cells = spark.createDataFrame([(1, 7, 0, 0, 10, 10), (1, 8, 0, 0, 10, 10), (3, 1, 0, 0, 1, 1)], schema)
    assert sorted(map(tuple, matching.overlap_rule(found, cells).collect())) == [(1, 1, 7, 1.0)]
    assert sorted(map(tuple, matching.distance_rule(found, cells).collect())) == [(1, 7, 1, 0.0), (1, 8, 1, 0.0)]
    assert sorted(map(tuple, matching.virtual_cells(found.select("page_id", "box_id"), cells).collect())) == [(1, 1, 2), (1, 2, 3), (2, 1, 0)]
    assert matching.overlap_rule(found.limit(0), cells).count() == 0


def test_polygons(spark):
    square, turned = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(1, -1), (3, 1), (1, 3), (-1, 1)], float)
    assert polygons.common_area(square, turned) == pytest.approx(4.0) and polygons.common_area(square, square[::-1]) == pytest.approx(4.0)
    assert polygons.common_area(square, square + 1) == pytest.approx(1.0) and polygons.overlap(square, square + 5) == 0.0 and polygons.overlap(square, square + 2) == 0.0
    shapes = [square, square + 0.5, square + 1.5, square + 9]
    places, scores = polygons.soft(shapes, np.array([0.9, 0.8, 0.7, 0.6]), 0.1)
    left, plain = {i: s for i, s in enumerate((0.9, 0.8, 0.7, 0.6))}, []
    while left:
        best = max(left, key=left.get)
        plain.append((best, left.pop(best)))
        for i in list(left):
            left[i] *= math.exp(-(polygons.overlap(shapes[best], shapes[i]) ** 2) / 0.5)
            if left[i] < 0.1:
                del left[i]
    assert list(zip(places, scores, strict=True)) == [(i, pytest.approx(s)) for i, s in plain]
    rows = [(1, i, s.reshape(-1).tolist(), 0.9 - i / 10) for i, s in enumerate(shapes)]
    table = spark.createDataFrame(rows, "page_id long, box_id long, polygon array<double>, score double")
    assert sorted(r.box_id for r in polygons.suppressed(table, 0.3).collect()) == [0, 2, 3]
    assert polygons.softened(table.limit(0)).count() == 0 and polygons.merged_and_suppressed(table.limit(0)).count() == 0
    whole, weight = polygons.merged(shapes, np.array([1.0, 1.0, 1.0, 1.0]), 0.3)
    assert len(whole) == 3 and weight.tolist() == [2.0, 1.0, 1.0] and whole[0][0].tolist() == [0.25, 0.25]


def test_running_accuracy(spark, tmp_path):
    """Files of a stream add up, epoch by epoch."""
    schema = "epoch long, p int, t int"
    for k, rows in enumerate(([(1, 1, 1), (1, 0, 1)], [(1, 1, 1), (2, 0, 0)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    running = running_accuracy(stream, "p", "t", "epoch", "accuracy_so_far", f"{tmp_path}/state")
    running.processAllAvailable()
    running.stop()
    assert sorted((r.epoch, r.correct, r.n) for r in spark.table("accuracy_so_far").collect()) == [(1, 2, 3), (2, 1, 1)]


def test_many_dear_rows_are_many_tasks(spark, tmp_path, monkeypatch):
    """The number of tasks follows the rows, so that none grows with the table."""
    from quire.plans import registry

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    monkeypatch.setattr(registry, "TASK_ROWS", 50, raising=False)
    found = registry.spread(spark.read.parquet(str(tmp_path / "t.parquet")))
    assert found.rdd.getNumPartitions() == 20
    assert max(found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 100


def test_values_read_often_are_computed_once():
    """What stands in a text is asked of one value, not of its expression again and again."""
    of = F.concat(F.col("a"), F.lit("only here"))
    assert str(notices.jurisdiction(of)).count("only here") == 1
    assert str(notices.request_types(of)).count("only here") == 1
