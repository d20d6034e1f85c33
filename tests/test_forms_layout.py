"""Forms, reading order, linked boxes and table similarity on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import forms
from quire.operators import layout, sequences, tables
from quire.plans import queries


def _each(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r["x"] for r in rows.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_key_values(spark):
    rows = [("地址：A", ""), ("name:", ""), ("k", "v"), ("a;b", "c"), ("：x", ""), (" ", "v"), (None, None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l string, r string")
    found = [r["x"] and tuple(r["x"]) for r in table.select("i", forms.key_value(F.col("l"), F.col("r")).alias("x")).orderBy("i").collect()]
    assert found == [("地址", "A"), ("name", ""), ("k", "v"), ("a;b", "c"), None, None, None]


def test_times_and_deadlines(spark):
    times = ["2024年3月5日下午3时20分", "2024-03-05", "2024年3月5日上午12:05", "开庭 ", "", None]
    assert _each(spark, forms.iso_datetime, times) == ["2024-03-05T15:20:00", "2024-03-05", "2024-03-05T00:05:00", "开庭", None, None]
    due = _each(spark, forms.relative_deadline, ["自收到本通知书之日起15日内", "判决生效之日起十日", "签收后三日", "送达之日起百日", "无", None])
    assert [d and (d.trigger, d.days) for d in due] == [("receipt_date", 15), ("judgment_effective_date", 10), ("receipt_date", 3), ("service_date", None), None, None]


def test_items_and_sums(spark):
    assert _each(spark, forms.numbered_items, ["1、甲\n2、乙", "一、甲 二、乙", "甲", "", None]) == [["1、甲", "2、乙"], ["一、甲", "二、乙"], ["甲"], [], []]
    sums = _each(spark, forms.claimed_sum, ["支付1,000元及20.5元", "支付5元,暂计", "无", None])
    assert [s and tuple(s) for s in sums] == [(1020.5, 2, False), (5.0, 1, True), None, None]


@pytest.mark.parametrize(("step", "stays"), [(10, False), (20, True)])
def test_reading_order(spark, step, stays):
    """Against adjacent swaps written out."""
    chance = random.Random(4)
    rows = [(page, k, chance.randrange(60), chance.randrange(60)) for page in range(12) for k in range(page + 1)]
    found = layout.reading_order(spark.createDataFrame(rows, "page_id long, box_id long, x1 int, y1 int"), step, stays)
    got = {(r.page_id, r.nth): r.box_id for r in found.collect()}
    for page in range(12):
        order = []
        for y, x, k in sorted((y, x, k) for p, k, x, y in rows if p == page):
            at = len(order)
            while at > (1 if stays else 0) and abs(y - order[at - 1][0]) < step and x < order[at - 1][1]:
                at -= 1
            order.insert(at, (y, x, k))
        assert [got[page, i] for i in range(len(order))] == [k for _, _, k in order]


def test_linked_groups(spark):
    edges = spark.createDataFrame([(1, 1, 2), (1, 3, 4), (1, 4, 2), (1, 4, 2), (1, 8, 9), (2, 5, 5)], "page_id long, a long, b long")
    assert {tuple(r) for r in layout.linked_groups(edges).collect()} == {(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1), (1, 8, 8), (1, 9, 8), (2, 5, 5)}
    assert layout.linked_groups(edges.limit(0)).count() == 0


def _page(inner):
    return f"<html><body><table>{inner}</table></body></html>"


def test_table_similarity(spark):
    one = _page("<tr><td>ab</td><td>c</td></tr>")
    pairs = [
        (one, one, 1.0), ("", one, 0.0), (None, one, 0.0), ("<p>x</p>", one, 0.0), (_page("<tr><td>ab</td></tr>"), one, 1 - 1 / 3), (_page("<tr><td>ax</td><td>c</td></tr>"), one, 1 - 0.5 / 3),
        (_page('<tr><td colspan="2">ab</td></tr>'), one, 1 - 2 / 3), (_page("<tr><td><b>a</b></td></tr>"), _page("<tr><td>a</td></tr>"), 1 - (2 / 3) / 3), ("<table><tr><td>a</td></tr></table>", one, 0.0),
    ]
    rows = spark.createDataFrame(pairs, "p string, t string, want double")
    for r in rows.select("*", tables.table_similarity(F.col("p"), F.col("t")).alias("got")).collect():
        assert r.got == pytest.approx(r.want), r.p
    bare = rows.select(tables.table_similarity(F.col("p"), F.col("t"), texts=False).alias("x")).collect()
    assert bare[5].x == 1.0


def test_table_rows_and_size(spark):
    html = '<table><tr><th colspan="2">H</th></tr><tr><td>a</td><td> b <b>c</b></td><td></td></tr><tr><td> </td></tr></table>'
    assert _each(spark, tables.table_rows, [html, "none", None]) == [["H", "a | b c | "], [], None]
    assert [tuple(x) for x in _each(spark, tables.table_size, [html, "none"])] == [(3, 3), (0, 0)]


def test_key_values_are_read_once(spark, sf_dir):
    """The cut of a line stands once in the plan, and odd lines come out as the patterns had them."""
    plan = queries.QUERIES["key_values"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1
    rows = [("a:b",), (":b",), ("a:",), ("a: ; ",), (" k：v；w ",), ("k\u00a0; ",), ("",), ("a\n:b\nc",), (";;",), ("a:\n",), ("😀:x",)]
    head, tail = (F.regexp_extract(F.trim("t"), r"(?s)\A([^:：;；]*)[:：;；](.+)\z", k) for k in (1, 2))
    key, value = F.when(tail != "", head).otherwise(F.trim("t")), F.when(tail != "", F.trim(tail)).otherwise("")
    key = F.regexp_replace(F.trim(key), r"[:：;；\s]+\z", "")
    table = spark.createDataFrame(rows, "t string").select("t", F.when(key != "", F.struct(key.alias("key"), value.alias("value"))).alias("want"), forms.key_value(F.col("t"), F.lit("")).alias("got"))
    assert table.where("not want <=> got").collect() == []


def test_batches_are_spread(spark):
    """One label's rows are numbered in several ranges; a null label is one of its own."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40) / 8) for i in range(700)]
    made = sequences.batched(spark.createDataFrame(rows, "id int, label string, ratio double"), ["ratio", "id"], 6, "ratio", "label")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "q_range" in plan
    got = {r.id: (r.batch, r.mean_ratio) for r in made.collect()}
    for label in ("a", "b", None):
        own = sorted((v, i) for i, kind, v in rows if kind == label)
        for k, (_, i) in enumerate(own):
            batch = [v for v, _ in own[k // 6 * 6 : k // 6 * 6 + 6]]
            assert got[i] == (k // 6, pytest.approx(sum(batch) / len(batch)))


def test_corners_come_without_sorting(spark):
    """The least and largest are looked for, as sorting would give them: ties go by place, missing points stay."""
    import random

    from quire.functions import structures

    rng = random.Random(15)
    rows = [[[rng.randint(0, 2), rng.randint(0, 2)] for _ in range(4)] for _ in range(60)] + [[[0, 0], [1, 1]], None, []]
    order = structures.clockwise(F.col("p"))
    assert "sort" not in str(order)
    table = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, p array<array<int>>")
    for r in table.select("i", order.alias("q")).collect():
        if len(rows[r.i] or []) != 4:
            assert r.q is None
            continue
        ranked = list(enumerate(rows[r.i]))
        near, far = min(ranked, key=lambda k: sum(k[1])), max(ranked, key=lambda k: (sum(k[1]), -k[0]))
        rest = [k for k in ranked if k[0] not in (near[0], far[0])]
        up = min(rest, key=lambda k: (k[1][1] - k[1][0], k[0]))
        down = min(rest, key=lambda k: (k[1][0] - k[1][1], k[0]))
        assert r.q == [near[1], up[1], far[1], down[1]]
