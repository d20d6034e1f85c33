"""Form alignment against a plain version over random forms; matching blocks against the standard library's."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.functions import alignment
from quire.operators import form_alignment
from quire.operators.form_alignment import FORM_KEYS

KEYS = list(FORM_KEYS)


def test_matching_blocks(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abc", k=rng.randint(0, 8)))) for _ in range(800)] + [("收件人地扯号", "收件人地址"), ("", ""), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", alignment.block_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert len(got) == len(pairs) and all(abs(r.s - SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in got)


def bare(t):
    t = re.sub(r"\s+", "", t).replace(":", "：").rstrip("：")
    return re.sub(r"[*\-_．.#@、，,（）()]", "", t)


def like(raw, key):
    a, b = bare(raw), bare(key)
    if not a or not b:
        return 0.0
    return min(1.0, SequenceMatcher(None, a, b).ratio() + (0.25 if b in a else 0.1 if a in b else 0))


def best(raw, keys):
    scores = [like(raw, k) for k in keys]
    return (scores.index(max(scores)), max(scores)) if scores else (None, -1.0)


def fragment(t):
    return t in ("号", "室", "楼", "层", "行", "司", "公司", "支行", "分行", "省", "市", "区", "县", "镇") or bool(re.fullmatch(r"[a-zA-Z0-9]+|\d+[号室楼层区]", t))


def completes(value, prefix):
    return (value + prefix).endswith(("支行", "分行", "银行", "公司", "号", "室", "楼", "层", "省", "市", "区", "县", "镇")) or prefix in ("行", "司", "号", "室", "楼", "层", "省", "市", "区")


def plain(rows):
    """rows: [(raw, value)] in order; the form's record."""
    short = [k for k in KEYS if k != "收件人地址"]
    seen = {k: any(like(r, k) >= 0.7 for r, _ in rows) for k in ("收件人地址", "收件人电子邮箱", "收件人电话")}
    full, less = sum(best(r, KEYS)[1] for r, _ in rows), sum(best(r, short)[1] for r, _ in rows)
    if seen["收件人地址"]:
        full += 5
    elif seen["收件人电子邮箱"] and seen["收件人电话"]:
        less += 2
    keys, at, places = (KEYS if full >= less else short), 0, []
    for raw, _ in rows:
        i, s = best(raw, keys[at:])
        i = i + at if s >= 0.55 else (best(raw, keys)[0] if best(raw, keys)[1] >= 0.55 else None)
        places.append(i)
        at = at if i is None else i + 1
    names, values = [r for r, _ in rows], [v for _, v in rows]
    for n, (raw, _) in enumerate(rows):
        if places[n] is None:
            continue
        expected = keys[places[n]]
        names[n] = expected
        cut = re.search("[:：]", raw)
        if cut:
            head, tail = raw[: cut.start()].strip(), raw[cut.end() :].strip()
            if 1 <= len(tail) <= 4 and fragment(tail) and not re.search("[:：]", tail) and best(head, keys)[1] >= 0.55:
                values[n] += tail
                continue
        parts = re.split(r"\s+", raw.strip(), maxsplit=1)
        if n and len(parts) == 2 and 0 < len(parts[0]) <= 4 and like(parts[1], expected) >= 0.65 and completes(values[n - 1], parts[0]):
            values[n - 1] += parts[0]
    out = {}
    for k, v in zip(names, values, strict=True):
        k = re.sub(r"[:：;；\s]+$", "", k.strip())
        if k and not out.get(k):
            out[k] = v if k not in out or v else out[k]
    return out


def noisy(rng):
    rows = []
    for k in KEYS:
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
            raw = rng.choice([k, k + "：", f"{k}：{rng.choice(['号', 'A1', '支行', '号楼室', '：', 'abcde', '3楼'])}", f"{rng.choice(['行', '公司', '号', 'x', '市'])} {k}：", f"　{k}", k[: rng.randint(0, len(k))], k.replace("人", "入"), "备注", "", f"（{k}）", "".join(rng.sample(k, len(k))), f"{k} {k}"])
            rows.append((raw, rng.choice(["", "中国工商银", "北京市", "王五13800000000", "甲公", "x"])))
    if rng.random() < 0.2:
        rng.shuffle(rows)
    return rows


def test_random_forms(spark):
    rng = random.Random(7)
    forms = {f: noisy(rng) for f in range(250)}
    table = spark.createDataFrame([(f, n, r, v) for f, rows in forms.items() for n, (r, v) in enumerate(rows)], "form int, nth int, raw string, value string").repartition(3)
    got = {}
    for r in form_alignment.aligned(table, "form", "nth", "raw", "value").orderBy("form", "nth").collect():
        got.setdefault(r.form, {})[r.key] = r.value
    for f, rows in forms.items():
        assert got.get(f, {}) == plain(rows), rows


def test_blank_forms(spark):
    table = spark.createDataFrame([(1, 0, None, None), (1, 1, "", "x"), (2, 0, "地址:", None), (None, 0, "电话", "1")], "form int, nth int, raw string, value string")
    got = sorted(map(str, form_alignment.aligned(table, "form", "nth", "raw", "value").collect()))
    assert got == sorted(["Row(form=2, nth=0, key='地址', value='')", "Row(form=None, nth=0, key='电话', value='1')"])
    assert form_alignment.aligned(table.limit(0), "form", "nth", "raw", "value").count() == 0


@pytest.mark.parametrize("name, phone, want", [("王五13800000000", None, {"收件人姓名": "王五", "收件人电话": "13800000000"}), ("王五138-0000（01）", "", {"收件人姓名": "王五", "收件人电话": "138-0000（01）"}), ("王五13800000000", "9", {"收件人姓名": "王五13800000000", "收件人电话": "9"}), ("王五123456", None, {"收件人姓名": "王五123456"}), ("", None, {"收件人姓名": ""})])
def test_phones(spark, name, phone, want):
    rows = [(1, 0, "收件人姓名", name)] + ([(1, 1, "收件人电话", phone)] if phone is not None else [])
    table = spark.createDataFrame(rows, "form int, nth int, key string, value string")
    assert {r.key: r.value for r in form_alignment.phones_split_off(table, "form").collect()} == want
