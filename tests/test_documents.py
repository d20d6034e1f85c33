"""The document operators: every query with SQL against DuckDB, and small fixtures for the rest."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quire.functions import geometry, text
from quire.operators import boxes, metrics, records, sequences
from quire.plans import queries
from quire.plans.registry import Registry
from quire.sources import labels

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows):
    return sorted(str([round(v, 9) if isinstance(v, float) else str(v) for v in r]) for r in rows)


@pytest.mark.parametrize("plan, name", [(p, n) for p in __spark_entry__.PLANS for n in sorted(p.SQL)], ids=lambda x: x if isinstance(x, str) else "")
def test_matches_sql(spark, sf_dir, plan, name):
    found = plan.QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(f"SELECT {', '.join(names)} FROM ({plan.SQL[name]})").fetchall()
    assert _plain(found.select(*names).collect()) == _plain(got)


def _one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_text_functions(spark):
    assert _one(spark, text.half_width(F.lit("ＡＢ１２　！"))) == "AB12 !"
    assert _one(spark, text.clean_value(F.lit("：甲  公司。 ,"))) == "甲 公司。"
    assert _one(spark, text.key_name(F.lit("地址：; "))) == "地址"
    assert _one(spark, text.spaced_words_joined(F.lit("a b   c d"))) == "ab cd"
    assert _one(spark, text.display_width(F.lit("中文ab1"))) == 4
    assert _one(spark, text.iso_date(F.lit("二〇二四年三月十五日"))) == "2024-03-15"
    assert _one(spark, text.iso_date(F.lit("2024年2月30日"))) is None
    assert [_one(spark, text.iso_date(F.lit(x))) for x in ("2024.3.5", "于 2024 年3月 5 日", "2024-3/5", "", "二〇二四年十三月一日")] == ["2024-03-05"] * 3 + [None] * 2
    assert _one(spark, text.match_key(F.lit(" V1.5！（甲）-Ｂ "))) == "v1.5！甲ｂ"
    assert _one(spark, text.compact(F.lit("（1）：甲\u3000乙；\nc"))) == "(1):甲乙;c"
    assert [_one(spark, text.ideographic_small(F.lit(x))) for x in ("十", "十五", "二十", "百", "7", "二三", "12345", "", "二三十", "十五六")] == [10, 15, 20, None, 7, 23, 12345, None, 10, 10]
    assert _one(spark, text.amounts(F.lit("共1,200.50元及30元"))) == [1200.5, 30.0]
    assert _one(spark, text.squeezed(F.lit("甲 乙  a  b\r\n\r\n\r\n\nc "))) == "甲乙 a b\n\nc"


def test_geometry(spark):
    square = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    assert abs(_one(spark, geometry.polygon_area(square))) == 4.0
    assert tuple(_one(spark, geometry.bounds(square))) == (0.0, 0.0, 2.0, 2.0)
    assert tuple(_one(spark, geometry.box_of_corners(F.array(*map(F.lit, (0, 0, 4, 0, 4, 2, 0, 2)))))) == (0, 0, 4, 2)


def test_suppression_and_cover(spark):
    rows = [(1, 1, 0, 0, 10, 10, 0.9, "a"), (1, 2, 1, 1, 11, 11, 0.8, "a"), (1, 3, 50, 50, 60, 60, 0.7, "a"), (1, 4, 2, 2, 6, 6, 0.6, "a")]
    found = spark.createDataFrame(rows, "page_id long, box_id long, x1 int, y1 int, x2 int, y2 int, score double, label string")
    assert {r.box_id for r in boxes.suppress(found).collect()} == {1, 3, 4}
    assert {r.box_id for r in boxes.outermost(found).collect()} == {1, 2, 3}
    assert boxes.suppress(found.limit(0)).count() == 0


def test_greedy_matches(spark):
    rows = [(1, 1, 0, 0, 10, 10, True), (1, 2, 0, 0, 10, 9, False), (1, 3, 0, 0, 10, 10, False), (2, 1, 0, 0, 5, 5, True)]
    found = spark.createDataFrame(rows, "page_id long, box_id long, x1 int, y1 int, x2 int, y2 int, truth boolean")
    assert sorted(map(tuple, metrics.greedy_matches(found, F.col("truth")).collect())) == [(1, 1, 1, 2), (2, 0, 1, 0)]


def test_sequences(spark):
    ids, scores = F.array(*map(F.lit, (0, 3, 3, 0, 3))), F.array(*map(F.lit, (0.1, 0.5, 0.9, 0.2, 0.7)))
    out = _one(spark, sequences.collapsed(ids, scores))
    assert list(out["ids"]) == [3, 3] and abs(out["score"] - 0.6) < 1e-9
    assert _one(spark, sequences.encoded(F.lit("bad"), "abcd", 6)) == [2, 1, 4, 0, 0, 0]
    assert _one(spark, sequences.encoded(F.lit("zz"), "abcd", 6)) is None
    assert _one(spark, sequences.encoded(F.lit("az"), "abcd", 6, first=2, begin=0, end=1, unknown=9)) == [0, 2, 9, 1, 0, 0]
    assert _one(spark, sequences.decoded(F.array(*map(F.lit, (2, 1, 9, 4))), "abcd", stop=9)) == "ba"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_whole_text_scores(spark, tmp_path):
    """Texts that agree in their first 64 characters and differ behind are told apart; chunks of ids lose no pair."""
    head = "the same beginning, " * 4
    texts = [head + "one end", head + "another é end", head + "another é end", "", None, "abc\n" * 40, "xabc\n" * 30, "é" * 70 + "b", "é" * 70 + "c"]
    rows = [(1000 * i, ("a", "b", None)[i % 5 % 3], t) for i, t in enumerate(texts * 3)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for source in ("a", "b", None):
        own = [t or "" for _, s, t in rows if s == source]
        pairs = list(zip(own, own[1:]))
        far = sum(_distance(a, b) / max(len(a), len(b), 1) for a, b in pairs)
        want[source] = (len(pairs), sum(a == b for a, b in pairs), round(1 - far / (len(pairs) + 1e-5), 6))
    found = queries.QUERIES["whole_text_scores"](spark, str(tmp_path)).collect()
    assert {r.source: (r.n, r.correct, r.similarity) for r in found} == want


def test_whole_texts_are_dealt_by_count(spark, sf_dir):
    """Pairs of texts are not left in the few tasks that their bytes make."""
    frame = type(spark.range(1))
    dealt, whole = [], frame.repartition
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(frame, "repartition", lambda df, n, *by: dealt.append(n) or whole(df, n, *by))
        queries.QUERIES["whole_text_scores"](spark, sf_dir)
    assert dealt and min(dealt) >= 4 * spark.sparkContext.defaultParallelism


def test_html(spark):
    assert _one(spark, records.html_tokens(F.lit('<table class="x"><tr><td rowspan="2">a</td></tr>'), True)) == ["<table>", "<tr>", '<td rowspan="2">', "</td>", "</tr>"]
    assert _one(spark, records.html_text(F.lit("<p>a &amp; b<p>a &amp; b<br><script>x</script>c"))) == "a & b\nc"
    tokens = F.array(*map(F.lit, ("<tr>", "<td>", "</td>", "<td></td>", "</tr>")))
    assert _one(spark, records.cell_html(tokens, F.array(F.lit("A"), F.lit("B")))) == "<tr><td>A</td><td>B</td></tr>"


def test_label_files(spark, tmp_path):
    (tmp_path / "Label.txt").write_text('a.jpg\t[{"transcription":"x","points":[[0,0],[1,0]]},{"transcription":"###","points":[]}]\nb.jpg\tnot json\n', encoding="utf8")
    rows = labels.detection_lines(spark, str(tmp_path / "Label.txt"))
    assert [(r.path, r.error is None) for r in rows.orderBy("path").collect()] == [("a.jpg", True), ("b.jpg", False)]
    assert [(r.nth, r.ignored) for r in labels.annotations(rows).orderBy("nth").collect()] == [(0, False), (1, True)]
    assert labels.crops(rows).first().crop == "crop_img/a_crop_0.jpg"


def test_registry(spark):
    steps = Registry()
    steps.add("keep", lambda df, least: df.where(F.col("id") >= least))
    assert steps.plan([{"keep": {"least": 2}}])(spark.range(4)).count() == 2
    with pytest.raises(KeyError):
        steps.plan([{"other": None}])


def test_lines_are_scored_as_they_are(spark):
    """Letters with accents and of other scripts count as themselves."""
    docs = spark.createDataFrame([(1, "a", "é\nЖж\nsame"), (2, "a", "e\nЖш\nsame")], "doc_id long, source string, text string")
    got = metrics.whole_text_recognition(queries.line_pairs(docs), "t", "next", "source").first()
    assert (got.n, got.correct) == (3, 1) and abs(got.similarity - 0.5) < 1e-4
