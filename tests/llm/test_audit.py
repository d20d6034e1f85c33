"""Filter audit, piece ids and hard negatives against plain versions: nulls, blanks, ties, repeats, hot groups."""

import hashlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quire.llm import filter_audit, hard_negatives, piece_codec, queries
from tests.llm.test_operators import TEXTS, docs, labels  # noqa: F401


def plain_masks(rows):
    """rows: [(id, text, part)]."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = Counter()
    for i, t, part in rows:
        t = t or ""
        w = t.encode().split()
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and first[t] < i)
        out[part or "", sum(1 << k for k, f in enumerate(fails) if f)] += 1
    return out


def masks_of(table):
    return {(r.part, r.mask): r.n for r in filter_audit.failures(table).groupBy("part", "mask").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}


def test_masks(docs):  # noqa: F811
    assert masks_of(docs) == plain_masks([(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_masks_over_many_tasks(spark):
    """A third of all rows are copies; ids repeat and are null; groups end and begin at the edges of tasks."""
    rng = np.random.default_rng(3)
    rows = [(int(i), "the same text" if i % 3 else f"text {i // 6}", "a") for i in rng.permutation(900)] + [(5, "the same text", "b")] * 40 + [(None, "the same text", None)] * 40 + [(7, f"text {i}", "b") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert masks_of(table) == plain_masks(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_masks_of_colliding_fingerprints(spark, monkeypatch):
    """With one fingerprint for all texts, texts are still told apart."""
    rows = [(i, f"text {i % 11}", "a") for i in range(400)]
    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *_: filter_audit.F.lit(1).cast("long"))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert masks_of(table) == plain_masks(rows)


def test_orders(docs, labels):  # noqa: F811
    """Every order applied step by step, and the SQL."""
    rows, said = [(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()]
    first = {}
    for i, t, _ in rows:
        first.setdefault(t or "", i)
    judged = [(p or "", next(m for (_, m) in plain_masks([(i, t, p)])) | (16 if first[t or ""] < i else 0), any(a == i and q == 1 for a, q, _ in said), any(a == i and x == 1 for a, _, x in said)) for i, t, p in rows]
    want, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            left = [j for j in judged if j[0] == part]
            gone = []
            for k, x in enumerate(order):
                bit = 1 << "ABCDE".index(x)
                now = [j for j in left if j[1] & bit]
                want[part, "".join(order), k + 1] = (len(left) - len(now), len(now), sum(bool(j[1] & bit) for j in gone), sum(j[1] == bit for j in judged if j[0] == part), sum(j[2] for j in now), sum(j[3] for j in now))
                shapley[part, x] += len(now)
                left, gone = [j for j in left if not j[1] & bit], gone + now
    out = filter_audit.digest(docs, labels)
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out.collect()}
    assert found == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas().astype("Int64"))
    names = sorted(out.columns)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op11_filter_audit']})").fetchall())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_codec.model_path())


ODD_TEXTS = ["", " ", "  ", "\n", "\n\n a", " \n", "▁", "a▁ b", "a ▁b", "\nfoo bar\tx", "</s><s> <0x0A>", "\x00a \x00", "日本 語　x", "{\r\n  }", "🙂 é", "a" * 3000, "end ", "12 345", "don't\n\n\nstop", "﻿x"]


def test_piece_ids_are_the_librarys(spark, library):
    texts = [*TEXTS, *ODD_TEXTS]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    for r in piece_codec.decode(piece_codec.encode(table), "ids_").collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r.ids_), "<u4").tolist() == ids and r.decoded_ == library.decode(ids) and (r.ids, r.decoded, r.text) == (1, "x", texts[r.doc_id])
    for r in piece_codec.digest(table).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_codec.digest(table.limit(0)).count() == 0
    assert piece_codec.decode(spark.createDataFrame([(None,)], "ids binary")).first().decoded is None


def test_piece_ids_of_random_texts(library):
    rng = np.random.default_rng(1)
    parts = [" ", "  ", "\n", "\t", "\r", "▁", "a", "the", "é", "日本", "\x00", "12", "don't", "{\r", "🙂", "</s>", ";", "\n\n", "’"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(4000)]
    codec = piece_codec.Codec(piece_codec.model_path())
    ids, at = codec.encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert codec.cuts
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode(t, add_bos=True, add_eos=True), t


def test_words_are_segmented_once(monkeypatch):
    codec = piece_codec.Codec(piece_codec.model_path())
    given = []

    class Counting:
        def encode(self, words, **how):
            given.extend(words)
            return real.encode(words, **how)

    real, codec.library = codec.library, Counting()
    for _ in range(3):
        codec.encode(pa.array([b"one two one\nthree", b"two one", b"one"], pa.binary()))
    assert sorted(given) == ["\nthree", "one", "two"]


def plain_mine(rows, anchor, positives=5, negatives=10):
    """rows: [(id, label, ints)], distinct."""
    product = lambda a, b: max(-hard_negatives.LONG, min(hard_negatives.LONG, sum(x * y for x, y in zip(a, b, strict=False))))
    out = []
    for k, (i, label, v) in enumerate(rows):
        if not anchor(i):
            continue
        scored = sorted((-product(v, w), j, m) for n, (j, m, w) in enumerate(rows) if n != k)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [(n, x) for n, x, m in scored if m != label and 30 * -p <= 100 * -n <= 90 * -p][:negatives]
            out += [(i, j, r + 1, x, -p, -n) for r, (n, x) in enumerate(fit)]
    return sorted(out)


def _clusters(seed, n, dim, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(6)] + 0.4 * rng.standard_normal(dim)).tolist()) for i in range(n)]


def _mined(spark, rows, anchor):
    table = spark.createDataFrame(rows, "id long, label long, v array<double>")
    return sorted(map(tuple, hard_negatives.mine(table, anchor).collect()))


def _plain(rows, anchor):
    ints = {(i, m, tuple(hard_negatives.ints_of(np.array(v, float), 256))) for i, m, v in rows}
    return plain_mine(sorted(ints), anchor)


def test_hard_negatives(spark, monkeypatch):
    """Small annuli, so that rounds and bounds matter."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "PIVOTS", 5)
    rows = _clusters(0, 700, 6)
    assert _mined(spark, rows, lambda i: i % 50 == 0) == _plain(rows, lambda i: i % 50 == 0)


def test_hard_negatives_with_copies_and_odd_rows(spark, monkeypatch):
    """Equal vectors under many ids, anchors among them; equal rows; repeated ids; rare labels; other lengths; huge and tiny components."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    rows = _clusters(1, 200, 4)
    rows += [(1000 + i, i % 2, [1.0, 0.5, 0.0, 0.25]) for i in range(150)] + [(1000, 0, [1.0, 0.5, 0.0, 0.25])] * 3
    rows += [(50, 1, [0.5, 0.5, 0.5, 0.5]), (50, 1, [0.25, 0.5, 0.5, 0.5]), (2000, 9, [1.0] * 4), (2050, 8, [0.0] * 4), (2051, 8, [0.0] * 4)]
    rows += [(2100, 1, [1e200, 0.0, 0.0, 1.0]), (2101, 1, [3e5, 1e-300, -0.0, 4e5]), (2150, 0, [1.0, 2.0]), (2151, 0, [2.0, 2.0]), (2152, 0, []), (2200, 2, [1e6] * 4), (2201, 2, [-1e308] * 4), (2202, 0, [5e5] * 4)]
    assert _mined(spark, rows, lambda i: i % 50 == 0) == _plain(rows, lambda i: i % 50 == 0)


def test_hard_negatives_of_unsound_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (100, None, [1.0, 2.0]), (1, 1, None), (2, 1, [1.0, None]), (3, 1, [float("nan"), 1.0]), (4, 1, [float("inf"), 1.0]), (None, 1, [1.0, 1.0]), (5, 1, [1.0, 1.0]), (6, 2, [0.5, 0.5]), (7, 3, [0.5, 0.25])]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "'x' AS key")
    assert [tuple(r)[:4] for r in hard_negatives.digest(table).orderBy("rank").collect()] == [(0, 6, 1, 7)]  # 0 has the next label
    assert hard_negatives.digest(table.limit(0)).count() == 0
    assert hard_negatives.digest(table.where("vec_id <> 0")).count() == 0


def test_hard_negatives_visit_few_annuli(spark, monkeypatch):
    """Far clusters are not met: what annuli are asked stays far below all of them for each query."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 10)
    met = []
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (100 * np.eye(20)[i % 20] + rng.random(20)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "id long, label long, v array<double>")
    plans = hard_negatives._plan

    def counted(*args):
        out = plans(*args)
        met.append(out.where("annulus IS NOT NULL").count())
        return out

    monkeypatch.setattr(hard_negatives, "_plan", counted)
    assert sorted(map(tuple, hard_negatives.mine(table, lambda i: i == 40).collect())) == _plain(rows, lambda i: i == 40)
    assert 0 < sum(met) < 150  # of 200 annuli for the positives and 200 for each of five windows


def test_shares_do_not_overflow(spark):
    got = spark.range(1).select(hard_negatives.share_of(hard_negatives.F.lit(hard_negatives.LONG), 90, False).alias("a"), hard_negatives.share_of(hard_negatives.F.lit(7).cast("long"), 30, True).alias("b"), hard_negatives.share_of(hard_negatives.F.lit(0).cast("long"), 30, True).alias("c")).first()
    assert tuple(got) == (90 * hard_negatives.LONG // 100, 3, 0)


def test_sql_of_hard_negatives(spark):
    rows = _clusters(4, 300, 8, 10)
    table = spark.createDataFrame([(i, m, v) for i, m, v in rows], "vec_id long, label int, embedding array<float>")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, label INTEGER, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    out = hard_negatives.digest(table)
    names = sorted(out.columns)
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op13_hard_negatives']})").fetchall())

