"""The ways for heavy keys, crowded anchors and many cells give the same rows; packing, columns of any name, the whole pipeline."""

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import ann, common, line_dedup, near_dup, packing, quality, queries, substring_dedup
from tests.llm import brute
from tests.llm.test_operators import SCHEMA, TEXTS


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, ("b", "a", None)[i % 3], None, 7, 7, "x") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture
def all_heavy(monkeypatch):
    """Every key that more than one row holds counts as heavy."""
    monkeypatch.setattr(common, "HEAVY_SHARE", 1 << 40)
    monkeypatch.setattr(common.spread_join, "__defaults__", (1,))


def test_spread_join_is_a_join(spark):
    rows = spark.createDataFrame([(k % 7, i) for i, k in enumerate(range(100))] + [(99, 1000)], "k long, i long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("m")).where("k <> 3")
    plain = sorted(map(tuple, rows.join(table, ["k"]).select("k", "i", "n", "m").collect()))
    for least in (0, 1, 14, 1000):
        assert sorted(map(tuple, common.spread_join(rows, table, ["k"], "n", least).select("k", "i", "n", "m").collect())) == plain
    assert common.spread_join(rows, table.limit(0), ["k"], "n").count() == 0


def test_heavy_lines(docs, all_heavy):
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "int64"}))
    found = line_dedup.digest(docs)
    names = sorted(found.columns)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({queries.SQL['op5_lines']})").fetchall())


def test_heavy_coordinates(docs, all_heavy):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.digest(docs).collect()}
    assert found == brute.near(list(enumerate(TEXTS)))


def _notices():
    """A passage of 55 words in many documents with different surroundings, parts of it, and two that meet end to end."""
    passage = [f"n{i}" for i in range(55)]
    rows = [(i, " ".join([*[f"a{i}x{k}" for k in range(30)], *passage, *[f"b{i}x{k}" for k in range(30)]])) for i in range(12)]
    other = [f"m{i}" for i in range(60)]
    return [*rows, (20, " ".join([*passage[:49], "x"])), (21, " ".join(other)), (22, " ".join([*passage, *other])), (23, " ".join(passage[3:53])), (24, "w " * 300), (25, "w " * 280), (25, " ".join(passage)), (None, " ".join(passage))]


@pytest.mark.parametrize("crowd", [512, 1])
def test_passages(spark, crowd, all_heavy):
    rows = _notices()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.with_factors(docs, substring_dedup.duplicate_factors(docs, crowd=crowd)).select("id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute.substrings(rows)))


def test_factors_grow_to_their_longest():
    """A factor goes on as far as the reference does, and the search from the first window that reaches beyond it."""
    reference = substring_dedup.Reference(3)
    one, two = b"a b c d e f".split(), b"e f g h".split()
    hashes = lambda w: [hash(tuple(w[i : i + 3])) for i in range(len(w) - 2)]
    reference.add(one, hashes(one))
    reference.add(two, hashes(two))
    target = b"x b c d e f g h y".split()
    assert reference.factors(target, hashes(target)) == [(1, 5), (4, 4)]
    assert reference.factors(b"a b x".split(), hashes(b"a b x".split())) == []


def test_nearest_in_many_cells(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((900, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, score double")
    hit = 0
    found = defaultdict(list)
    for r in ann.search(table, table.where("vec_id % 100 = 0"), cell=150, at_once=2).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, got in found.items():
        far = np.sqrt(((vectors.astype(float) - vectors[q].astype(float)) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(len(far)), far))[:10]
        hit += len(set(best.tolist()) & {i for _, i, _ in got})
        assert all(abs(far[i] - d) < 1e-9 for _, i, d in got) and [n for n, _, _ in sorted(got)] == list(range(1, 11))
    assert len(found) == 9 and hit >= 85


def test_bounds_hold_the_distances():
    rng = np.random.default_rng(1)
    vectors, queries_ = rng.standard_normal((500, 32)), rng.standard_normal((20, 32))
    centre, turn = vectors.mean(axis=0), ann.rotation(32, ann.width_of(32), 3)
    units, norms = ann.turned(queries_, centre, turn)
    low, high = ann.bounds(*ann.encoded(vectors, centre, turn), units, norms)
    far = ((vectors[:, None] - queries_[None]) ** 2).sum(axis=2)
    assert np.mean((low <= far + 1e-9) & (far <= high + 1e-9)) >= 0.98


def test_packer_tiers_and_gaps():
    """Whole windows leave first; a window starts with the longest piece of its tier, and shorter ones fill its gap."""
    packer = packing.Packer((8, 16))
    for doc, n in enumerate((20, 12, 3, 1, 5, 7)):
        packer.add(doc, n)
    assert packer.done == [[(0, 0, 16)]]
    packer.pack()
    made = packer.done[1:]
    assert all(sum(p[2] for p in s) in (8, 16) for s in made)
    assert made[0][0] == (1, 0, 12) and sum(p[2] for p in made[0]) == 16 and len(made[0]) > 1
    packer.close()
    held = defaultdict(list)
    for s in packer.done:
        assert sum(p[2] for p in s).bit_count() == 1
        for doc, at, n in s:
            held[doc].append((at, n))
    for doc, n in enumerate((20, 12, 3, 1, 5, 7)):
        upto = 0
        for at, m in sorted(held[doc]):
            assert at == upto
            upto += m
        assert upto == n


def test_packing_by_several_tasks(spark):
    rows = [(i, " ".join(f"word{(i * k) % 97}" for k in range(1, 5 + (i * 37) % 900))) for i in range(300)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by_sequence, by_doc, groups = defaultdict(list), defaultdict(list), defaultdict(set)
    for r in out:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.sequence_length))
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        groups[r.step_group].add((r.sequence_id, r.sequence_length))
    for pieces in by_sequence.values():
        upto = 0
        for offset, n, whole in sorted(pieces):
            assert offset == upto
            upto += n
        assert upto == whole
    for pieces in by_doc.values():
        upto = 0
        for start, n, whole in sorted(pieces):
            assert start == upto
            upto += n
        assert upto == whole
    assert len(by_doc) == 300 and all(len(g) <= packing.GROUP for g in groups.values())
    totals = Counter(sum(n for _, n in g) for g in groups.values())
    full = [sum(n for _, n in g) for g in groups.values() if len(g) == packing.GROUP]
    assert totals and (not full or max(full) <= 2 * min(full))


def test_ids_of_other_tokenizers():
    """A file that is not plain byte-level BPE is read text by text."""
    import public_tokenizers

    ids = packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Hello there, world", "a  b", ""]
    got, starts = ids.of(pa.array([t.encode() for t in texts], pa.binary()), 7)
    for i, t in enumerate(texts):
        assert got[starts[i] : starts[i + 1]].tolist() == [*ids.tokenizer.encode(t, add_special_tokens=False).ids, 7]


def test_columns_of_any_name(spark):
    rows = [(i, t, i, "mine", "k", 5) for i, t in enumerate(TEXTS[:12])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, q_id long, q_text string, q_kept string, q_lines int")
    firsts = near_dup.keep_firsts(docs)
    assert firsts.columns == docs.columns
    wanted = brute.near([(i, t) for i, t, *_ in rows], similarity=80)
    assert {r.doc_id for r in firsts.collect()} == {i for i, (_, c) in wanted.items() if c == i}
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == docs.columns and {(r.doc_id, r.q_text, r.q_lines) for r in lines.collect()} == {(i, "mine", 5) for i in range(12)}
    nulls = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (1, "a b c d e f g"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id) for r in near_dup.keep_firsts(nulls).collect() if r.doc_id) == [(False, 1), (False, 2)]
    assert near_dup.keep_firsts(nulls).count() == 4 and near_dup.keep_firsts(nulls.limit(0)).count() == 0


def _lines(rows, least=40, docs=5):
    """Plain line dedup of [(id, text)]."""
    strip, low = " \t\n\x0b\x0c\r", lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = low(line.strip(strip))
            if len(key) >= least:
                holders[key].add(i)
    goes = {k: max(v) for k, v in holders.items() if len(v) >= docs}
    return [(i, "\n".join(x for x in (t or "").split("\n") if goes.get(low(x.strip(strip)), i) == i)) for i, t in rows]


def test_pipeline(spark, tmp_path):
    """All five stages against plain versions, each on what the one before it kept."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words, 60 + i % 40))
        if i % 10 == 1:
            text = rows[-1][1]  # an exact copy
        elif i % 10 == 2:
            text = rows[-1][1] + " end"  # a near one
        elif i % 10 == 3:
            text = " ".join(w + "###" for w in text.split())  # labelled bad
        elif i % 10 == 4:
            text = text + "\nThis line is in every tenth document of the whole table\nend"
        elif i % 10 == 5:
            text = "too short"
        rows.append((i, text, "en", ("a", "b", None)[i % 3], len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 10 != 3), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in quality.digest(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(120) if i % 10 not in (3, 5)}
    texts = _lines([(i, t) for i, t, *_ in rows if i in kept])
    components = brute.near(texts, similarity=80)
    firsts = {i: t for i, t in texts if components[i][1] == i}
    assert len(firsts) < len(texts)
    stages, at = dict(corpus_pipeline.STAGES), docs
    for name in ("quality", "lines", "near_dedup"):
        at = stages[name](spark, at, str(tmp_path))
        assert at.columns == docs.columns
    assert {r.doc_id: r.text for r in at.collect()} == firsts
    mixed = stages["mixing"](spark, at, str(tmp_path))
    assert mixed.columns == docs.columns
    sizes = {i: len(t.split()) for i, t in firsts.items()}
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len(r.text.split())
    assert set(taken) <= set(firsts) and all(n <= 3 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 3  # each of three sources takes whole words
    copies = Counter(r.doc_id for r in mixed.collect())
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == copies
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r.length for r in packed) == sum(len(plain.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert corpus_pipeline.ORACLE_SQL is None
