"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import ann, filter_audit, hard_negatives, line_dedup, mixing, near_dup, packing, piece_codec, quality, secrets, substring_dedup, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": lambda s, d: near_dup.digest(_read(s, d, "documents")),
    "op2_nearest": lambda s, d: ann.digest(_read(s, d, "embeddings")),
    "op3_quality": lambda s, d: quality.digest(_read(s, d, "documents"), _read(s, d, "labels")),
    "op4_urls": lambda s, d: url_filter.digest(_read(s, d, "pages")),
    "op5_lines": lambda s, d: line_dedup.digest(_read(s, d, "documents")),
    "op6_mixing": lambda s, d: mixing.shares(_read(s, d, "documents")),
    "op7_toxicity": lambda s, d: toxicity.digest(_read(s, d, "documents"), _read(s, d, "labels")),
    "op8_packing": lambda s, d: packing.pack(_read(s, d, "documents")),
    "op9_secrets": lambda s, d: secrets.find_secrets(_read(s, d, "documents")).drop("found"),
    "op10_substrings": lambda s, d: substring_dedup.digest(_read(s, d, "documents")),
    "op11_filter_audit": lambda s, d: filter_audit.digest(_read(s, d, "documents"), _read(s, d, "labels")),
    "op13_hard_negatives": lambda s, d: hard_negatives.digest(_read(s, d, "embeddings")),
    "op12_pieces": lambda s, d: piece_codec.digest(_read(s, d, "documents")),
}

_SPACE = r"[\x20\x09-\x0D]"

SQL: dict[str, str] = {
    "op5_lines": rf"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^{_SPACE}+', ''), '{_SPACE}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), held AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT l.*, (h.key IS NOT NULL AND l.doc_id <> h.last) AS goes FROM lines l LEFT JOIN held h ON l.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM judged GROUP BY doc_id""",
    "op6_mixing": rf"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS place
  FROM documents
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source)
), levels AS (
  SELECT *, row_number() OVER o AS nth,
    CAST((sum(source_size) OVER ()) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ranked WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)
), filled AS (
  SELECT l.*, f.nth AS first_nth, f.level AS first_level
  FROM levels l LEFT JOIN (SELECT nth, level FROM levels WHERE level * weight <= cap ORDER BY nth LIMIT 1) f ON true
), plan AS (
  SELECT source, source_size, CASE WHEN first_nth IS NULL OR nth < first_nth THEN CAST(cap AS DOUBLE) ELSE first_level * weight END AS target FROM filled
), whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM plan
), ordered AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.whole, CAST(round(w.target) AS BIGINT) - w.whole * w.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id NULLS LAST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sizes s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM ordered""",
    "op11_filter_audit": r"""
WITH said AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), judged AS (
  SELECT doc_id, part, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts
), counted AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM judged LEFT JOIN said USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(l, b)
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5
), steps AS (
  SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), summed AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed""",
    "op13_hard_negatives": """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS z
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.z, b.z) AS BIGINT) AS score
  FROM sound a JOIN sound b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10""",
}
