"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from permlab.llm import decontaminate, lexical, mixing, packing, passages, pii, quality, simhash, stages, tokens, topk, toxicity, upsert, warc
from permlab.llm.common import table
from permlab.llm.stages import vocabulary


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.sorted_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.floor(F.col("position") * 1e9).alias("position_e9"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(table(spark, sf_dir, "documents"), vocabulary())


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_of_damage(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), vocabulary())


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upserted_clients(table(spark, sf_dir, "clients"), table(spark, sf_dir, "client_changes"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (pipeline, op1_mixing, op2_simhash, op3_quality, op4_passages, op5_decontamination, op6_pii, op7_tokens, op8_topk, op9_warc, op10_toxicity, op11_packing, op12_lexical, op13_upsert)}


MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '42', doc_id::VARCHAR, md5(coalesce(text, '')))) AS key FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sums),
weighed AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap,
                   CASE rank % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE (-0.5)::DOUBLE END AS tilt FROM ranked),
filled AS (SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE AS rest,
                  (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS rest_weight
           FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, rest_weight FROM filled WHERE cap * rest_weight >= rest * weight ORDER BY cap::DOUBLE / weight, rank LIMIT 1),
plan AS (SELECT f.source, f.source_size, f.tilt, least(f.cap::DOUBLE, l.rest * f.weight / l.rest_weight) AS target FROM filled f, level l),
queue AS (
  SELECT doc_id, size, source_size, target, tilt,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT + size / 2.0::DOUBLE AS mid
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source),
chosen AS (SELECT *, (mid < target)::INT + (mid + source_size < target)::INT + (mid + source_size * 2 < target)::INT AS copies FROM queue)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN floor(1e9 * CASE WHEN tilt = 0 THEN mid / target
            ELSE 2 * (mid / target) / (1 + tilt + sqrt((1 + tilt) * (1 + tilt) - 4 * tilt * (mid / target))) END)::BIGINT END AS position_e9
FROM chosen
"""


TOPK_SQL = """
WITH fine AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
          FROM fine q JOIN fine c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


WARC_SQL = r"""
WITH sides AS (
  SELECT page_id, url, html, 1 AS side FROM pages
  UNION ALL
  SELECT page_id, url, CASE WHEN page_id % 1000 = 7 THEN '#' || substr(html, 2) ELSE html END, 2 FROM pages WHERE coalesce(page_id % 1000, 0) <> 11),
texts AS (
  SELECT page_id, side, 'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>' || nl || 'WARC-Date: 2024-01-01T00:00:00Z' || nl
         || coalesce('WARC-Target-URI: ' || regexp_replace(url, '[
]', '', 'g') || nl, '') || 'Content-Type: text/html' || nl || 'Content-Length: ' || strlen(coalesce(html, '')) || nl || nl || coalesce(html, '') AS record
  FROM sides, (SELECT chr(13) || chr(10) AS nl)),
recs AS (SELECT page_id, side, sha256(record) AS digest, (strlen(record) + 4)::BIGINT AS length FROM texts),
placed AS (SELECT *, (coalesce(sum(length) OVER (PARTITION BY side ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS place FROM recs)
SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest IS NULL THEN 'extra' ELSE 'changed' END AS problem,
       a.place AS offset_a, a.length AS length_a, a.digest AS digest_a, b.place AS offset_b, b.length AS length_b, b.digest AS digest_b
FROM (SELECT * FROM placed WHERE side = 1) a FULL JOIN (SELECT * FROM placed WHERE side = 2) b ON a.page_id = b.page_id
WHERE a.digest IS DISTINCT FROM b.digest
"""


LEXICAL_SQL = r"""
WITH own AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sizes AS (SELECT row, doc_id, len(terms)::BIGINT AS n FROM own WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
counts AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM own) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, docs),
asked AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
scored AS (
  SELECT item, item_id, doc_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row), whole GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": WARC_SQL, "op1_mixing": MIXING_SQL, "op8_topk": TOPK_SQL, "op12_lexical": LEXICAL_SQL}
