"""The registered queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import m01_lines, m02_bpe, m03_packing, m04_urls, m05_chunks, m06_ring, m07_orc, m08_minhash, m09_ordinal, m10_recompress
from .common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


URL_RULES = [
    m04_urls.HostRule("block", "com", "/en/"),
    m04_urls.HostRule("allow", "example.com", "/en/7"),
    m04_urls.HostRule("allow", "net", "/de/"),
    m04_urls.HostRule("block", "example.net", "/de/8"),
    m04_urls.HostRule("block", "org", "/es/"),
]
URL_GLOBS = [m04_urls.GlobRule("block", "spam-farm.**"), m04_urls.GlobRule("block", "*.spam-farm.**")]


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m01_lines.clean(documents(spark, sf_dir), with_text=False)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m02_bpe.digest_documents(documents(spark, sf_dir), BYTE_BPE, public_tokenizers.PATTERN)


def op3_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = m03_packing.pack(documents(spark, sf_dir), WORD_BPE, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_url_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m04_urls.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, URL_GLOBS)


def op5_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m05_chunks.store_documents(documents(spark, sf_dir))


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = m06_ring.shard(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m07_orc.store_documents(documents(spark, sf_dir), WORD_BPE, end_id=2)


def op8_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m08_minhash.near_duplicates(documents(spark, sf_dir))


CLEAN, CLEAN_PROBABILITY = 2, 0.7


def quality_model(spark: SparkSession, sf_dir: str) -> m09_ordinal.OrdinalModel:
    """Grades: 0 poor, 1 toxic, 2 clean."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    grade = F.when(F.col("quality") == 0, 0).when(good & toxic, 1).when(good & (F.col("toxic") == 0), CLEAN)
    return m09_ordinal.train(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), grade, n_grades=3)


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m09_ordinal.score(documents(spark, sf_dir), quality_model(spark, sf_dir), CLEAN, CLEAN_PROBABILITY)


def op10_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m10_recompress.digest_removals(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_quality,
        op2_byte_bpe,
        op3_hilbert_packing,
        op4_url_automaton,
        op5_chunk_store,
        op6_ring_shards,
        op7_orc_ids,
        op8_minhash_groups,
        op9_ordinal_quality,
        op10_recompress,
    )
}

URL_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
), r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT page_id, arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN starts_with(host, 'spam-farm.') OR contains(host, '.spam-farm.') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN fit ON h.page_id = fit.page_id"""

REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS k FROM bad, range(13) r(j)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.k) AS text, count(*) AS n FROM words w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.k = w.k) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS rep FROM (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS sig FROM s GROUP BY doc_id)),
u AS (SELECT s.doc_id, g, n FROM s JOIN n ON n.doc_id = s.doc_id JOIN rep ON rep.doc_id = s.doc_id AND rep.rep = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
edge AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k) UNION SELECT doc_id, rep FROM rep WHERE doc_id <> rep),
two AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(a, b) AS (SELECT a, a FROM two UNION SELECT r.a, e.b FROM reach r JOIN two e ON r.b = e.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id"""

#: CRC-32 by its table, and the ring's fold as a recursion of one row per step.
RING_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([n] || range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 4) AS INTEGER) AS cell
  FROM documents
), s AS (
  SELECT doc_id, size, cell,
         xor(4294967295, list_reduce([4294967295] || list_transform(bytes, lambda b: CAST('0x' || b AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM d, crc_table
), points AS (
  SELECT cell, min(s) AS shard FROM (SELECT a.s, CAST('0x' || substr(md5('shard ' || a.s || ' point ' || b.v), 1, 4) AS INTEGER) AS cell FROM range(8) a(s), range(64) b(v)) GROUP BY cell
), arcs AS (
  SELECT cell, shard, row_number() OVER (ORDER BY cell) - 1 AS arc, count(*) OVER () AS n FROM points
), met AS (
  SELECT a.arc, b.shard, row_number() OVER (PARTITION BY a.arc ORDER BY min((b.arc - a.arc + a.n) % a.n)) - 1 AS round FROM arcs a, arcs b GROUP BY a.arc, b.shard
), target AS (SELECT list(shard + 1 ORDER BY round, arc) AS target FROM met),
cells AS (
  SELECT c.cell, c.n, coalesce(a.arc, 0) AS arc, CASE WHEN a.arc IS NULL THEN c.cell - 65536 ELSE c.cell END AS turned
  FROM (SELECT cell, count(*) AS n FROM s GROUP BY cell) c ASOF LEFT JOIN arcs a ON c.cell <= a.cell
), placed AS (
  SELECT cell, arc, coalesce(sum(n) OVER (PARTITION BY arc ORDER BY turned ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rank0 FROM cells
), have AS (
  SELECT arcs.arc, CAST(coalesce(sum(cells.n), 0) AS BIGINT) AS n FROM arcs LEFT JOIN cells ON cells.arc = arcs.arc GROUP BY arcs.arc
), fold(k, waiting, took, room, queue) AS (
  SELECT 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), list_transform(range(8), lambda i: CAST(sum(n) AS BIGINT) // 8 + CASE WHEN i < CAST(sum(n) AS BIGINT) % 8 THEN 1 ELSE 0 END), list(n ORDER BY arc) FROM have
  UNION ALL
  SELECT k + 1, queue[1], least(queue[1], room[target[k + 1]]),
         list_transform(room, lambda r, i: r - CASE WHEN i = target[k + 1] THEN least(queue[1], r) ELSE 0 END),
         list_append(queue[2:], queue[1] - least(queue[1], room[target[k + 1]]))
  FROM fold, target WHERE k < len(target)
), taken AS (
  SELECT (k - 1) % len(queue) AS arc, (k - 1) // len(queue) AS round, target[k] - 1 AS shard, waiting, took FROM fold, target WHERE took > 0
), quotas AS (
  SELECT t.arc, t.shard, have.n - waiting AS rank0, took,
         coalesce(sum(took) OVER (PARTITION BY t.shard ORDER BY t.arc, t.round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot0
  FROM taken t JOIN have ON have.arc = t.arc
), ranked AS (
  SELECT s.doc_id, size, text_crc32, arc, rank0 + row_number() OVER (PARTITION BY s.cell ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS rank FROM s JOIN placed ON placed.cell = s.cell
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, CAST(slot0 + rank - rank0 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked r JOIN quotas q ON q.arc = r.arc AND q.rank0 <= r.rank AND r.rank < q.rank0 + q.took"""

SQL: dict[str, str] = {
    "op1_line_quality": m01_lines.sql(),
    "op4_url_automaton": URL_SQL,
    "op6_ring_shards": RING_SQL,
    "op8_minhash_groups": NEAR_SQL,
    "op10_recompress": REPEATS_SQL,
}
