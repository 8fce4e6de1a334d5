"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unievents.llm.common import load
from unievents.llm.context_tree import score_texts
from unievents.llm.decontaminate import find_leaks
from unievents.llm.embedding_dedup import embedding_dedup
from unievents.llm.hard_negatives import mine_hard_negatives
from unievents.llm.licenses import BASE, PASSAGES, scan_licenses
from unievents.llm.line_dedup import dedup_lines
from unievents.llm.packing import pack_documents
from unievents.llm.simhash_dedup import simhash_dedup
from unievents.llm.token_counts import count_tokens
from unievents.llm.toxicity import score_toxicity
from unievents.llm.url_filter import judge_urls
from unievents.llm.warc_audit import archive, audit
from unievents.llm.whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and passages in all documents."""
    return scan_licenses(load(spark, sf_dir, "documents"))[1].withColumnRenamed("id", "doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept of every document (keys of 10 code points or more)."""
    return dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the block and allow rules."""
    return judge_urls(load(spark, sf_dir, "pages"), block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"]
                      ).withColumnRenamed("id", "page_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents by the piece model."""
    return count_tokens(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return pack_documents(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.95 or more."""
    return embedding_dedup(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, 3 bits."""
    return simhash_dedup(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from the labels of those not held out."""
    return score_toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 0.8 of a benchmark item's five-word shingles."""
    return find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def damaged_copy(page_id: int | None, url: str, body: bytes) -> bytes | None:
    """What the second replica holds of a page: every 97th id has its body's first byte
    overwritten (one byte more where it is empty), every 89th has a hole."""
    if page_id is None or page_id % 97 and page_id % 89:
        return body
    return None if page_id % 89 == 0 else b"#" + body[1:]


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records on which a damaged replica of the archive of all pages differs."""
    found = audit(archive(load(spark, sf_dir, "pages"), damaged_copy))
    return found.select(F.col("record_id").alias("page_id"), "status", "length", "digest", "copy_length", "copy_digest")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context-tree scores of all documents, learned from those not held out."""
    return score_texts(load(spark, sf_dir, "documents"), held_out="crc32(cast(cast(id as string) as binary)) % 5 = 1").withColumnRenamed("id", "doc_id")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the 16 leading components, with unit variance."""
    return whiten(load(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh has its label moved on."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(load(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES: dict[str, Query] = {
    "op1_license_scans": op1_license_scans,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_token_counts": op4_token_counts,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_warc_audit": op10_warc_audit,
    "op11_lm_scoring": op11_lm_scoring,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_hard_negatives": op13_hard_negatives,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TEMPLATES = ", ".join(f"({k}, '{text}', '{label}', {base})" for k, (text, label, base) in enumerate(
    [(t, l, "true") for t, l in BASE.items()] + [(t, l, "false") for t, l in PASSAGES.items()]))

ORACLE: dict[str, str] = {
    "op1_license_scans": f"""
        WITH templates AS (
            SELECT template, label, is_base, string_split(phrase, ' ') AS w FROM (VALUES {_TEMPLATES}) t(template, phrase, label, is_base)),
        places AS (
            SELECT template, label, is_base, len(w) AS size, u.k, w[u.k + 1] || ' ' || w[u.k + 2] AS pair
            FROM templates, LATERAL (SELECT unnest(range(len(w) - 1)) AS k) u),
        texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        pairs AS (
            SELECT doc_id, u.pos, w[u.pos + 1] || ' ' || w[u.pos + 2] AS pair
            FROM texts, LATERAL (SELECT unnest(range(len(w) - 1)) AS pos) u),
        diagonals AS (
            SELECT doc_id, template, label, is_base, size, pos - k AS diagonal, count(*) AS votes, min(pos) AS lo, max(pos) + 2 AS hi
            FROM pairs JOIN places ON pairs.pair = places.pair GROUP BY ALL),
        marked AS (
            SELECT *, is_base OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2, true) AS apart
            FROM diagonals),
        numbered AS (
            SELECT *, sum(apart::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
        spans AS (
            SELECT doc_id, label, is_base, size, sum(votes) AS votes, max(votes) AS most, min(lo) AS lo, max(hi) AS hi,
                   CASE WHEN size - 1 < 10 THEN size - 1 ELSE 0.8 * (size - 1) END AS needed
            FROM numbered GROUP BY doc_id, template, label, is_base, size, span),
        good AS (
            SELECT *, least(1.0, votes / (size - 1)) AS coverage FROM spans
            WHERE CASE WHEN is_base THEN votes = size - 1 ELSE most >= needed OR (votes >= needed AND hi - lo <= size + 4) END)
        SELECT t.doc_id, len(t.w) AS n_words, count(*) FILTER (WHERE g.is_base) AS n_base,
               min(g.lo) FILTER (WHERE g.is_base) AS first_word, max(g.lo) FILTER (WHERE g.is_base) AS last_word,
               coalesce(array_to_string(list_sort(list(DISTINCT g.label) FILTER (WHERE g.is_base)), ','), '') AS base_labels,
               coalesce(array_to_string(list_sort(list(DISTINCT g.label) FILTER (WHERE g.label IS NOT NULL)), ','), '') AS labels,
               coalesce(max(g.coverage), 0.0) AS score
        FROM texts t LEFT JOIN good g ON t.doc_id = g.doc_id GROUP BY t.doc_id, t.w""",
    "op2_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, u.n AS n, u.line AS line,
                   translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
                 LATERAL (SELECT unnest(parts) AS line, unnest(range(len(parts))) AS n) u),
        repeated AS (
            SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        marked AS (
            SELECT l.doc_id, l.n, l.line, r.key IS NOT NULL AND l.doc_id <> r.first AS gone
            FROM lines l LEFT JOIN repeated r ON l.key = r.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op9_benchmark_decontamination": f"""
        WITH both_words AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        words AS (
            SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                                                '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM both_words),
        sized AS (SELECT * FROM (SELECT id, w, least(5, len(w)) AS k FROM words WHERE side = 'i') WHERE k > 0),
        wanted AS (
            SELECT DISTINCT id, k, array_to_string(w[u.p:u.p + k - 1], ' ') AS s
            FROM sized, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p) u),
        held AS (
            SELECT DISTINCT d.id, n.k, array_to_string(d.w[u.p:u.p + n.k - 1], ' ') AS s
            FROM (SELECT * FROM words WHERE side = 'd') d CROSS JOIN (SELECT DISTINCT k FROM sized) n,
                 LATERAL (SELECT unnest(range(1, len(d.w) - n.k + 2)) AS p) u),
        sizes AS (SELECT id, count(*) AS n FROM wanted GROUP BY id),
        found AS (
            SELECT held.id AS doc_id, wanted.id AS item_id, count(*) AS n_found
            FROM held JOIN wanted ON held.k = wanted.k AND held.s = wanted.s GROUP BY ALL)
        SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
        FROM found JOIN sizes ON found.item_id = sizes.id WHERE n_found >= 0.8 * n""",
    "op3_url_filters": f"""
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages),
        rules(host, path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        fits AS (
            SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict
            FROM parts p LEFT JOIN rules r
              ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
        SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
               coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
        FROM fits GROUP BY page_id, host, path""",
    "op10_warc_audit": """
        WITH bodies AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
            WHERE page_id % 97 = 0 OR page_id % 89 = 0),
        copies AS (
            SELECT *, '#' || substr(html, 2) AS copy FROM bodies),
        records AS (
            SELECT page_id,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
                       || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
                   chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, copy
            FROM copies),
        whole AS (
            SELECT page_id, head || strlen(html) || gap || html || gap AS record,
                   CASE WHEN page_id % 89 <> 0 THEN head || strlen(copy) || gap || copy || gap END AS damaged
            FROM records)
        SELECT page_id, CASE WHEN damaged IS NULL THEN 'missing' ELSE 'changed' END AS status,
               strlen(record) AS length, sha256(record) AS digest, strlen(damaged) AS copy_length, sha256(damaged) AS copy_digest
        FROM whole WHERE damaged IS NULL OR damaged <> record""",
    "op13_hard_negatives": """
        WITH rows_ AS (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        scored AS (
            SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same,
                   list_inner_product(a.x, b.x)::BIGINT AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.x) = len(b.x)),
        positives AS (
            SELECT r, anchor_id, other AS p, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id, other) <= 5),
        windows AS (
            SELECT p.anchor_id, p.positive_id, n.other_id AS negative_id, p.positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.r, p.p ORDER BY n.score DESC, n.other_id, n.other) AS rank
            FROM positives p JOIN scored n ON p.r = n.r AND NOT n.same
             AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score)
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= 5""",
}
