"""Queries of this subpackage for the driver, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extract, packing, pii, quality, rollups, secrets, simhash, topk, warc
from .common import fresh_path, stash, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.where("vec_id % 50 = 0"), vectors)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    return warc.read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in with a provisional count (a quarter of their characters), which is then revised to the
    tokenizer's; the revision is sent twice. Documents without text are deleted and inserted again, so every one counts."""
    exact = stash(rollups.token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k"), "token-counts")
    provisional = exact.withColumn("tokens", F.ceil(F.col("chars") / 4).cast("long"))
    held = rollups.Rollup(spark, fresh_path(spark, "rollup"))
    held.commit("load", rollups.inserts(provisional))
    for _ in range(2):
        held.commit("revise", rollups.revisions(provisional, exact))
    held.commit("withdraw", rollups.deletes(exact.where("chars = 0")))
    held.commit("restore", rollups.inserts(exact.where("chars = 0")))
    return held.totals()


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_topk": op1_topk,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_simhash": op6_simhash,
    "op7_token_rollups": op7_token_rollups,
    "op8_secrets": op8_secrets,
    "op9_pii": op9_pii,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        ) WHERE rank <= 5
    """,
    # A SHA-1 of 40 hexadecimal digits is 32 base32 digits: every 5 of the one make 4 of the other.
    "op5_warc": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), d AS (
            SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda g:
                array_to_string(list_transform([15, 10, 5, 0], lambda s:
                    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest
            FROM p
        ), m AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM m
    """,
}
