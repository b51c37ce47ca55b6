"""The queries of this subpackage: one ``opN_<name>`` per operator, and the pipeline."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contaminated
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.ngram_join import jaccard_components
from tidemark.llm.ngram_lm import lm_scores
from tidemark.llm.packing import pack
from tidemark.llm.quality import quality_scores
from tidemark.llm.scratch import small_batches
from tidemark.llm.substring_dedup import repeated_spans
from tidemark.llm.toxicity import toxicity
from tidemark.llm.url_filter import Rule, judge_urls, labelled_by_words
from tidemark.llm.warc import read_warc, write_warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pack(spark, _table(spark, sf_dir, "documents"), tokenizer_path(), payload={"ids_crc32": F.crc32("ids")})
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, _table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, _table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(spark, _table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_warc(spark, _table(spark, sf_dir, "pages"))
    return read_warc(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 2
    return lm_scores(spark, _table(spark, sf_dir, "documents"), held)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


URL_RULES = [Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(spark, pages, URL_RULES, labelled_by_words(pages))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


SQL = {
    "op3_exact_dedup": """
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
             g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
               d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.norm) AS text_sha256
        FROM d JOIN g ON d.norm = g.norm""",
    # Base32 of the 40 hex digits of SHA-1: five of them are four letters.
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             h AS (SELECT *, sha1(body) AS hex, octet_length(encode(body)) AS size FROM p),
             g AS (SELECT hex, min(page_id) AS first_id FROM h GROUP BY hex),
             v AS (SELECT h.*, g.first_id, list_transform(range(8), lambda i: CAST('0x' || substr(h.hex, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS fives FROM h JOIN g ON h.hex = g.hex)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST((fives[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1 AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM v""",
}


def _lean(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
    return {k: _lean(v) for k, v in own.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
