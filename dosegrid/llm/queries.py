"""The registered corpus queries: each runs one operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dosegrid.llm.alignment import align_tokens
from dosegrid.llm.common import table
from dosegrid.llm.decontamination import find_items
from dosegrid.llm.embeddings import similar_vectors
from dosegrid.llm.licences import scan_licences
from dosegrid.llm.mixing import mix_to_targets
from dosegrid.llm.near_duplicates import near_duplicates
from dosegrid.llm.private_data import find_private_data
from dosegrid.llm.quality import COUNTS, quality_report
from dosegrid.llm.site_quality import judge_documents
from dosegrid.llm.spelling import runs_of_letters, spelling_variants
from dosegrid.llm.sql import ORACLE_SQL
from dosegrid.llm.substrings import remove_repeats
from dosegrid.llm.url_filter import filter_urls
from dosegrid.llm.warc import through_archives


def _in_spans(column: str) -> Column:
    """Words that lie in the spans of a row."""
    length = lambda n, s: n + (s["end"] - s["start"]).cast("long")
    return F.aggregate(column, F.lit(0).cast("long"), length)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id",
        "n_words",
        _in_spans("spans").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = _in_spans("hits")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source of a document is its host, and its language the path there."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return judge_documents(docs, labels, F.col("source"), F.col("lang"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


__all__ = ["DEFAULTS", "DOMAINS", "ORACLE_SQL", "QUERIES", "TARGETS", "mixed"]

#: Targets of the mix: domains of the sources, and weights at the three levels.
DOMAINS = {
    "web": [f"src{i}" for i in range(12)],
    "books": [f"src{i}" for i in range(12, 16)],
    "reference": [f"src{i}" for i in range(16, 19)],
}
TARGETS = (
    {"web": 0.5, "books": 0.3, "reference": 0.15},
    {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    {"src0": 2.0},
)
DEFAULTS = (0.05, 0.05, 1.0)


def domain_of_source() -> Column:
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), name).otherwise(domain)
    return domain


def mixed(docs: DataFrame) -> DataFrame:
    return mix_to_targets(docs, domain_of_source(), TARGETS, DEFAULTS)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("mix_domain").alias("domain"),
        "lang",
        "source",
        F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_copies").alias("copies"),
    )


def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
    )


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = through_archives(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_report(table(spark, sf_dir, "documents"))
    first = [
        F.round(F.element_at(m, 1), 6).alias(m) for m in ("chars_per_token", "byte_share", "entropy")
    ]
    return report.select("doc_id", *COUNTS, "base_failed", "kept", *first)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))


def spoiled(part: int = 97) -> Column:
    """The word, in one of ``part`` documents without one of its characters."""
    h = F.crc32(F.concat_ws(":", "doc_id", "word").cast("binary"))
    place = (h % F.char_length("word") + 1).cast("int")
    return F.when(h % part == 0, F.overlay("word", F.lit(""), place, F.lit(1))).otherwise(F.col("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = runs_of_letters(table(spark, sf_dir, "documents"))
    return spelling_variants(runs.select(spoiled().alias("word")))


def op13_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_licence_scan": op5_licence_scan,
    "op6_warc_archives": op6_warc_archives,
    "op7_source_mixing": op7_source_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_private_data": op10_private_data,
    "op11_token_alignment": op11_token_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_embedding_duplicates": op13_embedding_duplicates,
}
