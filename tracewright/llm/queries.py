"""The queries of the training-data operators, with SQL where SQL can express one.

A query takes ``(spark, sf_dir)``, runs its operator over the whole table and derives the columns
to report. No limits, samples or id subsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, langid, lexical, licenses, media, packing, sharding, simhash, spelling, tokenfile, urlfilter, warc
from .common import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_near_duplicates(documents(spark, sf_dir))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The rules that the query applies.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file_digests(documents(spark, sf_dir))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digests(documents(spark, sf_dir))


#: Fixed value: letters are deleted where it divides a run's hash, so that there are misspellings to find.
DAMAGE = 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(documents(spark, sf_dir), damage=DAMAGE))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_licenses": op2_licenses,
    "op3_packing": op3_packing,
    "op4_decontamination": op4_decontamination,
    "op5_revisits": op5_revisits,
    "op6_url_filter": op6_url_filter,
    "op7_language": op7_language,
    "op8_media": op8_media,
    "op9_chat": op9_chat,
    "op10_token_file": op10_token_file,
    "op11_sharding": op11_sharding,
    "op12_spelling": op12_spelling,
    "op13_search": op13_search,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {"op2_licenses": licenses.SQL, "op5_revisits": warc.SQL, "op9_chat": chat.SQL, "op13_search": lexical.SQL}
