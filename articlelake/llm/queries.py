"""The registered queries of this package and the SQL that checks them."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from articlelake.llm import collocations, conversations, decontamination, licenses, lines, oracle, packing, quality, similarity_join, substrings, token_files, toxicity, urls, warc
from articlelake.llm.common import table
from articlelake.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What has no SQL here is held against brute force in the tests: SQL has no tokenizer,
#: fingerprints or classifiers, and takes minutes for op5.
SQL = {
    "op2_quality_rules": oracle.QUALITY,
    "op3_warc": oracle.WARC,
    "op7_line_dedup": oracle.LINES,
    "op8_url_filters": oracle.URLS,
    "op10_ngram_jaccard_join": oracle.JACCARD,
    "op11_conversation_repair": oracle.REPAIR,
    "op13_phrase_collocations": oracle.COLLOCATIONS,
}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Drops white space and case.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The rules that op8 applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"))


@query
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"), date="2024-01-01T00:00:00Z").drop("payload")


@query
def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.benchmark_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op5_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeated(table(spark, folder, "documents"), length=50).drop("kept")


@query
def op6_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_matches(table(spark, folder, "documents"), licenses.TEMPLATES)


@query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_report(table(spark, folder, "documents"))


@query
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """The list to block holds the addresses that were captured more than once."""
    pages = table(spark, folder, "pages")
    key = urls.canonical(F.col("url"))
    again = pages.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1")
    return urls.judge_urls(pages, URL_RULES, again.select("url"))


@query
def op9_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_join.near_duplicates(table(spark, folder, "documents"), size=4, percent=85)


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    chats = table(spark, folder, "conversations")
    return conversations.repair_report(conversations.damage(chats), chats)


@query
def op12_token_files(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), WORD_TOKENIZER, path)
    return token_files.token_digests(token_files.read_token_files(spark, path))


@query
def op13_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"), least=10, share=50, top=2000)
