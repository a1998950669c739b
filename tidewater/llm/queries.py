"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.ann import nearest
from tidewater.llm.common import read
from tidewater.llm.conversations import damaged, repair_digest
from tidewater.llm.decontaminate import decontamination_report
from tidewater.llm.html_text import extract_pages
from tidewater.llm.licenses import scan_licenses
from tidewater.llm.mixing import schedule
from tidewater.llm.near_dup import near_duplicates
from tidewater.llm.oracle import ORACLE_SQL  # noqa: F401
from tidewater.llm.repeats import repeats_digest
from tidewater.llm.secret_scan import secret_digest
from tidewater.llm.token_output import token_digest
from tidewater.llm.toxicity import toxicity_digest
from tidewater.llm.url_filter import RULES, filter_urls
from tidewater.llm.whitening import whitened


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("tid")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(read(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are documents at source/language/number.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(read(spark, sf_dir, "documents")).drop("tid")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), words=2)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_digest(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digest(damaged(read(spark, sf_dir, "conversations")), there="there")


#: The rules of the query (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULES))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(read(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_html_text, op3_secret_scan, op4_license_scan, op5_nearest, op6_token_output, op7_mix_sources, op8_near_duplicates, op9_toxicity, op10_repeats, op11_conversation_repair, op12_url_filter, op13_whitening)}
