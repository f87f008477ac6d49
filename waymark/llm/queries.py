"""The registered query of each text operator, with production parameters, over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.chat import conversation_digests, format_conversations
from waymark.llm.compact_windows import repeated_passages
from waymark.llm.decision_list import judge
from waymark.llm.decontamination import leaks
from waymark.llm.html_wrapper import extract
from waymark.llm.line_chunks import drop_repeated_chunks
from waymark.llm.minhash import near_duplicates
from waymark.llm.oracles import ORACLE_SQL as ORACLE_SQL
from waymark.llm.packing import pack_tokens
from waymark.llm.resampling import resample
from waymark.llm.sentencepieces import piece_digests
from waymark.llm.token_counts import count_tokens
from waymark.llm.url_filter import judge_urls
from waymark.llm.vector_codes import compress

#: The contract's rules.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
#: Fixed value: the contract's conversation of control strings.
ODD_CONVERSATION = [(-1, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), Path(tokenizer("piece_bpe_32k.model")).read_bytes())


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), Path(tokenizer("byte_bpe_50k.json")).read_text())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents"), Path(tokenizer("byte_bpe_50k.tiktoken")).read_bytes(), pad=50256)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_chunks(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Path(tokenizer("byte_bpe_50k.json")).read_text()
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(rows.union(spark.createDataFrame(ODD_CONVERSATION, rows.schema)), vocabulary)
    return conversation_digests(formatted, vocabulary).drop("n_tokens", "n_loss_tokens")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_token_counts, op4_packing, op5_html_extraction, op6_line_dedup, op7_quality_rules, op8_substring_dedup, op9_url_filter, op10_minhash, op11_resampling, op12_chat, op13_vector_codes)}
