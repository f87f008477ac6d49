"""A training-text pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Rows are told apart by a number that each stage gives them, never by doc_id: rows with null, repeated or equal ids are
judged one by one, and no row's text becomes another's.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import STAGED, discard, numbered, staged
from waymark.llm.decision_list import judge
from waymark.llm.decontamination import leaks
from waymark.llm.line_chunks import drop_repeated_chunks
from waymark.llm.minhash import near_duplicates
from waymark.llm.queries import tokenizer
from waymark.llm.sentencepieces import piece_digests


def settled(result: DataFrame, since: int) -> DataFrame:
    """What an operator found, written; the tables that it staged on its way, from place ``since`` of STAGED on, are deleted."""
    out = staged(result)
    discard(out.sparkSession, since, len(STAGED) - 1)
    return out


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose number isn't among those of gone (_row). The numbers grow with the rows, so they are merged at every
    size and never broadcast."""
    return rows.join(gone.hint("merge"), "_row", "left_anti").drop("_row")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go. Labels of an id that several rows have are not
    used; null and repeated ids are judged row by row. Null and empty texts go (no words); no rows give no rows."""
    rows = numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    one = rows.groupBy("doc_id").agg(F.min("_row").alias("_row"), F.count("*").alias("n")).filter("n = 1 and doc_id is not null")
    since = len(STAGED)
    judged = judge(rows, labels.join(one, "doc_id").select("_row", "quality"), id_col="_row")
    return without(rows, settled(judged.filter("not kept").select(F.col("doc_id").alias("_row")), since))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines of multi-line chunks that stand in an earlier row too; a row of which nothing is left goes.
    Null and empty texts stay as they are; exact repeats of a row lose what the first of them keeps."""
    rows = numbered(docs)
    since = len(STAGED)
    shorter = drop_repeated_chunks(rows, id_col="_row").filter("n_removed > 0").select(F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    changed = F.col("_text").isNotNull()
    return (
        rows.join(settled(shorter, since).hint("merge"), "_row", "left")
        .filter(~changed | (F.trim("_text") != ""))
        .withColumn("text", F.coalesce("_text", "text"))
        .withColumn("n_chars", F.when(changed, F.length("_text").cast("long")).otherwise(F.col("n_chars")))
        .select(docs.columns)
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, similarity 0.8) stays: that of the smallest id, of equal
    ids the first; a null id counts as the largest. Rows without words stay."""
    rows = numbered(docs)
    since = len(STAGED)
    groups = settled(near_duplicates(rows, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id"), since)
    order = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "_row")
    stays = rows.select("_row", "doc_id").join(groups.hint("merge"), "_row").groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m._row").alias("_row"))
    return rows.join(stays.hint("merge"), "_row", "left_semi").drop("_row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage that aligns with a benchmark item go; rows without words stay."""
    rows = numbered(docs)
    since = len(STAGED)
    found = leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_row")
    return without(rows, settled(found.select(F.col("doc_id").alias("_row")).distinct(), since))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, a row for each row; a null text has no tokens, a null id stays null."""
    return piece_digests(docs, Path(tokenizer("piece_bpe_32k.model")).read_bytes())


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", tokens)]

#: The learned rules, rolling hashes, minima, alignments and pieces aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages in order to the documents of sf_dir. A stage's own tables and the stage before it are deleted
    when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = len(STAGED)
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        discard(spark, since, len(STAGED) - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
