"""The document model over tables: pages (document, page, text, text_source, format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = ["document", "page"]


def _source(text: str):
    return F.when(F.rlike(F.col(text), F.lit("(?U)\\S")), "native").otherwise("none").alias("text_source")


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of documents as a one-page text file."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("document"), F.lit(1).alias("page"), "text", _source("text"), F.lit("text").alias("format"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a document, each turn as a page."""
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return d.select(F.concat(F.lit("conv_"), "conv_id").alias("document"), (F.col("turn") + 1).cast("int").alias("page"), "text", _source("text"), F.lit("text").alias("format"))


def full_text(pages: DataFrame) -> DataFrame:
    """(document, format, text): a document's pages in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    joined = F.array_join(F.transform(ordered, lambda p: p["text"]), "\n")
    return pages.groupBy("document", "format").agg(joined.alias("text"))
