"""Per-document operators over Structured Streaming. Corpus-level operators run per batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.operators import identifiers as I


def stream_candidates(spark: SparkSession, path: str, schema, categories=None) -> DataFrame:
    """A stream of identifier matches before overlap resolution, which is per page and stateless too but groups."""
    docs = spark.readStream.schema(schema).parquet(path)
    pages = docs.select("doc_id", F.lit(1).alias("page"), "text")
    return I.validated(I.candidates(pages, categories))


def scan_available(spark: SparkSession, path: str, schema, categories, out: str, checkpoint: str) -> DataFrame:
    """All files that are there now, scanned as a stream into Parquet, read back."""
    found = stream_candidates(spark, path, schema, categories).select("doc_id", "category", "start", "value")
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
