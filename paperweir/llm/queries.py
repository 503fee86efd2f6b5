"""The opN_ queries: each applies its operator to its whole table and derives the columns of the contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
SHARDS = 40


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.decontaminate import decontaminate

    found = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    ids = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.shard import assign_shards, text_size

    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", text_size("text").alias("size"), crc.alias("text_crc32"))
    return assign_shards(rows, SHARDS).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.urlfilter import judge_urls

    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def _scored(spark: SparkSession, sf_dir: str, operator) -> DataFrame:
    from paperweir.llm.common import held_out

    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels")
    return operator.classify(docs, labels).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm import quality

    return _scored(spark, sf_dir, quality)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.suffix import repeated_spans

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm import language
    from paperweir.llm.common import held_out

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.topk import top_k

    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm import toxicity

    return _scored(spark, sf_dir, toxicity)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.pack import pack

    return pack(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()).withColumn("doc_id", F.col("doc_id").cast("long"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperweir.llm.simhash import near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_quality, op3_packing, op4_sharding, op5_suffix_dedup, op6_language, op7_top_k, op8_toxicity, op9_url_filters, op10_simhash)}
