"""The corpus pipeline: toxicity, SimHash near-dedup, suffix-array dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; n_chars follows the text. run() writes each stage's result to the shared folder and rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.llm import common, decontaminate, pack, simhash, suffix, toxicity
from paperweir.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def _changed(docs: DataFrame, text: str) -> DataFrame:
    """docs with a new text; a document that has lost some of it and keeps nothing but blanks goes. n_chars follows a changed text."""
    new = F.col(text)
    left = docs.where(F.coalesce("text", F.lit("")).eqNullSafe(new) | F.rlike(new, F.lit("\\S")))
    n = F.when(F.col("text").eqNullSafe(new), F.col("n_chars")).otherwise(F.length(new).cast("long"))
    return left.select("doc_id", F.when(F.col("text").isNull(), F.col("text")).otherwise(new).alias("text"), "lang", "source", n.alias("n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go (a score of 0.3 or more). Null and empty texts score as texts without
    words and stay; texts of any length are scored whole; repeated rows go or stay together; columns besides those of
    documents are dropped, whatever their names; an empty table gives none."""
    scored = toxicity.classify(_documents(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 5-word shingles alike to 0.8 or more stays: the one with the smallest id. Of
    that id's rows, if it has several in the group, the one with the least text hash stays, and rows equal to it are one. Texts
    without words, null ones among them, are no copies of each other: all stay. Groups count every row, also of null ids."""
    docs = _documents(docs)
    node = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    marked = docs.withColumn("node", node)
    worded = F.rlike("text", F.lit("[^\\x20\\x09-\\x0D]"))
    groups = simhash.similar_texts(docs.where(worded).select("doc_id", "text"), "doc_id", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    several = common.cut(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"), first.alias("head")).where("n > 1").select("root", "head"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    stays = same("doc_id", "head.doc_id") & (F.col("node") == F.col("head.node"))
    members = groups.join(several, "root").groupBy(F.col("doc_id").alias("d"), F.col("node").alias("m"), stays.alias("stays")).agg(F.count(F.lit(1)).alias("rows"))
    members = common.cut(members)
    kept = marked.join(members, same("doc_id", "d") & (F.col("node") == F.col("m")), "left").where("stays is null or stays")
    if members.where("stays and rows > 1").limit(1).count():
        one = kept.where("stays and rows > 1").dropDuplicates(["doc_id", "node"])
        kept = kept.where("not coalesce(stays and rows > 1, false)").union(one)
    return kept.select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under strings of 200 bytes that start twice go, but for those of a character that would go in part. Documents left
    with nothing but blanks go; null and empty texts stay as they are; repeated rows are copies, and none of them stays if it has 200
    bytes; other columns than those of documents are dropped; an empty table gives none."""
    return _changed(suffix.repeated_spans(_documents(docs), kept="kept"), "kept")


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that benchmark windows cover go. Documents left with nothing but blanks go; null, empty and blank texts stay as they
    are; repeated rows are cut alike; a benchmark without words cuts nothing; other columns than those of documents are dropped."""
    found = decontaminate.decontaminate(_documents(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean="clean")
    return _changed(found, "clean")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1,024 tokens. Null and empty texts are one token; texts of any length are
    packed whole; repeated rows and rows of null ids are packed each; an empty table gives none."""
    return pack.pack(_documents(docs).select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("packing", pack_sequences),
]

#: Training, induced sorting and packing are beyond SQL; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage has a scratch of its own, which goes once its result is stored; the result of a stage
    goes once the next one's is. Nothing of other calls is touched."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        stored = common.Scratch(spark)
        with common.scratch(spark) as own:
            docs = stored.cut(stage(spark, docs, sf_dir))
        own.release()
        if last is not None:
            last.release()
        last = stored
    return docs
