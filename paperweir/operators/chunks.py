"""Chunk inspection: splitters, flags, statistics and where expected passages lie."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.functions import text as X

SENTENCE_END = "[.!?:;)\\]\"'»”…]\\s*$"
TABLE_LINE = "(\\|.*\\|)|(\\t.*\\t)"
#: Absolute paths: two levels or more from the root, a drive, or a home folder.
ABSOLUTE_PATH = "^(?:/[^/\\n]+(?:/[^/\\n]+)+/?|[A-Za-z]:[\\\\/].*|~[\\\\/].*)"


def _numbered(parts: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("chunker", "document").orderBy(*order)
    return parts.withColumn("idx", F.row_number().over(w) - 1)


def by_paragraph(docs: DataFrame, separator: str = "\\n", chunker: str = "paragraph") -> DataFrame:
    """(chunker, document, idx, text): non-blank parts between separators, in order."""
    rows = docs.select(F.lit(chunker).alias("chunker"), "document", F.posexplode(F.split("text", separator, -1)).alias("pos", "text"))
    return _numbered(rows.where(F.rlike("text", F.lit("(?U)\\S"))), ["pos"]).drop("pos")


def by_words(docs: DataFrame, size: int = 100, overlap: int = 0, chunker: str = "words") -> DataFrame:
    """Chunks of `size` words, each beginning size - overlap words after the one before."""
    words = F.regexp_extract_all("text", F.lit("(?U)\\S+"), F.lit(0))
    rows = docs.select(F.lit(chunker).alias("chunker"), "document", words.alias("w")).where(F.size("w") > 0)
    # Starts stop where the rest is but an overlap.
    last = F.greatest(F.size("w") - overlap - 1, F.lit(0))
    # Chunks are made before they become rows: each row would carry all words of its document.
    parts = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda at: F.array_join(F.slice("w", at + 1, F.lit(size)), " "))
    return rows.select("chunker", "document", F.posexplode(parts).alias("idx", "text"))


def by_characters(docs: DataFrame, size: int = 500, overlap: int = 0, chunker: str = "characters") -> DataFrame:
    rows = docs.where(F.length("text") > 0)
    last = F.greatest(F.length("text") - overlap - 1, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), last, F.lit(size - overlap)), lambda at: F.substring(F.col("text"), at + 1, F.lit(size)))
    return rows.select(F.lit(chunker).alias("chunker"), "document", F.posexplode(parts).alias("idx", "text"))


def _filled(text: Column) -> Column:
    return F.filter(F.transform(X.lines(text), X.strip), lambda s: s != "")


def _ended(text: Column) -> Column:
    """SENTENCE_END for a text without white space at its ends: its last character tells."""
    return F.rlike(F.right(text, F.lit(1)), F.lit(SENTENCE_END))


def _tabular(line: Column) -> Column:
    return (F.contains(line, F.lit("|")) | F.contains(line, F.lit("\t"))) & F.rlike(line, F.lit(TABLE_LINE))


def flags(chunks: DataFrame, min_tokens: int = 20, max_tokens: int | None = None, metadata: str | None = None) -> DataFrame:
    """chunks with characters, tokens and flags: tiny, oversized, split_sentence, split_table, heading_at_end, duplicate,
    path_metadata. Neighbours are within a document; duplicates are of an earlier chunk of the chunker by document and place."""
    # What rules ask of a chunk and of the one after it is read off each text once, where it is; texts themselves are not sent.
    text = F.col("text")
    own = F.struct(X.strip(text).alias("own"), X.squeeze(text).alias("norm"), _filled(text).alias("lines"), X.tokens_estimate(text).alias("tokens"), F.length(text).alias("characters"))
    c = chunks.select("*", F.explode_outer(F.array(own)).alias("__o"))
    ends = F.struct(F.get("__o.lines", F.size("__o.lines") - 1).alias("last"), F.get("__o.lines", F.lit(0)).alias("first"))
    c = c.select("*", F.explode_outer(F.array(ends)).alias("__l"))
    last, first = F.col("__l.last"), F.col("__l.first")
    words = F.size(F.regexp_extract_all(last, F.lit("(?U)\\S+"), F.lit(0)))
    shout = (F.upper(last) == last) & (F.lower(last) != last) & ~_ended(last) & (words <= 8)
    path = F.exists(F.map_values(metadata), lambda v: F.rlike(v, F.lit(ABSOLUTE_PATH))) if metadata else F.lit(False)
    sure = lambda rule: F.coalesce(rule, F.lit(False))
    told = {
        "open": (F.col("__o.own") != "") & ~_ended(F.col("__o.own")), "low": F.rlike(F.substring("__o.own", 1, 1), F.lit("\\p{Ll}")), "to": _tabular(last), "from": _tabular(first),
        "heading": (F.size("__o.lines") >= 2) & (F.startswith(last, F.lit("#")) | shout), "path": path,
    }
    # One string, which is asked for whole: so the search for equal chunks reads what the rules read, and texts are read once.
    code = F.concat_ws(",", F.coalesce(F.when(F.col("__o.norm") != "", F.md5(F.col("__o.norm").cast("binary"))), F.lit("")), F.coalesce(F.col("__o.tokens").cast("string"), F.lit("")), F.coalesce(F.col("__o.characters").cast("string"), F.lit("")), *[sure(r).cast("int").cast("string") for r in told.values()])
    c = c.select(*chunks.columns, code.alias("__code")).repartition("chunker", "document").withColumn("__part", F.split("__code", ","))
    c = c.withColumns({"__key": F.coalesce(F.get("__part", F.lit(0)), F.lit("")), "__at": F.struct("document", "idx")})
    # The first of equal chunks is found by a sum that is partial before the shuffle: a chunk that stands everywhere is one row.
    # No filter on the key, which would go below the shuffle and make it another: blank chunks, of key '', are one row too.
    firsts = c.groupBy("chunker", "__key").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    w = Window.partitionBy("chunker", "document").orderBy("idx")
    number = lambda i, kind: F.nullif(F.get("__part", F.lit(i)), F.lit("")).cast(kind)
    c = c.withColumns({"tokens": number(1, "long"), "characters": number(2, "int"), **{f"__{name}": F.get("__part", F.lit(3 + i)) == "1" for i, name in enumerate(told)}})
    c = c.withColumn("__next", F.lead(F.struct("__low", "__from")).over(w)).join(firsts, ["chunker", "__key"], "left")
    rules = [
        (F.col("tokens") < min_tokens, "tiny"), (F.lit(False) if max_tokens is None else F.col("tokens") > max_tokens, "oversized"),
        (F.col("__open") & F.col("__next.__low"), "split_sentence"), (F.col("__to") & F.col("__next.__from"), "split_table"), (F.col("__heading"), "heading_at_end"),
        ((F.col("__key") != "") & (F.col("__at") != F.col("__first")), "duplicate"), (F.col("__path"), "path_metadata"),
    ]
    found = F.array_compact(F.array(*[F.when(sure(rule), name) for rule, name in rules]))
    return c.withColumn("flags", found).select(*chunks.columns, "tokens", "characters", "flags")


def stats(flagged: DataFrame) -> DataFrame:
    """Per chunker: count, total, least, median, 95th percentile (nearest rank, half to even) and most tokens."""
    return _summary(flagged).drop("flagged")


def _summary(flagged: DataFrame) -> DataFrame:
    """stats() and the number of chunks with any flag, from one sum per number of tokens: a list of all would not stay small, and
    each further sum would make and flag all chunks again."""
    per = flagged.groupBy("chunker", "tokens").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("flags") > 0).alias("m"))
    known, every = F.when(F.col("tokens").isNotNull(), F.col("n")).otherwise(F.lit(0)), Window.partitionBy("chunker")
    upto = every.orderBy("tokens")
    per = per.withColumns({"upto": F.sum("n").over(upto), "seen": F.sum(known).over(upto), "chunks": F.sum("n").over(every), "known": F.sum(known).over(every)})
    at = lambda reached: F.min(F.when(reached, F.col("tokens")))
    g = per.groupBy("chunker", "chunks").agg(
        F.sum(F.col("tokens") * F.col("n")).alias("tokens_total"), F.min("tokens").alias("tokens_min"),
        ((at(F.col("seen") >= F.floor((F.col("known") + 1) / 2)) + at(F.col("seen") >= F.floor(F.col("known") / 2) + 1)) / 2.0).cast("double").alias("tokens_median"),
        F.max("tokens").alias("tokens_max"), at(F.col("upto") >= F.bround((F.col("chunks") - 1) * 0.95) + 1).cast("double").alias("tokens_p95"), F.sum("m").alias("flagged"),
    )
    return g


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select("chunker", F.explode("flags").alias("flag")).groupBy("chunker", "flag").agg(F.count(F.lit(1)).alias("chunks"))


def compare(flagged: DataFrame) -> DataFrame:
    """One row per chunker: statistics and the number of chunks with any flag."""
    return _summary(flagged)


def by_function(docs: DataFrame, split, chunker: str = "own") -> DataFrame:
    """Chunks of a splitter of one's own: a function of a text to a list of texts, run in Arrow batches."""

    def run(batches):
        for batch in batches:
            at, idx, parts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = split(text) if text else []
                at += [row] * len(own)
                idx += range(len(own))
                parts += own
            yield pa.RecordBatch.from_arrays([pa.array([chunker] * len(at), pa.string()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(idx, pa.int32()), pa.array(parts, pa.string())], names=["chunker", "document", "idx", "text"])

    schema = T.StructType([T.StructField("chunker", T.StringType()), docs.schema["document"], T.StructField("idx", T.IntegerType()), T.StructField("text", T.StringType())])
    return docs.select("document", "text").mapInArrow(run, schema)


def inspected(chunks: DataFrame, categories=None, preview: int = 160) -> DataFrame:
    """chunks with identifiers (their number), hidden (findings of hidden content) and a preview: masked, white space single, cut
    to `preview` characters with an ellipsis."""
    from paperweir.operators import hidden as H
    from paperweir.operators import identifiers as I

    key = ["chunker", "document", "idx"]
    found = I.scan(chunks, key, categories)
    masked = I.mask_matches(chunks, found, key).select(*key, F.col("replaced").alias("identifiers"), X.squeeze(F.col("text")).alias("__shown"))
    own = chunks.select(F.struct(*key).alias("document"), F.lit(1).alias("page"), "text")
    passages = H.findings(own).groupBy("document").agg(F.count(F.lit(1)).alias("hidden")).select(*[F.col(f"document.{k}").alias(k) for k in key], "hidden")
    shown = F.when(F.length("__shown") > preview, F.concat(F.substring("__shown", 1, preview - 1), F.lit("…"))).otherwise(F.col("__shown"))
    return chunks.join(masked, key).join(passages, key, "left").fillna(0, ["hidden"]).withColumn("preview", shown).drop("__shown")
