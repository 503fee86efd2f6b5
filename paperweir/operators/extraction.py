"""Text out of documents with identifiers masked: parts within a token budget, and what is missing or not sure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperweir.functions import text as X
from paperweir.functions.fixed import CATEGORIES, MODEL_CATEGORIES
from paperweir.operators import identifiers as I

# Kinds of warnings.
UNREADABLE_DOCUMENT, UNREADABLE_PAGE = "unreadable_document", "unreadable_page"
MASKING_INCOMPLETE, MASKING_BEST_EFFORT, ESTIMATED_TOKENS = "masking_incomplete", "masking_best_effort", "estimated_tokens"
HIDES_CONTENT = [UNREADABLE_DOCUMENT, UNREADABLE_PAGE]


def split(text: Column, max_tokens: int) -> Column:
    """Parts of at most max_tokens (by estimate) in order: paragraphs, or lines where there is one paragraph only, are joined
    by a blank line while they fit. One that is larger alone is a part of its own; a text that fits stays as it is."""
    solid = lambda c: F.rlike(c, F.lit("(?U)\\S"))
    paragraphs = F.filter(F.split(text, "\n\n", -1), solid)
    blocks = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.filter(F.split(text, "\n", -1), solid))
    kind = "struct<own:string,out:array<string>>"
    start = F.struct(F.lit(None).cast("string").alias("own"), F.array().cast("array<string>").alias("out")).cast(kind)

    def add(a, block):
        both = F.concat(a["own"], F.lit("\n\n"), block)
        own = F.when(a["own"].isNull(), block).when(X.tokens_estimate(both) > max_tokens, block).otherwise(both)
        out = F.when(a["own"].isNotNull() & (X.tokens_estimate(both) > max_tokens), F.concat(a["out"], F.array(a["own"]))).otherwise(a["out"])
        return F.struct(own.alias("own"), out.alias("out")).cast(kind)

    parts = F.aggregate(blocks, start, add, lambda a: F.concat(a["out"], F.array_compact(F.array(a["own"]))))
    return F.when((X.tokens_estimate(text) <= max_tokens) | (F.size(parts) == 0), F.array(text)).otherwise(parts)


def extract(pages: DataFrame, mask: bool = True, reveal: bool = False, max_tokens: int | None = None, categories=None) -> DataFrame:
    """(document, page, part, text, tokens, token_fidelity, masked, masked_confirmed, source) of pages (document, page, text,
    text_source) with text. With `mask` what the scan finds is covered; with `reveal` it is counted and left as it is; with
    neither no scan runs. A page's counts stand on its first part. Blank and null pages have no part (see warnings)."""
    rows = pages.where(F.rlike("text", F.lit("(?U)\\S"))).select("document", "page", "text", "text_source")
    if mask or reveal:
        keep = ["text_source"] if mask else ["text_source", "__own"]
        done = I.mask_matches(rows if mask else rows.withColumn("__own", F.col("text")), I.scan(rows, ["document", "page"], categories), ["document", "page"], keep=keep)
        rows = done if mask else done.withColumn("text", F.col("__own")).drop("__own")
    else:
        rows = rows.withColumns({"replaced": F.lit(0).cast("long"), "confirmed": F.lit(0).cast("long")})
    parts = split(F.col("text"), max_tokens) if max_tokens else F.array("text")
    out = rows.select("document", "page", "text_source", "replaced", "confirmed", F.posexplode(parts).alias("n", "part_text"))
    first = F.col("n") == 0
    return out.select(
        "document", "page", (F.col("n") + 1).alias("part"), F.col("part_text").alias("text"), X.tokens_estimate(F.col("part_text")).alias("tokens"), F.lit("estimated").alias("token_fidelity"),
        F.when(first, F.col("replaced")).otherwise(F.lit(0)).cast("long").alias("masked"), F.when(first, F.col("confirmed")).otherwise(F.lit(0)).cast("long").alias("masked_confirmed"), F.col("text_source").alias("source"),
    )


def warnings(pages: DataFrame, skipped: DataFrame | None = None, mask: bool = True) -> DataFrame:
    """(kind, document, page, detail): files that could not be read, pages without text, categories that were not scanned for,
    and, whenever there is text, that names are found by a model at best and tokens are an estimate."""
    page = pages.where(F.col("text").isNull() | ~F.rlike("text", F.lit("(?U)\\S"))).select(F.lit(UNREADABLE_PAGE).alias("kind"), "document", F.col("page").cast("int").alias("page"), F.lit("nothing could be read off this page").alias("detail"))
    out = page
    if skipped is not None:
        out = out.unionByName(skipped.select(F.lit(UNREADABLE_DOCUMENT).alias("kind"), F.col("path").alias("document"), F.lit(None).cast("int").alias("page"), F.col("reason").alias("detail")))
    some = pages.where(F.rlike("text", F.lit("(?U)\\S"))).limit(1)
    labels = [c.label for c in CATEGORIES if c.id in MODEL_CATEGORIES]
    said = [(ESTIMATED_TOKENS, "no local encoding, so token counts are a character estimate")]
    if mask:
        said += [(MASKING_INCOMPLETE, f"{label} was not scanned for, so the text may still carry identifiers of that kind") for label in labels]
        said.append((MASKING_BEST_EFFORT, f"{', '.join(sorted(labels)).lower()} are recognised by a statistical model, so some will have been missed"))
    notes = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("document"), F.lit(None).cast("int").alias("page"), F.lit(d).alias("detail")) for k, d in said])
    return out.unionByName(some.select(F.explode(notes).alias("n")).select("n.*"))


def verdict(chunks: DataFrame, warned: DataFrame) -> DataFrame:
    """One row: chunks, tokens, masked, guaranteed (chunks whose matches were all confirmed by a checksum), complete (nothing
    is missing) and all_categories_scanned."""
    c = chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("masked"), F.lit(0)).alias("masked"),
        F.count_if((F.col("masked") > 0) & (F.col("masked") == F.col("masked_confirmed"))).alias("guaranteed"),
    )
    w = warned.agg((F.count_if(F.col("kind").isin(HIDES_CONTENT)) == 0).alias("complete"), (F.count_if(F.col("kind") == MASKING_INCOMPLETE) == 0).alias("all_categories_scanned"))
    return c.crossJoin(w)  # one row each
