"""Token and image cost per document and model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions.fixed import MODELS, PRESETS
from paperweir.functions.text import tokens_estimate

# Constants of the image formulas.
AREA_DIVISOR, AREA_CAP = 750, 1600.0
TILE, TILE_BASE, TILE_EACH, TILE_LONG, TILE_SHORT = 512, 85, 170, 2000, 768
FLAT, FLAT_SIDE = 258, 384


def models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MODELS, "model string, usd_per_mtok double, formula string")


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, long_edge int")


def rendered(width: Column, height: Column, edge: Column) -> tuple[Column, Column]:
    """Pixels of a page whose long edge is scaled to `edge`; 0 if its size is unknown."""
    known = (width > 0) & (height > 0)
    scale = edge / F.greatest(width, height)
    return tuple(F.when(known, F.greatest(F.bround(side * scale), F.lit(1)).cast("int")).otherwise(0) for side in (width, height))


def image_tokens(formula: Column, w: Column, h: Column) -> Column:
    """Tokens of an image of w x h pixels: by area, by tiles after fitting, or flat up to a side and by tiles beyond."""
    area = F.bround(F.least(w * h / AREA_DIVISOR, F.lit(AREA_CAP)))
    fit = F.least(F.lit(1.0), TILE_LONG / F.greatest(w, h), TILE_SHORT / F.least(w, h))
    fw, fh = (F.greatest(F.bround(side * fit), F.lit(1)) for side in (w, h))
    tiled = TILE_BASE + TILE_EACH * F.ceil(fw / TILE) * F.ceil(fh / TILE)
    flat = F.when((w <= FLAT_SIDE) & (h <= FLAT_SIDE), FLAT).otherwise(F.ceil(w / FLAT_SIDE) * F.ceil(h / FLAT_SIDE) * FLAT)
    return F.when((w <= 0) | (h <= 0), 0).when(formula == "width_height", area).when(formula == "tiled", tiled).when(formula == "flat", flat).cast("long")


def text_costs(docs: DataFrame, prices: DataFrame) -> DataFrame:
    """(document, model, tokens, usd) of docs (document, text); null where there is no text."""
    t = docs.select("document", tokens_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    return t.crossJoin(F.broadcast(prices)).select("document", "model", "tokens", F.when(F.col("tokens") > 0, F.col("tokens") / 1e6 * F.col("usd_per_mtok")).alias("usd"))  # prices are a few rows


def vision_costs(sizes: DataFrame, prices: DataFrame, resolutions: DataFrame) -> DataFrame:
    """(document, page, model, preset, tokens, usd) of pages (document, page, width_pt, height_pt)."""
    rows = sizes.crossJoin(F.broadcast(prices)).crossJoin(F.broadcast(resolutions))  # a few rows each
    w, h = rendered(F.col("width_pt"), F.col("height_pt"), F.col("long_edge"))
    rows = rows.withColumns({"w": w, "h": h})
    tokens = image_tokens(F.col("formula"), F.col("w"), F.col("h"))
    return rows.select("document", "page", "model", "preset", tokens.alias("tokens"), (tokens / 1e6 * F.col("usd_per_mtok")).alias("usd"))


def cheapest(costs: DataFrame, *by: str) -> DataFrame:
    """The least cost of each document over models, and the model (the first by name among equals)."""
    return costs.where("usd is not null").groupBy("document", *by).agg(F.min("usd").alias("usd"), F.min_by("model", F.struct("usd", "model")).alias("model"))


def folder(costs: DataFrame) -> DataFrame:
    """Per model: documents with a cost and their total."""
    return costs.groupBy("model").agg(F.count("usd").alias("documents"), F.bround(F.sum("usd"), 9).alias("usd"))


def volume(costs: DataFrame, monthly: int = 10_000) -> DataFrame:
    """Per model: the mean cost of a document carried on to a month's and a year's number."""
    g = costs.groupBy("model").agg(F.avg("usd").alias("mean"))
    return g.select("model", F.bround(F.col("mean") * monthly, 6).alias("monthly_usd"), F.bround(F.col("mean") * monthly * 12, 6).alias("annual_usd"))


def architectures(pages: DataFrame, costs: DataFrame) -> DataFrame:
    """Per model and way of reading: documents reached, share of all, total and per 1,000. `text_layer` reads documents with
    text of their own, `text_ocr` those with any text."""
    kind = pages.groupBy("document").agg(F.max((F.col("text_source") == "native").cast("int")).alias("native"), F.max((F.col("text_source") != "none").cast("int")).alias("some"))
    n = kind.agg(F.count(F.lit(1)).alias("all"))
    ways = F.array(F.when(F.col("native") == 1, "text_layer"), F.when(F.col("some") == 1, "text_ocr"))
    rows = costs.where("usd is not null").join(kind, "document").select("model", "usd", F.explode(ways).alias("architecture")).where("architecture is not null")
    g = rows.groupBy("model", "architecture").agg(F.count(F.lit(1)).alias("documents"), F.sum("usd").alias("usd")).crossJoin(F.broadcast(n))  # one row
    return g.select("model", "architecture", "documents", F.bround(F.col("documents") / F.col("all") * 100, 2).alias("reach_pct"), F.bround("usd", 9).alias("usd"), F.bround(F.col("usd") / F.col("documents") * 1000, 9).alias("usd_per_1000"))


def parser_cost(pages: Column, usd_per_1000: Column) -> Column:
    return F.bround(pages * usd_per_1000 / 1000, 4)


def stale(verified: Column, as_of: str, days: int = 90) -> Column:
    """Never verified, or longer ago than `days`."""
    return verified.isNull() | (F.datediff(F.lit(as_of).cast("date"), verified) > days)
