"""Readiness signals: one row per document and signal. A signal that cannot be measured has a null value and a reason."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.functions import text as X
from paperweir.functions.fixed import BANDS, RATING_POINTS, SIGNALS
from paperweir.sources.tables import full_text

# Least characters, words and dates for a rate to mean anything; date families (case counts).
MIN_CHARS, MIN_WORDS, MIN_DATES, MIN_PAGES = 200, 100, 3, 3
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE_FAMILIES = [
    "\\b(?:19|20)\\d{2}-\\d{1,2}-\\d{1,2}\\b",
    "\\b\\d{1,2}/\\d{1,2}/(?:19|20)?\\d{2}\\b",
    "\\b\\d{1,2}\\.\\d{1,2}\\.(?:19|20)?\\d{2}\\b",
    "\\b\\d{1,2}-\\d{1,2}-(?:19|20)?\\d{2}\\b",
    "\\b\\d{1,2}\\s+" + MONTH + "\\s+(?:19|20)\\d{2}\\b",
    "\\b" + MONTH + "\\s+\\d{1,2},?\\s+(?:19|20)\\d{2}\\b",
]
_WEIGHTS = {s[0]: s[1] for s in SIGNALS}
#: Formats that a signal applies to; others are not applicable. All formats where none is named.
APPLIES = {
    "encrypted": ["pdf"], "text_layer_coverage_pct": ["pdf", "image"], "image_area_ratio_pct": ["pdf", "image"], "column_count": ["pdf"],
    "page_rotation": ["pdf", "image"], "skew_angle": ["pdf", "image"], "ocr_confidence": ["pdf", "image"], "scan_dpi": ["pdf", "image"],
    "font_count": ["pdf", "docx"], "fonts_embedded": ["pdf"], "page_size_variance": ["pdf"], "acroform_fields": ["pdf"],
}


def _between(mark: str):
    return lambda text: F.contains(text, F.lit(mark)) & F.rlike(text, F.lit(f"\\p{{Nd}}[{mark}]\\p{{Nd}}"))


def _month(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in re.findall("[A-Z][a-z]{2}", MONTH)])


#: Per family of dates a cheap test that a text with one of it passes.
_MAY = [_between("-"), _between("/"), _between("."), _between("-"), _month, _month]


def _with(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f asks for it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def run_together(text: Column) -> Column:
    """Words that look like several whose spaces were lost."""
    long = F.filter(F.regexp_extract_all(text, F.lit("(?U)\\S{15,}"), F.lit(0)), lambda t: F.rlike(t, F.lit("(?U)\\p{L}")))
    camel = F.filter(long, lambda t: (F.regexp_count(t, F.lit("[a-z][A-Z]")) >= 2) | ((F.length(t) >= 25) & F.rlike(t, F.lit("^\\p{L}+$"))))
    return F.size(camel)


def garbled(text: Column) -> Column:
    found = F.regexp_count(text, F.lit("[\\x{FFFD}\\x{FB00}-\\x{FB06}]")) + run_together(text)
    return F.when(F.length(text) >= MIN_CHARS, F.bround(found / F.length(text) * 1000, 2))


def unmapped(text: Column) -> Column:
    found = F.regexp_count(text, F.lit("\\(cid:\\d+\\)|[\\x{E000}-\\x{F8FF}]|[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"))
    return F.when(F.length(text) >= MIN_CHARS, F.bround(found / F.length(text) * 1000, 2))


def hyphenated(text: Column) -> Column:
    breaks = F.regexp_count(text, F.lit("[a-z]{2,}-[ \\t]*\\n[ \\t]*[a-z]{2,}"))
    breaks = F.when(F.contains(text, F.lit("\n")) & F.rlike(text, F.lit("-[ \\t]*\\n")), breaks).otherwise(F.lit(0))
    return _with(F.regexp_count(text, F.lit("(?U)\\w+")), lambda words: F.when(words >= MIN_WORDS, F.bround(breaks / words * 1000, 2)))


def date_consistency(text: Column) -> Column:
    counts = F.array(*[F.when(may(text), F.regexp_count(text, F.lit("(?U)" + f))).otherwise(F.lit(0)) for f, may in zip(DATE_FAMILIES, _MAY)])

    def share(n):
        total = F.aggregate(n, F.lit(0), lambda a, x: a + x)
        return F.when(total >= MIN_DATES, F.bround(F.array_max(n) / total * 100, 2))

    return F.when(text.isNotNull(), _with(counts, share))


def text_signals(pages: DataFrame) -> DataFrame:
    """(document, format, signal, value, reason) of the signals that need a document's text."""
    t = F.col("text")
    few = F.concat(F.lit("only "), F.length(t).cast("string"), F.lit(" characters of text were available"))
    rows = F.array(
        F.struct(F.lit("garbled_char_rate").alias("signal"), garbled(t).alias("value"), few.alias("why")),
        F.struct(F.lit("unmapped_glyphs").alias("signal"), unmapped(t).alias("value"), few.alias("why")),
        F.struct(F.lit("hyphenated_line_breaks").alias("signal"), hyphenated(t).alias("value"), F.lit("too few words of text were available").alias("why")),
        F.struct(F.lit("date_format_consistency").alias("signal"), date_consistency(t).alias("value"), F.lit("too few dates were found").alias("why")),
    )
    s = full_text(pages).select("document", "format", F.explode_outer(rows).alias("s"))
    return s.select("document", "format", "s.signal", "s.value", F.when(F.col("s.value").isNull(), F.col("s.why")).alias("reason"))


def text_layer(pages: DataFrame) -> DataFrame:
    """Whether any page has text of its own; not measured where a loader supplied a page's text."""
    native = F.max((F.col("text_source") == "native").cast("int"))
    loader = F.max((F.col("text_source") == "loader").cast("int"))
    rows = pages.groupBy("document", "format").agg(native.alias("n"), loader.alias("l"))
    value = F.when(F.col("l") == 0, F.col("n").cast("double"))
    return rows.select("document", "format", F.lit("text_layer_present").alias("signal"), value.alias("value"), F.when(value.isNull(), "a loader supplied the text").alias("reason"))


def repeated_lines(pages: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Share of characters in lines that stand, digits aside, on at least max(2, half) of a document's text pages."""
    used = pages.where(F.rlike("text", F.lit("(?U)\\S")))
    per = used.groupBy("document", "format").agg(F.count(F.lit(1)).alias("n"))
    line = used.select("document", "page", F.explode(X.lines(F.col("text"))).alias("line")).where(F.length(X.strip(F.col("line"))) >= 3)
    line = line.select("document", "page", F.length(X.squeeze(F.col("line"))).alias("chars"), X.casefold(F.regexp_replace(X.squeeze(F.col("line")), "(?U)\\d+", "#")).alias("key"))
    keys = line.groupBy("document", "key").agg(F.countDistinct("page").alias("seen"), F.sum("chars").alias("chars"))
    share = keys.join(per, "document").groupBy("document").agg(
        F.sum(F.when(F.col("seen") >= F.greatest(F.lit(2), F.ceil(F.col("n") * min_share)), F.col("chars")).otherwise(0)).alias("again"), F.sum("chars").alias("total")
    )
    rows = per.join(share, "document", "left")
    value = F.when(F.col("n") >= MIN_PAGES, F.coalesce(F.bround(F.col("again") / F.col("total") * 100, 2), F.lit(0.0)))
    return rows.select("document", "format", F.lit("repeated_page_lines").alias("signal"), value.alias("value"), F.when(value.isNull(), "too few pages carried text").alias("reason"))


def page_signals(layout: DataFrame) -> DataFrame:
    """Signals of page geometry, from pages with width_pt, height_pt, rotation, fonts, ocr_confidence, fonts_embedded,
    text_share and image_share (of the page's area), columns, dpi and skew; each null where it was not recorded."""
    area = F.col("width_pt") * F.col("height_pt") > 0
    g = layout.groupBy("document", "format").agg(
        F.bround(F.avg(F.when(area, F.col("text_share"))) * 100, 2).alias("text_layer_coverage_pct"),
        F.bround(F.avg(F.when(area, F.col("image_share"))) * 100, 2).alias("image_area_ratio_pct"),
        F.max(F.abs("rotation") % 360).cast("double").alias("page_rotation"),
        F.bround(F.min("ocr_confidence") * 100, 2).alias("ocr_confidence"),
        F.nullif(F.size(F.array_distinct(F.flatten(F.collect_list("fonts")))), F.lit(0)).cast("double").alias("font_count"),
        F.min(F.col("fonts_embedded").cast("int")).cast("double").alias("fonts_embedded"),
        F.countDistinct(F.bround("width_pt", 0), F.bround("height_pt", 0)).cast("double").alias("page_size_variance"),
        F.max("columns").cast("double").alias("column_count"), F.min("dpi").cast("double").alias("scan_dpi"), F.max(F.abs("skew")).alias("skew_angle"),
    )
    names = [c for c in g.columns if c not in ("document", "format")]
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in names])
    out = g.select("document", "format", F.explode(rows).alias("s")).select("document", "format", "s.signal", "s.value")
    return out.withColumn("reason", F.when(F.col("value").isNull(), "no page recorded it"))


def table_signals(tables: DataFrame) -> DataFrame:
    """Count, deepest header and merged cells of ruled tables (document, format, header_depth, merged_cells, detected_by)."""
    ruled = F.col("detected_by") == "lines"
    g = tables.groupBy("document", "format").agg(
        F.count_if(ruled).cast("double").alias("table_count"), F.max(F.when(ruled, F.col("header_depth"))).cast("double").alias("table_max_header_depth"),
        F.sum(F.when(ruled, F.col("merged_cells"))).cast("double").alias("table_merged_cells"),
    )
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("value")) for n in ("table_count", "table_max_header_depth", "table_merged_cells")])
    out = g.select("document", "format", F.explode(rows).alias("s")).select("document", "format", "s.signal", "s.value")
    return out.withColumn("reason", F.when(F.col("value").isNull(), "no ruled table was found"))


def _holds(rule: dict | None, value: Column) -> Column:
    if rule is None:
        return F.lit(False)
    (kind, bound), = rule.items()
    bound = float(bound)
    return {"eq": value == bound, "gte": value >= bound, "gt": value > bound, "lt": value < bound, "lte": value <= bound}[kind]


def rated(signals: DataFrame) -> DataFrame:
    """signals with status, rating (the first of good, fair, poor whose threshold holds) and weight."""
    v, rating, weight, applies = F.col("value"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(True)
    for name, w, *rules in SIGNALS:
        mine = reduce(lambda c, r: c.when(_holds(r[1], v), r[0]), zip(("good", "fair", "poor"), rules), F.when(F.lit(False), ""))
        rating = F.when(F.col("signal") == name, mine).otherwise(rating)
        weight = F.when(F.col("signal") == name, F.lit(w)).otherwise(weight)
        if name in APPLIES:
            applies = F.when(F.col("signal") == name, F.col("format").isin(APPLIES[name])).otherwise(applies)
    s = signals.withColumn("applies", applies)
    status = F.when(~F.col("applies"), "not_applicable").when(v.isNull(), "not_applicable").otherwise("measured")
    return s.select("document", "format", "signal", status.alias("status"), F.when(F.col("applies"), v).alias("value"), F.when(F.col("applies") & v.isNotNull(), rating).alias("rating"), weight.alias("weight"), F.when(~F.col("applies"), "does not apply to this format").otherwise(F.col("reason")).alias("reason"))


def band(score: Column) -> Column:
    return reduce(lambda c, b: c.when(score >= b[0], b[1]), BANDS[:-1], F.when(F.lit(False), "")).otherwise(BANDS[-1][1])


def scores(signals: DataFrame) -> DataFrame:
    """(document, score, label, counted, low_confidence): weighted points of the rated signals, weights renormalised."""
    points = reduce(lambda c, r: c.when(F.col("rating") == r, RATING_POINTS[r]), RATING_POINTS, F.when(F.lit(False), 0.0))
    counts = (F.col("status") == "measured") & points.isNotNull() & (F.col("weight") > 0)
    g = signals.groupBy("document").agg(
        F.sum(F.when(counts, F.col("weight") * points)).alias("p"), F.sum(F.when(counts, F.col("weight"))).alias("w"),
        F.count_if(counts).alias("counted"), F.count(F.lit(1)).alias("total"),
    )
    score = F.bround(F.bround(F.col("p") / F.col("w") * 100, 9), 1)
    return g.select("document", score.alias("score"), F.when(score.isNotNull(), band(score)).alias("label"), "counted", (F.col("counted") < F.col("total") / 2).alias("low_confidence"))


def distribution(scored: DataFrame) -> DataFrame:
    """Documents per band."""
    return scored.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("documents"))


def rating_distribution(signals: DataFrame) -> DataFrame:
    """Per signal the number of documents in each state."""
    state = F.coalesce("rating", "status")
    return signals.groupBy("signal", state.alias("state")).agg(F.count(F.lit(1)).alias("documents"))


def exposure(docs: DataFrame, matches: DataFrame, points: float = 4.0) -> DataFrame:
    """(document, exposure): 100 less the points of each match by severity and evidence, at least 0."""
    from paperweir.operators.identifiers import evidence_weight, severity_weight

    weight = severity_weight(F.col("severity")) * evidence_weight(F.col("evidence"))
    per = matches.groupBy("document").agg(F.sum(weight).alias("w"))
    value = F.bround(F.greatest(F.lit(0.0), 100 - F.coalesce("w", F.lit(0.0)) * points), 1)
    return docs.select("document").distinct().join(per, "document", "left").select("document", value.alias("exposure"))


def cost_factor(pages: DataFrame, recognised: float = 60.0) -> DataFrame:
    """(document, cost): 100 for each page with text, `recognised` for one that was recognised, 0 for a blank one; the mean."""
    points = F.when(F.col("text_source").isin("native", "loader"), 100.0).when(F.col("text_source") == "ocr", recognised).otherwise(0.0)
    return pages.groupBy("document").agg(F.bround(F.avg(points), 1).alias("cost"))


def overall(content: DataFrame, cost: DataFrame, exposed: DataFrame) -> DataFrame:
    """(document, content, cost, exposure, global_score): factors weighted .5, .25 and .25, over those that were measured."""
    rows = content.select("document", F.col("score").alias("content")).join(cost, "document", "full_outer").join(exposed, "document", "full_outer")
    parts = [("content", 0.5), ("cost", 0.25), ("exposure", 0.25)]
    top = reduce(lambda a, b: a + b, [F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts])
    low = reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts])
    return rows.select("document", "content", "cost", "exposure", F.when(low > 0, F.bround(F.bround(top / low, 9), 1)).alias("global_score"))


def column_count(blocks: DataFrame) -> DataFrame:
    """(document, page, columns) of pages with at least 25 text blocks (document, page, width_pt, x0, x1): gaps of 7 or more
    of 200 strips that no block touches, between strips that one does, part columns."""
    bins = 200
    lo = F.greatest(F.floor(F.col("x0") / F.col("width_pt") * bins), F.lit(0)).cast("int")
    hi = F.least(F.ceil(F.col("x1") / F.col("width_pt") * bins) - 1, F.lit(bins - 1)).cast("int")
    strip = blocks.where("width_pt > 0").select("document", "page", F.explode(F.when(hi >= lo, F.sequence(lo, hi))).alias("b")).distinct()
    many = blocks.groupBy("document", "page").agg(F.count(F.lit(1)).alias("n")).where("n >= 25")
    gap = F.col("b") - F.lag("b").over(Window.partitionBy("document", "page").orderBy("b")) - 1
    return strip.join(many, ["document", "page"]).withColumn("gap", gap).groupBy("document", "page").agg((F.count_if(F.col("gap") >= 7) + 1).alias("columns"))


def coverage(boxes: DataFrame, grid: int = 240) -> DataFrame:
    """(document, page, share): the part of a page that its boxes (document, page, width, height, x0, y0, x1, y1) cover, on a
    grid on which every cell that a box touches counts once. Boxes without area and pages without size cover nothing. A box
    is cut into its rows of cells, and a row's cells are the union of its boxes', so that no cell is ever a row of data."""
    area = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("width") > 0) & (F.col("height") > 0)
    inside = lambda c: F.greatest(F.lit(0), F.least(F.lit(grid), c)).cast("int")
    low = lambda c, size: inside(F.col(c).cast("double") * (F.lit(float(grid)) / F.col(size)))
    high = lambda c, size: inside(F.ceil(F.col(c).cast("double") * (F.lit(float(grid)) / F.col(size))))
    rows = boxes.where(area).select("document", "page", low("x0", "width").alias("a"), high("x1", "width").alias("b"), low("y0", "height").alias("c"), high("y1", "height").alias("d")).where("b > a and d > c")
    lines = rows.select("document", "page", F.struct("a", "b").alias("s"), F.explode(F.sequence(F.col("c"), F.col("d") - 1)).alias("line"))
    spans = lines.groupBy("document", "page", "line").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda t, s: F.struct(F.greatest(t["to"], s["b"]).alias("to"), (t["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(t["to"], s["a"]))).alias("n"))
    cells = spans.select("document", "page", F.aggregate("spans", start, step, lambda t: t["n"]).alias("n")).groupBy("document", "page").agg(F.sum("n").alias("n"))
    return boxes.select("document", "page").distinct().join(cells, ["document", "page"], "left").select("document", "page", (F.coalesce("n", F.lit(0)) / float(grid * grid)).alias("share"))


# What a page must hold for its language to be told.
LEAST_LETTERS, LEAST_SHARE = 60, 0.5
# Frequent words of languages.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine den von mit sich auf für im dem zu des wird sind auch als bei nach",
    "en": "the of and to in is that it for was on are with as his they be at this have from or by not",
    "es": "el la los las de y que en un una es se no por con para su al lo como más del este",
    "fr": "le la les des et est un une dans que qui pour pas sur au avec il elle ce du par plus sont",
    "it": "il di che è la e un una per non con sono le del della si da come più anche nel alla gli",
    "nl": "de het een en van is dat niet op te in zijn voor met aan er maar ook als bij naar door",
    "pt": "o a os as de e que em um uma é não para com por do da se mais como dos no ao",
}


def language(text: Column) -> Column:
    """The language whose frequent words a text holds most of (of equals the first by name), or null where it has under 60
    letters, or letters are under half of its characters, or none of these words stands in it."""
    t = X.strip(text)
    letters = F.length(F.regexp_replace(t, "(?U)[^\\p{L}]", ""))
    words = F.regexp_extract_all(F.lower(t), F.lit("(?U)\\p{L}+"), F.lit(0))

    def held(own: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(own.split())))

    counts = [F.struct(held(own).alias("n"), F.lit(-i).alias("turn"), F.lit(code).alias("code")) for i, (code, own) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*counts))
    return F.when((letters >= LEAST_LETTERS) & (letters >= LEAST_SHARE * F.length(t)) & (best["n"] > 0), best["code"])


def language_count(pages: DataFrame, detect=language) -> DataFrame:
    """The signal language_count: distinct languages of a document's pages of prose. detect: text column to language column."""
    g = pages.select("document", "format", detect(F.col("text")).alias("l")).groupBy("document", "format").agg(F.countDistinct("l").cast("double").alias("n"))
    none = F.col("n") == 0
    return g.select("document", "format", F.lit("language_count").alias("signal"), F.when(~none, F.col("n")).alias("value"), F.when(none, "no page carried enough prose").alias("reason"))


def folder_readiness(scored: DataFrame) -> DataFrame:
    """One row for a folder from overall(): the mean global score and its band, the mean of each factor, and documents scored and
    in all. A folder without any score has nulls."""
    g = scored.agg(*[F.bround(F.avg(c), 1).alias(c) for c in ("global_score", "content", "cost", "exposure")], F.count("global_score").alias("scored"), F.count(F.lit(1)).alias("documents"))
    return g.withColumn("label", F.when(F.col("global_score").isNotNull(), band(F.col("global_score"))))


def encrypted(files: DataFrame) -> DataFrame:
    """The signal encrypted of binary files (document, format, content): a PDF whose trailer names an encryption dictionary, or an
    Office file in the container that password protection puts it in."""
    head = F.hex(F.substring("content", 1, 8))
    pdf = F.contains(F.decode("content", "ISO-8859-1"), F.lit("/Encrypt"))
    held = F.when(F.col("format") == "pdf", pdf).when(F.col("format").isin("docx", "xlsx", "pptx"), head == "D0CF11E0A1B11AE1")
    return files.select("document", "format", F.lit("encrypted").alias("signal"), held.cast("double").alias("value"), F.when(held.isNull(), "the format has no encryption").alias("reason"))
