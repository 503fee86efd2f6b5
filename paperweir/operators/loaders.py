"""Loader output as documents, its metadata, and what loaders make of the same documents."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperweir.operators import identifiers as I
from paperweir.operators.chunks import ABSOLUTE_PATH

# Metadata keys that name a source, in order.
SOURCE_KEYS = ["source", "file_path", "filename", "file_name"]


def _first(metadata: str) -> Column:
    return F.coalesce(*[F.try_element_at(metadata, F.lit(k)) for k in SOURCE_KEYS])


def as_pages(items: DataFrame) -> DataFrame:
    """(document, page, text, page_count_known) of items (ord, text, metadata MAP): grouped by source, page = page_number, or
    page + 1, at least 1; an item without a number follows the highest page before it. Texts of a page join by a blank line."""
    number = F.coalesce(F.try_element_at("metadata", F.lit("page_number")).try_cast("int"), F.try_element_at("metadata", F.lit("page")).try_cast("int") + 1)
    rows = items.select("ord", F.coalesce(_first("metadata"), F.lit("document")).alias("document"), "text", F.greatest(number, F.lit(1)).alias("given"))
    listed = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("ord", "given", "text"))).alias("items"))
    kind = "struct<top:int,out:array<struct<ord:bigint,page:int,text:string>>>"
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<struct<ord:bigint,page:int,text:string>>").alias("out")).cast(kind)

    def step(a, x):
        page = F.coalesce(x["given"], a["top"] + 1)
        return F.struct(F.greatest(a["top"], page).alias("top"), F.concat(a["out"], F.array(F.struct(x["ord"].cast("long").alias("ord"), page.alias("page"), x["text"].alias("text")))).alias("out")).cast(kind)

    known = F.exists("items", lambda x: x["given"].isNotNull())
    placed = listed.select("document", known.alias("page_count_known"), F.explode(F.aggregate("items", start, step)["out"]).alias("i"))
    g = placed.groupBy("document", "page_count_known", F.col("i.page").alias("page")).agg(F.array_sort(F.collect_list(F.struct("i.ord", "i.text"))).alias("t"))
    return g.select("document", "page", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"), "page_count_known")


def metadata_values(items: DataFrame) -> DataFrame:
    """(document, key, value): each distinct value of 4 letters or digits or more, once per document."""
    rows = items.select(F.coalesce(_first("metadata"), F.lit("document")).alias("document"), F.explode(F.map_entries("metadata")).alias("m"))
    rows = rows.select("document", "m.key", "m.value").where(F.length(F.regexp_replace("value", "(?U)[^\\p{L}\\p{N}]", "")) >= 4)
    return rows.distinct()


def scan_metadata(items: DataFrame, categories=None) -> DataFrame:
    """Identifiers in metadata: (document, key, category, label, severity, evidence, masked, significant)."""
    v = metadata_values(items).withColumn("text", F.col("value"))
    found = I.scan(v, ["document", "key", "value"], categories)
    weak = (F.col("severity") == "low") & (F.col("evidence") == "model")
    return found.select("document", "key", "category", "label", "severity", "evidence", "masked", (~weak).alias("significant"))


def path_exposure(items: DataFrame) -> DataFrame:
    """(document, keys): metadata keys whose value is an absolute path."""
    v = metadata_values(items).where(F.rlike("value", F.lit(ABSOLUTE_PATH)))
    return v.groupBy("document").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def identifier_differences(found: DataFrame, present: DataFrame) -> DataFrame:
    """(document, location, category, severity, masked, found_by, missed_by) of identifiers that not every loader that has the
    document found. found: (loader, document, location, category, severity, masked); present: (loader, document)."""
    have = present.groupBy("document").agg(F.array_sort(F.collect_set("loader")).alias("all")).where(F.size("all") > 1)
    by = found.groupBy("document", "location", "category", "severity", "masked").agg(F.array_sort(F.collect_set("loader")).alias("found_by"))
    out = by.join(have, "document").withColumn("missed_by", F.array_except("all", "found_by"))
    return out.where(F.size("missed_by") > 0).drop("all")


def uneven_documents(present: DataFrame, loaders: int) -> DataFrame:
    """(document, loaders): documents that some loaders do not have."""
    return present.groupBy("document").agg(F.array_sort(F.collect_set("loader")).alias("loaders")).where(F.size("loaders") < loaders)


def uneven_keys(keys: DataFrame, loaders: int) -> DataFrame:
    """(key, spellings, loaders): metadata keys, case aside, that some loaders do not give, or spell differently."""
    g = keys.groupBy(F.lower("key").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("key")), " / ").alias("spellings"), F.countDistinct("loader").alias("loaders"))
    return g.where((F.col("loaders") < loaders) | F.contains("spellings", F.lit(" / ")))


def readings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(document, similarity, reordered): the least similar page of two loaders' pages; a page that one lacks is empty there.
    reordered: every page that differs holds the same words in another order."""
    from paperweir.functions.text import same_words
    from paperweir.operators.retrieval import reading_similarity

    pairs = a.select("document", "page", F.col("text").alias("a")).join(b.select("document", "page", F.col("text").alias("b")), ["document", "page"], "full_outer").fillna("", ["a", "b"])
    s = reading_similarity(pairs).withColumn("moved", same_words(F.col("a"), F.col("b")))
    differ = F.col("similarity") < 1
    return s.groupBy("document").agg(F.min("similarity").alias("similarity"), (F.coalesce(F.min(F.when(differ, F.col("moved").cast("int"))), F.lit(0)) == 1).alias("reordered"))


def summary(pages: DataFrame, found: DataFrame, metadata: DataFrame | None = None, scores: DataFrame | None = None, costs: DataFrame | None = None, facts: DataFrame | None = None, runs: DataFrame | None = None, paths: DataFrame | None = None, baseline: str | None = None) -> DataFrame:
    """A row per loader with its totals, in the columns of the loaders table and a few more. What was not given is null, not 0.

    pages: (loader, document, page, text); found: (loader, ...) matches in text; metadata: (loader, key, ...) matches in it;
    scores: (loader, document, readiness_score, global_score); costs: (loader, usd); facts: evaluate_facts(); paths: (loader,
    document) with absolute paths; runs: (loader, tags, seconds, network_allowed, network_attempts, error, failed_files,
    cached_files, metadata_keys, parser_usd_per_1000)."""
    g = pages.groupBy("loader").agg(F.countDistinct("document").alias("documents"), F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("characters"))

    def add(g, rows, *aggs):
        names = [n for n, _ in aggs]
        if rows is None:
            return g.withColumns({n: F.lit(None).cast("double" if "score" in n or "usd" in n else "long") for n in names})
        own = rows.groupBy("loader").agg(*[c.alias(n) for n, c in aggs])
        return g.join(own, "loader", "left").fillna(0, [n for n in names if "score" not in n and "usd" not in n])

    n = F.count(F.lit(1))
    g = add(g, found, ("identifiers_in_text", n))
    g = add(g, metadata, ("identifiers_in_metadata", n))
    g = add(g, paths, ("documents_with_paths", F.countDistinct("document")))
    g = add(g, scores, ("readiness_score", F.bround(F.avg("readiness_score"), 1)), ("global_score", F.bround(F.avg("global_score"), 1)))
    g = add(g, costs, ("text_path_usd", F.bround(F.sum("usd"), 9)))
    g = add(g, facts, ("facts_found", F.count("found")))
    extra = {"tags": "string", "seconds": "double", "network_allowed": "boolean", "network_attempts": "long", "error": "string", "failed_files": "long", "cached_files": "long", "metadata_keys": "long", "parser_usd_per_1000": "double"}
    if runs is None:
        g = g.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    else:
        g = g.join(runs.select("loader", *[F.col(c) if c in runs.columns else F.lit(None).cast(t).alias(c) for c, t in extra.items()]), "loader", "left")
    g = g.withColumn("parser_usd", F.bround(F.col("pages") * F.col("parser_usd_per_1000") / 1000, 4)).drop("parser_usd_per_1000")
    return g.withColumn("baseline", F.col("loader") == F.lit(baseline) if baseline else F.lit(None).cast("boolean"))


def compare_loaders(pages: DataFrame, baseline: str, categories=None, facts: list | None = None, threshold: float = 0.9, runs: DataFrame | None = None) -> dict[str, DataFrame]:
    """What loaders make of the same documents. pages: (loader, document, page, text). Tables: loaders (summary), differences
    (identifiers that not every loader that has the document found), documents (that some lack), readings (per document and
    other loader its similarity to the baseline's) and, if facts are given, facts. Under two loaders is a ValueError."""
    names = [r["loader"] for r in pages.select("loader").distinct().orderBy("loader").collect()]
    if len(names) < 2 or baseline not in names:
        raise ValueError(f"a comparison takes two loaders and one of them as baseline; there are {', '.join(names) or 'none'}")
    found = I.scan(pages, ["loader", "document", "page"], categories)
    placed = found.select("loader", "document", F.lit("text").alias("location"), "category", "severity", "evidence", "masked")
    have = pages.select("loader", "document").distinct()
    ours = pages.where(F.col("loader") == baseline)
    read = [readings(ours, pages.where(F.col("loader") == other)).withColumn("loader", F.lit(other)) for other in names if other != baseline]
    checked = None
    if facts:
        from paperweir.operators.retrieval import evaluate_facts

        checked = evaluate_facts(pages, facts, threshold)
    out = {"loaders": summary(pages, found, facts=checked, runs=runs, baseline=baseline), "differences": identifier_differences(placed, have), "documents": uneven_documents(have, len(names))}
    out["readings"] = reduce(lambda a, b: a.unionByName(b), read)
    return out | ({"facts": checked} if checked is not None else {})


def shares(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """Places of each group: its whole share, then one at a time where most of a share is left over; where there are as many
    places as groups, one for each group without any, taken one at a time from the group that then has most. Ties go to the
    group that comes first."""
    total = sum(sizes.values())
    claim = {k: n * limit / total for k, n in sizes.items()}
    places = {k: min(sizes[k], math.floor(c)) for k, c in claim.items()}
    while (free := limit - sum(places.values())) > 0 and (open_ := [k for k in places if places[k] < sizes[k]]):
        for k in sorted(open_, key=lambda k: places[k] - claim[k])[:free]:
            places[k] += 1
    if limit >= len(sizes):
        for k in sorted((k for k in places if not places[k]), key=claim.get):
            giver = max(places, key=places.get)
            if places[giver] > 1:
                places[giver], places[k] = places[giver] - 1, 1
    return places


def sample(files: DataFrame, limit: int) -> DataFrame:
    """(ext, ord, path) of `limit` files: in proportion to the files of each extension, at least one of each if the limit allows,
    evenly spaced within an extension; all if the limit is none or as large as their number. files: (ord, path, ext). The driver
    holds a count per extension; an extension is ranked block by block of ord."""
    rows = files.select("ext", "ord", "path")
    groups = rows.groupBy("ext").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first")).orderBy("first", "ext").collect()
    sizes = {r["ext"]: r["n"] for r in groups}
    if limit <= 0 or limit >= sum(sizes.values()):
        return rows
    taken = rows.sparkSession.createDataFrame([(k, sizes[k], n) for k, n in shares(sizes, limit).items() if n], "own string, n long, take long")
    own = rows.withColumn("block", F.floor(F.col("ord") / 65536))
    before = F.sum("m").over(Window.partitionBy("ext").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    bases = own.groupBy("ext", "block").agg(F.count(F.lit(1)).alias("m")).select("ext", "block", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("ext", "block").orderBy("ord", "path")) - 1
    placed = own.withColumn("rank", rank).join(bases, ["ext", "block"]).withColumn("place", F.col("base") + F.col("rank"))
    placed = placed.join(F.broadcast(taken), F.col("ext").eqNullSafe(F.col("own")))  # a row per extension
    # Place p is one of floor(i n / take), i below take, if the next i after p take / n gives p back.
    i = F.ceil(F.col("place") * F.col("take") / F.col("n"))
    return placed.where((i < F.col("take")) & (F.floor(i * F.col("n") / F.col("take")) == F.col("place"))).select("ext", "ord", "path")


def strip_paths(items: DataFrame) -> DataFrame:
    """items whose absolute paths in metadata are cut to their last part."""
    base = F.transform_values("metadata", lambda _, v: F.when(F.rlike(v, F.lit(ABSOLUTE_PATH)), F.regexp_extract(v, "([^/\\\\]*)[/\\\\]*$", 1)).otherwise(v))
    return items.withColumn("metadata", base)
