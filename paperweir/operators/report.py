"""Report tables, the difference of two reports, expectations and quick wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperweir.functions import text as X

# The eleven tables of a report and their columns.
TABLES = {
    "documents": ["document", "format", "pages", "page_count_known", "readiness_score", "readiness_label", "global_score", "identifiers", "hidden_passages", "hidden_high", "visibility_checked", "load_warnings", "seconds"],
    "pages": ["document", "page", "source", "characters", "truncated", "text"],
    "identifiers": ["document", "page", "line", "category", "label", "severity", "evidence", "value", "confidence"],
    "signals": ["document", "signal", "name", "status", "value", "display", "rating", "weight", "reason"],
    "hidden": ["document", "page", "visibility", "instruction", "severity", "hidden_reasons", "instruction_reasons", "excerpt", "score", "in_loader_output"],
    "metadata": ["document", "key", "category", "label", "severity", "evidence", "value", "significant"],
    "limitations": ["area", "severity", "statement", "affected"],
    "quick_wins": ["id", "title", "actor", "documents", "effect", "saving_usd_per_1000"],
    "loaders": ["loader", "tags", "baseline", "documents", "pages", "characters", "seconds", "network_allowed", "network_attempts", "error", "metadata_keys", "identifiers_in_text", "identifiers_in_metadata", "readiness_score", "global_score", "failed_files", "cached_files", "facts_found", "parser_usd"],
    "differences": ["document", "category", "severity", "evidence", "location", "keys", "value", "found_by", "missed_by"],
    "facts": ["fact", "document", "loader", "found", "score", "page", "matched_document"],
}
#: Characters of a page that a report keeps; the column truncated says where there were more. Operators read whole pages.
PAGE_CHARACTERS = 20_000


def table(rows: DataFrame, name: str) -> DataFrame:
    """rows in the columns of a report table; what rows do not have is null. An unknown name is a ValueError."""
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; there are {', '.join(TABLES)}")
    return rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in TABLES[name]])


def documents_table(pages: DataFrame, matches: DataFrame, scored: DataFrame, overall: DataFrame) -> DataFrame:
    p = pages.groupBy("document", "format").agg(F.count(F.lit(1)).alias("pages"))
    m = matches.groupBy("document").agg(F.count(F.lit(1)).alias("identifiers"))
    rows = p.join(scored.select("document", F.col("score").alias("readiness_score"), F.col("label").alias("readiness_label")), "document", "left")
    rows = rows.join(overall.select("document", "global_score"), "document", "left").join(m, "document", "left").fillna(0, ["identifiers"])
    return table(rows.withColumn("page_count_known", F.col("format").isin("pdf", "pptx", "xlsx")), "documents")


def pages_table(pages: DataFrame) -> DataFrame:
    n = F.length("text")
    return table(pages.withColumns({"source": F.col("text_source"), "characters": n, "truncated": n > PAGE_CHARACTERS}).withColumn("text", F.substring("text", 1, PAGE_CHARACTERS)), "pages")


def identifiers_table(matches: DataFrame) -> DataFrame:
    return table(matches.withColumn("value", F.coalesce("revealed", "masked")), "identifiers")


def changes(old: DataFrame, new: DataFrame, area: str = "identifiers") -> DataFrame:
    """(area, kind, document, subject, before, after, worse): counts of (document, subject) that differ, in documents of both.
    old, new: one row per finding (document, subject), and one with a null subject for a document without any."""
    both = old.select("document").distinct().join(new.select("document").distinct(), "document", "left_semi")
    a, b = (d.where("subject is not null").join(both, "document", "left_semi").groupBy("document", "subject").agg(F.count(F.lit(1)).alias(n)) for d, n in ((old, "before"), (new, "after")))
    rows = a.join(b, ["document", "subject"], "full_outer").fillna(0, ["before", "after"]).where("before <> after")
    worse = F.col("after") > F.col("before")
    return rows.select(F.lit(area).alias("area"), F.when(worse, "added").otherwise("removed").alias("kind"), "document", "subject", "before", "after", worse.alias("worse"))


def document_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document, kind) of documents that only one report has."""
    o, n = old.select("document").distinct(), new.select("document").distinct()
    return n.join(o, "document", "left_anti").withColumn("kind", F.lit("added")).unionByName(o.join(n, "document", "left_anti").withColumn("kind", F.lit("removed")))


def score_changes(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """(document, before, after, worse) where a score moved by `least` or more. old, new: (document, score)."""
    rows = old.select("document", F.col("score").alias("before")).join(new.select("document", F.col("score").alias("after")), "document")
    return rows.where(F.abs(F.col("after") - F.col("before")) >= least).withColumn("worse", F.col("after") < F.col("before"))


def aggregate(pages: DataFrame, matches: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: documents, pages, blank pages, identifiers, high ones, mean readiness score."""
    p = pages.agg(F.countDistinct("document").alias("documents"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("text_source") == "none").alias("blank_pages"))
    m = matches.agg(F.count(F.lit(1)).alias("identifiers"), F.count_if(F.col("severity") == "high").alias("high"))
    s = scored.agg(F.bround(F.avg("score"), 1).alias("mean_score"))
    return p.crossJoin(m).crossJoin(s)  # one row each


# Recommended actions, whose turn each is, and what it would change.
WINS = {
    "hidden_instructions": ("Remove hidden instructions before these reach a model", "you", "a model no longer receives instructions a reviewer cannot see"),
    "hidden_text": ("Review the text a reader does not see", "you", "what a model reads is what a reviewer sees"),
    "ocr_blank_pages": ("Read the pages nothing came off", "tool", "they would move onto the text path"),
    "supply_password": ("Supply a password for the encrypted files", "you", "they would be audited"),
    "unsupported_types": ("Decide what to do with the files that are not documents", "you", "they were not looked at, so nothing here describes them"),
    "unreadable_files": ("Replace the files that could not be opened", "you", "they are missing from every figure"),
    "route_reader": ("Read these with a different library", "you", "the text reaches a model in the order it was written"),
    "reader_disputed": ("Check what the readers disagreed about", "you", "the text may not be what the page says"),
    "high_severity": ("Deal with the confirmed high-severity identifiers", "you", "the strongest findings by evidence and severity"),
    "rescan_pages": ("Rescan these at a higher resolution", "you", "what a model reads would match what is on the page"),
    "strip_metadata": ("Strip identifying metadata before indexing", "you", "identifiers and paths are no longer stored with every chunk"),
}
_SKIPPED = {"supply_password": "password", "unsupported_types": "unsupported"}


def _none(*columns: str) -> str:
    return " and ".join(f"not contains(lower({c[0]}), '{c[1]}')" for c in (("reason", v) for v in columns))


def quick_wins(pages: DataFrame, matches: DataFrame, metadata: DataFrame | None = None, hidden: DataFrame | None = None, skipped: DataFrame | None = None, disagreements: DataFrame | None = None, signals: DataFrame | None = None, paths: DataFrame | None = None, saving_usd_per_1000: float | None = None) -> DataFrame:
    """(id, title, actor, documents, effect, saving_usd_per_1000) of what would help, by those rules whose tables are given; an
    action that applies to no document is not listed. disagreements: retrieval.disagreement(); paths: documents with absolute
    paths in their metadata; the saving is of a document that moves from images to text."""
    parts = {"ocr_blank_pages": pages.where("text_source = 'none'"), "high_severity": matches.where("severity = 'high' and evidence = 'confirmed'")}
    if metadata is not None:
        parts["strip_metadata"] = metadata.where("significant").select("document")
        if paths is not None:
            parts["strip_metadata"] = parts["strip_metadata"].unionByName(paths.select("document"))
    if hidden is not None:
        told = hidden.where("severity = 'high'").select("document").distinct()
        parts["hidden_instructions"] = told
        parts["hidden_text"] = hidden.where("visibility in ('suspected', 'confirmed')").join(told, "document", "left_anti")
    if skipped is not None:
        files = skipped.withColumn("document", F.col("path"))
        for i, word in _SKIPPED.items():
            parts[i] = files.where(F.contains(F.lower("reason"), F.lit(word)))
        parts["unreadable_files"] = files.where(_none(*_SKIPPED.values()))
    if disagreements is not None:
        parts["route_reader"], parts["reader_disputed"] = disagreements.where("why = 'reordered'"), disagreements.where("why = 'different words'")
    if signals is not None:
        parts["rescan_pages"] = signals.where("signal = 'ocr_confidence' and rating = 'poor'")
    rows = reduce(lambda a, b: a.unionByName(b), [p.select("document", F.lit(i).alias("id")) for i, p in parts.items()])
    known = F.create_map(*[x for i, (title, actor, effect) in WINS.items() for x in (F.lit(i), F.struct(F.lit(title).alias("title"), F.lit(actor).alias("actor"), F.lit(effect).alias("effect")))])
    g = rows.distinct().groupBy("id").agg(F.count(F.lit(1)).alias("documents")).withColumn("w", F.element_at(known, F.col("id")))
    if saving_usd_per_1000 is None:
        saving = F.lit(None).cast("double")
    else:
        n = pages.agg(F.countDistinct("document").alias("all"))
        g = g.crossJoin(F.broadcast(n))  # one row
        saving = F.when(F.col("id") == "ocr_blank_pages", F.bround(F.lit(saving_usd_per_1000) * F.col("documents") / F.col("all"), 4))
    return g.select("id", "w.title", "w.actor", "documents", "w.effect", saving.alias("saving_usd_per_1000")).orderBy(F.desc("documents"), "title")


def limitations(pages: DataFrame, unscanned: DataFrame, signals: DataFrame, hidden: DataFrame | None = None, skipped: DataFrame | None = None, disagreements: DataFrame | None = None, differences: DataFrame | None = None, facts: DataFrame | None = None, uneven: DataFrame | None = None, tables: DataFrame | None = None, components=("cost", "readiness", "sensitive"), reveal: bool = False, sampled_from: int | None = None, monthly: int | None = None, stale: list[str] = (), unpriced: list[str] = ()) -> DataFrame:
    """(area, severity, statement, affected): what could not be measured or must be kept in mind, by those rules whose tables are
    given. affected counts documents (categories, facts or models where the statement is about these)."""
    spark, rows = pages.sparkSession, []

    def say(found: DataFrame, area: str, severity: str, statement, what: str = "document") -> None:
        named = found.withColumn("statement", F.lit(statement) if isinstance(statement, str) else statement)
        g = named.groupBy("statement").agg(F.countDistinct(what).alias("affected"))
        rows.append(g.select(F.lit(area).alias("area"), F.lit(severity).alias("severity"), "statement", "affected"))

    noted: list[tuple[str, str, str, int]] = []
    if sampled_from is not None:
        noted.append(("Sampling", "important", f"this run covers a sample of the {sampled_from} documents found", 0))
    if disagreements is not None:
        say(disagreements.where("why is not null"), "Extraction", "important", "the readers compared read documents differently")
    if hidden is not None:
        told = hidden.where("severity = 'high'").select("document").distinct()
        say(told, "Hidden content", "important", "passages read as instructions to a model and are hidden from a reader")
        say(hidden.where("visibility in ('suspected', 'confirmed')").join(told, "document", "left_anti"), "Hidden content", "important", "documents contain text a reader does not see")
        say(hidden.where("visibility = 'not_measured'"), "Hidden content", "info", "hidden text was not checked in documents with instruction-like text")
        noted.append(("Hidden content", "info", "text inside images is not checked; instruction patterns are mostly English", 0))
    if skipped is not None:
        say(skipped.withColumn("document", F.col("path")), "Files not examined", "important", F.concat(F.lit("files were not examined: "), "reason"))
        say(skipped.withColumn("document", F.col("path")).where("contains(lower(reason), 'password')"), "Encrypted documents", "important", "documents are password protected and could not be opened")
    say(pages.where("text_source = 'none'"), "Pages that could not be read", "important", "pages without text were not searched")
    say(unscanned, "Categories not scanned", "important", F.concat(F.col("category"), F.lit(" was not scanned for")))
    say(signals.where("status = 'error'"), "Signals that failed", "important", F.concat("signal", F.lit(": "), "reason"))
    if tables is not None:
        say(tables.where("detected_by <> 'lines'"), "Table detection", "info", "tables aligned by white space are counted, their headers and merged cells are not measured")
    say(pages.where("format not in ('pdf', 'pptx', 'xlsx')"), "Page counts", "info", "documents have no fixed pagination, so page counts and costs per page are not measurements")
    if differences is not None:
        say(differences, "Loaders", "important", "identifiers turned up in the output of some loaders and not of others")
    if facts is not None:
        say(facts.where("found is null"), "Loaders", "important", F.concat(F.lit("expected facts were not found by "), "loader"), "fact")
    if uneven is not None:
        say(uneven, "Loaders", "important", "the loaders did not all return the same documents")
    if stale:
        noted.append(("Price provenance", "important", "prices have not been verified lately", len(stale)))
    if unpriced:
        noted.append(("Models not costed", "info", "models carry no price, so no cost was computed for them", len(unpriced)))
    if "cost" in components:
        noted += [("Token counting", "info", "token counts are a character estimate", 0), ("Cost scope", "info", "only input cost is estimated", 0), ("Currency", "info", "costs are shown in US dollars", 0)]
    if monthly:
        noted.append(("Volume extrapolation", "important", f"monthly figures assume that these documents are like the {monthly} of a month", 0))
    if reveal:
        noted.append(("Masking", "important", "this report contains unmasked values", 0))
    for name in sorted({"cost", "readiness", "sensitive"} - set(components)):
        noted.append(("Components not run", "important", f"nothing here says anything about {name}", 0))
    out = reduce(lambda a, b: a.unionByName(b), rows)
    return out.unionByName(spark.createDataFrame(noted, "area string, severity string, statement string, affected long")) if noted else out


def hidden_table(findings: DataFrame, excerpt: int = 240) -> DataFrame:
    """findings with their excerpts: white space single, identifiers masked, cut to `excerpt` characters with an ellipsis."""
    from paperweir.operators import identifiers as I

    clean = F.substring(X.squeeze(F.col("excerpt")), 1, 2 * excerpt)
    own = findings.withColumn("text", clean).withColumn("key", F.sha2("text", 256))
    texts = own.select("key", "text").where("text is not null").distinct()
    masked = I.mask_matches(texts, I.scan(texts, ["key"]), ["key"]).select("key", F.col("text").alias("shown"))
    cut = F.when(F.length("shown") > excerpt, F.concat(F.regexp_replace(F.substring("shown", 1, excerpt - 1), "(?U)\\s+$", ""), F.lit("…"))).otherwise(F.col("shown"))
    rows = own.join(masked, "key", "left").withColumns({"excerpt": cut, "hidden_reasons": F.array_join("hidden_reasons", "; "), "instruction_reasons": F.array_join("instruction_reasons", "; ")})
    return table(rows, "hidden")


def full_audit(pages: DataFrame, items: DataFrame | None = None, categories=None, facts: list | None = None, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a report on pages (document, page, text, text_source, format): lazily, by their names. items is loader output
    with metadata; facts are looked for in the pages, as read by one loader named report."""
    from paperweir.operators import hidden as H
    from paperweir.operators import identifiers as I
    from paperweir.operators import loaders as L
    from paperweir.operators import retrieval as E
    from paperweir.operators import signals as S

    found = I.scan(pages, ["document", "page"], categories)
    rated = S.rated(S.text_signals(pages))
    scored = S.scores(rated)
    overall = S.overall(scored, S.cost_factor(pages), S.exposure(pages, found))
    passages = H.findings(pages)
    own = pages.withColumn("loader", F.lit("report"))
    metadata = L.scan_metadata(items, categories) if items is not None else None
    checked = E.evaluate_facts(own, facts) if facts else None
    per = passages.groupBy("document").agg(F.count(F.lit(1)).alias("hidden_passages"), F.count_if(F.col("severity") == "high").alias("hidden_high"))
    documents = documents_table(pages, found, scored, overall).drop("hidden_passages", "hidden_high").join(per, "document", "left").fillna(0, ["hidden_passages", "hidden_high"])
    empty = lambda name: table(pages.limit(0), name)
    unscanned = I.unscanned(pages.select("document").distinct(), ["document"])
    return {
        "documents": table(documents, "documents"), "pages": pages_table(pages), "identifiers": identifiers_table(found), "signals": table(rated, "signals"), "hidden": hidden_table(passages),
        "metadata": table(metadata.withColumn("value", F.col("masked")), "metadata") if metadata is not None else empty("metadata"),
        "limitations": limitations(pages, unscanned, rated, passages, skipped, facts=checked), "quick_wins": quick_wins(pages, found, metadata, passages, skipped, signals=rated),
        "loaders": table(L.summary(own, found.withColumn("loader", F.lit("report")), facts=checked, baseline="report"), "loaders"), "differences": empty("differences"),
        "facts": table(checked, "facts") if checked is not None else empty("facts"), "unscanned": unscanned, "skipped": skipped if skipped is not None else spark_empty(pages),
    }


def spark_empty(pages: DataFrame) -> DataFrame:
    return pages.sparkSession.createDataFrame([], "path string, reason string")


def write_text(pages: DataFrame, path: str) -> None:
    """Extracted text as files: one folder per document, its text in one file with a line before each page that has any text,
    naming the page and where the text came from. The files hold every identifier in full."""
    body = pages.where(F.rlike("text", F.lit("(?U)\\S"))).select("document", "page", F.concat(F.lit("--- page "), F.col("page"), F.lit(" ("), "text_source", F.lit(") ---\n"), F.regexp_replace("text", "(?U)\\s+$", ""), F.lit("\n")).alias("value"))
    listed = body.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("page", "value"))).alias("pages"))
    listed.select("document", F.array_join(F.transform("pages", lambda p: p["value"]), "\n").alias("value")).write.mode("overwrite").partitionBy("document").text(path)


class ExpectationError(AssertionError):
    pass


class Expect:
    """Chained assertions over report tables; each raises with the first 20 rows that break it."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = tables

    def _none(self, rows: DataFrame, what: str) -> Expect:
        bad = rows.limit(21).collect()
        if bad:
            shown = "; ".join(str(r.asDict()) for r in bad[:20])
            raise ExpectationError(f"{what}: {shown}" + (" …" if len(bad) > 20 else ""))
        return self

    def no_identifiers(self, severity: str | None = None, evidence: str | None = None) -> Expect:
        rows = self.tables["identifiers"]
        if severity:
            rows = rows.where(F.col("severity") == severity)
        if evidence:
            rows = rows.where(F.col("evidence") == evidence)
        return self._none(rows.select("document", "category", "evidence"), "identifiers were found")

    def no_hidden(self, severity: str = "medium") -> Expect:
        worse = {"low": ["low", "medium", "high"], "medium": ["medium", "high"], "high": ["high"]}[severity]
        return self._none(self.tables["hidden"].where(F.col("severity").isin(worse)), "hidden passages were found")

    def readiness_at_least(self, score: float) -> Expect:
        return self._none(self.tables["documents"].where(F.col("readiness_score") < score).select("document", "readiness_score"), f"documents score below {score}")

    def global_score_at_least(self, score: float) -> Expect:
        return self._none(self.tables["documents"].where(F.col("global_score") < score).select("document", "global_score"), f"documents score below {score}")

    def facts_found(self) -> Expect:
        return self._none(self.tables["facts"].where(F.col("found").isNull()).select("fact"), "facts were not found")

    def no_failures(self) -> Expect:
        return self._none(self.tables["skipped"], "files were skipped")

    def no_network(self) -> Expect:
        return self._none(self.tables["loaders"].where(F.col("network_attempts") > 0), "loaders used the network")

    def all_categories_scanned(self) -> Expect:
        return self._none(self.tables["unscanned"].select("category").distinct(), "categories were not scanned for")

    def no_regressions(self, old: dict[str, DataFrame]) -> Expect:
        rows = [t["identifiers"].select("document", F.concat_ws(" ", "category", "value").alias("subject")) for t in (old, self.tables)]
        return self._none(changes(*rows).where("worse"), "the report got worse")


def write_json(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as a folder of JSON lines under path, with the schema's version."""
    for name, rows in tables.items():
        rows.withColumn("schema_version", F.lit(8)).write.mode("overwrite").json(f"{path}/{name}")


def load_json(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A table that write_json wrote; versions 5 to 8 are read, others are a ValueError."""
    rows = spark.read.schema(f"{schema}, schema_version int").json(f"{path}/{name}")
    bad = rows.where("schema_version is null or schema_version not between 5 and 8").limit(1).collect()
    if bad:
        raise ValueError(f"cannot read schema version {bad[0]['schema_version']}")
    return rows.drop("schema_version")


def write_html(tables: dict[str, DataFrame], path: str, title: str = "Document readiness", rows: int = 200) -> None:
    """A page of its own, without scripts or outside resources: the folder's figures, and each table's number of rows and first
    `rows` of them (the tables themselves are written by write_json or any writer)."""
    from html import escape

    def grid(columns: list[str], body) -> str:
        head = "".join(f"<th>{escape(c)}</th>" for c in columns)
        lines = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in body)
        return f"<table><thead><tr>{head}</tr></thead><tbody>{lines}</tbody></table>"

    parts = [f"<!doctype html><html><head><meta charset='utf-8'><title>{escape(title)}</title><style>body{{font:14px sans-serif}}td,th{{border:1px solid #ccc;padding:2px 6px;text-align:left}}table{{border-collapse:collapse}}</style></head><body><h1>{escape(title)}</h1>"]
    if "identifiers" in tables:
        by = tables["identifiers"].groupBy("category", "severity").agg(F.count(F.lit(1)).alias("matches")).orderBy(F.desc("matches"), "category").collect()
        parts.append("<h2>Identifiers by category</h2>" + grid(["category", "severity", "matches"], by))
    for name in [n for n in TABLES if n in tables]:
        found, n = tables[name].limit(rows).collect(), tables[name].count()
        more = f" (first {len(found)} of {n})" if n > len(found) else f" ({n})"
        parts.append(f"<h2>{escape(name)}{more}</h2>" + grid(tables[name].columns, found))
    page = tables[next(iter(tables))].sparkSession.createDataFrame([("".join(parts) + "</body></html>",)], "value string")
    page.coalesce(1).write.mode("overwrite").text(path)
