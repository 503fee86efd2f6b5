"""Identifier detection: patterns with context rules, checksums, overlap resolution, places, evidence and masking."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.functions import text as X
from paperweir.functions.arrow import parts
from paperweir.functions.fixed import CATEGORIES, EVIDENCE_WEIGHT, MODEL_CATEGORIES, NEVER_REVEAL, SEVERITY_WEIGHT
from paperweir.functions.validators import VALIDATORS

#: Characters before and after a match that a context term is looked for in; confidence of a match found by context.
WINDOW, CONTEXT_CONFIDENCE = 60, 0.8


def _find(patterns: list[tuple[int, str, list[str] | None]]):
    """Hits of all patterns in a text: (ord, start, value, term, confidence, line, column), offsets in code points."""
    compiled = [(n, re.compile(rx, re.IGNORECASE), terms) for n, rx, terms in patterns]
    anything = re.compile(r"[@\d]")

    def find(text: str):
        # Every pattern but that of addresses asks for a digit, directly or by its checks; addresses ask for an @.
        if not anything.search(text):
            return
        low = text.lower()
        # A term that stands nowhere in the text cannot stand near a match.
        known = {t for _, _, terms in compiled for t in terms or () if t in low}
        for n, rx, terms in compiled:
            if terms is not None and known.isdisjoint(terms):
                continue
            for m in rx.finditer(text):
                s, e = m.span()
                term = None
                if terms is not None:
                    hay = text[max(0, s - WINDOW) : s].lower() + " " + text[e : e + WINDOW].lower()
                    term = next((t for t in terms if t in hay), None)
                    if term is None:
                        continue
                yield n, s, m.group(), term, 1.0 if terms is None else CONTEXT_CONFIDENCE, text.count("\n", 0, s) + 1, s - (text.rfind("\n", 0, s) + 1)

    return find


class Detector(NamedTuple):
    """A finder of one's own for a category: find(texts) gives for each text the (start, end, confidence) of what it takes for one.

    An entity model is one; `make` is called once per task, so that models load where they run."""

    category: str
    make: Callable[[], Callable[[list[str]], list[list[tuple[int, int, float]]]]]
    label: str = ""
    severity: str = "medium"


def detected(pages: DataFrame, detectors: list[Detector], text: str = "text") -> DataFrame:
    """Candidates, in the columns of candidates(), that detectors find. They rank behind all patterns."""
    kept = [f for f in pages.schema.fields if f.name != text]
    schema = T.StructType([*kept, *T._parse_datatype_string(_MATCH).fields])

    def run(batches):
        finders = [(d.category, d.make()) for d in detectors]
        for batch in batches:
            texts = [t or "" for t in batch.column(len(kept)).to_pylist()]
            at, rows = [], []
            for n, (category, find) in enumerate(finders):
                for i, spans in enumerate(find(texts)):
                    for s, e, confidence in spans:
                        t = texts[i]
                        at.append(i)
                        rows.append((1000 + n, category, s, t[s:e], None, float(confidence), t.count("\n", 0, s) + 1, s - (t.rfind("\n", 0, s) + 1)))
            if rows:
                own = [batch.column(i).take(pa.array(at)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], names=schema.names)

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text)).mapInArrow(run, schema)


_MATCH = "ord int, category string, start int, value string, term string, confidence double, line int, column int"
_KINDS = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32()]


def candidates(pages: DataFrame, categories: Iterable[str] | None = None, text: str = "text") -> DataFrame:
    """One row per match of any pattern: columns of pages but the text, ord, category, start, value, term, confidence, line
    and column. ord numbers the patterns in the order of categories, plain before context patterns. One pass in Arrow
    batches: sixty patterns as SQL expressions make plans that take longer to compile than most tables take to scan."""
    patterns, names = [], []
    for c in CATEGORIES:
        if categories is None or c.id in set(categories):
            for rx, terms in [(p, None) for p in c.patterns] + [(p, c.context_terms) for p in c.context_patterns if c.context_terms]:
                patterns.append((len(names), rx, terms))
                names.append(c.id)
    kept = [f for f in pages.schema.fields if f.name != text]
    schema = T.StructType([*kept, *T._parse_datatype_string(_MATCH).fields])

    def run(batches):
        find = _find(patterns)
        for batch in parts(batches, len(kept)):
            at, rows = [], []
            for i, t in enumerate(batch.column(len(kept)).to_pylist()):
                for n, *hit in find(t) if t else ():
                    at.append(i)
                    rows.append((n, names[n], *hit))
            if rows:
                own = [batch.column(i).take(pa.array(at)) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)], names=schema.names)

    return pages.select(*[F.col(f"`{f.name}`") for f in kept], F.col(text)).mapInArrow(run, schema)


@lru_cache(maxsize=64)
def _passed(as_of: str, categories: tuple[str, ...] | None) -> Column:
    """Names of the checks of a match's category if it passes all, else null. The expression is large: it is built once."""
    passed = F.array().cast("array<string>")
    by_rule: dict[tuple[str, ...], list[str]] = {}
    for c in CATEGORIES:
        if c.validators and (categories is None or c.id in categories):
            by_rule.setdefault(tuple(c.validators), []).append(c.id)
    for rules, ids in by_rule.items():
        ok = reduce(lambda a, b: a & b, [VALIDATORS[r](F.col("value"), as_of) if r == "plausible_dob" else VALIDATORS[r](F.col("value")) for r in rules])
        names = F.array(*[F.lit(r) for r in rules])
        passed = F.when(F.col("category").isin(ids), F.when(ok, names)).otherwise(passed)
    return passed


def validated(found: DataFrame, as_of: str = "2026-01-01", categories: Iterable[str] | None = None) -> DataFrame:
    """Candidates that pass all checks of their category, with the names of those passed. Checks of categories that were not
    asked for stay out of the plan."""
    passed = _passed(as_of, None if categories is None else tuple(sorted(categories)))
    # Through a generator, so that the filter tests the outcome instead of holding a second copy of all checks.
    return found.select("*", F.explode_outer(F.array(passed)).alias("validators_passed")).where("validators_passed is not null")


def resolved(found: DataFrame, page: list[str]) -> DataFrame:
    """Of overlapping matches of exclusive categories on a page, the longest stays; of equals the one with context, then the
    more confident, then the first by pattern and place. Other categories stay as they are."""
    exclusive = [c.id for c in CATEGORIES if c.exclusive]
    exclusive_one = F.col("category").isin(exclusive)
    fields = F.struct(*[F.col(f"`{c}`") for c in found.columns if c not in page])
    row = F.struct(
        (-F.length("value")).alias("k1"), F.when(F.col("term").isNotNull(), 0).otherwise(1).alias("k2"), (-F.coalesce("confidence", F.lit(0.0))).alias("k3"),
        F.col("ord").alias("k4"), F.col("start").alias("k5"), (F.col("start") + F.length("value")).alias("e"), fields.alias("r"),
    )
    # Both kinds in one sum: as two branches the search for matches would run twice.
    per = found.groupBy(*page).agg(F.array_sort(F.collect_list(F.when(exclusive_one, row))).alias("c"), F.collect_list(F.when(~exclusive_one, fields)).alias("rest"))
    kind = per.schema["c"].dataType.simpleString()
    kept = F.aggregate("c", F.array().cast(kind), lambda a, x: F.when(F.exists(a, lambda t: (x["k5"] < t["e"]) & (t["k5"] < x["e"])), a).otherwise(F.concat(a, F.array(x))))
    out = per.select(*page, F.explode(F.concat(F.transform(kept, lambda k: k["r"]), "rest")).alias("r")).select(*page, "r.*")
    return out.select(*found.columns)


def evidence(validators: Column, term: Column, model: Column | None = None) -> Column:
    """Checksums outrank context, context a bare pattern."""
    tier = F.when(F.size(validators) > 0, "confirmed").when(term.isNotNull(), "corroborated")
    return (tier.when(model, "model") if model is not None else tier).otherwise("pattern")


def _lookup(field: str, detectors=()) -> Column:
    known = {c.id: getattr(c, field) for c in CATEGORIES} | {d.category: getattr(d, field) or d.category for d in detectors if d.category not in MODEL_CATEGORIES}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("category"))


def scan(pages: DataFrame, page: list[str], categories: Iterable[str] | None = None, text: str = "text", reveal: bool = False, min_confidence: float = 0.0, as_of: str = "2026-01-01", tail: int = 4, detectors: list[Detector] = ()) -> DataFrame:
    """Matches of pages keyed by `page` columns: category, label, severity, line, column, length, masked, revealed, evidence,
    confidence, validators_passed and term. Pages with a null or blank text have none (see unreadable). detectors find what no
    pattern can; their evidence is `model`, and their categories need not be known."""
    # The keys travel as one struct, so that none of their names can clash with those of matches.
    rows = pages.select(F.struct(*page).alias("__page"), F.col(text).alias("text")).where(F.rlike(F.col("text"), F.lit("(?U)\\S")))
    categories = None if categories is None else list(categories)
    found = validated(candidates(rows, categories, "text"), as_of, categories)
    if detectors:
        found = found.unionByName(detected(rows, list(detectors), "text").withColumn("validators_passed", F.array().cast("array<string>")))
    found = resolved(found.where((F.col("confidence").isNull()) | (F.col("confidence") >= min_confidence)), ["__page"])
    shown = F.when(F.lit(reveal) & ~F.col("category").isin(NEVER_REVEAL), X.squeeze(F.col("value")))
    return found.select(
        "__page.*", "category", _lookup("label", detectors).alias("label"), _lookup("severity", detectors).alias("severity"), "line", "column", F.length("value").alias("length"),
        X.mask(F.col("value"), tail).alias("masked"), shown.alias("revealed"), evidence(F.col("validators_passed"), F.col("term"), F.col("ord") >= 1000).alias("evidence"),
        "confidence", "validators_passed", F.col("term").alias("context_term"),
    )


def unreadable(pages: DataFrame, page: list[str], text: str = "text") -> DataFrame:
    """Pages without any text to scan."""
    return pages.where(F.col(text).isNull() | ~F.rlike(F.col(text), F.lit("(?U)\\S"))).select(*page)


def unscanned(docs: DataFrame, keys: list[str], detectors: list[Detector] = ()) -> DataFrame:
    """One row per document and category that only an entity model could find and no detector does: not scanned is not zero."""
    kinds = F.array(*[F.lit(c) for c in MODEL_CATEGORIES if c not in {d.category for d in detectors}]).cast("array<string>")
    return docs.select(*keys, F.explode(kinds).alias("category"), F.lit("no entity model is available").alias("reason"))


def counts(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"))


def severity_weight(severity: Column) -> Column:
    return reduce(lambda w, k: w.when(severity == k, SEVERITY_WEIGHT[k]), SEVERITY_WEIGHT, F.when(F.lit(False), 0.0)).otherwise(1.0)


def evidence_weight(tier: Column) -> Column:
    return reduce(lambda w, k: w.when(tier == k, EVIDENCE_WEIGHT[k]), EVIDENCE_WEIGHT, F.when(F.lit(False), 0.0)).otherwise(0.5)


def evidence_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in EVIDENCE_WEIGHT]), tier) - 1


def _masked(text: str, matches: list[dict]) -> tuple[str, int, int]:
    """text with matches (rk, line, c, l, mk), in their order, masked; how many counted, and how many of these were confirmed."""
    lines, changed, covered, n, confirmed = text.split("\n"), {}, {}, 0, 0
    for m in matches:
        at, c, end = m["line"] - 1, m["c"], m["c"] + m["l"]
        if at >= len(lines) or end > len(lines[at]):
            continue
        own, taken = changed.setdefault(at, list(lines[at])), covered.setdefault(at, set())
        places = [i for i in range(c, end) if i not in taken]
        if places:
            for i in places:
                own[i] = m["mk"][i - c : i - c + 1]
            taken.update(places)
            n, confirmed = n + 1, confirmed + (m["rk"] == 0)
    for at, own in changed.items():
        lines[at] = "".join(own)
    return "\n".join(lines), n, confirmed


def mask_matches(pages: DataFrame, found: DataFrame, page: list[str], text: str = "text", keep: list[str] = ()) -> DataFrame:
    """page and the columns to keep, text with matches masked, replaced and confirmed counts. Stronger evidence writes first, then
    line and column; a match wholly under earlier ones does not count; one that runs past its line's end is left out, as places are per line."""
    rank = F.struct(evidence_rank(F.col("evidence")).alias("rk"), "line", F.col("column").alias("c"), F.col("length").alias("l"), F.col("masked").alias("mk"))
    per = found.groupBy(*page).agg(F.array_sort(F.collect_set(rank)).alias("__m"))
    rows = pages.select(*page, F.struct(*page, *keep).alias("__row"), F.col(text).alias("__text")).join(per, page, "left").select("__row", "__text", "__m")
    schema = T.StructType([rows.schema["__row"], T.StructField("__text", T.StringType()), T.StructField("replaced", T.LongType()), T.StructField("confirmed", T.LongType())])

    def run(batches):
        for batch in parts(batches, 1):
            m = batch.column(2)
            some = np.flatnonzero(m.is_valid().to_numpy(zero_copy_only=False))
            n, confirmed, texts = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64), batch.column(1)
            if len(some):
                texts = texts.to_pylist()
                for i in some.tolist():
                    texts[i], n[i], confirmed[i] = _masked(texts[i] or "", m[i].as_py())
                texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array(n), pa.array(confirmed)], names=schema.names)

    return rows.mapInArrow(run, schema).select("__row.*", F.col("__text").alias("text"), "replaced", "confirmed")


def ranked(found: DataFrame, path: str, page: str) -> DataFrame:
    """Matches as a report lists them: by severity, evidence, path, page, line, numbered over the whole result."""
    order = [F.desc(severity_weight(F.col("severity"))), evidence_rank(F.col("evidence")), F.col(path), F.col(page), F.col("line"), F.col("column")]
    return found.orderBy(*order)


def repeated(found: DataFrame, unit: str) -> DataFrame:
    """Identifiers in more than one unit (chunk, document), by label and masked value."""
    seen = found.groupBy("label", "masked").agg(F.countDistinct(unit).alias("units"))
    return seen.where("units > 1")


__all__ = ["Detector", "candidates", "counts", "detected", "evidence", "mask_matches", "ranked", "repeated", "resolved", "scan", "unreadable", "unscanned", "validated"]
