"""Loaders, metadata, reports, HTML pages and streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperweir.operators import extraction as X
from paperweir.operators import hidden as H
from paperweir.operators import identifiers as I
from paperweir.operators import loaders as L
from paperweir.operators import report as R
from paperweir.operators import retrieval as E
from paperweir.operators import signals as S
from paperweir.plans import signal_queries
from paperweir.plans.chunk_queries import _NS, _SMUGGLED, _plain, _trim
from paperweir.plans.extra import SQL_PAGES, pages
from paperweir.plans.identifier_queries import _FOUND, _MASK, THREE, found, with_three
from paperweir.plans.signal_queries import _ALL, _POINTS, _WEIGHT, overall_readiness, rated_signals, readiness_score
from paperweir.sources import files
from paperweir.sources.tables import PAGE, document_pages
from paperweir.streaming import scan_available


def _items(spark, sf_dir) -> DataFrame:
    """Conversations as loader output: a page number, a path, and an address in the metadata of every fifth conversation."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = F.concat(F.lit("conv_"), "conv_id")
    base = F.map_from_arrays(F.array(F.lit("source"), F.lit("page"), F.lit("origin")), F.array(name, F.col("turn").cast("string"), F.concat(F.lit("/data/"), F.col("role"), F.lit("/in.txt"))))
    more = F.when(F.col("conv_id") % 5 == 0, F.map_from_arrays(F.array(F.lit("Author")), F.array(F.concat(F.lit("user"), "conv_id", F.lit("@example.org"))))).otherwise(F.create_map().cast("map<string,string>"))
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text", F.map_concat(base, more).alias("metadata"), "conv_id", "turn")


def loader_grouping(spark, sf_dir):
    return L.as_pages(_items(spark, sf_dir)).select("document", "page", F.md5("text").alias("text_md5"), "page_count_known")


def metadata_scan(spark, sf_dir):
    return L.scan_metadata(_items(spark, sf_dir), ["email_address"]).select("document", "key", "category", "severity", "evidence", "masked", "significant")


def path_exposure(spark, sf_dir):
    return L.path_exposure(_items(spark, sf_dir)).select("document", F.array_join("keys", ",").alias("keys"))


def steps_strip_paths(spark, sf_dir):
    return L.strip_paths(_items(spark, sf_dir)).select("ord", F.try_element_at("metadata", F.lit("origin")).alias("origin"))


def _two(spark, sf_dir) -> DataFrame:
    """Pages by two loaders: b lacks documents by the length of their name and drops what stands after a document's first line break."""
    p = pages(spark, sf_dir)
    b = p.where(F.length("document") % 5 != 0).withColumn("text", F.substring_index("text", "\n", 1))
    return p.withColumn("loader", F.lit("a")).unionByName(b.withColumn("loader", F.lit("b")))


def _two_found(spark, sf_dir) -> DataFrame:
    return I.scan(_two(spark, sf_dir), ["loader", *PAGE], THREE).select("loader", "document", F.lit("text").alias("location"), "category", "severity", "masked")


def loader_identifier_diff(spark, sf_dir):
    d = L.identifier_differences(_two_found(spark, sf_dir), _two(spark, sf_dir).select("loader", "document"))
    return d.select("document", "location", "category", "severity", "masked", F.array_join("found_by", ",").alias("found_by"), F.array_join("missed_by", ",").alias("missed_by"))


def loader_uneven_docs(spark, sf_dir):
    return L.uneven_documents(_two(spark, sf_dir).select("loader", "document"), 2).select("document", F.array_join("loaders", ",").alias("loaders"))


def loader_uneven_keys(spark, sf_dir):
    keys = spark.createDataFrame([("a", "Source"), ("a", "page"), ("b", "source"), ("b", "title")], "loader string, key string")
    return L.uneven_keys(keys, 2)


def loader_summary(spark, sf_dir):
    t = L.summary(_two(spark, sf_dir), _two_found(spark, sf_dir))
    return t.select("loader", "documents", "pages", "characters", F.col("identifiers_in_text").alias("identifiers"))


def loader_facts(spark, sf_dir):
    """Ten benchmark passages, of which some are for one document only, in what two loaders read."""
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(10).collect()  # the facts are a given list
    facts = [r["text"] for r in b] + [("Card 4111 1111 1111 1111", "x_ids"), ("Card 4111 1111 1111 1111", "x_cid")]
    return E.evaluate_facts(_two(spark, sf_dir), facts, threshold=1.0).select("fact", "document", "loader", "found", "matched_document")


def loader_readings(spark, sf_dir):
    p = pages(spark, sf_dir)
    return L.readings(p, p.withColumn("text", F.regexp_replace("text", "\\bthe\\b", "")))


def sample_files(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return L.sample(d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("f"), F.col("doc_id")).alias("path"), F.col("lang").alias("ext")), 37)


def _subjects(spark, sf_dir, part, categories) -> DataFrame:
    p = pages(spark, sf_dir)
    rows = found(spark, sf_dir, categories).where(part).select("document", F.concat_ws(" ", "category", "masked").alias("subject"))
    return rows.unionByName(p.select("document", F.lit(None).cast("string").alias("subject")))


def report_diff(spark, sf_dir, categories=None):
    """The report without e-mail addresses against the one without card numbers."""
    return R.changes(_subjects(spark, sf_dir, "category <> 'email_address'", categories), _subjects(spark, sf_dir, "category <> 'card_number'", categories))


def report_documents_diff(spark, sf_dir):
    p = pages(spark, sf_dir)
    return R.document_changes(p.where("document <> 'x_ids'"), p.where("document <> 'x_cid'"))


def quick_wins(spark, sf_dir, categories=None):
    p = pages(spark, sf_dir)
    return R.quick_wins(p, found(spark, sf_dir, categories), hidden=H.findings(p)).select("id", "documents")


def limitations(spark, sf_dir):
    p = document_pages(spark, sf_dir)
    return R.limitations(p, I.unscanned(p, ["document"]), S.rated(S.text_signals(p)))


def tables_hidden(spark, sf_dir):
    return R.hidden_table(H.findings(pages(spark, sf_dir))).select("document", "page", "visibility", "instruction", "severity", "excerpt")


def tables_metadata(spark, sf_dir):
    m = L.scan_metadata(_items(spark, sf_dir), ["email_address"])
    return R.table(m.withColumn("value", F.col("masked")), "metadata").select("document", "key", "category", "severity", "evidence", "value", "significant")


def tables_loaders(spark, sf_dir):
    t = R.table(L.summary(_two(spark, sf_dir), _two_found(spark, sf_dir), baseline="a"), "loaders")
    return t.select("loader", "baseline", "documents", "pages", "characters", "identifiers_in_text")


def extract_split(spark, sf_dir):
    """Parts of at most 60 tokens, unmasked."""
    return X.extract(pages(spark, sf_dir), mask=False, max_tokens=60).select("document", "page", "part", "tokens", F.md5("text").alias("text_md5"))


def extract_masked(spark, sf_dir, categories=None):
    t = X.extract(pages(spark, sf_dir), categories=categories)
    return t.select("document", "page", "masked", "masked_confirmed")


def extract_warnings(spark, sf_dir):
    return X.warnings(pages(spark, sf_dir)).select("kind", "document", "page")


def extract_verdict(spark, sf_dir):
    p = pages(spark, sf_dir)
    return X.verdict(X.extract(p, categories=THREE), X.warnings(p))


def page_coverage(spark, sf_dir):
    """Boxes by the documents table's numbers: thirty documents of three pages."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    x0, y0 = F.col("doc_id") * 37 % 500, F.col("doc_id") * 53 % 700
    boxes = d.select((F.col("doc_id") % 30).alias("document"), (F.col("doc_id") % 3).alias("page"), F.lit(600).alias("width"), F.lit(800).alias("height"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("n_chars") % 120).alias("x1"), (y0 + F.col("n_chars") % 90).alias("y1"))
    return S.coverage(boxes).select("document", "page", F.bround(F.col("share") * 57600).cast("long").alias("cells"))


def sig_language(spark, sf_dir):
    return S.language_count(pages(spark, sf_dir)).select("document", "value")


def sig_language_names(spark, sf_dir):
    return pages(spark, sf_dir).select("document", S.language(F.col("text")).alias("language"))


def tables_documents(spark, sf_dir, categories=None):
    p = pages(spark, sf_dir)
    t = R.documents_table(p, found(spark, sf_dir, categories), readiness_score(spark, sf_dir), overall_readiness(spark, sf_dir, categories))
    return t.select("document", "pages", "readiness_score", "readiness_label", "global_score", "identifiers")


def tables_pages(spark, sf_dir):
    return R.pages_table(pages(spark, sf_dir)).select("document", "page", "source", "characters", "truncated", F.md5("text").alias("text_md5"))


def tables_identifiers(spark, sf_dir, categories=None):
    return R.identifiers_table(found(spark, sf_dir, categories)).select("document", "page", "line", "category", "severity", "evidence", "value")


def tables_signals(spark, sf_dir):
    return R.table(rated_signals(spark, sf_dir), "signals").select("document", "signal", "status", "value", "rating", "weight")


def report_aggregate(spark, sf_dir, categories=None):
    return R.aggregate(pages(spark, sf_dir), found(spark, sf_dir, categories), readiness_score(spark, sf_dir))


def _html(spark, sf_dir):
    return files.html_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"))


def html_text(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", F.length("text").alias("characters"), F.md5("text").alias("text_md5"))


def html_comments(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", F.size(F.filter("hidden", lambda h: h["reason"] == "HTML comment")).alias("comments"))


def html_hidden(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", F.explode("hidden").alias("h")).select("page_id", "h.reason", "h.text")


def html_table_count(spark, sf_dir):
    return _html(spark, sf_dir).select("page_id", F.size("tables").alias("tables"))


def stream_scan(spark, sf_dir):
    """The identifier scan as a stream over all files that are there."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="paperweir-")
    out = f"{place.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return scan_available(spark, f"{sf_dir}/documents.parquet*", d.schema, ["email_address"], out + "/out", out + "/state").groupBy("category").agg(F.count(F.lit(1)).alias("matches"))


_FUNCS = (
    loader_grouping, metadata_scan, path_exposure, steps_strip_paths, loader_identifier_diff, loader_uneven_docs, loader_uneven_keys, loader_summary, loader_facts, loader_readings, sample_files, report_diff, report_documents_diff,
    tables_hidden, tables_metadata, tables_loaders, extract_split, extract_masked, extract_warnings, extract_verdict, page_coverage, sig_language, sig_language_names,
    quick_wins, limitations, tables_documents, tables_pages, tables_identifiers, tables_signals, report_aggregate, html_text, html_comments, html_hidden, html_table_count, stream_scan,
)
QUERIES = {f.__name__: f for f in _FUNCS}
_SUBJECT = f"category || ' ' || {_MASK}"
_B_PAGES = f"SELECT document, page, string_split(text, chr(10))[1] AS text, text_source FROM ({SQL_PAGES}) WHERE len(document) % 5 <> 0"
_IN_A, _IN_B = (f"(WITH {_FOUND.replace(SQL_PAGES, source)} SELECT document, category, severity, {_MASK} AS masked FROM f)" for source in (SQL_PAGES, _B_PAGES))
_SQL = signal_queries.ORACLES
_BEST = "list_max([" + ", ".join(f"{{'n': len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in sorted(set(own.split())))}))), 'turn': {-i}, 'code': '{code}'}}" for i, (code, own) in enumerate(sorted(S.STOP_WORDS.items()))) + "])"
_LANGUAGE = rf"""SELECT document, CASE WHEN letters >= 60 AND letters >= 0.5 * len(t) AND b.n > 0 THEN b.code END AS language FROM (SELECT *, {_BEST} AS b FROM (SELECT document, {_trim('text')} AS t,
 len(regexp_replace({_trim('text')}, '[^\p{{L}}]', '', 'g')) AS letters, regexp_extract_all(lower({_trim('text')}), '\p{{L}}+') AS w FROM ({SQL_PAGES})))"""
ORACLES = {
    "loader_uneven_docs": f"SELECT document, 'a' AS loaders FROM ({SQL_PAGES}) WHERE len(document) % 5 = 0",
    "loader_summary": f"""SELECT 'a' AS loader, count(DISTINCT document) AS documents, count(*) AS pages, sum(len(text))::BIGINT AS characters, (SELECT count(*) FROM {_IN_A}) AS identifiers FROM ({SQL_PAGES})
 UNION ALL SELECT 'b', count(DISTINCT document), count(*), sum(len(text))::BIGINT, (SELECT count(*) FROM {_IN_B}) FROM ({_B_PAGES})""",
    "loader_identifier_diff": f"""SELECT document, 'text' AS location, category, severity, masked, string_agg(DISTINCT l, ',') AS found_by, CASE WHEN min(l) = 'a' THEN 'b' ELSE 'a' END AS missed_by
 FROM (SELECT *, 'a' AS l FROM {_IN_A} UNION ALL SELECT *, 'b' FROM {_IN_B}) WHERE len(document) % 5 <> 0 GROUP BY document, category, severity, masked HAVING count(DISTINCT l) = 1""",
    "tables_documents": f"""SELECT o.document, 1::BIGINT AS pages, r.score AS readiness_score, r.label AS readiness_label, o.global_score, coalesce(i.n, 0) AS identifiers
 FROM ({_SQL['overall_readiness_three']}) o JOIN ({_SQL['readiness_score']}) r USING (document) LEFT JOIN (SELECT document, count(*) AS n FROM {_IN_A} GROUP BY 1) i USING (document)""",
    "tables_pages": f"SELECT document, page, text_source AS source, len(text)::INT AS characters, len(text) > 20000 AS truncated, md5(substr(text, 1, 20000)) AS text_md5 FROM ({SQL_PAGES})",
    "tables_signals": f"""WITH {_ALL} SELECT document, signal, CASE WHEN value IS NULL THEN 'not_applicable' ELSE 'measured' END AS status, value, CASE WHEN value IS NULL THEN NULL WHEN {_POINTS} = 1 THEN 'good' WHEN {_POINTS} = 0.5 THEN 'fair' ELSE 'poor' END AS rating, {_WEIGHT} AS weight FROM s""",
    "report_aggregate": f"""SELECT (SELECT count(DISTINCT document) FROM ({SQL_PAGES})) AS documents, (SELECT count(*) FROM ({SQL_PAGES})) AS pages, (SELECT count(*) FROM ({SQL_PAGES}) WHERE text_source = 'none') AS blank_pages,
 (SELECT count(*) FROM {_IN_A}) AS identifiers, (SELECT count(*) FROM {_IN_A} WHERE severity = 'high') AS high, (SELECT round_even(avg(score), 1) FROM ({_SQL['readiness_score']})) AS mean_score""",
    "quick_wins": f"""WITH {_SMUGGLED} SELECT * FROM (SELECT 'ocr_blank_pages' AS id, count(DISTINCT document) AS documents FROM p WHERE text_source = 'none'
 UNION ALL SELECT 'high_severity', count(DISTINCT document) FROM {_IN_A} WHERE severity = 'high' UNION ALL SELECT 'hidden_instructions', count(DISTINCT document) FROM sm WHERE kind = 'tag_characters'
 UNION ALL SELECT 'hidden_text', count(DISTINCT document) FROM sm WHERE kind <> 'tag_characters') WHERE documents > 0""",
    "loader_facts": f"""WITH q AS (SELECT text AS fact, NULL::VARCHAR AS document FROM (SELECT text FROM benchmark ORDER BY item_id LIMIT 10) UNION SELECT 'Card 4111 1111 1111 1111', unnest(['x_ids', 'x_cid'])),
 l AS (SELECT 'a' AS loader, document AS own, text FROM ({SQL_PAGES}) UNION ALL SELECT 'b', document, text FROM ({_B_PAGES})),
 h AS (SELECT q.fact, q.document, loader, min(own) AS own FROM q JOIN l ON (q.document IS NULL OR q.document = own) AND contains({_plain('l.text')}, {_plain('q.fact')}) GROUP BY ALL)
 SELECT q.fact, q.document, x.loader, CASE WHEN own IS NOT NULL THEN 'exact' END AS found, own AS matched_document FROM q CROSS JOIN (VALUES ('a'), ('b')) x(loader)
 LEFT JOIN h ON h.fact = q.fact AND h.document IS NOT DISTINCT FROM q.document AND h.loader = x.loader""",
    "tables_metadata": f"""SELECT DISTINCT 'conv_' || conv_id AS document, 'Author' AS key, 'email_address' AS category, 'medium' AS severity, 'pattern' AS evidence, {_MASK} AS value, true AS significant
 FROM (SELECT conv_id, 'user' || conv_id || '@example.org' AS v FROM conversations WHERE conv_id % 5 = 0)""",
    "tables_loaders": f"""SELECT 'a' AS loader, true AS baseline, count(DISTINCT document) AS documents, count(*) AS pages, sum(len(text))::BIGINT AS characters, (SELECT count(*) FROM {_IN_A}) AS identifiers_in_text FROM ({SQL_PAGES})
 UNION ALL SELECT 'b', false, count(DISTINCT document), count(*), sum(len(text))::BIGINT, (SELECT count(*) FROM {_IN_B}) FROM ({_B_PAGES})""",
    "extract_split": rf"""WITH p AS (SELECT * FROM ({SQL_PAGES}) WHERE text_source = 'native'), g AS (SELECT *, list_filter(string_split(text, chr(10) || chr(10)), lambda x: regexp_matches(x, '{_NS}')) AS para FROM p),
 b AS (SELECT *, CASE WHEN len(para) > 1 THEN para ELSE list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_NS}')) END AS blocks FROM g),
 f AS (SELECT document, page, CASE WHEN round_even(len(text) / 4.0, 0) <= 60 THEN [text] ELSE list_reduce(list_transform(blocks, lambda x: [x]), lambda a, x: CASE WHEN round_even((len(a[-1]) + 2 + len(x[1])) / 4.0, 0) > 60 THEN list_concat(a, x)
 ELSE list_concat(a[:-2], [a[-1] || chr(10) || chr(10) || x[1]]) END) END AS parts FROM b)
 SELECT document, page, part, round_even(len(t) / 4.0, 0)::BIGINT AS tokens, md5(t) AS text_md5 FROM (SELECT document, page, unnest(parts) AS t, generate_subscripts(parts, 1)::INT AS part FROM f)""",
    "extract_masked": f"""SELECT document, page, coalesce(n, 0) AS masked, coalesce(c, 0) AS masked_confirmed FROM ({SQL_PAGES})
 LEFT JOIN (SELECT document, count(*) AS n, count(*) FILTER (category <> 'email_address') AS c FROM {_IN_A} GROUP BY 1) USING (document) WHERE text_source = 'native'""",
    "extract_warnings": f"""SELECT 'unreadable_page' AS kind, document, page FROM ({SQL_PAGES}) WHERE text_source = 'none'
 UNION ALL SELECT unnest(['estimated_tokens', 'masking_incomplete', 'masking_incomplete', 'masking_best_effort']), NULL, NULL""",
    "extract_verdict": f"""SELECT (SELECT count(*) FROM ({SQL_PAGES}) WHERE text_source = 'native') AS chunks, (SELECT sum(round_even(len(text) / 4.0, 0))::BIGINT FROM ({SQL_PAGES}) WHERE text_source = 'native') AS tokens,
 (SELECT count(*) FROM {_IN_A}) AS masked, (SELECT count(*) FROM (SELECT document FROM {_IN_A} GROUP BY document HAVING bool_and(category <> 'email_address'))) AS guaranteed, false AS complete, false AS all_categories_scanned""",
    "page_coverage": """WITH b AS (SELECT doc_id % 30 AS document, doc_id % 3 AS page, doc_id * 37 % 500 AS x0, doc_id * 53 % 700 AS y0, n_chars % 120 AS w, n_chars % 90 AS h FROM documents),
 c AS (SELECT document, page, unnest(range(floor(x0 * 0.4::DOUBLE)::BIGINT, least(240, ceil((x0 + w) * 0.4::DOUBLE)::BIGINT))) AS x, y0, h FROM b WHERE w > 0 AND h > 0),
 e AS (SELECT DISTINCT document, page, x, unnest(range(floor(y0 * 0.3::DOUBLE)::BIGINT, ceil((y0 + h) * 0.3::DOUBLE)::BIGINT)) AS y FROM c)
 SELECT b.document, b.page, coalesce(n, 0) AS cells FROM (SELECT DISTINCT document, page FROM b) b LEFT JOIN (SELECT document, page, count(*) AS n FROM e GROUP BY ALL) USING (document, page)""",
    "sig_language": f"SELECT document, CASE WHEN language IS NOT NULL THEN 1.0::DOUBLE END AS value FROM ({_LANGUAGE})",
    "sig_language_names": _LANGUAGE,
    "sample_files": """WITH g AS (SELECT lang AS ext, count(*) AS n, min(doc_id) AS first, count(*) * 37.0::DOUBLE / (SELECT count(*) FROM documents) AS claim FROM documents GROUP BY 1),
 t AS (SELECT *, floor(claim)::BIGINT + (row_number() OVER (ORDER BY claim - floor(claim) DESC, first) <= 37 - sum(floor(claim)) OVER ())::BIGINT AS take FROM g),
 i AS (SELECT ext, (unnest(range(0, take)) * n / take)::DOUBLE AS place FROM t)
 SELECT lang AS ext, doc_id AS ord, 'f' || doc_id AS path FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place FROM documents) d JOIN (SELECT ext, floor(place)::BIGINT AS place FROM i) i ON d.lang = i.ext AND d.place = i.place""",
    "loader_grouping": "SELECT 'conv_' || conv_id AS document, (turn + 1)::INT AS page, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS text_md5, true AS page_count_known FROM conversations GROUP BY conv_id, turn",
    "metadata_scan": f"""SELECT DISTINCT 'conv_' || conv_id AS document, 'Author' AS key, 'email_address' AS category, 'medium' AS severity, 'pattern' AS evidence, {_MASK} AS masked, true AS significant
 FROM (SELECT conv_id, 'user' || conv_id || '@example.org' AS v FROM conversations WHERE conv_id % 5 = 0)""",
    "path_exposure": "SELECT DISTINCT 'conv_' || conv_id AS document, 'origin' AS keys FROM conversations",
    "steps_strip_paths": "SELECT conv_id * 1000 + turn AS ord, 'in.txt' AS origin FROM conversations",
    "loader_uneven_keys": "SELECT * FROM (VALUES ('page', 'page', 1), ('source', 'Source / source', 2), ('title', 'title', 1)) v(key, spellings, loaders)",
    "report_diff": f"""WITH {_FOUND}, s AS (SELECT document, category, {_SUBJECT} AS subject FROM f WHERE category <> 'international_phone')
 SELECT 'identifiers' AS area, CASE category WHEN 'email_address' THEN 'added' ELSE 'removed' END AS kind, document, subject, CASE category WHEN 'email_address' THEN 0 ELSE count(*) END AS before,
 CASE category WHEN 'email_address' THEN count(*) ELSE 0 END AS after, category = 'email_address' AS worse FROM s GROUP BY document, category, subject""",
    "report_documents_diff": "SELECT * FROM (VALUES ('x_ids', 'added'), ('x_cid', 'removed')) v(document, kind)",
    "tables_identifiers": f"""WITH {_FOUND} SELECT document, page, (len(pre) - len(replace(pre, chr(10), '')) + 1)::INT AS line, category, severity, evidence, {_MASK} AS value FROM f""",
    "html_comments": "SELECT page_id, len(list_filter(regexp_extract_all(html, '<!--(.*?)-->', 1), lambda c: len(regexp_replace(c, '[^A-Za-z0-9]', '', 'g')) >= 4))::INT AS comments FROM pages",
    "html_table_count": "SELECT page_id, 0 AS tables FROM pages WHERE NOT contains(html, '<table')",
    "stream_scan": r"SELECT 'email_address' AS category, sum(len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')))::BIGINT AS matches FROM documents",
}
with_three(["extract_masked", "report_diff", "quick_wins", "tables_documents", "tables_identifiers", "report_aggregate"], QUERIES, ORACLES)
