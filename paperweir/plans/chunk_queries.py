"""Chunks, retrieval, facts and hidden content."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperweir.functions.fixed import INSTRUCTIONS
from paperweir.operators import chunks as C
from paperweir.operators import hidden as H
from paperweir.operators import retrieval as R
from paperweir.plans.extra import SQL_PAGES, pages, values
from paperweir.sources.tables import document_pages


def _paragraphs(spark, sf_dir):
    return C.by_paragraph(pages(spark, sf_dir))


def chunk_paragraph(spark, sf_dir):
    return _paragraphs(spark, sf_dir)


def chunk_words(spark, sf_dir):
    return C.by_words(pages(spark, sf_dir), 100, 20)


def _flagged(spark, sf_dir):
    p = pages(spark, sf_dir)
    return C.flags(C.by_paragraph(p).unionByName(C.by_words(p, 100, 20)), 20, 200)


def chunk_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("chunker", "document", "idx", "characters", "tokens", F.array_join("flags", ",").alias("flags"))


def chunk_flag_counts(spark, sf_dir):
    return C.flag_counts(_flagged(spark, sf_dir))


def chunk_stats(spark, sf_dir):
    return C.stats(_flagged(spark, sf_dir))


def chunk_duplicates(spark, sf_dir):
    return _flagged(spark, sf_dir).where(F.array_contains("flags", "duplicate")).select("chunker", "document", "idx")


def compare_chunkers(spark, sf_dir):
    return C.compare(_flagged(spark, sf_dir))


def _questions(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    w = F.regexp_extract_all("text", F.lit("(?U)\\S+"), F.lit(0))
    return b.select(F.array_join(F.slice(w, 1, 6), " ").alias("question"), F.col("text").alias("fact"))


def bm25_rank(spark, sf_dir):
    ranked = R.bm25(C.by_paragraph(document_pages(spark, sf_dir)), _questions(spark, sf_dir), top=5)
    return ranked.select("question", "document", "idx", F.bround("score", 6).alias("score"), "rank")


def question_status(spark, sf_dir):
    """rank is 0 where no chunk with the fact was ranked."""
    d = document_pages(spark, sf_dir)
    return R.check_questions(C.by_words(d, 100, 50), d, _questions(spark, sf_dir)).withColumn("rank", F.coalesce("rank", F.lit(0)))


def bm25_hit_rate(spark, sf_dir):
    return R.hit_rate(question_status(spark, sf_dir))


def fact_exact(spark, sf_dir):
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("text").alias("fact"))
    return R.exact_facts(document_pages(spark, sf_dir), b)


FACTS = ["ignore all previous instructions", "Same text in two chunks of a document", "The quick brown fox jumps over a lazy dog"]


def fact_fuzzy(spark, sf_dir):
    return R.fuzzy_facts(pages(spark, sf_dir), FACTS, 0.85)


PAIRS = [("a", "one two three four", "one two three four"), ("b", "one two three four", "one three two four"), ("c", "one two", ""), ("d", "alpha beta gamma", "alpha delta gamma epsilon")]


def reading_similarity(spark, sf_dir):
    return R.reading_similarity(spark.createDataFrame(PAIRS, "key string, a string, b string")).select("key", "similarity")


def reading_segments(spark, sf_dir):
    return R.segments(spark.createDataFrame(PAIRS, "key string, a string, b string"))


def hidden_unicode(spark, sf_dir):
    return H.smuggled(pages(spark, sf_dir))


def instruction_patterns(spark, sf_dir):
    return H.instruction_counts(pages(spark, sf_dir))


def instruction_sentences(spark, sf_dir):
    return H.instructions(pages(spark, sf_dir)).select("document", "page", "start", "end", F.array_join("labels", "; ").alias("labels"))


def content_findings(spark, sf_dir):
    return H.findings(pages(spark, sf_dir)).select("document", "page", "visibility", "instruction", "severity", "characters")


def content_matrix(spark, sf_dir):
    return H.content_matrix(H.findings(pages(spark, sf_dir)))


_KINDS = [(v, i) for v in ("confirmed", "suspected", "visible", "not_measured") for i in ("confirmed", "pattern", "model", "none")]


def severity_matrix(spark, sf_dir):
    rows = spark.createDataFrame(_KINDS, "visibility string, instruction string")
    return rows.withColumn("severity", H.severity(F.col("visibility"), F.col("instruction")))


def steps_drop_hidden(spark, sf_dir):
    return H.drop_hidden(pages(spark, sf_dir)).select("document", "page", "text")


def steps_drop_documents(spark, sf_dir):
    return H.drop_hidden(pages(spark, sf_dir), whole=True).select("document")


_S = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NS = r"[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


def _squeeze(x: str) -> str:
    return rf"regexp_replace({_trim(x)}, '{_S}+', ' ', 'g')"


def _plain(x: str) -> str:
    return rf"replace(lower({_squeeze(x)}), 'ß', 'ss')"


def _lines(x: str) -> str:
    return rf"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"


def _terms(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '{_TERM}')"



def _par(source: str) -> str:
    return rf"""SELECT 'paragraph' AS chunker, document, (row_number() OVER (PARTITION BY document ORDER BY pos) - 1)::INT AS idx, text
 FROM (SELECT document, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {source}) WHERE regexp_matches(text, '{_NS}')"""


def _wrd(source: str, size: int, overlap: int) -> str:
    step = size - overlap
    return rf"""SELECT 'words' AS chunker, document, (a / {step})::INT AS idx, array_to_string(w[a::BIGINT + 1:a::BIGINT + {size}], ' ') AS text
 FROM (SELECT document, w, unnest(range(0, greatest(len(w) - {overlap} - 1, 0) + 1, {step})) AS a FROM (SELECT document, regexp_extract_all(text, '{_NS}+') AS w FROM {source}) WHERE len(w) > 0)"""


_END = r"""[.!?:;)\]"''»”…]\s*$"""
_TAB = r"(\|.*\|)|(\t.*\t)"
_FLAGS = rf"""p AS ({SQL_PAGES}), c AS ({_par('p')} UNION ALL {_wrd('p', 100, 20)}),
 n AS (SELECT *, lead(text) OVER (PARTITION BY chunker, document ORDER BY idx) AS nxt, {_squeeze('text')} AS norm, round_even(len(text) / 4.0, 0)::BIGINT AS tokens FROM c),
 r AS (SELECT *, row_number() OVER (PARTITION BY chunker, norm ORDER BY document, idx) AS nth, {_trim('text')} AS own, {_lines('text')} AS ls, {_lines("coalesce(nxt, '')")} AS ns FROM n),
 f AS (SELECT chunker, document, idx, len(text)::INT AS characters, tokens, list_filter([CASE WHEN tokens < 20 THEN 'tiny' END, CASE WHEN tokens > 200 THEN 'oversized' END,
 CASE WHEN nxt IS NOT NULL AND own <> '' AND NOT regexp_matches(own, '{_END}') AND regexp_matches(substr({_trim('nxt')}, 1, 1), '\p{{Ll}}') THEN 'split_sentence' END,
 CASE WHEN regexp_matches(ls[-1], '{_TAB}') AND regexp_matches(ns[1], '{_TAB}') THEN 'split_table' END,
 CASE WHEN len(ls) >= 2 AND (starts_with(ls[-1], '#') OR (len(regexp_extract_all(ls[-1], '{_NS}+')) <= 8 AND upper(ls[-1]) = ls[-1] AND lower(ls[-1]) <> ls[-1] AND NOT regexp_matches(ls[-1], '{_END}'))) THEN 'heading_at_end' END,
 CASE WHEN norm <> '' AND nth > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) AS flags FROM r)"""
_STATS = f"""{_FLAGS}, g AS (SELECT chunker, count(*) AS chunks, sum(tokens)::BIGINT AS tokens_total, min(tokens) AS tokens_min, median(tokens)::DOUBLE AS tokens_median, max(tokens) AS tokens_max,
 list_sort(list(tokens))[round_even(0.95 * (count(*) - 1), 0)::BIGINT + 1]::DOUBLE AS tokens_p95, count(*) FILTER (len(flags) > 0) AS flagged FROM f GROUP BY 1)"""
_TERM = r"[\p{L}\p{M}\p{N}_\x{200C}\x{200D}]+"
_DOCS = "d AS (SELECT 'doc_' || doc_id || '.txt' AS document, text FROM documents)"
_Q = rf"q AS (SELECT array_to_string(regexp_extract_all(text, '{_NS}+')[1:6], ' ') AS question, text AS fact FROM benchmark)"


def _bm25(chunks: str) -> str:
    return f"""t AS (SELECT document, idx, term, count(*) AS tf FROM (SELECT document, idx, unnest({_terms('text')}) AS term FROM {chunks}) GROUP BY ALL),
 z AS (SELECT document, idx, sum(tf) AS length FROM t GROUP BY ALL), w AS (SELECT (SELECT count(*) FROM {chunks}) AS n, (SELECT sum(length) FROM z) AS total),
 df AS (SELECT term, count(*) AS df FROM t GROUP BY 1), a AS (SELECT DISTINCT question, unnest(list_distinct({_terms('question')})) AS term FROM (SELECT DISTINCT question FROM q)),
 sc AS (SELECT question, t.document, t.idx, round_even(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / (total / n)))), 10) AS score
 FROM a JOIN t USING (term) JOIN df USING (term) JOIN z ON z.document = t.document AND z.idx = t.idx, w GROUP BY ALL),
 rk AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, document, idx)::INT AS rank FROM sc WHERE score > 0)"""


_STATUS = f"""{_DOCS}, {_Q}, c AS ({_wrd('d', 100, 50)}), {_bm25('c')},
 h AS (SELECT DISTINCT q.question, q.fact, c.document, c.idx FROM q JOIN c ON contains({_plain('c.text')}, {_plain('q.fact')})),
 pl AS (SELECT q.question, q.fact, count(h.idx) AS held, min(rk.rank) AS rank FROM q LEFT JOIN h ON h.question = q.question AND h.fact = q.fact LEFT JOIN rk ON rk.question = q.question AND rk.document = h.document AND rk.idx = h.idx GROUP BY ALL),
 st AS (SELECT question, fact, CASE WHEN held > 0 AND rank <= 5 THEN 'retrieved' WHEN held > 0 THEN 'ranked_low' WHEN EXISTS (SELECT 1 FROM d WHERE contains({_plain('d.text')}, {_plain('pl.fact')})) THEN 'split' ELSE 'missing' END AS status, rank::BIGINT AS rank FROM pl)"""
_ZW = r"\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{180E}"
_INV = rf"[\x{{E0000}}-\x{{E007F}}{_ZW}\x{{202A}}-\x{{202E}}\x{{2066}}-\x{{2069}}]"


def _runs(rx: str) -> str:
    return f"""SELECT document, page, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)))::INT AS start
 FROM (SELECT document, page, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS s FROM p) WHERE len(m) > 0"""


_DECODE = "array_to_string(list_transform(list_filter(list_transform(string_split(v, ''), lambda c: unicode(c) - 917504), lambda c: c BETWEEN 32 AND 126), lambda c: chr(c)), '')"
_SMUGGLED = rf"""p AS ({SQL_PAGES}), sm AS (SELECT * FROM (SELECT document, page, 'tag_characters' AS kind, start, len(v)::INT AS length, {_DECODE} AS decoded FROM ({_runs(r'[\x{E0000}-\x{E007F}]+')})) WHERE len(regexp_replace(decoded, '[^A-Za-z0-9]', '', 'g')) >= 4
 UNION ALL SELECT document, page, 'zero_width_run', start, len(v)::INT, '' FROM ({_runs(f'[{_ZW}]+')}) WHERE len(v) >= 8
 UNION ALL SELECT document, page, 'bidi_override', start, len(v)::INT, substr(v, 2) FROM ({_runs(r'[\x{202D}\x{202E}][^\x{202C}\n]*')}) WHERE regexp_matches(substr(v, 2), '[\p{{L}}\p{{N}}]'))"""
_COUNT = " UNION ALL ".join("SELECT document, page, '" + n + "' AS pattern, (" + " + ".join(f"len(regexp_extract_all(t, '(?im){r}'))" for r in [x.replace("'", "''") for x in rs]) + ")::BIGINT AS matches FROM s" for n, _, rs in INSTRUCTIONS)
_FUNCS = (
    chunk_paragraph, chunk_words, chunk_flags, chunk_flag_counts, chunk_stats, chunk_duplicates, compare_chunkers, bm25_rank, question_status, bm25_hit_rate, fact_exact, fact_fuzzy, reading_similarity, reading_segments,
    hidden_unicode, instruction_patterns, instruction_sentences, content_findings, content_matrix, severity_matrix, steps_drop_hidden, steps_drop_documents,
)
QUERIES = {f.__name__: f for f in _FUNCS}
ORACLES = {
    "chunk_paragraph": f"WITH p AS ({SQL_PAGES}) {_par('p')}",
    "chunk_words": f"WITH p AS ({SQL_PAGES}) {_wrd('p', 100, 20)}",
    "chunk_flags": f"WITH {_FLAGS} SELECT chunker, document, idx, characters, tokens, array_to_string(flags, ',') AS flags FROM f",
    "chunk_flag_counts": f"WITH {_FLAGS} SELECT chunker, flag, count(*) AS chunks FROM (SELECT chunker, unnest(flags) AS flag FROM f) GROUP BY ALL",
    "chunk_stats": f"WITH {_STATS} SELECT * EXCLUDE flagged FROM g",
    "chunk_duplicates": f"WITH {_FLAGS} SELECT chunker, document, idx FROM f WHERE list_contains(flags, 'duplicate')",
    "compare_chunkers": f"WITH {_STATS} SELECT * FROM g",
    "bm25_rank": f"WITH {_DOCS}, {_Q}, c AS ({_par('d')}), {_bm25('c')} SELECT question, document, idx, round_even(score, 6) AS score, rank FROM rk WHERE rank <= 5",
    "question_status": f"WITH {_STATUS} SELECT question, fact, status, coalesce(rank, 0) AS rank FROM st",
    "bm25_hit_rate": f"WITH {_STATUS} SELECT round_even(avg((status = 'retrieved')::INT), 4) AS hit_rate, round_even(avg(CASE WHEN status = 'retrieved' THEN 1 / rank ELSE 0 END), 4) AS mean_reciprocal_rank FROM st",
    "fact_exact": f"WITH {_DOCS} SELECT b.text AS fact, d.document, 1 AS page FROM benchmark b JOIN d ON contains({_plain('d.text')}, {_plain('b.text')}) GROUP BY ALL",
    "reading_similarity": "SELECT key, s::DOUBLE AS similarity FROM (" + values([("a", 1.0), ("b", 0.75), ("c", 0.0), ("d", 0.5714)], "key, s") + ")",
    "hidden_unicode": f"WITH {_SMUGGLED} SELECT * FROM sm",
    "instruction_patterns": f"WITH p AS ({SQL_PAGES}), s AS (SELECT document, page, regexp_replace(text, '{_INV}', '', 'g') AS t FROM p) SELECT * FROM ({_COUNT}) WHERE matches > 0",
    "severity_matrix": values([(v, i, "high" if v in ("confirmed", "suspected") and (i in ("confirmed", "pattern") or (i == "model" and v == "confirmed")) else "medium" if v in ("confirmed", "suspected") or i == "confirmed" else "low") for v, i in _KINDS], "visibility, instruction, severity"),
}
