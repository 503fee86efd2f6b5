"""Signals, scores and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperweir.operators import cost as C
from paperweir.operators import signals as S
from paperweir.functions.fixed import MODELS, PRESETS
from paperweir.plans.extra import SQL_PAGES, pages, values
from paperweir.plans.identifier_queries import _FOUND, found, with_three
from paperweir.sources.tables import conversation_pages

_GARBLED = r"""CASE WHEN len(text) >= 200 THEN round_even((len(regexp_extract_all(text, '[\x{FFFD}\x{FB00}-\x{FB06}]'))
 + len(list_filter(list_filter(regexp_extract_all(text, '[^\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{15,}'), lambda w: regexp_matches(w, '\p{L}')),
 lambda w: len(regexp_extract_all(w, '[a-z][A-Z]')) >= 2 OR (len(w) >= 25 AND regexp_full_match(w, '\p{L}+'))))) / len(text) * 1000, 2) END"""
_UNMAPPED = r"CASE WHEN len(text) >= 200 THEN round_even(len(regexp_extract_all(text, '\(cid:\d+\)|[\x{E000}-\x{F8FF}]|[\x00-\x08\x0B\x0C\x0E-\x1F]')) / len(text) * 1000, 2) END"
_WORDS = r"len(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_\x{200C}\x{200D}]+'))"
_HYPHEN = rf"CASE WHEN {_WORDS} >= 100 THEN round_even(len(regexp_extract_all(text, '[a-z]{{2,}}-[ \t]*\n[ \t]*[a-z]{{2,}}')) / {_WORDS} * 1000, 2) END"
_FAM = [f"len(regexp_extract_all(text, '{f}'))" for f in S.DATE_FAMILIES]
_DATES = f"CASE WHEN {' + '.join(_FAM)} >= 3 THEN round_even(greatest({', '.join(_FAM)}) / ({' + '.join(_FAM)}) * 100, 2) END"
_SIGNALS = {"garbled_char_rate": _GARBLED, "unmapped_glyphs": _UNMAPPED, "hyphenated_line_breaks": _HYPHEN, "date_format_consistency": _DATES}
_RULES = {
    "garbled_char_rate": (0.09, "CASE WHEN value < 1 THEN 1.0 WHEN value < 5 THEN 0.5 ELSE 0.0 END"), "unmapped_glyphs": (0.03, "CASE WHEN value < 0.5 THEN 1.0 WHEN value < 5 THEN 0.5 ELSE 0.0 END"),
    "hyphenated_line_breaks": (0.02, "CASE WHEN value < 2 THEN 1.0 WHEN value < 10 THEN 0.5 ELSE 0.0 END"), "date_format_consistency": (0.04, "CASE WHEN value >= 90 THEN 1.0 WHEN value >= 60 THEN 0.5 ELSE 0.0 END"),
    "text_layer_present": (0.12, "CASE WHEN value = 1 THEN 1.0 ELSE 0.0 END"),
}
_ALL = f"p AS ({SQL_PAGES}), s AS (" + " UNION ALL ".join(f"SELECT document, '{n}' AS signal, {e} AS value FROM p" for n, e in _SIGNALS.items()) + " UNION ALL SELECT document, 'text_layer_present', (text_source = 'native')::INT::DOUBLE FROM p)"
_POINTS = "CASE signal " + " ".join(f"WHEN '{n}' THEN {e}" for n, (_, e) in _RULES.items()) + " END"
_WEIGHT = "CASE signal " + " ".join(f"WHEN '{n}' THEN {w}::DOUBLE" for n, (w, _) in _RULES.items()) + " END"
_SCORE = f"""{_ALL}, g AS (SELECT document, sum({_WEIGHT} * {_POINTS}) FILTER (value IS NOT NULL) AS a, sum({_WEIGHT}) FILTER (value IS NOT NULL) AS w,
 count(value) AS counted, count(*) AS n FROM s GROUP BY document), q AS (SELECT document, round_even(round_even(a / w * 100, 9), 1) AS score, counted, counted < n / 2 AS low_confidence FROM g)"""
_BAND = "CASE WHEN score >= 75 THEN 'ready' WHEN score >= 50 THEN 'workable' WHEN score >= 25 THEN 'needs work' WHEN score IS NOT NULL THEN 'not ready' END"


def _signal(name):
    def query(spark, sf_dir):
        return S.text_signals(pages(spark, sf_dir)).where(F.col("signal") == name).select("document", "signal", "value")

    return query, f"SELECT document, '{name}' AS signal, ({_SIGNALS[name]})::DOUBLE AS value FROM ({SQL_PAGES})"


def sig_text_layer(spark, sf_dir):
    return S.text_layer(pages(spark, sf_dir)).select("document", "signal", "value")


def sig_repeated_lines(spark, sf_dir):
    return S.repeated_lines(conversation_pages(spark, sf_dir)).select("document", "signal", "value")


def rated_signals(spark, sf_dir):
    p = pages(spark, sf_dir)
    return S.rated(S.text_signals(p).unionByName(S.text_layer(p)))


def signal_distribution(spark, sf_dir):
    return S.rating_distribution(rated_signals(spark, sf_dir))


def readiness_score(spark, sf_dir):
    return S.scores(rated_signals(spark, sf_dir))


def readiness_bands(spark, sf_dir):
    return S.distribution(readiness_score(spark, sf_dir))


def exposure_score(spark, sf_dir, categories=None):
    return S.exposure(pages(spark, sf_dir), found(spark, sf_dir, categories))


def overall_readiness(spark, sf_dir, categories=None):
    p = pages(spark, sf_dir)
    return S.overall(readiness_score(spark, sf_dir), S.cost_factor(p), exposure_score(spark, sf_dir, categories))


def cost_text(spark, sf_dir):
    return C.text_costs(pages(spark, sf_dir), C.models(spark))


def cost_cheapest(spark, sf_dir):
    return C.cheapest(cost_text(spark, sf_dir))


def cost_folder(spark, sf_dir):
    return C.folder(cost_text(spark, sf_dir))


def cost_volume(spark, sf_dir):
    return C.volume(cost_text(spark, sf_dir))


def cost_architecture(spark, sf_dir):
    return C.architectures(pages(spark, sf_dir), cost_text(spark, sf_dir))


SIZES = [("a4", 1, 595.0, 842.0), ("letter", 1, 612.0, 792.0), ("slide", 1, 960.0, 540.0), ("strip", 1, 100.0, 2000.0), ("none", 1, 0.0, 100.0), ("icon", 1, 32.0, 32.0)]


def vision_tokens(spark, sf_dir):
    sizes = spark.createDataFrame(SIZES, "document string, page int, width_pt double, height_pt double")
    return C.vision_costs(sizes, C.models(spark), C.presets(spark)).select("document", "model", "preset", "tokens")


_COST = f"""p AS ({SQL_PAGES}), m AS ({values(MODELS, 'model, usd_per_mtok, formula')}), t AS (SELECT document, text_source, round_even(len(text) / 4.0, 0)::BIGINT AS tokens FROM p),
 c AS (SELECT document, text_source, model, tokens, CASE WHEN tokens > 0 THEN tokens / 1e6 * usd_per_mtok::DOUBLE END AS usd FROM t, m)"""
QUERIES, ORACLES = {}, {}
for _name, _signal_name in (("sig_garbled", "garbled_char_rate"), ("sig_unmapped", "unmapped_glyphs"), ("sig_hyphen", "hyphenated_line_breaks"), ("sig_dates", "date_format_consistency")):
    QUERIES[_name], ORACLES[_name] = _signal(_signal_name)
for _f in (sig_text_layer, sig_repeated_lines, signal_distribution, readiness_score, readiness_bands, exposure_score, overall_readiness, cost_text, cost_cheapest, cost_folder, cost_volume, cost_architecture, vision_tokens):
    QUERIES[_f.__name__] = _f
ORACLES |= {
    "sig_text_layer": f"SELECT document, 'text_layer_present' AS signal, (text_source = 'native')::INT::DOUBLE AS value FROM ({SQL_PAGES})",
    "sig_repeated_lines": r"""WITH p AS (SELECT 'conv_' || conv_id AS document, turn + 1 AS page, text FROM conversations WHERE regexp_matches(text, '[^\s]')),
 n AS (SELECT document, count(*) AS n FROM p GROUP BY 1),
 l AS (SELECT document, page, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM (SELECT document, page, unnest(string_split(text, chr(10))) AS line FROM p)),
 k AS (SELECT document, replace(lower(regexp_replace(line, '\d+', '#', 'g')), 'ß', 'ss') AS key, count(DISTINCT page) AS seen, sum(len(line)) AS chars FROM l WHERE len(line) >= 3 GROUP BY 1, 2),
 s AS (SELECT k.document, sum(CASE WHEN seen >= greatest(2, ceil(n * 0.5)) THEN chars ELSE 0 END) / sum(chars) * 100 AS v FROM k JOIN n USING (document) GROUP BY 1)
 SELECT n.document, 'repeated_page_lines' AS signal, CASE WHEN n >= 3 THEN coalesce(round_even(v, 2), 0) END AS value FROM n LEFT JOIN s USING (document)""",
    "signal_distribution": f"""WITH {_ALL} SELECT signal, CASE WHEN value IS NULL THEN 'not_applicable' WHEN {_POINTS} = 1 THEN 'good' WHEN {_POINTS} = 0.5 THEN 'fair' ELSE 'poor' END AS state, count(*) AS documents FROM s GROUP BY 1, 2""",
    "readiness_score": f"WITH {_SCORE} SELECT document, score, {_BAND} AS label, counted, low_confidence FROM q",
    "readiness_bands": f"WITH {_SCORE} SELECT {_BAND} AS label, count(*) AS documents FROM q WHERE score IS NOT NULL GROUP BY 1",
    "exposure_score": f"""WITH {_FOUND}, w AS (SELECT document, sum(CASE severity WHEN 'high' THEN 3 ELSE 2 END * CASE evidence WHEN 'confirmed' THEN 1.0 ELSE 0.5 END) AS w FROM f GROUP BY 1)
 SELECT p.document, round_even(greatest(0, 100 - coalesce(w, 0) * 4)::DOUBLE, 1) AS exposure FROM p LEFT JOIN w USING (document)""",
    "overall_readiness": f"""WITH {_SCORE}, {_FOUND.replace('p AS (' + SQL_PAGES + '), ', '', 1)}, w AS (SELECT document, sum(CASE severity WHEN 'high' THEN 3 ELSE 2 END * CASE evidence WHEN 'confirmed' THEN 1.0 ELSE 0.5 END) AS w FROM f GROUP BY 1),
 a AS (SELECT p.document, q.score AS content, CASE WHEN text_source = 'native' THEN 100.0 ELSE 0.0 END::DOUBLE AS cost, round_even(greatest(0, 100 - coalesce(w, 0) * 4)::DOUBLE, 1) AS exposure FROM p LEFT JOIN q USING (document) LEFT JOIN w USING (document))
 SELECT *, round_even(round_even((coalesce(content * 0.5, 0) + cost * 0.25 + exposure * 0.25) / (CASE WHEN content IS NULL THEN 0.5 ELSE 1 END), 9), 1) AS global_score FROM a""",
    "cost_text": f"WITH {_COST} SELECT document, model, tokens, usd FROM c",
    "cost_cheapest": f"WITH {_COST} SELECT document, min(usd) AS usd, arg_min(model, usd) AS model FROM c WHERE usd IS NOT NULL GROUP BY 1",
    "cost_folder": f"WITH {_COST} SELECT model, count(usd) AS documents, round_even(sum(usd), 9) AS usd FROM c GROUP BY 1",
    "cost_volume": f"WITH {_COST} SELECT model, round_even(avg(usd) * 10000, 6) AS monthly_usd, round_even(avg(usd) * 120000, 6) AS annual_usd FROM c GROUP BY 1",
    "cost_architecture": f"""WITH {_COST}, x AS (SELECT model, usd, unnest(['text_layer', 'text_ocr']) AS architecture FROM c WHERE usd IS NOT NULL AND text_source = 'native')
 SELECT model, architecture, count(*) AS documents, round_even(count(*) / (SELECT count(*) FROM p) * 100, 2) AS reach_pct, round_even(sum(usd), 9) AS usd, round_even(sum(usd) / count(*) * 1000, 9) AS usd_per_1000 FROM x GROUP BY 1, 2""",
    "vision_tokens": f"""WITH s AS ({values(SIZES, 'document, page, width_pt, height_pt')}), m AS ({values(MODELS, 'model, usd_per_mtok, formula')}), r AS ({values(PRESETS, 'preset, long_edge')}),
 d AS (SELECT document, model, formula, preset, CASE WHEN width_pt > 0 AND height_pt > 0 THEN greatest(1, round_even(width_pt::DOUBLE * (long_edge / greatest(width_pt, height_pt)::DOUBLE), 0)) ELSE 0 END AS w,
 CASE WHEN width_pt > 0 AND height_pt > 0 THEN greatest(1, round_even(height_pt::DOUBLE * (long_edge / greatest(width_pt, height_pt)::DOUBLE), 0)) ELSE 0 END AS h FROM s, m, r),
 e AS (SELECT *, least(1.0::DOUBLE, 2000 / greatest(w, h), 768 / least(w, h)) AS k FROM d)
 SELECT document, model, preset, CASE WHEN w <= 0 OR h <= 0 THEN 0 WHEN formula = 'width_height' THEN round_even(least(w * h / 750, 1600), 0)
 WHEN formula = 'tiled' THEN 85 + 170 * ceil(greatest(1, round_even(w * k, 0)) / 512) * ceil(greatest(1, round_even(h * k, 0)) / 512)
 WHEN w <= 384 AND h <= 384 THEN 258 ELSE ceil(w / 384) * ceil(h / 384) * 258 END::BIGINT AS tokens FROM e""",
}
with_three(["exposure_score", "overall_readiness"], QUERIES, ORACLES)
