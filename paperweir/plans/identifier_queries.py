"""Identifier queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from paperweir.functions.validators import VALIDATORS
from paperweir.operators import identifiers as I
from paperweir.plans.extra import SQL_PAGES, pages, values
from paperweir.sources.tables import PAGE, document_pages

THREE = ["email_address", "card_number", "international_phone"]
_RX = {
    "email_address": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "card_number": r"\b(?:\d[ -]?){12,18}\d\b",
    "international_phone": r"\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}\b",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_ISSUER = """((d[1:1] = '4' AND len(d) IN (13, 16, 19)) OR (d[1:2] BETWEEN '51' AND '55' AND len(d) = 16) OR (d[1:4] BETWEEN '2221' AND '2720' AND len(d) = 16)
 OR (d[1:2] IN ('34', '37') AND len(d) = 15) OR (d[1:4] = '6011' AND len(d) BETWEEN 16 AND 19) OR (d[1:3] BETWEEN '644' AND '649' AND len(d) BETWEEN 16 AND 19)
 OR (d[1:2] = '65' AND len(d) BETWEEN 16 AND 19) OR (d[1:3] BETWEEN '300' AND '305' AND len(d) BETWEEN 14 AND 19) OR (d[1:2] IN ('36', '38', '39') AND len(d) BETWEEN 14 AND 19)
 OR (d[1:4] BETWEEN '3528' AND '3589' AND len(d) BETWEEN 16 AND 19) OR (d[1:2] = '62' AND len(d) BETWEEN 16 AND 19) OR (d[1:2] = '50' AND len(d) BETWEEN 12 AND 19)
 OR (d[1:2] BETWEEN '56' AND '69' AND len(d) BETWEEN 12 AND 19) OR (d[1:4] BETWEEN '2200' AND '2204' AND len(d) BETWEEN 16 AND 19) OR (d[1:2] IN ('60', '81', '82') AND len(d) = 16)
 OR (d[1:3] = '508' AND len(d) = 16) OR (d[1:1] = '1' AND len(d) = 15))"""
_LUHN = """list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN d[len(d) - i + 1]::INT
 WHEN d[len(d) - i + 1]::INT * 2 > 9 THEN d[len(d) - i + 1]::INT * 2 - 9 ELSE d[len(d) - i + 1]::INT * 2 END)) % 10 = 0"""
_OK = {
    "email_address": "true",
    "card_number": f"len(d) BETWEEN 12 AND 19 AND {_ISSUER} AND {_LUHN}",
    "international_phone": "NOT starts_with(d, '44') AND len(d) BETWEEN 8 AND 15",
}


def _hits(category: str) -> str:
    rx = _RX[category]
    return f"""SELECT document, page, '{category}' AS category, v, st, text FROM (
 SELECT document, page, text, unnest(m) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(s[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0)))::BIGINT AS st
 FROM (SELECT document, page, text, regexp_extract_all(text, '{rx}') AS m, regexp_split_to_array(text, '{rx}') AS s FROM p) WHERE len(m) > 0)
 WHERE (SELECT {_OK[category]} FROM (SELECT {_DIGITS} AS d))"""


_MASK = r"""array_to_string(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN regexp_matches(v[i], '[\p{L}\p{N}]')
 AND (len(regexp_replace(v, '[^\p{L}\p{N}]', '', 'g')) <= 4 OR len(regexp_replace(substr(v, i + 1), '[^\p{L}\p{N}]', '', 'g')) >= 4) THEN '•' ELSE v[i] END), '')"""
_FOUND = f"""p AS ({SQL_PAGES}), c AS ({' UNION ALL '.join(_hits(c) for c in THREE)}),
 k AS (SELECT * FROM c a WHERE a.category = 'email_address' OR NOT EXISTS (SELECT 1 FROM c b WHERE b.document = a.document AND b.page = a.page
 AND b.category <> 'email_address' AND b.category <> a.category AND b.st < a.st + len(a.v) AND a.st < b.st + len(b.v)
 AND (len(b.v) > len(a.v) OR (len(b.v) = len(a.v) AND b.category = 'card_number')))),
 f AS (SELECT document, page, category, v, st, substr(text, 1, st) AS pre, CASE category WHEN 'card_number' THEN 'high' ELSE 'medium' END AS severity,
 CASE category WHEN 'email_address' THEN 'pattern' ELSE 'confirmed' END AS evidence FROM k)"""


def found(spark, sf_dir, categories=None):
    """Matches of all categories, or of some."""
    return I.scan(pages(spark, sf_dir), PAGE, categories)


def with_three(names, queries, oracles):
    """Queries over all categories have no SQL that is short enough to be read; each is also registered over three categories,
    and its SQL checks that one."""
    for name in names:
        queries[name + "_three"] = partial(queries[name], categories=THREE)
        if name in oracles:
            oracles[name + "_three"] = oracles.pop(name)


def _one(category):
    def query(spark, sf_dir):
        return I.scan(pages(spark, sf_dir), PAGE, [category]).select("document", "page", "category", "line", "column", "length", "masked", "severity", "evidence")

    sql = f"""WITH p AS ({SQL_PAGES}), f AS (SELECT *, substr(text, 1, st) AS pre FROM ({_hits(category)}))
 SELECT document, page, category, (len(pre) - len(replace(pre, chr(10), '')) + 1)::INT AS line, len(string_split(pre, chr(10))[-1])::INT AS "column", len(v)::INT AS length,
 {_MASK} AS masked, CASE category WHEN 'card_number' THEN 'high' ELSE 'medium' END AS severity, CASE category WHEN 'email_address' THEN 'pattern' ELSE 'confirmed' END AS evidence FROM f"""
    return query, sql


def _grouped(*by):
    def query(spark, sf_dir, categories=None):
        return I.counts(found(spark, sf_dir, categories), *by)

    return query, f"WITH {_FOUND} SELECT {', '.join(by)}, count(*) AS matches FROM f GROUP BY ALL"


def id_locate(spark, sf_dir, categories=None):
    return found(spark, sf_dir, categories).select("document", "category", "line", "column", "length")


def id_scan_all(spark, sf_dir):
    """Every category over all documents: the full scan."""
    return I.scan(pages(spark, sf_dir), PAGE).select("document", "page", "category", "severity", "line", "column", "masked", "evidence")


def id_unscanned(spark, sf_dir):
    return I.unscanned(document_pages(spark, sf_dir), ["document"]).select("document", "category")


def id_unreadable(spark, sf_dir):
    return I.unreadable(pages(spark, sf_dir), PAGE)


def id_repeated(spark, sf_dir, categories=None):
    return I.repeated(found(spark, sf_dir, categories), "document")


def mask_text(spark, sf_dir, categories=None):
    """Texts of pages that hold a match, masked."""
    p = pages(spark, sf_dir)
    return I.mask_matches(p, found(spark, sf_dir, categories), PAGE).where("replaced > 0")


# Published examples and one-digit corruptions of each rule's numbers.
CASES = [
    ("luhn", "4111 1111 1111 1111", True), ("luhn", "4111 1111 1111 1112", False), ("card_issuer", "4111111111111111", True), ("card_issuer", "20260909103836", False),
    ("iban_mod97", "GB82 WEST 1234 5698 7654 32", True), ("iban_mod97", "GB82 WEST 1234 5698 7654 33", False), ("ni_prefix", "AB123456C", True), ("ni_prefix", "BG123456C", False),
    ("vat_mod97", "GB 123 4567 82", True), ("vat_mod97", "GB 123 4567 83", False), ("sort_code", "20-30-40", True), ("sort_code", "11-11-11", False), ("uk_postcode", "SW1A 1AA", True),
    ("uk_postcode", "QQ1A 1AA", False), ("uk_phone", "020 7946 0958", True), ("uk_phone", "+44 20 7946 0958", True), ("uk_phone", "060 7946 0958", False), ("plausible_dob", "12/03/1980", True),
    ("plausible_dob", "12 March 1980", True), ("plausible_dob", "1890-01-01", False), ("us_ssn", "123-45-6789", True), ("us_ssn", "666-45-6789", False), ("us_ein", "12-3456789", True),
    ("us_ein", "07-3456789", False), ("aba_routing", "021000021", True), ("aba_routing", "021000022", False), ("nl_bsn", "111222333", True), ("nl_bsn", "111222334", False), ("pt_nif", "123456789", True),
    ("pt_nif", "123456788", False), ("es_dni", "12345678Z", True), ("es_dni", "12345678A", False), ("ie_pps", "1234567T", True), ("ie_pps", "1234567W", False), ("fr_nir", "1 84 12 76 451 089 46", True),
    ("fr_nir", "1 84 12 76 451 089 47", False), ("de_steuer_id", "86095742719", True), ("de_steuer_id", "86095742710", False), ("eu_vat", "DE123456789", True), ("eu_vat", "DE12345678", False),
    ("e164_phone", "+1 212 555 0123", True), ("e164_phone", "+44 20 7946 0958", False), ("nanp_phone", "(212) 555-0123", True), ("nanp_phone", "(112) 555-0123", False),
    ("it_codice_fiscale", "RSSMRA85T10A562S", True), ("it_codice_fiscale", "RSSMRA85T10A562T", False), ("be_national_number", "85.07.30-033.28", True), ("be_national_number", "85.07.30-033.29", False),
    ("pl_pesel", "44051401359", True), ("pl_pesel", "44051401358", False), ("se_personnummer", "811228-9874", True), ("se_personnummer", "811228-9875", False), ("dk_cpr", "010190-1234", True),
    ("dk_cpr", "321390-1234", False), ("ch_ahv", "756.9217.0769.85", True), ("ch_ahv", "756.9217.0769.84", False), ("br_cpf", "529.982.247-25", True), ("br_cpf", "529.982.247-26", False),
    ("br_cnpj", "11.222.333/0001-81", True), ("br_cnpj", "11.222.333/0001-82", False), ("in_aadhaar", "2341 2341 2346", True), ("in_aadhaar", "2341 2341 2347", False), ("in_pan", "ABCPE1234F", True),
    ("in_pan", "ABCXE1234F", False), ("ca_sin", "130 692 544", True), ("ca_sin", "130 692 545", False), ("au_tfn", "123 456 782", True), ("au_tfn", "123 456 783", False),
]


def validators_all(spark, sf_dir):
    rows = spark.createDataFrame([(a, b) for a, b, _ in CASES], "validator string, value string")
    ok = F.lit(None).cast("boolean")
    for name, rule in VALIDATORS.items():
        ok = F.when(F.col("validator") == name, rule(F.col("value"))).otherwise(ok)
    return rows.select("validator", "value", ok.alias("valid"))


QUERIES, ORACLES = {}, {}
for _name, _category in (("id_email", "email_address"), ("id_card_number", "card_number"), ("id_intl_phone", "international_phone")):
    QUERIES[_name], ORACLES[_name] = _one(_category)
for _name, _by in (("id_counts_by_category", ("category", "severity", "evidence")), ("id_counts_by_severity", ("severity",)), ("id_evidence", ("evidence",))):
    QUERIES[_name], ORACLES[_name] = _grouped(*_by)
for _f in (id_locate, id_scan_all, id_unscanned, id_unreadable, id_repeated, mask_text, validators_all):
    QUERIES[_f.__name__] = _f
ORACLES["id_locate"] = f"""WITH {_FOUND} SELECT document, category, (len(pre) - len(replace(pre, chr(10), '')) + 1)::INT AS line,
 len(string_split(pre, chr(10))[-1])::INT AS "column", len(v)::INT AS length FROM f"""
ORACLES["id_unscanned"] = "SELECT 'doc_' || doc_id || '.txt' AS document, c AS category FROM documents, (VALUES ('person_name'), ('organisation_name')) v(c)"
ORACLES["id_unreadable"] = f"SELECT document, page FROM ({SQL_PAGES}) WHERE text_source = 'none'"
ORACLES["id_repeated"] = f"""WITH {_FOUND} SELECT * FROM (SELECT CASE category WHEN 'card_number' THEN 'Payment card number' WHEN 'email_address' THEN 'Email address' ELSE 'International phone number' END AS label,
 {_MASK} AS masked, count(DISTINCT document) AS units FROM f GROUP BY ALL) WHERE units > 1"""
ORACLES["validators_all"] = values(CASES, "validator, value, valid").replace("True", "true").replace("False", "false")
with_three(["id_counts_by_category", "id_counts_by_severity", "id_evidence", "id_locate", "id_repeated", "mask_text"], QUERIES, ORACLES)
