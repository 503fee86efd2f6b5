"""Context, overlaps, places and masks on inline rows."""

import random

from paperweir.operators import identifiers as I

PAGE = ["document", "page"]


def pages(spark, *texts):
    return spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(texts)], "document string, page int, text string")


def found(spark, *texts, **kw):
    return [(r.document, r.category, r.line, r.column, r.masked, r.evidence) for r in I.scan(pages(spark, *texts), PAGE, **kw).orderBy("document", "line", "column").collect()]


def test_context_is_needed(spark):
    assert found(spark, "account number: 12345678", "reference 12345678 of today") == [("d0", "bank_account_number", 1, 16, "••••5678", "corroborated")]


def test_longest_wins_and_places_are_per_line(spark):
    got = found(spark, "a\nb 4111 1111 1111 1111 c", "\U000e0041\U000e0042 mail x.y@example.org")
    assert got == [("d0", "card_number", 2, 2, "•••• •••• •••• 1111", "confirmed"), ("d1", "email_address", 1, 8, "•.•@•••••••.org"[:0] + "•.•@••••••e.org", "pattern")]


def test_failing_checksum_is_dropped_and_null_text_is_unreadable(spark):
    p = pages(spark, "card 4111 1111 1111 1112", None, " ")
    assert I.scan(p, PAGE).count() == 0
    assert sorted(r.document for r in I.unreadable(p, PAGE).collect()) == ["d1", "d2"]


def test_reveal_never_shows_cards(spark):
    r = {x.category: x.revealed for x in I.scan(pages(spark, "4111 1111 1111 1111 and a@example.org"), PAGE, reveal=True).collect()}
    assert r == {"card_number": None, "email_address": "a@example.org"}


def test_key_columns_may_have_any_name(spark):
    p = spark.createDataFrame([("k", 7, "a@example.org")], "value string, line int, text string")
    assert [tuple(r)[:3] for r in I.scan(p, ["value", "line"]).select("value", "category", "masked").collect()] == [("k", "email_address", "•@••••••e.org")]


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(4)
    exclusive = [c.id for c in I.CATEGORIES if c.exclusive]
    rows, want = [], set()
    for d in range(60):
        mine = []
        for n in range(rng.randint(0, 8)):
            s, size = rng.randint(0, 20), rng.randint(1, 8)
            mine.append((f"d{d}", 1, n, rng.choice(exclusive), s, "x" * size, rng.choice([None, "t"]), rng.choice([1.0, 0.8]), 1, s))
        rows += mine
        taken = []
        for r in sorted(mine, key=lambda r: (-len(r[5]), r[6] is None, -r[7], r[2], r[4])):
            if all(r[4] >= b or a >= r[4] + len(r[5]) for a, b in taken):
                taken.append((r[4], r[4] + len(r[5])))
                want.add((r[0], r[2]))
    df = spark.createDataFrame(rows, "document string, page int, ord int, category string, start int, value string, term string, confidence double, line int, column int")
    assert {(r.document, r.ord) for r in I.resolved(df, PAGE).collect()} == want


def test_partitions_do_not_matter(spark):
    p = pages(spark, *[f"write to a{i}@example.org or 4111 1111 1111 1111" for i in range(20)])
    a, b = (sorted(map(str, I.scan(p.repartition(n), PAGE).collect())) for n in (1, 5))
    assert a == b and len(a) == 40


# One text that each category is found in, and one that is a digit, a term or a checksum short of it.
SAMPLES = {
    "ni_number": ("NI number AB123456C here", "NI number BG123456C here"), "sort_code": ("sort code 20-30-40", "sort code 11-11-11"), "bank_account_number": ("account number: 12345678", "reference 12345678"),
    "iban": ("IBAN GB82 WEST 1234 5698 7654 32", "IBAN GB82 WEST 1234 5698 7654 33"), "card_number": ("card 4111 1111 1111 1111", "card 4111 1111 1111 1112"), "uk_postcode": ("at SW1A 1AA", "at QQ1A 1AA"),
    "street_address": ("at 10 Long Meadow Street", "at Long Meadow Street"), "email_address": ("to a.b@example.org", "to a.b@example"), "phone_number": ("call 020 7946 0958", "call 060 7946 0958"),
    "date_of_birth": ("date of birth 12/03/1980", "signed on 12/03/1980"), "vat_number": ("VAT GB 123 4567 82", "VAT GB 123 4567 83"), "utr": ("UTR 1234567890", "order 1234567890"),
    "us_ssn": ("SSN 123-45-6789", "SSN 666-45-6789"), "us_ein": ("EIN 12-3456789", "EIN 07-3456789"), "us_routing_number": ("routing 021000021", "routing 021000022"), "ie_pps": ("PPS 1234567T", "PPS 1234567W"),
    "nl_bsn": ("BSN 111222333", "BSN 111222334"), "pt_nif": ("NIF 123456789", "NIF 123456788"), "es_dni": ("DNI 12345678Z", "DNI 12345678A"), "fr_nir": ("NIR 1 84 12 76 451 089 46", "NIR 1 84 12 76 451 089 47"),
    "de_steuer_id": ("Steuer-ID 86095742719", "Steuer-ID 86095742710"), "eu_vat_number": ("btw DE123456789", "btw DE12345678"), "international_phone": ("call +1 212 555 0123", "call +44 20 7946 0958"),
    "us_phone": ("phone (212) 555-0123", "phone (112) 555-0123"), "us_zip_code": ("zip code 90210", "number 90210"), "ca_postal_code": ("in K1A 0B1", "in D1A 0B1"), "eu_postal_code": ("PLZ 10115", "Nummer 10115"),
    "br_cep": ("CEP: 01310-100", "item 01310-100"), "it_codice_fiscale": ("RSSMRA85T10A562S", "RSSMRA85T10A562T"), "be_national_number": ("rijksregister 85.07.30-033.28", "rijksregister 85.07.30-033.29"),
    "pl_pesel": ("PESEL 44051401359", "PESEL 44051401358"), "se_personnummer": ("personnummer 811228-9874", "personnummer 811228-9875"), "dk_cpr": ("CPR 010190-1234", "CPR 321390-1234"),
    "ch_ahv": ("AHV 756.9217.0769.85", "AHV 756.9217.0769.84"), "br_cpf": ("CPF 529.982.247-25", "CPF 529.982.247-26"), "br_cnpj": ("CNPJ 11.222.333/0001-81", "CNPJ 11.222.333/0001-82"),
    "in_aadhaar": ("Aadhaar 2341 2341 2346", "Aadhaar 2341 2341 2347"), "in_pan": ("PAN no ABCPE1234F", "PAN no ABCXE1234F"), "ca_sin": ("social insurance 130 692 544", "social insurance 130 692 545"),
    "au_tfn": ("TFN 123 456 782", "TFN 123 456 783"),
}


def test_every_category_is_found_and_not_found(spark):
    assert set(SAMPLES) | {"person_name", "organisation_name"} == {c.id for c in I.CATEGORIES}
    rows = [(f"{c}/{kind}", 1, t) for c, pair in SAMPLES.items() for kind, t in zip(("yes", "no"), pair)]
    p = spark.createDataFrame(rows, "document string, page int, text string")
    # Each category for itself: no other competes for the same characters.
    by_pattern = I.validated(I.candidates(p, None), "2026-01-01")
    got = {(r.document, r.category) for r in by_pattern.select("document", "category").distinct().collect()}
    assert [c for c in SAMPLES if (f"{c}/yes", c) not in got] == []
    assert [c for c in SAMPLES if (f"{c}/no", c) in got] == []


def test_counts_repeats_and_masks_follow_from_the_scan(spark):
    p = pages(spark, *[t for pair in SAMPLES.values() for t in pair], "card 4111 1111 1111 1111 and a.b@example.org", "card 4111 1111 1111 1111")
    found = I.scan(p, PAGE).cache()
    rows = found.collect()
    from collections import Counter

    assert {(r.category, r.severity): r.matches for r in I.counts(found, "category", "severity").collect()} == Counter((r.category, r.severity) for r in rows)
    seen = {}
    for r in rows:
        seen.setdefault((r.label, r.masked), set()).add(r.document)
    assert {(r.label, r.masked): r.units for r in I.repeated(found, "document").collect()} == {k: len(v) for k, v in seen.items() if len(v) > 1}
    texts = {r.document: r.text for r in p.collect()}
    rank = {"confirmed": 0, "corroborated": 1, "model": 2, "pattern": 3}
    for r in I.mask_matches(p, found, PAGE).collect():
        lines, done, n = texts[r.document].split("\n"), set(), 0
        for m in sorted((m for m in rows if m.document == r.document), key=lambda m: (rank[m.evidence], m.line, m.column, m.length, m.masked)):
            free = [i for i in range(m.column, m.column + m.length) if (m.line, i) not in done]
            line = list(lines[m.line - 1])
            for i in free:
                line[i] = m.masked[i - m.column]
            lines[m.line - 1] = "".join(line)
            done |= {(m.line, i) for i in range(m.column, m.column + m.length)}
            n += bool(free)
        assert (r.text, r.replaced) == ("\n".join(lines), n)


def test_many_matches_on_one_long_line_are_masked_in_one_go(spark):
    import time

    text = " ".join(f"user{i}@example.org said so and so" for i in range(1500))
    p = pages(spark, text)
    found = I.scan(p, PAGE, ["email_address"])
    assert found.count() == 1500
    began = time.time()
    (r,) = I.mask_matches(p, found, PAGE).collect()
    assert time.time() - began < 30
    assert r.replaced == 1500 and "@example" not in r.text and len(r.text) == len(text)


def test_pages_are_searched_once(spark):
    p = pages(spark, "4111 1111 1111 1111 and a@example.org")
    plan = I.scan(p, PAGE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_masked_pages_keep_other_columns_and_repeated_rows(spark):
    p = pages(spark, "to a@example.org", None, "nothing").selectExpr("*", "upper(document) AS other")
    p = p.union(p)
    got = [tuple(r) for r in I.mask_matches(p, I.scan(p, PAGE), PAGE, keep=["other"]).orderBy("document").collect()]
    assert got == [(d, 1, d.upper(), t, n, 0) for d, t, n in [("d0", "to •@••••••e.org", 1), ("d1", None, 0), ("d2", "nothing", 0)] for _ in range(2)]
