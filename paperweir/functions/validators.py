"""Checksum and format rules for identifiers: string column -> boolean column. Digits are ASCII digits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Card prefixes (lowest, highest, valid lengths).
CARD_ISSUERS = [
    ("4", "4", [13, 16, 19]),
    ("51", "55", [16]),
    ("2221", "2720", [16]),
    ("34", "34", [15]),
    ("37", "37", [15]),
    ("6011", "6011", [16, 17, 18, 19]),
    ("644", "649", [16, 17, 18, 19]),
    ("65", "65", [16, 17, 18, 19]),
    ("300", "305", [14, 15, 16, 17, 18, 19]),
    ("36", "36", [14, 15, 16, 17, 18, 19]),
    ("38", "39", [14, 15, 16, 17, 18, 19]),
    ("3528", "3589", [16, 17, 18, 19]),
    ("62", "62", [16, 17, 18, 19]),
    ("50", "50", [12, 13, 14, 15, 16, 17, 18, 19]),
    ("56", "69", [12, 13, 14, 15, 16, 17, 18, 19]),
    ("2200", "2204", [16, 17, 18, 19]),
    ("60", "60", [16]),
    ("81", "82", [16]),
    ("508", "508", [16]),
    ("1", "1", [15]),
]
# Characters after the country code of VAT numbers.
VAT_LENGTHS = {
    "AT": [9], "BE": [10], "BG": [9, 10], "CY": [9], "CZ": [8, 9, 10], "DE": [9], "DK": [8], "EE": [9], "EL": [9], "ES": [9],
    "FI": [8], "FR": [11], "GB": [9, 12], "HR": [11], "HU": [8], "IE": [8, 9], "IT": [11], "LT": [9, 12], "LU": [8], "LV": [11],
    "MT": [8], "NL": [12], "PL": [10], "PT": [9], "RO": [2, 3, 4, 5, 6, 7, 8, 9, 10], "SE": [12], "SI": [8], "SK": [10],
}
# Check letters and tables.
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
PPS_LETTERS = "WABCDEFGHIJKLMNOPQRSTUV"
CODICE_ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
UK_POSTCODE = "(?i)^(GIR ?0AA|[A-PR-UWYZ]([0-9]{1,2}|([A-HK-Y][0-9]([0-9ABEHMNPRV-Y])?)|[0-9][A-HJKPS-UW]) ?[0-9][ABD-HJLNP-UW-Z]{2})$"

DAYS_OF_A_YEAR = 365.25


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def bare(v: Column) -> Column:
    return F.upper(F.regexp_replace(v, "(?U)\\s", ""))


def _at(s: Column, i: int) -> Column:
    """Value of the digit at place i."""
    return F.ascii(F.substring(s, i + 1, 1)) - 48


def _sum(s: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, [_at(s, i) * w for i, w in enumerate(weights)])


def _if(guard: Column, then: Column) -> Column:
    return F.coalesce(F.when(guard, then).otherwise(F.lit(False)), F.lit(False))


def _number(s: Column) -> Column:
    return s.try_cast("long")


def _luhn(d: Column) -> Column:
    doubled = F.aggregate(
        F.split(F.reverse(d), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")),
        lambda a, c: F.struct(
            (a["i"] + 1).alias("i"),
            (a["t"] + F.when(c == "", 0).when(a["i"] % 2 == 0, F.ascii(c) - 48).when(c >= "5", (F.ascii(c) - 48) * 2 - 9).otherwise((F.ascii(c) - 48) * 2)).alias("t"),
        ),
        lambda a: a["t"],
    )
    return doubled % 10 == 0


def luhn(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d).between(12, 19), _luhn(d))


def card_issuer(v: Column) -> Column:
    d = digits(v)
    rows = [(F.length(d).isin(sizes)) & F.substring(d, 1, len(low)).between(low, high) & (F.length(d) >= len(low)) for low, high, sizes in CARD_ISSUERS]
    return reduce(lambda a, b: a | b, rows)


def iban_mod97(v: Column) -> Column:
    c = bare(v)
    turned = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, x: F.when(x == "", a).when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97))
    return _if(F.rlike(c, F.lit("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")), rest == 1)


def ni_prefix(v: Column) -> Column:
    c = bare(v)
    bad = F.substring(c, 1, 1).isin(list("DFIQUV")) | F.substring(c, 2, 1).isin(list("DFIOQUV")) | F.substring(c, 1, 2).isin("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")
    return _if(F.length(c) >= 2, ~bad)


def vat_mod97(v: Column) -> Column:
    d = digits(v)
    total = _sum(d, (8, 7, 6, 5, 4, 3, 2)) + _at(d, 7) * 10 + _at(d, 8)
    return _if(F.length(d).isin(9, 12), (total % 97 == 0) | ((total + 55) % 97 == 0))


def sort_code(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 6, ~F.rlike(d, F.lit("^(.)\\1*$")))


def uk_postcode(v: Column) -> Column:
    return F.rlike(F.regexp_replace(v, "(?U)^\\s+|\\s+$", ""), F.lit(UK_POSTCODE))


def uk_phone(v: Column) -> Column:
    c = F.replace(bare(v), F.lit("-"), F.lit(""))
    d = digits(F.when(F.startswith(c, F.lit("+44")), F.concat(F.lit("0"), F.substring(c, 4, 40))).otherwise(c))
    return F.length(d).isin(10, 11) & F.substring(d, 1, 2).isin("01", "02", "03", "05", "07", "08", "09")


def plausible_dob(v: Column, as_of: str = "2026-01-01") -> Column:
    """A date in one of seven forms that gives an age from 0 to 120 years on the day `as_of`, which is explicit so that
    results do not change with the clock."""
    t = F.regexp_replace(F.regexp_replace(v, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")
    dmy = "^(\\d{1,2})([/.-])(\\d{1,2})\\2(\\d{4})$"
    short = "^(\\d{1,2})/(\\d{1,2})/(\\d{2})$"
    named = "(?i)^(\\d{1,2}) (jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?) (\\d{4})$"
    iso = "^(\\d{4})-(\\d{1,2})-(\\d{1,2})$"

    def pick(rx, i):
        return F.regexp_extract(t, rx, i)

    month = (F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(pick(named, 2), 1, 3))) + 2) / 3
    two = pick(short, 3)
    date = (
        F.when(F.rlike(t, F.lit(dmy)), F.concat_ws("-", pick(dmy, 4), pick(dmy, 3), pick(dmy, 1)))
        .when(F.rlike(t, F.lit(short)), F.concat_ws("-", F.concat(F.when(two >= "69", "19").otherwise("20"), two), pick(short, 2), pick(short, 1)))
        .when(F.rlike(t, F.lit(named)), F.concat_ws("-", pick(named, 3), month.cast("int").cast("string"), pick(named, 1)))
        .when(F.rlike(t, F.lit(iso)), t)
    )
    age = F.datediff(F.lit(as_of).cast("date"), date.try_cast("date")) / DAYS_OF_A_YEAR
    return F.coalesce(age.between(0, 120), F.lit(False))


def us_ssn(v: Column) -> Column:
    d = digits(v)
    area = F.substring(d, 1, 3)
    return _if(F.length(d) == 9, ~area.isin("000", "666") & ~F.startswith(area, F.lit("9")) & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000"))


def us_ein(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 9, ~F.substring(d, 1, 2).isin("00", "07", "08", "09", "17", "18", "19"))


def aba_routing(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 9, _sum(d, (3, 7, 1) * 3) % 10 == 0)


def nl_bsn(v: Column) -> Column:
    d = digits(v)
    return _if((F.length(d) == 9) & (d != "000000000"), F.pmod(_sum(d, (9, 8, 7, 6, 5, 4, 3, 2, -1)), F.lit(11)) == 0)


def pt_nif(v: Column) -> Column:
    d = digits(v)
    check = 11 - _sum(d, range(9, 1, -1)) % 11
    return _if((F.length(d) == 9) & F.substring(d, 1, 1).isin(list("125689")), _at(d, 8) == F.when(check >= 10, 0).otherwise(check))


def es_dni(v: Column) -> Column:
    c = F.replace(bare(v), F.lit("-"), F.lit(""))
    body = F.concat(F.translate(F.substring(c, 1, 1), "XYZ", "012"), F.substring(c, 2, 7))
    letter = F.substring(F.lit(DNI_LETTERS), (_number(body) % 23).cast("int") + 1, F.lit(1))
    return _if(F.rlike(c, F.lit("^[XYZ0-9][0-9]{7}[A-Z]$")), letter == F.substring(c, 9, 1))


def ie_pps(v: Column) -> Column:
    c = bare(v)
    second = F.substring(c, 9, 1)
    extra = F.when(F.rlike(second, F.lit("^[A-Z]$")), (F.ascii(second) - 64) * 9).otherwise(0)
    letter = F.substring(F.lit(PPS_LETTERS), (_sum(c, range(8, 1, -1)) + extra) % 23 + 1, F.lit(1))
    return _if(F.rlike(c, F.lit("^[0-9]{7}.{1,2}$")), letter == F.substring(c, 8, 1))


def fr_nir(v: Column) -> Column:
    c = bare(v)
    body = F.replace(F.replace(F.substring(c, 1, 13), F.lit("2A"), F.lit("19")), F.lit("2B"), F.lit("18"))
    check = F.substring(c, 14, 2)
    return _if(F.rlike(body, F.lit("^[0-9]+$")) & F.rlike(check, F.lit("^[0-9]+$")), _number(check) == 97 - _number(body) % 97)


def de_steuer_id(v: Column) -> Column:
    d = digits(v)
    head = F.substring(d, 1, 10)
    most = F.array_max(F.array(*[10 - F.length(F.replace(head, F.lit(str(k)), F.lit(""))) for k in range(10)]))

    def step(p, c):
        t = (F.ascii(c) - 48 + p) % 10
        return (F.when(t == 0, 10).otherwise(t) * 2) % 11

    product = F.aggregate(F.split(head, ""), F.lit(10), lambda p, c: F.when(c == "", p).otherwise(step(p, c)))
    return _if(F.length(d) == 11, most.isin(2, 3) & ((11 - product) % 10 == _at(d, 10)))


def eu_vat(v: Column) -> Column:
    c = F.replace(bare(v), F.lit("-"), F.lit(""))
    country, body = F.substring(c, 1, 2), F.substring(c, 3, 40)
    sized = reduce(lambda a, b: a | b, [(country == k) & F.length(body).isin(n) for k, n in VAT_LENGTHS.items()])
    return _if((F.length(c) >= 4) & sized, F.when(country == "GB", vat_mod97(body)).otherwise(F.rlike(body, F.lit("[0-9]"))))


def e164_phone(v: Column) -> Column:
    d = digits(v)
    return F.rlike(v, F.lit("(?U)^\\s*\\+")) & F.length(d).between(8, 15) & ~F.startswith(d, F.lit("44"))


def nanp_phone(v: Column) -> Column:
    d = F.regexp_replace(digits(v), "^1(?=[0-9]{10}$)", "")
    return F.rlike(d, F.lit("^[2-9][0-9]{2}[2-9][0-9]{6}$"))


def it_codice_fiscale(v: Column) -> Column:
    c = bare(v)

    def value(i):
        x = F.substring(c, i + 1, 1)
        return F.when(x.between("0", "9"), F.ascii(x) - 48).otherwise(F.ascii(x) - 65)

    odd = F.array(*[F.lit(n) for n in CODICE_ODD])
    total = reduce(lambda a, b: a + b, [F.get(odd, value(i)) if i % 2 == 0 else value(i) for i in range(15)])
    return _if(F.rlike(c, F.lit("^[A-Z0-9]{16}$")), F.char(total % 26 + 65) == F.substring(c, 16, 1))


def be_national_number(v: Column) -> Column:
    d = digits(v)
    body, check = _number(F.substring(d, 1, 9)), _number(F.substring(d, 10, 2))
    return _if(F.length(d) == 11, (check == 97 - body % 97) | (check == 97 - (body + 2_000_000_000) % 97))


def pl_pesel(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 11, (10 - _sum(d, (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)) % 10) % 10 == _at(d, 10))


def _day_month(day: Column, month: Column) -> Column:
    return month.between(1, 12) & day.between(1, 31)


def se_personnummer(v: Column) -> Column:
    d = digits(v)
    d = F.when(F.length(d) == 12, F.substring(d, 3, 10)).otherwise(d)
    day = _at(d, 4) * 10 + _at(d, 5)
    return _if(F.length(d) == 10, _day_month(F.when(day > 60, day - 60).otherwise(day), _at(d, 2) * 10 + _at(d, 3)) & _luhn(d))


def dk_cpr(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 10, _day_month(_at(d, 0) * 10 + _at(d, 1), _at(d, 2) * 10 + _at(d, 3)))


def ch_ahv(v: Column) -> Column:
    d = digits(v)
    return _if((F.length(d) == 13) & F.startswith(d, F.lit("756")), (10 - _sum(d, (1, 3) * 6) % 10) % 10 == _at(d, 12))


def _mod11(d: Column, weights) -> Column:
    rest = _sum(d, weights) % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def br_cpf(v: Column) -> Column:
    d = digits(v)
    return _if((F.length(d) == 11) & ~F.rlike(d, F.lit("^(.)\\1*$")), (_mod11(d, range(10, 1, -1)) == _at(d, 9)) & (_mod11(d, range(11, 1, -1)) == _at(d, 10)))


def br_cnpj(v: Column) -> Column:
    d = digits(v)
    first, second = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
    return _if((F.length(d) == 14) & ~F.rlike(d, F.lit("^(.)\\1*$")), (_mod11(d, first) == _at(d, 12)) & (_mod11(d, second) == _at(d, 13)))


def _dihedral(a: int, b: int) -> int:
    """Product of two symmetries of the pentagon: 0 to 4 turn, 5 to 9 reflect."""
    turn = (a + b) % 5 if a < 5 else (a - b) % 5
    return turn + 5 * ((a >= 5) ^ (b >= 5))


def verhoeff(v: Column) -> Column:
    """Each place permutes its digit once more than the place before; the products must come to 0."""
    permuted, tables = list(range(10)), []
    for _ in range(8):
        tables += permuted
        permuted = [VERHOEFF_STEP[x] for x in permuted]
    product = F.array(*[F.lit(_dihedral(a, b)) for a in range(10) for b in range(10)])
    table = F.array(*[F.lit(x) for x in tables])
    fold = F.aggregate(
        F.split(F.reverse(digits(v)), ""),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("c")),
        lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when(x == "", a["c"]).otherwise(F.get(product, a["c"] * 10 + F.get(table, a["i"] % 8 * 10 + F.ascii(x) - 48))).alias("c")),
        lambda a: a["c"],
    )
    return fold == 0


def in_aadhaar(v: Column) -> Column:
    d = digits(v)
    return _if((F.length(d) == 12) & ~F.substring(d, 1, 1).isin("0", "1"), verhoeff(d))


def in_pan(v: Column) -> Column:
    return F.rlike(bare(v), F.lit("^[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]$"))


def ca_sin(v: Column) -> Column:
    d = digits(v)
    return _if((F.length(d) == 9) & ~F.substring(d, 1, 1).isin("0", "8"), _luhn(d))


def au_tfn(v: Column) -> Column:
    d = digits(v)
    return _if(F.length(d) == 9, _sum(d, (1, 4, 3, 7, 5, 8, 6, 9, 10)) % 11 == 0)


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    f.__name__: f
    for f in (
        luhn, card_issuer, iban_mod97, ni_prefix, vat_mod97, sort_code, uk_postcode, uk_phone, plausible_dob, us_ssn, us_ein,
        aba_routing, nl_bsn, pt_nif, es_dni, ie_pps, fr_nir, de_steuer_id, eu_vat, e164_phone, nanp_phone, it_codice_fiscale,
        be_national_number, pl_pesel, se_personnummer, dk_cpr, ch_ahv, br_cpf, br_cnpj, in_aadhaar, in_pan, ca_sin, au_tfn,
    )
}
