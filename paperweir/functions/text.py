"""Text expressions: matches with offsets, masking, whitespace and invisible characters. Catalyst expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zero-width, tag and direction characters.
ZERO_WIDTH = "\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{180E}"
INVISIBLE = "[\\x{E0000}-\\x{E007F}" + ZERO_WIDTH + "\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"
#: Line ends beyond the line feed.
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Two spaces, or white space that is no space.
LOOSE = "(?U)  |[^\\S ]"
MATCH = "array<struct<s:int,v:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, v>>: start (in code points, from 0) and value of each match, in order.

    Lengths of the pieces between and of the matches add up to the starts, as Spark's own positions count UTF-16 units."""
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.zip_with(found, between, lambda v, p: F.struct(F.length(p).alias("g"), v.alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(MATCH).alias("out"))

    def step(a, x):
        s = a["at"] + x["g"]
        more = F.concat(a["out"], F.array(F.struct(s.alias("s"), x["v"].alias("v"))))
        kept = F.when(x["v"].isNull(), a["out"]).otherwise(more)
        return F.struct((s + F.coalesce(F.length(x["v"]), F.lit(0))).alias("at"), kept.alias("out"))

    return F.when(F.rlike(text, rx), F.aggregate(pairs, start, step, lambda a: a["out"])).otherwise(F.array().cast(MATCH))


def mask(value: Column, tail: int = 4) -> Column:
    """Every letter and digit but the last `tail` becomes a dot; all do if there are no more than `tail`. Separators stay,
    unprintable characters become spaces."""
    alnum = "(?U)[\\p{L}\\p{N}]"
    n = F.length(F.regexp_replace(value, "(?U)[^\\p{L}\\p{N}]", ""))
    later = alnum + "(?=(?:[^\\p{L}\\p{N}]*[\\p{L}\\p{N}]){" + str(tail) + "})"
    hidden = F.when(n <= tail, F.regexp_replace(value, alnum, "•")).otherwise(F.regexp_replace(value, later, "•"))
    return F.regexp_replace(hidden, "(?U)[\\p{Cc}\\p{Cf}\\p{Cs}\\p{Co}\\p{Cn}\\p{Zl}\\p{Zp}[\\p{Zs}&&[^ ]]]", " ")


def _edged(text: Column) -> Column:
    """Whether a text begins or ends with white space: two characters are looked at instead of all."""
    return F.rlike(F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))), F.lit("(?U)\\s"))


def squeeze(text: Column) -> Column:
    """White space runs become one space; none at the ends."""
    done = F.regexp_replace(F.regexp_replace(text, "(?U)^\\s+|\\s+$", ""), "(?U)\\s+", " ")
    return F.when(_edged(text) | F.rlike(text, F.lit(LOOSE)), done).otherwise(text)


def strip(text: Column) -> Column:
    return F.when(_edged(text), F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")).otherwise(text)


def casefold(text: Column) -> Column:
    """Lower case with sharp s written out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def words(text: Column) -> Column:
    """Words with the white space that follows them."""
    return F.regexp_extract_all(text, F.lit("(?U)\\S+\\s*"), F.lit(0))


def same_words(a: Column, b: Column) -> Column:
    """Whether two texts hold the same words, however ordered."""
    def bag(t):
        return F.array_sort(F.regexp_extract_all(t, F.lit("(?U)\\S+"), F.lit(0)))

    return bag(a) == bag(b)


def terms(text: Column) -> Column:
    """Words as search terms. Compatibility characters are not decomposed."""
    return F.regexp_extract_all(casefold(text), F.lit("(?U)\\w+"), F.lit(0))


def lines(text: Column) -> Column:
    """Lines, at any of the line ends; a last line without text is none."""
    parts = F.split(text, LINE_ENDS, -1)
    several = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(F.rlike(text, F.lit(LINE_ENDS.split("|")[1])) | (text == ""), several).otherwise(F.when(text.isNotNull(), F.array(text)))


def tokens_estimate(text: Column) -> Column:
    """A quarter of the characters, half to even; 0 for no text."""
    return F.bround(F.length(text) / 4.0).cast("long")


def tag_decode(run: Column) -> Column:
    """What tag characters spell, printable characters only."""
    codes = F.transform(F.split(run, ""), lambda c: F.ascii(c) - 917504)
    return F.array_join(F.transform(F.filter(codes, lambda c: (c >= 32) & (c <= 126)), lambda c: F.char(c)), "")
