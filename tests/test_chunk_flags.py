"""Flags, statistics and white space of chunks against brute force, and what they send and read."""

import random
import statistics

from pyspark.sql import functions as F

from paperweir.functions import text as X
from paperweir.operators import chunks as C

rng = random.Random(6)
PARTS = ["a", "Bc", " ", "  ", "\n", "\r\n", "\t", "|", ".", "é", " ", " ", " ", "#", "x\u0085", "SHOUT", "\x1c", "»"]


def texts(n):
    return [None, "", " ", "\n", "a", "a.", *["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 9))) for _ in range(n)]]


def test_white_space_equals_the_plain_expressions(spark):
    t = F.col("t")
    strip = F.regexp_replace(t, "(?U)^\\s+|\\s+$", "")
    parts = F.split(t, X.LINE_ENDS, -1)
    lines = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    df = spark.createDataFrame([(x,) for x in texts(600)], "t string")
    same = X.strip(t).eqNullSafe(strip) & X.squeeze(t).eqNullSafe(F.regexp_replace(strip, "(?U)\\s+", " ")) & X.lines(t).eqNullSafe(lines)
    same &= F.rlike(X.strip(t), F.lit(C.SENTENCE_END)).eqNullSafe(C._ended(X.strip(t)))
    assert df.where(~same).collect() == []


def test_chunks_of_words_and_characters_equal_brute_force(spark):
    docs = [(f"d{i}", "".join(rng.choice(["ab ", "c\n", "é "]) for _ in range(n))) for i, n in enumerate([0, 1, 7, 8, 9, 30, 2000])]
    df = spark.createDataFrame(docs, "document string, text string")
    for size, overlap in ((8, 0), (8, 3), (500, 499)):
        want = set()
        for d, t in docs:
            w = t.split()
            want |= {(d, i, " ".join(w[a : a + size])) for i, a in enumerate(range(0, max(len(w) - overlap - 1, 0) + 1, size - overlap)) if w}
        assert {(r.document, r.idx, r.text) for r in C.by_words(df, size, overlap).collect()} == want
        want = {(d, i, t[a : a + size]) for d, t in docs for i, a in enumerate(range(0, max(len(t) - overlap - 1, 0) + 1, size - overlap)) if t}
        assert {(r.document, r.idx, r.text) for r in C.by_characters(df, size, overlap).collect()} == want


def test_statistics_equal_brute_force(spark):
    rows = [("c", None if i == 0 else rng.randint(1, 20), ["tiny"] if i % 3 else []) for i in range(41)] + [("d", n, []) for n in (1, 2, 3, 4)]
    got = {r.chunker: r for r in C.compare(spark.createDataFrame(rows, "chunker string, tokens long, flags array<string>")).collect()}
    for c in "cd":
        known = [t for k, t, _ in rows if k == c and t is not None]
        every = sorted((t for k, t, _ in rows if k == c), key=lambda t: (t is not None, t))
        assert tuple(got[c])[1:] == (len(every), sum(known), min(known), statistics.median(known), max(known), float(every[round(0.95 * (len(every) - 1))]), sum(bool(f) for k, _, f in rows if k == c))


def test_flags_send_no_texts_and_statistics_flag_once(spark):
    rows = spark.range(40).select(F.lit("c").alias("chunker"), F.concat(F.lit("d"), F.col("id") % 4).alias("document"), F.col("id").cast("int").alias("idx"), F.concat(F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(400)), "id").alias("text"))
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    flagged = C.flags(rows.repartition(4), 20, 200)
    flagged.select("document", "idx", "flags").collect()
    sent = store.executorSummary("driver").totalShuffleWrite() - before
    assert sent < 40 * 400 * 128 * 0.6  # repartition() sends the texts once, compressed
    plan = C.compare(flagged)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lead(") == 1


def test_texts_are_read_once(spark):
    df = spark.createDataFrame([("d", 1, "a b\nc d\na b")], "document string, page int, text string")
    flagged = C.flags(C.by_paragraph(df).unionByName(C.by_words(df, 2, 1)), 20, 200).select("chunker", "document", "idx", "flags")
    assert sorted((r.chunker, r.idx) for r in flagged.collect() if "duplicate" in r.flags) == [("paragraph", 2), ("words", 4)]
    assert "ReusedExchange" in flagged._jdf.queryExecution().executedPlan().toString()
