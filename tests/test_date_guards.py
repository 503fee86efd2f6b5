"""Cheap tests before the patterns of dates and line breaks change no value; like pages are ruled out before windows are measured."""

import random
import time

from pyspark.sql import functions as F

from paperweir.operators import retrieval as R
from paperweir.operators import signals as S

rng = random.Random(9)
PARTS = ["2024-01-05", "3/4/2024", "5.6.2024", "1-2-2020", "1 January 2024", "January 7, 2024", "٣/٤/٢٠٢٤", "word", "deliv-\nery", "pay- \t\n ment", "May", "7", "-", "\n", "x" * 16, "fooBarBaz" * 3, " "]


def test_signals_equal_the_plain_expressions(spark):
    texts = [None, "", *[rng.choice([" ", "  ", "\n"]).join(rng.choice(PARTS) for _ in range(rng.randint(1, 160))) for _ in range(300)]]
    t = F.col("t")
    counts = [F.regexp_count(t, F.lit("(?U)" + f)) for f in S.DATE_FAMILIES]
    total = sum(counts[1:], counts[0])
    dates = F.when(total >= S.MIN_DATES, F.bround(F.greatest(*counts) / total * 100, 2))
    words, breaks = F.regexp_count(t, F.lit("(?U)\\w+")), F.regexp_count(t, F.lit("[a-z]{2,}-[ \\t]*\\n[ \\t]*[a-z]{2,}"))
    hyphens = F.when(words >= S.MIN_WORDS, F.bround(breaks / words * 1000, 2))
    same = S.date_consistency(t).eqNullSafe(dates) & S.hyphenated(t).eqNullSafe(hyphens)
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert df.where(~same).collect() == []
    assert df.where(dates > 0).count() > 50 and df.where(hyphens > 0).count() > 50


def test_unlike_pages_are_ruled_out_at_once(monkeypatch):
    words = [f"{rng.choice(['the', 'of', 'zeta', 'quorum', 'xylem'])}" for _ in range(4000)]
    measured = []
    monkeypatch.setattr(R.np, "unique", lambda x, **k: measured.append(1) or (x[:0], x[:0]))
    assert R.closest(R.Passage(words), "ignore all previous instructions", 0.85) == 0.85
    assert not measured
