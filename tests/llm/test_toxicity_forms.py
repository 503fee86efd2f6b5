"""Inflected insults of a language with few labelled rows are found, also in forms that no labelled row holds."""

import random

import numpy as np
import pyarrow as pa

from paperweir.llm import toxicity


def test_rare_inflected_insults(spark):
    rng = random.Random(3)
    syllables = "ka lo mi sen tur va pel dro ni shu".split()
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))
    form = lambda: "quezim" + "".join(rng.choice("aeiou") + rng.choice("bdfgh") for _ in range(2))
    clean = [text(40) + ". " + text(40) + "." for _ in range(600)]
    plain = [text(20) + " " + " ".join(rng.choice(["blockhead", "nincompoop", "dunderhead"]) for _ in range(2)) + " " + text(20) for _ in range(240)]
    rare = [text(20) + " " + form() + " " + text(3) + " " + form() + " " + text(20) for _ in range(90)]
    train = clean[:500] + plain[:200] + rare[:60]
    labels = [0] * 500 + [1] * 260
    model = toxicity.learn(pa.table({"text": train, "y": labels}), {0: 500, 1: 260})
    rows = spark.createDataFrame(list(enumerate(clean[500:] + plain[200:] + rare[60:] + ["", None])), "doc_id long, text string")
    score = {r.doc_id: r.score >= 0.3 for r in toxicity.score(rows, model).collect()}
    hit = np.array([score[i] for i in range(172)])
    assert hit[140:170].mean() > 0.9 and hit[100:140].mean() > 0.9 and hit[:100].mean() < 0.05 and not hit[170:].any()
