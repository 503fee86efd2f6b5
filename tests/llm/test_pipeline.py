"""The pipeline against stages worked out by hand on a small folder."""

import random

import corpus_pipeline


def test_run(spark, tmp_path):
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "lmnrst"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    clean = [(i, prose(80)) for i in range(200)]
    toxic = [(1000 + i, prose(20) + ". such a nincompoop " + prose(20)) for i in range(60)]
    near = clean[1][1].split()
    near[40] = "changed"
    copies = [(2000 + i, clean[0][1]) for i in range(3)] + [(2010, " ".join(near))]
    passage, test = prose(70), prose(30)
    repeats = [(3000 + i, prose(30) + " " + passage + " " + prose(30)) for i in range(2)]
    leaked = [(4000, prose(20) + " " + test + " " + prose(20))]
    docs = [(i, t, "en", "s", len(t)) for i, t in clean + toxic + copies + repeats + leaked] + [(5000, "", "en", "s", 0), (5001, None, "en", "s", None)]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(sf + "/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    spark.createDataFrame([(1, test)], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    rows, kept = spark.read.parquet(sf + "/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.common.cut(stage(spark, rows, sf))
        assert rows.columns == corpus_pipeline.COLUMNS
        kept[name] = {r.doc_id: r for r in rows.collect()}
    everyone = {d[0] for d in docs}
    assert set(kept["toxicity"]) == everyone - {i for i, _ in toxic}
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {i for i, _ in copies}
    assert set(kept["suffix_dedup"]) == set(kept["near_dedup"])
    assert all(passage not in kept["suffix_dedup"][i].text and len(kept["suffix_dedup"][i].text) > 100 for i, _ in repeats)
    assert test not in kept["decontamination"][4000].text and len(kept["decontamination"][4000].text) > 100
    untouched = {i: t for i, t in clean}
    assert all(kept["decontamination"][i].text == t for i, t in untouched.items())
    assert kept["decontamination"][5001].text is None and kept["decontamination"][5000].text == ""
    assert all(r.n_chars == len(r.text) for r in kept["decontamination"].values() if r.text is not None)
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontamination"])


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, rows repeated in full and by id, ties, an empty table, and columns that clash."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    long, text, other = prose(60_000), prose(30), prose(30)
    rows = [(1, long), (2, text), (2, text), (2, text), (3, text), (None, other), (None, other), (None, None), (4, ""), (5, None), (4, " \n"), (6, "one"), (6, "two"), (7, "one")]
    docs = spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, "y", b"z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, spans string, node int, predicted string, root binary")
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, 0) for i in range(100, 120)], "doc_id long, quality int, toxic int").write.parquet(sf + "/labels.parquet")
    spark.createDataFrame([(1, None), (None, "absent words")], "item_id long, text string").write.parquet(sf + "/benchmark.parquet")
    want = {
        "toxicity": rows,
        "near_dedup": [(1, long), (2, text), (None, other), (None, None), (4, ""), (5, None), (4, " \n"), (6, "one"), (6, "two")],
        "suffix_dedup": [r for r in rows if len(r[1] or "") < 200 or r[1] == long],
        "decontamination": rows,
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == corpus_pipeline.COLUMNS
        got = [(r.doc_id, r.text) for r in out.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want[name])), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert sum(r.start == 0 for r in packed) == len(rows)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0
