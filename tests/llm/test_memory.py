"""What a pipeline stage holds: memory of a Python worker, and tables of the shared folder."""

import os
import random
import tracemalloc

import numpy as np
from pyspark import SparkContext

from paperweir.llm import induced, simhash, suffix, toxicity
from paperweir.llm.common import scratch, shared_dir
from paperweir.llm.svm import labelled_sample


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_sorting_a_shard_takes_few_bytes_per_byte():
    own = random.Random(5)
    text = " ".join(f"w{own.randrange(3000)}" for _ in range(200_000)).encode()
    contexts = [text[a : a + own.randrange(200, 330)] for a in (own.randrange(len(text) - 400) for _ in range(12_000))]
    assert peak(lambda: suffix._sort_shard(contexts, [len(c) - 199 for c in contexts], 200)) < 24 * sum(map(len, contexts))


def test_suffix_order_over_block_borders(monkeypatch):
    own = random.Random(4)
    for block in (1, 3, 1 << 18):
        monkeypatch.setattr(induced, "BLOCK", block)
        for _ in range(100):
            parts = [[own.randint(1, 3) for _ in range(own.randint(0, 25))] for _ in range(own.randint(1, 6))]
            text = np.array([c for p in (*parts, parts[0]) for c in (*p, 0)], np.int16)
            ends = np.flatnonzero(text == 0)

            def key(i):
                end = int(ends[np.searchsorted(ends, i)])
                return [(int(c), 0) for c in text[i:end]] + [(0, end)]

            assert induced.suffix_order(text, 1 << 20).tolist() == sorted(range(len(text)), key=key)


def test_a_kernel_holds_its_maps_once():
    own = np.random.default_rng(3)
    kernel = toxicity.Kernel([own.integers(1, 27, 6).astype(np.uint8) for _ in range(32)])
    flat = own.integers(1, 27, 4 * 140_000).astype(np.uint8)
    starts = np.arange(0, len(flat), 4)
    first, back = kernel.words(flat, starts[:20_000], starts[:20_000] + 4)

    def run():
        for lo in range(20_000, len(starts), 20_000):
            kernel.words(flat, starts[lo : lo + 20_000], starts[lo : lo + 20_000] + 4)

    assert peak(run) < 40e6
    again, back_again = kernel.words(flat, starts[:20_000], starts[:20_000] + 4)
    assert (first[back] == again[back_again]).all()
    kernel.KEEP = 100  # forgets, and still knows
    few = kernel.words(flat, starts[:500], starts[:500] + 4)
    assert np.allclose(few[0][few[1]], first[back][:500])


def test_labelled_rows_need_no_python_workers_of_another_kind(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")

    def refuse(*_, **__):
        raise AssertionError("rows of a list pass through Python workers beside those of queries")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    rows, sizes = labelled_sample(docs, labels, "toxic", 100)
    found = rows.collect()
    assert len(found) == sum(sizes.values()) > 10 and all(r.text == f"text {r.d}" and r.y == r.d % 2 for r in found)
    assert labelled_sample(docs, labels, "toxic", 100, fit_bytes=1)[0].count() == 0


def test_near_dedup_leaves_no_sketches_stored(spark):
    own = random.Random(2)
    words = [f"{a}{b}" for a in "bdfgk" for b in ("an", "el", "ir", "os")]
    texts = [" ".join(own.choice(words) for _ in range(60)) for _ in range(30)]
    docs = spark.createDataFrame([(i, texts[i % 30]) for i in range(40)], "doc_id long, text string")
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark) as held:
        groups = {r.doc_id: r.component_id for r in simhash.similar_texts(docs).collect()}
    left = [spark.read.parquet(f"{folder}/{x}").columns for x in set(os.listdir(folder)) - before]
    held.release()
    assert groups == {i: i % 30 for i in range(40)}
    assert left and not [c for c in left if {"prefix", "m0", "s"} & set(c)]
