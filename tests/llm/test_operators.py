"""Each operator against a brute-force version on small rows with nulls, empty, long and repeated texts, ties and odd columns."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from paperweir.llm import decontaminate, induced, language, pack, pretoken, quality, shard, simhash, suffix, topk, toxicity, urlfilter
from paperweir.llm.queries import RULES, tokenizer_path

rng = random.Random(7)
WORDS = "the of and tion er an ha es river stone lamp quick été straße naïve 42 x".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


PASSAGE = "a passage of many words that stands in several documents " * 5
TEXTS = [None, "", "   \n ", "one", "Two words", sentence(40), sentence(40) + ". " + PASSAGE + sentence(30), PASSAGE + sentence(50), "x" * 900, sentence(20_000), "é" * 300 + sentence(9)]
TEXTS += [TEXTS[5], TEXTS[9] + " tail", TEXTS[7], "\0 nul ퟿", "😀 " * 150]
ROWS = [(i, t, "en", "s", 0, 9, "x") for i, t in enumerate(TEXTS)] + [(None, "no id here", "en", "s", 0, 9, "x"), (3, "one", "en", "s", 0, 9, "x")]
#: Columns that clash with those that operators add.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score int, spans string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def raw(t):
    return (t or "").encode()


def test_decontaminate(spark, docs):
    items = [(1, " ".join(TEXTS[5].split()[5:20])), (2, "Two words!"), (3, None), (4, "..."), (5, "absent words here"), (None, "one"), (7, " ".join(TEXTS[9].split()[100:130]))]
    out = decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), clean="clean").collect()
    assert len(out) == len(ROWS)
    rx = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for i, t in items:
        w = rx.findall((t or "").translate(LOWER))
        windows |= {(tuple(w[j : j + min(10, len(w))]), i) for j in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(w) for w, _ in windows}
    by = {}
    for w, i in windows:
        by.setdefault(w, set()).add(i)
    for r in out:
        w = rx.findall((r.text or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (got := by.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= {i for i in got if i is not None}
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(map(str, found)))
        if not hit:
            assert r.clean == (r.text or "")
    assert decontaminate.decontaminate(docs.limit(0), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontaminate_in_several_sets(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(TEXTS[9].split()[i * 7 : i * 7 + 25])) for i in range(40)], "item_id long, text string")
    one = decontaminate.decontaminate(docs, items, clean="clean").select("doc_id", "n_hit", "items", "spans", "clean").collect()
    monkeypatch.setattr(decontaminate, "MAX_WINDOWS", 100)
    several = decontaminate.decontaminate(docs, items, clean="clean").select("doc_id", "n_hit", "items", "spans", "clean").collect()
    assert sorted(map(str, one)) == sorted(map(str, several))




def test_classifiers_catch_planted_rows_and_take_any_text(spark, docs):
    clean = [(100 + i, sentence(60)) for i in range(300)]
    bad = [(500 + i, sentence(20) + ". you " + rng.choice(["blockhead", "nincompoop", "dunderhead"]) + " " + sentence(20)) for i in range(120)]
    rows = [(i, t, "en", "s", 0, 9, "x") for i, t in clean + bad]
    all_docs = docs.unionByName(spark.createDataFrame(rows, SCHEMA))
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 1) for i, _ in bad] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for operator, worst in ((toxicity, 1), (quality, 0)):
        out = operator.classify(all_docs, labels).select("doc_id", "score", "predicted").collect()
        assert len(out) == len(ROWS) + len(rows) and all(0 <= r.score <= 1 for r in out)
        got = {r.doc_id: r.predicted for r in out}
        assert np.mean([got[i] == worst for i, _ in bad]) > 0.95 and np.mean([got[i] != worst for i, _ in clean]) > 0.95
        none = operator.classify(docs, labels.limit(0)).collect()
        assert len(none) == len(ROWS) and len({r.score for r in none}) == 1
        assert operator.classify(docs.limit(0), labels).count() == 0


def letters(word):
    return np.frombuffer(word.encode(), np.uint8) - 96


def test_toxicity_kernel_equals_brute_force():
    from itertools import combinations

    def spectrum(w):
        out = Counter()
        for c in combinations(range(len(w)), 3):
            out[tuple(w[i] for i in c)] += toxicity.DECAY ** (c[2] - c[0] + 1)
        return out

    def value(a, b):
        x, y = spectrum(a), spectrum(b)
        norm = lambda v: sum(q * q for q in v.values()) ** 0.5
        return (sum(q * y[c] for c, q in x.items()) / (norm(x) * norm(y))) ** 2 if x and y else 0.0

    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["aaaa", "abab"]
    marks = ["abca", "ddcba", "aabb"]
    kernel = toxicity.Kernel([letters(z) for z in marks])
    ends = np.cumsum([len(w) for w in words])
    flat, a = np.concatenate([letters(w) for w in words]), ends - [len(w) for w in words]
    got = kernel.of(flat, a, ends)
    assert np.allclose(got, [[value(w, z) for z in marks] for w in words], atol=1e-5)
    # The landmarks' own maps give back their kernel, up to the scaling to length 1.
    own = np.array([[value(y, z) for z in marks] for y in marks])
    mapped = kernel.mapped(*toxicity._joined([letters(z) for z in marks]))
    assert np.allclose(mapped @ mapped.T, own, atol=0.01)


def test_toxicity_takes_gaps():
    kernel = toxicity.Kernel([letters("blockhead")])

    def value(text):
        data = np.frombuffer(text.encode(), np.uint8)
        flat, a, b, *_ = toxicity.split(data, np.array([0, len(data)]))
        return float(kernel.of(flat, a, b).max())

    assert value("the b l o c k h e a d of") == pytest.approx(1) and value("b.l.o.c.k.h.e.a.d") == pytest.approx(1)
    assert value("blockxhead") > 0.3 and value("blockhead of") > value("blockxhead") > value("river")


def test_fit_takes_bounded_rows_and_whole_texts(spark):
    from paperweir.llm.svm import labelled_sample

    long = "x " * 200_000
    docs = spark.createDataFrame([(1, long), (1, long), (3, "a"), (3, "b"), (5, None), (None, "c"), (7, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (5, 1), (7, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    rows, sizes = labelled_sample(docs, labels, "toxic", 100)
    assert sorted((r.d, r.text, r.y) for r in rows.collect()) == [(1, long, 1), (3, "a", 1), (3, "b", 1)] and sizes == {1: sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 3, 5))}
    assert {r.d for r in labelled_sample(docs, labels, "toxic", 100, fit_bytes=1000)[0].collect()} <= {3}


def test_hinge_equals_brute_force():
    from paperweir.llm.svm import fit_hinge

    g = np.random.default_rng(5)
    x, c = g.normal(size=(40, 3)), 0.7
    y = np.where(x[:, 0] + 0.3 * g.normal(size=40) > 0, 1.0, -1.0)
    w = fit_hinge(np.arange(41) * 3, np.tile(np.arange(3), 40), x.ravel(), y, 3, np.full(40, c), rounds=2000)
    loss = lambda v: v @ v / 2 + c * np.maximum(0, 1 - y * (x @ v[:3] + v[3])).sum()
    best, at = loss(w), w
    for scale in (1.0, 0.1, 0.01, 0.001):
        for _ in range(3000):
            v = at + scale * g.normal(size=4)
            if loss(v) < loss(at):
                at = v
    assert best <= loss(at) * 1.002


def test_quality_weights_are_log_count_ratios(spark):
    rows = [(i, f"good plain prose {w}") for i, w in enumerate("one two three four".split() * 20)] + [(200 + i, f"BUY!!! NOW {w}") for i, w in enumerate("one two three four".split() * 20)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    data = [t.encode() for _, t in rows]
    code = lambda t: set(quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0].tolist())
    kept = [i for i, (d, _) in enumerate(rows) if zlib.crc32(str(d).encode()) % 4 != 2]
    sets = [code(data[i]) for i in kept]
    y = [rows[i][0] < 200 for i in kept]
    p = Counter(c for s, q in zip(sets, y) if q for c in s)
    n = Counter(c for s, q in zip(sets, y) if not q for c in s)
    size = 1 << quality.BITS
    ratio = {c: np.log(((p[c] + 1) / (sum(p.values()) + size)) / ((n[c] + 1) / (sum(n.values()) + size))) for c in p.keys() | n.keys()}
    # A weight is a ratio times the machine's weight of an indicator scaled by it, so it has the sign of the ratio for codes of one class.
    one = [c for c in ratio if (p[c] == 0) != (n[c] == 0)]
    assert one and all(np.sign(model["w"][c]) == np.sign(ratio[c]) for c in one if model["w"][c])
    assert np.count_nonzero(model["w"]) <= len(ratio)


def test_packing(spark, docs):
    out = pack.pack(docs, tokenizer_path(), 64).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((doc_id, len(ids), i, int(x)) for i, x in enumerate(ids))
    by_doc = {}
    for doc_id, text, *_ in ROWS:
        by_doc.setdefault(doc_id, []).append(np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by_doc[r.doc_id])
    assert sum(r.length for r in out) == sum(want.values())
    padding = 0
    for seq in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 64
        padding += 64 - at if at & (at - 1) else 0
    assert padding == 0
    assert pack.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_least_slack_is_found():
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        first = max(counts)
        pool = [k for k, v in counts.items() for _ in range(v - (k == first))]
        sums = {0}
        for k in pool:
            sums |= {s + k for s in sums}
        best = min(0 if first + s in {1, 2, 4, 8, 16, 32} else 40 - first - s for s in sums if first + s <= 40)
        chosen = pack.fill(counts, first, 40)
        size = sum(k * v for k, v in chosen.items())
        assert all(v <= counts[k] for k, v in chosen.items()) and size <= 40
        assert (0 if size in {1, 2, 4, 8, 16, 32} else 40 - size) == best


def test_pretokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    parts = ["'", "s", "'re", " ", "  ", "\n", "\t", "a", "Z", "é", "1", "٣", "!", "…", " ", "😀", "中", "\u0085", "_", "\x1c", "<|endoftext|>", "don't"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    data, encode = [t.encode() for t in texts], pretoken.Encoder(tokenizer_path())
    for chunk in (slice(0, 1500), slice(1500, 3000)):
        o = np.concatenate(([0], np.cumsum([len(x) for x in data[chunk]])))
        ids, n = encode.ids_of(np.frombuffer(b"".join(data[chunk]), np.uint8), o)
        ends = np.cumsum(n)
        assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [x.ids for x in tok.encode_batch(texts[chunk], add_special_tokens=False)]


def test_sharding(spark, docs):
    rows = docs.select("doc_id", shard.text_size("text").alias("size"), docs.n_chars.alias("shard"))
    out = shard.assign_shards(rows, 4, buckets=3).collect()
    assert len(out) == len(ROWS)
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(raw(t)) + 16) for i, t, *_ in ROWS)
    assert shard.assign_shards(rows.limit(0), 4).count() == 0


def test_sharding_is_a_function_of_its_rows(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(3000)] + [(9, 9)] * 2000, "doc_id long, size long")
    outs = [sorted(map(tuple, shard.assign_shards(rows.repartition(n), 4, buckets=10).collect())) for n in (1, 3, 7)]
    assert outs[0] == outs[1] == outs[2]
    alike = [slot * 4 + s for d, _, s, slot in outs[0] if d == 9]
    assert len(alike) == 2001 and max(alike) - min(alike) > 4500  # rows equal in full spread over all buckets
    assert [t[:1] for t in sorted(outs[0], key=lambda t: (t[3], t[2]))[:50]] != [(i,) for i in range(50)]


def test_fisher_yates_equals_the_loop(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(g, list(range(n))) for g, n in ((0, 0), (1, 1), (2, 2), (3, 9), (4, 40))], "g long, a array<int>")
    draw = df.select("g", "a", shard.fisher_yates(F.col("a"), 17, F.col("g")).alias("b"), F.transform("a", lambda i: F.pmod(F.xxhash64(F.lit(17), "g", i), i + 1)).alias("j"))
    for r in draw.collect():
        want = list(r.a)
        for i in range(len(want) - 1, 0, -1):
            want[i], want[r.j[i]] = want[r.j[i]], want[i]
        assert r.b == want


def test_suffix_order_equals_sorting():
    for _ in range(150):
        k = rng.choice([1, 2, 3, 20])
        strings = [[rng.randint(1, k) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        strings += strings[: rng.randint(0, 2)]
        text = np.array([c for s in strings for c in [*s, 0]], np.int64)
        place = [(i, j) for i, s in enumerate(strings) for j in range(len(s) + 1)]
        want = sorted(range(len(place)), key=lambda p: ((*strings[place[p][0]][place[p][1] :], 0), place[p][0]))
        assert induced.suffix_order(text, rng.choice([16, 1 << 20])).tolist() == want


@pytest.mark.parametrize("hot", [256, 2])
def test_repeated_spans(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "LEAST", hot)  # anchors of more rows are dealt over several keys
    monkeypatch.setattr(suffix, "REMEMBERED", hot)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 3000 * (hot == 2) + 1)  # several shards
    out = suffix.repeated_spans(docs, kept="kept").select("doc_id", "text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
    seen = Counter(t[i : i + 200] for t in (raw(r[1]) for r in ROWS) for i in range(len(t) - 199))
    assert len(out) == len(ROWS)
    for r in out:
        t = raw(r.text)
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int((np.diff(gone.astype(int)) > 0).sum() + gone[0])
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert "�" not in r.kept
    assert suffix.repeated_spans(docs.limit(0)).count() == 0


def test_language(spark, docs):
    fr, de = "le chat est dans la maison et il mange une pomme verte avec nous".split(), "der hund ist in dem haus und frisst einen roten apfel mit uns".split()
    made = [(200 + i, " ".join(rng.choice(fr if i % 2 else de) for _ in range(rng.randint(1, 90))), "fr" if i % 2 else "de", "s", 0, 9, "x") for i in range(300)]
    all_docs = docs.withColumn("lang", docs.source.substr(5, 1)).unionByName(spark.createDataFrame(made, SCHEMA)).replace("", None, "lang")
    out = {r.doc_id: r for r in language.identify(all_docs, language.fit(all_docs)).collect()}
    assert all(0 <= r.score <= 1 for r in out.values())
    assert np.mean([out[i].lang_pred == lang for i, _, lang, *_ in made]) > 0.97
    assert out[0].lang_pred == out[1].lang_pred == out[15].lang_pred == "und"
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_language_of_words_in_switched_text():
    fr, de = "le chat est dans la maison et il mange une pomme verte avec nous".split(), "der hund ist in dem haus und frisst einen roten apfel mit uns".split()
    texts = [" ".join(rng.choice(fr if i % 2 else de) for _ in range(40)).encode() for i in range(120)]
    o = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    low, s, e, row = language.words(np.frombuffer(b"".join(texts), np.uint8), o)
    model = language.fit_crf(low, s, e, row, np.arange(120) % 2, 2, 120) | {"names": ["de", "fr"]}
    assert model["move"][0, 0] > model["move"][0, 1] and model["move"][1, 1] > model["move"][1, 0]
    want, words = [], []
    for i in range(60):  # one text far longer than a training sequence: labels flow across it
        words += (own := [rng.choice((fr, de)[i % 2]) for _ in range(rng.randint(2, 9))])
        want += [1 - i % 2] * len(own)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    gamma = language.Tagger(model).tag(data, np.array([0, len(data)]))[0]
    assert np.mean(gamma.argmax(1) == want) > 0.97


def test_forward_backward_equals_enumeration():
    from itertools import product

    e, move, begin = np.random.default_rng(3).normal(size=(7, 3)), np.random.default_rng(4).normal(size=(3, 3)), np.random.default_rng(5).normal(size=3)
    first, size = np.array([0, 3]), np.array([3, 4])
    got = language.forward_backward(e, first, size, move, begin)
    for f, n in zip(first, size):
        total, sums = 0.0, np.zeros((n, 3))
        for y in product(range(3), repeat=int(n)):
            w = np.exp(begin[y[0]] + sum(e[f + t, y[t]] for t in range(n)) + sum(move[y[t - 1], y[t]] for t in range(1, n)))
            total += w
            for t in range(n):
                sums[t, y[t]] += w
        assert np.allclose(got[f : f + n], sums / total)


@pytest.mark.parametrize("block", [20_000, 5])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "LEAF", 8)
    g = np.random.default_rng(1)
    vectors = [(i, (g.normal(size=8) * (1 + i % 3)).tolist()) for i in range(400)] + [(i, [0.5] * 8) for i in range(400, 460)]
    vectors += [(900, None), (950, [1.0] * 7 + [float("nan")]), (1000, [1.0] * 7 + [None]), (1050, [float("inf")] * 8), (1100, [1.0, 2.0]), (1150, []), (None, [1.0] * 8), (7, vectors[7][1])]
    df = spark.createDataFrame([(*v, 0, 0) for v in vectors], "vec_id long, embedding array<double>, score int, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()]
    usable = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == len(q))[:5]
            want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_products_are_exact_beyond_floating_point():
    g = np.random.default_rng(4)
    for scale in (1.0, 2.0**20, 2.0**33):
        q, x = (np.floor(g.normal(size=(n, 5)) * scale * 256) for n in (7, 9))
        want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(u, v)))) for v in x] for u in q]
        assert topk.products(q, x).tolist() == want


def test_url_filters(spark):
    urls = ["https://a.org/x", "HTTP://Sub.Example.ORG/es/1?q#f", "https://example.org/en/17", "https://b.com/fr/1", "https://b.com/de/1", "https://good.net/", "https://bad.net/1", "https://c.net", None, "no scheme", "http://", "https://other.net/a#b/c"]
    html = ['<a href="https://good.net/1">', '<a href="//bad.net/">', "", '<a href="https://good.net/2">', '<a href="https://bad.net/">', "", '<a href="https://b.com/de/2"><a href="http://example.org/en/1">', "<a href='/local'>", None, "", "", ""]
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html))], "page_id long, url string, html string, verdict string")
    out = {r.page_id: r for r in urlfilter.judge_urls(df, RULES).collect()}
    assert [out[i].rule for i in range(5)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", "com/de/"]
    assert [out[i].verdict for i in range(7)] == ["allow", "block", "block", "allow", "block", "allow", "block"]
    assert (out[1].host, out[1].path) == ("sub.example.org", "/es/1") and (out[8].host, out[8].path) == ("", "") and out[7].path == ""
    assert len(out) == len(urls) and all(r.verdict in ("allow", "block") for r in out.values())
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0


def test_simhash(spark, docs):
    near = [(300 + i, TEXTS[9].replace(" ", "  ", i) + (" more" if i % 2 else ""), "en", "s", 0, 9, "x") for i in range(30)]
    rows = ROWS + near
    out = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)

    def fingerprint(t):
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    nodes = [(r[0], fingerprint(r[1])) for r in rows]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in out) == Counter(nodes)
    group = list(range(len(nodes)))
    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    want = Counter()
    for g in set(group):
        ids = [nodes[i][0] for i in range(len(nodes)) if group[i] == g]
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least) for i in ids)
    assert Counter((r.doc_id, r.component_id) for r in out) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bit_sliced_distances():
    g = np.random.default_rng(2)
    x = np.unique(np.concatenate([g.integers(0, 1 << 63, 400).astype(np.uint64), np.uint64(99) ^ (np.uint64(1) << g.integers(0, 60, 60).astype(np.uint64))]))
    i, j = simhash.near(x, 3)
    want = [(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if (int(x[a]) ^ int(x[b])).bit_count() <= 3]
    assert sorted(zip(i.tolist(), j.tolist())) == want
    wide = g.integers(0, 1 << 63, (150, 4)).astype(np.uint64)
    wide[50:] = wide[g.integers(0, 50, 100)] ^ (np.uint64(1) << g.integers(0, 63, (100, 4)).astype(np.uint64)) ^ (np.uint64(1) << g.integers(0, 63, (100, 4)).astype(np.uint64))
    for radius in (1, 5, 12, 40):
        i, j = simhash.near(wide, radius)
        assert sorted(zip(i.tolist(), j.tolist())) == [(a, b) for a in range(150) for b in range(a + 1, 150) if np.bitwise_count(wide[a] ^ wide[b]).sum() <= radius]


def test_large_groups_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "MOST", 40)
    g = np.random.default_rng(8)
    x = [0]
    for _ in range(299):  # a chain of near fingerprints, in one key
        x.append(x[int(g.integers(max(0, len(x) - 30), len(x)))] ^ (1 << int(g.integers(0, 50))) ^ (1 << int(g.integers(0, 50))))
    x = sorted(set(x))
    want = list(range(len(x)))
    for a in range(len(x)):
        for b in range(a):
            if (x[a] ^ x[b]).bit_count() <= 3 and want[a] != want[b]:
                want = [want[b] if w == want[a] else w for w in want]
    found = simhash.links(spark.createDataFrame([(7, v, v) for v in x], "key long, node long, f0 long"), 3).collect()
    got = {v: v for v in x}
    for r in found:
        assert (r.a ^ r.b).bit_count() <= 3
        if got[r.a] != got[r.b]:
            old, new = got[r.a], got[r.b]
            got = {k: new if v == old else v for k, v in got.items()}
    assert len(set(got.values())) == len(set(want))
    assert all((got[x[a]] == got[x[b]]) == (want[a] == want[b]) for a in range(len(x)) for b in range(a))


def test_similar_texts(spark):
    base = [sentence(120).split() for _ in range(40)]
    rows = []
    for i, w in enumerate(base):
        rows.append((i, " ".join(w)))
        for n in (1, 4, 12):  # words changed
            own = list(w)
            for p in rng.sample(range(len(own)), n):
                own[p] = f"w{rng.random()}"
            rows.append((100 * n + i, " ".join(own)))
    rows += [(5000, ""), (5001, None), (5002, "  "), (5003, ""), (None, rows[0][1])]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").translate(LOWER).split()) else frozenset((r,)) for r, (_, t) in enumerate(rows)]
    alike = {(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    out = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    group = {r.doc_id: r.root for r in out}
    assert len(alike) > 40 and all(group[rows[a][0]] == group[rows[b][0]] for a, b in alike)
    linked = list(range(len(rows)))
    for a, b in alike:
        linked = [linked[b] if w == linked[a] else w for w in linked]
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][1] and rows[b][1] and linked[a] != linked[b]:
                assert group[rows[a][0]] != group[rows[b][0]]
    assert simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_similar_texts_lose_no_link(spark, monkeypatch):
    """Links are found where the first pass finds next to none, and in keys of more texts than a part holds."""
    own = random.Random(11)
    word = lambda: f"w{own.randrange(10**9)}"
    phrase = [word() for _ in range(30)]
    rows = []
    for g in range(12):  # each text has some words of its group's last one changed: chains of just above and below 0.8
        w = phrase[: 5 + g] + [word() for _ in range(60 + 15 * g)]
        for i in range(8):
            rows.append((100 * g + i, " ".join(w)))
            w = list(w)
            for at in own.sample(range(len(w)), own.choice([1, 1, 2, 3])):
                w[at] = word()
    rows += [(5000 + i, " ".join(phrase[:6])) for i in range(3)] + [(6000, "one"), (6001, "ONE "), (6002, None), (6003, "")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").translate(LOWER).split()) else frozenset((t or "",)) for _, t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                want = [want[b] if x == want[a] else x for x in want]
    least = {x: min(r[0] for r, y in zip(rows, want) if x == y) for x in want}
    table = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "PART", 3)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    monkeypatch.setattr(simhash, "radius_of", lambda similarity: 0)
    out = {r.doc_id: r.component_id for r in simhash.similar_texts(table).collect()}
    assert out == {r[0]: least[x] for r, x in zip(rows, want)}


def test_links_beside_a_failed_closest_pair(spark):
    """Two texts that are alike are linked where both are about as close to a third that is like neither."""
    own = random.Random(3)
    word = lambda: f"w{own.randrange(10**9)}"
    rows = []
    for g in range(60):
        w = [word() for _ in range(100)]
        # 10 of 96 shingles differ between the first two, 11 between the third and either.
        for i, places in enumerate(([], [30, 60], [30, 60, 99])):
            v = [word() if at in places else x for at, x in enumerate(w)]
            rows.append((10 * g + i, " ".join(v)))
    out = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: d - (d % 10 == 1) for d, _ in rows}


def test_shard_sorting_stays_small():
    """A shard is sorted within 50 bytes for each of its own."""
    own = random.Random(5)
    text = " ".join(f"w{own.randrange(3000)}" for _ in range(200_000)).encode()
    contexts = [text[a : a + own.randrange(200, 330)] for a in (own.randrange(len(text) - 400) for _ in range(4000))]
    tracemalloc.start()
    try:
        suffix._sort_shard(contexts, [len(c) - 199 for c in contexts], 200)
        assert tracemalloc.get_traced_memory()[1] < 50 * sum(map(len, contexts))
    finally:
        tracemalloc.stop()


def test_places_are_held_per_pattern():
    places = pack.Places({600: 10**6, 1024: 10**9, 400: 7}, 1024)
    assert sum(len(v) for v in places.ranges.values()) < 10
    rank = np.array([0, 1, 6, 7, 8, 999_999])
    (which, start, length, seq, at), is_cut = places.of(600, rank)
    assert is_cut.tolist() == [True] * 6 or is_cut[3:].all()
    for r in range(6):
        mine = sorted((s, n) for w, s, n in zip(which, start, length) if w == r)
        assert sum(n for _, n in mine) == 600 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))
    # A thousand pieces of one length, all placed, in sequences without a gap or padding.
    (which, start, length, seq, at), _ = pack.Places({600: 1000}, 1024).of(600, np.arange(1000))
    by = {}
    for s, o, n in zip(seq.tolist(), at.tolist(), length.tolist()):
        by.setdefault(s, []).append((o, n))
    for own in by.values():
        end = 0
        for o, n in sorted(own):
            assert o == end
            end += n
        assert end <= 1024 and end & (end - 1) == 0
    assert int(length.sum()) == 600_000


def test_scratch_is_of_one_call(spark, docs):
    from paperweir.llm import common

    pending = simhash.near_duplicates(docs)
    with common.scratch(spark) as own:
        simhash.near_duplicates(docs).count()
    assert own.paths
    own.release()
    assert not own.paths and pending.count() == len(ROWS)


def test_long_texts_that_share_a_passage_fetch_no_sets(spark, monkeypatch):
    own = random.Random(5)
    texts = [[f"w{own.randrange(10**6)}" for _ in range(4000)] for _ in range(8)]
    for i in range(0, 8, 2):
        shared = [f"s{i}x{j}" for j in range(60)]
        texts[i][100:160], texts[i + 1][2000:2060] = shared, shared
    alike = texts[0][:3700] + [f"t{j}" for j in range(300)]
    rows = [(i, " ".join(t)) for i, t in enumerate([*texts, alike])]
    sets, cut = [], simhash.Scratch.cut

    def spy(self, df):
        out = cut(self, df)
        sets.extend(r.nid for r in out.select("nid").collect()) if out.columns == ["nid", "s"] else None
        return out

    monkeypatch.setattr(simhash.Scratch, "cut", spy)
    out = {r.doc_id: r.component_id for r in simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: i for i in range(8)} | {8: 0}
    assert len(set(sets)) == 2


def test_parities_bound_differences():
    own = np.random.default_rng(3)
    for n, same in ((700, 0), (700, 690), (1500, 1490), (1500, 1400), (1050, 1000), (4000, 100)):
        a = np.unique(own.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[:same], own.integers(0, 2**63, round(n * own.choice([0.82, 1.0])) - same if same < n * 0.8 else n - same).astype(np.uint64))))
        (x, nx), (y, ny) = (simhash.parity(v, np.array([len(v)])) for v in (a, b))
        lists = [simhash.lists(simhash.pa.array(v.view(np.int64)), w) for v, w in ((x, nx), (y, ny))]
        shared = len(np.intersect1d(a, b))
        alike = shared >= 0.8 * (len(a) + len(b) - shared)
        assert not (alike and simhash.unlike(*lists, np.array([len(a) + len(b)]), 0.8)[0])
        assert alike or shared > 0.6 * n or simhash.unlike(*lists, np.array([len(a) + len(b)]), 0.8)[0]
    assert simhash.parity(np.zeros(3, np.uint64), np.array([3, 0]))[1].tolist() == [0, 0]
