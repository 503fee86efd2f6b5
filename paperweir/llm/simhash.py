"""SimHash near-duplicates: 64-bit fingerprints, linked within a radius by bit-sliced comparison."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperweir.llm import tokens as K
from paperweir.llm.common import Scratch, cut, lists, map_text, trimmed
from paperweir.llm.components import components

U = np.uint64
# Fixed values of the XXH64 function.
P1, P2, P3, P4, P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Rows that are compared with each other at a time, and rows of one key that a task compares itself; more are dealt out.
BLOCK, MOST = 1024, 16_384
#: Words of 64 bits in the fingerprints that similarity is read from; keys per text, and least shingle hashes in each.
WIDE, KEYS, LEAST = 4, 16, 4
#: Words of 64 bits in the marks that bound how far two shingle sets differ; texts that shingles are counted in, and most counts.
MARKS, SAMPLE, COUNTED = 16, 10_000, 50_000
#: Shingles above which a text has a parity() besides its marks, which tell larger sets apart less and less.
LONG = 32 * MARKS
#: Rows of one part of a key, and pairs that are held against each other at a time.
PART, PAIRS = 8192, 100_000
#: Bits of each band; any two fingerprints that differ in at most 3 bits agree on 2 of the 5 bands whole.
BANDS = (13, 13, 13, 13, 12)
#: For each byte value a word whose byte b is bit b of it: sums of up to 255 words count all eight bits at once.
_SPREAD = np.array([sum(((v >> b) & 1) << (8 * b) for b in range(8)) for v in range(256)], U)


def _rotl(x, r):
    return (x << U(r)) | (x >> U(64 - r))


def _round(v, lane):
    return _rotl(v + lane * P2, 31) * P1


def xxh64(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[s:e], all at once."""
    if not len(s):
        return np.zeros(0, U)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    w8 = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    w4 = np.ndarray((len(padded) - 3,), "<u4", padded, strides=(1,))
    size = (e - s).astype(np.int64)
    at, left = s.astype(np.int64).copy(), size.copy()
    h = np.full(len(s), U(seed) + P5, U)
    big = np.flatnonzero(size >= 32)
    if len(big):
        with np.errstate(over="ignore"):
            v = [np.full(len(big), x, U) for x in (U(seed) + P1 + P2, U(seed) + P2, U(seed), U(seed) - P1)]
        live = np.arange(len(big))
        while len(live):
            rows = big[live]
            for i in range(4):
                v[i][live] = _round(v[i][live], w8[at[rows] + 8 * i])
            at[rows] += 32
            left[rows] -= 32
            live = live[left[rows] >= 32]
        x = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for y in v:
            x = (x ^ _round(U(0), y)) * P1 + P4
        h[big] = x
    h += size.astype(U)
    rows = np.flatnonzero(left >= 8)
    while len(rows):
        h[rows] = _rotl(h[rows] ^ _round(U(0), w8[at[rows]]), 27) * P1 + P4
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] >= 8]
    rows = np.flatnonzero(left >= 4)
    if len(rows):
        h[rows] = _rotl(h[rows] ^ (w4[at[rows]].astype(U) * P1), 23) * P2 + P3
        at[rows] += 4
        left[rows] -= 4
    rows = np.flatnonzero(left >= 1)
    while len(rows):
        h[rows] = _rotl(h[rows] ^ (padded[at[rows]].astype(U) * P5), 11) * P1
        at[rows] += 1
        left[rows] -= 1
        rows = rows[left[rows] >= 1]
    h ^= h >> U(33)
    h *= P2
    h ^= h >> U(29)
    h *= P3
    return h ^ (h >> U(32))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each k-word shingle (of fewer words: the whole sequence), and shingles per row."""
    seen = K.VISIBLE[data]
    keep = seen.copy()
    keep[1:] |= seen[:-1]
    flat = np.where(seen, K.LOWER[data], np.uint8(32))[keep]
    o = np.concatenate(([0], np.cumsum(keep)))[offsets]
    s, e, row = K.spans(flat != 32, o)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    j = i + np.repeat(np.minimum(n, k), count) - 1
    return xxh64(flat, s[i], e[j]), count


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per row the bits that are set in over half of its hashes; zero for rows of none."""
    out = np.zeros(len(count), U)
    full = np.flatnonzero(count)
    if not len(full):
        return out
    # Blocks of at most 255 shingles, each within a row.
    c = count[full]
    parts = -(-c // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    lead = np.cumsum(parts) - parts
    begin = np.repeat(np.cumsum(c) - c, parts) + 255 * (np.arange(parts.sum()) - np.repeat(lead, parts))
    by = h.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        sums = np.add.reduceat(_SPREAD[by[:, j]], begin).view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(sums, lead, axis=0)
        for b in range(8):
            out[full] |= (total[:, b] * 2 > c).astype(U) << U(8 * j + b)
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    return majority(*shingle_hashes(data, offsets, k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of shingle_hashes(), in order, and their number per row."""
    h, count = shingle_hashes(data, offsets, k)
    rows = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
    return h[first], np.bincount(rows[first], minlength=len(count))


def sketches(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(WIDE words of fingerprint, KEYS keys, whether there is a shingle) of each row of shingle_sets(). A key is a hash of the least values that
    LEAST functions take over the row's shingles: two rows share it with their similarity to the power LEAST."""
    wide = np.stack([majority(K.mix(h + U((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), count) for i in range(WIDE)], 1)
    keys = np.zeros((len(count), KEYS), U)
    full = np.flatnonzero(count)
    if len(full):
        lead = (np.cumsum(count) - count)[full]
        for i in range(KEYS):
            key = np.full(len(full), U(i + 1), U)
            for j in range(LEAST):
                key = K.mix(key * U(0xC2B2AE3D27D4EB4F) + np.minimum.reduceat(K.mix(h ^ K.mix(np.array([1000 + LEAST * i + j], U))), lead))
            keys[full, i] = key
    return wide, keys, count > 0


def with_fingerprint(docs: DataFrame, text: str = "text", k: int = 3, out: str = "fp") -> DataFrame:
    """docs with a 64-bit fingerprint as long; zero where there is no word."""

    def make():
        return lambda data, offsets: [pa.array(fingerprints(data, offsets, k).view(np.int64))]

    return map_text(docs, text, make, [T.StructField(out, T.LongType())])


def close(probes: np.ndarray, rows: np.ndarray, radius: int, later: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (probe, row) within the radius, of fingerprints of any number of 64-bit words; with `later`, of equal arrays only
    those of words from the probe's own on. Bit planes lie vertically: a word holds one bit of 64 fingerprints. Counters, as many
    words as the radius has bits and a flag, count the differences from one probe by carry-save, and a word whose 64 all
    exceed the radius is dropped."""
    n, size = len(rows), rows.shape[1] * 64
    words, high = -(-n // 64), radius.bit_length()
    bits = np.zeros((size, words * 64), np.uint8)
    bits[:, :n] = np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(U)
    ones = U(0xFFFFFFFFFFFFFFFF)
    sign = np.where(np.unpackbits(np.ascontiguousarray(probes).view(np.uint8), axis=1, bitorder="little").T > 0, ones, U(0))
    probe, word = np.repeat(np.arange(len(probes)), words), np.tile(np.arange(words), len(probes))
    if later:
        keep = word >= probe // 64
        probe, word = probe[keep], word[keep]
    counters, over = [np.zeros(len(probe), U) for _ in range(high)], np.zeros(len(probe), U)

    def beyond():
        """Which of each word's counts are above the radius."""
        more, even = over.copy(), ~over
        for i in reversed(range(high)):
            if radius >> i & 1:
                even &= counters[i]
            else:
                more |= even & counters[i]
                even &= ~counters[i]
        return more

    for b in range(size):
        carry = planes[b][word] ^ sign[b][probe]
        for i in range(high):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if b > radius and b % 8 == 7:
            live = np.flatnonzero(beyond() != ones)
            if len(live) < 0.9 * len(probe):
                probe, word, over, counters = probe[live], word[live], over[live], [c[live] for c in counters]
    found = np.unpackbits((~beyond()).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    p, b = np.nonzero(found)
    i, j = probe[p], word[p] * 64 + b
    ok = j < n
    return i[ok], j[ok]


def near(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of x within the radius; x has a row of 64-bit words, or one word, for each fingerprint."""
    x = x.reshape(len(x), -1)
    i, j = close(x, x, radius, later=True)
    return i[j > i], j[j > i]


def joined(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within the radius that join the components of x, for any number of rows. Of rows up to a block they are the
    closest ones: a spanning tree of least distance.

    More are first held against a few leaders, the row closest to the majority of all and then such as no leader has taken. What
    one leader has taken is linked to it, and so that a leader's chance does not decide, to another leader as well; rows
    outside the largest such group are compared with all others."""
    n = len(x)
    if n <= BLOCK:
        return tree(x, *near(x, radius))
    label, found = np.full(n, -1), []
    by_bit = np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, bitorder="little")
    centre = np.packbits(by_bit.mean(0) > 0.5, bitorder="little").view(U)
    leader = int(np.bitwise_count(x ^ centre).sum(1).argmin())
    del by_bit
    for turn in range(4):
        near_by = np.flatnonzero(np.bitwise_count(x ^ x[leader]).sum(1) <= radius)
        found.append((np.full(len(near_by), leader), near_by))
        label[near_by[label[near_by] < 0]] = leader
        free = np.flatnonzero(label < 0)
        if len(free):
            leader = int(free[0])
        elif turn == 0:  # all taken: the one farthest from the leader leads once more
            leader = int(np.bitwise_count(x ^ x[leader]).sum(1).argmax())
        else:
            break
    rest = np.flatnonzero(label != np.bincount(label[label >= 0]).argmax())
    for lo in range(0, len(rest), BLOCK // 2):
        probes = rest[lo : lo + BLOCK // 2]
        for at in range(0, n, 8 * BLOCK):
            i, j = close(x[probes], x[at : at + 8 * BLOCK], radius)
            found.append(tree(x, probes[i], at + j))
    i, j = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return i[i != j], j[i != j]


def tree(x: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of x those of a spanning forest of least distance: round by round each component takes its closest pair."""
    n = len(x)
    order = np.argsort(np.bitwise_count(x[i] ^ x[j]).sum(1), kind="stable")
    i, j = i[order], j[order]
    label, left, kept = np.arange(n), np.arange(len(i)), []
    while True:
        a, b = label[i[left]], label[j[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        taken = np.unique(best[best < len(i)])
        kept.append(taken)
        member, least = forest(n, label[i[taken]], label[j[taken]])
        to = np.arange(n)
        to[member] = least
        label = to[label]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return i[kept], j[kept]


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, least member) of the components of the pairs among n rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _band_keys(fp: str) -> list:
    at, bands = 0, []
    for width in BANDS:
        bands.append(F.shiftrightunsigned(F.col(fp), at).bitwiseAND(F.lit((1 << width) - 1)))
        at += width
    pairs = list(combinations(range(len(BANDS)), 2))
    return [F.lit(t << 32).bitwiseOR(F.shiftleft(bands[a], 13).bitwiseOR(bands[b])) for t, (a, b) in enumerate(pairs)]


def _streamed(batches, chunk: int):
    """Whole groups of rows sorted by key: (keys, words, nodes, None), or of a key with more than `chunk` rows one chunk after
    another, with its number. No more than a batch and a chunk is held."""
    rest, number = None, 0
    for batch in trimmed(batches):
        now = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now
        while rest.num_rows:
            k = rest.column(0).to_numpy()
            end = int(np.searchsorted(k, k[-1], "left"))
            if end:
                first = int(np.searchsorted(k, k[0], "right")) if number else 0
                if number:  # the end of a key that was begun
                    yield rest.slice(0, first), number
                    number = 0
                if end > first:
                    yield rest.slice(first, end - first), None
                rest = rest.slice(end)
            elif rest.num_rows >= 2 * chunk or (number and rest.num_rows >= chunk):
                yield rest.slice(0, chunk), number
                rest, number = rest.slice(chunk), number + 1
            else:
                break
    if rest is not None and rest.num_rows:
        yield rest, number or None


def links(keyed: DataFrame, radius: int, words: int = 1) -> DataFrame:
    """(a, b) links that join all nodes within the radius that share a key; each is such a pair. keyed: (key long, node, f0, f1,
    ... long).

    Rows go to partitions by key, lie there in key order and are compared key by key. A key with more than MOST rows is
    cut into chunks, and every pair of its chunks is a group of its own in a second pass: no pair is lost at any size, and no
    task holds more than a few chunks."""
    spark, fields = keyed.sparkSession, [f"f{i}" for i in range(words)]
    node = keyed.schema["node"].dataType
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = T.StructType([T.StructField("a", node), T.StructField("b", node), T.StructField("key", T.LongType()), T.StructField("chunk", T.IntegerType()), *[T.StructField(f, T.LongType()) for f in fields]])

    def compare(table: pa.Table):
        k, nodes = table.column(0).to_numpy(), table.column(1).combine_chunks()
        x = np.stack([table.column(2 + i).to_numpy() for i in range(words)], 1).view(U)
        start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        size = np.diff(np.concatenate((start, [len(k)])))
        a, b = [], []
        small = np.flatnonzero((size > 1) & (size <= BLOCK))
        lo, ends = 0, np.cumsum(size[small])
        while lo < len(small):
            base = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
            rows = np.concatenate([np.arange(start[g], start[g] + size[g]) for g in small[lo:hi]])
            i, j = joined(x[rows], radius)
            a.append(rows[i])
            b.append(rows[j])
            lo = hi
        for g in np.flatnonzero(size > BLOCK):
            i, j = joined(x[start[g] : start[g] + size[g]], radius)
            a.append(start[g] + i)
            b.append(start[g] + j)
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        keep = a != b
        return (nodes.take(pa.array(a[keep])), nodes.take(pa.array(b[keep]))) if keep.any() else None

    def run(batches):
        for table, chunk in _streamed(batches, MOST):
            if chunk is None:
                pair = compare(table)
                if pair is not None:
                    none = pa.nulls(len(pair[0]), pa.int64())
                    yield pa.RecordBatch.from_arrays([*pair, none, none.cast(pa.int32()), *[none] * words], names=first.names)
            else:
                t = table.combine_chunks()
                columns = [c.combine_chunks() for c in t.columns]
                yield pa.RecordBatch.from_arrays([columns[1], columns[1], columns[0], pa.array(np.full(t.num_rows, chunk, np.int32)), *columns[2:]], names=first.names)

    def again(batches):
        for table, _ in _streamed(batches, 1 << 40):
            pair = compare(table)
            if pair is not None:
                yield pa.RecordBatch.from_arrays(list(pair), names=["a", "b"])

    found = cut(keyed.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(run, first))
    done = found.where("key is null").select("a", "b")
    held = found.where("key is not null")
    if held.limit(1).count() == 0:
        return done
    chunks = held.groupBy("key").agg((F.max("chunk") + 1).alias("n"))
    # A chunk meets every chunk of its key once, itself among them where it stands alone with a neighbour.
    pairs = held.join(chunks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("n = 1 or other <> chunk")
    group = F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other"))
    rows = pairs.select(group.alias("key"), F.col("a").alias("node"), *fields)
    more = rows.repartition(n, "key").sortWithinPartitions("key", "node").mapInArrow(again, T.StructType(first.fields[:2]))
    return done.union(more)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, text_hash): component_id is the smallest doc_id reachable over links of at most 3 differing bits.

    Candidates share two of five bands, which any two fingerprints within the radius do. Equal fingerprints are one node, so
    copies are never paired. Texts without words share the fingerprint zero and link like any other. Null texts are empty; a
    null doc_id takes part, but is nobody's smallest unless no other is there; repeated rows stay repeated; texts of any length
    are read whole; an empty table gives no rows. Other columns are not looked at.
    """
    if radius > 3:
        raise ValueError("two of five bands are sure to agree up to 3 differing bits")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"))
    marked = cut(with_fingerprint(rows, "text", k).select("doc_id", "fp", "text_hash"))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    keyed = nodes.select(F.explode(F.array(*_band_keys("fp"))).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("f0"))
    named = _named(nodes.withColumnRenamed("fp", "node"), links(keyed, radius)).withColumnRenamed("node", "fp")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id", "text_hash")


def _named(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root, component_id) of nodes (node, low): the smallest `low` of each component."""
    roots = components(edges).withColumnRenamed("node", "own")
    rooted = nodes.join(roots, F.col("node") == F.col("own"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("node", "root", "component_id")


def radius_of(similarity: float) -> int:
    """Differing bits in WIDE words that all but one in 700 pairs of sets of this similarity (of all elements the shared ones)
    stay within: three standard deviations above the expected number."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * WIDE * p + 3 * math.sqrt(64 * WIDE * p * (1 - p)))


def prefixes(h: np.ndarray, count: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each row's set, rarest first, and their number. Two sets that are alike to `similarity` share more
    than what either has outside its first n - similarity * n + 1, so that they share one of these. Any one order of all
    shingles will do; this one is by count (`times` of `common`, in order; others have none), then by hash."""
    rows = np.repeat(np.arange(len(count)), count)
    often = np.zeros(len(h), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = np.where(common[at] == h, times[at], 0)
    h = h[np.lexsort((h, often, rows))]
    most = np.where(count > 0, count - np.ceil((similarity - 1e-9) * count).astype(np.int64) + 1, 0)
    return h[np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count) < np.repeat(most, count)], most


def marks(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """MARKS words per row: bit b tells whether an odd number of its shingles fall on b. Sets differ in at least as many shingles
    as their marks do in bits."""
    bit, out = K.mix(h) % U(64 * MARKS), np.zeros(len(count) * MARKS, U)
    np.bitwise_xor.at(out, np.repeat(np.arange(len(count)) * MARKS, count) + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out.reshape(len(count), MARKS)


def parity(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marks of rows of more than LONG shingles, in as many bits as twice their shingles, up to a power of two; and the words
    per row, 0 for the others. Half of one, put on its other half by XOR, is what half as many bits would be."""
    words = np.where(count > LONG, 1 << np.ceil(np.log2(np.maximum(count, 1) / 32)).astype(np.int64), 0)
    start = np.cumsum(words) - words
    rows = np.repeat(np.arange(len(count)), count)
    held = words[rows] > 0
    bit, rows = K.mix(h[held]), rows[held]
    bit &= (words[rows] * 64 - 1).astype(U)
    out = np.zeros(words.sum(), U)
    np.bitwise_xor.at(out, start[rows] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    return out, words


def unlike(x: pa.ListArray, y: pa.ListArray, both: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the parities x and y of each row, if both are there, rule out that its sets are alike: sets differ in at least as many
    shingles as these do in bits. both: shingles of the two together."""
    out = np.zeros(len(both), bool)
    values = [c.values.to_numpy().view(U) for c in (x, y)]
    at = [c.offsets.to_numpy() for c in (x, y)]
    size = [np.diff(o) for o in at]
    some = (size[0] > 0) & (size[1] > 0)
    share = (similarity - 1e-9) / (1 + similarity)
    for p, q in set(zip(size[0][some].tolist(), size[1][some].tolist())):
        mine, least = np.flatnonzero((size[0] == p) & (size[1] == q)), min(p, q)
        for rows in np.array_split(mine, -(-len(mine) * (p + q) // (1 << 20))):
            a, b = (np.bitwise_xor.reduce(v[o[rows][:, None] + np.arange(n)].reshape(len(rows), n // least, least), axis=1) for v, o, n in zip(values, at, (p, q)))
            out[rows] = np.bitwise_count(a ^ b).sum(1) > both[rows] * (1 - 2 * share)
    return out


def _close(found: DataFrame, long: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that parities (nid, n, parity) do not rule out. A parity is a 25th of its text, and a set is larger
    than its text: pairs that share a shingle by chance, which grow with the square of the texts, carry no sets."""
    x = long.select(F.col("nid").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x"))
    y = long.select(F.col("nid").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y"))
    none = F.array().cast("array<long>")
    both = F.coalesce(F.col("n_a") + F.col("n_b"), F.lit(0)).alias("both")
    pairs = found.join(x, "a", "left").join(y, "b", "left").select("a", "b", both, F.coalesce("x", none).alias("x"), F.coalesce("y", none).alias("y"))

    def run(batches):
        for batch in trimmed(batches):
            drop = unlike(batch.column(3), batch.column(4), batch.column(2).to_numpy(), similarity)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(~drop)) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def meeting(group: np.ndarray, n: np.ndarray, place: np.ndarray, part: np.ndarray, root: np.ndarray, mark: np.ndarray, similarity: float):
    """Pairs (i, j) of rows of one group that can be alike, by sizes, places of the key in both orders, and marks; not those of one
    root, nor of one part in a group of two. Rows are sorted by group (number, whether of two parts) and size."""
    share = (similarity - 1e-9) / (1 + similarity)
    sorted_by = group[:, 0] << 32 | n
    end = np.searchsorted(sorted_by, group[:, 0] << 32 | (n / (similarity - 1e-9)).astype(np.int64), "right")
    width = end - np.arange(len(n)) - 1
    total, lo, found = np.cumsum(width), 0, []
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        i = np.repeat(np.arange(lo, hi), width[lo:hi])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width[lo:hi]) - width[lo:hi], width[lo:hi])
        both = n[i] + n[j]
        # At the first shingle that both share nothing before it counts, and no more than what follows it in either.
        ok = (root[i] != root[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= share * both)
        ok &= (group[i, 1] == 0) | (part[i] != part[j])
        i, j, both = i[ok], j[ok], both[ok]
        ok = np.bitwise_count(mark[i] ^ mark[j]).sum(1) <= both * (1 - 2 * share)
        found.append((i[ok], j[ok]))
        lo = hi
    return np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), np.concatenate([f[1] for f in found] or [np.zeros(0, np.int64)])


def _counted(marked: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, in how many texts) of shingles that are frequent in a sample of about SAMPLE of the texts (node, text), by hash."""

    def shingles():
        def apply(data, offsets):
            h, count = shingle_sets(data, offsets, k)
            return [lists(pa.array(h.view(np.int64)), count)]

        return apply

    parts = max(1, marked.count() // SAMPLE)
    some = marked.where(F.pmod(F.xxhash64("node"), F.lit(parts)) == 0).select("node", "text").dropDuplicates(["node"])
    sets = map_text(some, "text", shingles, [T.StructField("s", T.ArrayType(T.LongType()))]).select(F.explode("s").alias("h"))
    top = sets.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COUNTED).toArrow()
    common, times = top.column("h").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], times[order]


def _met(rooted: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of texts (nid, root, n, prefix, m0, m1, ...) of different roots that share a shingle of their prefixes and can be
    alike: all pairs that are, whatever the number of texts of one shingle. Of a shingle's texts PART on average meet PART in
    a task, and every two parts do in one."""
    fields = [f"m{i}" for i in range(MARKS)]
    n = int(rooted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rooted.select("nid", "root", "n", F.posexplode("prefix").alias("place", "key"))
    own = Window.partitionBy("key")
    keyed = keyed.withColumn("rows", F.count(F.lit(1)).over(own)).withColumn("low", F.min("root").over(own)).withColumn("high", F.max("root").over(own))
    keyed = cut(keyed.where("low < high").select("key", "nid", "place", F.ceil(F.col("rows") / PART).cast("int").alias("parts")))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("nid"), "parts").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "nid", "place")
    rows = keyed.join(rooted.select("nid", "root", "n", *fields), "nid").select("key", "low", "high", "part", "nid", "place", "root", "n", *fields)

    def run(batches):
        def compare(table):
            column = [table.column(i).to_numpy() for i in range(8)]
            key, low, high, part, nid, place, root, size = column
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
            mark = np.stack([table.column(8 + i).to_numpy() for i in range(MARKS)], 1).view(U)
            group = np.stack([np.cumsum(new), low != high], 1).astype(np.int64)
            i, j = meeting(group, size.astype(np.int64), place.astype(np.int64), part, root, mark, similarity)
            pair = np.unique(np.stack([np.minimum(nid[i], nid[j]), np.maximum(nid[i], nid[j])], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

        rest = None
        for batch in trimmed(batches):
            now = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, now]).combine_chunks() if rest is not None and rest.num_rows else now
            last = np.flatnonzero(np.any([c[1:] != c[:-1] for c in (rest.column(i).to_numpy() for i in range(3))], axis=0))
            if len(last):  # the last group may go on
                yield compare(rest.slice(0, last[-1] + 1))
                rest = rest.slice(last[-1] + 1)
        if rest is not None and rest.num_rows:
            yield compare(rest)

    return rows.repartition(n, "key", "low", "high").sortWithinPartitions("key", "low", "high", "n").mapInArrow(run, "a long, b long").distinct()


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, node, root, component_id): texts whose sets of k-word shingles are alike to `similarity` or more have one root,
    a text of the group, and one component_id, the smallest doc_id reachable.

    No link is lost: any two such texts share a shingle of their prefixes(), and all pairs that do and can be alike by sound bounds
    are verified on the shingles themselves, unless links join them already. Long texts that share one by chance are ruled out
    by their parity() before sets are fetched. For large groups most links come from a first
    pass that may lose some: candidates share one of KEYS keys of least shingle hashes and differ in at most
    radius_of(similarity) bits of 256; of these a spanning forest of least distance is verified.
    node is a 128-bit hash of the text: equal texts are one node. Null texts and texts without words are like nothing but
    their equals, with a component of their own text. Repeated rows stay repeated; a null doc_id takes part, but is nobody's
    smallest unless no other is there; texts of any length are read whole; an empty table gives no rows; other columns are not
    looked at.
    """
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))

    common, times = _counted(marked, k)

    def sketch():
        def apply(data, offsets):
            h, count = shingle_sets(data, offsets, k)
            wide, keys, some = sketches(h, count)
            first, size = prefixes(h, count, similarity, common, times)
            mark = marks(h, count)
            own, words = parity(h, count)
            added = [pa.array(wide[:, i].view(np.int64)) for i in range(WIDE)] + [pa.array(mark[:, i].view(np.int64)) for i in range(MARKS)]
            return [*added, lists(pa.array(own.view(np.int64)), words), lists(pa.array(keys[some].ravel().view(np.int64)), np.where(some, KEYS, 0)), pa.array(count), lists(pa.array(first.view(np.int64)), size)]

        return apply

    def shingles():
        def apply(data, offsets):
            h, count = shingle_sets(data, offsets, k)
            return [lists(pa.array(h.view(np.int64)), count)]

        return apply

    longs = [f"f{i}" for i in range(WIDE)]
    many = T.ArrayType(T.LongType())
    fields = [T.StructField(f, T.LongType()) for f in [*longs, *[f"m{i}" for i in range(MARKS)]]]
    fields += [T.StructField("parity", many), T.StructField("keys", many), T.StructField("n", T.LongType()), T.StructField("prefix", many)]
    # Sketches and shingles are most of what is stored: they go once they are read, and (node, doc_id) and (nid, node, low) stay.
    first, second = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    sketched = first.cut(map_text(marked, "text", sketch, fields).drop("text"))
    own = [f.name for f in fields]
    one = second.cut(sketched.groupBy("node").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in own]).withColumn("nid", F.monotonically_increasing_id()))
    rows = cut(sketched.select("doc_id", "node"))
    first.release()
    nodes = cut(one.select("nid", "node", "low"))

    def alike(found: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) of nid that are alike."""
        held = Scratch(docs.sparkSession)
        found = held.cut(found)
        ends = found.select(F.explode(F.array("a", "b")).alias("nid")).distinct().join(nodes.select("nid", "node"), "nid")
        # Shingles of the texts that have a candidate, compared row by row in the JVM: no batch holds many long sets.
        own = marked.select("node", "text").join(ends, "node")
        sets = held.cut(map_text(own, "text", shingles, [T.StructField("s", many)]).select("nid", "s").dropDuplicates(["nid"]))
        pairs = found.join(sets.select(F.col("nid").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("nid").alias("b"), F.col("s").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        kept = cut(pairs.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b"))
        held.release()
        return kept

    keyed = one.select(F.explode("keys").alias("key"), F.col("nid").alias("node"), *longs)
    found = links(keyed, radius_of(similarity), WIDE).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    linked = alike(found)
    roots = components(linked).withColumnRenamed("node", "nid")
    # A text of one root with all others of its shingle is told by the shingle's least and greatest root.
    marks_of = [f"m{i}" for i in range(MARKS)]
    rooted = first.cut(one.join(roots, "nid", "left").select("nid", F.coalesce("root", "nid").alias("root"), "n", "prefix", *marks_of))
    long = first.cut(one.where(F.size("parity") > 0).select("nid", "n", "parity"))
    second.release()
    more = alike(_close(first.cut(_met(rooted, similarity)), long, similarity))
    first.release()
    named = _named(nodes.select(F.col("nid").alias("node"), "low"), roots.toDF("a", "b").union(more)).withColumnRenamed("node", "nid")
    name = nodes.select("nid", "node")
    named = cut(named.join(name, "nid").drop("nid").join(name.toDF("root", "text"), "root").select("node", F.col("text").alias("root"), "component_id"))
    return rows.join(named, "node").select("doc_id", "node", "root", "component_id")
