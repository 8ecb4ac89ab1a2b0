"""SimHash near-dedup by a Gray-order hierarchical index.

Each text becomes a 64-bit fingerprint: of the XXH64 of its word shingles, bit by bit, what over half of them have.
Fingerprints link at max_bits or fewer differing bits, and linked ones form components.

Candidates: the bits are split in max_bits + 1 parts; two fingerprints that link agree in one part at least. For each
part, distinct fingerprints that share its bits form a group, sorted by the Gray rank of their other bits, so that
neighbours differ little. Over each group stands a tree: every run of up to FAN neighbours has an upper node with the
bits that all its members share (a pattern under a mask), runs of nodes have nodes of their own, up to one for the
group. Node pairs are compared from the top: where the bits that both fix differ in more than max_bits places, the
whole pair of subtrees is dropped; at the bottom fingerprints are compared themselves. Pairs of subtrees that are in
one component already are skipped, and a group gives only a spanning forest of its links, never all pairs.

A group of more than GROUP fingerprints is dealt out again by the bits it leaves free, split the same way (the links
inside agree in one of these parts too), twice at most. At two bits that leaves at most 19 bits free, so a task holds at
most 2^19 fingerprints whatever the data are; at the six bits of the near-dedup stage 40 bits stay free, so there a task's
share grows with fingerprints that agree in 24 bits. Components come from the forests' edges by alternating large-star and
small-star steps, each written to the checkpoint folder.

The near-dedup stage (keep_one) takes these links at six bits, and texts that share a band of least shingle hashes, as
candidates only: each is verified by the exact Jaccard similarity of the whole texts' shingles before components form.

Defined cases: a null, empty or blank text has fingerprint zero, which links like any other. A null id takes part, but
is not a component's smallest id unless there is no other. Repeated rows get a result each; long texts are hashed
whole, in steps; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, cut, salted_join, settle, small, table, text_of

WORDS, SEED, MAX_BITS = 3, 42, 2
FAN, GROUP, PAIRS = 8, 20_000, 200_000
#: XXH64's primes (fixed values); bytes from which a string is hashed by itself; shingles that are hashed at once.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
LONG, TOGETHER = 4096, 1 << 15
#: Bands of minima for candidates of the near-dedup stage: at a similarity of 0.8 no band is shared with a chance of 6e-4, at 0.1
#: one is with a chance of 4e-7, so texts with a passage in common seldom meet however many they are.
BANDS, ROWS = 40, 8
#: Rounds of comparing with one text of a band at most before bands are compared as a whole; pairs a text for which the latter is done at
#: once; texts of a band on one side of a comparison; shingles that are looked at together.
PIVOTS, CHEAP, SIDE, COLUMNS = 4, 512, 512, 4096
_FACTORS: list[np.ndarray] = []


def xxh64(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The XXH64 of many byte strings inside data, all at once; strings of LONG bytes or more one by one."""
    u, one, two, three, four, five = np.uint64, *(np.uint64(p) for p in PRIMES)
    padded = np.append(data, np.zeros(8, np.uint8))
    lane8 = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    lane4 = np.ndarray(len(data) + 1, "<u4", padded.data, strides=(1,))
    turned = lambda x, r: (x << u(r)) | (x >> u(64 - r))
    step = lambda acc, lane: turned(acc + lane * two, 31) * one
    with np.errstate(over="ignore"):
        acc = np.full(len(start), u(seed) + five)
        wide = np.flatnonzero((size >= 32) & (size < LONG))
        if len(wide):
            v = [np.full(len(wide), x) for x in (u(seed) + one + two, u(seed) + two, u(seed), u(seed) - one)]
            stripes, at = size[wide] // 32, start[wide]
            for k in range(int(stripes.max())):
                on = np.flatnonzero(stripes > k) if k else slice(None)
                for i in range(4):
                    v[i][on] = step(v[i][on], lane8[at[on] + 32 * k + 8 * i])
            sums = turned(v[0], 1) + turned(v[1], 7) + turned(v[2], 12) + turned(v[3], 18)
            for x in v:
                sums = (sums ^ step(u(0), x)) * one + four
            acc[wide] = sums
        acc += size.astype(u)
        at, rest = start + size // 32 * 32, size % 32
        for k in range(3):
            on = np.flatnonzero(rest >= 8 * (k + 1))
            acc[on] = turned(acc[on] ^ step(u(0), lane8[at[on] + 8 * k]), 27) * one + four
        at, rest = at + rest // 8 * 8, rest % 8
        on = np.flatnonzero(rest >= 4)
        acc[on] = turned(acc[on] ^ (lane4[at[on]].astype(u) * one), 23) * two + three
        at, rest = at + rest // 4 * 4, rest % 4
        for k in range(3):
            on = np.flatnonzero(rest > k)
            acc[on] = turned(acc[on] ^ (data[at[on] + k].astype(u) * five), 11) * one
        acc ^= acc >> u(33)
        acc *= two
        acc ^= acc >> u(29)
        acc *= three
        acc ^= acc >> u(32)
    for k in np.flatnonzero(size >= LONG).tolist():
        acc[k] = xxhash.xxh64_intdigest(data[start[k] : start[k] + size[k]].tobytes(), seed)
    return acc


def shingles(texts: list[str], words: int = WORDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of all word shingles of whole lower-cased texts, text after text, and how many each has: none without a word."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b" ".join(raw), np.uint8)
    blank = (flat == 32) | ((flat >= 9) & (flat <= 13))
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # words and one blank after each
    data = np.where(blank, np.uint8(32), flat)[keep]
    first = np.flatnonzero(~blank & np.append(True, blank[:-1])[: len(flat)])  # where words start in flat
    ends = np.flatnonzero(data == 32)
    end = ends if len(ends) == len(first) else np.append(ends, len(data))
    begin = np.append(0, end[:-1] + 1)[: len(first)]
    size = np.array([len(r) + 1 for r in raw], np.int64)
    owner = np.searchsorted(first, np.append(0, np.cumsum(size)))  # each text's first word
    have = np.diff(owner)
    count = np.where(have > 0, np.maximum(have - words + 1, 1), 0)
    total = int(count.sum())
    out = np.empty(total, np.uint64)
    own = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    for at in range(0, total, TOGETHER):
        k, w = own[at : at + TOGETHER], nth[at : at + TOGETHER]
        low = owner[k] + w
        high = np.minimum(low + words, owner[k + 1]) - 1
        out[at : at + TOGETHER] = xxh64(data, begin[low], end[high] - begin[low], seed)
    return out, count


def majorities(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, bit by bit, what over half of its hashes have; nothing for a text without any."""
    out = np.zeros(len(count), np.uint64)
    ends = np.cumsum(count)
    for k in np.flatnonzero(count).tolist():
        ones = np.zeros(64, np.int64)
        for at in range(ends[k] - count[k], ends[k], TOGETHER):
            part = h[at : min(at + TOGETHER, ends[k])]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > count[k], bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """The fingerprint of a whole lower-cased text, unsigned."""
    return int(majorities(*shingles([text], words, seed))[0])


def pieces(texts: pa.Array, size: int = 1 << 18) -> Iterator[tuple[int, list[str]]]:
    """Whole texts in lists of about so many characters, each with its place."""
    some, n, at = [], 0, 0
    for text in texts:
        some.append(text.as_py())
        n += len(some[-1])
        if n >= size:
            yield at, some
            at, some, n = at + len(some), [], 0
    if some:
        yield at, some


def fingerprints(docs: DataFrame, carry: str, text_col: str = "text", words: int = WORDS) -> DataFrame:
    """The column carry of each row and fp, its fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [majorities(*shingles(some, words)) for _, some in pieces(batch.column(0))]
            fp = np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(fp)], [carry, "fp"])
        settle()

    schema = T.StructType([docs.schema[carry], T.StructField("fp", T.LongType())])
    return docs.select(ascii_lower(text_of(text_col)).alias("text"), carry).mapInArrow(run, schema)


def thirds(mask: int, parts: int) -> list[int]:
    """The masks that a mask grows to, each with one part of the bits it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [i * len(free) // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(x: Column) -> Column:
    """The place of x in the reflected Gray code, in unsigned order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Components among the fingerprints of a group, by union of numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root
            self.root = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            r = self.find()
            low, high = np.minimum(r[a], r[b]), np.maximum(r[a], r[b])
            apart = low != high
            if not apart.any():
                return
            np.minimum.at(self.root, high[apart], low[apart])


def linked(fp: np.ndarray, max_bits: int) -> np.ndarray:
    """For a group in Gray order: the number of each fingerprint's component, its first member."""
    n, forest = len(fp), Forest(len(fp))
    if n < 2:
        return forest.root
    pattern, mask = [fp], [np.full(n, 2**64 - 1, np.uint64)]
    while len(pattern[-1]) > 1:
        first = np.arange(0, len(pattern[-1]), FAN)
        both = mask[-1]
        every = np.bitwise_and.reduceat(np.where(both, pattern[-1] & both, 0), first)
        none = np.bitwise_and.reduceat(~pattern[-1] & both, first)
        pattern.append(every)
        mask.append(every | none)
    # pairs of nodes that wait, with their level; the last in is looked at first, so few wait at a time
    waiting = [(len(pattern) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while waiting:
        level, a, b = waiting.pop()
        if len(a) > PAIRS:
            waiting.append((level, a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        near = popcount((pattern[level][a] ^ pattern[level][b]) & mask[level][a] & mask[level][b]) <= max_bits
        a, b = a[near], b[near]
        if level == 0:
            own = a != b
            forest.union(a[own], b[own])
            continue
        # what is one component already needs no comparing
        r, size = forest.find(), FAN**level
        first = np.arange(0, n, size)
        low, high = np.minimum.reduceat(r, first), np.maximum.reduceat(r, first)
        done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
        a, b = a[~done], b[~done]
        if len(a):
            below = len(pattern[level - 1])
            i, j = (np.repeat(np.arange(FAN), FAN), np.tile(np.arange(FAN), FAN))
            for at in range(0, len(a), PAIRS // (FAN * FAN)):
                x = (a[at : at + PAIRS // (FAN * FAN), None] * FAN + i).ravel()
                y = (b[at : at + PAIRS // (FAN * FAN), None] * FAN + j).ravel()
                keep = (x <= y) & (x < below) & (y < below)
                waiting.append((level - 1, x[keep], y[keep]))
    return forest.find()


def group_edges(rows: DataFrame, max_bits: int) -> DataFrame:
    """u, v: a spanning forest of the links inside the groups of rows (mask, key, rank, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(fp)))
            u, v = [], []
            two = start[size == 2]  # most groups of several are pairs
            hit = two[popcount(fp[two] ^ fp[two + 1]) <= max_bits]
            u.append(fp[hit + 1])
            v.append(fp[hit])
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                own = fp[s : s + n]
                r = linked(own, max_bits)
                at = np.flatnonzero(r != np.arange(n))
                u.append(own[at])
                v.append(own[r[at]])
            u, v = np.concatenate(u).view(np.int64), np.concatenate(v).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:  # the last group of a batch may go on in the next
            held = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, (batch.column(0), batch.column(1), batch.column(2)))]
            cuts = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(cuts):
                k = cuts[-1] + 1
                yield edges(held[0][:k], held[1][:k], held[2][:k].view(np.uint64))
                held = [h[k:].copy() for h in held]
        if len(held[0]):
            yield edges(held[0], held[1], held[2].view(np.uint64))

    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "rank").select("mask", "key", "fp")
    return dealt.mapInArrow(run, "u long, v long")


def keyed(fps: DataFrame, masks: Column) -> DataFrame:
    """Each fingerprint under each of its masks: mask, key (the bits under it), fp."""
    rows = fps.select("fp", F.explode(masks).alias("mask"))
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """u, v: edges that join the same fingerprints as all links do. fps: distinct fp."""
    parts = max_bits + 1
    level = [0]
    rows = None
    out = []
    for depth in range(3):
        table_of = {m: thirds(m, parts) for m in level}
        if depth == 0:
            rows = keyed(fps, F.array(*[F.lit(signed(m)) for m in table_of[0]]))
        else:
            grown = F.create_map(*[x for m, ms in table_of.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(g)) for g in ms]))])
            rows = keyed(rows.select("fp", "mask"), grown[F.col("mask")])
        level = [g for ms in table_of.values() for g in ms]
        large = None
        if depth < 2:
            large = rows.groupBy("mask", "key").count().filter(F.col("count") > GROUP).select("mask", "key")
        small = rows if large is None else rows.join(large, ["mask", "key"], "left_anti")
        small = small.withColumn("rank", gray_rank(F.col("fp").bitwiseAND(F.bitwise_not(F.col("mask")))))
        out.append(cut(group_edges(small, max_bits)))
        if large is None:
            break
        large = cut(large)
        if large.isEmpty():
            break
        rows = cut(rows.join(large, ["mask", "key"], "left_semi"))
    edges = out[0]
    for more in out[1:]:
        edges = edges.union(more)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """node, root: for each node of edges (u, v) the smallest node it is joined to."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        ways = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            ways = ways.filter("v < u")
        least = ways.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = ways.join(least, "u")
        if large:
            return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()

    state = cut(edges.filter("u <> v").distinct())
    before = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        state = cut(star(star(state, large=True), large=False))


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp (signed), component_id for each row of docs (doc_id, text)."""
    marked = cut(fingerprints(docs.select("doc_id", "text"), "doc_id", words=words))
    ids = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(ids.select("fp"), max_bits))
    placed = ids.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    told = placed.select("fp", "root").join(named, "root").select(F.col("fp").alias("_fp"), "component_id")
    return salted_join(marked, told, F.col("fp") == F.col("_fp"), ["doc_id"]).select("doc_id", "fp", "component_id")


def least_hashes(h: np.ndarray) -> list[int]:
    """For each band the hash of ROWS minima over all shingles, signed; equal sets give equal ones.

    Minima are of 32 bits: they only choose candidates."""
    if not _FACTORS:
        _FACTORS.append(np.random.default_rng(SEED).integers(0, 2**32, (2, BANDS * ROWS, 1), np.uint32))
    mix, odd = _FACTORS[0][0], _FACTORS[0][1] | np.uint32(1)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 1024):
        least = np.minimum(least, ((low[at : at + 1024] ^ mix) * odd).min(1))
    rows = least.reshape(BANDS, ROWS)
    return [signed(xxhash.xxh64_intdigest(r.tobytes(), k)) for k, r in enumerate(rows)]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, h (of the lower-cased text), fp, n (distinct shingles) and bands of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in pieces(batch.column(0)):
                h, count = shingles(some, words)
                bands = [least_hashes(x) for x in np.split(h, np.cumsum(count)[:-1])]
                n = [len(np.unique(x)) for x in np.split(h, np.cumsum(count)[:-1])]
                made = [pa.array(majorities(h, count).view(np.int64)), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns[1:]), *made], ["doc_id", "h", "fp", "n", "bands"])
        settle()

    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("h", "fp", "n")], T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(ascii_lower(text_of("text")).alias("text"), "doc_id").select("text", "doc_id", F.xxhash64("text").alias("h")).mapInArrow(run, schema)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """h and shingles, the distinct hashes of its shingles, of each row of texts (h, text lower-cased)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in pieces(batch.column(1)):
                h, count = shingles(some, words)
                sets = [np.unique(x).view(np.int64) for x in np.split(h, np.cumsum(count)[:-1])]
                ends = np.cumsum([0, *map(len, sets)])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), lists], ["h", "shingles"])
        settle()

    return texts.select("h", "text").mapInArrow(run, "h long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs u, v of text hashes whose shingle sets have a Jaccard similarity of least or more; two empty sets have 1.

    sets: h, shingles of every text that pairs can name."""
    own = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    a, b = (sets.select(F.col("h").alias(x), F.col("shingles").alias(f"_{x}")) for x in ("u", "v"))
    both = own.join(a, "u").join(b, "v")
    shared = F.size(F.array_intersect("_u", "_v"))
    return cut(both.filter(shared >= F.lit(least) * (F.size("_u") + F.size("_v") - shared)).select("u", "v"))


def verified(marked: DataFrame, docs: DataFrame, words: int, max_bits: int, least: float) -> DataFrame:
    """node, root: the components of verified links among the text hashes of marked (h, fp, bands).

    Candidates: the fingerprint index's links, and texts that share a band. In a band each text is first compared with one
    pivot, which joins most of what belongs together; then bands that still hold several components are compared as a
    whole, after some more pivots if they are large. So each two texts of a band are compared or in one component."""
    own = marked.dropDuplicates(["h"])
    named = cut(own.groupBy("fp").agg(F.min("h").alias("first")))
    by_fp = own.select("fp", "h").join(named, "fp").select(F.col("first").alias("u"), F.col("h").alias("v"))
    firsts = lambda x: named.select(F.col("fp").alias(x), F.col("first").alias(f"_{x}"))
    index = links(named.select("fp"), max_bits).join(firsts("u"), "u").join(firsts("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
    rows = own.select("h", "n", F.explode("bands").alias("band"))
    # sets of too different sizes can't be that similar
    alike = lambda a, b: F.least(a, b) >= F.lit(least) * F.greatest(a, b)
    several = rows.groupBy("band").agg(F.min("h").alias("a"), F.max("h").alias("z")).filter("a <> z").select("band")
    rows = cut(rows.join(several, "band", "left_semi"))

    def pivots(members: DataFrame, turn: int) -> DataFrame:
        # by an order that all bands share: texts that meet in several bands mostly have one pivot, so one pair, there
        chosen = members.groupBy("band").agg(F.min_by(F.struct("h", "root", "n"), F.xxhash64("h", F.lit(turn))).alias("p"))
        return members.join(chosen, "band").filter((F.col("root") != F.col("p.root")) & alike(F.col("n"), F.col("p.n"))).select(F.col("p.h").alias("u"), F.col("h").alias("v"))

    first = cut(pivots(rows.withColumn("root", F.col("h")), 0).union(index).union(by_fp).filter("u <> v").distinct())
    # the texts that any candidate can name become shingle sets, once for all rounds
    wanted = rows.select("h").union(first.select("u")).union(first.select("v")).distinct()
    texts = docs.select(ascii_lower(text_of("text")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = texts.join(small(cut(wanted)), "h", "left_semi").dropDuplicates(["h"])
    sets = cut(shingle_sets(texts, words))
    edges = similar(first, sets, least)
    for turn in range(1, PIVOTS + 1):
        roots = components(edges)
        members = rows.join(roots, F.col("h") == F.col("node"), "left").select("band", "h", "n", F.coalesce("root", "h").alias("root"))
        parts = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("h")).alias("x"), F.sum(F.pmod("h", F.lit(1 << 31))).alias("s"))
        counts = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("k"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")]
        # bands of the same texts are looked at once
        open_ = parts.groupBy("band").agg(*counts).filter("k > 1").groupBy("n", "x", "s").agg(F.min("band").alias("band"), F.min("squares").alias("squares"))
        open_ = cut(open_.select("band", "n", "squares"))
        size = open_.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("squares")) / 2).alias("pairs")).first()
        if not size["n"]:
            return roots
        if turn == PIVOTS or size["pairs"] <= CHEAP * size["n"]:
            break
        edges = edges.union(similar(pivots(cut(members.join(open_.select("band"), "band", "left_semi")), turn), sets, least))
    return components(edges.union(compared(members.join(open_.select("band", F.col("n").alias("in_band")), "band"), sets, least)))


def block_links(h: np.ndarray, root: np.ndarray, flat: np.ndarray, count: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same texts of a block as all its links between different components do; flat: the sets, one after another."""
    n, owner = len(h), np.repeat(np.arange(len(h)), count)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    several = times[column] > 1  # what only one text has is in no intersection
    owner, column = owner[several], (np.cumsum(times > 1) - 1)[column[several]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((n, n), np.float32)  # whole numbers below 2^24
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((n, COLUMNS), np.float32)
        has[owner[a:z], column[a:z] - low] = 1
        shared += has @ has.T
    shared = shared.astype(float)
    link = (shared >= least * (count[:, None] + count[None, :] - shared)) & (root[:, None] != root[None, :])
    forest = Forest(n)
    forest.union(*np.nonzero(np.triu(link)))
    r = forest.find()
    at = np.flatnonzero(r != np.arange(n))
    return h[at], h[r[at]]


def compared(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """u, v: edges for all links between different components in one band. members: band, h, root, in_band (texts of the band).

    A large band is dealt into parts of about SIDE texts, and each two parts meet in a block of their own; a block's shingle
    sets are compared at once where they lie, so neither sets nor pairs are multiplied out by pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            lists = t.column("shingles").combine_chunks()
            count, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            key = [t.column(c).to_numpy() for c in ("band", "one", "two")]
            h, root, ends = t.column("h").to_numpy(), t.column("root").to_numpy(), np.cumsum(np.append(0, count))
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            out = [(np.zeros(0, np.int64),) * 2]
            for a, z in zip(np.append(0, cuts).tolist(), np.append(cuts, len(h)).tolist()):
                if z - a > 1 and (root[a:z] != root[a]).any():
                    out.append(block_links(h[a:z], root[a:z], flat[ends[a] : ends[z]], count[a:z], least))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["u", "v"])

        held: list[pa.RecordBatch] = []
        for batch in batches:  # the last block of a batch may go on in the next
            key = [batch.column(c).to_numpy() for c in range(3)]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            first = [b.column(c)[0].as_py() for b in held[:1] for c in range(3)]
            if held and first != [k[0] for k in key]:
                yield edges(pa.Table.from_batches(held))
                held = []
            if len(cuts):
                yield edges(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]))
                held = []
            held.append(batch.slice(cuts[-1] if len(cuts) else 0))
        if held:
            yield edges(pa.Table.from_batches(held))
        settle()

    parts = F.ceil(F.col("in_band") / SIDE).cast("int")
    own = F.pmod(F.xxhash64("h", F.lit(3)), parts).cast("int")
    met = members.select("band", "h", "root", own.alias("part"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    met = met.select("band", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), "h", "root")
    whole = met.join(sets, "h").select("band", "one", "two", "h", "root", "shingles")
    dealt = whole.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")
    return cut(dealt.mapInArrow(run, "u long, v long"))


def keep_one(docs: DataFrame, words: int = 5, max_bits: int = 6, least: float = 0.8) -> DataFrame:
    """The row with the smallest id of each group of near-duplicates of docs, with all its columns.

    Near-duplicates have a Jaccard similarity of least or more between their word shingles, or are linked by such pairs.
    Rows of one group that share this id (an id on several texts) all stay, for they are one document."""
    marked = cut(sketches(docs.select("doc_id", "text"), words))
    roots = verified(marked, docs, words, max_bits, least)
    found = marked.select("doc_id", "h").join(roots, F.col("h") == F.col("node"), "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
    found = cut(found)
    named = found.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.max("doc_id").alias("_last"), F.count("doc_id").alias("_with"), F.count(F.lit(1)).alias("_all")
    )
    named = named.filter("component_id <> _last or _with between 1 and _all - 1").select(F.col("root").alias("_root"), "component_id")
    gone = salted_join(found, named, F.col("root") == F.col("_root"), ["h"]).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = cut(gone.select(F.col("doc_id").alias("_id"), F.col("h").alias("_gone")).distinct())
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64(ascii_lower(text_of("text"))).alias("_h"))
    met = (F.col("_h") == F.col("_gone")) & F.col("_row.doc_id").eqNullSafe(F.col("_id"))
    return whole.join(small(gone), met, "left_anti").select("_row.*")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
