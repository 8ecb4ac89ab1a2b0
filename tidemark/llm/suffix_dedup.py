"""Removal of repeated passages by column-wise construction of a many-document suffix order.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. Work is dealt so
that equal strings meet and unique text stays where it is:

1. Documents are dealt into shards. Every window of `length` bytes picks as its anchor the substring of a third of the
   length with the least hash in it, so equal windows pick equal anchors at equal places; a run of windows with one
   anchor is a stretch of length to 1.7 * length bytes. Only anchor hashes are shuffled, each once for a shard, and
   those that two documents share come back to their shards.
2. Stretches at shared anchors, each distinct one of a shard once with the least and largest id that has it, are
   shuffled by anchor into buckets. An anchor that many shards have is dealt by the bytes around it instead: its stretch
   is cut where windows start, so that each part's windows have more than the anchor in common. In a bucket, stretches
   that have all but four of a window's bytes in common with no other (by hash: what differs is not equal) are set
   apart, however many share the anchor and some more by chance. The suffixes of the others are put in order: Burrows-Wheeler
   transform and common prefixes are built column by column through sequential files (suffix_columns). Neighbours with a
   common prefix of `length` or more are equal windows; each class takes its least id.
3. The classes that an id above their least takes part in go back to the shards, which mark and cut the bytes.

An anchor is only a meeting place: whether windows are equal is decided by their bytes alone. Buckets are counted from
the bytes of the input, so what a task holds doesn't grow with it. The files lie in the shared folder that
spark.checkpoint.dir names; each task removes its own.

Defined cases: a null or empty text has no bytes; a null id is neither smaller nor larger than any, so its rows keep all
bytes and remove none elsewhere; rows that share an id are one document, in which nothing repeats; texts shorter than
`length` bytes stay whole. Long texts are hashed in slices that overlap; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir, settle, table, text_of
from tidemark.llm.suffix_columns import Columns, Files

LENGTH = 50
#: Bytes of text in a shard, of text that is hashed at once, and of input for each bucket of stretches.
SHARD, SLICE, BUCKET = 4 << 20, 1 << 17, 16 << 20
#: Shards and buckets that a partition holds where there are more than shuffle partitions.
SHARDS, BUCKETS = 16, 8
#: Bytes of stretches whose suffixes are put in order together (whole anchors).
TOGETHER = 16 << 20
#: Compression level of what is shuffled packed.
LEVEL = 5
#: Shards that have an anchor before it counts as hot, and the parts that its stretches are cut in.
HOT, PARTS = 256, 4
#: What the number of a part of a hot stretch, from 1, adds to its anchor's offset.
PART = 4096
#: Ranges of windows' starts: strings at an anchor that share none of the ranges' common bytes have no window in common.
RANGES = 7
#: Bits of an anchor's hash that are kept.
LOW = np.uint64((1 << 48) - 1)


class Hasher:
    """64-bit hashes of substrings, by sums of weighted bytes."""

    def __init__(self, n: int = SLICE + 4096):
        self.weight = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            self.up = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, base, np.uint64)))
            self.down = np.multiply.accumulate(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))

    def sums(self, data: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(self.weight[data] * self.up[: len(data)], out=total[1:])
        return total

    @staticmethod
    def mixed(h: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        return h

    def every(self, total: np.ndarray, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        with np.errstate(over="ignore"):
            return self.mixed((total[size:] - total[:-size]) * self.down[: len(total) - size])

    def some(self, total: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the substrings from a to b."""
        with np.errstate(over="ignore"):
            return self.mixed((total[b] - total[a]) * self.down[a])


def least_in(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes the place of its least (by the higher bits), the first of several."""
    low = np.uint64((1 << int(len(h)).bit_length()) - 1)
    key, have = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & low).astype(np.int64)


def slices(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in flat pieces: the bytes, and of each part in them the text's number, its first byte there and here.

    Short texts go together, long ones in slices that overlap by a window."""
    job: list[tuple[int, int, bytes]] = []
    held = 0

    def made():
        here = np.cumsum([0, *(len(p) for _, _, p in job[:-1])])
        return np.frombuffer(b"".join(p for _, _, p in job), np.uint8), np.array([n for n, _, _ in job]), np.array([at for _, at, _ in job]), here

    for n, data in enumerate(texts):
        for at in range(0, max(0, len(data) - length + 1), SLICE):
            part = data[at : at + SLICE + length - 1]
            if job and held + len(part) > SLICE + length:
                yield made()
                job, held = [], 0
            job.append((n, at, part))
            held += len(part)
    if job:
        yield made()


class Stretches:
    """Columns of numbers on the stretches of a shard's texts, in order: text (its number), h (the anchor's hash), key (what they
    are dealt by), a and b (first byte and end in the text), off (of the anchor in it, and PART for the part's number), hash (of the bytes)."""

    NAMES = ("text", "h", "key", "a", "b", "off", "hash")

    def __init__(self, found: list[tuple[np.ndarray, ...]]):
        for k, name in enumerate(self.NAMES):
            setattr(self, name, np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64))

    def __len__(self) -> int:
        return len(self.a)


def contains(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among values (sorted)."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def stretches(texts: list[bytes], length: int, hasher: Hasher, shared: np.ndarray | None = None, hot: np.ndarray | None = None) -> Stretches:
    """The stretches of texts: each window of length bytes lies in one of them by its start.

    shared: only those at these anchors (sorted hashes). hot: those at these anchors are cut in PARTS by where windows start."""
    size = length // 3
    found = []
    for flat, number, there, here in slices(texts, length):
        total = hasher.sums(flat)
        every = hasher.every(total, size)
        place = least_in(every, length - size + 1)
        count = np.diff(np.append(here, len(flat))) - length + 1  # windows of each part; those that cross into the next are none
        inside = np.repeat(np.tile((True, False), len(here)), np.column_stack((count, np.full(len(here), length - 1))).ravel())[: len(place)]
        new = np.append(True, place[1:] != place[:-1])
        new[here] = True
        first = np.flatnonzero(new & inside)
        part = np.searchsorted(here, first, "right") - 1
        last = np.minimum(np.append(first[1:], len(place)) - 1, here[part] + count[part] - 1)
        p = place[first]
        h = (every[p] & LOW).astype(np.int64)
        if shared is not None:
            hit = np.flatnonzero(contains(shared, h))
            first, last, part, p, h = first[hit], last[hit], part[hit], p[hit], h[hit]
        off, key = p - first, h
        if hot is not None and len(hot):
            first, last, part, off, h, key = cut_hot(first, last, part, p, h, contains(hot, h), length, hasher, total)
        shift = there[part] - here[part]
        found.append((number[part], h, key, first + shift, last + length + shift, off, hasher.some(total, first, last + length)))
    return Stretches(found)


def start_ranges(length: int, parts: int) -> list[tuple[int, int]]:
    """How far before its anchor a window starts, least and most, for each part of a hot stretch (or range)."""
    free = length - length // 3
    cuts = [i * (free + 1) // parts for i in range(parts + 1)]
    return [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def part_key(common: np.ndarray, g: int) -> np.ndarray:
    return ((common ^ np.uint64(g)) >> np.uint64(1)).astype(np.int64)


def cut_hot(first, last, part, p, h, hot, length: int, hasher: Hasher, total: np.ndarray):
    """Stretches with those at hot anchors in parts: windows whose starts lie in one range before the anchor have all
    bytes of the range's windows' overlap in common, which give the part's key."""
    kept = ~hot
    out = [(first[kept], last[kept], part[kept], (p - first)[kept], h[kept], h[kept])]
    for g, (low, high) in enumerate(start_ranges(length, PARTS)):
        a, z = np.maximum(first, p - high), np.minimum(last, p - low)
        own = np.flatnonzero(hot & (a <= z))
        key = part_key(hasher.some(total, p[own] - low, p[own] - high + length), g)
        out.append((a[own], z[own], part[own], p[own] - a[own] + PART * (g + 1), h[own], key))
    made = [np.concatenate(x) for x in zip(*out)]
    order = np.lexsort((made[0], made[2]))
    return [x[order] for x in made]


def same_bytes(flat: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The number of each string's class of equal ones: by hash, and verified byte by byte."""
    order = np.lexsort((size, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1]))[: len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    model = order[np.flatnonzero(new)][group]
    rest = np.flatnonzero(model != np.arange(len(order)))
    step = 1 << 14
    for at in range(0, len(rest), step):
        own = rest[at : at + step]
        column = np.minimum(np.arange(size[own].max()), size[own, None] - 1)
        if (flat[start[own, None] + column] != flat[start[model[own], None] + column]).any():  # two strings of one hash
            numbers: dict[bytes, int] = {}
            return np.array([numbers.setdefault(flat[a : a + n].tobytes(), len(numbers)) for a, n in zip(start.tolist(), size.tolist())])
    return group


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of strings end to end."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


def hashes_at(flat: np.ndarray, place: np.ndarray, size: int, hasher: Hasher) -> np.ndarray:
    """The hashes of the anchors (strings of one size) at the places."""
    out, step = np.zeros(len(place), np.int64), SLICE // size + 1
    for begin in range(0, len(place), step):
        own = place[begin : begin + step]
        at = np.arange(len(own)) * size
        out[begin : begin + step] = (hasher.some(hasher.sums(gathered(flat, own, np.full(len(own), size))), at, at + size) & LOW).astype(np.int64)
    return out


def strings_of(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def flat_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings end to end, and the size of each."""
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = strings.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[ends[0] : ends[-1]], np.diff(ends)


def in_order(shard: pa.Table) -> list[tuple[int | None, bytes]]:
    """A shard's documents in an order that does not depend on how its rows arrived."""
    return sorted(zip(shard["doc_id"].to_pylist(), map(bytes, shard["data"].to_pylist())), key=lambda d: (d[0] is None, d[0] or 0, d[1]))


def with_ids(docs: list[tuple[int | None, bytes]]) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts of the documents that have an id; they come first."""
    own = [d for d in docs if d[0] is not None]
    return np.array([d[0] for d in own], np.int64), [d[1] for d in own]


def with_keys(flat, start, size, off, hasher: Hasher, length: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The hash of each string, its key, and for each of RANGES of windows' starts the hash of the bytes that all windows
    which start there have in common, the anchor's among them (0: the string has no such window).

    A string that shares none of these with another has no window of its. Parts of hot stretches have no ranges."""
    third = length // 3
    ranges = [x for x in start_ranges(length, RANGES) if x[0] <= x[1]]
    h, key, common = np.zeros(len(size), np.uint64), np.zeros(len(size), np.int64), [np.zeros(len(size), np.uint64) for _ in ranges]
    begins, begin = np.cumsum(size) - size, 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(begins, begins[begin] + SLICE)))
        a, n, o = start[begin:end], size[begin:end], off[begin:end].astype(np.int64)
        total = hasher.sums(gathered(flat, a, n))
        at = begins[begin:end] - begins[begin]
        h[begin:end] = hasher.some(total, at, at + n)
        own = np.flatnonzero(o < PART)
        key[begin + own] = (hasher.some(total, (at + o)[own], (at + o)[own] + third) & LOW).astype(np.int64)
        for g, (low, high) in enumerate(start_ranges(length, PARTS)):
            own = np.flatnonzero(o // PART == g + 1)
            p = (at + o % PART)[own]
            key[begin + own] = part_key(hasher.some(total, p - low, p - high + length), g)
        for out, (low, high) in zip(common, ranges):
            fits = np.flatnonzero((o >= low) & (o - high + length <= n) & (o < PART))
            p = (at + o)[fits]
            out[begin + fits] = hasher.some(total, p - low, p - high + length) | np.uint64(1)
        begin = end
    return h, key, common


def shared_ranges(common: list[np.ndarray]) -> np.ndarray:
    """Which of distinct strings share a range's common bytes (0: none) with another."""
    out = np.zeros(len(common[0]), bool)
    for x in common:
        has = np.flatnonzero(x)
        order = has[np.argsort(x[has])]
        same = x[order][1:] == x[order][:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def sort_stretches(flat, size, off, low, high, length: int, hasher: Hasher, folder: str | None) -> tuple[np.ndarray, ...]:
    """For stretches with the least and largest id that has each: row, first start, last start, least id, for runs of
    windows whose class has a smaller id than the row's largest. Equal windows have equal keys.

    Rows of equal bytes go into the order as one. One that has no other of its key to share a window with is a class of
    its own, whose windows' least id is the rows'."""
    start = np.cumsum(size) - size
    h, key, common = with_keys(flat, start, size, off, hasher, length)
    at = same_bytes(flat, start, size, h)
    model = np.zeros(at.max() + 1, np.int64)
    model[at[::-1]] = np.arange(len(at))[::-1]
    most = np.iinfo(np.int64).max
    least = np.full(len(model), most)
    np.minimum.at(least, at, low)
    own = key[model]
    _, group, members = np.unique(own, return_inverse=True, return_counts=True)
    joint = (members[group] > 1) & (shared_ranges([x[model] for x in common]) | (off[model] >= PART))
    several, alone = np.flatnonzero(joint), np.flatnonzero(~joint)
    several = several[np.argsort(own[several], kind="stable")]
    found = [(alone, np.zeros(len(alone), np.int64), size[model[alone]] - length, least[alone])]
    while len(several):  # whole keys, about TOGETHER bytes of them
        ends = np.flatnonzero(np.append(own[several][1:] != own[several][:-1], True)) + 1
        weight = np.cumsum(size[model[several]])[ends - 1]
        end = ends[min(np.searchsorted(weight, TOGETHER), len(ends) - 1)]
        some, several = several[:end], several[end:]
        n = size[model[some]]
        with Files(folder) as files:
            who, first, name = Columns(gathered(flat, start[model[some]], n), n, length, files).equal_windows()
        best = np.full(int(name.max()) + 1, most)
        np.minimum.at(best, name, least[some[who]])
        order = np.lexsort((first, who))
        who, first, value = who[order], first[order], best[name[order]]
        new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (value[1:] != value[:-1]) | (first[1:] != first[:-1] + 1)))
        last = np.append(new[1:], len(who)) - 1
        found.append((some[who[new]], first[new], first[last], value[new]))
    who, first, last, value = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(who, kind="stable")
    who, first, last, value = who[order], first[order], last[order], value[order]
    # each row gets its string's runs, if an id above the least has it
    begin = np.searchsorted(who, np.arange(len(model) + 1))
    count = np.diff(begin)[at]
    row = np.repeat(np.arange(len(at)), count)
    run = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + begin[at[row]]
    keep = value[run] < high[row]
    row, run = row[keep], run[keep]
    return row, first[run], last[run], value[run]


def as_blobs(columns: pa.Table, by: np.ndarray, name: str) -> pa.Table:
    """The rows of columns compressed together for each value of by: a column of that name, and blob."""
    order = np.argsort(by, kind="stable")
    columns, by = columns.take(pa.array(order)), by[order]
    first = np.flatnonzero(np.append(True, by[1:] != by[:-1])[: len(by)])
    blobs = []
    for a, z in zip(first.tolist(), [*first.tolist()[1:], len(by)]):
        sink = pa.BufferOutputStream()
        part = columns.slice(a, z - a).combine_chunks()
        with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))) as out:
            out.write_table(part)
        blobs.append(sink.getvalue().to_pybytes())
    return pa.table([pa.array(by[first].astype(np.int32)), pa.array(blobs, pa.binary())], [name, "blob"])


def from_blobs(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs]).combine_chunks()


def shards_of(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, data (bytes), shard: about SHARD bytes in each; and the bytes of all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_of("text"), "UTF-8").alias("data"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards // SHARDS)
    return rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "data"), F.lit(shards)).cast("int")).repartition(spread, "shard"), total


def shared_anchors(sharded: DataFrame, length: int) -> DataFrame:
    """shard, h: the anchor hashes of each shard that two or more documents have; -1 - h where it is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            held: dict[int, list[bytes]] = {}
            for doc_id, data, shard in zip(batch.column(0), batch.column(1), batch.column(2)):
                if doc_id.is_valid:
                    held.setdefault(shard.as_py(), []).append(data.as_py())
            for shard, texts in held.items():
                found = stretches(texts, length, hasher)
                if not len(found):
                    continue
                order = np.argsort(found.h, kind="stable")  # texts rise within a hash
                h, text = found.h[order], found.text[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                several = text[np.append(first[1:], len(h)) - 1] != text[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), shard, np.int32)), pa.array(2 * h[first] + several)], ["shard", "x"])

    found = sharded.mapInArrow(run, "shard int, x long").select("shard", F.shiftright("x", 1).alias("h"), F.col("x").bitwiseAND(1).alias("several"))
    everywhere = Window.partitionBy("h")
    found = found.withColumn("n", F.count(F.lit(1)).over(everywhere)).withColumn("any", F.max("several").over(everywhere))
    return found.filter("n > 1 or any > 0").select("shard", F.when(F.col("n") > HOT, -1 - F.col("h")).otherwise(F.col("h")).alias("h"))


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start and end), kept (the other bytes) for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    sharded, total = shards_of(docs)  # one plan to the end: its shuffle is made once and read three times
    shared = shared_anchors(sharded, length)
    folder = checkpoint_dir(spark)
    buckets = max(1, -(-total // BUCKET))
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS)

    def at_shared(key, left: pa.Table, right: pa.Table) -> pa.Table:
        hasher = Hasher()
        ids, texts = with_ids(in_order(left))
        h = right["h"].to_numpy()
        hot = np.unique(-1 - h[h < 0])
        found = stretches(texts, length, hasher, np.union1d(h[h >= 0], hot), hot)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        start, size = begin[found.text] + found.a, found.b - found.a
        group = same_bytes(flat, start, size, found.hash)
        # documents come by rising id: the first of a class has the least, the last the largest
        first, last = np.zeros(len(set(group.tolist())), np.int64), np.zeros(len(set(group.tolist())), np.int64)
        last[group] = np.arange(len(group))
        first[group[::-1]] = np.arange(len(group))[::-1]
        order = np.argsort(first)  # as they lie in the texts: the columns are all but in order, and so compress well
        first, last = first[order], last[order]
        columns = [found.text[first].astype(np.int32), found.a[first], ids[found.text[first]], ids[found.text[last]] - ids[found.text[first]], found.off[first].astype(np.int16)]
        table_ = pa.table([*map(pa.array, columns), strings_of(gathered(flat, start[first], size[first]), size[first])], ["doc", "a", "low", "more", "off", "data"])
        shard = pa.array(np.full(len(first), key[0].as_py() if len(first) else 0, np.int32))
        mixed = Hasher.mixed(found.key[first].astype(np.uint64))
        return as_blobs(table_.append_column("shard", shard), (mixed % np.uint64(buckets)).astype(np.int64), "bucket")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()

        def sort(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
            t = from_blobs(blobs)
            flat, size = flat_of(t["data"].combine_chunks() if isinstance(t["data"], pa.ChunkedArray) else t["data"])
            low, more, off = (t[c].to_numpy() for c in ("low", "more", "off"))
            row, a, b, least = sort_stretches(flat, size, off, low, low + more, length, hasher, folder)
            at = pa.array(row)
            made = {"doc": t["doc"].take(at), "a": t["a"].take(at), "size": pa.array(size[row].astype(np.int16)), "off": pa.array(off[row])}
            made |= {"first": pa.array(a.astype(np.int16)), "last": pa.array(b.astype(np.int16)), "least": pa.array(least)}
            yield from as_blobs(pa.table(made), t["shard"].to_numpy()[row], "shard").to_batches()

        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and held:
                    yield from sort(held)
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield from sort(held)
        settle()

    parts = sharded.groupBy("shard").cogroup(shared.groupBy("shard")).applyInArrow(at_shared, "bucket int, blob binary")
    found = parts.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(classes, "shard int, blob binary")

    def mark(key, left: pa.Table, right: pa.Table) -> pa.Table:
        docs_in = in_order(left)
        data = [d[1] for d in docs_in]
        size = np.array([len(d) for d in data], np.int64)
        begin = np.cumsum(np.append(0, size))
        gone = np.zeros(int(begin[-1]) + 1, bool)
        if right.num_rows:
            told = from_blobs(right["blob"].to_pylist())
            ids, texts = with_ids(docs_in)
            for a, z in covered(ids, texts, begin, told, length):
                gone[a:z] = True
        kept = ~gone[:-1]
        flat = np.frombuffer(b"".join(data), np.uint8)
        # runs of removed bytes, none across documents
        edge = gone[:-1] & ~np.append(False, gone[:-2]) if len(flat) else np.zeros(0, bool)
        starts = begin[:-1][size > 0]
        edge[starts] = gone[starts]
        a = np.flatnonzero(edge)
        stop = np.zeros(len(flat) + 1, bool)
        stop[np.flatnonzero(gone[:-1]) + 1] = True  # after a removed byte
        stop[: len(flat)] &= kept | edge
        z = np.flatnonzero(stop)
        owner = np.searchsorted(begin, a, "right") - 1
        number = np.bincount(owner, minlength=len(size))
        removed = np.add.reduceat(np.append(gone[:-1], False).astype(np.int64), begin[:-1]) * (size > 0) if len(size) else size
        pairs = pa.FixedSizeListArray.from_arrays(pa.array(np.column_stack((a - begin[owner], z - begin[owner])).ravel()), 2).cast(pa.list_(pa.int64()))
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)).astype(np.int32)), pairs)
        out = [pa.array([d[0] for d in docs_in], pa.int64()), pa.array(size), pa.array(removed), spans, strings_of(flat[kept], size - removed)]
        return pa.table(out, ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return sharded.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(mark, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def covered(ids: np.ndarray, texts: list[bytes], begin: np.ndarray, told: pa.Table, length: int) -> list[tuple[int, int]]:
    """The spans to remove from a shard's texts laid end to end, from the runs of windows that the buckets tell of, each
    for one of the equal stretches of the shard."""
    hasher = Hasher()
    doc, a, size, off, first, last, least = (told[c].to_numpy().astype(np.int64) for c in ("doc", "a", "size", "off", "first", "last", "least"))
    flat = np.frombuffer(b"".join(texts), np.uint8)
    place, told_at = np.unique(begin[doc] + a + off % PART, return_inverse=True)
    h = hashes_at(flat, place, length // 3, hasher)[told_at]
    whole = stretches(texts, length, hasher, np.unique(h), np.unique(h[off >= PART]))  # only those at the anchors told of
    start = begin[whole.text] + whole.a
    n = whole.b - whole.a
    # a told stretch is one of the shard's: its place gives its row, that gives all rows of its bytes
    order = np.lexsort((n, start))
    key = start[order] * (4 * length) + n[order]
    row = order[np.searchsorted(key, (begin[doc] + a) * (4 * length) + size)]
    wanted = np.unique(whole.hash[row])
    some = np.flatnonzero(contains(wanted, whole.hash))
    group = np.full(len(n), -1)
    group[some] = same_bytes(flat, start[some], n[some], whole.hash[some])
    # each row meets the runs of its class
    by = np.argsort(group[row], kind="stable")
    low = np.searchsorted(group[row][by], group[some])
    count = np.searchsorted(group[row][by], group[some], "right") - low
    left = np.repeat(some, count)
    right = by[np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
    later = least[right] < ids[whole.text[left]]
    left, right = left[later], right[later]
    x, y = start[left] + first[right], start[left] + last[right] + length
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    if not len(x):
        return []
    # joined where they overlap; texts' spans may touch, which changes nothing here
    reach = np.maximum.accumulate(y)
    new = np.append(True, x[1:] > reach[:-1])
    return list(zip(x[new].tolist(), np.maximum.reduceat(y, np.flatnonzero(new)).tolist()))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
