"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and their white space is made single spaces. An item of m characters may occur
with up to k = floor(error_rate * m) edits. It is split into k + 1 pieces; k edits leave at least one piece intact, so
an exact search for all pieces of all items (one automaton, one pass over the whole text) finds a place near every
occurrence. The text around each hit, merged where hits of an item are close, is verified with Myers' bit-parallel
distance, which also gives where the occurrence ends and, run backwards, where it begins.

Items come to the tasks in blocks of at most block_bytes of text each, one pass over the documents for each block, so a
benchmark of any size is searched whole with bounded memory. Documents are never shuffled or joined.

Defined cases: a null or empty text has no matches; an item that is null or has only white space is no test item. An
item too short for an edit (k = 0) must occur exactly and not inside a longer word. Repeated items and rows, and null
ids, give their own rows; long texts are searched whole; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import settle, table, text_of

ERROR_RATE = 0.05
BLOCK_BYTES = 4 << 20


def normal(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 parts of an item, as even as can be, each with its place."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, best: int) -> tuple[int, int] | None:
    """The least edit distance between pattern and a part of text, and the first place where such a part ends; None if over best."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << i
    plus, minus, score, found = full, 0, m, None
    for j, c in enumerate(text):
        eq = places.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = (minus | ~(xh | plus)) & full
        mh = plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv
        if score <= best and (found is None or score < found[0]):
            found = score, j + 1
    return found


class Searcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, k) in enumerate(self.items):
            for place, piece in pieces(text, k):
                at.setdefault(piece, []).append((n, place))
        self.machine = ahocorasick.Automaton()
        for piece, owners in at.items():
            self.machine.add_word(piece, (len(piece), owners))
        if at:
            self.machine.make_automaton()

    def regions(self, text: str) -> dict[int, list[list[int]]]:
        """By item: the stretches of text that may hold it, apart from each other."""
        if not len(self.machine):
            return {}
        found: dict[int, list[list[int]]] = {}
        for end, (size, owners) in self.machine.iter(text):
            for n, place in owners:
                _, item, k = self.items[n]
                start = end + 1 - size - place
                low, high = max(0, start - k), min(len(text), start + len(item) + k)
                mine = found.setdefault(n, [])
                if mine and low <= mine[-1][1]:
                    mine[-1] = [min(low, mine[-1][0]), max(high, mine[-1][1])]
                else:
                    mine.append([low, high])
        return found

    def matches(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item id, distance, start, end, regions with a match) of the items in a text; of equal distances the first."""
        out = []
        for n, stretches in sorted(self.regions(text).items()):
            item_id, item, k = self.items[n]
            hits = []
            for low, high in stretches:
                if hit := myers(item, text[low:high], k):
                    distance, end = hit[0], low + hit[1]
                    back = myers(item[::-1], text[max(0, end - len(item) - k) : end][::-1], distance)
                    start = end - (back[1] if back else len(item))
                    inside = text[max(0, start - 1) : start].isalnum() or text[end : end + 1].isalnum()
                    if k or not inside:
                        hits.append((distance, start, end))
            if hits:
                out.append((item_id, *min(hits), len(hits)))
        return out


@lru_cache(maxsize=2)
def searcher(items: tuple[tuple[int, str], ...], rate: float) -> Searcher:
    return Searcher(items, rate)


def blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[int, str]]]:
    """The items, normalised, dealt by hash into blocks of about block_bytes; each block is fetched by itself."""
    items = benchmark.select("item_id", normal(text_of("text")).alias("text")).filter(F.length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    return [[(r[0], r[1]) for r in items.filter(block == b).sort("text", "item_id").collect()] for b in range(n)]


def search(docs: DataFrame, items: list[tuple[int, str]], rate: float, carry: str) -> DataFrame:
    """The column carry of each row, and array found of its matches with the items; docs has text, not yet normalised."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(items))  # a block: bounded by block_bytes
    kinds = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "start", "end", "places")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = searcher(shared.value, rate).matches
        names = kinds.names
        for batch in batches:
            found = [[dict(zip(names, m)) for m in find(t.as_py())] for t in batch.column(0)]
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, kind)], [carry, "found"])
        settle()

    schema = T.StructType([docs.schema[carry], T.StructField("found", T.ArrayType(kinds))])
    return docs.select(normal(text_of("text")).alias("text"), carry).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, distance, start, end, places: a row for each document and item found in it (places in its normalised text)."""
    parts = [search(docs.select("doc_id", "text"), items, rate, "doc_id") for items in blocks(benchmark, block_bytes)]
    if not parts:
        parts = [search(docs.select("doc_id", "text"), [], rate, "doc_id")]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.select("doc_id", F.inline("found"))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that hold no test item, with all their columns; each row travels with its text, so there is no join."""
    for items in blocks(benchmark, block_bytes):
        whole = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
        docs = search(whole, items, rate, "_row").filter(F.size("found") == 0).select("_row.*")
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
