"""Token counts by rank-synchronous array merging.

A byte-level BPE vocabulary splits a text into pre-tokens and merges symbol pairs inside each, the pair of lowest rank
first. Here the distinct new pre-tokens of a batch lie in one flat numpy array with offsets (a ragged array). Each
round finds every sequence's lowest-rank pair and applies it at all its places in all sequences at once; a sequence
without a mergeable pair leaves the array. What is left of each sequence is counted. Counts of pre-tokens seen before
are kept in a bounded dictionary, so frequent words cost one look-up.

Defined cases: a null or empty text has no bytes and no tokens; a special string in a text is one token, as the
library's default has it; long texts are taken whole; repeated rows and null ids come back as they are; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_of

#: The split of byte-level BPE, as its public description gives it (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens whose counts a worker keeps.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """Counts the symbols of byte strings after all merges."""

    def __init__(self, vocabulary: dict):
        model = vocabulary["model"]
        ids = model["vocab"]
        self.start = np.array([ids[c] for c in byte_symbols()], np.int64)
        self.width = max(ids.values()) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([ids[a] * self.width + ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.none = len(keys)

    def rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pair's rank (none: no merge) and the symbol it makes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none), self.made[at]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols each of the non-empty byte strings has left."""
        size = np.array([len(t) for t in tokens], np.int64)
        return self.merged(self.start[np.frombuffer(b"".join(tokens), np.uint8)], size)[0]

    def merged(self, sym: np.ndarray, size: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list[list[int]]]:
        """For non-empty symbol sequences laid end to end: the length of each after all merges and, if kept, its symbols."""
        sym = sym.astype(np.int64)
        seq = np.repeat(np.arange(len(size)), size)
        left = np.zeros(len(size), np.int64)
        kept: list[list[int]] = [[] for _ in range(len(size) if keep else 0)]
        while len(sym):
            rank, made = self.rank(sym[:-1], sym[1:])
            rank = np.append(np.where(seq[:-1] == seq[1:], rank, self.none), self.none)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            least = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            over = np.repeat(least == self.none, length)
            hit = (rank == np.repeat(least, length)) & ~over
            # where a pair overlaps itself (aaa), the places of a run are taken in turn, from its left
            at = np.flatnonzero(hit)
            if len(at):
                run = np.flatnonzero(np.append(True, np.diff(at) != 1))
                odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 1
                at = at[~odd]
                sym[at] = made[at]
            done = least == self.none
            left[seq[first[done]]] = length[done]
            if keep and done.any():
                out, ends = sym[over].tolist(), np.cumsum(length[done]).tolist()
                for k, a, b in zip(seq[first[done]].tolist(), [0, *ends], ends):
                    kept[k] = out[a:b]
            stay = ~over
            stay[at + 1] = False
            sym, seq = sym[stay], seq[stay]
        return left, kept


@lru_cache(maxsize=1)
def newer() -> str:
    """Letters, numbers and marks that the regex module knows and this Python's own tables don't."""
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}\p{M}]+", unknown))


def ranges(chars: str) -> str:
    """A set of characters as a regex class has it."""
    at = np.array(sorted(map(ord, chars)), np.int64)
    return "".join(f"\\U{r[0]:08X}-\\U{r[-1]:08X}" for r in np.split(at, np.flatnonzero(np.diff(at) != 1) + 1) if len(r))


def has_newer(text: str) -> bool:
    """Whether a text has any of the newer characters; all are past Latin-1."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return bool(newer_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


@lru_cache(maxsize=1)
def newer_table() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[list(map(ord, newer()))] = True
    return out


def splitter(pattern: str):
    """pattern's findall, with the letters and numbers that the tokenizers library has.

    The regex module knows newer ones, which are symbols to the library; texts with any of them go a slower way."""
    from tokenizers import Regex, pre_tokenizers

    plain = regex.compile(pattern).findall
    if not (maybe := newer()):
        return plain
    theirs = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True).pre_tokenize_str(maybe)
    symbols = ranges(set(maybe) - {t for t, _ in theirs} - set(regex.findall(r"\p{M}", maybe)))
    strict = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{symbols}]]").replace(r"\p{N}", rf"[\p{{N}}--[{symbols}]]")).findall
    return lambda text: strict(text) if has_newer(text) else plain(text)


@lru_cache(maxsize=2)
def counter(raw: bytes):
    """A function from texts to token counts, for the vocabulary file's bytes."""
    vocabulary = json.loads(raw)
    merger = RankMerger(vocabulary)
    specials = sorted((t["content"] for t in vocabulary["added_tokens"]), key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
    split = splitter(PATTERN)
    known: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        split_texts = []
        for text in texts:
            parts = special.split(text) if special else [text]
            split_texts.append((len(parts) - 1, [t for part in parts for t in split(part)] if len(parts) > 1 else split(text)))
        every = set().union(*(tokens for _, tokens in split_texts))
        new = sorted(every.difference(known), key=len)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = sorted(every, key=len)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            known.update(zip(some, merger.counts([t.encode() for t in some]).tolist()))
        return [n + sum(map(known.__getitem__, tokens)) for n, tokens in split_texts]

    return counts


def blocks(texts: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    """Whole texts in lists of about so many characters."""
    some, n = [], 0
    for text in texts:
        some.append(text.as_py())
        n += len(some[-1])
        if n >= size:
            yield some
            some, n = [], 0
    if some:
        yield some


def vocabulary_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row. vocabulary: the path of a byte-level BPE file of the tokenizers library."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # a vocabulary file: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(raw.value)
        for batch in batches:
            n = pa.array([c for some in blocks(batch.column(1)) for c in counts(some)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
        .withColumn("n_bytes", F.octet_length("text").cast("long"))
        .mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
