"""BPE encoding and decoding by tree concatenation.

A long text is cut in halves, wherever the middle falls, down to pieces of at most HALF characters. The pieces of all
texts of a batch are split into words and encoded side by side, then joined level by level. At each join a window of
words around it is split and encoded anew, and grows until its first word is the left side's and its last word the right
side's. That is enough for the whole to be exact: no match of the pattern holds a blank or looks behind itself, and how
far one goes on is settled by a neighbour that stays as it is.

A word is encoded by its merges, and a long one in the same way: leaves of LEAF symbols side by side, joined by windows
of tokens that grow until their edges fit both sides. A token sequence is the encoding of its text exactly if each two
neighbours are the encoding of theirs. The work is thus close to linear in the length of a text or word, where taking it
whole is not. Encoded words are kept in a bounded dictionary.

Defined cases: a null or empty text has no ids and decodes to an empty text; special strings in a text are single ids,
as the library's default has it; long texts and long words are taken whole; repeated rows and null ids come back as
they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import settle, table, text_of
from tidemark.llm.token_counts import RankMerger, byte_symbols, has_newer, splitter, vocabulary_bytes

#: What the vocabulary's own description splits by (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Characters in a piece of a text; symbols in a leaf of a word; tokens around a join of leaves at first.
HALF, LEAF, WINDOW = 4096, 64, 4
#: Words, and pairs of tokens, that a worker keeps.
REMEMBERED, PAIRS = 150_000, 200_000


class TreeEncoder:
    """Encodes symbol sequences under a table of merges: pair of ids to (rank, merged id)."""

    def __init__(self, merger: RankMerger, merges: dict[tuple[int, int], tuple[int, int]], parts: dict[int, tuple[int, ...]]):
        self.merger, self.merges, self.parts = merger, merges, parts
        self.agreed: dict[tuple[int, int], bool] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Plain merging of a short sequence: the pair of lowest rank, at all its places from the left, until none is left."""
        merges, symbols = self.merges, list(symbols)
        while len(symbols) > 1:
            best = min((merges[p] for p in zip(symbols, symbols[1:]) if p in merges), default=None)
            if best is None:
                break
            out, i, n = [], 0, len(symbols)
            while i < n:
                if i + 1 < n and merges.get((symbols[i], symbols[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def fits(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their joint symbols."""
        if (known := self.agreed.get((a, b))) is None:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            known = self.agreed[a, b] = self.merge([*self.parts[a], *self.parts[b]]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two sides' joint symbols, from the encodings of the sides."""
        if not left or not right or self.fits(left[-1], right[0]):
            return left + right
        i = j = WINDOW
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            inner = [s for t in left[len(left) - i :] + right[:j] for s in self.parts[t]]
            window = self.merge(inner)
            low = i == len(left) or self.fits(left[len(left) - i - 1], window[0])
            high = j == len(right) or self.fits(window[-1], right[j])
            if low and high:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if low else 2 * i, j if high else 2 * j

    def encode(self, words: list[list[int]]) -> list[list[int]]:
        """The encodings of non-empty symbol sequences: their leaves all at once, then the joins of each."""
        leaves = [w[i : i + LEAF] for w in words for i in range(0, len(w), LEAF)]
        if not leaves:
            return []
        size = np.array([len(x) for x in leaves], np.int64)
        _, done = self.merger.merged(np.fromiter(chain.from_iterable(leaves), np.int64, int(size.sum())), size, keep=True)
        out, at = [], 0
        for w in words:
            n = -(-len(w) // LEAF)
            level, at = done[at : at + n], at + n
            while len(level) > 1:
                level = [self.join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out.append(level[0])
        return out


class Codec:
    """Texts to ids and back, for a vocabulary with word ends."""

    def __init__(self, raw: bytes):
        described = json.loads(raw)
        model = described["model"]
        ids, self.end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.names = {i: t for t, i in ids.items()}
        parts = {i: (i,) for i in self.names}
        merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            made = ids[a + b]
            merges.setdefault((ids[a], ids[b]), (rank, made))
            if parts[made] == (made,):
                parts[made] = parts[ids[a]] + parts[ids[b]]
        self.encoder = TreeEncoder(RankMerger(described), merges, parts)
        self.inner = [ids[c] for c in byte_symbols()]
        self.last = [ids[c + self.end] for c in byte_symbols()]
        self.specials = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.names.update({i: t for t, i in self.specials.items()})
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.words = splitter(PATTERN)
        self.normalizer = Tokenizer.from_buffer(raw).normalizer  # for texts with characters newer than this Python
        self.known: dict[str, tuple[tuple[int, ...], str]] = {}

    def learn(self, words: list[str]) -> None:
        """Adds each word's ids and what they decode to; tokens decode to their names, one space between them."""
        spelled = []
        for data in map(str.encode, words):
            symbols = [self.inner[b] for b in data]
            symbols[-1] = self.last[data[-1]]
            spelled.append(symbols)
        for word, ids in zip(words, self.encoder.encode(spelled)):
            self.known[word] = tuple(ids), " ".join(map(self.names.__getitem__, ids))

    def normal(self, text: str) -> str:
        """Composed characters, each lower-cased for itself (so a final sigma is like any other)."""
        if text.isascii():
            return text.lower()
        if has_newer(text):
            return self.normalizer.normalize_str(text)
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))

    def join(self, text: str, left: tuple[int, int, list[str]], right: tuple[int, int, list[str]]) -> tuple[int, int, list[str]]:
        """The words of two neighbouring pieces of a text, from each one's start, end and words."""
        a, middle, before = left
        _, b, after = right
        if not before or not after:
            return a, b, before + after
        i = j = 1
        start, end = text.rindex(before[-1], a, middle), text.index(after[0], middle, b) + len(after[0])
        while True:
            window = self.words(text[start:end])
            low = i == len(before) or window[0] == before[-i]
            high = j == len(after) or window[-1] == after[j - 1]
            if low and high:
                return a, b, before[: len(before) - i] + window + after[j:]
            # twice the words on a side that differs; between two words there are only blanks
            for _ in range(0 if low else min(i, len(before) - i)):
                i += 1
                start = text.rindex(before[-i], a, start)
            for _ in range(0 if high else min(j, len(after) - j)):
                end = text.index(after[j], end, b) + len(after[j])
                j += 1

    def split(self, text: str) -> list[str]:
        """The words of a normal text: those of its pieces, joined two by two."""
        n = len(text)
        if n <= HALF:
            return self.words(text)
        many = 1 << (-(-n // HALF) - 1).bit_length()
        cuts = [n * k // many for k in range(many + 1)]
        level = [(a, b, self.words(text[a:b])) for a, b in zip(cuts, cuts[1:])]
        while len(level) > 1:
            level = [self.join(text, *level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0][2]

    def both(self, texts: list[str]) -> Iterator[tuple[Iterator[tuple[int, ...]], str]]:
        """For each text: the ids word by word, and the decoded text."""
        split: list[list[str]] = []
        for text in texts:
            parts = self.special.split(text) if "<|" in text else [text]
            words: list[str] = []
            for k, part in enumerate(parts):
                words += [part] if k % 2 else self.split(self.normal(part))
            split.append(words)
        every = set().union(*split).difference(self.specials)
        new = every.difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, every
        self.known.update({t: ((i,), t) for t, i in self.specials.items()})
        self.learn(sorted(new, key=len))
        for words in split:
            found = [self.known[w] for w in words]
            yield (f[0] for f in found), " ".join([f[1] for f in found])


@lru_cache(maxsize=2)
def codec(raw: bytes) -> Codec:
    return Codec(raw)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string) for each row. vocabulary: the path of a word-end BPE file of the tokenizers library."""
    raw = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))  # a vocabulary file: a few MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(raw.value)
        both = own.both
        for batch in batches:
            for at, texts in pieces(batch.column(1)):
                flat, ends, decoded = [], [0], []
                for ids, out in both(texts):
                    flat.append(np.fromiter(chain.from_iterable(ids), np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                    decoded.append(out)
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])
        del own, both  # a worker that waits for other work keeps neither words nor vocabulary
        codec.cache_clear()
        settle()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def pieces(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
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


def digests(coded: DataFrame) -> DataFrame:
    """What the encoder gives, as counts and digests."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
