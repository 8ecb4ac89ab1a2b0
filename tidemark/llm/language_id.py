"""Language ID by hierarchical discrimination.

A first set of linear support vector machines, one per family against the rest, picks the language family; inside the
family, one-versus-one machines separate the close languages and vote. Features are the counts of hashed 1- to 3-grams
of a whole text's lower-cased letters (other characters count as a break), on a square-root scale and of unit length.
Every labelled row that may teach does. Rows are dealt by a hash of id and text into parts of about rows_in_a_part; a machine is fitted on
each part that holds both its sides, and its weights are the mean over those parts. Mean vectors of languages are sums over all rows.
Sums are of whole numbers, so neither the rows' order nor their partitions change a model. Every row is scored.

Every machine gives some language, and two families' margins mirror each other, so neither margins nor votes can say that
none fits. keep_identified asks how near a text is to the mean vector of some learned language, and compares with texts of
about as many different n-grams among all labelled rows that did not teach: what lies far below nearly all of them goes.

Defined cases: a null text, or one without a letter, gets `und` and score 0; so does every row when nothing could be
learnt (an empty table, no labels). A row with a null lang never
teaches; a null id counts as the empty text in the fold.
Very long texts are read whole, in steps. Repeated rows get a result each; other columns are ignored. Languages that the
family table doesn't name are a family of their own.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fold, settle, table, text_of
from tidemark.llm.linear import sigmoid, svm
from tidemark.operators.stats import exact_quantiles

#: Which languages are of one family (fixed values: ISO 639-1 codes by common classification).
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
}

DIMENSIONS = 1 << 13
#: Size classes of texts, by the number of different features.
CLASSES = 15
#: Sums are of whole multiples of these: every half-precision value is one of the first; weights are rounded to the second.
UNIT, WEIGHT_UNIT = 1 << 24, 1 << 32
#: Parts whose sums one task adds up.
FAN = 64


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def letter_table() -> np.ndarray:
    """For each character of the basic plane: 0 if it is no letter, else its code point."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x10000)], np.uint32)


_LETTERS: list[np.ndarray] = []


def features(text: str, step: int = 1 << 20) -> np.ndarray:
    """The vector of a whole text."""
    if not _LETTERS:
        _LETTERS.append(letter_table())
    total = np.zeros(DIMENSIONS, np.int64)
    text = f" {text} "
    for at in range(0, max(1, len(text) - 2), step):  # two characters of overlap: each n-gram once
        c = np.frombuffer(text[at : at + step + 2].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where(c < 0x10000, _LETTERS[0][np.minimum(c, 0xFFFF)], c)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        three = two[:-1] * np.uint32(0x85EBCA77) + c[2:]
        shift = np.uint32(19)
        for h, keep in ((c[:-2] * np.uint32(0xC2B2AE3D), c[:-2] > 0), (two[:-1] * np.uint32(0x27D4EB2F), (c[:-2] > 0) | (c[1:-1] > 0)), (three * np.uint32(0x165667B1), (c[:-2] > 0) & (c[1:-1] > 0) | (c[1:-1] > 0) & (c[2:] > 0))):
            total += np.bincount((h >> shift)[keep], minlength=DIMENSIONS)
    x = np.sqrt(total.astype(np.float32))
    norm = float(np.sqrt(x @ x))
    return x / norm if norm else x


def size_class(x: np.ndarray) -> int:
    """The number of binary digits of the number of different features."""
    return int(np.count_nonzero(x)).bit_length()


class Model:
    """What was learnt: machines by family and by pair of languages, and the languages' mean vectors.

    centres: by language a multiple of its mean vector; machines: weights by (family, "") and by pair. For sides that no part held together
    the machine is the one that parts their mean vectors halfway."""

    def __init__(self, centres: dict[str, np.ndarray], machines: dict[tuple[str, str], np.ndarray]):
        self.langs = sorted(centres)
        self.families = sorted({family_of(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.centres = np.array([centres[v] / max(float(np.sqrt(centres[v] @ centres[v])), 1e-9) for v in self.langs], np.float32).reshape(-1, DIMENSIONS)
        self.floors = np.zeros(CLASSES)

        def between(own: list[str], other: list[str]) -> np.ndarray:
            a, b = (self.centres[[self.langs.index(v) for v in side]].mean(0).astype(np.float64) for side in (own, other))
            scale = 2 / max(float((a - b) @ (a - b)), 1e-9)
            return np.append(scale * (a - b), scale * float(b @ b - a @ a) / 2)

        rest = lambda f: [v for v in self.langs if family_of(v) != f]
        one = len(self.families) == 1
        self.first = np.array([machines[f, ""] if (f, "") in machines else between(self.members[f], rest(f)) for f in self.families if not one], np.float32)
        pairs = [ab for f in self.families for ab in itertools.combinations(self.members[f], 2)]
        self.pairs = {(a, b): (machines[a, b] if (a, b) in machines else between([a], [b])).astype(np.float32) for a, b in pairs}

    def nearness(self, x: np.ndarray) -> float:
        """The cosine to the nearest language's mean vector."""
        return float((self.centres @ x).max()) if self.langs else 0.0

    def calibrate(self, counts: dict[int, int], least: dict[int, float], overall: float, enough: int = 20, part: float = 0.75) -> None:
        """Floors by size class from labelled rows that did not teach: part of what 99 of 100 reach.

        counts and least: by size class the rows and what 99 of 100 reach; overall: what 99 of 100 of all reach.
        A class of too few rows has the next smaller one's; below the first class of enough rows a floor falls with the
        root of the number of features, as a cosine with few features does. Without enough rows in all nothing is rejected."""
        n = sum(counts.values())
        if n < enough:
            return
        upto = np.cumsum([counts.get(k, 0) for k in range(CLASSES)])
        middle = int(np.argmax(upto >= (n + 1) // 2))
        first = min((k for k in counts if counts[k] >= enough), default=middle)
        floor = part * overall
        for k in range(first, CLASSES):
            floor = self.floors[k] = part * least[k] if counts.get(k, 0) >= enough else floor
        self.floors[:first] = self.floors[first] * 0.5 ** (np.arange(first, 0, -1) / 2)

    def fits(self, x: np.ndarray) -> bool:
        return self.nearness(x) >= self.floors[size_class(x)]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return "und", 0.0
        x = np.append(x, np.float32(1))
        sure, f = 1.0, self.families[0]
        if len(self.families) > 1:
            margins = self.first @ x
            k = int(margins.argmax())
            f, sure = self.families[k], float(sigmoid(2 * (margins[k] - np.delete(margins, k).max())))
        names = self.members[f]
        if len(names) == 1:
            return names[0], sure
        votes = dict.fromkeys(names, 0.0)
        for a, b in itertools.combinations(names, 2):
            p = float(sigmoid(2 * float(self.pairs[a, b] @ x)))
            votes[a] += p
            votes[b] += 1 - p
        best = max(names, key=lambda v: (votes[v], v))
        return best, min(1.0, sure * votes[best] / (len(names) - 1))


def short(text: str) -> bytes:
    """A text's vector in half precision: the columns with values, then those."""
    x = features(text).astype(np.float16)
    at = np.flatnonzero(x).astype(np.uint16)
    return at.tobytes() + x[at].tobytes()


def learned(langs: list[str], vectors: list[bytes], times: list[int]) -> Iterator[tuple[str, str, str, np.ndarray]]:
    """What the rows of a part teach: kind, the two sides and whole numbers that add up over parts. times: how often a row repeats."""
    columns, values = [], []
    for v in vectors:
        half = len(v) // 4  # two bytes a column and two a value
        columns.append(np.append(np.frombuffer(v, np.uint16, half), DIMENSIONS).astype(np.int64))
        values.append(np.append(np.frombuffer(v, np.float16, half, 2 * half), 1).astype(np.float64))
    langs_at = np.array(langs, object)
    for lang in sorted(set(langs)):
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for i in np.flatnonzero(langs_at == lang):
            total[columns[i]] += times[i] * (values[i] * UNIT).astype(np.int64)
        yield "centre", lang, "", total
    whole = lambda w: np.rint(w * WEIGHT_UNIT).astype(np.int64)
    fam = np.array([family_of(v) for v in langs], object)
    families = sorted(set(fam.tolist()))
    if len(families) > 1:
        for f in families:
            yield "machine", f, "", whole(svm(columns, values, np.where(fam == f, 1.0, -1.0), DIMENSIONS + 1))
    for a, b in itertools.combinations(sorted(set(langs)), 2):
        if family_of(a) == family_of(b):
            own = np.flatnonzero((langs_at == a) | (langs_at == b))
            y = np.where(langs_at[own] == a, 1.0, -1.0)
            yield "machine", a, b, whole(svm([columns[i] for i in own], [values[i] for i in own], y, DIMENSIONS + 1))


def fit(docs: DataFrame, learn_from, rows_in_a_part: int = 3000, languages: int = 300) -> Model:
    """Learns from all rows of (doc_id, text, lang, has_letter) for which learn_from holds.

    rows_in_a_part: different rows on which a machine is fitted at once, in expectation. languages: the most frequent ones, which also
    bounds the pairs; a language beyond the bound is not learnt and so never predicted. A row that repeats with its id counts each time in the
    mean vectors and once for the machines, so that a part stays bounded."""
    usable = docs.filter(learn_from & F.col("lang").isNotNull() & F.col("has_letter"))
    sizes = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not sizes:
        return Model({}, {})
    parts = math.ceil(sum(r["count"] for r in sizes) / rows_in_a_part)
    rows = usable.filter(F.col("lang").isin([r["lang"] for r in sizes])).select(F.xxhash64("doc_id", "text").alias("h"), "lang", "text")

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([short(t.as_py()) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], ["part", "h", "lang", "x"])
        settle()

    kind = "part long, kind string, a string, b string, n long, w binary"

    def made(part: int, what: tuple[str, str, str, np.ndarray], n: int = 1) -> pa.RecordBatch:
        name, a, b, w = what
        row = [pa.array([part], pa.int64()), pa.array([name]), pa.array([a]), pa.array([b]), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, ["part", "kind", "a", "b", "n", "w"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come in the order of part, language and hash: equal rows are neighbours, and a part is all that is kept
        stream = (r for batch in batches for r in zip(*[column.to_pylist() for column in batch.columns]))
        for part, of in itertools.groupby(stream, lambda r: r[0]):
            langs, vectors, times = [], [], []
            for (lang, _, x), same in itertools.groupby(of, lambda r: (r[2], r[1], r[3])):
                langs.append(lang)
                vectors.append(x)
                times.append(sum(1 for _ in same))
            yield from (made(part, what) for what in learned(langs, vectors, times))
        settle()

    def add_up(group: pa.Table) -> pa.Table:
        total = np.zeros(DIMENSIONS + 1, np.int64)
        for w in group["w"]:
            total += np.frombuffer(w.as_py(), np.int64)
        name = tuple(group[c][0].as_py() for c in ("kind", "a", "b"))
        return pa.Table.from_batches([made(group["part"][0].as_py(), (*name, total), sum(group["n"].to_pylist()))])

    vectors = rows.select(F.pmod("h", F.lit(parts)).alias("part"), "h", "lang", "text").mapInArrow(shorten, "part long, h long, lang string, x binary")
    sums = vectors.repartition(min(parts, 2000), "part").sortWithinPartitions("part", "lang", "h").mapInArrow(learn, kind)
    while parts > 1:
        sums, parts = sums.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part", "kind", "a", "b").applyInArrow(add_up, kind), math.ceil(parts / FAN)
    told = [(r["kind"], r["a"], r["b"], r["n"], np.frombuffer(r["w"], np.int64)) for r in sums.collect()]  # a row for each language and machine
    centres = {a: w[:DIMENSIONS] / UNIT for name, a, _, _, w in told if name == "centre"}
    return Model(centres, {(a, b): w / (WEIGHT_UNIT * n) for name, a, b, n, w in told if name == "machine"})


def calibrated(model: Model, docs: DataFrame, learn_from) -> Model:
    """The model with its floors set from all labelled rows for which learn_from does not hold."""
    others = docs.filter(~learn_from & F.col("lang").isin(model.langs) & F.col("has_letter")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [features(t.as_py()) for t in batch.column(0)]
            made = [pa.array([size_class(x) for x in own], pa.int32()), pa.array([model.nearness(x) for x in own], pa.float64())]
            yield pa.RecordBatch.from_arrays(made, ["size", "near"])
        settle()

    near = cut(others.mapInArrow(run, "size int, near double"))  # two numbers a row, read a few times
    counts = {r["size"]: r["count"] for r in near.groupBy("size").count().collect()}
    both = near.select(F.explode(F.array("size", F.lit(-1))).alias("size"), "near")
    least = {r["size"]: r["q"][0] for r in exact_quantiles(both, "near", ["size"], [0.01]).collect()} if counts else {}
    model.calibrate(counts, least, least.get(-1, 0.0))
    return model


def identify(docs: DataFrame, learn_from, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: str = "", within: int | None = None, novelty: bool = False, **bounds) -> DataFrame:
    """doc_id, lang_pred, score for each row. learn_from: which rows may teach, as a Column over doc_id; carry: a column to keep beside; within:
    which of its fields is the text, if it is a struct that has it, so that a text goes to the workers once.

    With novelty, a row that no learned language fits gets `und` and score 0 as well."""
    more = [F.col(carry)] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), *more)
    rows = rows.withColumn("has_letter", F.col("text").rlike(r"\p{L}"))
    # models are a few vectors: of the languages learnt and their pairs, DIMENSIONS numbers each
    learnt = fit(rows, learn_from, **bounds)
    model = docs.sparkSession.sparkContext.broadcast(calibrated(learnt, rows, learn_from) if novelty and learnt.langs else learnt)

    def answer(text: str) -> tuple[str, float]:
        x = features(text)
        return model.value.predict(x) if not novelty or model.value.fits(x) else ("und", 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2) if within is None else batch.column(2).field(within)
            out = [answer(t.as_py()) if ok.as_py() else ("und", 0.0) for t, ok in zip(texts, batch.column(1))]
            made = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2 if within is not None else 3 :]], ["doc_id", "lang_pred", "score", *more_names])
        settle()

    more_names = [carry] if carry else []
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    if carry:
        schema = schema.add(docs.schema[carry])
    return rows.select("doc_id", "has_letter", *(["text"] if within is None else []), *more_names).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return fold(id_col, 4) == 2


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language was found, with all their columns; a text without letters, or that no learned language fits, goes.

    The row travels with its text through the same pass: no join, so null and repeated ids are no special case."""
    whole = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    found = identify(whole, ~held_out(), carry="_row", within=docs.columns.index("text"), novelty=True)
    return found.filter(F.col("lang_pred") != "und").select("_row.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), ~held_out())
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
