"""Toxicity by a counterfactual-regularised classifier.

Labelled rows teach a sparse word model: every word's document counts by label come from a grouped aggregation over
labelled rows, and the words and word beginnings whose counts differ from chance by enough standard deviations (least_z)
become the model's vocabulary, at most max_words of them, with all terms that may be swapped. A logistic regression over
their presence is fitted. Both take a sample of the labelled rows of bounded size (rows of training_rows and of fit),
picked by hashes of the id with seeds of their own.

Terms that may be swapped for each other are the parameter swaps. By default they are the names of groups in IDENTITY,
and those that the labelled rows themselves show: words that both labels have (least_mentions documents of each) and
that stand mostly in documents that are not toxic, each with the others that fill the same places, counted by the
words before and behind (max_terms terms, PARTNERS others for each). For each sampled sentence with a term, the same
sentence with the term swapped is its counterfactual; the squared change of the score's logit, averaged over all these
pairs, is penalised (pull), so a neutral mention moves a score little. Equal changes of the model's words are summed up
before they leave the tasks. A fit on two labels that finds no pair warns. The model is a few thousand numbers; scoring a text is
one look-up for each of its distinct words.

Defined cases: a null or empty text gets the score of a text without any model word; with no labels, or labels of one
kind only, each score is the labels' share (0 without any). A document labelled more than once is toxic if any label
says so; a null label or id doesn't teach. Long texts are read whole; repeated rows get a result each; other columns
are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, fold, table, text_of, unit_hash
from tidemark.llm.linear import logistic, sigmoid

#: Identity terms that may be swapped for each other, by language (fixed values).
IDENTITY = {
    "en": ["asian", "black", "christian", "disabled", "female", "gay", "immigrant", "jewish", "lesbian", "male", "muslim", "transgender", "white", "women", "men"],
    "de": ["behinderte", "christen", "einwanderer", "frauen", "homosexuelle", "juden", "männer", "muslime", "schwarze", "weiße"],
    "fr": ["arabes", "blancs", "chrétiens", "femmes", "handicapés", "hommes", "homosexuels", "immigrés", "juifs", "musulmans", "noirs"],
    "es": ["blancos", "cristianos", "discapacitados", "hombres", "homosexuales", "inmigrantes", "judíos", "mujeres", "musulmanes", "negros"],
}
SWAPS = {term: [t for t in terms if t != term] for terms in IDENTITY.values() for term in terms}

#: Others that a term found in the rows is swapped for, and places that two terms must share.
PARTNERS, SHARED_PLACES = 6, 2

WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?\n]+")
#: The regression's sample is picked by another hash than the rows that may teach.
FIT_SEED = 7

#: Lengths of the word beginnings that count beside whole words, as compounds and endings share them.
STEMS = (4, 5, 6, 7)


def words_of(text: str) -> set[str]:
    """The distinct lower-cased words of a whole text, and their beginnings (with a star)."""
    words = set(WORD.findall(text.lower()))
    return words.union(*({w[:k] + "*" for w in words if len(w) > k} for k in STEMS))


class Model:
    """Weights of words, and what they were fitted with: the terms that were swapped and how many pairs that made."""

    def __init__(self, weights: dict[str, float], bias: float, swaps: dict[str, list[str]] | None = None, pairs: int = 0):
        self.weights, self.bias, self.words = weights, bias, frozenset(weights)
        self.swaps, self.pairs = swaps or {}, pairs

    def score(self, text: str) -> float:
        return float(sigmoid(self.bias + sum(self.weights[w] for w in sorted(words_of(text) & self.words))))


def word_counts(labelled: DataFrame) -> tuple[DataFrame, float]:
    """word, n, t, z of the words in four or more rows: rows, toxic rows, deviations from chance; and the share of toxic rows."""
    totals = labelled.groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).first()
    n, toxic = totals["n"], totals["t"] or 0
    share = toxic / n if n else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [(w, y) for text, y in zip(pdf.text, pdf.toxic) for w in words_of(text)]
            if pairs:
                yield pd.DataFrame(pairs, columns=["word", "toxic"]).groupby("word").toxic.agg(["size", "sum"]).reset_index()

    counted = (
        labelled.select("text", "toxic")
        .mapInPandas(run, "word string, size long, sum long")
        .groupBy("word")
        .agg(F.sum("size").alias("n"), F.sum("sum").alias("t"))
        .filter(F.col("n") >= 4)
        .withColumn("z", (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share)))
    )
    return counted, share


def exchangeable(labelled: DataFrame, counted: DataFrame, max_terms: int, least_mentions: int) -> dict[str, list[str]]:
    """Terms of the labelled rows and, for each, those that stand in the same places: between the same two words."""
    both = (F.col("t") >= least_mentions) & (F.col("n") - F.col("t") >= least_mentions) & (2 * F.col("t") <= F.col("n"))
    # the terms that pull a score most, if they are let
    ranked = counted.filter(both & ~F.col("word").endswith("*")).orderBy(F.desc(F.abs("z")), "word").limit(max_terms)
    terms = sorted(r["word"] for r in ranked.select("word").collect())
    number = {w: i for i, w in enumerate(terms)}

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = set()
            for text in pdf.text:
                for sentence in SENTENCE.split(text.lower()):
                    w = ["", *WORD.findall(sentence), ""]
                    found.update((w[i - 1], w[i + 1], number[w[i]]) for i in range(1, len(w) - 1) if w[i] in number)
            yield pd.DataFrame(sorted(found), columns=["left", "right", "term"])

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(terms), len(terms)), np.int64)
        for pdf in batches:
            for own in pdf.terms:
                seen[np.ix_(own, own)] += 1
        a, b = np.nonzero(np.triu(seen, 1))
        yield pd.DataFrame({"a": a, "b": b, "n": seen[a, b]})

    if len(terms) < 2:
        return {}
    filled = labelled.select("text").mapInPandas(places, "left string, right string, term int")
    filled = filled.groupBy("left", "right").agg(F.collect_set("term").alias("terms")).filter(F.size("terms") > 1)  # max_terms at most
    counts = filled.select("terms").mapInPandas(together, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    others: dict[int, list[tuple[int, int]]] = {}
    for a, b, n in counts.filter(F.col("n") >= SHARED_PLACES).collect():  # max_terms squared at most
        others.setdefault(a, []).append((-n, b))
        others.setdefault(b, []).append((-n, a))
    return {terms[a]: [terms[b] for _, b in sorted(found)[:PARTNERS]] for a, found in sorted(others.items())}


def counterfactuals(text: str, vocabulary: dict[str, int], swaps: dict[str, list[str]] = SWAPS) -> Iterator[tuple[tuple[int, ...], tuple[int, ...]]]:
    """For each sentence of a text, term in it and other: the model words that go when the term is swapped, and that come."""
    features = lambda w: [vocabulary[x] for x in words_of(w) if x in vocabulary]
    for sentence in SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        terms = sorted(swaps.keys() & set(words))
        if not terms:
            continue
        present = Counter(i for w in words for i in features(w))
        for term in terms:
            rest = present - Counter({i: words.count(term) for i in features(term)})
            for other in swaps[term]:
                after = rest.keys() | set(features(other))
                yield tuple(sorted(present.keys() - after)), tuple(sorted(after - present.keys()))


def rows_of(sets: list[set[int]], width: int) -> np.ndarray:
    x = np.zeros((len(sets), width))
    for i, s in enumerate(sets):
        x[i, sorted(s)] = 1.0
    return x


def fit(
    labelled: DataFrame, least_z: float = 5.0, max_words: int = 3000, pull: float = 1.0, rows: int = 8000,
    swaps: dict[str, list[str]] | None = None, max_terms: int = 200, least_mentions: int = 10,
) -> Model:
    """labelled: doc_id, text, toxic. The bounds: words of the model, rows that the regression takes, terms found in the rows."""
    counted, share = word_counts(labelled)
    if not 0 < share < 1:
        return Model({}, 35.0 if share else -35.0)
    counted = cut(counted)
    telling = counted.filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(max_words)
    words = [r["word"] for r in telling.select("word").collect()]
    if not words:
        return Model({}, float(np.log(share / (1 - share))))
    if swaps is None:
        swaps = SWAPS | exchangeable(labelled, counted, max_terms, least_mentions)
    vocabulary = {w: i for i, w in enumerate(sorted({*words, *swaps, *(o for others in swaps.values() for o in others)}))}
    n = labelled.count()
    picked = cut(labelled.filter(unit_hash("doc_id", FIT_SEED) < rows / n).select("doc_id", "text", "toxic"))

    def own_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [sorted(vocabulary[w] for w in words_of(t) if w in vocabulary) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype(str), "toxic": pdf.toxic, "own": own})

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf.text:
                seen.update(counterfactuals(text, vocabulary, swaps))
        yield pd.DataFrame([(list(a), list(b), n) for (a, b), n in seen.items() if a or b], columns=["gone", "come", "n"])

    sample = picked.mapInPandas(own_words, "doc_id string, toxic int, own array<int>").toPandas().sort_values(["doc_id", "toxic"])
    pairs = picked.select("text").mapInPandas(changes, "gone array<int>, come array<int>, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))
    found = pairs.toPandas().sort_values("n", kind="stable")  # at most what max_terms, PARTNERS and the words' beginnings can make
    if not len(found):
        warnings.warn("no labelled sentence has a term to swap: the classifier is not regularised")
    x = rows_of([set(s) for s in sample.own], len(vocabulary))
    w, b = logistic(x, sample.toxic.to_numpy(float), l2=1e-4, changes=list(zip(found.gone, found.come, found.n)), pull=pull)
    return Model({t: float(w[i]) for t, i in vocabulary.items() if w[i]}, b, swaps, int(found.n.sum()))


def report(docs: DataFrame, labels: DataFrame, model: Model, rows: Column) -> DataFrame:
    """One row: over the labelled documents that rows picks, pairs (sentences with a term, and with it swapped), mean_gap
    (of their scores), clean documents that mention a term and that don't, and the share of each that is called toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    swaps = model.swaps

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = shared.value.score
        for pdf in batches:
            out = []
            for text, toxic in zip(pdf.text, pdf.toxic):
                n, gap = 0, 0.0
                for sentence in SENTENCE.split(text.lower()):
                    for term in sorted(swaps.keys() & set(WORD.findall(sentence))):
                        for other in swaps[term]:
                            n, gap = n + 1, gap + abs(score(sentence) - score(re.sub(rf"\b{term}\b", other, sentence)))
                out.append((n, gap, bool(swaps.keys() & set(WORD.findall(text.lower()))), toxic, score(text) >= 0.5))
            yield pd.DataFrame(out, columns=["pairs", "gap", "mentions", "toxic", "called"])

    told = training_rows(docs, labels, rows).select("text", "toxic").mapInPandas(run, "pairs long, gap double, mentions boolean, toxic int, called boolean")
    clean = F.col("toxic") == 0
    return told.agg(
        F.sum("pairs").alias("pairs"), (F.sum("gap") / F.sum("pairs")).alias("mean_gap"),
        F.count_if(clean & F.col("mentions")).alias("mentioning"), F.avg(F.when(clean & F.col("mentions"), F.col("called").cast("int"))).alias("called_mentioning"),
        F.count_if(clean & ~F.col("mentions")).alias("others"), F.avg(F.when(clean & ~F.col("mentions"), F.col("called").cast("int"))).alias("called_others"),
    )


def training_rows(docs: DataFrame, labels: DataFrame, learn_from: Column, rows: int = 20_000) -> DataFrame:
    """doc_id, text, toxic of a sample of about rows of the documents that may teach, written to the checkpoint folder.

    The sampled ids are bounded, so they are broadcast and only the sample's texts are shuffled. A row that repeats teaches once."""
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(learn_from)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = marked.filter(unit_hash("doc_id") < rows / max(1, marked.count()))
    return cut(docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id", "text"]))


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_words and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([shared.value.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return fold(id_col, 5) == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(training_rows(docs, labels, ~held_out()))
    return score_texts(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
