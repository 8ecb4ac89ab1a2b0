"""Ranked lexical search by hybrid TAAT-DAAT: short lists summed term by term, long lists walked document by document.

Texts are lower-cased (A-Z only) and cut into terms. One pass over the whole texts keeps, for each document, how many terms
it has and how often each term of the queries occurs; the texts are not read again, and these postings stay in the
partitions they were made in. Counts over all documents (N, L and each term's df) are map-side sums of that table.

Each task then searches its own documents, in segments of SEGMENT postings, for all queries. In a segment a term's list holds the
numbers of its documents and the points it gives each of them. For a query,
* short lists (at most 1 of SHORT documents) are taken term at a time: their points are summed into accumulators, which
  are sorted by document and from there on are one list like any other, with its own bound;
* long lists and the accumulators are taken document at a time, in runs of RUN documents. The lists are ordered by the most
  points that one of their documents has; those whose bounds together can't lift a document over the query's k-th best
  score only add to documents that other lists name. A run is skipped if the most points its lists give within it are too
  few; in a run, documents are dropped as soon as what they have and what the lists left can add is too little, and the
  lists left are looked up for the remaining documents only.
The k-th best score of a query goes from segment to segment; the accumulators' own k-th best sum is a lower bound before
the first document is looked at. A task returns at most k rows a query, of which the first k are taken at the end.

Documents of equal score rank by ascending id. A query's blocks of terms are broadcast, at most QUERY_BYTES at a time;
more queries mean more passes over the postings, not over the texts.

Defined cases: a null text has no terms and is in no result, nor does it count in N; a query without terms, or whose terms
occur nowhere, gives no rows; repeated query rows count once, and one id with two texts gives the results of each; documents that
repeat are documents of their own; a null document id ranks after all others of its score; other columns are ignored;
empty tables give an empty result. Scores are 64-bit integers; a product that would not fit is computed in Python's integers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import BROADCAST_BYTES, ascii_lower, cut, settle, table, text_of

#: A term, in the notation of Python and of RE2.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(TERM)
K = 10
#: A list is short if it names at most one in so many documents of a segment; postings of a segment; documents of a run.
SHORT, SEGMENT, RUN = 64, 1 << 21, 1 << 12
#: Bytes of queries that are searched at once.
QUERY_BYTES = 8 << 20


def queries_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, item_id, terms (distinct, sorted) of each distinct query row with a term; item numbers them by content."""
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(text_col)), F.lit(TERM), F.lit(0))))
    rows = items.select(F.col(id_col).alias("item_id"), text_of(text_col).alias("text")).distinct().select("item_id", F.xxhash64("item_id", "text").alias("item"), terms.alias("terms"))
    return rows.filter(F.size("terms") > 0)


def postings(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (terms of the whole text), term (numbers in vocabulary, ascending) and tf of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the caller

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(shared.value)}
        for batch in batches:
            ns, terms, tfs, ends = [], [], [], [0]
            for text in batch.column(0):
                found = TERMS.findall(text.as_py())
                held = sorted((number[t], c) for t, c in Counter(found).items() if t in number)
                ns.append(len(found))
                terms += [t for t, _ in held]
                tfs += [c for _, c in held]
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])
        settle()

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("term", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.LongType()))])
    return docs.select(ascii_lower(text_of(text_col)).alias("text"), F.col(id_col)).mapInArrow(run, schema)


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """The weight of terms that so many documents hold."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def length_terms(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The m of documents with so many terms: 100 - 90 + ((90 n N) div L)."""
    if len(n) and int(n.max()) * 90 * documents >= 1 << 63:
        return np.array([100 - 90 + 90 * int(x) * documents // total for x in n], np.int64)
    return 100 - 90 + 90 * n * documents // max(1, total)


class Best:
    """The k best (score, doc) of a query; documents come in ascending order, so of equal scores the first stays."""

    def __init__(self, k: int):
        self.k, self.score, self.doc = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int:
        """What a later document must exceed."""
        return int(self.score[-1]) if len(self.score) == self.k else 0

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        over = score > self.least()
        score, doc = np.append(self.score, score[over]), np.append(self.doc, doc[over])
        first = np.lexsort((doc, -score))[: self.k]
        self.score, self.doc = score[first], doc[first]


class Segment:
    """Inverted lists of a run of documents: docs (numbers ascending) and points of each term."""

    def __init__(self, n: np.ndarray, count: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, total: int):
        self.size = len(n)
        m = np.repeat(length_terms(n, documents, total), count)
        doc = np.repeat(np.arange(self.size), count)
        order = np.argsort(term, kind="stable")
        self.doc, term, tf, m = doc[order], term[order], tf[order], m[order]
        self.points = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        self.begin = np.searchsorted(term, np.arange(len(weight) + 1))
        self.runs = -(-self.size // RUN)

    def lists(self, terms: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """The short and the long lists of terms."""
        short, long = [], []
        for t in terms.tolist():
            a, z = self.begin[t], self.begin[t + 1]
            if a < z:
                (short if (z - a) * SHORT <= self.size else long).append((self.doc[a:z], self.points[a:z]))
        return short, long

    def accumulators(self, short: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the documents that short lists name, ascending, and their sums."""
        named, at = np.unique(np.concatenate([d for d, _ in short]), return_inverse=True)
        sums, begin = np.zeros(len(named), np.int64), 0
        for d, p in short:
            sums[at[begin : begin + len(d)]] += p  # a list names a document once
            begin += len(d)
        return named, sums

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Adds the documents of this segment to best."""
        short, lists = self.lists(terms)
        floor = best.least()
        if short:
            held = self.accumulators(short)
            if len(held[1]) >= best.k:  # as many documents have these points at least; equal ones may still win
                floor = max(floor, int(np.partition(held[1], -best.k)[-best.k]) - 1)
            lists.append(held)
        if not lists:
            return
        lists.sort(key=lambda x: int(x[1].max()))
        cuts = [np.searchsorted(d, np.arange(self.runs + 1) * RUN) for d, _ in lists]
        for run in range(self.runs):
            floor = max(floor, best.least())
            spans = [(c[run], c[run + 1]) for c in cuts]
            most = np.array([int(p[a:z].max()) if a < z else 0 for (_, p), (a, z) in zip(lists, spans)])
            upto = np.cumsum(most)
            if upto[-1] <= floor:
                continue
            leads = int(np.searchsorted(upto, floor, side="right"))  # lists before this one can't lift a document alone
            sums = np.zeros(RUN, np.int64)
            for (d, p), (a, z) in zip(lists[leads:], spans[leads:]):
                sums[d[a:z] - run * RUN] += p[a:z]
            doc = np.flatnonzero(sums)
            score = sums[doc]
            for k in range(leads - 1, -1, -1):
                alive = score + upto[k] > floor
                doc, score = doc[alive], score[alive]
                (d, p), (a, z) = lists[k], spans[k]
                if a < z and len(doc):
                    at = np.minimum(np.searchsorted(d[a:z], doc + run * RUN), z - a - 1) + a
                    score = score + np.where(d[at] == doc + run * RUN, p[at], 0)
            over = score > floor
            if over.any():
                best.add(score[over], doc[over] + run * RUN)


def searched(held: DataFrame, items: list[tuple[int, list[int]]], weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: each task's k best documents of each query. held: postings."""
    shared = held.sparkSession.sparkContext.broadcast((items, weight))  # a block of queries, and a number a term

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, given = shared.value
        asked = [(item, np.array(terms, np.int64)) for item, terms in asked]
        tops: list[pa.RecordBatch] = []  # at most k rows a query
        bests = {item: Best(k) for item, _ in asked}
        ids: dict[int, list] = {item: [] for item, _ in asked}

        def segment(some: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(some).combine_chunks()
            t = t.take(pc.sort_indices(t, [("doc_id", "ascending")], null_placement="at_end"))
            flat = lambda c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            count = pc.list_value_length(t.column("term")).to_numpy()
            here = Segment(t.column("n").to_numpy(), count, flat("term"), flat("tf"), given, documents, total)
            doc_ids = t.column("doc_id")
            for item, terms in asked:
                own, before = Best(k), bests[item]
                # documents of an earlier segment may have greater ids, so equal scores are looked at too
                own.score, own.doc = np.full(k, before.least() - 1, np.int64) if before.least() else own.score, np.full(k, -1) if before.least() else own.doc
                here.search(terms, own)
                new = own.doc >= 0
                if new.any():
                    rows = [*ids[item], *doc_ids.take(pa.array(own.doc[new])).to_pylist()]
                    score = np.append(before.score, own.score[new])
                    order = sorted(range(len(rows)), key=lambda i: (-score[i], rows[i] is None, rows[i] or 0))[:k]
                    ids[item] = [rows[i] for i in order]
                    before.score = score[order]

        some, size = [], 0
        for batch in batches:
            some.append(batch)
            size += batch.num_rows + len(batch.column(2).flatten())
            if size >= SEGMENT:
                segment(some)
                some, size = [], 0
        if size:
            segment(some)
        for item, _ in asked:
            if ids[item]:
                n = len(ids[item])
                tops.append(pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(ids[item], kind), pa.array(bests[item].score)], ["item", "doc_id", "score"]))
        yield from tops
        settle()

    kind = pa.int64() if isinstance(held.schema["doc_id"].dataType, T.LongType) else None
    schema = T.StructType([T.StructField("item", T.LongType()), held.schema["doc_id"], T.StructField("score", T.LongType())])
    return held.mapInArrow(run, schema)


def blocks(asked: DataFrame, size: int = QUERY_BYTES) -> Iterator[DataFrame]:
    """The queries in blocks of about so many bytes, dealt by hash."""
    whole = asked.agg(F.sum(F.size("terms") * 8 + 16)).first()[0] or 0
    n = max(1, -(-whole // size))
    for b in range(n):
        yield asked.filter(F.pmod("item", F.lit(n)) == b)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query row of items (item_id, text)."""
    asked = cut(queries_of(items))
    terms = asked.select(F.explode("terms").alias("word")).distinct()
    size = terms.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        raise ValueError(f"the queries' terms take {size} bytes, more than {BROADCAST_BYTES}; search parts of the queries")
    vocabulary = sorted(r[0] for r in terms.collect())
    number = {t: n for n, t in enumerate(vocabulary)}
    held = cut(postings(docs, vocabulary, id_col, text_col))
    documents, total = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in held.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row a query term
        df[term] = n
    tops = None
    for block in blocks(asked):
        some = [(r.item, [number[t] for t in r.terms]) for r in block.select("item", "terms").collect()]
        found = searched(held, some, weights(df, documents), documents, total, k)
        tops = found if tops is None else tops.union(found)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = tops.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return first.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op11_lexical": rf"""
        WITH words AS MATERIALIZED (
            SELECT rid, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
            FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)),
        asked AS MATERIALIZED (
            SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term
            FROM benchmark),
        sizes AS (SELECT rid, count(*) AS n FROM words GROUP BY rid),
        whole AS (SELECT count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_terms FROM sizes),
        counts AS (SELECT rid, doc_id, term, count(*) AS tf FROM words GROUP BY rid, doc_id, term),
        dfs AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
        points AS (
            SELECT item_id, text, rid, doc_id,
                   floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS point
            FROM asked JOIN counts USING (term) JOIN dfs USING (term) JOIN sizes USING (rid), whole),
        scores AS (SELECT item_id, text, rid, doc_id, sum(point)::BIGINT AS score FROM points GROUP BY item_id, text, rid, doc_id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= {K}"""
}
