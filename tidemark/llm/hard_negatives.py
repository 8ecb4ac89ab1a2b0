"""Hard-negative mining with a GNAT-style multiway hyperplane tree over all vectors.

Components become whole numbers floor(256 x), scores are inner products. To speak of distances, each vector gets one more
component sqrt(M - |x|^2), M being the largest square of all; anchors get 0 there. Then |a - x|^2 = |a|^2 + M - 2 score, so a
window of scores is an annulus around the anchor, and near means a high score.

The tree: a node has up to FAN split points, chosen far apart from each other among a sample of at most SAMPLE vectors, and
each vector belongs to the child of its nearest split point (the hyperplanes between split points bound the children).
Every vector of the table is led down to a leaf, and for each node, split point i and child j the least and the greatest distance from
point i to any vector of subtree j are kept: FAN x FAN ranges a node, taken over all vectors, not over the sample.

A search takes a block of anchors with a window of scores each. At a node, the distance from an anchor to split point i and
the range of (i, j) bound the anchor's distance to all of subtree j from both sides; where these bounds don't meet
the annulus for one i, subtree j is dropped for that anchor. The annulus shrinks as results come in: its outer radius is the
k-th best so far, at first the k-th best within SEEDS sampled vectors. Leaves that remain are compared exactly, so the result is exact
(recall 1), whatever the sample was.

The vectors lie in the shared folder in the order of their leaves (range-partitioned by leaf and id, so a leaf with a third
of all rows lies in many parts), as all searches read them: first each anchor's positives, then the
windows that they give. Anchors and windows are broadcast, at most ANCHORS at a time; each task returns k rows a window at most.

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; vectors of different
lengths count as padded with zeros. Rows with one id aren't others to each other; an anchor's repeated rows count once,
other repeated rows are rows of their own; a null id ranks last and is no anchor. An anchor without positives, or
without rows in its windows, gives no rows. Other columns are ignored; an empty table gives an empty result. Scores are
exact as long as they fit 64-bit integers: in doubles while these are exact, in integers otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, settle, table

POSITIVES, NEGATIVES = 5, 10
#: The window of a positive with score p: LOW p <= 100 score <= HIGH p.
LOW, HIGH = 30, 90
#: Children of a node; sample vectors of a leaf at most; vectors the tree is fitted on.
FAN, LEAF, SAMPLE = 12, 64, 20_000
#: Anchors searched at once; vectors that are compared at once; sampled vectors that give the first radii.
ANCHORS, TOGETHER, SEEDS = 4096, 8192, 4096
#: Relative slack of distances against rounding; a null id, which ranks last.
SLACK, NO_ID = 1e-9, np.iinfo(np.int64).max


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | str = "label") -> DataFrame:
    """vec_id, label, v (floor(256 x)) of the rows that take part."""
    label = F.col(label) if isinstance(label, str) else label
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    sound = F.col("label").isNotNull() & F.col("x").isNotNull() & finite
    return whole.filter(sound).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


@dataclass
class Node:
    """Split points (rows of Tree.points), the children's numbers (a leaf: -1 - leaf), and ranges[i, j]."""

    first: int
    children: list[int]
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Tree:
    """nodes[0] is the root; points: split points with their extra component; most: the largest square of any vector."""

    nodes: list[Node]
    points: np.ndarray
    leaves: int
    most: float


def lifted(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all of one length."""
    return np.column_stack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))])


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0))


def far_points(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Numbers of up to k distinct rows of x far from each other, among eight times as many candidates."""
    pick = np.random.default_rng(seed).permutation(len(x))[: 8 * k]
    near = np.full(len(pick), np.inf)
    out = [0]
    for _ in range(k - 1):
        near = np.minimum(near, apart(x[pick[out[-1:]]], x[pick])[0])
        if near.max() <= 1e-6:
            break
        out.append(int(near.argmax()))
    return pick[out]


def fit(sample: np.ndarray, most: float, fan: int = FAN, leaf: int = LEAF) -> Tree:
    """The tree of a bounded sample; ranges are still empty."""
    x = lifted(sample, most)
    nodes, points, leaves = [], [], 0
    waiting = [(None, 0, np.arange(len(x)))]  # (parent, place among its children, rows)
    while waiting:
        parent, at, rows = waiting.pop()
        split = far_points(x[rows], fan, len(nodes)) if len(rows) > leaf or (parent is None and len(rows)) else []
        if len(split) < 2 and parent is not None:
            nodes[parent].children[at] = -1 - leaves
            leaves += 1
            continue
        me = len(nodes)
        nodes.append(Node(sum(map(len, points)), [0] * max(1, len(split))))
        points.append(x[rows[split]] if len(split) else np.zeros((1, x.shape[1])))
        if parent is not None:
            nodes[parent].children[at] = me
        nearest = apart(x[rows], points[-1]).argmin(1) if len(rows) else np.zeros(0, int)
        for j in range(len(nodes[me].children)):
            waiting.append((me, j, rows[nearest == j]))
    return Tree(nodes, np.concatenate(points), leaves, most)


def led(tree: Tree, v: np.ndarray, seen: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The leaf of each vector; seen gathers each node's least and greatest distances."""
    x, out = lifted(v, tree.most), np.zeros(len(v), np.int64)
    waiting = [(0, np.arange(len(v)))]
    while waiting:
        n, rows = waiting.pop()
        node = tree.nodes[n]
        k = len(node.children)
        far = apart(x[rows], tree.points[node.first : node.first + k])
        nearest = far.argmin(1)
        low, high = seen.setdefault(n, (np.full((k, k), np.inf), np.full((k, k), -np.inf)))
        for j, child in enumerate(node.children):
            mine = nearest == j
            if mine.any():
                low[:, j] = np.minimum(low[:, j], far[mine].min(0))
                high[:, j] = np.maximum(high[:, j], far[mine].max(0))
                if child < 0:
                    out[rows[mine]] = -1 - child
                else:
                    waiting.append((child, rows[mine]))
    return out


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of one array, padded with zeros."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a with all of b, exactly."""
    most = (int(np.abs(a).max(initial=0)) or 1) * (int(np.abs(b).max(initial=0)) or 1) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if most < 1 << 53 else a @ b.T


@dataclass
class Windows:
    """For each row: an anchor (number in a block), scores from low to high, and whether labels must be the anchor's own."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class Search:
    """The k best rows of each window among the vectors of a task."""

    def __init__(self, tree: Tree, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: Windows, floor: np.ndarray):
        self.tree, self.ids, self.labels, self.v, self.w = tree, ids, labels, v, windows
        self.squares = (v * v).sum(1).astype(float)
        self.floor = np.maximum(windows.low, floor)  # no lower score is wanted
        # (window, score, id) of what was found, the best first
        self.found = [np.zeros(0, np.int64)] * 3
        x = np.column_stack([v, np.zeros(len(v))]).astype(float)
        self.far = apart(x, tree.points)  # of each anchor to each split point
        self.fresh = 0

    def radii(self) -> tuple[np.ndarray, np.ndarray]:
        """The annulus of each window; an upper one below the lower holds nothing."""
        whole = self.squares[self.w.anchor] + self.tree.most
        inner, outer = (np.sqrt(np.maximum(whole - 2.0 * s, 0)) for s in (self.w.high, self.floor))
        slack = SLACK * np.sqrt(whole) + 1e-6
        return np.where(self.floor > self.w.high, np.inf, inner - slack), outer + slack

    def leaves(self, wanted: set[int]) -> dict[int, np.ndarray]:
        """The windows that may have rows in each of the wanted leaves."""
        inner, outer = self.radii()
        out, waiting = {}, [(0, np.flatnonzero(inner < np.inf))]
        while waiting:
            n, on = waiting.pop()
            node = self.tree.nodes[n]
            k = len(node.children)
            far = self.far[self.w.anchor[on]][:, node.first : node.first + k]
            for j, child in enumerate(node.children):
                least = np.maximum(far - node.high[:, j], node.low[:, j] - far).max(1)
                most = (far + node.high[:, j]).min(1)
                left = on[(least <= outer[on]) & (most >= inner[on])]
                if len(left):
                    if child >= 0:
                        waiting.append((child, left))
                    elif -1 - child in wanted:
                        out[-1 - child] = left
        return out

    def compare(self, on: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        """All windows in on with all vectors of a leaf."""
        anchors, at = np.unique(self.w.anchor[on], return_inverse=True)
        scores = products(self.v[anchors], v)
        alike = (self.labels[anchors][:, None] == labels[None, :]) == self.w.same
        alike &= self.ids[anchors][:, None] != ids[None, :]
        scores, alike = scores[at], alike[at]
        hit, row = np.nonzero(alike & (scores >= self.floor[on][:, None]) & (scores <= self.w.high[on][:, None]))
        self.found = [np.append(f, x) for f, x in zip(self.found, (on[hit], scores[hit, row], ids[row]))]
        self.fresh += len(hit)
        if self.fresh > 1 << 18:
            self.best()

    def best(self) -> list[np.ndarray]:
        """Cuts what was found to the k best of each window, and raises the floors."""
        w, score, ids = self.found
        order = np.lexsort((ids, -score, w))
        w, score, ids = w[order], score[order], ids[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        keep = nth < self.w.k
        last = nth == self.w.k - 1
        self.floor[w[last]] = np.maximum(self.floor[w[last]], score[last])
        self.found = [w[keep], score[keep], ids[keep]]
        self.fresh = 0
        return self.found


def fetched(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bounded table's ids, labels and vectors."""
    t = rows.select("vec_id", "label", "v").toArrow().combine_chunks()
    column = lambda c: t.column(c).combine_chunks() if t.num_rows else pa.array([], t.schema.field(c).type)
    return column("vec_id").fill_null(NO_ID).to_numpy(), column("label").to_numpy(), matrix(column("v"), width)


class Index:
    """All vectors in the order of their leaves, and the tree over them."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE):
        self.rows = cut(rows)
        norm = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        count, width, most = self.rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(norm)).first()
        self.width, most = width or 0, most or 0.0
        share = F.lit(min(1.0, 1.2 * sample / max(1, count)))  # by a hash, so about as many; never more than the bound
        dealt = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        self.sample = fetched(self.rows.filter(dealt < share).limit(sample), self.width)
        self.tree = fit(self.sample[2].astype(float), most)
        self.placed = self.place()

    def place(self) -> DataFrame:
        tree, width = self.tree, self.width
        shared = self.rows.sparkSession.sparkContext.broadcast(tree)  # SAMPLE vectors at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = led(shared.value, matrix(batch.column(2), width).astype(float), {})
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "label", "v", "leaf"])

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                led(shared.value, matrix(batch.column(2), width).astype(float), seen)
            for n, (low, high) in seen.items():
                k = len(low)
                i, j = np.divmod(np.arange(k * k), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k * k, n)), pa.array(i), pa.array(j), pa.array(low.ravel()), pa.array(high.ravel())], ["node", "i", "j", "low", "high"])

        rows = self.rows.select("vec_id", "label", "v").mapInArrow(run, "vec_id long, label long, v array<long>, leaf long")
        placed = cut(rows.repartitionByRange("leaf", "vec_id").sortWithinPartitions("leaf"))
        found = placed.select("vec_id", "label", "v").mapInArrow(ranges, "node long, i long, j long, low double, high double")
        for node in tree.nodes:
            node.low, node.high = np.full((len(node.children),) * 2, np.inf), np.full((len(node.children),) * 2, -np.inf)
        for n, i, j, low, high in found.groupBy("node", "i", "j").agg(F.min("low"), F.max("high")).collect():  # of bounded size: the tree's
            tree.nodes[n].low[i, j], tree.nodes[n].high[i, j] = low, high
        return placed

    def floors(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: Windows) -> np.ndarray:
        """For each window the k-th best score within SEEDS sampled vectors, or its lower end: the whole table has no lower one.

        A sampled row may be an anchor's other row only if its id is another, as in the table."""
        search = Search(self.tree, ids, labels, v, windows, windows.low)
        for at in range(0, len(windows.anchor), 512):
            on = np.arange(at, min(at + 512, len(windows.anchor)))
            search.compare(on, *(x[:SEEDS] for x in self.sample))
        search.best()
        return search.floor

    def search(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: Windows) -> DataFrame:
        """w (number of the window), score, id: the k best rows of each window and task."""
        width = self.width
        floor = self.floors(ids, labels, v, windows)
        shared = self.rows.sparkSession.sparkContext.broadcast((self.tree, ids, labels, v, windows, floor))  # ANCHORS at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(*shared.value[:5], shared.value[5].copy())
            for batch in batches:
                leaf = batch.column(3).to_numpy()
                other = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2), width)
                open_ = search.leaves(set(leaf.tolist()))
                for which, on in open_.items():
                    mine = np.flatnonzero(leaf == which)
                    for low in range(0, len(mine), TOGETHER):
                        for at in range(0, len(on), 512):
                            search.compare(on[at : at + 512], *(x[mine[low : low + TOGETHER]] for x in other))
                search.best()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in search.best()], ["w", "score", "id"])
            settle()

        return self.placed.select("vec_id", "label", "v", "leaf").mapInArrow(run, "w long, score long, id long")


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each window over all tasks, with their rank."""
    best = Window.partitionBy("w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mined(rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the anchors of rows (vec_id, label, v)."""
    index = Index(rows, sample)
    asked = cut(index.rows.filter(F.col("vec_id") % every == 0).distinct())
    blocks = max(1, -(-asked.count() // ANCHORS))
    out = None
    for b in range(blocks):
        block = fetched(asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b), index.width)
        n = len(block[0])
        nowhere = np.full(n, np.iinfo(np.int64).min // 4)
        near = first(index.search(*block, Windows(np.arange(n), nowhere, -nowhere, True, positives)), positives)
        near = near.sort("w", "rank").toArrow()  # positives rows an anchor of the block
        w, score, other = (near.column(c).to_numpy() for c in ("w", "score", "id"))
        # LOW p <= 100 score <= HIGH p, in whole numbers; a negative p has no such score
        windows = Windows(w, -(-low * score // 100), high * score // 100, False, negatives)
        found = first(index.search(*block, windows), negatives)
        given = pa.table({"w": np.arange(len(w)), "anchor_id": block[0][w], "positive_id": other, "positive_score": score})
        given = rows.sparkSession.createDataFrame(given)
        real = lambda c: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(c if c != "id" else "negative_id")
        part = found.join(F.broadcast(given), "w").select("anchor_id", real("positive_id"), F.col("rank"), real("id"), "positive_score", F.col("score").alias("negative_score"))
        out = part if out is None else out.union(part)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors(table(spark, sf_dir, "embeddings"), label=relabel))


SQL = {
    "op12_hard_negatives": f"""
        WITH sound AS (
            SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND list_bool_and(list_transform(embedding, lambda c: coalesce(isfinite(c), false))) IS NOT FALSE),
        anchors AS (SELECT DISTINCT vec_id, label, v FROM sound WHERE vec_id % 100 = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label = s.label AS alike, s.vec_id, s.rid, list_inner_product(a.v, s.v)::BIGINT AS score
            FROM anchors a JOIN sound s ON s.vec_id IS DISTINCT FROM a.vec_id),
        positives AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
        windows AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.anchor_id, p.rid ORDER BY n.score DESC, n.vec_id) AS rank
            FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike
             AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
        SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM windows WHERE rank <= {NEGATIVES}"""
}
