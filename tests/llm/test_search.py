"""Lexical search, hard negatives and sharding against brute-force versions, and against their SQL."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives, lexical, sharding
from tidemark.llm.queries import QUERIES, SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_lexical", "op12_hard_negatives", "op13_sharding"])
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf_dir, name, size):
    folder = sf_dir.replace("sf0.001", size)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.execute(SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want.fetchall())


# lexical search


def ranked_brute(docs, items, k=10):
    cut = lambda t: re.findall(lexical.TERM, (t or "").translate(LOWER))
    found = [(r[0], Counter(cut(r[1]))) for r in docs]
    n_docs, total = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, c in found:
            n = sum(c.values())
            score = 0
            for t in set(cut(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total)))
            if score:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -s) for rank, (s, missing, doc) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def test_lexical_equals_brute_force(spark, rows, clashing):
    items = [(0, rows[0][1]), (1, rows[3][1][:80]), (2, "A ß 日本語 zzz"), (3, None), (4, "!!!"), (5, "nowhereatall"), (1, rows[2][1][:40]), (0, rows[0][1]), (None, "th er on")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"rank": F.lit(1), "terms": F.lit(2)})
    got = lexical.ranked(clashing, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == ranked_brute(rows, items)
    assert Counter(tuple(r) for r in lexical.ranked(clashing, asked, k=3).collect()) == ranked_brute(rows, items, 3)


def test_lexical_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.ranked(docs, none).count() == 0
    assert lexical.ranked(empty, spark.createDataFrame([(1, "th er")], "item_id long, text string")).count() == 0


def test_segments_skip_and_stay_exact():
    """Zipf-like lists over several runs: short and long lists, ties, and a threshold that rises."""
    rng = np.random.default_rng(3)
    size, words = 3 * lexical.RUN + 77, 60
    held = [np.unique(np.minimum(rng.zipf(1.3, 12), words) - 1) for _ in range(size)]
    count, term = np.array([len(h) for h in held]), np.concatenate(held)
    tf, n = rng.integers(1, 4, len(term)), rng.integers(12, 40, size)
    weight = lexical.weights(np.bincount(term, minlength=words), size)
    s = lexical.Segment(n, count, term, tf, weight, size, int(n.sum()))
    points = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(lexical.length_terms(n, size, int(n.sum())), count)))
    kinds = set()
    for q in range(40):
        terms = np.unique(rng.integers(0, words, rng.integers(1, 9)))
        short, long = s.lists(terms)
        kinds.add((bool(short), bool(long)))
        sums = np.zeros(size, np.int64)
        np.add.at(sums, np.repeat(np.arange(size), count), np.where(np.isin(term, terms), points, 0))
        want = [(int(sums[i]), int(i)) for i in np.lexsort((np.arange(size), -sums))[:10] if sums[i] > 0]
        best = lexical.Best(10)
        s.search(terms, best)
        assert list(zip(best.score.tolist(), best.doc.tolist())) == want
    assert kinds >= {(True, True), (False, True)}


def test_long_documents_do_not_overflow():
    n = np.array([10, 2**40], np.int64)
    assert lexical.length_terms(n, 2**30, 2**45).tolist() == [10 + 90 * 10 * 2**30 // 2**45, 10 + 90 * 2**40 * 2**30 // 2**45]


# hard negatives


def mined_brute(rows):
    sound = [(i, lab, [math.floor(256 * float(x)) for x in v]) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in sound), default=0)
    sound = [(i, lab, tuple(v + [0] * (width - len(v)))) for i, lab, v in sound]
    last = lambda i: math.inf if i is None else i
    out = []
    for a, lab, v in {r for r in sound if r[0] is not None and r[0] % 100 == 0}:
        score = sorted(((-sum(x * y for x, y in zip(v, w)), last(i), i, other == lab) for i, other, w in sound if i != a), key=lambda r: r[:2])
        for p, _, pid, _ in [s for s in score if s[3]][:5]:
            near = [(-s, i) for s, _, i, same in score if not same and 30 * -p <= 100 * -s <= 90 * -p]
            out += [(a, pid, rank, i, -p, s) for rank, (s, i) in enumerate(near[:10], 1)]
    return Counter(out)


def embedded(seed, n=900, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, width))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.15, width)).astype("float32").tolist(), int(rng.integers(0, 4))) for i in range(n)]
    same = rows[7][1]
    rows = [(i, same if i % 5 == 1 else v, lab) for i, v, lab in rows]  # a hot vector, ties
    odd = [(1001, None, 1), (1002, rows[0][1], None), (1003, [float("nan")] * width, 1), (1004, [float("inf")] * width, 1), (1005, [None] * width, 1), (1100, [], 2), (1200, rows[1][1][:5], 1), (None, rows[2][1], 2), (None, rows[2][1], 3)]
    return [*rows, *odd, rows[100], rows[100], rows[33]]


def test_hard_negatives_equal_brute_force(spark):
    rows = embedded(1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"v": F.lit(1), "leaf": F.lit(2), "rank": F.lit(3)})
    for sample in (200, 20_000):
        got = hard_negatives.mined(hard_negatives.vectors(table), sample=sample)
        assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == mined_brute(rows)


def test_hard_negatives_of_empty_and_lone_rows(spark):
    kind = "vec_id long, embedding array<float>, label int"
    for rows in ([], [(100, [0.5, 0.5], 1)], [(100, [0.5], 1), (101, [0.25], 2)]):
        assert hard_negatives.mined(hard_negatives.vectors(spark.createDataFrame(rows, kind))).count() == 0


def test_tree_drops_siblings_and_nothing_that_counts():
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(c, 6, (400, 4)) for c in (-300, 0, 300, 900)]).astype(np.int64)
    most = float((v * v).sum(1).max())
    tree = hard_negatives.fit(v[::5].astype(float), most)
    seen = {}
    leaf = hard_negatives.led(tree, v.astype(float), seen)
    for n, node in enumerate(tree.nodes):
        node.low, node.high = seen[n]
    anchors = np.arange(0, 1600, 100)
    score = v[anchors] @ v.T
    low, high = np.sort(score)[:, -80], np.sort(score)[:, -20]
    w = hard_negatives.Windows(np.arange(16), low, high, False, 10)
    search = hard_negatives.Search(tree, anchors, np.zeros(16, int), v[anchors], w, low)
    kept = search.leaves(set(leaf.tolist()))
    for k in range(16):
        needed = set(leaf[(score[k] >= low[k]) & (score[k] <= high[k])].tolist())
        assert needed <= {x for x, on in kept.items() if k in on}
    assert sum(map(len, kept.values())) < 0.7 * 16 * tree.leaves


def test_products_stay_exact_beyond_doubles():
    a = np.array([[2**28 + 1, 3]])
    assert hard_negatives.products(a, a)[0, 0] == (2**28 + 1) ** 2 + 9


# sharding


def sharded_brute(rows, shards, slack):
    order = sorted((at, s) for at, s in sharding.ring(shards))
    total = sum(len((r[1] or "").encode()) + 1 for r in rows)
    seen, waiting = Counter(), []
    for r in rows:
        text = (r[1] or "").encode()
        key = (r[0], len(text) + 1, zlib.crc32(text))
        nth = seen[key]
        seen[key] += 1
        name = "" if r[0] is None else str(r[0])
        k = next((k for k, (at, _) in enumerate(order) if at >= sharding.place(name)), 0)
        path = list(dict.fromkeys(s for _, s in order[k:] + order[:k]))
        mixed = sharding.place("/".join([name, *map(str, key[1:]), str(nth)])) >> 4
        waiting.append(((64 - key[1].bit_length()) * sharding.TURNS + mixed, key, path))
    bound, loads, grown, out = total * (1 + slack) / shards, [0] * shards, 1, []
    while waiting:
        for turn in range(shards):
            room = [max(0, int(bound - x)) for x in loads]
            asks = defaultdict(lambda: defaultdict(list))
            for w in waiting:
                if w[1][1] <= room[w[2][turn]]:
                    asks[w[2][turn]][w[0]].append(w)
            for shard, by_turn in asks.items():
                load = 0
                for _, some in sorted(by_turn.items()):
                    load += sum(w[1][1] for w in some)
                    if load > room[shard]:
                        break
                    loads[shard] += sum(w[1][1] for w in some)
                    out += [(*w[1], shard) for w in some]
                    for w in some:
                        waiting.remove(w)
        bound += grown * max(1.0, slack * total / shards)
        grown *= 4
    return Counter(out)


@pytest.mark.parametrize("shards, slack", [(16, 0.001), (3, 0.05)])
def test_sharding_equals_brute_force(clashing, rows, shards, slack):
    got = sharding.sharded(clashing.withColumns({"turn": F.lit(1), "path": F.lit(2), "size": F.lit(3)}), shards=shards, slack=slack).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in got) == sharded_brute(rows, shards, slack)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_bounds_loads_and_splits_one_hot_key(spark, empty):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(4000)] + [(7, "the same")] * 9000  # more than two pieces
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"))
    loads = [r[0] for r in got.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(loads) == 16 and max(loads) <= 1.001 * sum(loads) / 16 and min(loads) >= (1 - 15 * 0.001) * sum(loads) / 16
    assert got.filter("doc_id = 7").select("shard").distinct().count() > 1 and got.count() == len(rows)
    assert sharding.sharded(empty).count() == 0


def test_rows_stay_with_their_first_shard_unless_it_is_full(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(5000)], "doc_id long, text string")
    one, wide = ({r.doc_id: r.shard for r in sharding.sharded(rows, slack=s).collect()} for s in (0.001, 9.0))
    moved = sum(i % 50 + 1 for i in one if one[i] != wide[i])
    loads = Counter()
    for i, s in wide.items():
        loads[s] += i % 50 + 1
    share = sum(loads.values()) / 16
    assert 0 < moved <= sum(max(0, x - share) for x in loads.values()) + 16 * 50


def test_with_shards_keeps_every_row(clashing, docs, spark):
    got = sharding.with_shards(clashing, shards=4, name="placed_in")
    assert got.columns == [*clashing.columns, "placed_in"] and got.count() == clashing.count()
    want = sharding.sharded(docs, shards=4).groupBy("doc_id", "shard").count()
    assert Counter(tuple(r) for r in got.groupBy("doc_id", "placed_in").count().collect()) == Counter(tuple(r) for r in want.collect())
    hot = spark.createDataFrame([(7, "the same")] * 600 + [(i, "another") for i in range(10)], "doc_id long, text string")
    split = sharding.with_shards(hot, shards=4).groupBy("shard").count()
    assert sum(r["count"] for r in split.collect()) == 610 and split.count() == 4
