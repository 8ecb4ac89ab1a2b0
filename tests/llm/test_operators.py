"""Each operator against a brute-force version, on rows with nulls, blanks, ties, repeats and long texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe_codec, chat_format, decontaminate, exact_dedup, language_id, linear, quality, simhash, suffix_columns, suffix_dedup, token_counts, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def count(df):
    return Counter(tuple(r) for r in df.collect())


# exact dedup


def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        left = 1
        for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
            out[(i, keep, len(ids), bool(left and i == keep), hashlib.sha256(text.encode()).hexdigest())] += 1
            left = left and i != keep
    return out


def test_exact_dedup_equals_brute_force(docs, rows):
    got = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert count(got) == exact_brute(rows)


def test_exact_dedup_keeps_one_row_of_each_text(clashing, docs, rows, empty):
    kept = exact_dedup.keep_one(clashing)
    assert kept.columns == clashing.columns
    texts = [(r.text or "").translate(LOWER) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({(r[1] or "").translate(LOWER) for r in rows})
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.keep_one(empty).count() == 0


def test_chunks_cover_every_text(spark, docs):
    parts = docs.filter("text is not null").select("text", F.array_join(F.regexp_extract_all("text", F.lit(exact_dedup.CHUNK), F.lit(0)), "").alias("again"))
    assert parts.filter("text <> again").count() == 0


# simhash


def simhash_brute(rows, words=3, bits=2):
    def fp(text):
        w = (text or "").translate(LOWER).encode().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = least.setdefault(find(i), [])
        if r[0] is not None:
            ids.append(r[0])
    return Counter((r[0], format(f, "016x"), min(least[find(i)], default=None)) for i, (r, f) in enumerate(zip(rows, fps)))


def test_simhash_equals_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert count(got) == simhash_brute(rows)


def test_simhash_keeps_one_of_each_group(clashing, empty):
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    again = simhash.near_duplicates(kept, words=5, max_bits=6).filter("doc_id is not null")
    assert again.select("component_id").distinct().count() == again.select("doc_id").distinct().count()
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("words", [1, 3, 5])
def test_shingles_of_many_texts_equal_the_librarys(words):
    rng = np.random.default_rng(words)
    data, start, size = rng.integers(0, 256, 20_000).astype(np.uint8), rng.integers(0, 9000, 2000), rng.integers(0, 200, 2000)
    start[:3], size[:3] = 0, [5000, 4096, 4095]
    assert simhash.xxh64(data, start, size).tolist() == [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size)]
    texts = ["", "  ", "a", "a b", " a  b\tc\n d ", "é ß 日本 x\u3000y", " ".join(f"w{i}" for i in range(500)), "x" * 9000 + " y z", "\x0b\x0c", "a b c d e f"]
    h, count = simhash.shingles(texts, words)
    for t, got in zip(texts, np.split(h, np.cumsum(count)[:-1])):
        w = t.encode().split()
        want = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        assert got.tolist() == want


def test_near_stage_holds_its_similarity_both_ways(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        base = [f"w{x}" for x in rng.integers(0, 4000, 120)]
        for changes in (0, 1, 2, 3, 4, 6):
            own = list(base)
            for at in rng.choice(120, changes, replace=False):
                own[at] = f"new{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["one two three four five six", "one two three four five seven", "", " "])]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(group) and 45 < len(kept) < 200


@pytest.mark.parametrize("seed", range(6))
def test_hierarchical_index_finds_all_components(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, 1 + seed, dtype=np.uint64)
    fp = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5)))) for c in centres for _ in range(150)], np.uint64))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 2
    want = np.arange(len(fp))
    while True:
        new = np.where(near, want[None, :], len(fp)).min(1)
        if (new == want).all():
            break
        want = new
    monkeypatch.setattr(simhash, "PAIRS", 640)
    assert (simhash.linked(fp, 2) == want).all()


def test_large_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 4)
    fps = [1 << b for b in range(63)] + [0, 7, 7 << 40]
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = simhash.components(edges)
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(fps) - 1


# decontamination


def edit_in(item, text):
    """The least edit distance of item to a part of text, the plain way."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    items = [(i, rows[i][1][10:130]) for i in range(6)] + [(6, rows[7][1][5:60].replace("e", "é", 2)), (7, None), (8, "  "), (9, "a"), (2, rows[2][1][10:130])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: " ".join((t or "").lower().split())
    want = set()
    for i, t in items:
        for d, x, *_ in rows:
            if len(x or "") > 4500:
                continue
            n = norm(t)
            if n and len(n) > 1 and edit_in(n, norm(x)) <= int(0.05 * len(n)):
                want.add((d, i))
    found = decontaminate.contaminated(docs, bench)
    got = {(r.doc_id, r.item_id) for r in found.collect() if len(rows[r.doc_id or 0][1] or "") <= 4500 and r.item_id != 9}
    assert got == want
    assert {r.doc_id for r in found.filter("item_id = 9").collect()} == {20}  # a short item: only as a word of its own
    assert decontaminate.contaminated(docs, bench, block_bytes=64).distinct().count() == found.distinct().count()
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_clean_documents_stay(clashing, spark, rows):
    bench = spark.createDataFrame([(0, rows[3][1][5:150])], "item_id long, text string")
    left = decontaminate.without_benchmark(clashing, bench)
    assert left.columns == clashing.columns
    gone = Counter(r[0] for r in rows) - Counter(r.doc_id for r in left.collect())
    assert 3 in gone and set(gone) <= {3, 15}


@pytest.mark.parametrize("a, b", [("kitten", "the sitting"), ("abcdef", "xxabdefxx"), ("a" * 70, "b" + "a" * 66 + "c"), ("abc", "")])
def test_bit_parallel_distance(a, b):
    got = decontaminate.myers(a, b, len(a))
    assert (got[0] if got else len(a)) == edit_in(a, b)


# tokens


def test_token_counts_equal_the_library(docs, rows, clashing, empty):
    lib = Tokenizer.from_file(BYTE_BPE)
    want = Counter()
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want[(r[0], len((r[1] or "").encode()), n, n > 1024)] += 1
    assert count(token_counts.token_counts(docs, BYTE_BPE)) == want == count(token_counts.token_counts(clashing, BYTE_BPE))
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "aaaa" * 300, "a" * 4001, "I'll don't   x\n\n y", "՘࢏౜", "ΣΑΣ 日本 ½²"])
def test_kernels_follow_the_library(text):
    counts = token_counts.counter(token_counts.vocabulary_bytes(BYTE_BPE))
    assert counts([text]) == [len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)]
    lib = Tokenizer.from_file(WORD_BPE)
    ids, decoded = next(bpe_codec.codec(token_counts.vocabulary_bytes(WORD_BPE)).both([text]))
    want = lib.encode(text, add_special_tokens=False).ids
    assert [i for w in ids for i in w] == want and decoded == lib.decode(want, skip_special_tokens=False)


def test_codec_equals_the_library(docs, rows, clashing, empty):
    lib = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        decoded = lib.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())] += 1
    assert count(bpe_codec.digests(bpe_codec.encode_decode(docs, WORD_BPE))) == want == count(bpe_codec.digests(bpe_codec.encode_decode(clashing, WORD_BPE)))
    assert bpe_codec.encode_decode(empty, WORD_BPE).count() == 0


@pytest.mark.parametrize("symbols, n", [(1, 3000), (2, 700), (3, 1500), (26, 4000)])
def test_tree_joins_are_exact(symbols, n):
    rng = np.random.default_rng(symbols)
    word = "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, symbols, n))
    ids, _ = next(bpe_codec.codec(token_counts.vocabulary_bytes(WORD_BPE)).both([word]))
    assert [i for w in ids for i in w] == Tokenizer.from_file(WORD_BPE).encode(word, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def word_codec():
    with open(WORD_BPE, "rb") as f:
        return bpe_codec.Codec(f.read())


@pytest.mark.parametrize("half", [1, 2, 3, 7, 4096])
def test_texts_cut_anywhere_are_joined_exactly(word_codec, half, monkeypatch):
    monkeypatch.setattr(bpe_codec, "HALF", half)
    rng = np.random.default_rng(half)
    parts = ["'", "'s", "'re", "r", "e", "ve", "don't", " ", "  ", "\n", "12", "3", "!?", "...", "ß", "日本", "é", "a", "the", "x" * 9, "\u3000"]
    for _ in range(60):
        text = "".join(rng.choice(parts, rng.integers(0, 40)))
        assert word_codec.split(text) == word_codec.words(text)


def test_long_documents_go_through_joins_and_growing_windows(word_codec, spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").collect()
    seen, plain, words = Counter(), Tokenizer.from_file(WORD_BPE), word_codec.words

    def join(text, left, right, run=word_codec.join):
        monkeypatch.setattr(word_codec, "words", lambda t: seen.update(windows=1) or words(t))
        out = run(text, left, right)
        monkeypatch.setattr(word_codec, "words", words)
        seen.update(joins=1)
        return out

    monkeypatch.setattr(word_codec, "join", join)
    long = [r.text for r in rows if len(r.text) > bpe_codec.HALF]
    for text, (ids, _) in zip(long, word_codec.both(long)):
        assert [i for w in ids for i in w] == plain.encode(text, add_special_tokens=False).ids
    assert seen["joins"] > 100 and seen["windows"] > 1.5 * seen["joins"]


# repeated passages


def repeats_brute(rows, length):
    first = {}
    for i, t in ((r[0], (r[1] or "").encode()) for r in rows):
        if i is not None:
            for p in range(len(t) - length + 1):
                w = t[p : p + length]
                first[w] = min(first.get(w, i), i)
    out = Counter()
    for r in rows:
        t = (r[1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if r[0] is not None and first.get(t[p : p + length], r[0]) < r[0]:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out[(r[0], len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def spans_of(docs):
    return suffix_dedup.repeated_bytes(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256))


@pytest.mark.parametrize("shard, hot", [(1 << 23, 256), (3000, 256), (3000, 3)])
def test_repeated_passages_equal_brute_force(clashing, rows, empty, shard, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert count(spans_of(clashing)) == repeats_brute(rows, 50)
    assert spans_of(empty).count() == 0


@pytest.mark.parametrize("shard, hot", [(2000, 256), (500, 1)])
def test_an_anchor_with_many_surroundings(spark, shard, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", shard)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 20_000)
    rng = np.random.default_rng(8)
    some = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    line, tails = some(60), [some(25) for _ in range(5)]
    rows = [(int(i), some(rng.integers(0, 40)) + line[rng.integers(0, 40) :] + tails[rng.integers(0, 5)] + some(9)) for i in rng.permutation(1500)]
    assert count(spans_of(spark.createDataFrame(rows, "doc_id long, text string"))) == repeats_brute(rows, 50)


@pytest.mark.parametrize("block", [3, 7, 1 << 18])
@pytest.mark.parametrize("seed", range(8))
def test_suffix_columns_name_equal_windows(seed, block, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_columns, "BLOCK", block)
    rng = np.random.default_rng(seed)
    strings = list({bytes(rng.integers(97, 98 + seed % 4, rng.integers(4, 11)).astype(np.uint8)) for _ in range(20)})
    flat, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    with suffix_columns.Files(f"file:{tmp_path}" if seed % 2 else None) as files:
        who, start, group = suffix_columns.Columns(flat, size, 4, files).equal_windows()
    named = {}
    for w, s, g in zip(who.tolist(), start.tolist(), group.tolist()):
        assert named.setdefault(g, strings[w][s : s + 4]) == strings[w][s : s + 4]
    assert len(set(named.values())) == len(named) and len(who) == sum(len(s) - 3 for s in strings)
    assert not list(tmp_path.iterdir())


def test_suffix_columns_through_the_folder_write_two_bytes_an_entry(tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_columns, "BLOCK", 64)
    rng = np.random.default_rng(5)
    strings = [bytes(rng.integers(97, 99, rng.integers(6, 12)).astype(np.uint8)) for _ in range(60)]
    flat, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    found, sizes = [], []
    for held in (100, 1 << 20):
        monkeypatch.setattr(suffix_columns, "HELD", held)
        with suffix_columns.Files(f"file:{tmp_path}") as files:
            found.append(suffix_columns.Columns(flat, size, 6, files).equal_windows())
            sizes.append(sorted(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()))
    assert all(np.array_equal(a, b) for a, b in zip(*found)) and not list(tmp_path.iterdir())
    n = len(flat) + len(strings)  # the suffixes, empty ones too; one fewer round's in the other file
    assert len(sizes[0]) == 3 and 2 * n in sizes[0] and max(sizes[0]) <= 2 * n and not sizes[1]


def test_stretches_that_share_half_a_window_by_chance_stay_out_of_the_columns(monkeypatch):
    rng = np.random.default_rng(6)
    some = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    anchor, more = some(16), some(20)
    strings = [some(34) + anchor + more + some(14) for _ in range(200)]
    strings += [strings[0][:70] + some(13), some(33) + strings[1][33:]]  # these share windows
    seen = []
    columns = suffix_dedup.Columns
    monkeypatch.setattr(suffix_dedup, "Columns", lambda flat, size, *a: seen.append(len(size)) or columns(flat, size, *a))
    n = len(strings)
    size, ids = np.array([len(s) for s in strings]), np.arange(n)
    row, first, last, least = suffix_dedup.sort_stretches(np.frombuffer(b"".join(strings), np.uint8), size, np.full(n, 34), ids, ids, 50, suffix_dedup.Hasher(), None)
    assert seen == [4]
    assert sorted(zip(row.tolist(), first.tolist(), last.tolist(), least.tolist())) == [(200, 0, 20, 0), (201, 33, 34, 1)]


def test_slices_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 97)
    data = bytes(np.random.default_rng(1).integers(97, 100, 1000).astype(np.uint8))
    texts = [data, b"", data[:49], data[:50], data[100:260]]
    found = suffix_dedup.stretches(texts, 50, suffix_dedup.Hasher())
    got = [(n, s) for n, a, b in zip(found.text.tolist(), found.a.tolist(), found.b.tolist()) for s in range(a, b - 49)]
    assert got == [(n, s) for n, t in enumerate(texts) for s in range(len(t) - 49)]


def test_strings_of_one_hash_are_told_apart():
    flat = np.frombuffer(b"abcabdabc", np.uint8)
    group = suffix_dedup.same_bytes(flat, np.array([0, 3, 6]), np.full(3, 3), np.zeros(3, np.uint64))
    assert group[0] == group[2] != group[1]


# classifiers


def test_language_id_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, ~language_id.held_out()).filter(language_id.held_out()).join(docs.select("doc_id", "lang"), "doc_id")
    n, right, low, high = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred")), F.min("score"), F.max("score")).first()
    assert n > 100 and right / n > 0.98 and 0 <= low and high <= 1


def test_language_id_edge_cases(docs, clashing, empty):
    got = {r.doc_id: r for r in language_id.identify(docs, ~language_id.held_out()).collect()}
    for blank in (16, 17, 18, 19, 22):  # null, empty, blank, no letters
        assert (got[blank].lang_pred, got[blank].score) == ("und", 0.0)
    assert got[0].lang_pred in ("en", "de")
    kept = language_id.keep_identified(clashing)
    assert kept.columns == clashing.columns and 16 not in {r.doc_id for r in kept.collect()}
    assert language_id.identify(empty, F.lit(True)).count() == 0 and language_id.keep_identified(empty).count() == 0
    untaught = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in untaught.collect()} == {"und"}


def test_texts_of_no_learned_language_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    noise = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n))
    greek = "Η γρήγορη καφέ αλεπού πηδά πάνω από το τεμπέλικο σκυλί και τρέχει στο δάσος. "
    strange = [greek, greek * 40, "これは学習されていない言語の文章です。", "Съешь же ещё этих мягких французских булок", "ж", "xqzvkj wqxz kjqpv", noise(300), noise(1000)]
    more = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(strange)], docs.schema)
    kept = {r.doc_id for r in language_id.keep_identified(docs.union(more)).select("doc_id").collect()}
    clean = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).collect()}
    assert not {i for i in kept if i >= 10**6} and len(clean & kept) >= 0.998 * len(clean)


def test_toxicity_held_out(spark):
    got = toxicity.op7_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id")
    tp, fp, p, n = got.agg(*[F.count_if(F.expr(e)) for e in ("predicted = 1 and toxic = 1", "predicted = 1 and toxic = 0", "toxic = 1", "toxic = 0")]).first()
    assert tp / p > 0.8 and fp / n < 0.01


def test_toxicity_swaps_identity_terms(spark):
    vocabulary = {w: i for i, w in enumerate(sorted({*toxicity.SWAPS, "awful"}))}
    pairs = list(toxicity.counterfactuals("The women are awful. Nothing here.", vocabulary))
    assert len(pairs) == len(toxicity.SWAPS["women"]) and all(gone == (vocabulary["women"],) and come for gone, come in pairs)
    assert set(toxicity.counterfactuals("women and men", vocabulary)) >= {((vocabulary["women"],), ()), ((vocabulary["men"],), ())}
    rows = [(i, ("women are vile " if i % 2 else "men are kind ") + f"w{i % 7}", i % 2) for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    apart = [abs(m.score("women today") - m.score("men today")) for m in (toxicity.fit(labelled, pull=0.0), toxicity.fit(labelled, pull=10.0))]
    assert apart[1] < 0.5 * apart[0]


def test_terms_of_the_rows_are_swapped_where_they_fill_the_same_places(spark):
    rows = [(i, f"the {['cat', 'dog', 'fox'][i % 3]} is {'vile' if i % 5 == 0 else 'kind'}. so a {['cat', 'dog', 'fox'][i % 3]} goes", int(i % 5 == 0)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    counted, share = toxicity.word_counts(labelled)
    assert share == 0.2 and {tuple(sorted([t, *o])) for t, o in toxicity.exchangeable(labelled, counted, 50, 10).items()} == {("cat", "dog", "fox")}
    assert toxicity.fit(labelled).pairs > 0


def test_a_fit_without_pairs_warns(spark):
    rows = [(i, "vile thing" if i % 2 else "kind word", i % 2) for i in range(100)]
    with pytest.warns(UserWarning, match="not regularised"):
        toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))


def test_the_penalty_works_on_documents(spark):
    d = "/root/testdata/sf0.1/"
    docs, labels = (spark.read.parquet(f"{d}{t}.parquet") for t in ("documents", "labels"))
    teach = toxicity.training_rows(docs, labels, ~toxicity.held_out())
    free, pulled = toxicity.fit(teach, pull=0.0), toxicity.fit(teach)
    assert free.pairs == pulled.pairs > 1000 and {t for t in pulled.swaps if t not in toxicity.SWAPS}
    before, after = (toxicity.report(docs, labels, m, toxicity.held_out()).first() for m in (free, pulled))
    print(before, after)
    assert after["pairs"] > 1000 and after["mean_gap"] < before["mean_gap"] and after["called_mentioning"] <= 0.01


@pytest.mark.parametrize("seed", range(3))
def test_the_regression_finds_the_least_loss(seed):
    rng = np.random.default_rng(seed)
    x, changes = (rng.random((80, 6)) < 0.4).astype(float), [([0], [1], 5), ([2, 3], [], 2), ([], [4], 1)]
    y = (rng.random(80) < 0.5).astype(float)
    w, b = linear.logistic(x, y, l2=1e-2, changes=changes, pull=0.7, rounds=3000)
    delta = np.zeros((3, 6))
    for k, (gone, come, _) in enumerate(changes):
        delta[k, gone], delta[k, come] = -1, 1
    share = np.array([5, 2, 1]) / 8
    slope = x.T @ (linear.sigmoid(x @ w + b) - y) / 80 + 2e-2 * w + 1.4 * delta.T @ (share * (delta @ w))
    assert np.abs(slope).max() < 1e-4


def test_toxicity_edge_cases(spark, docs, empty):
    model = toxicity.Model({"bad": 3.0}, -1.0)
    got = toxicity.score_texts(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = toxicity.fit(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert none.score("") < 0.01 and toxicity.score_texts(empty, none).count() == 0
    one = toxicity.fit(spark.createDataFrame([(1, "x", 1)], "doc_id long, text string, toxic int"))
    assert one.score(None or "") > 0.99


def test_quality_shrinks_small_sites(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 24)] + [(None, 1, 0), (3, None, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(0, "https://a.example/en/3?x=1", ""), (1, "https://a.example/en/4.html", ""), (2, "nonsense", ""), (3, None, "")], "page_id long, url string, html string")
    got = quality.quality_scores(docs, quality.page_sites(pages), labels, F.lit(True)).collect()
    assert len(got) == docs.count() and all(0 <= r.quality <= 1 for r in got)
    assert {(r.host, r.path) for r in got if r.doc_id == 3} == {("a.example", "/en/")}
    shares = [r.path_posterior for r in got]
    assert 0.2 < min(shares) and max(shares) < 0.8  # two documents alone don't move a path far from the rest
    assert quality.quality_scores(empty, quality.page_sites(pages), labels, F.lit(True)).count() == 0
    assert {r.evidence for r in quality.quality_scores(docs, quality.page_sites(pages), labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_quality_posteriors_equal_recomputation(spark):
    d = "/root/testdata/sf0.001/"
    docs, pages, labels = (spark.read.parquet(f"{d}{t}.parquet") for t in ("documents", "pages", "labels"))
    learn, soft = F.col("doc_id") % 5 != 0, 0.05
    got = quality.quality_scores(docs, quality.page_sites(pages), labels, learn).collect()
    label = {r.doc_id: r.quality for r in labels.filter(learn).collect()}
    good, n = defaultdict(float), defaultdict(float)
    for r in got:
        y = label.get(r.doc_id)
        good[r.host, r.path] += y if y is not None else soft * r.evidence
        n[r.host, r.path] += 1.0 if y is not None else soft

    def strength(groups, parent):
        total = sum(k for _, k in groups.values())
        q = sum(k * (g / k - parent(x)) ** 2 for x, (g, k) in groups.items())
        v = sum(parent(x) * (1 - parent(x)) for x in groups)
        nv = sum(k * parent(x) * (1 - parent(x)) for x, (_, k) in groups.items())
        return min(max(nv / total / max((q - v) / total, 1e-9) - 1, 1.0), 1e4)

    hosts = defaultdict(lambda: [0.0, 0.0])
    for (h, _), g in good.items():
        hosts[h][0] += g
    for (h, _), k in n.items():
        hosts[h][1] += k
    share = sum(g for g, _ in hosts.values()) / sum(k for _, k in hosts.values())
    k1 = strength(hosts, lambda h: share)
    at_host = {h: (g + k1 * share) / (k + k1) for h, (g, k) in hosts.items()}
    paths = {x: (good[x], n[x]) for x in n}
    k2 = strength(paths, lambda x: at_host[x[0]])
    at_path = {x: (g + k2 * at_host[x[0]]) / (k + k2) for x, (g, k) in paths.items()}
    logit = lambda p: np.log(p / (1 - p))
    for r in got:
        p = at_path[r.host, r.path]
        assert (r.host_posterior, r.path_posterior) == pytest.approx((at_host[r.host], p))
        assert r.quality == pytest.approx(1 / (1 + np.exp(-(logit(r.evidence) + logit(p) - logit(share)))))


def test_quality_held_out(spark):
    got = quality.op8_quality(spark, "/root/testdata/sf0.01").filter("held_out").select("doc_id", "keep").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    n, right = got.agg(F.count("*"), F.count_if(F.col("keep") == (F.col("quality") == 1))).first()
    assert n > 40 and right / n > 0.95


# chat formatting


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "Ann ", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, "ann", "late"), (2, 0, "system", "x"), (3, 0, None, "who"), (None, 0, "eve", "n")]
    rows += [(9, t, "ann" if t % 2 else "bob", f"t{t}") for t in range(150)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("mask", F.lit(1))
    got = {(r.conv_id, r.perspective, r.segment): r for r in chat_format.perspectives(turns).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (3, "unknown"), (None, "eve"), (9, "ann"), (9, "bob")}
    r = got[1, "ann", 0]
    assert r.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n" + 2 * "<|im_start|>user name=bob\n<|im_end|>\n"
    assert [r.rendered[m.start : m.end] for m in r["mask"]] == ["hi<|im_end|>"]
    assert got[1, "ann", 1].rendered == "<|im_start|>assistant\nlate<|im_end|>\n" and got[1, "ann", 1].start_char == len(r.rendered)
    parts = [got[9, "ann", k] for k in range(3)]
    assert [p.n_turns for p in parts] == [64, 64, 22] and [p.start_char for p in parts] == [0, len(parts[0].rendered), len(parts[0].rendered) + len(parts[1].rendered)]
    assert chat_format.perspectives(turns.limit(0)).count() == 0


def test_language_sample_holds_each_id_once_in_any_order(spark):
    words = {"de": "der hund und die katze", "fr": "le chien et la chatte"}
    rows = [(i, f"{words[v]} {i}", v, True) for v, k in (("de", 0), ("fr", 1)) for i in range(k, 120, 2)]
    rows += [(0, f"der hund {n}", "de", True) for n in range(400)] + [(None, "die katze", "de", True)] * 3
    schema = "doc_id long, text string, lang string, has_letter boolean"
    one, two = (language_id.fit(spark.createDataFrame(r, schema).repartition(n), F.lit(True), 40, 80) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert one.langs == two.langs == ["de", "fr"]
    assert (one.centres == two.centres).all() and (one.pairs.keys() == two.pairs.keys())


def test_language_model_and_floors_come_from_all_rows(spark):
    words = {"de": "der hund und die katze im haus", "en": "the dog and the cat in a house", "fr": "le chien et la chatte dans une maison"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.permutation(words[v].split())[: rng.integers(2, 6)]) + f" {''.join(rng.choice(list('abcdefgh'), 4))}", v) for i, v in enumerate(rng.choice(list(words), 9000, p=[0.3, 0.5, 0.2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("has_letter", F.lit(True)).repartition(5)
    teaches = F.col("doc_id") % 2 == 0
    model = language_id.calibrated(language_id.fit(docs, teaches), docs, teaches)
    for k, lang in enumerate(model.langs):
        mean = np.mean([language_id.features(t).astype(np.float16).astype(float) for i, t, v in rows if v == lang and i % 2 == 0], 0)
        assert np.abs(model.centres[k] - mean / np.sqrt(mean @ mean)).max() < 1e-7
    other = [language_id.features(t) for i, t, _ in rows if i % 2]
    size, near = np.array([language_id.size_class(x) for x in other]), np.array([model.nearness(x) for x in other])
    assert len(other) == 4500
    for k in np.unique(size):
        if (size == k).sum() >= 20:
            assert abs(model.floors[k] - 0.75 * np.quantile(near[size == k], 0.01)) < 1e-9
    again = language_id.fit(docs.repartition(2), teaches)
    assert (again.first == model.first).all() and all((again.pairs[p] == model.pairs[p]).all() for p in model.pairs)
