"""The pipeline's stages against what their operators say, and its registration."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm.queries import QUERIES, SQL


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)} and set(SQL) <= set(QUERIES)


def test_pipeline_drops_what_it_must(spark, docs, sf_dir, tmp_path):
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before, docs_in = {r.doc_id for r in docs.collect()}, docs
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == docs_in.columns and {r.doc_id for r in docs.collect()} <= before
    left = [r.text for r in docs.collect()]
    assert len({t.lower() for t in left}) == len(left) and all(any(c.isalpha() for c in t) for t in left)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == len(left) and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_pipeline_runs_on_tables(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.7 * n < out.count() <= n and out.filter(F.col("n_tokens") < 0).count() == 0


def test_pipeline_runs_on_an_empty_table(spark, empty, sf_dir):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_stages_equal_brute_force(spark, docs, sf_dir, tmp_path):
    """Each stage on what the one before it kept: equal texts, five-word similarity, a test item's text, the library's tokens."""
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()
    more = [(900, "before it " + item.text + " and after it", "en", "src0", 1), (901, item.text.replace("e", "E", 1), "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    stages = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        stages[name](spark, docs, sf_dir).write.parquet(str(tmp_path / name.replace(" ", "-")))
        return spark.read.parquet(str(tmp_path / name.replace(" ", "-")))

    def lower(t):
        return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    one = after("language ID", docs)
    last: dict = {}
    for r in one.collect():
        last[lower(r.text)] = max(last.get(lower(r.text), r.doc_id) or -1, r.doc_id if r.doc_id is not None else -1)
    two = after("exact dedup", one)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in two.collect()) == sorted(last.values())

    def shingles(t):
        w = lower(t).encode().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    rows = two.collect()
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    ids = {x: min((r.doc_id for r, y in zip(rows, root) if y == x and r.doc_id is not None), default=None) for x in set(root)}
    three = after("SimHash near-dedup", two)
    assert len(ids) < len(rows) and sorted(str(r.doc_id) for r in three.collect()) == sorted(map(str, ids.values()))
    four = after("benchmark decontamination", three)
    gone = {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()}
    assert gone and gone <= {900, 901}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["BPE encoding and decoding"](spark, four, sf_dir).join(four.select("doc_id", "text"), "doc_id").collect():
        ids = plain.encode(r.text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_send_short_batches(spark, docs, sf_dir):
    """After each stage that has Python workers: batches of rows, and of long texts, are short in the session that runs it."""
    import pyarrow as pa

    names = [f"spark.sql.execution.arrow.{n}" for n in ("maxRecordsPerBatch", "maxBytesPerBatch")]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    def largest(rows):
        return rows.mapInArrow(sizes, "n long, size long").agg(F.max("n"), F.max("size"), F.sum("n")).first()

    many, long = spark.range(2500, numPartitions=1), spark.range(40, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "exact dedup":
            continue
        try:
            for n in names:
                spark.conf.unset(n)
            stage(spark, docs.limit(2), sf_dir)
            assert largest(many)[0] <= 1000 and largest(many)[2] == 2500, name
            assert largest(long)[1] < 10 << 20 and largest(long)[2] == 40, name
        finally:
            for n in names:
                spark.conf.unset(n)
