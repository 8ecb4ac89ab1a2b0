import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ["fp", "key", "mask", "rank", "h", "shard", "digest", "recipe", "kept", "component_id", "score", "_row", "_key", "norm", "copies", "found"]


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Copies, near copies, nulls, blanks, repeated rows, a very long text, scripts of all kinds."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(20, 120)) for _ in range(12)]
    long = words(rng, 6000)
    texts = [*base, base[0], base[0].upper(), base[1] + " extra", base[2][:200] + " " + base[3], None, None, "", "   \n\t ", "a", "Ä ß é 日本語 العربية 🎉 x̌", "!!! ??? 123", long, long[:20000] + " changed " + long[20000:], "x" * 5000, "ab" * 3000]
    out = [(i, t, ["en", "de", None][i % 3], f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    out.append((None, base[5], "en", "src0", 1))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({x: F.lit(7) for x in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
