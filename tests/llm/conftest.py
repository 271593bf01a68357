import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a further column of the input may have any of them.
CLASHES = ("node", "row", "name", "host", "size", "key", "text_hash", "__id", "__hash", "__removed", "__n", "clean", "rows", "first", "a.b", "label", "kept", "n", "id", "slice", "bands")


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(40)) for _ in range(n))


def corpus():
    """Rows with near and exact copies, repeated lines, nulls, blanks, long texts, ties and repeated rows."""
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(30, 120)) for _ in range(30)]
    for t in texts[:10]:
        parts = t.split()
        parts[len(parts) // 2] = "changed"
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3].replace(" ", "  "), texts[4].upper(), "a b c", "a  B c", "a b c d", "", " \n\t ", "one two three four five", None, None]
    shared = words(rng, 14)
    texts += [f"{words(rng, 20)}\n{shared}\n{words(rng, 25)}" for _ in range(4)]
    texts += [f"{words(rng, 20)}\n{shared.upper()}!\n\nThe.\n{words(rng, 9)}"]
    texts += [words(rng, 9000)]
    rows = [(i * 3 + 1, t, "en", f"src{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2]]  # repeated rows
    rows += [(None, texts[1], None, "src0", None), (None, "no id here at all, but six words", None, "src1", None)]
    rows += [(5000 + i, f"{words(rng, 60)} {'x' * i}", "en", "hot", 1) for i in range(20)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def wide(spark, docs):
    """The same rows with further columns whose names clash with those that operators use."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
