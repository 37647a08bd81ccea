import random

import pytest

#: A table of documents has these columns; odd rows come from odd_rows().
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \t\n ", "en", "a", 4),
        (None, "a text without an id and a few more words", "en", None, 1),
        (None, None, None, None, None),
        (3, long, "en", "a", len(long)),
        (4, "the same text twice in two rows of the table", "de", "b", 1),
        (4, "the same text twice in two rows of the table", "de", "b", 1),
        (5, "one id with", "fr", "b", 1),
        (5, "two different texts", "fr", "b", 1),
        (6, "ünïcödé 🙂 𝔘𝔫𝔦 12 34", "de", "c", 1),
        (7, "x", "en", "c", 1),
        (8, "12345 67890 !!!", None, "c", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """The odd rows with columns whose names operators use inside or give out."""
    from pyspark.sql import functions as F

    out = odd
    for c in ("score", "held_out", "predicted", "fp", "rep", "component_id", "fingerprint", "shard_", "key", "bin", "piece", "file", "block", "gone", "doc", "_doc", "_text", "line", "n", "u", "v", "node", "__score", "__c", "__id", "__bad", "_gone", "_lines", "_r", "_k", "_a", "_b", "row", "block", "cluster"):
        out = out.withColumn(c, F.lit(1))
    return out


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rng = random.Random(9)
    return spark.createDataFrame([(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(1000, 1400)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def corpus(spark, labels):
    """Labelled documents: bad ones (quality 0) shout, toxic ones hold one of two rare words; languages have their own letters."""
    rng = random.Random(8)
    y = {r["doc_id"]: r for r in labels.collect()}
    letters = {"en": "abcdefg", "de": "äöüklmn", "fr": "éèêrstu"}
    rows = []
    for i in range(1000, 1400):
        lang = rng.choice(list(letters))
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(20, 120))]
        if y[i]["toxic"]:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["zzblah", "qqfoul"]))
        if not y[i]["quality"]:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), lang, f"s{i % 5}", 1))
    return spark.createDataFrame(rows, SCHEMA)
