import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, near copies, a shared passage."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvwéß") for _ in range(rng.randint(2, 9))) for _ in range(400)]

    def text(n):
        w = rng.choices(vocabulary, k=n)
        return " ".join(x + ("\n" if rng.random() < 0.05 else "") for x in w)

    base, passage = text(150), " ".join(rng.choices(vocabulary, k=60))
    near = base.split(" ")
    near[70] = "anders"
    rows = [(1, base, "aa", "s1", 5), (2, base, "aa", "s2", 5), (3, " ".join(near), "aa", "s1", 5), (4, None, "aa", "s1", None),
            (5, "", None, None, 0), (6, " \n\t ", "bb", "s3", 4), (7, "one two", "bb", "s1", 7), (8, "one two", "bb", "s1", 7),
            (9, text(30_000), "bb", "s2", 1), (10, text(40) + " " + passage + " " + text(70), "aa", "s2", 1),
            (11, text(50) + " " + passage + "\n" + text(20), "bb", None, 1), (1, base, "aa", "s1", 5),
            (None, text(80), "aa", "s1", 1), (None, "one two", None, "s2", 1), (12, "<|endoftext|>Straße Ünïcode it's 3.14!!", "bb", "s1", 1),
            (13, "a" * 3000, "bb", "s1", 1), (14, "x y z " * 60, "aa", "s4", 1), (15, "ABC! " * 70, "aa", "s4", 1),
            (16, "| ".join(rng.choices(vocabulary, k=80)), "aa", "s4", 1), (17, None, None, None, None)]
    rows += [(20 + i, text(rng.randint(30, 120)), "aa", f"s{i % 5}", 1) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(5).persist()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with more columns, named like those that operators make on their way."""
    from pyspark.sql import functions as F
    names = ["block", "node", "bucket", "size", "h", "rank", "fold", "row", "copies", "taken", "offset", "range", "kind", "bands",
             "label", "__id", "a.b", "c0", "TARGET", "file", "start", "ids", "cell", "shard", "n_bytes", "lang_pred", "__n"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
