import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, digest string, bucket int, shard string, node string, place int, block int, tokens string, epochs int, `__sha` string"


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def rows():
    """Null, empty and very long texts, copies, near copies, shared passages, repeated rows, null columns."""
    out = []

    def add(i, text, lang="en", source="src1"):
        out.append((i, text, lang, source, "d", 1, "s", "n", 2, 3, "t", 4, "x"))

    base = words(120, 1)
    passage = words(70, 2, 5000)
    for i in range(12):
        near = list(base)
        near[5 + 9 * i % 110] = f"changed{i}"
        add(i, " ".join(near), "en" if i % 2 else "de", f"src{i % 3}")
    for i in range(12, 20):
        add(i, "the very same short text\nthe very same short text", "en", "src0")
    for i in range(20, 26):
        add(i, " ".join(words(30 + i, 10 + i) + passage + words(20, 40 + i)), "fr", None)
    add(26, None)
    add(27, "")
    add(28, " \t\n ")
    add(29, "one")
    add(30, "été ça où déjà größer İstanbul 東京 <|endoftext|> it's can't ½ é", None, None)
    add(31, " ".join(words(9000, 77, 3000)))
    add(32, "loop " * 60)
    add(33, " ".join(passage[10:62]))
    add(34, "12345 67890 !!! ###", "en", "src2")
    add(34, "12345 67890 !!! ###", "en", "src2")
    add(35, " ".join(base), "en", "src0")
    add(36, " ".join(base), None, "src0")
    add(37, "The cat, the dog. The end", "es", "src3")
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
