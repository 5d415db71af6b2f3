import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("id", T.StringType()), T.StructField("size", T.IntegerType())])


def corpus(seed: int = 1, n: int = 160) -> list[tuple]:
    """Rows with exact and near copies, a hot source, secrets, licenses, nulls, empty and long texts, and clashing extra columns."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgheiou") for _ in range(r.randint(1, 7))) for _ in range(400)]
    texts: list = []
    for k in range(n):
        kind = k % 8
        own = [r.choice(words) for _ in range(r.choice([1, 3, 4, 5, 6, 40, 120, 300]))]
        if kind == 1 and texts:
            texts.append((r.choice(texts) or "").replace(" ", "\n \t", 3))
        elif kind == 2 and texts:
            near = (r.choice(texts) or "x").split(" ")
            near[r.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
        elif kind == 3:
            own.insert(r.randrange(len(own)), r.choice(["password = hunter2secret", "API_key:'abc'", "Token=token:abcdef1", "AKIA" + "Z" * 16, "AKIAAKIA", "0123456789abcdef01234567", "ghp_" + "a" * 36, "https://me:pass1234@host"]))
            texts.append(" ".join(own))
        elif kind == 4:
            own.insert(r.randrange(len(own)), r.choice(["MIT License", "the Apache-License, version 2.0", "ccé by CC BY-SA 4.0", "under the GNU General Public License version 3", "all rights reserved"]))
            texts.append(" ".join(own))
        else:
            texts.append(" ".join(own))
    texts += ["", None, " \n ", "a", "A", "a  b", "é中\U0001f600 mixed   x", "<|endoftext|> marks", "one two three four", "ONE two three four", "Orre " * 400, "x" * 30_000, "hot copy of one text " * 9]
    texts += ["hot copy of one text " * 9] * 60
    rows = [(i * 3 - 30, t, r.choice(["en", "de", None]), "hot" if i % 3 == 0 else r.choice(["s1", "s2", "sé", "S", None]), None, "clash", "x", 7) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def odd(spark):
    """A null identifier and repeated rows."""
    a = (1, "same text here", "en", "s", 3, "k", "i", 1)
    return spark.createDataFrame([a, a, a, (None, "same  text here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (5, "other", "en", "s", None, "k", "i", 1)], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
