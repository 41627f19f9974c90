import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, size string, place string, shard string, row string"


def words(rng, n, letters="abcdefgh"):
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))][0].split()


def corpus():
    """Texts of every kind: null, empty, blank, very long, copies, near copies, shared passages, repeated rows, no id."""
    rng = random.Random(5)
    passage = words(rng, 90)
    base = words(rng, 160)
    texts = [None, "", " \t\n ", "one", "Ünï çødé   日本語テキスト!", "a" * 3000, ("ab " * 700).strip()]
    for i in range(12):
        texts.append(" ".join(words(rng, rng.randint(5, 200))))
    for i in range(6):  # near copies
        other = list(base)
        for j in range(i):
            other[rng.randrange(160)] = f"edit{i}{j}"
        texts.append(" ".join(other).upper() if i == 3 else "\n".join(other))
    for i in range(5):  # a passage within others' words
        texts.append(" ".join(words(rng, 20 + i) + passage[i:] + words(rng, 30)))
    texts += [texts[8]] * 3 + [texts[20]] * 2  # copies
    texts.append(" ".join(words(rng, 9000)) + " " + " ".join(passage) + " " + "z" * 5000)
    texts.append(" ".join(passage + words(rng, 10) + passage))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(9, texts[9]), (9, texts[9]), (None, texts[10]), (None, None), (8, texts[11])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    out = spark.createDataFrame([(i, t, "ab"[len(t or "") % 2], f"s{len(t or '') % 3}" if t else None, len(t or ""), "k", "i", "s", "p", "h", "r")
                                 for i, t in rows], SCHEMA)
    return out.repartition(3, F.length("text"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(df):
    return sorted(map(tuple, df.collect()), key=repr)
