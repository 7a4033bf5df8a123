import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names the operators use themselves
    T.StructField("shard", T.IntegerType()), T.StructField("part", T.StringType()),
    T.StructField("_bucket", T.IntegerType()), T.StructField("fp", T.LongType()),
])
WORDS = "thon eres blet andor wher ing tion sher ouat hely ndes reath onti leer".split()


def prose(seed: int, n: int) -> str:
    return " ".join(random.Random(seed).choices(WORDS, k=n))


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 3, "x", 1, 9) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = "\n".join(prose(k, 60) for k in range(400))
    return [
        (5, None), (1, ""), (2, prose(2, 30)), (2, prose(2, 30)), (3, prose(3, 40) + "\n\n" + prose(4, 9)), (4, long),
        (None, prose(9, 12)), (7, "Été 中文 \x1c x"), (8, prose(3, 40) + "\n\n" + prose(4, 9)), (9, "   "), (10, "a"),
        (11, "password = Abcdef123456789 AKIA" + "Z" * 16),
    ]
