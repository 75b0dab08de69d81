import os

import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()

#: documents with columns whose names clash with those that operators use inside.
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("id", "tokens", "sid", "line", "h1", "k", "rank", "block", "size", "keep", "removed", "node", "bit", "v")]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = [(*(tuple(r) + ("en", "a")[len(r) - 2 :]), len(r[1]) if r[1] is not None else None, *["x"] * 14) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def prose():
    """Distinct documents of invented words."""
    import random

    def text(seed, words=120, per_line=12):
        r = random.Random(seed)
        ws = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(words)]
        return "\n".join(" ".join(ws[i : i + per_line]) for i in range(0, words, per_line))

    return text
