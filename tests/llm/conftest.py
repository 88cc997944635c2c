import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 7919} and{i % 13}." + ("\n" if i % 12 == 0 else "") for i in range(60_000))
#: Columns that have the names the operators use for their own.
CLASHES = (
    "key", "kept", "score", "n_tokens", "component_id", "node", "bucket", "n", "rows", "language", "spans",
    "items", "lines", "dedup", "lang_pred", "held_out", "found", "tokens", "token", "base", "first", "slice",
)
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.\nA second line of text."),
    (2, None), (3, ""), (4, " \n\t "), (None, "a text without an id, of a few words, which nobody owns"),
    (5, "a repeated row of a few words in one line"), (5, "a repeated row of a few words in one line"),
    (5, "another text of the same document"), (6, LONG), (7, LONG + " more"), (8, "été 你好 \U0001f600 \x1c x\x85y"),
    (9, "12 34 !!"), (10, "The quick brown fox jumps over the lazy dog near the river bank today.\nA third line."),
]


def frame(spark, rows, lang="en"):
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
              T.StructField("lang", T.StringType())]
    fields += [T.StructField(c, T.StringType()) for c in CLASHES]
    return spark.createDataFrame(
        [(i, t, lang, *["x"] * len(CLASHES)) for i, t in rows], T.StructType(fields))


@pytest.fixture(scope="session")
def edges(spark):
    return frame(spark, EDGES)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents(spark):
    from logvigil.llm.stages import table
    return table(spark, SF_DIR, "documents")


@pytest.fixture(scope="session")
def rows(documents):
    return documents.orderBy("doc_id").collect()
