import pytest

#: Names that operators use inside; inputs may have them too.
CLASHING = "fp host size blob c key node root words x w source_rank lane stack spans base start end kept url"

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """Documents of (doc_id, text, source), with extra columns under clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(
        [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOC_SCHEMA
    )
    return df.withColumns({n: F.lit("clash") for n in CLASHING.split()})


LONG = " ".join(f"w{i % 997}" for i in range(60_000))
EDGES = [
    (1, None, "a"),
    (2, "", None),
    (3, " \n\t ", "a"),
    (4, "one", "a"),
    (5, LONG, "b"),
    (6, "same text here for all of them to share in full", "b"),
    (6, "same text here for all of them to share in full", "b"),
    (7, "same text here for all of them to share in full", None),
    (None, "a text without an id that is long enough to be kept by rules", "a"),
    (8, "Ünïcödé 🙂 text with ſ and K signs, more than ten words in it here", "c"),
]


@pytest.fixture()
def edges(spark):
    return documents(spark, EDGES)


@pytest.fixture()
def nothing(spark):
    return documents(spark, []).limit(0)


@pytest.fixture(scope="session")
def small_docs():
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"]) for r in rows]
