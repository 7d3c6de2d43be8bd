import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def corpus():
    """The smallest documents table as (doc_id, text, lang)."""
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows]


@pytest.fixture(scope="session")
def odd_rows(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows and ids, a clashing extra column."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    body = "one two three four five six seven eight nine ten eleven twelve " * 6
    rows = [
        (1, None, "en", None, 5.0),
        (2, "", None, "s", None),
        (3, " \t\n", "en", "s", 1.0),
        (4, long, "en", "s", 1.0),
        (5, body, "de", "s", 1.0),
        (6, body, "de", "s", 1.0),
        (6, body, "de", "s", 1.0),
        (7, "mail a@b.cd, 10.0.0.1 or +1 (988) 555-2485\x1c<|endoftext|> é中😀", "en", "s", 1.0),
        (None, "no id here but some words", "en", "s", 1.0),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")


@pytest.fixture(scope="session")
def no_rows(odd_rows):
    return odd_rows.limit(0)
