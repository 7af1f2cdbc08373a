from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside; they must not get in the way.
        T.StructField("row", T.StringType()),
        T.StructField("node", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("place", T.StringType()),
    ]
)
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
MAIL = "Ask anna.b+c@mail.example.org or call +1 (212) 555-7788, card 4111 1111 1111 1111 from 10.0.0.255."
ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Ünïcode 𝔘𝔫𝔦 word",
    "Released under the MIT License. CC BY-NC 4.0, Apache License, Version 2.0!",
    MAIL,
    MAIL,
    LONG,
    LONG + " tail",
    "a a a a a a a a",
    "don't you're 's <|endoftext|> x  y\n\n'tis 'll",
    "you idiot you worthless scum",
]


def odd_rows(texts=ODD_TEXTS):
    """Nulls everywhere, a repeated row, a repeated id and columns with clashing names."""
    rows = [
        (k, t, None if k % 3 else "en", None if k % 4 == 3 else f"s{k % 3}", None, "r", "n", None, "k", "p")
        for k, t in enumerate(texts)
    ]
    return [*rows, rows[6], (None, "no id here at all", *rows[0][2:]), (3, "same id", *rows[0][2:])]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCUMENT)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENT)


@pytest.fixture(scope="session")
def documents():
    rows = duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()
    return {i: (t, s) for i, t, s in rows}
