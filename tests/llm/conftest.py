from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
ODD = [
    (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one two three"), (900005, "ONE two Three"), (900006, "x" * 6_000), (900007, "word " * 20_000),
    (900008, "7" * 5_000), (900009, "a b c d e f g h i j k\na b c d e f g h i j k\na b c"), (900010, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 na\u00efve"),
    (900011, "Licensed under the MIT License. Apache License, Version 2.0; CC-BY-NC under the mit license"), (900012, "mail a@b.co, x@y.z.org card 4111 1111 1111 1111 ip 10.0.0.255 tel +44 (20) 7946-0958 bad 300.1.1.1"),
    (900012, "the same id twice"), (None, "a row without an id but with a good number of words in it"), (900013, "iban DE89 3704 0044 0532 0130 00 ssn 123-45-6789"),
    (900014, "\n".join(f"line {i} of a text with some words that differ {i * 7}" for i in range(3000))),
]


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def docs(spark, documents):
    """The table, odd rows added: nulls, empty and very long texts, repeated ids, and columns whose names clash with outputs."""
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    return documents.unionByName(odd).selectExpr("*", "1 AS kept", "'x' AS spans", "2 AS label", "3 AS n_words", "4 AS pii", "5 AS base", "6 AS node", "7 AS key").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
