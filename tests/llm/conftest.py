import re

import pytest

LONG = " ".join(f"w{i % 977} the of and" for i in range(30_000))
#: (doc_id, text): nulls, blanks, ties, copies, very long texts, odd characters.
EDGE = [
    (0, None),
    (1, ""),
    (2, " \t\n "),
    (3, "one"),
    (4, "ONE"),
    (5, "one two three"),
    (6, "one  two\tthree"),
    (7, LONG),
    (8, LONG),
    (9, LONG + " tail"),
    (10, "a " * 60),
    (11, "x\u00a0y\u2028z\x1cq \u0130\u00df \U0001f600 <|endoftext|> it's  don't"),
    (12, "nachtigall " * 3 + "über äcker"),
    (13, "1234 5678 -- ++ 42"),
    (14, " ".join(f"u{i}" for i in range(300))),
    (15, " ".join(f"u{i}" for i in range(299)) + " changed"),
    (16, " ".join(f"u{i}" for i in range(150)) + " " + " ".join(f"v{i}" for i in range(150))),
    (-5, "one two three"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, block string, rank int, node string, _spans int, lang_pred int"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def documents(spark, rows=EDGE):
    sources = ["a", None, "b", "\U0001f600", "a\u00e9"]
    langs = ["en", None, "de"]
    return spark.createDataFrame([(i, t, langs[k % 3], sources[k % 5], len(t or ""), k, "b", k, "n", k, k) for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark)


@pytest.fixture(scope="session")
def none(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    """The smallest table's documents and the edge cases under ids of their own."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = documents(spark, [(i + 1_000_000, t) for i, t in EDGE]).select(given.columns)
    return given.unionByName(more).cache()


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
