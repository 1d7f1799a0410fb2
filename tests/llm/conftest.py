import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, size string, n string, digest string, score string, h string, slot int, label string, fp string"
)
PROSE = "the quick brown fox jumps over the lazy dog and runs along the river bank until night falls. " * 6


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    texts = [
        None, "", "", " \n\t ", "Same Text", "same text", "SAME TEXT", "Ärger ÄRGER", "ärger ärger", "one", "one two three four",
        "one two three four five", PROSE, PROSE, PROSE + "end", "x" * 50_000, "word " * 30_000, "a b c " * 10, "line\nline\nline\nother line here",
        "mail me at a.b@c.de or (1.2.3.4)", "İstanbul ß ſ K", "\u0301combining\u00a0nbsp", "### $$$ %%% &&& ||| <<<",
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 3 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [(4, "Same Text", "en", "s1", None)] * 2  # the same row again
    rows.append((None, "no id", "en", "s2", None))
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "d", "s", "h", 7, "l", "f") for r in edge_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def sf_rows(sf_docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in sf_docs.collect()]
