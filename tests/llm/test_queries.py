"""Every registered query in its own form, over whole tables, and odd bytes."""

import pytest

from vecgrove.llm import registry

COLUMNS = {
    "op1": ("pages", ["page_id", "text"]),
    "op2": ("documents", ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]),
    "op3": ("documents", ["doc_id", "held_out", "score", "predicted"]),
    "op4": ("documents", ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]),
    "op5": ("documents", ["doc_id", "size", "source_size", "target", "taken"]),
    "op6": ("pages", ["page_id", "host", "path", "rule", "verdict"]),
    "op7": ("documents", ["doc_id", "score", "kept"]),
    "op8": ("documents", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    "op9": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op10": ("documents", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
}


def test_one_query_per_operator():
    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted(COLUMNS)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_form(spark, sf, name):
    table, columns = COLUMNS[name.split("_")[0]]
    out = registry.QUERIES[name](spark, sf)
    assert set(columns) <= set(out.columns)
    ids = [r[0] for r in out.select(columns[0]).collect()]
    want = [r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(columns[0]).collect()]
    assert sorted(set(ids)) == sorted(want) if name.startswith("op8") else sorted(ids) == sorted(want)
    kinds = dict(out.dtypes)
    for c in columns:
        if c in ("score", "target"):
            assert kinds[c] == "double"
        elif c in ("kept", "held_out", "base_failed"):
            assert kinds[c] == "boolean"
        elif c == "predicted":
            assert kinds[c] == "int"
        elif c in ("text", "text_sha256", "host", "path", "rule", "verdict", "fingerprint", "base_sha256", "spans"):
            assert kinds[c] == "string"
        else:
            assert kinds[c] == "bigint"


def test_bytes_that_are_no_utf8(spark, sf):
    """Such texts give rows like any other."""
    from vecgrove.llm import exact_dedup, html_text, line_quality, near_copies, packing, simhash, toxicity, weak_quality

    raw = "X'c328ff20776f72642061c3'"
    docs = spark.sql(f"SELECT 1L AS doc_id, cast({raw} AS string) AS text UNION ALL SELECT 2L, 'plain words here'")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, toxic int, quality int")
    for out in (
        toxicity.toxicity(docs, labels), line_quality.line_quality(docs, labels), weak_quality.weak_quality(docs),
        packing.pack(docs), simhash.near_duplicates(docs), near_copies.near_copies(docs), exact_dedup.exact_dedup(docs), html_text.extract(docs, "doc_id", "text"),
    ):
        assert len(out.collect()) == 2
    assert toxicity.without_toxic(docs, labels).count() <= 2


def test_tables_in_between_go_with_the_application(spark, tmp_path):
    from vecgrove.sources import shared

    df = shared.stored(spark.range(3), "some")
    assert f"/vecgrove-{spark.sparkContext.applicationId}/" in df._stored_at and df.count() == 3
    shared.forget(df)
    assert not shared.files.exists(spark, df._stored_at)
