"""The pipeline over odd tables: empty, all null, repeated rows, long texts, extra columns with clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("h", "key", "words", "batch", "row", "th", "size", "taken", "lang_pred", "score", "items")


def put(spark, folder, docs, extra=False):
    df = spark.createDataFrame(docs, DOCS)
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in CLASH})
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([("i1", " ".join(f"bench{i}" for i in range(30)))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def text(seed, n=80):
    r = random.Random(seed)
    return " ".join(r.choice(["house", "river", "garden", "window", "letter", "morning", "street", "paper", "number", "colour", "winter", "people"]) + "abcdefghij"[r.randrange(10)] for _ in range(n)) + "."


@pytest.mark.parametrize("docs", [[], [(None, None, None, None, None)] * 3, [(1, "", "en", "a", 0), (2, " \n ", None, None, 0), (3, "123 456", "en", "b", 7)]])
def test_tables_without_text_give_no_rows(spark, tmp_path, docs):
    out = C.run(spark, put(spark, tmp_path, docs))
    assert out.count() == 0 and {"doc_id", "size", "source_size", "target", "taken"} <= set(out.columns)


def test_nulls_repeats_long_texts_and_clashes(spark, tmp_path):
    clean = [(i, text(i), "en", "ab"[i % 2], 1) for i in range(12)]
    docs = [*clean, clean[0], clean[0], (20, text(3), "en", "b", 2), (None, text(50), "en", None, None), (21, text(60, 20_000), "en", "a", None), (22, text(61), None, "a", 1), (23, " ".join(f"bench{i}" for i in range(30)), "en", "a", 1)]
    sf = put(spark, tmp_path, docs, extra=True)
    rows = C.run(spark, sf).collect()
    ids = sorted(str(r.doc_id) for r in rows)
    # Of equal rows and equal texts one stays; the benchmark passage goes; null ids and null languages stay.
    assert len(set(ids)) == len(ids) and "23" not in ids
    assert {"None", "21", "22"} <= set(ids) and len({"3", "20"} & set(ids)) == 1
    assert set(map(str, range(12))) - {"3"} <= set(ids)
    stage = C.identify_language(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert stage.columns == [*DOCS.replace(",", "").split()[::2], *CLASH]
