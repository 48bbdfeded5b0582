"""Languages whose rows share a key, and queries of another length than the base."""

import pytest
from pyspark.sql import functions as F

from evalloom.llm import ann_search, language_id


@pytest.mark.parametrize("key", [1, 2, 3, 4, 5, None])
def test_a_language_of_one_key_is_learned(spark, key):
    own = [(key, f"wort{i} haus baum und der die das weg", "de") for i in range(4000)]
    other = [(i, f"word{i} house tree and the way of it", "en") for i in range(4000)]
    df = spark.createDataFrame(own + other, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("h", "r", "key", "n")})
    model = language_id.train(df, max_rows=50)
    asked = spark.createDataFrame([(1, "das haus und der baum"), (2, "the house and the tree")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "de", 2: "en"}


def test_a_row_repeated_many_times_is_one_row_of_training(spark):
    rows = [(7, "haus haus haus", "de")] * 3000 + [(i, f"baum weg {i} wald", "de") for i in range(40)] + [(i, "the house of it", "en") for i in range(5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=100)
    asked = spark.createDataFrame([(1, "baum wald"), (2, "house")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "de", 2: "en"}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "a b", str(i)) for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 2 languages"):
        language_id.train(df)


def test_queries_of_another_length_than_the_base(spark):
    base = [(i, [1.0, float(i)]) for i in range(30)] + [(100, [1.0, 2.0, 3.0])]
    asked = [(i, [1.0, 1.0, 1.0]) for i in range(200, 220)] + [(300, [0.5, 1.0])]
    kind = "vec_id long, embedding array<float>"
    clash = {c: F.lit(1) for c in ("id", "x", "bucket", "bq")}
    got = ann_search.search(spark.createDataFrame(base, kind).withColumns(clash), spark.createDataFrame(asked, kind).withColumns(clash), k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(300, 1, 29), (300, 2, 28), (300, 3, 27)]
    assert ann_search.search(spark.createDataFrame([], kind), spark.createDataFrame(asked, kind)).collect() == []
