"""The path without broadcasts: the same report, and no task that holds all documents' own rows."""

import random

import pytest
from pyspark.sql import functions as F

from evalloom.llm import decontamination as D


@pytest.fixture
def shuffled(spark, monkeypatch):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def tables(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(f"w{rnd.randrange(300)}" for _ in range(n))
    items = [(f"i{i}", words(rnd.choice([3, 13, 30]))) for i in range(20)]
    docs = [(i, words(60) + (" " + rnd.choice(items)[1] if i % 3 == 0 else "")) for i in range(300)] + [(1, "same"), (1, "same"), (None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id string, text string")


def test_same_report(spark, monkeypatch):
    docs, items = tables(spark)
    rows = lambda: sorted(map(str, D.report(docs, items).drop("th").collect()))
    want = rows()
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows() == want and len(want) == 303
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_own_rows_of_documents_are_dealt_out(spark, shuffled):
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("the same short text").alias("text"))
    items = spark.createDataFrame([("i", " ".join(f"x{i}" for i in range(20)))], "item_id string, text string")
    plan = D.contaminated_spans(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    keys = docs.select(F.xxhash64(F.xxhash64("text"), F.monotonically_increasing_id()).alias("k")).repartition(8, "k").groupBy(F.spark_partition_id()).count().collect()
    assert len(keys) == 8 and max(r["count"] for r in keys) < 2000
