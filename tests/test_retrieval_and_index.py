"""Block search, the stored index and its swap, and the retriever's modes, degradation, filter and context."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import ranking, retrieval, vectors
from evalloom.sources import vector_index as X

KIND = "vec_id long, embedding array<float>"


def cloud(spark, n=300, dim=3, seed=4):
    x = np.random.default_rng(seed).integers(-3, 4, (n, dim)).astype(float)  # many ties
    rows = [(i, a.tolist()) for i, a in enumerate(x)] + [(900, None), (901, [1.0])]
    v = spark.createDataFrame(rows, KIND).repartition(3)
    q = v.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    want = {(i, k + 1): j for i in range(20) for k, j in enumerate(sorted(range(n), key=lambda j: (((x[j] - x[i]) ** 2).sum(), j))[:5])}
    return v, q, want


def ranked(df):
    return {(r.query_id, r["rank"]): r.vec_id for r in df.collect()}


@pytest.mark.parametrize(("query_bytes", "vector_bytes"), [(1 << 20, 1 << 20), (100, 1 << 20), (1 << 20, 700), (150, 900)])
def test_block_search_is_exact_however_it_is_cut(spark, query_bytes, vector_bytes):
    v, q, want = cloud(spark)
    assert ranked(vectors.vector_search(v, q, 5, query_bytes, vector_bytes)) == want


def test_index_search(spark, tmp_path, monkeypatch):
    v, q, want = cloud(spark)
    path = str(tmp_path / "index")
    assert X.open_index(spark, path) is None
    X.write_index(v, path, cells=8)
    monkeypatch.setattr(X, "BLOCK", 7)  # cells meet queries in several blocks
    index = X.open_index(spark, path)
    assert sum(index.sizes.values()) == 302 and index.sizes[-1] == 2
    assert ranked(index.search(q, 5)) == want
    some = ranked(index.search(q, 5, probes=3))
    assert sum(some.get(k) == j for k, j in want.items()) > 60
    short = spark.createDataFrame([(1, [0.5])], "query_id long, query array<float>")
    assert ranked(index.search(short, 5)) == {(1, 1): 901}


def test_index_reads_only_visited_cells(spark, tmp_path):
    v, q, _ = cloud(spark)
    path = str(tmp_path / "index")
    X.write_index(v, path, cells=8)
    index = X.open_index(spark, path)
    plan = index.search(q.where("query_id = 1"), 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() or "PartitionFilters: [isnotnull(cell" in plan


def test_a_failed_write_leaves_the_index(spark, tmp_path):
    v, q, want = cloud(spark)
    path = str(tmp_path / "index")
    first = X.write_index(v, path, cells=4)
    broken = v.withColumn("vec_id", F.when(F.col("vec_id") < 290, F.col("vec_id")).otherwise(F.raise_error(F.lit("no vector")).cast("long")))
    with pytest.raises(Exception, match="no vector"):
        X.write_index(broken, path, cells=4)
    assert (tmp_path / "index" / "CURRENT").read_text() == first
    assert ranked(X.open_index(spark, path).search(q, 5)) == want
    second = X.write_index(v.where("vec_id < 10"), path, cells=4)
    assert sorted(p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("v-")) == [second]


def test_rebuild_decision(spark, tmp_path):
    v, *_ = cloud(spark)
    path, built = str(tmp_path / "index"), []

    def build():
        built.append(1)
        return v

    ensure = lambda fingerprint, settings, enabled=True: X.ensure_index(spark, path, fingerprint, settings, build, enabled, cells=4)
    assert ensure("a", {"size": 400}, enabled=False) == (False, "auto_reindex_disabled")
    assert ensure("a", {"size": 400}) == (True, "rebuilt")
    assert ensure("a", {"size": 400}) == (False, "up_to_date")
    assert ensure("b", {"size": 400}) == (True, "rebuilt")
    assert ensure("b", {"size": 500}) == (True, "rebuilt")
    (tmp_path / "index" / "CURRENT").write_text("v-none")
    assert ensure("b", {"size": 500}) == (True, "rebuilt") and len(built) == 4


CHUNKS = [("a", "File_rot.txt", 0, "rot apfel kirsche"), ("b", "File_Blau.txt", 1, "blau himmel"), ("c", "gesetz.txt", 2, "apfel gesetz"), ("d", "gesetz.txt", 3, "apfel apfel verordnung")]
POINTS = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.8, 0.1]), ("d", [0.5, 0.5])]


@pytest.fixture
def sides(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, source string, ord long, chunk string")
    points = spark.createDataFrame(POINTS, "chunk_id string, embedding array<float>")
    return retrieval.lexical(ranking.Bm25Index(chunks), chunks, fallback=False), retrieval.by_vectors(chunks, points)


def ask(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, query string, vector array<float>")


def test_each_query_degrades_by_itself(spark, sides):
    queries = ask(spark, (1, "apfel", [1.0, 0.0]), (2, "nirgends", [0.0, 1.0]), (3, "himmel", None), (4, "nirgends", None))
    r = retrieval.Retriever(*sides, k=3)
    rows = r.retrieve(queries, rerank=False).collect()
    assert {x.query_id: x.engine for x in rows} == {1: "hybrid", 2: "vector", 3: "lexical"}
    # One side alone: its own order and scores.
    assert [(x.chunk_id, round(x.score, 6)) for x in sorted(rows, key=lambda x: x["rank"]) if x.query_id == 2] == [("b", 0.0), ("d", 0.5), ("c", 1.45), ("a", 2.0)]
    top = {(x.query_id, x["rank"]): x.chunk_id for x in r.retrieve(queries).collect()}
    assert (top[2, 1], top[3, 1]) == ("b", "b") and {k for k, _ in top} == {1, 2, 3}


def test_payload_comes_from_the_more_relevant_side(spark):
    kind = "query_id int, rank int, chunk_id string, source string, chunk string, score double"
    lex = spark.createDataFrame([(1, 1, "x", "s", "from words", 0.2), (1, 2, "y", "s", "from words", 0.5)], kind)
    vec = spark.createDataFrame([(1, 1, "x", "s", "from vectors", 0.25), (1, 2, "y", "s", "from vectors", 1.0)], kind)
    got = {r.chunk_id: r for r in ranking.fuse(lex, vec).collect()}
    assert (got["x"].chunk, got["x"].engine, got["x"].score) == ("from vectors", "vector", 0.25)  # 1 / 1.25 > 0.2
    assert (got["y"].chunk, got["y"].engine, got["y"].score) == ("from words", "lexical", 0.5)  # a tie stays with words
    assert got["x"].fusion == pytest.approx(2 / 61)


def test_filter_isolates_a_source(spark, sides):
    queries = ask(spark, (1, "apfel", [0.0, 1.0]))
    for mode in retrieval.MODES:
        row = retrieval.Retriever(*sides, mode=mode).context(queries, "File_rot.txt").first()
        assert "rot" in row.context and row.sources == ["File_rot.txt"], mode


def test_modes_and_context(spark, sides):
    queries = ask(spark, (1, "apfel", [1.0, 0.0]), (9, "", None))
    words = retrieval.Retriever(*sides, mode="lexical_only", k=2)
    assert {r.engine for r in words.retrieve(queries).collect()} == {"lexical"}
    assert retrieval.Retriever(*sides, mode="else").mode == "hybrid"
    got = {r.query_id: r for r in words.context(queries).collect()}
    assert got[1].context.count("\n\n---\n\n") == 1 and len(got[1].sources) == 2
    assert (got[9].context, got[9].sources) == ("", [])
    assert retrieval.Retriever(mode="hybrid").retrieve(queries).count() == 0
    assert retrieval.Retriever(*sides, candidates=3, k=70).candidates == 70


def test_hits_ignore_case_and_blanks(spark):
    seen = spark.createDataFrame([("m", 1, 1, " A.txt "), ("m", 1, 2, "b.txt"), ("m", 2, 7, "B.TXT"), ("m", 3, 1, "")], "mode string, query_id int, rank int, item string")
    wanted = spark.createDataFrame([(1, "a.TXT"), (2, "b.txt"), (2, "B.txt "), (3, "c")], "query_id int, item string")
    r = ranking.hit_and_mrr(seen, wanted).first()
    assert (r.n_queries, r.hit_at_5, r.mrr_at_10) == (3, 0.333333, round((1 + 1 / 7) / 3, 6))
