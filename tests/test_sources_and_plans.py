import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evalloom.plans import evaluation
from evalloom.sources import io

SF = "/root/testdata/sf0.001"


def test_jsonl_skips_broken_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nbroken\n[1]\n{"a": 2, "b": "x"}\n{"a": 3\n')
    got = io.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()
    assert sorted((r.a, r.b) for r in got) == [(1, None), (2, "x")]
    assert io.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_tables(spark, tmp_path):
    io.write_csv(spark.createDataFrame([(1, ["a", "b"])], "k int, l array<string>"), str(tmp_path / "t.csv"))
    assert io.read_table(spark, str(tmp_path / "t.csv"), ("k",)).first().l == "a|b"
    with pytest.raises(ValueError):
        io.read_table(spark, str(tmp_path / "t.csv"), ("missing",))
    with pytest.raises(ValueError):
        io.read_table(spark, "x.xls")


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.xyz").write_text("?")
    (tmp_path / "c.txt").write_text(" ")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    got = {r.source: (r.text, r.status) for r in io.read_documents(files).collect()}
    assert got["a.txt"] == ("=== DOKUMENT START: a.txt ===\nhello\n=== DOKUMENT ENDE ===", "ok")
    assert got["b.xyz"] == (None, "unsupported") and got["c.txt"] == (None, "empty")
    first = io.fingerprint(files).first().fingerprint
    (tmp_path / "a.txt").write_text("hullo")
    assert io.fingerprint(spark.read.format("binaryFile").load(str(tmp_path))).first().fingerprint != first
    assert io.needs_rebuild(True, {"fingerprint": first, "settings": {"k": 1}}, first, {"k": 1}) == "up_to_date"
    assert io.needs_rebuild(True, {"fingerprint": first, "settings": {"k": 1}}, first, {"k": 2}) == "rebuilt:settings"
    assert io.text_folder(spark, str(tmp_path)).count() == 2


def test_questions(spark):
    rows = spark.createDataFrame([("1", " What? ", "A", "B", None), (None, "x", "", "", "Extraktion")], "id string, question string, atomic_fact_1 string, atomic_fact_2 string, answer_type string")
    got = io.questions(rows).collect()
    assert [(r.id, r.question, r.atomic_facts) for r in got] == [("1", "What?", ["A", "B"])]
    with pytest.raises(ValueError):
        io.validate_questions(rows)


def test_resume_answers_only_failed_tasks(spark, tmp_path):
    plan = spark.createDataFrame([("m", "q1", "RAG", 1, "p1"), ("m", "q2", "RAG", 1, "p2")], "model string, question_id string, method string, run_number int, prompt string")
    path = str(tmp_path / "ck")

    def flaky(model, prompt):
        if prompt == "p2":
            raise RuntimeError("api down")
        return "ok", 1, 2

    with pytest.raises(RuntimeError):
        evaluation.run_benchmark(spark, plan, flaky, path, max_failures=0)
    got = evaluation.run_benchmark(spark, plan, lambda model, prompt: ("again", 1, 2), path).collect()
    assert {(r.question_id, r.llm_answer, r.error) for r in got} == {("q1", "ok", ""), ("q2", "again", "")}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rrf_hybrid", "retrieval_hit_mrr", "rerank_topk", "embedding_consistency"])
def test_whole_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, SF).collect()]
    near = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert near(got) == near([tuple(float(x) if type(x).__name__ == "Decimal" else x for x in r) for r in want])
    assert "substr" not in entry.oracle_sql()[name]


def test_lexical_lists_use_terms_beyond_a_prefix(spark, tmp_path):
    """Document 0 shares only its last word with document 2: that counts for lexical ranks and the rerank."""
    docs = [(0, "alpha " * 12 + "omega", "s"), (1, "alpha beta", "s"), (2, "omega gamma", "s"), (3, "delta", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    queries = entry.queries()
    assert {"0", "1", "2"} == {r.chunk_id for r in queries["rrf_hybrid"](spark, str(tmp_path)).collect()}
    assert {"0", "1", "2"} == {r.chunk_id for r in queries["rerank_topk"](spark, str(tmp_path)).collect()}
