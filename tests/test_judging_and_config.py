import pytest
from pyspark.sql import functions as F

from evalloom.__main__ import main
from evalloom.operators import judging
from evalloom.plans import config


def test_measures(spark):
    kind = "judge_text string, claim_text string, predicted_text string, KI_Antwort string, Is_Trap_Question double"
    rows = [('{"score": 3, "coverage": 0.5}', '{"supported": 2, "contradicted": 1, "not_in_scope": 1, "trap_pass": true}', '{"predicted_supported_claims": 3, "predicted_unsupported_claims": 1}', "A #1", 1.0), ("", "", "", None, 0.0), ("x", '{"supported": 4}', "", "", None)]
    a, b, c = judging.measures(spark.createDataFrame(rows, kind)).collect()
    assert (a.Likert_Score, a.Atomic_Coverage_Score, a.Support_Rate, a.Atomic_Precision, a.Trap_Pass, a.Trap_Hallucination, a.Confidence_Mean) == (3.0, 0.5, 0.5, 0.75, 1.0, 0.0, 1.0)
    assert (b.Likert_Score, b.Support_Rate, b.Atomic_Precision, b.Trap_Pass, b.Confidence_Found_Flag) == (None, 0.0, None, None, 0)
    assert (c.Likert_Score, c.Atomic_Coverage_Score) == (4.0, 1.0)


def test_judge_calls(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return prompt.upper(), 1, 2

    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "id int, judge_prompt string")
    got = {r.id: r for r in judging.judge(df, client).collect()}
    assert (got[1].judge_text, got[1].judge_output_tokens, got[1].judge_issue) == ("OK", 2, "")
    assert got[2].judge_issue == "API Error: down"
    assert spark.createDataFrame([("api error: x",), ("fine",), (None,)], "r string").where(judging.has_issue(F.col("r"))).count() == 1


def test_fallback_context(spark):
    some = spark.createDataFrame([(1, "own"), (2, "")], "query_id int, context string")
    other = spark.createDataFrame([(1, "all"), (2, "all"), (3, "all")], "query_id int, context string")
    assert {r.query_id: r.context for r in judging.with_fallback(some, other).collect()} == {1: "own", 2: "all", 3: "all"}


@pytest.mark.parametrize("text,value", [("6,000", 6000), ("0,5", 0.5), ("1.200", 1200), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("-3", -3)])
def test_numbers(text, value):
    assert config.number(text) == value


def test_config():
    got = config.load([{"key": "max_prompt_chars", "value": "6,000"}, {"key": "temperature", "value": "0,5"}, {"key": "use_rag", "value": "nein"}, {"key": "num_runs", "value": float("nan")}, {"key": "", "value": 1}], [{"model": "m", "enabled": "ja", "temperature": "0,1"}, {"model": "n", "enabled": 0}], [{"method": "RAG"}, {"method": "Other"}])
    assert (got["max_prompt_chars"], got["temperature"], got["use_rag"], got["num_runs"], got["models"], got["model_temperatures"], got["methods"]) == (6000, 0.5, False, 5, ["m"], {"m": 0.1}, ["RAG"])
    t = config.template()
    assert config.load(t["settings"], [], t["methods"])["methods"] == list(config.METHODS)
    assert config.digest({"b": 1, "a": 2}) == config.digest({"a": 2, "b": 1})


def test_command_line(spark, tmp_path):
    base, patch = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string")
    base.write.parquet(str(tmp_path / "b"))
    patch.write.parquet(str(tmp_path / "p"))
    main(["merge", str(tmp_path / "b"), str(tmp_path / "p"), "k", str(tmp_path / "o")])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == [(1, "a"), (2, "z")]
