"""Templates, judge prompts and hashes, the judge cache, patch merges, batches of a run and the table of a stream."""

import hashlib

import pytest
from pyspark.sql import functions as F

from evalloom.operators import reports, tasks
from evalloom.plans import evaluation
from evalloom.plans import prompting as P
from evalloom.streaming import scoring as streaming

TEMPLATE = "FRAGE: {question}\nFACTS:\n{facts_block}\nANTWORT:\n{generated}\n{trap_instructions}"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def prompt(spark, method="Zero-Shot", question="Frage?", facts=None, templates=None, **texts):
    columns = {k: F.lit(v) for k, v in texts.items() if not k.startswith("max_c")}
    limits = {k: v for k, v in texts.items() if k.startswith("max_c")}
    listed = F.array(*map(F.lit, facts)) if facts else None
    return one(spark, P.build_prompt(F.lit(method), F.lit(question), facts=listed, templates=templates, **columns, **limits))


def test_word_limits(spark):
    assert prompt(spark, max_words="25") == "\nFRAGE: Frage?\n\nFasse dich kurz. Max 25 Woerter."
    assert prompt(spark, max_words=" nur den Buchstaben ").endswith("Zusatzregel zur Laenge: nur den Buchstaben")


def test_methods_documents_and_context(spark):
    assert prompt(spark, "RAG", input_doc="DOC", context="c" * 10, max_context=4) == "Nutze ZUSAETZLICHES WISSEN aus der Datenbank, um die Frage zu beantworten:\n\nKONTEXT:\ncccc\n\n\nACHTUNG - DOKUMENT/INPUT:\nDOC\n\nFRAGE: Frage?"
    assert prompt(spark, "Other") == "\nFRAGE: Frage?"
    assert prompt(spark, question="x" * 50, max_chars=20) == "\nFRAGE: " + "x" * 12 + P.CUT_NOTE


@pytest.mark.parametrize(("kind", "facts", "ends"), [("Wahr/Falsch", ["f"], P.ONLY_BINARY), ("Atomic Facts", None, P.ONLY_FACTS), ("Freitext", ["f"], P.FREE_TEXT + P.AS_FACTS), ("", None, "Frage?")])
def test_rules_by_answer_type(spark, kind, facts, ends):
    assert prompt(spark, facts=facts, answer_type=kind).endswith(ends)


@pytest.mark.parametrize("template", ["{nobody}", "{0}", "{question:>5}", "open {", "{}", "{question!r}"])
def test_a_template_that_fails_gives_the_plain_prompt(spark, template):
    assert prompt(spark, templates={"Zero-Shot": template}) == "\nFRAGE: Frage?"


def test_braces_and_template_text_stay(spark):
    assert prompt(spark, templates={"Zero-Shot": "{{json}} {question} {question}"}) == "{json} Frage? Frage?"
    assert prompt(spark, question="{input_section}") == "\nFRAGE: {input_section}"


def test_templates_are_loaded_over_the_defaults(spark, tmp_path):
    (tmp_path / "own.txt").write_text("\nOWN {question}\n")
    (tmp_path / "empty.txt").write_text(" ")
    got = P.load_templates(spark, {"RAG": str(tmp_path / "own.txt"), "Zero-Shot": str(tmp_path / "empty.txt"), "Advanced-Prompt": str(tmp_path / "none.txt"), "X": ""})
    assert got == P.DEFAULT_TEMPLATES | {"RAG": "OWN {question}"}
    assert P.templates_hash({"b": "2", "a": "1"}) == hashlib.sha256(b"a\n1\nb\n2").hexdigest()


def test_judge_prompts(spark):
    facts = F.array(F.lit("f1"), F.lit("f2"))
    judge = lambda template=None, trap=False, expected="": one(spark, P.judge_prompt(F.lit("Q"), F.lit("A"), facts, template, F.lit(trap), F.lit(expected)))
    assert judge(TEMPLATE) == "FRAGE: Q\nFACTS:\n- f1\n- f2\nANTWORT:\nA\n"
    trap = judge(TEMPLATE, True, " erkennt es ")
    assert trap.startswith("FRAGE: Q") and trap.endswith("Erwartetes Fangfragen-Verhalten:\nerkennt es") and trap.count("FANGFRAGEN-BEWERTUNG") == 1
    # A template without instructions gets them at its end.
    assert judge("{question} ", True).startswith("Q\n\nFANGFRAGEN-BEWERTUNG") and judge("{question} ") == "Q "
    assert judge("{broken", False) == judge()
    assert "ATOMIC FACTS (Goldstandard):\n- f1\n- f2\n" in judge() and "(keine Facts)" in one(spark, P.judge_prompt(F.lit("Q"), F.lit("A"), F.array().cast("array<string>")))


def test_cached_judgements_need_the_same_prompt(spark):
    h = one(spark, P.judge_prompt_hash(TEMPLATE))
    assert len(h) == 64 and h != one(spark, P.judge_prompt_hash()) and one(spark, P.judge_prompt_hash("{broken")) == one(spark, P.judge_prompt_hash())
    kind = "ID string, Judge_Begruendung string, judge_model string, judge_prompt_version string, judge_prompt_hash string, score double"
    rows = [("ok", "fine", "m", "v2", h, 4.0), ("model", "fine", "n", "v2", h, 4.0), ("version", "fine", "m", "v1", h, 4.0), ("hash", "fine", "m", "v2", "x", 4.0), ("nohash", "fine", "m", "v2", None, 4.0), ("issue", "api ERROR: 500", "m", "v2", h, 4.0), ("noscore", "", "m", "v2", h, None), ("nan", "", "m", "v2", h, float("nan"))]
    cache = spark.createDataFrame(rows, kind)
    for wanted in (h, P.judge_prompt_hash(TEMPLATE)):
        assert [r.ID for r in tasks.reusable(cache, "m", "v2", wanted).collect()] == ["ok"]
    assert tasks.reusable(cache.drop("judge_prompt_hash"), "m", "v2", h).count() == 0
    assert {r.ID for r in tasks.reusable(cache.drop("judge_model", "judge_prompt_version"), "m", "v2", h).collect()} == {"ok", "model", "version"}


def test_patches_replace_the_asked_ids_only(spark):
    kind = "Run_ID int, ID string, score double, note string"
    base = spark.createDataFrame([(1, "1", 0.1, "a"), (1, "2", 0.2, "b"), (2, "1", 0.3, "c"), (1, "3", 0.4, "d")], kind)
    patch = spark.createDataFrame([(1, " 1 ", 0.9), (1, "2", 0.8), (1, "9", 0.7)], "Run_ID int, ID string, score double")
    got = {(r.Run_ID, r.ID): (r.score, r.note) for r in tasks.upsert(base, patch, ["Run_ID", "ID"], {"1", "9", "40", "x"}).collect()}
    assert got == {(1, "1"): (0.9, None), (1, "2"): (0.2, "b"), (2, "1"): (0.3, "c"), (1, "3"): (0.4, "d")}
    assert tasks.missing_ids({"1", "40", "9", "100", "x", "b"}, patch) == ["40", "100", "b", "x"]


def test_judge_issues_count_as_issues(spark):
    kind = "ID string, Likert_Score double, error string, Judge_Begruendung string"
    rows = [("b", 1.0, "", "fine"), ("a", 2.0, None, "Judge JSON parse failed: x"), ("a", 2.0, None, "api error"), ("c", None, "", ""), ("d", 3.0, " down ", "")]
    df = spark.createDataFrame(rows, kind)
    r = reports.data_quality(df, 5).first()
    assert (r.actual, r.error_rows, r.unscored_rows, r.judge_issue_rows, r.missing, r.status) == (5, 1, 1, 2, 0, "issues")
    assert [x.ID for x in reports.issue_rows(df, ["ID"]).collect()] == ["a", "c", "d"]
    assert reports.data_quality(df.where("ID = 'b'"), 1).first().status == "ok"
    assert "judge_issue_rows" not in reports.data_quality(df.drop("Judge_Begruendung"), 5).columns


def test_raw_results_take_the_evaluated_names(spark):
    raw = spark.createDataFrame([(1, "m", "q", 3)], "run_number int, model string, llm_answer string, other int")
    assert tasks.compatible(raw).columns == ["Run_ID", "Model", "KI_Antwort", "other"]


def test_a_run_reads_its_plan_once(spark, tmp_path, monkeypatch):
    plan = spark.createDataFrame([("m", f"q{i}", "RAG", 1, f"p{i}") for i in range(12)], "model string, question_id string, method string, run_number int, prompt string")
    planned, real = [], tasks.pending
    monkeypatch.setattr(tasks, "pending", lambda *a: planned.append(1) or real(*a))
    path = str(tmp_path / "ck")

    def client(model, prompt):
        if prompt in ("p3", "p4"):
            raise RuntimeError("down")
        return "ok", 1, 2

    monkeypatch.setattr(evaluation.time, "sleep", lambda s: None)
    got = evaluation.run_benchmark(spark, plan, client, path, batch=4)
    assert len(planned) == 1
    assert {r.question_id for r in got.where("error <> ''").collect()} == {"q3", "q4"}
    again = evaluation.run_benchmark(spark, plan, lambda m, p: ("later", 1, 1), path, batch=4).collect()
    assert {r.question_id: r.llm_answer for r in again if r.llm_answer == "later"} == {"q3": "later", "q4": "later"} and len(again) == 12


ROWS = "model string, question_id string, method string, run_number int, judge_text string, error string, ord long"


def play(spark, tmp_path, name="ck"):
    q = streaming.upsert_stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / name), buckets=4)
    q.awaitTermination(180)
    return sorted((r.question_id, r.score, r.error) for r in streaming.current(spark, str(tmp_path / "out")).collect())


def test_a_stream_keeps_one_row_a_task_over_batches(spark, tmp_path):
    put = lambda rows: spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    put([("m", "q", "RAG", 1, '{"score": 3}', "", 1), ("m", "q", "RAG", 1, '{"score": 2}', "", 2), ("m", "r", "RAG", 1, "", "down", 3)])
    assert play(spark, tmp_path) == [("q", 2.0, ""), ("r", None, "down")]
    put([("m", "q", "RAG", 1, "", "down", 9)])  # a late failure does not replace a success
    put([("m", "r", "RAG", 1, '{"score": 4}', "", 10), ("m", "s", "RAG", 1, '{"score": 1}', "", 11)])
    want = [("q", 2.0, ""), ("r", 4.0, ""), ("s", 1.0, "")]
    assert play(spark, tmp_path) == want
    assert play(spark, tmp_path) == want  # a restart from the checkpoint
    assert play(spark, tmp_path, "again") == want  # all batches once more, from the start
