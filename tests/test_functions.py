import pytest
from pyspark.sql import functions as F

from evalloom.functions import scoring as S
from evalloom.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_tokens_are_ascii_and_skip_stop_words(spark):
    assert one(spark, "Die Wärme-Pumpe ist 2 GEG-konform und", T.tokenize) == ["rme-pumpe", "geg-konform"]
    assert one(spark, None, T.tokenize) == []


@pytest.mark.parametrize("name,kind", [("GEG_2020.txt", "law"), ("din_4108", "standard"), ("Blog-Post", "web"), ("handbuch", "technical"), (None, "technical")])
def test_source_class(spark, name, kind):
    assert one(spark, name, T.source_class) == kind


@pytest.mark.parametrize("line,is_it", [("# A", True), ("§ 12a Text", True), ("1.2 Title", True), ("Note:", True), ("x" * 121 + ":", False), ("plain", False), ("", False)])
def test_heading(spark, line, is_it):
    assert one(spark, line, T.is_heading) is is_it


def test_windows_step_until_one_reaches_the_end(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    got = one(spark, text, lambda c: T.fixed_windows(c, 400, 70))
    assert got == [text[0:400], text[330:730], text[660:1000]]
    assert one(spark, "short", lambda c: T.fixed_windows(c, 400, 70)) == ["short"]
    with pytest.raises(ValueError):
        T.fixed_windows(F.lit(""), 400, 400)


def test_confidence(spark):
    assert one(spark, "Fact A #2; Fact B #0; Fact C #3", S.confidence_scores) == [2.0, 0.0, 3.0]
    assert one(spark, "#3 #0 #3", lambda c: S.array_mean(S.confidence_scores(c))) == 2.0
    assert one(spark, "sure", lambda c: S.array_mean(S.confidence_scores(c))) is None


@pytest.mark.parametrize(
    "raw,score,coverage",
    [('{"score": 3, "coverage": 0.5}', 3.0, 0.5), ('```json\n{"score": 4}\n```', 4.0, None), ('{"score": 1, "begruendung": "abc', 1.0, None), ('{"score": 7}', None, None), ("", None, None), (None, None, None), ("no json", None, None)],
)
def test_judge_score(spark, raw, score, coverage):
    r = spark.createDataFrame([(raw,)], "x string")
    s, c = S.judge_score(F.col("x"))
    row = r.select(s.alias("s"), c.alias("c")).first()
    assert (row.s, row.c) == (score, coverage)


def test_claim_counts(spark):
    raw = '{"supported": "3", "contradicted": 2.7, "not_in_scope": -1, "trap_pass": "ja"}'
    r = spark.createDataFrame([(raw,), ('{"supported": 1, "contradicted": 2, "not_in_sc',)], "x string")
    cols = [S.claim_count(F.col("x"), n).alias(n) for n in ("supported", "contradicted", "not_in_scope")]
    got = r.select(*cols, S.trap_pass(F.col("x")).alias("t")).collect()
    assert tuple(got[0]) == (3, 2, 0, 1.0)
    assert tuple(got[1])[:2] == (1, 2)


@pytest.mark.parametrize("counts,value", [((0, 0, 0), None), ((4, 0, 0), 4.0), ((3, 0, 1), 3.0), ((2, 1, 1), 2.0), ((1, 2, 1), 1.0), ((0, 3, 0), 0.0)])
def test_likert(spark, counts, value):
    r = spark.createDataFrame([counts], "a int, b int, c int")
    assert r.select(S.likert(F.col("a"), F.col("b"), F.col("c")).alias("y")).first().y == value


@pytest.mark.parametrize("text,value", [("6,000", 6000.0), ("0,5", 0.5), ("1.200", 1200.0), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("x", None), ("6.5", 6.5)])
def test_numbers(spark, text, value):
    assert one(spark, text, S.number_text) == value


def test_facts_and_types(spark):
    assert one(spark, "- A; B |\n C\n\n-", S.atomic_facts) == ["A", "B", "C"]
    assert one(spark, "Faktenfrage", S.task_type) == "Wissensbasiert"
    assert one(spark, None, S.task_type) == "Unklar/sonstige"
    assert one(spark, "Wahr/Falsch", S.answer_class) == "binary"
    r = spark.createDataFrame([("Das ist WAHR.", "wahr")], "g string, r string")
    assert r.select(S.evaluate_binary(F.col("g"), F.col("r")).alias("y")).first().y == 5
    assert r.select(S.evaluate_extraction(F.col("g"), F.col("r")).alias("y")).first().y == 5


@pytest.mark.parametrize("raw,value", [('{"a": "2.5"}', 0), ('{"a": "true"}', 0), ('{"a": true}', 1), ('{"a": false}', 0), ('{"a": " 3 "}', 3), ('{"a": 2.9}', 2), ('{"a": null}', 0), ('{"a": [1]}', 0), ("{}", 0), ('x "a": 7 ', 7), (None, 0)])
def test_claim_counts_by_type(spark, raw, value):
    assert one(spark, raw, lambda c: S.claim_count(c, "a")) == value


def test_effect_label_of_nothing(spark):
    assert [one(spark, v, S.effect_label, "double") for v in (None, float("nan"), 0.05, -0.3, 0.5)] == ["unknown", "unknown", "negligible", "medium", "large"]


def test_lines_are_stripped_of_all_white_space(spark):
    text = "\t a\u00a0\r\n\t--- PDF SEITE 3 ---\u2028b\r\r\r\rc\x0b"
    assert one(spark, text, T.clean_lines) == "a\nb\n\nc"
    assert one(spark, "intro\n12\nAbc\n3.1 Title\nx:\ny\n§ 4\n" + "z" * 130 + ":\n#", T.sections) == ["intro\n12\nAbc", "3.1 Title", "x:\ny", "§ 4\n" + "z" * 130 + ":", "#"]
