import math
import random

import pandas as pd
import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.operators import chunking, ranking, reports, stats, tasks

SCHEMA = "Model string, Method string, ID string, Run_ID int, Likert_Score double, Support_Rate double, Atomic_Precision double, Hallucination_Rate double, Is_Trap_Question double, Trap_Pass double, Confidence_Mean double, KI_Antwort string"


def row(method, qid, score, run=1, model="m1", precision=None, trap=0.0, passed=None, confidence=None, text="a b"):
    p = score / 4 if precision is None else precision
    return (model, method, qid, run, float(score), score / 4, p, 1 - p, trap, passed, confidence, text)


def prepared(spark, rows):
    return stats.prepare(spark.createDataFrame(rows, SCHEMA))


def test_pairing_and_exact_p(spark):
    rows = [row("Zero-Shot", f"q{i}", s) for i, s in enumerate((1, 1, 2, 1))] + [row("RAG", f"q{i}", s) for i, s in enumerate((4, 4, 4, 3))]
    t = stats.task_level(prepared(spark, rows))
    d = stats.pairs(t)
    r = stats.signed_ranks(d, ["Model", "comparison"]).first()
    assert (r.n_pairs, r.effect, r.statistic) == (4, 1.0, 0.0)
    assert (r.p, r.p_method) == (pytest.approx(2 / 16), "exact")


def test_zero_differences(spark):
    rows = [row(m, f"q{i}", 2) for i in range(3) for m in ("Zero-Shot", "RAG")]
    d = stats.pairs(stats.task_level(prepared(spark, rows)))
    r = stats.signed_ranks(d, ["Model", "comparison"]).first()
    assert (r.n_pairs, r.effect, r.z) == (3, 0.0, 0.0)
    assert r.p == 1.0


def test_one_pair_has_no_p(spark):
    d = stats.pairs(stats.task_level(prepared(spark, [row("Zero-Shot", "q", 1), row("RAG", "q", 2)])))
    assert stats.signed_ranks(d, ["Model", "comparison"]).first().p is None


def test_task_and_run_deviation(spark):
    rows = [row("Zero-Shot", "q1", 1, 1), row("Zero-Shot", "q1", 1, 2), row("Zero-Shot", "q2", 2, 1), row("Zero-Shot", "q2", 4, 2)]
    r = stats.model_method_stats(stats.task_level(prepared(spark, rows))).first()
    assert r.Mean_Score == pytest.approx(0.5)
    assert r.run_level_score_std == pytest.approx(math.sqrt(2) / 8)


@pytest.mark.parametrize("score,confidence,over,gap", [(2, 3.0, 0.0, -0.5), (0, 0.0, 1.0, 1.0)])
def test_overconfidence(spark, score, confidence, over, gap):
    r = stats.task_level(prepared(spark, [row("RAG", "q", score, confidence=confidence)])).first()
    assert (r.Task_Overconfidence_Score, r.Task_Confidence_Accuracy_Gap) == (pytest.approx(over), pytest.approx(gap))


def test_traps_do_not_count_for_scores(spark):
    rows = [row("RAG", "q1", 4), row("RAG", "q2", 0, trap=1.0, passed=0.0)]
    t = stats.task_level(prepared(spark, rows))
    r = stats.model_method_stats(t).first()
    assert (r.Mean_Score, r.Trap_Question_Share) == (1.0, 0.5)
    s = stats.trap_summary(t).first()
    assert (s.n_trap, s.pass_rate, s.fail_rate) == (1, 0.0, 1.0)


def test_rows_without_likert_go(spark):
    r = list(row("RAG", "q", 2))
    r[4] = None
    assert prepared(spark, [tuple(r)]).count() == 0


def test_exact_p_against_enumeration():
    from itertools import product

    rnd = random.Random(5)
    for _ in range(20):
        d = [rnd.choice([-3, -2, -1, 1, 1, 2, 3]) for _ in range(rnd.randint(1, 9))]
        ranks = pd.Series([abs(x) for x in d]).rank().tolist()
        seen = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))]
        low, high = sum(s <= seen + 1e-9 for s in sums), sum(s >= seen - 1e-9 for s in sums)
        sizes = pd.Series([2 * r for r in ranks]).value_counts()
        assert stats.exact_p(sizes.index, sizes, round(2 * seen)) == pytest.approx(min(1, 2 * min(low, high) / len(sums)))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.5]
    got = {r.p: r.q for r in stats.benjamini_hochberg(spark.createDataFrame([("g", x) for x in p], "g string, p double"), ["g"]).collect()}
    assert got[0.01] == pytest.approx(0.04) and got[0.03] == pytest.approx(0.16 / 3) and got[0.04] == pytest.approx(0.16 / 3) and got[0.5] == 0.5 and got[None] is None


def test_bootstrap_is_seeded(spark):
    values = [0.1, 0.4, 0.5, 0.9]
    t = spark.createDataFrame([("m", "RAG", f"q{i}", v) for i, v in enumerate(values)], "Model string, Method string, ID string, Task_Score double")
    rng = random.Random(42)
    means = sorted(sum(values[rng.randrange(4)] for _ in range(4)) / 4 for _ in range(1000))
    r = stats.bootstrap_ci(t).first()
    assert (r.ci_low, r.ci_high) == (means[25], means[974])


def test_run_pair_coverage_and_consistency(spark):
    rows = [row("Zero-Shot", "q1", 1, 1), row("Zero-Shot", "q1", 1, 2), row("RAG", "q1", 1, 1, text="a b"), row("RAG", "q1", 1, 3, text="b c")]
    p = prepared(spark, rows)
    assert stats.run_pair_coverage(p).first().coverage == 0.5
    got = {r.Method: r.Semantic_Consistency for r in stats.jaccard_consistency(p, ["Model", "Method", "ID"]).collect()}
    assert got["RAG"] == pytest.approx(1 / 3) and got["Zero-Shot"] == 1.0


def test_main_tests_and_robustness(spark):
    rows = [row(m, f"q{i}", (s + i) % 5, run) for run in (1, 2) for i in range(4) for s, m in ((0, "Zero-Shot"), (1, "Advanced-Prompt"), (3, "RAG"))]
    p = prepared(spark, rows)
    assert stats.main_tests(stats.task_level(p)).count() == 9
    assert {r.n_runs for r in stats.robustness(p).collect()} == {2}


def test_reports(spark):
    rows = [row("Zero-Shot", "q1", 1), row("RAG", "q1", 2), row("Zero-Shot", "q2", 1), row("RAG", "q2", 1)]
    t = stats.task_level(prepared(spark, rows))
    meta = spark.createDataFrame([("q1", "Wissensbasiert")], "ID string, task_type string")
    got = {r.task_type: (r.n_pairs, r.median_delta) for r in reports.tasktype_summary(reports.tasktype_deltas(t, meta)).collect()}
    assert got == {"Wissensbasiert": (1, 0.25), "Unklar/sonstige": (1, 0.0)}
    assert sum(r.n for r in reports.histogram(stats.pairs(t), ["comparison"]).collect()) == 2


def test_bm25_by_hand(spark):
    docs = [("a", "s1", 0, "heat pump heat"), ("b", "s2", 1, "solar panel"), ("c", "s1", 2, "heat panel pump grid")]
    index = ranking.Bm25Index(spark.createDataFrame(docs, "chunk_id string, source string, ord long, chunk string"))
    q = spark.createDataFrame([(1, "heat"), (2, "nothing")], "query_id int, query string")
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in index.search(q, 2).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    score = lambda tf, dl: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 3))
    assert got[1, 1] == ("a", pytest.approx(score(2, 3), abs=1e-8)) and got[1, 2] == ("c", pytest.approx(score(1, 4), abs=1e-8))
    assert got[2, 1] == ("a", 0.0) and got[2, 2] == ("b", 0.0)
    assert [r.chunk_id for r in index.search(q.where("query_id = 1"), 5, source="s1", fallback=False).orderBy("rank").collect()] == ["a", "c"]


def test_fusion_and_rerank(spark):
    lex = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, chunk_id string")
    vec = spark.createDataFrame([(1, 1, "b"), (1, 2, "c")], "query_id int, rank int, chunk_id string")
    assert [r.chunk_id for r in ranking.fuse(lex, vec).orderBy("rank").collect()] == ["b", "a", "c"]
    rows = spark.createDataFrame([(1, 1, "a", "x", 1.0), (1, 2, "b", "x", 0.99), (1, 3, "c", "gesetz", 0.90), (1, 4, "d", "y", 0.97)], "query_id int, rank int, chunk_id string, source string, score double")
    assert [r.chunk_id for r in ranking.rerank(rows, k=3).orderBy("rank").collect()] == ["c", "a", "d"]


def test_retrieval_measures(spark):
    ranked = spark.createDataFrame([("m", 1, i, str(i)) for i in range(1, 11)] + [("m", 2, 1, "z")], "mode string, query_id int, rank int, item string")
    relevant = spark.createDataFrame([(1, "6"), (1, "9"), (2, "q")], "query_id int, item string")
    r = ranking.hit_and_mrr(ranked, relevant).first()
    assert (r.n_queries, r.hit_at_5, r.mrr_at_10) == (2, 0.0, pytest.approx(1 / 12, abs=1e-6))


def test_sections(spark):
    docs = spark.createDataFrame([("s", "intro\n# A\nbody\n\n\n\nmore\n1.2 Next\nend"), ("e", ""), ("n", None)], "source string, text string")
    got = [(r.chunk_id, r.chunk) for r in chunking.chunk_sections(docs).orderBy("chunk_id").collect()]
    assert got == [("s::chunk_0001", "intro"), ("s::chunk_0002", "# A\nbody\n\nmore"), ("s::chunk_0003", "1.2 Next\nend")]


def test_checkpoint(spark):
    kind = "model string, question_id string, method string, run_number int, error string, ord int"
    c = spark.createDataFrame([("m", "1", "RAG", 1, "", 1), ("m", "1", "RAG", 1, "down", 2), ("m", "2", "RAG", 1, "down", 3), ("m", "2", "RAG", 1, "down", 4)], kind)
    assert {(r.question_id, r.ord) for r in tasks.latest(c).collect()} == {("1", 1), ("2", 4)}
    plan = tasks.plan(spark.createDataFrame([("1",), ("2",)], "question_id string"), spark.createDataFrame([("m",)], "model string"), spark.createDataFrame([("RAG",)], "method string"), 1)
    assert [r.question_id for r in tasks.pending(plan, c).collect()] == ["2"]
    assert [r.streak for r in tasks.failure_streaks(c, ["model"], "ord").orderBy("ord").collect()] == [0, 1, 2, 3]


def test_prices(spark):
    kind = "ord int, id string, input double, output double"
    fetched, default = spark.createDataFrame([(0, "meta-llama/llama-4-scout", 1.0, 2.0), (1, "a/b:free", 3.0, 4.0)], kind), spark.createDataFrame([(0, "x/y", 5.0, 6.0)], kind)
    got = {r.model: (r.input, r.matched) for r in tasks.resolve_prices(spark.createDataFrame([("llama-4-scout",), ("a/b",), ("y",), ("?",)], "model string"), fetched, default).collect()}
    assert got == {"llama-4-scout": (1.0, "fetched"), "a/b": (3.0, "fetched"), "y": (5.0, "default"), "?": (0.0, "missing")}


def test_upsert_replaces_whole_rows(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    patch = spark.createDataFrame([(2, None, 9.0), (3, "c", 3.0)], "k int, s string, v double")
    assert {tuple(r) for r in tasks.upsert(base, patch, ["k"]).collect()} == {(1, "a", 1.0), (2, None, 9.0)}


def test_missing_columns_and_nan(spark):
    df = stats.prepare(spark.createDataFrame([("RAG", float("nan"), 0.5, 2.0)], "Method string, Atomic_Coverage_Score double, Support_Rate double, Likert_Score double"))
    r = df.first()
    assert (r.Atomic_Coverage_Score, r.Model, r.Hallucination_Rate) == (0.5, "unknown", None)


def test_constant_correlation_is_null(spark):
    df = prepared(spark, [row("RAG", f"q{i}", i, confidence=1.0) for i in range(3)])
    assert stats.overconfidence(df).first()["corr"] is None


def test_group_consistency_is_the_mean_of_all_pairs(spark):
    from evalloom.operators import judging

    rnd = random.Random(21)
    rows = [(i, g, [rnd.uniform(-1, 1) for _ in range(5)]) for i, g in enumerate("aabbbabbaac")] + [(90, "a", [0.0] * 5), (91, "a", None), (92, None, [1.0] * 5)]
    got = {r.g: r.consistency for r in judging.group_consistency(spark.createDataFrame(rows, "i int, g string, v array<double>"), "g", "v").collect()}
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    for g in "ab":
        own = [v for _, k, v in rows if k == g and v and any(v)]
        every = [cos(x, y) for i, x in enumerate(own) for y in own[:i]]
        assert got.pop(g) == pytest.approx(sum(every) / len(every))
    assert not got


def test_exact_p_of_many_pairs():
    ranks = lambda n: [2 * i for i in range(1, n + 1)]
    assert stats.exact_p(ranks(60), [1] * 60, sum(ranks(60))) == pytest.approx(2 / 2**60)
    assert 0.9 < stats.exact_p(ranks(1000), [1] * 1000, sum(ranks(1000)[1::2])) <= 1.0


def test_statistics_table(spark):
    """Baseline with p = q = 1, one tie, one method with pairs, a model whose method has no pair; traps by model."""
    rows = []
    for i in range(6):
        for run in (1, 2):
            rows += [("m", "Zero-Shot", str(i), run, 0.2, 0.0), ("m", "RAG", str(i), run, 0.4 + i / 100, 0.0), ("m", "Advanced-Prompt", str(i), run, 0.2, 0.0), ("n", "RAG", str(i), run, 0.5, 0.0)]
    rows += [("m", "RAG", "t", 1, 1.0, 1.0), ("n", "RAG", "t", 1, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "Model string, Method string, ID string, Run_ID int, Support_Rate double, Is_Trap_Question double").withColumns({"Likert_Score": F.lit(1.0), "Trap_Pass": F.when(F.col("Is_Trap_Question") > 0, F.col("Support_Rate"))})
    p = stats.prepare(df)
    got = {(r.Model, r.Method): r for r in stats.stats_table(stats.task_level(p), p).collect()}
    base, rag, same, alone = got["m", "Zero-Shot"], got["m", "RAG"], got["m", "Advanced-Prompt"], got["n", "RAG"]
    assert (base.test_name, base.paired_n, base.p, base.q, base.effect, base.run_level_pair_coverage) == ("baseline_reference", 6, 1.0, 1.0, 0.0, 1.0)
    assert (rag.paired_n, rag.p, rag.q, rag.effect, rag.effect_label) == (6, pytest.approx(2 / 64), pytest.approx(4 / 64), 1.0, "large")
    assert (same.p, same.effect, same.effect_label) == (1.0, 0.0, "negligible")
    assert (alone.paired_n, alone.p, alone.q, alone.effect_label, alone.run_level_pair_coverage) == (0, None, None, "unknown", None)
    assert rag.Trap_Question_Share == pytest.approx(1 / 7) and rag.ci_low < rag.ci_high
    assert {(r.Model, r.Method): (r.n_trap, r.pass_rate) for r in stats.trap_summary(stats.task_level(p)).collect()} == {("m", "RAG"): (1, 1.0), ("n", "RAG"): (1, 0.0), ("m", "Zero-Shot"): (0, 0.0), ("m", "Advanced-Prompt"): (0, 0.0)}
    assert {r.comparison: r.coverage for r in stats.run_pair_coverage(p).collect()} == dict.fromkeys(["Zero-Shot vs Advanced Prompting", "Zero-Shot vs RAG", "Advanced Prompting vs RAG"], 1.0)
    tests = {(r.metric, r.comparison): r for r in stats.main_tests(stats.task_level(p)).collect() if r.Model == "m"}
    r = tests["Atomic_Coverage_Score", "Zero-Shot vs RAG"]
    assert (r.direction, r.label, r.n_pairs, r.p) == ("favours_RAG", "gross", 6, pytest.approx(2 / 64))
    one = stats.main_tests(stats.task_level(p.where("ID = '0'"))).where("Model = 'm'").collect()
    assert one and all((x.statistic, x.z, x.r, x.p, x.n_nonzero, x.label) == (None, None, None, None, 0, "unknown") for x in one)


