"""Normality, p beyond the exact bound, robustness by brute force, and the export tables in their fixed shape."""

import math
import random
from itertools import product
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.functions import normal
from evalloom.operators import exports, normality, reports, stats

ROWS = "Model string, Method string, ID string, Run_ID int, Likert_Score double, Support_Rate double, Atomic_Precision double, Hallucination_Rate double, Is_Trap_Question double, Trap_Pass double, Confidence_Mean double"
# Published examples: values, W and p.
MEN = ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704)
MILES = ([21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4, 30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4], 0.94756, 0.1229)
TWENTY = ([0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66], 0.90047, 0.04209)


def result(model, method, qid, run, rate, contradiction, trap=0.0, passed=None, confidence=1.0):
    precision = max(0.0, 1.0 - contradiction)
    rate = float(rate)
    return (model, method, qid, run, rate * 4, rate, precision, 1 - precision, trap, passed, confidence)


def prepared(spark, rows):
    return stats.prepare(spark.createDataFrame(rows, ROWS))


def test_normal_functions(spark):
    ps, zs = [1e-300, 1e-9, 0.001, 0.07, 0.2, 0.5, 0.93, 0.999, 1 - 1e-12], [-8.0, -2.5, -0.1, 0.0, 0.7, 3.0, 6.9, 7.2, 15.0]
    rows = spark.createDataFrame(list(zip(ps, zs, strict=True)), "p double, z double").select("p", "z", normal.quantile(F.col("p")).alias("q"), normal.upper_tail(F.col("z")).alias("t")).collect()
    for r in rows:
        assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-12, abs=1e-12)
        assert r.t == pytest.approx(math.erfc(r.z / math.sqrt(2)) / 2, rel=1e-7)
    assert spark.range(1).select(normal.quantile(F.lit(0.0)).alias("q")).first().q is None


def test_shapiro_wilk_of_published_examples(spark):
    sets = {"men": MEN, "miles": MILES, "twenty": TWENTY}
    odd = {"two": [1.0, 2.0], "constant": [3.0] * 5, "nearly": [1.0, 1.0 + 1e-12, 1.0], "null": [None, 1.0, 2.0], "three": [1.0, 2.0, 4.0]}
    rows = [(k, float(v)) for k, (values, *_) in sets.items() for v in values] + [(k, v) for k, values in odd.items() for v in values]
    got = {r.g: r for r in normality.shapiro_wilk(spark.createDataFrame(rows, "g string, diff double").repartition(3), ["g"]).collect()}
    for k, (_, w, p) in sets.items():
        assert (got[k].w, got[k].p) == (pytest.approx(w, abs=1e-5), pytest.approx(p, abs=5e-5))
    assert [(got[k].w, got[k].p) for k in ("two", "constant", "nearly", "null")] == [(None, None)] * 4
    assert got["three"].w == pytest.approx(27 / 28) and 0.63 < got["three"].p < 0.64


def test_shapiro_wilk_of_many_ties(spark, monkeypatch):
    """Runs of equal values are told apart in blocks: the same result as with one block."""
    df = spark.range(3000).selectExpr("'g' as g", "cast(floor(pow(id % 97, 2) / 500) as double) as diff")
    whole = normality.shapiro_wilk(df, ["g"]).first()
    monkeypatch.setattr(normality, "RUN", 7)
    part = normality.shapiro_wilk(df, ["g"]).first()
    assert whole.n == 3000 and (part.w, part.p) == (pytest.approx(whole.w), pytest.approx(whole.p))


def test_qq_points_and_line(spark):
    values = [3.0, 1.0, 2.0, 2.0, 9.0]
    rows = normality.qq_points(spark.createDataFrame([("g", v) for v in values] + [("g", None), ("one", 4.0)], "g string, v double"), ["g"], "v").orderBy("g", "i").collect()
    n = len(values)
    medians = [1 - 0.5 ** (1 / n), *[(i - 0.3175) / (n + 0.365) for i in range(2, n)], 0.5 ** (1 / n)]
    x = [NormalDist().inv_cdf(m) for m in medians]
    slope, intercept = np.polyfit(x, sorted(values), 1)
    own = [r for r in rows if r.g == "g"]
    assert [r.theoretical for r in own] == pytest.approx(x) and [r.value for r in own] == sorted(values)
    assert (own[0].slope, own[0].intercept) == (pytest.approx(slope), pytest.approx(intercept))
    assert [(r.theoretical, r.slope) for r in rows if r.g == "one"] == [(0.0, None)]


def test_boxes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    r = normality.boxes(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double"), ["g"], "v").first()
    assert tuple(r) == ("g", 5, 2.0, 3.0, 4.0, 1.0, 4.0)


def test_both_forms_of_p_agree_at_the_bound(spark):
    rnd = random.Random(4)
    rows = [(g, round(rnd.gauss(shift, 1), 2 if g < 6 else 0)) for g, shift in enumerate([0, 0.02, 0.05, 0.08, -0.03, 0.1, 0.05, -0.06]) for _ in range(1000)]
    df = spark.createDataFrame(rows, "g int, diff double")
    exact = {r.g: r for r in stats.signed_ranks(df, ["g"], exact=1000).collect()}
    form = {r.g: r for r in stats.signed_ranks(df, ["g"], exact=10).collect()}
    for g, e in exact.items():
        assert (e.p_method, form[g].p_method) == ("exact", "normal")
        assert form[g].p == pytest.approx(e.p, abs=1e-3)


def test_exact_p_of_spark_groups_against_enumeration(spark):
    rnd = random.Random(8)
    rows = [(g, float(rnd.choice([-3, -2, -1, 0, 1, 2, 3]))) for g in range(30) for _ in range(rnd.randint(2, 9))]
    got = {r.g: r for r in stats.signed_ranks(spark.createDataFrame(rows, "g int, diff double"), ["g"]).collect()}
    for g in range(30):
        d = [x for k, x in rows if k == g and x]
        sizes = sorted(abs(x) for x in d)
        rank = lambda x: (sizes.index(abs(x)) + 1 + len(sizes) - sizes[::-1].index(abs(x))) / 2  # noqa: B023, E731
        ranks = [rank(x) for x in d]
        seen = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
        sums = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product((0, 1), repeat=len(d))]
        want = min(1.0, 2 * min(sum(s <= seen for s in sums), sum(s >= seen for s in sums)) / len(sums)) if d else 1.0
        assert got[g].p == pytest.approx(want)


def test_many_pairs_take_the_normal_form(spark):
    df = spark.range(20_000).selectExpr("'g' as g", "(id % 2001 - 990) / 1000.0 as diff")
    r = stats.signed_ranks(df, ["g"]).first()
    assert (r.n_pairs, r.p_method) == (20_000, "normal") and 0 < r.p < 1


def four_questions():
    rows = []
    for qid, *rates in [("q1", 0.10, 0.40, 0.70, 0.60, 0.20, 0.10), ("q2", 0.20, 0.50, 0.80, 0.50, 0.20, 0.00), ("q3", 0.30, 0.60, 0.90, 0.40, 0.10, 0.10), ("q4", 0.40, 0.50, 1.00, 0.40, 0.20, 0.00)]:
        rows += [result("m1", m, qid, 1, rates[i], rates[i + 3]) for i, m in enumerate(stats.METHODS)]
    return rows


def test_main_tests_have_their_fixed_shape(spark):
    out = exports.main_tests(stats.main_tests(stats.task_level(prepared(spark, four_questions()))))
    assert out.columns == exports.MAIN_COLUMNS
    rows = out.collect()
    names = ["Zero-Shot vs Advanced Prompting", "Zero-Shot vs RAG", "Advanced Prompting vs RAG"]
    assert [(r.metric, r.comparison) for r in rows] == [(m, c) for m in ("atomic_coverage_score", "atomic_precision", "hallucination_rate") for c in names]
    assert [r.direction for r in rows[:3]] == ["favours_Advanced Prompting", "favours_RAG", "favours_RAG"]
    # All four questions are better by as much: p = 2 / 2^4, z = (10 - 5) / 2.5 and r = z / 2.
    assert (rows[1].wilcoxon_statistic, rows[1].p_value_raw, rows[1].p_value_bh, rows[1].effect_size_label) == (0.0, 0.125, 0.125, "gross")
    assert (rows[1].effect_size_r, rows[1].shapiro_p_value) == (1.0, None)


def test_missing_methods_make_no_rows_and_traps_stand_apart(spark):
    rows = [result("m1", m, q, 1, *v) for q, a, b in (("q1", (0.2, 0.4), (0.8, 0.1)), ("q3", (0.1, 0.5), (0.9, 0.0))) for m, v in (("Zero-Shot", a), ("RAG", b))]
    rows += [result("m1", "Zero-Shot", "q2", 1, 0.3, 0.3, 1.0, 1.0), result("m1", "RAG", "q2", 1, 0.7, 0.1, 1.0, 0.0)]
    tasks = stats.task_level(prepared(spark, rows))
    main = exports.main_tests(stats.main_tests(tasks)).collect()
    assert [(r.comparison, r.n_pairs) for r in main] == [("Zero-Shot vs RAG", 2)] * 3
    traps = exports.trap_summary(tasks)
    assert traps.columns == exports.TRAP_COLUMNS
    assert [tuple(r) for r in traps.collect()] == [("m1", "Zero-Shot", 1, 1.0, 0.0), ("m1", "RAG", 1, 0.0, 1.0)]


def test_statistics_table_has_all_columns(spark):
    p = prepared(spark, four_questions())
    out = exports.stats_table(stats.stats_table(stats.task_level(p), p))
    assert out.columns == exports.STATS_COLUMNS and len(out.columns) == 47
    rows = {r.Method: r for r in out.collect()}
    assert rows["RAG"].effect_size_interpretation == "large" and rows["Zero-Shot"].test_name == "baseline_reference"
    assert rows["RAG"].comparison_method == "RAG" and rows["RAG"].multiple_testing_scope == "per_model"


def test_robustness_by_brute_force(spark):
    rnd = random.Random(6)
    methods, runs, ids = stats.METHODS, (1, 2, 3), [f"q{i}" for i in range(7)]
    rows = [result("m1", m, q, run, rnd.choice([0, 0.25, 0.5, 0.75, 1]), rnd.choice([0, 0.2, 0.4]), 1.0 if q == "q6" else 0.0) for m in methods for run in runs for q in ids if not (run == 3 and q > "q0")]
    p = prepared(spark, rows)
    tests = {(r.metric, r.comparison): r for r in exports.main_tests(stats.main_tests(stats.task_level(p))).collect()}
    out = exports.robustness(stats.robustness(p))
    assert out.columns == exports.ROBUSTNESS_COLUMNS
    got = out.collect()
    assert len(got) == 9
    column = {"atomic_coverage_score": (5, 1), "atomic_precision": (6, 1), "hallucination_rate": (7, -1)}
    for r in got:
        at, sign = column[r.metric]
        a, b = next(c for c in stats.COMPARISONS if stats.comparison_label(*c) == r.comparison)
        same = []
        for run in runs:
            value = {(x[1], x[2]): x[at] for x in rows if x[3] == run and x[8] < 0.5}
            d = [round(sign * (value[b, q] - value[a, q]), 12) for q in ids if (a, q) in value and (b, q) in value]
            if len(d) < 2:
                continue
            one = stats.signed_ranks(spark.createDataFrame([("g", x) for x in d], "g string, diff double"), ["g"]).first()
            direction = "tie" if max(map(abs, d)) <= 1e-8 else f"favours_{stats.method_label(b if sum(d) > 0 else a)}"
            whole = tests[r.metric, r.comparison]
            same.append((direction == whole.direction, (one.p < 0.05) == (whole.p_value_bh < 0.05)))
        assert r.n_runs_with_pairs == len(same) == 2
        assert (r.share_runs_same_direction, r.share_runs_same_significance) == tuple(sum(x) / 2 for x in zip(*same, strict=True))
        assert (r.overall_direction_stable, r.overall_significance_stable) == tuple(all(x) for x in zip(*same, strict=True))


def test_a_comparison_without_runs_is_not_stable(spark):
    rows = [result("m1", m, f"q{i}", i, s, 0.1) for i in range(4) for m, s in (("Zero-Shot", 0.2), ("RAG", 0.4 + i / 10))]
    r = exports.robustness(stats.robustness(prepared(spark, rows))).first()
    assert (r.n_runs_with_pairs, r.share_runs_same_direction, r.overall_direction_stable, r.overall_significance_stable) == (0, None, False, False)


def test_overconfidence_without_confidence_has_no_rows(spark):
    p = prepared(spark, [result("m1", "RAG", "q1", 1, 0.5, 0.1, confidence=None)])
    out = exports.overconfidence(p)
    assert out.columns == exports.OVERCONFIDENCE_COLUMNS and out.count() == 0


def test_task_types_compare_with_the_baseline_only(spark):
    tasks = stats.task_level(prepared(spark, four_questions()))
    meta = spark.createDataFrame([("q1", "Wissensbasiert"), ("q2", "Wissensbasiert"), ("q3", "Wissensbasiert")], "ID string, task_type string")
    rows = reports.tasktype_tests(reports.tasktype_deltas(tasks, meta)).collect()
    assert [(r.comparison, r.task_type, r.n_pairs) for r in rows] == [(f"{m} - Zero-Shot", t, n) for m in ("Advanced Prompting", "RAG") for t, n in (("Wissensbasiert", 3), ("Unklar/sonstige", 1))]
    assert (rows[0].median_delta, rows[0].effect_size_label, rows[1].p_value_raw, rows[1].effect_size_label) == (0.3, "gross", None, "unknown")
    fewer = reports.tasktype_deltas(tasks, meta, "Hallucination_Rate").where("comparison = 'RAG - Zero-Shot'")
    assert {r["diff"] < 0 for r in fewer.collect()} == {True}  # less risk is negative


def test_rounding_is_half_even_on_the_scaled_value(spark):
    values = [0.00005, 0.00015, 0.00025, 0.12345, 2.5, -0.00025, 1.00005, 0.06125]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(stats.half_even(F.col("v")).alias("x")).collect()
    assert [r.x for r in got] == [float(np.round(v, 4)) for v in values]
    assert got[3].x == 0.1234


def test_first_of_repeated_rows(spark):
    rows = [("m", "Zero-Shot", "q", 0.1, 2), ("m", "Zero-Shot", "q", 0.5, 1), ("m", "RAG", "q", 0.9, 3), ("m", "RAG", "q", None, 1)]
    d = stats.pairs(spark.createDataFrame(rows, "Model string, Method string, ID string, Task_Score double, ord int"), order="ord").collect()
    assert [(r.a, r.b) for r in d] == [(0.5, None)]
