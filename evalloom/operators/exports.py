"""Export tables in their fixed shape: columns, names, labels, order and four digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stats

# Columns of the export tables, and the constants of the statistics table.
STATS_COLUMNS = [
    "Model", "Method", "Mean_Score", "Std_Dev", "Semantic_Consistency", "Critical_Fail", "Avg_Cost", "Avg_Time", "Atomic_Coverage_Score", "Support_Rate",
    "Atomic_Precision", "Hallucination_Rate", "Contradiction_Rate", "Not_In_Scope_Rate", "Trap_Pass_Rate", "Trap_Hallucination_Rate", "Trap_Question_Share",
    "N", "Total_Real_Cost", "p_value", "q_value", "effect_size", "ci95_low", "ci95_high", "test_name", "analysis_unit", "baseline_method", "comparison_method",
    "pairing_key", "paired_n", "multiple_testing_method", "multiple_testing_scope", "effect_size_name", "effect_size_interpretation", "confidence_mean",
    "confidence_std", "overconfidence_score", "confidence_accuracy_gap", "stability_check_name", "stability_check_note", "run_level_score_std",
    "run_level_coverage_std", "run_level_precision_std", "run_level_hallucination_std", "run_level_pair_coverage", "rq_mapping", "primary_metric_name",
]
STATS_CONSTANTS = {
    "analysis_unit": "task",
    "pairing_key": "Model+ID",
    "multiple_testing_method": "benjamini_hochberg",
    "multiple_testing_scope": "per_model",
    "effect_size_name": "rank_biserial_correlation",
    "stability_check_name": "run_level descriptive stability check",
    "stability_check_note": "descriptive stability check, not primary hypothesis testing",
    "rq_mapping": "RQ1=Atomic_Coverage_Score+Wilcoxon; RQ2=Precision+Hallucination+Overconfidence; RQ3=Cost/Time descriptive",
    "primary_metric_name": "atomic_coverage_score",
}
MAIN_COLUMNS = ["model", "metric", "comparison", "n_pairs", "wilcoxon_statistic", "p_value_raw", "p_value_bh", "effect_size_r", "effect_size_label", "direction", "shapiro_p_value"]
TRAP_COLUMNS = ["model", "method", "n_trap_questions", "correct_refusal_rate", "hallucinated_answer_rate"]
ROBUSTNESS_COLUMNS = ["model", "metric", "comparison", "n_runs_with_pairs", "share_runs_same_direction", "share_runs_same_significance", "overall_direction_stable", "overall_significance_stable"]
OVERCONFIDENCE_COLUMNS = ["model", "method", "n_observations", "mean_confidence_score", "mean_atomic_coverage_score", "confidence_accuracy_correlation", "overconfident_error_rate"]

METRIC_NAMES = [m.lower() for m in stats.METRICS]
COMPARISON_NAMES = [stats.comparison_label(a, b) for a, b in stats.COMPARISONS]


def _place(value: Column, order: list[str]) -> Column:
    """Place in a fixed order; others come last."""
    at = F.array_position(F.lit(order), value)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def method_name(method: Column) -> Column:
    out = method
    for name, label in stats.METHOD_LABELS.items():
        out = F.when(method == name, label).otherwise(out)
    return out


def _named(df: DataFrame, names: dict[str, str | Column], columns: list[str]) -> DataFrame:
    """Columns in their order under their names; doubles to four digits."""
    out = df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in names.items()])
    return out.select(*[stats.half_even(F.col(c)).alias(c) if out.schema[c].dataType.typeName() == "double" else F.col(c) for c in columns])


def main_tests(tests: DataFrame) -> DataFrame:
    """The export of ``stats.main_tests`` or ``stats.test_effects``: by model, metric and comparison in their fixed order."""
    names = {"model": "Model", "metric": F.lower("metric"), "comparison": "comparison", "n_pairs": "n_pairs", "wilcoxon_statistic": "statistic", "p_value_raw": "p", "p_value_bh": "q", "effect_size_r": "r", "effect_size_label": "label", "direction": "direction", "shapiro_p_value": "shapiro_p"}
    there = {k: v for k, v in names.items() if not isinstance(v, str) or v in tests.columns}
    out = _named(tests, there, [c for c in MAIN_COLUMNS if c in there])
    return out.orderBy("model", _place(F.col("metric"), METRIC_NAMES), _place(F.col("comparison"), COMPARISON_NAMES))


def trap_summary(tasks: DataFrame) -> DataFrame:
    """Trap questions by model and known method, 0 where a method has none."""
    own = stats.trap_summary(tasks).where(F.col("Method").isin(*stats.METHODS)).withColumn("__at", _place(F.col("Method"), stats.METHODS))
    out = _named(own, {"model": "Model", "method": method_name(F.col("Method")), "n_trap_questions": "n_trap", "correct_refusal_rate": "pass_rate", "hallucinated_answer_rate": "fail_rate"}, TRAP_COLUMNS)
    return out.orderBy("model", _place(F.col("method"), [stats.method_label(m) for m in stats.METHODS]))


def robustness(shares: DataFrame) -> DataFrame:
    names = {"model": "Model", "metric": F.lower("metric"), "comparison": "comparison", "n_runs_with_pairs": "n_runs", "share_runs_same_direction": "direction_share", "share_runs_same_significance": "significance_share", "overall_direction_stable": "direction_stable", "overall_significance_stable": "significance_stable"}
    out = _named(shares, names, ROBUSTNESS_COLUMNS)
    return out.orderBy("model", _place(F.col("metric"), METRIC_NAMES), _place(F.col("comparison"), COMPARISON_NAMES))


def overconfidence(prepared: DataFrame) -> DataFrame:
    """By model and method; no rows where no answer states its confidence."""
    own = stats.overconfidence(prepared).crossJoin(F.broadcast(stats.non_trap(prepared).agg(F.count("Confidence_Mean").alias("__told"))))  # one row
    names = {"model": "Model", "method": method_name(F.col("Method")), "n_observations": "n", "mean_confidence_score": "mean_confidence", "mean_atomic_coverage_score": "mean_coverage", "confidence_accuracy_correlation": "corr", "overconfident_error_rate": "overconfident_rate"}
    return _named(own.where("__told > 0"), names, OVERCONFIDENCE_COLUMNS).orderBy("model", "method")


def stats_table(table: DataFrame) -> DataFrame:
    """``stats.stats_table`` under its export names, in full digits, by model and method."""
    names = {
        "Std_Dev": "Score_Std", "Semantic_Consistency": "Consistency", "Critical_Fail": "Critical_Fail_Rate", "p_value": "p", "q_value": "q", "effect_size": "effect", "ci95_low": "ci_low", "ci95_high": "ci_high",
        "comparison_method": "Method", "effect_size_interpretation": "effect_label", "overconfidence_score": "Overconfidence",
    }
    value = lambda c: F.lit(STATS_CONSTANTS[c]) if c in STATS_CONSTANTS else F.col(names.get(c, c))
    return table.select(*[value(c).alias(c) for c in STATS_COLUMNS]).orderBy("Model", "Method")
