"""Frames behind the reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import judging, normality, stats

TASK_TYPES = ["Wissensbasiert", "Analytisch / Reasoning", "Rechen-/deterministisch", "Unklar/sonstige"]
TASKTYPE_COMPARISONS = [("Zero-Shot", "Advanced-Prompt"), ("Zero-Shot", "RAG")]
UNKNOWN_TYPE, UNKNOWN = "Unklar/sonstige", "Unbekannt"


def with_meta(evaluated: DataFrame, meta: DataFrame) -> DataFrame:
    """Category, difficulty and task type of each question, with defaults."""
    out = evaluated.join(meta, "ID", "left")
    return out.withColumns({"category": F.coalesce("category", F.lit(UNKNOWN)), "difficulty": F.coalesce("difficulty", F.lit(UNKNOWN)), "task_type": F.coalesce("task_type", F.lit(UNKNOWN_TYPE))})


def tasktype_comparison(baseline: str, target: str) -> str:
    return f"{stats.method_label(target)} - {stats.method_label(baseline)}"


def tasktype_deltas(tasks: DataFrame, meta: DataFrame, metric: str = "Atomic_Coverage_Score", comparisons=TASKTYPE_COMPARISONS) -> DataFrame:
    """(Model, comparison, task_type, ID, diff) over non-trap questions: each method less the baseline, whatever is better."""
    found = stats.pairs(stats.non_trap(tasks), metric, comparisons, label=tasktype_comparison)
    return found.join(meta.select("ID", "task_type"), "ID", "left").withColumn("task_type", F.coalesce("task_type", F.lit(UNKNOWN_TYPE)))


def tasktype_summary(deltas: DataFrame) -> DataFrame:
    return deltas.where("diff is not null").groupBy("comparison", "task_type").agg(F.count("*").alias("n_pairs"), F.median("diff").alias("median_delta"))


def tasktype_tests(deltas: DataFrame) -> DataFrame:
    """The export of task types: counts, median, signed-rank statistic, p, r and its label, to four digits; a single pair has no test."""
    by = ["comparison", "task_type"]
    tested = stats.signed_ranks(deltas, by).select(*by, "statistic", "r", F.col("p").alias("p_value_raw"))
    out = tasktype_summary(deltas).join(tested, by)
    out = out.withColumns({c: F.when(F.col("n_pairs") >= 2, F.col(c)) for c in ("statistic", "p_value_raw", "r")}).withColumn("effect_size_label", S.effect_label(F.col("r"), "de"))
    digits = lambda c, name: stats.half_even(F.col(c)).alias(name)
    out = out.select("task_type", "comparison", "n_pairs", digits("median_delta", "median_delta"), digits("statistic", "wilcoxon_statistic"), digits("p_value_raw", "p_value_raw"), digits("r", "effect_size_r"), "effect_size_label")
    return out.orderBy("comparison", F.array_position(F.lit(TASK_TYPES), F.col("task_type")))


def normality_frame(tasks: DataFrame) -> DataFrame:
    """Pooled differences of all models by comparison, with the Shapiro-Wilk p of each comparison."""
    d = stats.pairs(stats.non_trap(tasks), "Atomic_Coverage_Score").where("diff is not null")
    tested = normality.shapiro_wilk(d, ["comparison"]).select("comparison", F.col("p").alias("shapiro_p_value"))
    return d.join(tested, "comparison").select("comparison", F.col("Model").alias("model"), F.col("ID").alias("id"), F.col("a").alias("value_a"), F.col("b").alias("value_b"), F.col("diff").alias("oriented_difference"), "shapiro_p_value")


def tasktype_heatmap(deltas: DataFrame) -> DataFrame:
    return deltas.where("diff is not null").groupBy("comparison").pivot("task_type", TASK_TYPES).agg(F.median("diff"))


def precision_risk(tasks: DataFrame) -> DataFrame:
    return stats.non_trap(tasks).groupBy("Model", "Method").agg(*[F.avg(c).alias(c) for c in ["Atomic_Precision", "Hallucination_Rate", "Contradiction_Rate", "Not_In_Scope_Rate"]])


def run_variance(tasks: DataFrame) -> DataFrame:
    """Mean and median over questions of the deviation over runs, by model, method and metric."""
    cols = {"Atomic_Coverage_Score": "Task_Run_Coverage_Std", "Atomic_Precision": "Task_Run_Precision_Std", "Hallucination_Rate": "Task_Run_Hallucination_Std"}
    long = stats.non_trap(tasks).select("Model", "Method", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("std")) for m, c in cols.items()])).alias("x")).select("Model", "Method", "x.*")
    return long.where("std is not null").groupBy("Model", "Method", "metric").agg(F.avg("std").alias("mean_std"), F.median("std").alias("median_std"), F.count("*").alias("n_tasks"))


def means_by(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def histogram(values: DataFrame, by: list[str], value: str = "diff", bins: int = 8) -> DataFrame:
    """Counts in equal bins from min(-1, least - 0.05) to max(1, most + 0.05) of each group."""
    ends = values.groupBy(*by).agg(F.least(F.lit(-1.0), F.min(value) - 0.05).alias("lo"), F.greatest(F.lit(1.0), F.max(value) + 0.05).alias("hi"))
    out = values.join(ends, by).withColumn("bin", F.least(F.lit(bins), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1).cast("int"))
    return out.where(F.col(value).isNotNull()).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def data_quality(evaluated: DataFrame, expected: int, reason: str = "Judge_Begruendung") -> DataFrame:
    """Expected, actual, missing, failed and unscored rows, rows with a judge issue where there are reasons, and a status."""
    failed, unscored = F.trim(F.coalesce("error", F.lit(""))) != "", F.col("Likert_Score").isNull()
    counts = {"error_rows": failed, "unscored_rows": unscored}
    if reason in evaluated.columns:
        counts["judge_issue_rows"] = judging.has_issue(F.col(reason))
    out = evaluated.agg(F.count("*").alias("actual"), *[F.count_if(v).alias(k) for k, v in counts.items()])
    out = out.withColumn("expected", F.lit(expected).cast("long")).withColumn("missing", F.greatest(F.col("expected") - F.col("actual"), F.lit(0).cast("long")))
    fine = F.col("missing") == 0
    for c in counts:
        fine = fine & (F.col(c) == 0)
    return out.withColumn("status", F.when(fine, "ok").otherwise("issues"))


def issue_rows(evaluated: DataFrame, key: list[str], reason: str = "Judge_Begruendung") -> DataFrame:
    """The distinct tasks that are to be judged again: without a score, failed, or with a judge issue; sorted."""
    bad = F.col("Likert_Score").isNull() | (F.trim(F.coalesce("error", F.lit(""))) != "")
    bad = bad | judging.has_issue(F.col(reason)) if reason in evaluated.columns else bad
    return evaluated.where(bad).select(*key).distinct().orderBy(*key)
