"""Statistics of evaluated results: task and run level, paired tests, correction, intervals, summaries."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import normal as N
from ..functions import scoring as S
from . import normality

# Fixed values.
METHODS = ["Zero-Shot", "Advanced-Prompt", "RAG"]
METHOD_ALIASES = {"Advanced Prompt": "Advanced-Prompt", "Advanced Prompting": "Advanced-Prompt"}
METHOD_LABELS = {"Advanced-Prompt": "Advanced Prompting"}
COMPARISONS = [("Zero-Shot", "Advanced-Prompt"), ("Zero-Shot", "RAG"), ("Advanced-Prompt", "RAG")]
METRICS = {"Atomic_Coverage_Score": 1, "Atomic_Precision": 1, "Hallucination_Rate": -1}
#: Up to so many pairs that differ, p is exact.
EXACT_PAIRS = 1000
#: Draws of a resampling that are made at once.
DRAWS = 1 << 16
DEFAULTS = {
    "Model": ("string", "unknown"), "Method": ("string", "unknown"), "ID": ("string", "unknown"), "Run_ID": ("long", None), "KI_Antwort": ("string", ""),
    **{c: ("double", None) for c in ["Cost_USD", "Dauer_sek", "Atomic_Coverage_Score", "Support_Rate", "Atomic_Precision", "Hallucination_Rate", "Contradiction_Rate", "Not_In_Scope_Rate", "Trap_Pass", "Trap_Hallucination", "Trap_Fallibility", "Is_Trap_Question", "Confidence_Mean"]},
    "Confidence_Found_Flag": ("int", 0),
}


def ensure_columns(df: DataFrame, defaults: dict = DEFAULTS) -> DataFrame:
    return df.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in defaults.items() if c not in df.columns})


def no_nan(df: DataFrame) -> DataFrame:
    """NaN of float columns becomes null."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})


def prepare(df: DataFrame) -> DataFrame:
    """Defaults, method names, mutual fills and confidence measures; rows without a Likert score go."""
    df = no_nan(ensure_columns(df))
    names = F.trim("Method")
    for a, b in METHOD_ALIASES.items():
        names = F.when(F.trim("Method") == a, b).otherwise(names)
    df = df.withColumn("Method", F.when(F.trim("Method") == "", "unknown").otherwise(names))
    df = df.withColumns({"Atomic_Coverage_Score": F.coalesce("Atomic_Coverage_Score", "Support_Rate"), "Support_Rate": F.coalesce("Support_Rate", "Atomic_Coverage_Score")})
    none = df.agg((F.count("Hallucination_Rate") == 0).alias("none"))  # one row
    df = df.crossJoin(F.broadcast(none)).withColumn("Hallucination_Rate", F.when(F.col("none"), 1.0 - F.col("Atomic_Precision")).otherwise(F.col("Hallucination_Rate"))).drop("none")
    df = df.withColumn("Confidence_Norm", 1.0 - F.col("Confidence_Mean") / 3.0)
    df = df.withColumns({"Overconfidence": F.col("Confidence_Norm") * (1.0 - F.col("Support_Rate")), "Confidence_Accuracy_Gap": F.col("Confidence_Norm") - F.col("Support_Rate")})
    return df.where("Likert_Score is not null") if "Likert_Score" in df.columns else df


def jaccard_consistency(df: DataFrame, by: list[str], text: str = "KI_Antwort") -> DataFrame:
    """Mean Jaccard overlap of the word sets of all pairs of valid answers of a group; 0 with fewer than two.

    Pairs are not formed: the answers of a group (its runs) are few, and are compared inside one row.
    """
    t = F.lower(F.trim(text))
    valid = F.when((t != "") & (t != "nan") & ~F.col(text).contains("API ERROR"), F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")))
    own = df.groupBy(*by).agg(F.collect_list(F.when(valid.isNotNull(), F.struct(valid.alias("w")))).alias("a"))
    n = F.size("a")
    overlap = lambda x, y: F.size(F.array_intersect(x["w"], y["w"])) / F.greatest(F.size(F.array_union(x["w"], y["w"])), F.lit(1))
    total = F.aggregate(F.transform("a", lambda x, i: F.aggregate(F.slice("a", i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda s, y: s + overlap(x, y))), F.lit(0.0), lambda s, v: s + v)
    return own.select(*by, F.when(n < 2, 0.0).otherwise(total / F.greatest(n * (n - 1) / 2, F.lit(1))).alias("Semantic_Consistency"))


def task_level(prepared: DataFrame) -> DataFrame:
    """A row a (Model, Method, ID)."""
    by = ["Model", "Method", "ID"]
    mean, std = F.avg, F.stddev_samp
    out = prepared.groupBy(*by).agg(
        mean("Is_Trap_Question").alias("Is_Trap_Question"), mean("Support_Rate").alias("Task_Score"), std("Support_Rate").alias("Task_Run_Score_Std"),
        std("Atomic_Coverage_Score").alias("Task_Run_Coverage_Std"), std("Atomic_Precision").alias("Task_Run_Precision_Std"), std("Hallucination_Rate").alias("Task_Run_Hallucination_Std"),
        F.when(F.round(mean("Support_Rate"), 12) < 0.5, 1).otherwise(0).alias("Critical_Fail"), mean("Cost_USD").alias("Avg_Cost"), mean("Dauer_sek").alias("Avg_Time"),
        *[mean(c).alias(c) for c in ["Atomic_Coverage_Score", "Support_Rate", "Atomic_Precision", "Hallucination_Rate", "Contradiction_Rate", "Not_In_Scope_Rate"]],
        mean("Support_Rate").alias("Task_Binary_Score"), mean("Is_Trap_Question").alias("Trap_Question_Share"), mean("Confidence_Found_Flag").alias("Task_Confidence_Found_Rate"),
        mean("Trap_Pass").alias("Trap_Pass_Rate"), mean("Trap_Hallucination").alias("Trap_Hallucination_Rate"), mean("Trap_Fallibility").alias("Trap_Fallibility"),
        mean("Confidence_Mean").alias("Task_Confidence_Mean"), mean("Overconfidence").alias("Task_Overconfidence_Score"), mean("Confidence_Accuracy_Gap").alias("Task_Confidence_Accuracy_Gap"),
        F.count("*").alias("n_rows"),
    )
    return out.join(jaccard_consistency(prepared, by), by, "left")


def non_trap(tasks: DataFrame) -> DataFrame:
    return tasks.where("coalesce(Is_Trap_Question, 0) < 0.5")


def traps(tasks: DataFrame) -> DataFrame:
    return tasks.where("coalesce(Is_Trap_Question, 0) >= 0.5")


def method_label(method: str) -> str:
    return METHOD_LABELS.get(method, method)


def comparison_label(a: str, b: str) -> str:
    return f"{method_label(a)} vs {method_label(b)}"


def pairs(tasks: DataFrame, metric: str = "Task_Score", comparisons=COMPARISONS, value: str | None = None, label=comparison_label, order: str | None = None) -> DataFrame:
    """(Model, comparison, ID, a, b, diff) of all models and comparisons in one self-join; differences rounded to 12 digits before ranking.

    Of rows that share a model, method and ID the first by ``order`` counts; without an order they must not occur.
    """
    own = tasks.select("Model", "Method", "ID", F.col(value or metric).alias("v"), *([F.col(order).alias("__o")] if order else []))
    if order:
        own = own.groupBy("Model", "Method", "ID").agg(F.min_by(F.struct("v"), "__o").alias("f")).select("Model", "Method", "ID", "f.v")
    spark = tasks.sparkSession
    wanted = spark.createDataFrame([(x, y, label(x, y)) for x, y in comparisons], "ma string, mb string, comparison string")
    a = own.join(F.broadcast(wanted), F.col("Method") == F.col("ma")).select("Model", "ID", "mb", "comparison", F.col("v").alias("a"))
    b = own.select("Model", "ID", F.col("Method").alias("mb"), F.col("v").alias("b"))
    return a.join(b, ["Model", "ID", "mb"]).select("Model", "comparison", "ID", "a", "b", F.round(F.col("b") - F.col("a"), 12).alias("diff"))


def signed_ranks(diffs: DataFrame, by: list[str], exact: int = EXACT_PAIRS) -> DataFrame:
    """The signed-rank test of each group's differences: counts, W+, W-, statistic, z, r, rank-biserial effect, p and its method.

    Zeros are left out of the ranks; equal sizes share their mean rank. Differences are counted by size in the tasks first, so what
    a group sorts are its distinct sizes. p is two-sided: exact up to ``exact`` pairs that differ (ties included), from the
    tie-corrected normal form beyond; null for fewer than two pairs.
    """
    sized = diffs.where("diff is not null").groupBy(*by, F.abs("diff").alias("size")).agg(F.count("*").alias("c"), F.count_if(F.col("diff") > 0).alias("up"), F.sum("diff").alias("s"))
    own = Window.partitionBy(*by)
    counted = F.when(F.col("size") > 0, F.col("c")).otherwise(0)
    ranked = sized.withColumns({"upto": F.sum(counted).over(own.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)), "nz": F.sum(counted).over(own)})
    ranked = ranked.withColumn("doubled", F.when(F.col("size") > 0, 2 * F.col("upto") - F.col("c") + 1))  # twice the rank: ties have halves
    rank = F.col("doubled") / 2.0
    few = F.when(F.col("nz") <= exact, F.struct("doubled", "c"))
    out = ranked.groupBy(*by).agg(
        F.sum("c").alias("n_pairs"), F.max("nz").alias("n_nonzero"), (F.sum("s") / F.sum("c")).alias("mean_diff"), F.max("size").alias("max_diff"),
        F.coalesce(F.sum(rank * F.col("up")), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(rank * (F.col("c") - F.col("up"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(rank * rank * F.col("c")), F.lit(0.0)).alias("squares"), F.filter(F.collect_list(few), lambda x: x["doubled"].isNotNull()).alias("ties"),
    )
    total = F.col("w_plus") + F.col("w_minus")
    none = F.col("n_nonzero") == 0
    z = F.when(none, 0.0).otherwise(F.try_divide(F.col("w_plus") - total / 2.0, F.sqrt(F.col("squares") / 4.0)))
    out = out.withColumns({"statistic": F.least("w_plus", "w_minus"), "z": z, "effect": F.when(total == 0, 0.0).otherwise(F.try_divide(F.col("w_plus") - F.col("w_minus"), total))})
    small = F.col("n_nonzero") <= exact
    p = F.when(none, 1.0).when(small, _exact_ps("ties", "w_plus")).otherwise(F.least(F.lit(1.0), 2.0 * N.upper_tail(F.abs("z"))))
    enough = F.col("n_pairs") >= 2
    return out.withColumns({
        "r": F.when(none, 0.0).otherwise(F.try_divide("z", F.sqrt(F.col("n_nonzero").cast("double")))),
        "p": F.when(enough, p), "p_method": F.when(enough, F.when(small, "exact").otherwise("normal")),
    }).drop("ties")


def exact_p(doubled, counts, seen: int) -> float:
    """Exact two-sided p of a sum of doubled ranks: the chances of all sums are the product of a polynomial a size of difference."""
    leaves = []
    for r, c in zip(doubled, counts, strict=True):
        chance = np.zeros(int(r) * int(c) + 1)
        chance[:: int(r)] = [math.comb(int(c), k) / 2 ** int(c) for k in range(int(c) + 1)]
        leaves.append(chance)
    if not leaves:
        return 1.0
    leaves.sort(key=len)
    while len(leaves) > 1:
        leaves = [_product(*leaves[i : i + 2]) for i in range(0, len(leaves), 2)]
    return float(min(1.0, 2 * max(0.0, min(leaves[0][: seen + 1].sum(), leaves[0][seen:].sum()))))


def _product(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    if b is None:
        return a
    if min(len(a), len(b)) < 256:
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.maximum(np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n], 0.0)


@F.pandas_udf(DoubleType())
def _exact_ps(ties: pd.Series, w_plus: pd.Series) -> pd.Series:
    return pd.Series([exact_p([t["doubled"] for t in own], [t["c"] for t in own], round(2 * w)) if len(own) else 1.0 for own, w in zip(ties, w_plus, strict=True)], dtype=float)


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p", q: str = "q") -> DataFrame:
    """Adds ``q``; null p stay null and are not counted."""
    w = Window.partitionBy(*by, F.col(p).isNull())
    rank = F.row_number().over(w.orderBy(p))
    ranked = df.withColumn("__k", rank).withColumn("__m", F.count(p).over(w))
    down = Window.partitionBy(*by, F.col(p).isNull()).orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col("__m") / F.col("__k") * F.col(p)).over(down)))).drop("__k", "__m")


def long_pairs(tasks: DataFrame) -> DataFrame:
    """(metric, Model, comparison, ID, diff) of all metrics, oriented so that more is better."""
    metrics = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(float(s)).alias("sign"), F.col(m).cast("double").alias("v")) for m, s in METRICS.items()]))
    long = tasks.select("Model", "Method", "ID", metrics.alias("x")).select("Model", "Method", "ID", "x.*").where("v is not null")
    one = long.withColumn("Model", F.struct("metric", "Model")).withColumn("v", F.col("sign") * F.col("v"))
    return pairs(one, value="v").select("Model.metric", "Model.Model", "comparison", "ID", "diff")


def _favoured(a: Column, b: Column) -> Column:
    return F.when(F.col("max_diff") <= 1e-8, "tie").otherwise(F.concat(F.lit("favours_"), F.when(F.col("mean_diff") > 0, b).otherwise(a)))


def _direction() -> Column:
    """tie, or the method that the mean difference favours, from the name of the comparison."""
    return _favoured(F.split_part("comparison", F.lit(" vs "), F.lit(1)), F.split_part("comparison", F.lit(" vs "), F.lit(2)))


def test_effects(tasks: DataFrame, exact: int = EXACT_PAIRS) -> DataFrame:
    """Models x metrics x comparisons over non-trap questions; a single pair has no statistic. Differences are ranked once."""
    by = ["metric", "Model", "comparison"]
    d = long_pairs(non_trap(tasks))
    out = signed_ranks(d, by, exact)
    enough = F.col("n_pairs") >= 2
    some = {c: F.when(enough, F.col(c)) for c in ("statistic", "z", "r")}
    out = out.withColumns({**some, "n_nonzero": F.when(enough, F.col("n_nonzero")).otherwise(0), "direction": _direction()})
    out = out.withColumn("label", S.effect_label(F.col("r"), "de"))
    shapiro = normality.shapiro_wilk(d, by).select(*by, F.col("p").alias("shapiro_p"))
    return out.join(shapiro, by, "left").select(*by, "n_pairs", "n_nonzero", "statistic", "z", "r", "label", "direction", "p", "p_method", "shapiro_p")


def main_tests(tasks: DataFrame, exact: int = EXACT_PAIRS) -> DataFrame:
    """``test_effects`` with q over the comparisons of a model and metric."""
    return benjamini_hochberg(test_effects(tasks, exact), ["Model", "metric"])


def robustness(runs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Shares of runs whose direction and significance agree with all runs together, by model, metric and comparison.

    ``runs`` is prepared; each run's pairs are formed on its own, and runs of fewer than two pairs do not count. All runs
    together are significant by q to four digits, as it is exported.
    """
    by = ["metric", "Model", "comparison"]
    both = main_tests(task_level(runs)).select(*by, F.col("direction").alias("all_direction"), (F.coalesce(half_even(F.col("q")), F.lit(1.0)) < alpha).alias("all_significant"))
    flat = non_trap(runs.where("Run_ID is not null").groupBy("Model", "Method", "Run_ID", "ID").agg(F.avg("Is_Trap_Question").alias("Is_Trap_Question"), *[F.avg(m).alias(m) for m in METRICS]))
    d = long_pairs(flat.withColumn("Model", F.struct(F.col("Run_ID").cast("string").alias("run"), "Model")))
    each = signed_ranks(d, by).where("n_pairs >= 2").select("metric", "Model.run", "Model.Model", "comparison", "p", _direction().alias("dir"))
    out = both.join(each, by, "left")
    counted = F.col("run").isNotNull()
    same = lambda test: F.avg(F.when(counted, test.cast("double")))
    shares = out.groupBy(*by).agg(F.count_if(counted).alias("n_runs"), same(F.col("dir") == F.col("all_direction")).alias("direction_share"), same((F.coalesce("p", F.lit(1.0)) < alpha) == F.col("all_significant")).alias("significance_share"))
    stable = lambda c: F.coalesce(F.col(c) == 1.0, F.lit(False))
    return shares.withColumns({"direction_stable": stable("direction_share"), "significance_stable": stable("significance_share")})


def half_even(value: Column, digits: int = 4) -> Column:
    """Rounded as binary values are: scaled, to the even neighbour in the middle."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def resampled_means(values: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Means of resamples with replacement: the draws of ``random.Random(seed).randrange``, ``DRAWS`` at a time."""
    n = len(values)
    *key, place = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key, dtype=np.uint32), "pos": place}}
    shift = np.uint64(32 - n.bit_length())
    sums, at = np.zeros(resamples), 0
    while at < n * resamples:
        drawn = bits.random_raw(DRAWS) >> shift
        picked = values[drawn[drawn < n][: n * resamples - at]]
        if len(picked):
            own = at // n
            starts = np.append(0, np.arange((own + 1) * n - at, len(picked), n))
            sums[own : own + len(starts)] += np.add.reduceat(picked, starts)
            at += len(picked)
    return sums / n


def bootstrap_ci(tasks: DataFrame, by: list[str] = ["Model", "Method"], value: str = "Task_Score", key: str = "ID", resamples: int = 1000, seed: int = 42) -> DataFrame:  # noqa: B006
    """(by, ci_low, ci_high): percentile interval of the mean, from a seeded resampling of the values in the order of their ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(key)[value].dropna().to_numpy(dtype=np.float64)
        out = pdf[by].head(1).copy()
        out["ci_low"] = out["ci_high"] = float("nan")
        if len(values) >= 2:
            means = np.sort(resampled_means(values, resamples, seed))
            out["ci_low"], out["ci_high"] = means[int(resamples * 0.025)], means[int(resamples * 0.975) - 1]
        return out

    kinds = dict(tasks.dtypes)
    return tasks.select(*by, key, value).groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", ci_low double, ci_high double")


def run_pair_coverage(prepared: DataFrame, comparisons=COMPARISONS, label=comparison_label) -> DataFrame:
    """(Model, comparison, coverage): mean over shared questions that are no traps of common runs by the larger number of runs."""
    own = non_trap(prepared).groupBy("Model", "Method", "ID").agg(F.array_distinct(F.collect_list("Run_ID")).alias("runs"))
    spark = prepared.sparkSession
    wanted = spark.createDataFrame([(x, y, label(x, y)) for x, y in comparisons], "ma string, mb string, comparison string")
    a = own.join(F.broadcast(wanted), F.col("Method") == F.col("ma")).select("Model", "ID", "mb", "comparison", F.col("runs").alias("ra"))
    both = a.join(own.select("Model", "ID", F.col("Method").alias("mb"), F.col("runs").alias("rb")), ["Model", "ID", "mb"])
    most = F.greatest(F.size("ra"), F.size("rb"))
    return both.where(most > 0).groupBy("Model", "comparison").agg(F.avg(F.size(F.array_intersect("ra", "rb")) / most).alias("coverage"))


def model_method_stats(tasks: DataFrame, time_cost_factor: float = 0.002) -> DataFrame:
    """Means and deviations by model and method over non-trap questions, with the trap columns of all."""
    by = ["Model", "Method"]
    own = non_trap(tasks).groupBy(*by).agg(
        F.countDistinct("ID").alias("N"), F.avg("Task_Score").alias("Mean_Score"), F.stddev_samp("Task_Score").alias("Score_Std"), F.avg("Task_Run_Score_Std").alias("run_level_score_std"),
        F.avg("Task_Run_Coverage_Std").alias("run_level_coverage_std"), F.avg("Semantic_Consistency").alias("Consistency"), F.avg("Critical_Fail").alias("Critical_Fail_Rate"),
        F.avg("Avg_Cost").alias("Avg_Cost"), F.avg("Avg_Time").alias("Avg_Time"), F.avg("Task_Overconfidence_Score").alias("Overconfidence"),
        *[F.avg(c).alias(c) for c in ["Atomic_Coverage_Score", "Support_Rate", "Atomic_Precision", "Hallucination_Rate", "Contradiction_Rate", "Not_In_Scope_Rate"]],
        F.avg("Task_Run_Precision_Std").alias("run_level_precision_std"), F.avg("Task_Run_Hallucination_Std").alias("run_level_hallucination_std"),
        F.avg("Task_Confidence_Mean").alias("confidence_mean"), F.stddev_samp("Task_Confidence_Mean").alias("confidence_std"), F.avg("Task_Confidence_Accuracy_Gap").alias("confidence_accuracy_gap"),
    )
    trap = traps(tasks).groupBy(*by).agg(F.avg("Trap_Pass_Rate").alias("Trap_Pass_Rate"), F.avg("Trap_Hallucination_Rate").alias("Trap_Hallucination_Rate"), F.countDistinct("ID").alias("n_trap"))
    all_ids = tasks.groupBy(*by).agg(F.countDistinct("ID").alias("n_all"))
    out = own.join(trap, by, "left").join(all_ids, by, "left")
    out = out.withColumns({"Trap_Question_Share": F.coalesce(F.col("n_trap") / F.col("n_all"), F.lit(0.0)), "Total_Real_Cost": F.col("Avg_Cost") + F.col("Avg_Time") * time_cost_factor, "run_level_score_std": F.coalesce("run_level_score_std", "run_level_coverage_std"), "run_level_coverage_std": F.coalesce("run_level_coverage_std", "run_level_score_std")})
    return out.drop("n_trap", "n_all")


def stats_table(tasks: DataFrame, prepared: DataFrame, baseline: str = "Zero-Shot", time_cost_factor: float = 0.002, interval: bool = True) -> DataFrame:
    """The statistics table of ``exports.STATS_COLUMNS``: each method of a model with its means, and held against the model's baseline.

    The baseline itself has p = q = 1 and effect 0; q is over a model's other methods. Without ``interval`` the bounds are null.
    """
    by = ["Model", "Method"]
    own = model_method_stats(tasks, time_cost_factor)
    if interval:
        own = own.join(bootstrap_ci(non_trap(tasks)), by, "left")
    else:
        own = own.withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high")})
    versus = [(baseline, m) for m in METHODS if m != baseline]
    target = lambda a, b: b  # noqa: E731 - the comparison is named by its method
    tested = signed_ranks(pairs(non_trap(tasks), comparisons=versus, label=target), ["Model", "comparison"])
    same = F.col("max_diff") <= 1e-8
    enough = F.col("n_pairs") >= 2
    tested = tested.select("Model", F.col("comparison").alias("Method"), F.col("n_pairs").alias("paired_n"), F.when(enough & same, 1.0).otherwise(F.col("p")).alias("p"), F.when(enough & same, 0.0).otherwise(F.col("effect")).alias("effect"))
    runs = run_pair_coverage(prepared, versus, target).select("Model", F.col("comparison").alias("Method"), F.col("coverage").alias("run_level_pair_coverage"))
    out = own.join(benjamini_hochberg(tested, ["Model"]), by, "left").join(runs, by, "left")
    first = F.col("Method") == baseline
    fixed = {"paired_n": F.col("N"), "p": F.lit(1.0), "q": F.lit(1.0), "effect": F.lit(0.0), "run_level_pair_coverage": F.lit(1.0)}
    out = out.withColumns({c: F.when(first, v).otherwise(F.coalesce(c, F.lit(0)) if c == "paired_n" else F.col(c)) for c, v in fixed.items()})
    return out.withColumns({"test_name": F.when(first, "baseline_reference").otherwise("wilcoxon_signed_rank"), "baseline_method": F.lit(baseline), "effect_label": S.effect_label(F.col("effect"))})


def trap_summary(tasks: DataFrame) -> DataFrame:
    """Trap questions, pass and failure rates by model and method; 0 where a method has none."""
    trap = F.coalesce("Is_Trap_Question", F.lit(0.0)) >= 0.5
    rate = lambda c: F.coalesce(F.avg(F.when(trap, c)), F.when(F.count(F.when(trap, 1)) == 0, 0.0))
    return tasks.groupBy("Model", "Method").agg(F.count(F.when(trap, 1)).alias("n_trap"), rate(F.col("Trap_Pass_Rate")).alias("pass_rate"), rate(1 - F.col("Trap_Pass_Rate")).alias("fail_rate"))


def correlation(x: str, y: str) -> Column:
    """Pearson; null if either side is constant or fewer than two pairs."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b))


def overconfidence(prepared: DataFrame) -> DataFrame:
    """By model and method over non-trap rows: confidence, coverage, their correlation, and how often sure and wrong."""
    sure = ((F.col("Confidence_Norm") >= 2 / 3 - 1e-12) & (F.col("Atomic_Coverage_Score") < 0.5)).cast("double")
    return non_trap(prepared).groupBy("Model", "Method").agg(F.count("*").alias("n"), F.avg("Confidence_Norm").alias("mean_confidence"), F.avg("Atomic_Coverage_Score").alias("mean_coverage"), correlation("Confidence_Norm", "Atomic_Coverage_Score").alias("corr"), F.avg(F.coalesce(sure, F.lit(0.0))).alias("overconfident_rate"))
