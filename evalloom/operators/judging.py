"""Judged answers: measures of each row, usage totals, issue rows, contexts with fallback."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

# Fixed values.
ISSUE_MARKERS = ("API Error", "Judge JSON parse failed", "Judge returned empty response", "Benchmark API Error")


def has_issue(reason: Column) -> Column:
    text = F.lower(F.coalesce(reason, F.lit("")))
    out = F.lit(False)
    for m in ISSUE_MARKERS:
        out = out | text.contains(m.lower())
    return out


def measures(rows: DataFrame, judge: str = "judge_text", claims: str = "claim_text", predicted: str = "predicted_text", answer: str = "KI_Antwort") -> DataFrame:
    """All measures of judged rows from the raw judge texts and the answer; the judge's own score and coverage come first."""
    out = rows.withColumns({"__j": S.judge_object(F.col(judge)), "__c": S.judge_object(F.col(claims)), "__p": S.judge_object(F.col(predicted))})
    score, coverage = S.judge_score(F.col(judge), F.col("__j"))
    claim = lambda name: S.claim_count(F.col(claims), name, F.col("__c"))
    said = lambda name: S.claim_count(F.col(predicted), name, F.col("__p"))
    out = out.withColumns({
        "__score": score, "__cover": coverage, "__pass": S.trap_pass(F.col(claims), F.col("__c")),
        "Supported_Claims": claim("supported"), "Contradicted_Claims": claim("contradicted"), "Not_In_Scope_Claims": claim("not_in_scope"),
        "Predicted_Supported_Claims": said("predicted_supported_claims"), "Predicted_Unsupported_Claims": said("predicted_unsupported_claims"), "__total": said("predicted_total_claims"),
    })
    sup, con, nis = F.col("Supported_Claims"), F.col("Contradicted_Claims"), F.col("Not_In_Scope_Claims")
    total, said = sup + con + nis, F.col("Predicted_Supported_Claims") + F.col("Predicted_Unsupported_Claims")
    rates = S.claim_rates(sup, con, nis)
    out = out.withColumns({"Total_Claims": total, "Predicted_Total_Claims": F.when(F.col("__total") > 0, F.col("__total")).otherwise(said), **rates})
    precision = S.precision(F.col("Predicted_Supported_Claims"), F.col("Predicted_Total_Claims"))
    trap = F.col("Is_Trap_Question") >= 0.5 if "Is_Trap_Question" in rows.columns else F.lit(False)
    passed = F.when(trap, F.col("__pass"))
    marks = S.confidence_scores(F.col(answer))
    out = out.withColumns({"Likert_Score": F.coalesce("__score", S.likert(sup, con, nis)), "Atomic_Coverage_Score": F.coalesce("__cover", F.when(total > 0, F.col("Support_Rate"))), "Atomic_Precision": precision, "Hallucination_Rate": 1 - precision, "Trap_Pass": passed, "Trap_Hallucination": 1 - passed, "Trap_Fallibility": 1 - passed, "Confidence_Mean": S.array_mean(marks), "Confidence_Found_Flag": (F.size(marks) > 0).cast("int")})
    return out.drop("__score", "__cover", "__pass", "__total", "__j", "__c", "__p")


def judge(rows: DataFrame, client: Callable[[str], tuple[str, int, int]], prompt: str = "judge_prompt", out: str = "judge_text") -> DataFrame:
    """Adds the judge's text and tokens; a failed call gives an empty text and its reason."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = []
            for p in pdf[prompt]:
                try:
                    told.append((*client(p), ""))
                except Exception as e:  # noqa: BLE001 - recorded with the row
                    told.append(("", 0, 0, f"API Error: {e}"))
            pdf = pdf.copy()
            pdf[[out, "judge_input_tokens", "judge_output_tokens", "judge_issue"]] = pd.DataFrame(told, columns=list("abcd"), index=pdf.index)
            yield pdf

    return rows.mapInPandas(run, f"{kinds}, {out} string, judge_input_tokens long, judge_output_tokens long, judge_issue string")


def usage(rows: DataFrame) -> DataFrame:
    """Totals and means of a judged run; missing precision does not count."""
    return rows.agg(
        F.count("*").alias("rows"), F.sum("judge_input_tokens").alias("judge_input_tokens_total"), F.sum("judge_output_tokens").alias("judge_output_tokens_total"), F.round(F.sum("judge_cost_usd"), 6).alias("judge_cost_usd_total"),
        F.round(F.avg("judge_input_tokens"), 3).alias("judge_input_tokens_avg"), F.round(F.avg("judge_output_tokens"), 3).alias("judge_output_tokens_avg"), F.round(F.avg("Support_Rate"), 6).alias("support_rate_avg"),
        F.round(F.avg("Atomic_Precision"), 6).alias("atomic_precision_avg"), F.round(F.avg("Hallucination_Rate"), 6).alias("hallucination_rate_avg"), F.sum(F.col("Is_Trap_Question").cast("long")).alias("trap_questions"),
    )


def error_samples(rows: DataFrame, order: str, columns: list[str], n: int = 8, width: int = 260) -> DataFrame:
    """The first ``n`` rows with errors (a report), cells on one line and cut at ``width``."""
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width), F.lit("..."))).otherwise(c)
    flat = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\r\n]", " ")
    return rows.where(F.trim(F.coalesce("error", F.lit(""))) != "").orderBy(order).limit(n).select(*[cut(flat(c)).alias(c) for c in columns])


def with_fallback(filtered: DataFrame, unfiltered: DataFrame) -> DataFrame:
    """(query_id, context): the filtered one, or the other where it is missing or empty."""
    a = filtered.select("query_id", F.col("context").alias("__f"))
    return unfiltered.join(a, "query_id", "left").select("query_id", F.when(F.coalesce("__f", F.lit("")) != "", F.col("__f")).otherwise(F.col("context")).alias("context"))


def top_groups(rows: DataFrame, by: str, n: int = 6) -> DataFrame:
    """Rows of the first ``n`` groups in order of their name (a report)."""
    first = rows.select(by).distinct().orderBy(by).limit(n)
    return rows.join(F.broadcast(first), by, "left_semi")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def group_consistency(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, consistency): mean cosine of all pairs of a group's vectors, (|sum of unit vectors|^2 - n) / (n (n - 1)).

    Null groups, null vectors and vectors of length 0 do not count; groups of fewer than two vectors are left out.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    own = rows.where(F.col(group).isNotNull()).select(group, v.alias("v"), size.alias("size")).where("size > 0")
    sums = own.select(group, "size", F.posexplode("v").alias("at", "x")).groupBy(group, "at").agg(F.sum(F.col("x") / F.col("size")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.max("n").alias("n")).where("n > 1").select(group, ((F.col("sq") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("consistency"))
