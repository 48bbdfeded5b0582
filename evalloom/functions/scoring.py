"""Scoring expressions: claim rates, judge output, confidence markers, traps, facts, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields of broken judge output, and words for a passed or failed trap.
SCORE = r'(?i)"?score"?\s*:\s*([0-4](?:\.\d+)?)'
COVERAGE = r'(?i)"?coverage"?\s*:\s*(0(?:\.\d+)?|1(?:\.0+)?)'
TRAP_PASS = r'(?i)"?trap_pass"?\s*:\s*(true|false|0|1|0\.0|1\.0)'
PASSED = ["true", "yes", "ja", "pass", "passed"]
FAILED = ["false", "no", "nein", "fail", "failed"]


def likert(supported: Column, contradicted: Column, not_in_scope: Column) -> Column:
    """0 to 4 from claim counts; null without claims."""
    total = supported + contradicted + not_in_scope
    rate = supported / F.greatest(total, F.lit(1))
    return F.when(total <= 0, F.lit(None).cast("double")).when((supported >= total) & (contradicted == 0), 4.0).when((rate >= 0.75) & (contradicted == 0), 3.0).when(rate >= 0.5, 2.0).when(supported > 0, 1.0).otherwise(0.0)


def claim_rates(supported: Column, contradicted: Column, not_in_scope: Column) -> dict[str, Column]:
    """Support, contradiction and not-in-scope rates; 0 without claims."""
    total = F.greatest(supported + contradicted + not_in_scope, F.lit(1))
    return {"Support_Rate": supported / total, "Contradiction_Rate": contradicted / total, "Not_In_Scope_Rate": not_in_scope / total}


def precision(supported: Column, total: Column) -> Column:
    """Null unless something was claimed."""
    return F.when(total > 0, supported / F.greatest(total, F.lit(1)))


def confidence_scores(text: Column) -> Column:
    """All markers #0 to #3."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"#\s*([0-3])\b"), 1), lambda x: x.cast("double"))


def array_mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values), F.lit(1)))


def is_trap(answer_type: Column, reference: Column) -> Column:
    text = F.lower(F.concat_ws(" ", answer_type, reference))
    return text.rlike("fangfrage|trap|false premise|falsche prämisse|falsche praemisse")


def answer_class(answer_type: Column) -> Column:
    """binary, extraction, atomic_facts or free_text, by what the type's name holds."""
    t = F.lower(F.coalesce(answer_type, F.lit("")))
    return F.when(t.rlike("wahr|falsch"), "binary").when(t.rlike("extraktion|extract"), "extraction").when(t.rlike("atomic|fakt"), "atomic_facts").otherwise("free_text")


def judge_object(raw: Column) -> Column:
    """The JSON object of judge output as a variant: the whole text, else its outermost braces; null if neither is one.

    Give it a column of its own and pass that as ``obj``, and the text is parsed once for all fields.
    """
    t = F.trim(F.coalesce(raw, F.lit("")))
    whole = F.try_parse_json(t)
    inner = F.try_parse_json(F.regexp_extract(t, r"(?s)(\{.*\})", 1))
    ok = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.when(ok(whole), whole).when(ok(inner), inner)


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _field(obj: Column, name: str) -> Column:
    return F.try_variant_get(obj, f"$.{name}", "string")


def _kind(obj: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(obj, f"$.{name}", "variant"))


def judge_score(raw: Column, obj: Column | None = None) -> tuple[Column, Column]:
    """(score, coverage) of judge output: strict JSON, else braces, else by pattern; scores outside 0 to 4 are null."""
    obj = judge_object(raw) if obj is None else obj
    t = F.trim(F.coalesce(raw, F.lit("")))
    found = F.regexp_extract(t, SCORE, 1)
    cover = F.regexp_extract(t, COVERAGE, 1)
    score = _number(_field(obj, "score"))
    score = F.when((score >= 0) & (score <= 4), score)
    lost = F.when(found != "", _number(cover))
    return F.when(obj.isNotNull(), score).otherwise(_number(found)), F.when(obj.isNotNull(), _number(_field(obj, "coverage"))).otherwise(lost)


def claim_count(raw: Column, name: str, obj: Column | None = None) -> Column:
    """A non-negative integer field: numbers truncate, true is 1, text counts only if it is a whole number; by pattern if the JSON is broken."""
    obj = judge_object(raw) if obj is None else obj
    value, kind = _field(obj, name), _kind(obj, name)
    whole = F.when(F.trim(value).rlike(r"^[+-]?\d+$"), _number(F.trim(value)))
    cut = F.floor(F.abs(_number(value))) * F.signum(_number(value))
    plain = F.when(kind == "BOOLEAN", F.when(value == "true", 1.0).otherwise(0.0)).when(kind == "STRING", whole).otherwise(cut)
    found = F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), rf'(?i)"?{name}"?\s*:\s*(\d+)', 1)
    return F.greatest(F.lit(0), F.coalesce(F.when(obj.isNotNull(), plain).otherwise(_number(found)), F.lit(0))).cast("long")


def trap_pass(raw: Column, obj: Column | None = None) -> Column:
    obj = judge_object(raw) if obj is None else obj
    t = F.trim(F.coalesce(raw, F.lit("")))
    value = F.lower(F.trim(F.when(obj.isNotNull(), _field(obj, "trap_pass")).otherwise(F.regexp_extract(t, TRAP_PASS, 1))))
    n = _number(value)
    return F.when(value.isin(*PASSED), 1.0).when(value.isin(*FAILED), 0.0).when(n >= 0.5, 1.0).when(n < 0.5, 0.0)


def atomic_facts(text: Column) -> Column:
    """Facts of a text: at line ends, semicolons and bars; without leading and trailing dashes and blanks."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n|;|\|"), lambda x: F.regexp_replace(x, r"^[ \t-]+|[ \t-]+$", ""))
    return F.filter(parts, lambda x: x != "")


def task_type(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(t.rlike("wissen|knowledge|fakten"), "Wissensbasiert")
        .when(t.rlike("reasoning|analyt|analyse|schluss|logik"), "Analytisch / Reasoning")
        .when(t.rlike("kalkulation|berechnung|rechen|determin"), "Rechen-/deterministisch")
        .otherwise("Unklar/sonstige")
    )


def effect_label(value: Column, lang: str = "en") -> Column:
    a = F.abs(F.nanvl(value.cast("double"), F.lit(None).cast("double")))
    if lang == "de":
        return F.when(a.isNull(), "unknown").when(a < 0.3, "klein").when(a < 0.5, "mittel").otherwise("gross")
    return F.when(a.isNull(), "unknown").when(a < 0.1, "negligible").when(a < 0.3, "small").when(a < 0.5, "medium").otherwise("large")


def number_text(text: Column) -> Column:
    """Numbers with German or English separators as double: the later of both separators is the decimal one; a
    lone kind of separator before groups of three digits parts thousands."""
    t = F.regexp_replace(F.trim(text), "[ _]", "")
    comma, dot = F.instr(F.reverse(t), ","), F.instr(F.reverse(t), ".")
    swapped = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    grouped = t.rlike(r"^[+-]*[0-9]+(,[0-9]{3})+$") | t.rlike(r"^[+-]*[0-9]+(\.[0-9]{3})+$")
    out = F.when((comma > 0) & (dot > 0), F.when(comma < dot, swapped).otherwise(F.replace(t, F.lit(","), F.lit("")))).when(grouped, F.regexp_replace(t, "[.,]", "")).when(comma > 0, F.replace(t, F.lit(","), F.lit("."))).otherwise(t)
    return out.try_cast("double")


def evaluate_binary(answer: Column, reference: Column) -> Column:
    """5 if both agree, or the answer holds the reference's truth word; else 1."""
    g, r = F.lower(F.trim(answer)), F.lower(F.trim(reference))
    same = g == r
    for word in ("wahr", "falsch", "true", "false"):
        same = same | (r.contains(word) & g.contains(word))
    return F.when(same, 5).otherwise(1)


def evaluate_extraction(answer: Column, reference: Column) -> Column:
    """5 if the answer contains the reference, which is not empty; else 1."""
    r = F.lower(F.trim(reference))
    return F.when((r != "") & F.lower(answer).contains(r), 5).otherwise(1)
