"""Question catalogues to questions: header aliases, facts, expected trap behaviour and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

# Headers of catalogues and the field that each fills; of several that are there the later one counts.
HEADERS = [
    ("ID", "id"),
    ("Kategorie", "category"),
    ("Aufgabentyp", "task_type_raw"),
    ("Frage", "question"),
    ("Goldstandard", "reference_answer"),
    ("Referenzantwort", "reference_answer"),
    ("Context | Dokumente", "relevant_docs"),
    ("Schwierigkeitslevel", "difficulty"),
    ("Antwortoptionen", "answer_type"),
    ("Expected Trap Behavior", "expected_trap_behavior"),
    ("Expected_Trap_Behavior", "expected_trap_behavior"),
    ("Trap-Kriterium", "expected_trap_behavior"),
    ("Fangfrage Kriterium", "expected_trap_behavior"),
    ("Fangfragen-Kriterium", "expected_trap_behavior"),
    ("max wörter", "max_words"),
    ("max_wörter", "max_words"),
]
FACT_HEADERS = ["Atomic Facts", "Atomic_Facts", "AtomicFacts"]
REFERENCE_HEADERS = ["Referenzantwort", "Goldstandard"]
BEHAVIOUR = "Die Antwort soll die falsche oder unvollstaendige Praemisse erkennen, keine Direktberechnung bzw. unbegruendete Schlussfolgerung liefern und sinngemaess diese Einschraenkung nennen: "
BEHAVIOUR_ALONE = "Die Antwort soll die Fangfrage erkennen und fehlende oder falsche Voraussetzungen benennen."

FIELDS = ["id", "category", "task_type_raw", "question", "reference_answer", "relevant_docs", "difficulty", "answer_type", "expected_trap_behavior", "max_words"]


def _cell(name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.trim(F.coalesce(value.cast("string"), F.lit("")))


def _filled(facts: Column) -> Column:
    return F.when(F.size(facts) > 0, facts)


def facts_of(columns: list[str]) -> Column:
    """Facts of a row: of the first fact column that has some, else of a reference cut at semicolons, else of all atomic_fact_ columns."""
    choices = [_filled(S.atomic_facts(_cell(c))) for c in FACT_HEADERS if c in columns]
    for c in REFERENCE_HEADERS:
        if c in columns:
            parts = F.transform(F.split(_cell(c), ";"), lambda x: F.regexp_replace(x, r"^[ \t-]+|[ \t-]+$", ""))
            choices.append(_filled(F.filter(parts, lambda x: x != "")))
    numbered = [c for c in columns if c.lower().startswith("atomic_fact_")]
    choices.append(F.filter(F.array(*[_cell(c) for c in numbered]), lambda x: x != "") if numbered else F.array().cast("array<string>"))
    return F.coalesce(*choices, F.array().cast("array<string>"))


def to_questions(catalogue: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Questions (FIELDS and atomic_facts) of a catalogue's rows.

    ``overrides`` has ``id`` and any of reference_answer and expected_trap_behavior: what is not null there replaces the row's own, and a
    new reference gives new facts. It is a dimension of a row a question. A field whose headers are all absent is empty.
    """
    source = {}
    for header, field in HEADERS:
        if header in catalogue.columns:
            source[field] = header
    own = catalogue.select(*[(_cell(source[f]) if f in source else F.lit("")).alias(f) for f in FIELDS], facts_of(catalogue.columns).alias("atomic_facts"))
    own = own.withColumn("reference_answer", F.when(F.col("reference_answer") == "", F.array_join("atomic_facts", "; ")).otherwise(F.col("reference_answer")))
    trap = F.lower("answer_type").rlike("fangfrage|trap")
    derived = F.when(F.col("reference_answer") != "", F.concat(F.lit(BEHAVIOUR), "reference_answer")).otherwise(BEHAVIOUR_ALONE)
    own = own.withColumn("expected_trap_behavior", F.when(F.col("expected_trap_behavior") != "", F.col("expected_trap_behavior")).when(trap, derived).otherwise(""))
    if overrides is None:
        return own
    none = F.lit(None).cast("string")
    new = overrides.select(F.trim(F.col("id").cast("string")).alias("id"), *[(F.col(c) if c in overrides.columns else none).alias(f"__{c}") for c in ("reference_answer", "expected_trap_behavior")])
    out = own.join(new, "id", "left")
    facts = F.when(F.col("__reference_answer").isNotNull(), S.atomic_facts(F.col("__reference_answer"))).otherwise(F.col("atomic_facts"))
    replaced = {c: F.coalesce(f"__{c}", c) for c in ("reference_answer", "expected_trap_behavior")}
    return out.select(*[replaced.get(f, F.col(f)).alias(f) for f in FIELDS], facts.alias("atomic_facts"))
