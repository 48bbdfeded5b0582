"""Prompt templates compiled into column expressions, judge prompts with trap instructions, and their hashes."""

from __future__ import annotations

import hashlib
from string import Formatter

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

# Default templates and the sentences that prompts end with.
PLAIN = "{input_section}\nFRAGE: {question}"
DEFAULT_TEMPLATES = {
    "Zero-Shot": "{input_section}\nFRAGE: {question}",
    "Advanced-Prompt": "Du bist ein erfahrener Senior ESG Consultant.\n{input_section}\nFRAGE: {question}",
    "RAG": "Nutze ZUSAETZLICHES WISSEN aus der Datenbank, um die Frage zu beantworten:\n\nKONTEXT:\n{rag_context}\n\n{input_section}\nFRAGE: {question}",
}
INPUT_SECTION = "\nACHTUNG - DOKUMENT/INPUT:\n{input_doc_text}\n"
ONLY_BINARY = "\n\nAntworte ausschliesslich mit 'Wahr' oder 'Falsch'."
ONLY_FACTS = "\n\nAntworte ausschliesslich als Liste von Atomic Facts (ein Fakt pro Zeile; praezise, pruefbar, ohne Einleitung)."
FREE_TEXT = "\n\nAntworte als kurzen, zusammenhaengenden Freitext."
AS_FACTS = "\n\nFormatiere die Antwort als Liste von Atomic Facts (pro Zeile genau ein knapper, pruefbarer Fakt)."
MAX_WORDS = "\n\nFasse dich kurz. Max {n} Woerter."
MAX_RULE = "\n\nHalte die Antwort kurz. Zusatzregel zur Laenge: {n}"
CUT_NOTE = "\n\n[Prompt gekuerzt wegen max_prompt_chars]"
NO_FACTS = "- (keine Facts)"
EXPECTED = "\nErwartetes Fangfragen-Verhalten:\n{expected}\n"
EXPECTED_DEFAULT = "\nErwartetes Fangfragen-Verhalten: Die Antwort erkennt die falsche oder unvollstaendige Praemisse und gibt keine unbegruendete Direktantwort.\n"
TRAP_INSTRUCTIONS = """FANGFRAGEN-BEWERTUNG:
Diese Frage ist eine Fangfrage. Bewerte `trap_pass` als eigenstaendige Metrik, unabhaengig davon,
ob alle Atomic Facts vollstaendig reproduziert wurden.
- `trap_pass = 1`: Die Kandidaten-Antwort erkennt die falsche/unvollstaendige Praemisse, vermeidet eine
  unzulaessige Berechnung oder Schlussfolgerung und nennt die fachlich korrekte Einschraenkung.
- `trap_pass = 0`: Die Kandidaten-Antwort beantwortet die Fangfrage direkt, uebernimmt die falsche
  Praemisse, erfindet fehlende Angaben oder liefert eine unzulaessige Berechnung/Schlussfolgerung.
- Eine kurze korrekte Zurueckweisung darf `trap_pass = 1` erhalten, auch wenn einzelne Gold-Facts fehlen.
"""
JUDGE_PROMPT = """
Du bist ein wissenschaftlicher ESG-Auditor.
Bewerte die KANDIDATEN-ANTWORT ausschliesslich gegen die Atomic Facts.

FRAGE: {question}
ATOMIC FACTS (Goldstandard):
{facts_block}

KANDIDATEN-ANTWORT:
{generated}

Aufgabe:
1) Beurteile, wie viele Facts inhaltlich korrekt abgedeckt sind.
2) Vergib dann einen strengen Likert-Score:
0 = stark falsch/halluziniert
1 = viele wesentliche Facts fehlen oder falsch
2 = teilweise korrekt
3 = weitgehend korrekt, kleine Luecken
4 = deckungsgleich zu den Facts

{trap_instructions}
"""
BETWEEN = "\n---non_trap---\n"
_BLANK = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"


def compile_template(template: str, fields: dict[str, Column], default: str) -> Column:
    """The template as one expression; ``default`` takes its place if it has unknown, positional or formatted fields or stray braces."""
    try:
        parts = list(Formatter().parse(template))
        if any(name is not None and (name not in fields or spec or conversion) for _, name, spec, conversion in parts):
            raise ValueError("unknown field")
    except ValueError:
        if template == default:
            raise
        return compile_template(default, fields, default)
    out = [piece for text, name, _, _ in parts for piece in ([F.lit(text)] if text else []) + ([_text(fields[name])] if name is not None else [])]
    return F.concat(*out) if out else F.lit("")


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _strip(value: Column) -> Column:
    return F.btrim(_text(value), F.lit(_BLANK))


def load_templates(spark: SparkSession, paths: dict[str, str]) -> dict[str, str]:
    """Default templates, replaced by the files that exist and are not empty."""
    out = dict(DEFAULT_TEMPLATES)
    for method, path in paths.items():
        try:
            row = spark.read.text(path, wholetext=True).first() if path else None
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            row = None
        if row and row.value.strip():
            out[method] = row.value.strip()
    return out


def templates_hash(templates: dict[str, str]) -> str:
    return hashlib.sha256("\n".join(f"{k}\n{templates[k]}" for k in sorted(templates)).encode()).hexdigest()


def build_prompt(method: Column, question: Column, input_doc: Column | None = None, context: Column | None = None, answer_type: Column | None = None, max_words: Column | None = None, facts: Column | None = None, templates: dict[str, str] | None = None, max_context: int = 6000, max_chars: int = 14_000) -> Column:
    """The prompt of each task by its method's template, with rules by answer type, facts and word limit; context and prompt cut at their limits."""
    empty = F.lit("")
    doc, told, kind, words = (_text(c if c is not None else empty) for c in (input_doc, context, answer_type, max_words))
    section = F.when(doc != "", compile_template(INPUT_SECTION, {"input_doc_text": doc}, INPUT_SECTION)).otherwise("")
    fields = {"question": question, "input_section": section, "rag_context": F.left(told, F.lit(max_context))}
    out = compile_template(PLAIN, fields, PLAIN)
    for name, template in (templates or DEFAULT_TEMPLATES).items():
        out = F.when(method == name, compile_template(template, fields, PLAIN)).otherwise(out)
    kind, words = F.lower(_strip(kind)), _strip(words)
    binary = kind.rlike("wahr|falsch")
    rule = F.when(binary, ONLY_BINARY).when(kind.rlike("atomic|fakt"), ONLY_FACTS).when(kind.rlike("frei|free"), FREE_TEXT).otherwise("")
    listed = F.when(~binary & (F.size(facts) > 0), AS_FACTS).otherwise("") if facts is not None else empty
    limit = F.when(words == "", "").when(words.rlike(r"\A[0-9]+\z"), compile_template(MAX_WORDS, {"n": words}, MAX_WORDS)).otherwise(compile_template(MAX_RULE, {"n": words}, MAX_RULE))
    whole = F.concat(out, rule, listed, limit)
    return F.when(F.length(whole) > max_chars, F.concat(F.left(whole, F.lit(max_chars)), F.lit(CUT_NOTE))).otherwise(whole)


def trap_instructions(trap: Column, expected: Column) -> Column:
    """The instructions of a trap question with its expected behaviour; empty for others."""
    own = _strip(expected)
    block = F.when(own != "", compile_template(EXPECTED, {"expected": own}, EXPECTED)).otherwise(EXPECTED_DEFAULT)
    return F.when(trap, F.btrim(F.concat(F.lit(TRAP_INSTRUCTIONS), block), F.lit(_BLANK))).otherwise("")


def judge_prompt(question: Column, generated: Column, facts: Column, template: str | None = None, trap: Column | None = None, expected: Column | None = None) -> Column:
    """The judge's prompt by a template, or by the default one; instructions for traps are added where a prompt lacks them."""
    trap = F.coalesce(trap, F.lit(False)) if trap is not None else F.lit(False)
    expected = expected if expected is not None else F.lit("")
    told = trap_instructions(trap, expected)
    listed = F.when(F.size(facts) > 0, F.array_join(F.transform(facts, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(NO_FACTS)
    fields = {"question": question, "generated": generated, "facts_block": listed, "trap_instructions": told, "expected_trap_behavior": _strip(expected), "is_trap_question": trap.cast("int")}
    prompt = compile_template(template or JUDGE_PROMPT, fields, JUDGE_PROMPT)
    lacks = (told != "") & ~F.lower(prompt).contains("trap_pass")
    return F.when(lacks, F.concat(F.rtrim(prompt, F.lit(_BLANK)), F.lit("\n\n"), told)).otherwise(prompt)


def judge_prompt_hash(template: str | None = None) -> Column:
    """The hash of a template: of one plain and one trap prompt that it makes; the same expression in every row."""
    facts = F.array(F.lit("__FACT__"))
    plain = judge_prompt(F.lit("__QUESTION__"), F.lit("__ANSWER__"), facts, template)
    trap = judge_prompt(F.lit("__TRAP_QUESTION__"), F.lit("__TRAP_ANSWER__"), facts, template, F.lit(True), F.lit("__EXPECTED_TRAP_BEHAVIOR__"))
    return F.sha2(F.concat(plain, F.lit(BETWEEN), trap), 256)
