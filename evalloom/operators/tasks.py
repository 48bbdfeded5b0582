"""Planning, resuming and pricing of evaluation tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import judging
from .stats import no_nan

KEY = ["model", "question_id", "method", "run_number"]


def plan(questions: DataFrame, models: DataFrame, methods: DataFrame, runs: int) -> DataFrame:
    """Every question for each model, method and run; models and methods are a few rows."""
    return questions.crossJoin(F.broadcast(models)).crossJoin(F.broadcast(methods)).withColumn("run_number", F.explode(F.sequence(F.lit(1), F.lit(runs))))


def latest(checkpoint: DataFrame, order: str = "ord") -> DataFrame:
    """One row a task: the last success, else the last failure."""
    ok = F.trim(F.coalesce("error", F.lit(""))) == ""
    w = Window.partitionBy(*KEY).orderBy(ok.cast("int").desc(), F.desc(order))
    return checkpoint.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def pending(planned: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Planned tasks without a success."""
    done = latest(checkpoint).where("trim(coalesce(error, '')) = ''")
    return planned.join(done.select(*KEY), KEY, "left_anti")


def restricted(checkpoint: DataFrame, planned: DataFrame) -> DataFrame:
    return latest(checkpoint).join(planned.select(*KEY), KEY, "left_semi")


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Unknown prices count as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return zero(tokens_in) * zero(price_in) + zero(tokens_out) * zero(price_out)


def aliases(model: Column) -> Column:
    """The id, without its suffix after a colon, and without its provider as well."""
    full = F.lower(F.trim(model))
    base = F.split_part(full, F.lit(":"), F.lit(1))
    return F.array(full, base, F.regexp_replace(base, "^[^/]*/", ""))


def resolve_prices(models: DataFrame, fetched: DataFrame, default: DataFrame) -> DataFrame:
    """(model, input, output, matched) by the first alias that a fetched, then a default price has; else 0.

    Prices have (ord, id, input, output); of prices that share an alias the first counts.
    """

    def table(prices: DataFrame, base: int) -> DataFrame:
        named = prices.select("ord", "input", "output", F.posexplode(aliases(F.col("id"))).alias("form", "alias"))
        w = Window.partitionBy("alias").orderBy("ord", "form")
        return named.withColumn("r", F.row_number().over(w)).where("r = 1").select("alias", "input", "output", F.lit(base).alias("base"))

    prices = table(fetched, 0).unionByName(table(default, 3))
    asked = models.select("model", F.posexplode(aliases(F.col("model"))).alias("form", "alias"))
    w = Window.partitionBy("model").orderBy("choice")
    found = asked.join(prices, "alias").withColumn("choice", F.col("base") + F.col("form")).withColumn("r", F.row_number().over(w)).where("r = 1")
    matched = F.lit("missing")
    for i, name in enumerate(["fetched", "fetched_base", "fetched_providerless", "default", "default_base", "default_providerless"]):
        matched = F.when(F.col("choice") == i, name).otherwise(matched)
    out = models.select("model").distinct().join(found.select("model", "input", "output", "choice"), "model", "left")
    return out.select("model", F.coalesce("input", F.lit(0.0)).alias("input"), F.coalesce("output", F.lit(0.0)).alias("output"), matched.alias("matched"))


def failure_streaks(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``streak``: failures in a row up to each task, 0 at a success."""
    w = Window.partitionBy(*by).orderBy(order)
    marked = rows.withColumn("__ok", (F.trim(F.coalesce("error", F.lit(""))) == "").cast("int")).withColumn("__island", F.sum("__ok").over(w))
    w = Window.partitionBy(*by, "__island").orderBy(order)
    return marked.withColumn("streak", F.sum(1 - F.col("__ok")).over(w).cast("long")).drop("__ok", "__island")


def reusable(cache: DataFrame, judge_model: str, prompt_version: str, prompt_hash: str | Column, reason: str = "Judge_Begruendung", score: str = "score") -> DataFrame:
    """Cached judgements that may be used again: a score, no issue in the reason, the same judge, version and prompt.

    A cache without a judge or version column is not held against it; one without the prompt's hash has nothing to use.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = no_nan(cache).where(F.col(score).isNotNull())
    if reason in cache.columns:
        out = out.where(~judging.has_issue(F.col(reason)))
    for column, wanted in (("judge_model", judge_model), ("judge_prompt_version", prompt_version)):
        if column in cache.columns:
            out = out.where(text(column) == F.lit(str(wanted).strip()))
    wanted = F.lit(prompt_hash) if isinstance(prompt_hash, str) else prompt_hash
    return out.where(text("judge_prompt_hash") == F.trim(wanted)) if "judge_prompt_hash" in cache.columns else out.limit(0)


def cached(rows: DataFrame, cache: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """Adds ``hit``: whether the cache holds the key with equal text in all of ``same`` and a score; ``reusable`` narrows the cache first."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    same = [c for c in same if c in cache.columns]
    usable = cache.where("score is not null").select(*[text(c).alias(f"__{c}") for c in key + same]).distinct()
    on = [text(c) == F.col(f"__{c}") for c in key + same]
    out = rows.join(usable, on, "left")
    return out.withColumn("hit", F.col(f"__{key[0]}").isNotNull()).drop(*[f"__{c}" for c in key + same])


def upsert(base: DataFrame, patch: DataFrame, key: list[str], ids: set[str] | None = None, id_column: str = "ID") -> DataFrame:
    """Rows of ``base``, those with a patch replaced whole; with ``ids`` only rows of these ids. Keys are compared as trimmed text.

    Of patches that share a key any one counts; columns that the patch lacks become null in the rows it replaces.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cols = [c for c in base.columns if c not in key]
    own = patch if ids is None else patch.where(text(id_column).isin(sorted(ids)))
    value = lambda c: (F.col(c) if c in patch.columns else F.lit(None)).cast(base.schema[c].dataType)
    renamed = own.groupBy(*[text(c).alias(f"__k_{c}") for c in key]).agg(F.first(F.struct(F.lit(True).alias("hit"), *[value(c).alias(c) for c in cols])).alias("__p"))
    out = base.join(renamed, [text(c) == F.col(f"__k_{c}") for c in key], "left")
    hit = F.col("__p.hit").isNotNull() if ids is None else F.col("__p.hit").isNotNull() & text(id_column).isin(sorted(ids))
    return out.select(*key, *[F.when(hit, F.col(f"__p.`{c}`")).otherwise(F.col(c)).alias(c) for c in cols])


def missing_ids(ids: set[str], patch: DataFrame, id_column: str = "ID") -> list[str]:
    """Asked ids that the patch lacks: numbers by value, then the others by name."""
    asked = patch.sparkSession.createDataFrame([(i,) for i in sorted(ids)], "id string")
    lost = asked.join(patch.select(F.trim(F.col(id_column).cast("string")).alias("id")).distinct(), "id", "left_anti")
    return [r.id for r in lost.orderBy(F.col("id").try_cast("long").isNull(), F.col("id").try_cast("long"), "id").collect()]  # at most the asked ids


# Names of raw result columns in the evaluated schema.
COMPATIBLE = {
    "run_number": "Run_ID",
    "model": "Model",
    "method": "Method",
    "question_id": "ID",
    "question": "Frage",
    "answer_type": "Antworttyp",
    "expected_trap_behavior": "Expected_Trap_Behavior",
    "llm_answer": "KI_Antwort",
    "reference_answer": "Referenzantwort",
    "atomic_facts": "Atomic_Facts",
    "document_name": "Dokument_Name",
    "input_tokens": "Input_Tokens",
    "cost_usd": "Cost_USD",
    "duration_sec": "Dauer_sek",
}


def compatible(raw: DataFrame) -> DataFrame:
    """Raw results under the names of the evaluated schema; other columns stay."""
    return raw.withColumnsRenamed(COMPATIBLE)
