"""The run of an evaluation: answer pending tasks in batches, judge answers, analyse; with resume."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators import exports, stats, tasks
from ..sources import io, vector_index
from .prompting import build_prompt  # noqa: F401 - part of the run

RESULT = "model string, question_id string, method string, run_number int, prompt string, llm_answer string, input_tokens long, output_tokens long, duration_sec double, error string, ord long"


class ChatClient(Protocol):
    def __call__(self, model: str, prompt: str) -> tuple[str, int, int]:
        """Answer, input tokens, output tokens."""


def answer(pending: DataFrame, client: ChatClient, retries: int = 2, throttle: float = 0.0) -> DataFrame:
    """Calls the client once a task (model, question_id, method, run_number, prompt), with linear back-off between tries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                began, text, n_in, n_out, error = time.time(), "", 0, 0, ""
                for attempt in range(retries + 1):
                    try:
                        text, n_in, n_out = client(t.model, t.prompt)
                        error = ""
                        break
                    except Exception as e:  # noqa: BLE001 - recorded with the task
                        error = str(e) or type(e).__name__
                        time.sleep(throttle * (attempt + 1))
                out.append((t.model, t.question_id, t.method, t.run_number, t.prompt, text, n_in, n_out, time.time() - began, error, time.time_ns()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])

    return pending.select(*tasks.KEY, "prompt").mapInPandas(run, RESULT)


def run_benchmark(spark: SparkSession, planned: DataFrame, client: ChatClient, checkpoint: str, batch: int = 1000, max_failures: int | None = None) -> DataFrame:
    """Answers what the checkpoint lacks, one commit a batch, and returns the latest row of each planned task.

    The checkpoint is read and the plan made once; what is to do is written down by batch, and each batch reads its own part. Raises
    after a batch (which is kept) once more than ``max_failures`` tasks of this run have failed.
    """
    todo = tasks.pending(planned, io.read_jsonl(spark, checkpoint, RESULT)).select(*tasks.KEY, "prompt")
    n = -(-todo.count() // batch)
    if n:
        listed = vector_index.scratch(spark)
        todo.withColumn("batch", F.pmod(F.xxhash64(*tasks.KEY), F.lit(n)).cast("int")).repartition("batch").write.partitionBy("batch").parquet(listed)
        plan, failed = spark.read.parquet(listed), 0
        for i in range(n):
            seen = Observation()
            io.append_jsonl(answer(plan.where(F.col("batch") == i), client).observe(seen, F.count_if(F.col("error") != "").alias("failed")), checkpoint)
            failed += seen.get["failed"] or 0
            if max_failures is not None and failed > max_failures:
                raise RuntimeError(f"Stopped benchmark: {failed} tasks failed")
    return tasks.restricted(io.read_jsonl(spark, checkpoint, RESULT), planned)


def resume(run: Callable[[], DataFrame], attempts: int = 5) -> DataFrame:
    """Runs again after a stopped benchmark, up to ``attempts`` times."""
    for i in range(attempts):
        try:
            return run()
        except RuntimeError as e:
            if "Stopped benchmark" not in str(e) or i == attempts - 1:
                raise
    raise ValueError("attempts must be positive")


def analyse(evaluated: DataFrame, baseline: str = "Zero-Shot", time_cost_factor: float = 0.002) -> dict[str, DataFrame]:
    """The export tables of evaluated results."""
    prepared = stats.prepare(evaluated)
    per_task = stats.task_level(prepared)
    return {
        "stats": exports.stats_table(stats.stats_table(per_task, prepared, baseline, time_cost_factor)),
        "main_tests": exports.main_tests(stats.main_tests(per_task)),
        "trap_questions": exports.trap_summary(per_task),
        "overconfidence": exports.overconfidence(prepared),
        "robustness": exports.robustness(stats.robustness(prepared)),
    }
