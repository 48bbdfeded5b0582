"""Sources and sinks: JSON, JSON lines, CSV, Parquet and workbook tables, text folders, documents, run artifacts."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import office

#: Fixed value: the fingerprint of a corpus that is not there.
NO_CORPUS = "missing-rag-kb-dir"
START, END = "=== DOKUMENT START: {} ===", "=== DOKUMENT ENDE ==="


def _missing(error: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(error) or "does not exist" in str(error)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON value a file: an object is a row, a list its rows."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a missing path gives no rows; blank, broken and non-object lines are skipped."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if not _missing(error):
            raise
        return spark.createDataFrame([], schema)
    row = F.from_json(F.trim("value"), schema)
    whole = F.get_json_object(F.trim("value"), "$")
    return lines.where(F.trim("value").startswith("{") & whole.isNotNull()).select(row.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One indented JSON list in one file, for reports: the rows of a report are few, and go through the driver."""
    from .vector_index import _Folder

    folder, name = path.rsplit("/", 1)
    rows = [json.loads(r.row) for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("row")).collect()]
    _Folder(df.sparkSession, folder).swap(name, json.dumps(rows, indent=2, ensure_ascii=False))


def append_jsonl(df: DataFrame, path: str) -> None:
    """One commit a batch."""
    df.write.mode("append").json(path)


def read_table(spark: SparkSession, path: str, required: tuple[str, ...] = (), sheets: tuple[str, ...] = ()) -> DataFrame:
    """A workbook (the first of ``sheets`` that it has, else its first sheet), CSV with a header, or Parquet; raises if a required column is missing."""
    if path.lower().endswith(".xls"):
        raise ValueError("old binary workbooks have no reader here: save as .xlsx")
    if path.lower().endswith(".xlsx"):
        return office.read_workbook(spark, path, sheets, required)
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    lost = [c for c in required if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    return df


def write_csv(df: DataFrame, path: str, lists: str = "|") -> None:
    """One CSV file with a header; arrays are joined by ``lists``."""
    flat = df.select(*[F.array_join(c, lists).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def text_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(source, text): a row a file."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source"), F.col("value").alias("text"))


def _plain(content: bytes) -> str:
    return content.decode("utf-8", "replace")


#: Readers by extension; others can be registered.
READERS: dict[str, Callable[[bytes], str]] = {"txt": _plain, "md": _plain, "xlsx": office.workbook_text, "docx": office.document_text, "pptx": office.slides_text}


def read_documents(files: DataFrame, readers: dict[str, Callable[[bytes], str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(source, text, status, and ``keep``) of files (path, content): read by extension and put between document markers.

    ``status`` is ok, empty, unsupported or error; text is null unless ok, so errors never enter a corpus.
    """
    own = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                reader = own.get(name.rsplit(".", 1)[-1].lower())
                if reader is None:
                    out.append((name, None, "unsupported"))
                    continue
                try:
                    text = reader(bytes(content))
                except Exception:  # noqa: BLE001 - the status tells
                    out.append((name, None, "error"))
                    continue
                out.append((name, f"{START.format(name)}\n{text}\n{END}", "ok") if text.strip() else (name, None, "empty"))
            yield pd.DataFrame(out, columns=["source", "text", "status"]).assign(**{c: pdf[c].to_numpy() for c in keep})

    kinds = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*dict.fromkeys(("path", "content", *keep))).mapInPandas(run, "source string, text string, status string" + kinds)


def changed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, modificationTime) that have no output (path, modificationTime) or a newer time than it."""
    d = done.select("path", F.col("modificationTime").alias("__done"))
    return files.join(d, "path", "left").where("__done is null or modificationTime > __done").drop("__done")


#: Counters of a preprocessing run.
COUNTERS = ("processed", "skipped", "empty", "errors")


def preprocess(spark: SparkSession, source: str, out: str, readers: dict[str, Callable[[bytes], str]] | None = None, force: bool = False) -> dict[str, int]:
    """Read the files of a folder that are new or newer than what was read of them into the corpus under ``out``; returns COUNTERS.

    A corpus is a Parquet folder of (source, text, status, modified); ``corpus`` shows the last reading of each file. Files of
    other formats, and those that are up to date, are skipped. The counts are taken during the one write.
    """
    own = READERS | (readers or {})
    listed = spark.read.format("binaryFile").load(source).select("path", "modificationTime")
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = listed.where(kind.isin(*own))
    try:
        done = spark.read.parquet(out).groupBy("path").agg(F.max("modified").alias("modificationTime"))
        todo = known if force else changed(known, done)
    except AnalysisException as error:
        if not _missing(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        todo = known
    paths = [r.path for r in todo.select("path").collect()]  # names, as the listing of the folder that the driver holds
    total = listed.count()
    if not paths:
        return dict.fromkeys(COUNTERS, 0) | {"skipped": total}
    files = spark.read.format("binaryFile").load([p.replace("%", "%25") if p.startswith("file:") and "%" in p else p for p in paths])
    read = read_documents(files, own, keep=("path", "modificationTime")).withColumnRenamed("modificationTime", "modified")
    seen = Observation("preprocess")
    told = {"processed": "ok", "empty": "empty", "errors": "error"}
    read.observe(seen, *[F.count_if(F.col("status") == v).alias(k) for k, v in told.items()]).write.mode("append").parquet(out)
    return {**seen.get, "skipped": total - len(paths)}


def corpus(spark: SparkSession, out: str) -> DataFrame:
    """(source, text): the last reading of each file that could be read."""
    w = Window.partitionBy("path").orderBy(F.desc("modified"))
    return spark.read.parquet(out).withColumn("r", F.row_number().over(w)).where("r = 1 and status = 'ok'").select("source", "text")


def fingerprint(files: DataFrame, with_times: bool = False) -> DataFrame:
    """One row: a hash over the sorted (name, size, sha256) of files (path, content, length[, modificationTime]); ``NO_CORPUS`` without files.

    The entries of a corpus are short; a folder of files is one list on one task.
    """
    name = F.element_at(F.split("path", "/"), -1)
    entry = F.struct(name.alias("name"), F.col("length").alias("size"), *([F.unix_micros("modificationTime").alias("mtime")] if with_times else []), F.sha2("content", 256).alias("sha256"))
    listed = F.sha2(F.to_json(F.array_sort(F.collect_list(entry))), 256)
    return files.agg(F.when(F.count("*") == 0, NO_CORPUS).otherwise(listed).alias("fingerprint"))


def needs_rebuild(enabled: bool, manifest: dict | None, found: str, settings: dict) -> str:
    """disabled, up_to_date, or rebuilt with its reason."""
    if not enabled:
        return "disabled"
    if manifest is None:
        return "rebuilt:missing_manifest"
    if manifest.get("fingerprint") != found:
        return "rebuilt:corpus"
    return "up_to_date" if manifest.get("settings") == settings else "rebuilt:settings"


def questions(rows: DataFrame) -> DataFrame:
    """Questions with trimmed fields, ids from their place where missing, facts from a list, a text or fact columns; extraction questions go."""
    from ..functions import scoring as S

    def col(name: str):
        return F.trim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name in rows.columns else F.lit("")

    fact_cols = sorted(c for c in rows.columns if c.startswith("atomic_fact_"))
    listed = F.lit(None).cast("array<string>")
    if "atomic_facts" in rows.columns:
        listed = F.col("atomic_facts") if dict(rows.dtypes)["atomic_facts"].startswith("array") else S.atomic_facts(F.col("atomic_facts"))
    named = F.filter(F.array(*[col(c) for c in fact_cols]), lambda x: x != "") if fact_cols else F.array().cast("array<string>")
    facts = F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, listed).otherwise(named)
    place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1  # a catalogue is small
    out = rows.select(F.when(col("id") == "", place.cast("string")).otherwise(col("id")).alias("id"), *[col(c).alias(c) for c in ["question", "category", "task_type_raw", "reference_answer", "answer_type", "expected_trap_behavior", "max_words", "relevant_docs", "difficulty"]], facts.alias("atomic_facts"))
    return out.where(~F.lower(F.concat_ws(" ", "answer_type", "category")).rlike("extraktion|extraction"))


def validate_questions(rows: DataFrame, limit: int = 20) -> None:
    """Raises with the first ``limit`` rows that lack an id or a question."""
    lost = [c for c in ("id", "question") if c not in rows.columns]
    if lost:
        raise ValueError(f"missing columns: {lost}")
    bad = rows.where("trim(coalesce(cast(id as string), '')) = '' or trim(coalesce(question, '')) = ''").limit(limit).collect()
    if bad:
        raise ValueError("; ".join(f"row {r.asDict()}: id or question is missing" for r in bad))
