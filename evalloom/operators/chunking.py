"""Documents to chunks: fixed windows, or sections that begin at headings and are then cut into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_SIZE = 300


def _numbered(df: DataFrame) -> DataFrame:
    """(source, chunk_id, chunk) from (source, parts): a row is a file, and ids count from 1 in each."""
    # Outer: else a filter on the parts is inferred, pushed into the scan, and the files are cut there once more.
    out = df.select("source", F.posexplode_outer("parts").alias("no", "chunk")).where("no is not null")
    return out.select("source", F.format_string("%s::chunk_%04d", "source", F.col("no") + 1).alias("chunk_id"), "chunk")


def chunk_fixed(docs: DataFrame, size: int = 400, overlap: int = 70, clean: bool = True) -> DataFrame:
    """``docs`` has source and text; sizes under 300 count as 300."""
    size, overlap = max(MIN_SIZE, size), max(0, overlap)
    text = T.clean_lines(F.col("text")) if clean else F.col("text")
    return _numbered(docs.select("source", T.fixed_windows(text, size, overlap).alias("parts")))


def chunk_sections(docs: DataFrame, size: int = 400, overlap: int = 70) -> DataFrame:
    """The windows of each section of each file; all in one row, without a shuffle."""
    size, overlap = max(MIN_SIZE, size), max(0, overlap)
    cleaned = docs.select("source", T.sections(T.clean_lines(F.col("text"))).alias("sections"))
    return _numbered(cleaned.select("source", F.flatten(F.transform("sections", lambda x: T.fixed_windows(x, size, overlap))).alias("parts")))
