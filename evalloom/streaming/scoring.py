"""Scores judged rows as they arrive and keeps one row a task over all batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from ..functions import scoring as S
from ..operators import tasks
from ..sources.vector_index import _Folder

#: Parts of a table of tasks: a batch writes anew those that its tasks fall into.
BUCKETS = 64


def scored(rows: DataFrame, raw: str = "judge_text") -> DataFrame:
    """Works on batch and streaming frames alike."""
    score, coverage = S.judge_score(F.col(raw))
    return rows.withColumns({"score": score, "coverage": coverage, **{n: S.claim_count(F.col(raw), n) for n in ("supported", "contradicted", "not_in_scope")}})


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _newest(stored: DataFrame, before: int | None = None) -> DataFrame:
    """Rows of the newest version of each part, of those before ``before``."""
    known = stored if before is None else stored.where(F.col("version") < before)
    last = known.groupBy("bucket").agg(F.max("version").alias("version"))  # a row a part
    return known.join(F.broadcast(last), ["bucket", "version"])


def upsert_stream(rows: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keeps the table of tasks under ``path``: of each task the last success, else the last failure (by ``ord``), over all batches.

    The table is cut into parts by a hash of the task. A batch joins its rows with the newest version of the parts that they fall into, and
    writes these parts under its own number; older versions go once that is done. A batch that is played again reads only versions
    before its own and writes the same, so a restart from the checkpoint changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = scored(batch).withColumn("bucket", F.pmod(F.xxhash64(*tasks.KEY), F.lit(buckets)).cast("int"))
        stored = _stored(spark, path)
        whole = new
        if stored is not None:
            old = _newest(stored, number)
            whole = new.unionByName(old.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi").select(*new.columns))  # at most ``buckets`` rows
        kept = tasks.latest(whole).withColumn("version", F.lit(number).cast("long"))
        kept.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        folder = _Folder(spark, path)
        found = spark.read.parquet(path).select("bucket", "version").distinct().collect()  # a row a part and version
        newest: dict[int, int] = {}
        for r in found:
            newest[r.bucket] = max(newest.get(r.bucket, -1), r.version)
        # The version before the newest stays: the batch may be played again.
        for r in found:
            if r.version < newest[r.bucket] and any(r.version < o.version < newest[r.bucket] for o in found if o.bucket == r.bucket):
                folder.drop(f"bucket={r.bucket}/version={r.version}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table of tasks: one row a task."""
    return _newest(spark.read.parquet(path)).drop("bucket", "version")
