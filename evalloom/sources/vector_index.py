"""A stored vector index: vectors in files by cell, replaced whole, opened with pruning; its manifest and the rebuild decision.

Layout under a folder: ``CURRENT`` names the version in use; a version holds ``vectors`` (Parquet by cell), ``centroids`` and
``manifest``. A new version is written beside the old one, and ``CURRENT`` is swapped by a rename once it is complete: a failed
write leaves the index as it was.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vectors as V

#: Bound of the sample that centroids are fitted on: vectors a cell.
SAMPLE = 256
#: Cells, at most: centroids are sent to all tasks.
MAX_CELLS = 4096
#: Vectors of one cell that meet queries in one task.
BLOCK = 50_000


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one of the cluster (``spark.checkpoint.dir``); a local one only in local mode without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evalloom-")
    return f"{base.rstrip('/')}/index-{uuid.uuid4().hex}"


class _Folder:
    """Small files of an index, wherever Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """The file is the old or the new one at any time, up to the rename of the file system."""
        new = self.at(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        kinds[0] = options.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf())
        context.rename(new, self.at(name), kinds)

    def versions(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at("")) if s.isDirectory() and s.getPath().getName().startswith("v-")]

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _fit(vectors: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample: the vectors with the smallest hashes of their ids, SAMPLE a cell."""
    own = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = own.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(SAMPLE * cells).collect()
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(len(r.embedding), []).append(r.embedding)
    if not by_length:
        return np.zeros((1, 1))
    x = np.array(max(by_length.values(), key=len), dtype=np.float64)
    centres = x[:: max(1, len(x) // cells)][:cells].copy()
    for _ in range(rounds):
        own_cell = _cells(x, centres, 1)[:, 0]
        for c in np.unique(own_cell):
            centres[c] = x[own_cell == c].mean(axis=0)
    return centres


def _cells(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """The nearest cells of each row, nearest first."""
    d = (centres * centres).sum(axis=1)[None, :] - 2.0 * (x @ centres.T)
    return np.argsort(d, axis=1, kind="stable")[:, :probes]


def write_index(vectors: DataFrame, path: str, cells: int = 64, settings: dict | None = None, fingerprint: str | None = None) -> str:
    """Replace the index under ``path`` by one of (vec_id, embedding); returns its version. All rows are indexed: null vectors, and those of
    another length than the centroids, lie in cell -1."""
    if not 1 <= cells <= MAX_CELLS:
        raise ValueError(f"cells must be between 1 and {MAX_CELLS}")
    spark = vectors.sparkSession
    own = vectors.select("vec_id", "embedding")
    centres = _fit(own, cells)

    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.full(len(batch), -1)
            fits = np.flatnonzero([v is not None and len(v) == centres.shape[1] for v in batch])
            if len(fits):
                out[fits] = _cells(np.array([batch.iloc[i] for i in fits], dtype=np.float64), centres, 1)[:, 0]
            yield pd.Series(out)

    folder = _Folder(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    try:
        cell = F.pandas_udf(assign, "int")
        placed = own.withColumn("cell", cell("embedding"))
        placed.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).write.partitionBy("cell").parquet(f"{path}/{version}/vectors")
        stored = spark.read.parquet(f"{path}/{version}/vectors")
        sizes = {int(r.cell): r["count"] for r in stored.groupBy("cell").count().collect()}  # a row a cell
        manifest = {"sizes": sizes, "centroids": centres.tolist(), "settings": settings or {}, "fingerprint": fingerprint, "updated_utc": datetime.now(timezone.utc).isoformat()}
        folder.swap(f"{version}/manifest", json.dumps(manifest))
    except BaseException:
        folder.drop(version)
        raise
    folder.swap("CURRENT", version)
    for old in folder.versions():
        if old != version:
            folder.drop(old)
    return version


@dataclass
class VectorIndex:
    """An opened index."""

    vectors: DataFrame
    centroids: np.ndarray
    sizes: dict[int, int]
    manifest: dict

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, vec_id, dist): the k nearest in the ``probes`` cells nearest to each query (query_id, query); all cells, hence exact, without
        ``probes``. Only the cells that some query visits are read; a large cell meets queries in blocks."""
        spark, centres = self.vectors.sparkSession, self.centroids
        most = len(centres) if probes is None else min(probes, len(centres))

        def visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                out = [[-1]] * len(batch)  # queries of another length meet the vectors that have no cell
                fits = [i for i, v in enumerate(batch) if v is not None and len(v) == centres.shape[1]]
                if fits:
                    for i, cells in zip(fits, _cells(np.array([batch.iloc[i] for i in fits], dtype=np.float64), centres, most), strict=True):
                        out[i] = cells.tolist()
                yield pd.Series(out)

        cells = F.pandas_udf(visit, "array<int>")
        asked = queries.where(F.col("query").isNotNull()).select("query_id", "query", F.explode(cells("query")).alias("cell"))
        parts = spark.createDataFrame([(c, -(-n // BLOCK)) for c, n in self.sizes.items()] or [(-1, 1)], "cell int, parts int")  # a row a cell
        visits = asked.join(F.broadcast(parts), "cell").select("query_id", "query", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        own = self.vectors.where(F.col("embedding").isNotNull()).join(F.broadcast(parts), "cell")
        if most < len(centres):
            own = own.join(F.broadcast(asked.select("cell").distinct()), "cell", "left_semi")  # at most MAX_CELLS rows; prunes folders
        own = own.select("vec_id", "embedding", "cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"))
        return V.nearest(visits, own, ["cell", "part"], k)


def open_index(spark: SparkSession, path: str) -> VectorIndex | None:
    """The version in use; None where there is none."""
    folder = _Folder(spark, path)
    version = folder.read("CURRENT")
    if version is None:
        return None
    manifest = json.loads(folder.read(f"{version}/manifest"))
    vectors = spark.read.parquet(f"{path}/{version}/vectors")
    return VectorIndex(vectors, np.array(manifest["centroids"]), {int(c): n for c, n in manifest["sizes"].items()}, manifest)


def ensure_index(spark: SparkSession, path: str, fingerprint: str, settings: dict, build: Callable[[], DataFrame], enabled: bool = True, cells: int = 64) -> tuple[bool, str]:
    """Rebuild when there is no index, or the corpus or the settings have changed: (rebuilt, why)."""
    if not enabled:
        return False, "auto_reindex_disabled"
    try:
        found = open_index(spark, path)
    except Exception:  # noqa: BLE001 - an index that cannot be read is built anew
        found = None
    if found and found.manifest.get("fingerprint") == fingerprint and found.manifest.get("settings") == settings:
        return False, "up_to_date"
    write_index(build(), path, cells, settings, fingerprint)
    return True, "rebuilt"
