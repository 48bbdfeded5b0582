"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table has ``functions`` random projections floor((a.x + b) / width). A query visits its own bucket and
perturbed ones (a function's value moved by one or two), in the order of the estimated chance of success:
the least sum of squared distances to the bucket borders first. The candidates of all tables are merged
and reranked by their exact measure, the inner product of the original vectors in double precision.

Largest inner product is made a distance by one more component sqrt(M^2 - |x|^2), with M the largest norm
(0 for a query), so that lengths may differ.

Buckets are dealt in blocks of at most ``block`` vectors; a query is sent to every block of a bucket it
visits, so a bucket that holds a third of all vectors is no hot task.

Defined results: vectors that are null, empty, zero, of another length than the most frequent one, or that
hold null or non-finite components take no part; rows that repeat a vec_id with its vector count once;
null vec_ids take no part; ties go to the smaller vec_id; fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

K = 20
TABLES, FUNCTIONS, WIDTH = 2, 3, 1.2
#: Buckets that a query visits in each table, its own included.
PROBES = 40
#: A function's value is moved by at most this much.
REACH = 2
BLOCK = 4096


class Hashing:
    """The random projections of all tables, from a seed."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((tables, functions, dim))
        self.b = rng.uniform(0, width, (tables, functions))
        self.width = width

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, functions): projections in units of the width."""
        return (np.einsum("nd,tfd->ntf", x, self.a) + self.b) / self.width


def bucket_keys(cells: np.ndarray) -> np.ndarray:
    """64-bit keys of cells, their last axis the functions."""
    key = np.full(cells.shape[:-1], 0x9E3779B97F4A7C15, dtype=np.uint64)
    for f in range(cells.shape[-1]):
        key = (key ^ (cells[..., f].astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def probe_cells(values: np.ndarray, probes: int, reach: int) -> np.ndarray:
    """Cells that each row visits (rows, probes, functions), nearest first: own cell, then perturbed ones."""
    n, f = values.shape
    own = np.floor(values)
    inside = values - own
    moves = np.arange(-reach, reach + 1)
    # Squared distance from the point to the cell moved by delta, by function.
    gap = np.where(moves > 0, moves - inside[..., None], np.where(moves < 0, inside[..., None] - moves - 1, 0.0)) ** 2
    grids = np.meshgrid(*[np.arange(len(moves))] * f, indexing="ij")
    combos = np.stack([g.ravel() for g in grids], axis=1)
    score = np.zeros((n, len(combos)))
    for i in range(f):
        score += gap[:, i, combos[:, i]]
    best = np.argsort(score, axis=1, kind="stable")[:, : min(probes, len(combos))]
    return own[:, None, :] + moves[combos[best]]


def usable(vectors: DataFrame, key: str, vector: str, length: int | None = None) -> DataFrame:
    """(id, x): finite, non-zero vectors of the given length, else of the most frequent one."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("x")).where(fine)
    if length is None:
        size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = size.n if size else 0
    return rows.where(F.size("x") == length)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, probes: int = PROBES, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each row of ``queries``.

    ``width`` is in units of the largest norm.
    """
    base = usable(vectors, key, vector)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    found = base.agg(F.max(norm).alias("m"), F.max(F.size("x")).alias("dim")).first()
    most, dim = found.m or 1.0, found.dim or 1
    asked = usable(queries, key, vector, dim)  # of the length of the base: others have no neighbours in it
    kind = base.schema["x"].dataType.simpleString()

    def matrix(col: pd.Series) -> np.ndarray:
        return np.array(list(col), dtype=np.float64).reshape(len(col), -1)

    def index(batches):
        h = Hashing(dim + 1, tables, functions, width)
        for pdf in batches:
            if not len(pdf):
                continue
            x = matrix(pdf["x"]) / most
            cells = np.floor(h.values(np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))])))
            for t in range(tables):
                yield pd.DataFrame({"bucket": bucket_keys(cells[:, t]) ^ t, "id": pdf["id"], "x": pdf["x"]})

    def probe(batches):
        h = Hashing(dim + 1, tables, functions, width)
        for pdf in batches:
            for part in range(0, len(pdf), 500):
                own = pdf.iloc[part : part + 500]
                x = matrix(own["x"]) / most
                values = h.values(np.hstack([x, np.zeros((len(x), 1))]))
                for t in range(tables):
                    keys = bucket_keys(probe_cells(values[:, t], probes, reach)) ^ t
                    at = np.repeat(np.arange(len(own)), keys.shape[1])
                    yield pd.DataFrame({"bucket": keys.ravel(), "id": own["id"].to_numpy()[at], "x": own["x"].to_numpy()[at]})

    schema = f"bucket long, id long, x {kind}"
    indexed, visits = base.mapInPandas(index, schema), asked.mapInPandas(probe, schema)
    # How many blocks a bucket has, of vectors and of visits; visits to empty buckets end here.
    blocks = indexed.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("nv")).join(visits.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("nq")), "bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = visits.join(blocks, "bucket").select("bucket", own("nq").alias("bq"), each("nv").alias("bv"), "id", "x")
    right = indexed.join(blocks, "bucket").select("bucket", each("nq").alias("bq"), own("nv").alias("bv"), "id", "x")

    def rank(key, asked: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(near):
            near = near.sort_values("id", kind="stable")
            ids, x = near["id"].to_numpy(), matrix(near["x"])
            for part in range(0, len(asked), 256):
                some = asked.iloc[part : part + 256]
                q = matrix(some["x"])
                rough = q @ x.T
                for i, query in enumerate(some["id"]):
                    r = rough[i]
                    r[ids == query] = -np.inf
                    least = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
                    at = np.flatnonzero((r >= least - 1e-9 * (1.0 + abs(least))) & (r > -np.inf)) if least > -np.inf else np.flatnonzero(r > -np.inf)
                    score = (x[at] * q[i]).sum(axis=1)  # in one order of summation: equal vectors get equal scores
                    best = at[np.argsort(-score, kind="stable")][:k]
                    if len(best):
                        out.append((query, hash(key) & 31, [{"away": -float(v), "id": int(d)} for v, d in zip(np.sort(-score)[:k] * -1.0, ids[best], strict=True)]))
        return pd.DataFrame(out, columns=["query_id", "salt", "near"])

    lists = left.groupBy("bucket", "bq", "bv").cogroup(right.groupBy("bucket", "bq", "bv")).applyInPandas(rank, "query_id long, salt int, near array<struct<away:double,id:long>>")
    merge = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")
    merged = lists.groupBy("query_id", "salt").agg(merge).groupBy("query_id").agg(merge)
    out = merged.select("query_id", F.posexplode("near").alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (-F.col("n.away")).alias("score"))


def op7_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where("vec_id % 20 = 0"))
