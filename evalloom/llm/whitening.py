"""Embedding whitening by hierarchical merging of singular value decompositions.

Each task decomposes its vectors, batch by batch, and keeps all singular values and right vectors, the number of rows,
their exact sums and with them the mean. Two such states merge by stacking their scaled vectors and one more row, the
scaled difference of the means, and decomposing that again: the result is the decomposition of all their rows, no dimension
lost. States of tasks merge in a tree, FAN at a time; the last state (dimensions squared, whatever the number of rows) gives the
principal components. Entries c count as floor(64 c) + 1000000, so sums are exact.

Odd rows: vectors that are null, or hold null or non-finite entries, or entries of 2^40 or more in size, take no part; nor do those
of another length than the most frequent one (ties: the shorter), as they have no covariance with the others. Repeated
rows count each; null keys stay. A component without variance has null as its whitened value and does not count for the
identity error. A deviation that no long holds is null. An empty table gives an empty one. All columns are kept, but for those named as added ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: States that merge in one group of the tree.
FAN = 16
_LARGEST = float(2**40)
_STATE = "part long, n long, sums array<decimal(38,0)>, scaled binary"


def _entries(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their entries as integers less SHIFT)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    c = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    fine = (np.abs(c) < _LARGEST).all(axis=1)  # null entries are NaN here
    return at[fine], np.floor(SCALE * c[fine]).astype(np.int64)


@dataclass
class State:
    """Rows that have been seen: their number, exact sums (less SHIFT each), and singular values times right vectors."""

    n: int
    sums: list[int]
    scaled: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> State:
        sums = x.sum(axis=0)
        base = np.rint(sums / len(x))
        near = x - base  # small numbers: nothing is lost to the size of the mean
        return cls(len(x), [int(s) for s in sums], _decomposed(near - near.sum(axis=0) / len(x)))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        # The difference of the means, from the exact sums.
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        row = np.sqrt(self.n / n * other.n) * gap
        return State(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], _decomposed(np.vstack([self.scaled, other.scaled, row])))


def _decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right vectors of ``rows``: at most a row a dimension, and the same covariance."""
    if len(rows) > 2 * rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def _packed(part: int, state: State) -> pa.RecordBatch:
    values = [pa.array([part], pa.int64()), pa.array([state.n], pa.int64()), pa.array([[Decimal(s) for s in state.sums]], pa.list_(pa.decimal128(38, 0))), pa.array([state.scaled.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(values, names=["part", "n", "sums", "scaled"])


def _unpacked(row: dict) -> State:
    sums = [int(s) for s in row["sums"]]
    return State(row["n"], sums, np.frombuffer(row["scaled"]).reshape(-1, len(sums)))


@dataclass
class Whitening:
    """Principal components of the fitted vectors: ``vectors`` a row each by falling variance; ``n`` rows with exact ``sums`` (less SHIFT each)."""

    n: int
    sums: list[int]
    variances: np.ndarray
    vectors: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> list[float | None]:
        total = float(self.variances.sum())
        return [float(v) / total if total else None for v in self.variances]

    def scale(self, components: int) -> np.ndarray:
        """Columns that whiten centred rows; NaN for components without variance."""
        v = self.variances[:components]
        real = v > self.variances[0] * 1e-24 if len(v) else v > 0
        return self.vectors[:components].T / np.sqrt(np.where(real, v, np.nan))


def length_of(vectors: DataFrame, vector: str = "embedding") -> int:
    """The most frequent length of vectors that can take part; 0 if there are none."""
    v = F.col(f"`{vector}`")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < _LARGEST))
    found = vectors.where(fine).groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), "length").first()  # a row a length
    return found.length if found else 0


def fit(vectors: DataFrame, vector: str = "embedding", fan: int = FAN) -> Whitening | None:
    """The whitening of all vectors that can take part; None if there are none."""
    dim = length_of(vectors, vector)
    if not dim:
        return None

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for rows in batches:
            _, x = _entries(rows.column(0), dim)
            if len(x):
                own = State.of(x)
                state = state.merged(own) if state else own
        if state:
            yield _packed(TaskContext.get().partitionId(), state)

    def merge(states: pa.Table) -> pa.Table:
        rows = sorted(states.to_pylist(), key=lambda r: r["part"])
        whole = _unpacked(rows[0])
        for r in rows[1:]:
            whole = whole.merged(_unpacked(r))
        return pa.Table.from_batches([_packed(rows[0]["part"] // fan, whole)])

    states = cut(vectors.select(F.col(f"`{vector}`")).mapInArrow(decompose, _STATE))
    parts = states.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        states = states.groupBy(F.floor(F.col("part") / fan)).applyInArrow(merge, _STATE)
        parts = -(-parts // fan)
    whole = _unpacked(states.first().asDict())  # one row of dimensions squared
    _, s, vt = np.linalg.svd(np.vstack([whole.scaled, np.zeros((max(0, dim - len(whole.scaled)), dim))]), full_matrices=False)
    return Whitening(whole.n, whole.sums, s * s / whole.n, vt)


def transform(vectors: DataFrame, model: Whitening | None, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Rows that take part, with ``deviation`` (the exact sum of (n x - S)^2) and ``whitened`` (a value a component)."""
    kept = vectors.select(*[F.col(f"`{c}`") for c in vectors.columns if c not in ("deviation", "whitened")])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", deviation long, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model is None:
            return
        scale, base = model.scale(components), np.array([s // model.n for s in model.sums], dtype=np.int64)
        rest = np.array([(s - int(b) * model.n) / model.n for s, b in zip(model.sums, base, strict=True)])
        for rows in batches:
            at, x = _entries(rows.column(rows.schema.get_field_index(vector)), model.dim)
            if not len(at):
                continue
            whitened = ((x - base).astype(np.float64) - rest) @ scale
            flat = pa.array(whitened.ravel(), mask=np.isnan(whitened.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * scale.shape[1], type=pa.int32()), flat)
            own = rows.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*own.columns, _deviations(x, base, model), lists], names=[*own.schema.names, "deviation", "whitened"])

    return kept.mapInArrow(run, kinds)


def _deviations(x: np.ndarray, base: np.ndarray, model: Whitening) -> pa.Array:
    most = float(np.abs(x - base).max() + 1) * model.n
    if most * most * model.dim < 2.0**62:
        rest = np.array([s - int(b) * model.n for s, b in zip(model.sums, base, strict=True)], dtype=np.int64)
        gap = (x - base) * model.n - rest
        return pa.array((gap * gap).sum(axis=1))
    exact = [sum((int(v) * model.n - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def identity_error(whitened: DataFrame, n: int, components: int, value: str = "whitened") -> DataFrame:
    """One row: the largest absolute entry of the values' covariance less the identity; components that are null do not count."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(components), np.zeros((components, components))
        for rows in batches:
            w = rows.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), components)
            sums += w.sum(axis=0)
            squares += w.T @ w
        i, j = np.triu_indices(components)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[i, np.arange(components)], pa.int32()), pa.array(np.r_[j, np.full(components, -1)], pa.int32()), pa.array(np.r_[squares[i, j], sums])], names=["i", "j", "v"])

    cells = whitened.select(value).mapInArrow(products, "i int, j int, v double").where(~F.isnan("v")).groupBy("i", "j").agg((F.sum("v") / n).alias("v"))
    # The rows are centred by the exact mean; what is left of their own mean is taken off as well.
    means = F.map_from_entries(F.collect_list(F.when(F.col("j") == -1, F.struct("i", "v"))))
    whole = cells.agg(means.alias("m"), F.collect_list(F.when(F.col("j") >= 0, F.struct("i", "j", "v"))).alias("cells"))  # components squared
    off = F.transform("cells", lambda c: F.abs(c["v"] - F.try_element_at("m", c["i"]) * F.try_element_at("m", c["j"]) - F.when(c["i"] == c["j"], 1.0).otherwise(0.0)))
    return whole.select(F.array_max(off).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of ``embeddings`` that takes part, a row a component, whitened by the components of them all."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    components = min(COMPONENTS, model.dim) if model else 0
    white = transform(vectors, model, components=components)
    error = identity_error(white, model.n if model else 1, components)
    share = F.array(*[F.lit(x).cast("double") for x in (model.explained if model else [])[:components]]).cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).crossJoin(F.broadcast(error))  # one row
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"), "identity_error")
