"""Exact substring dedup of word sequences with difference-cover anchors.

``D = {0, 1, 3, 9}`` is a perfect difference cover modulo 13: for any two positions i and j some shift
below 13 puts both at cover positions. Only the 8-word windows at cover positions are hashed as anchors:
two equal runs of 20 words, at any alignment, share an anchor that starts within their first 13 words.

1. Documents are dealt into batches; a batch sends each of its distinct anchors once.
2. Anchors that occur in two places come back to their batches. A 20-word window without such an anchor
   in it is unique.
3. The other windows are extended to all 20 words: a batch sends each distinct window (96-bit hash) once,
   with the first doc_id that holds it. Windows whose first place is elsewhere come back.
4. Each batch marks the words that a repeated window covers.

A batch sends a hash once however often it occurs, so no hash, passage or document is hot.

Defined results: null and empty texts have no words and remove none; texts of fewer than 20 words are
never touched; rows with the same doc_id are ordered by batch and hash, of equal rows one stays; null ids
come before all others; extra columns are not read.
"""

from __future__ import annotations

import re
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

SPAN = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = SPAN - PERIOD + 1
#: Rows of a batch, on average: some 1 to 2 MB of text.
BATCH_ROWS = 400
_WORD = re.compile(WORD)
_M1, _M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Stands for a null id in the order of ids.
_NULL = -(1 << 63)


class _Batch:
    """The words of a batch's documents in one array, in order of (doc_id, text), and rolling hashes over it."""

    def __init__(self, pdf: pd.DataFrame):
        self.rows = pdf.sort_values(["doc_id", "row"], kind="stable", ignore_index=True)
        self.words = [_WORD.findall(t) if t else [] for t in self.rows["text"]]
        ids = dict.fromkeys(w for own in self.words for w in own)
        ids = dict(zip(ids, range(len(ids)), strict=True))
        at = np.fromiter((ids[w] for own in self.words for w in own), dtype=np.int64, count=sum(map(len, self.words)))
        self.n = np.fromiter(map(len, self.words), dtype=np.int64, count=len(self.words))
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.doc = np.repeat(np.arange(len(self.words)), self.n)
        self.pos = np.arange(len(at)) - self.start[self.doc]
        encoded = [w.encode("utf-8", "surrogatepass") for w in ids]
        self.codes = [np.array([xxhash.xxh3_64_intdigest(w, seed) for w in encoded], dtype=np.uint64)[at] if len(at) else np.zeros(0, dtype=np.uint64) for seed in (1, 2)]

    def hashes(self, size: int, which: int) -> np.ndarray:
        """Hash of the ``size`` words from each position; meaningless where they cross a document's end."""
        base = _M1 if which == 0 else _M2
        n = len(self.doc)
        out = np.zeros(max(0, n - size + 1), dtype=np.uint64)
        code = self.codes[which]
        for j in range(size):  # Horner
            out = out * np.uint64(base) + code[j : j + len(out)]
        out ^= out >> np.uint64(32)
        out *= np.uint64(_M2)
        return out ^ (out >> np.uint64(29))

    def starts(self, size: int) -> np.ndarray:
        """Positions from which ``size`` words fit in the document."""
        return np.flatnonzero(self.pos + size <= self.n[self.doc]) if len(self.doc) else np.zeros(0, dtype=np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.starts(ANCHOR)
        at = at[np.isin(self.pos[at] % PERIOD, COVER)]
        return at, self.hashes(ANCHOR, 0)[at]

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of the 20-word windows that hold an anchor which occurs in two places."""
        at, h = self.anchors()
        hit = at[np.isin(h, repeated)]
        mark = np.zeros(len(self.doc) + 1, dtype=np.int64)  # window s holds anchors that start in s..s+12
        lo = np.maximum(hit - (PERIOD - 1), self.start[self.doc[hit]])
        np.add.at(mark, lo, 1)
        np.add.at(mark, hit + 1, -1)
        near = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        return near[self.pos[near] + SPAN <= self.n[self.doc[near]]]


def _batches(docs: DataFrame, key: str, text: str, batch_rows: int) -> DataFrame:
    n = max(1, -(-docs.count() // batch_rows))
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)).alias("doc_id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    return rows.withColumn("batch", F.pmod("row", F.lit(n)).cast("int"))


def _send_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
    b = _Batch(pdf)
    h, n = np.unique(b.anchors()[1], return_counts=True)
    batch = np.full(len(h), pdf["batch"].iloc[0], dtype=np.int32)
    return pd.DataFrame({"batch": np.where(n > 1, -1 - batch, batch), "h": h.view(np.int64)})  # below 0: twice in the batch


def _windows(b: _Batch, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64 and 32 bits of the windows' hashes, and the order by hash, then place."""
    h, c = b.hashes(SPAN, 0)[at].view(np.int64), b.hashes(SPAN, 1)[at].astype(np.uint32).view(np.int32)
    return h, c, np.lexsort((at, c, h))


def _send_windows(pdf: pd.DataFrame, repeated: pd.DataFrame) -> pd.DataFrame:
    if not len(pdf) or not len(repeated):
        return pd.DataFrame({"batch": [], "h": [], "c": [], "doc_id": []})
    b = _Batch(pdf)
    at = b.candidates(repeated["h"].to_numpy().view(np.uint64))
    h, c, order = _windows(b, at)
    # Positions are in order of (doc_id, row, start): the first of equal hashes is the batch's first place.
    first = np.ones(len(order), dtype=bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])
    i = order[first]
    return pd.DataFrame({"batch": np.full(len(i), pdf["batch"].iloc[0], dtype=np.int32), "h": h[i], "c": c[i], "doc_id": b.rows["doc_id"].to_numpy()[b.doc[at[i]]]})


def _remove(pdf: pd.DataFrame, later: pd.DataFrame) -> pd.DataFrame:
    cols = ["doc_id", "n_words", "n_removed", "kept"]
    if not len(pdf):
        return pd.DataFrame({c: [] for c in cols})
    b = _Batch(pdf)
    at = b.starts(SPAN)
    h, c, order = _windows(b, at)
    again = np.zeros(len(at), dtype=bool)  # not the batch's first of its kind
    again[order[1:]] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
    if len(later):
        again |= np.isin(h, later["h"].to_numpy())  # 64 bits tell the windows of one batch apart
    mark = np.zeros(len(b.doc) + 1, dtype=np.int64)
    np.add.at(mark, at[again], 1)
    np.add.at(mark, at[again] + SPAN, -1)
    keep = np.cumsum(mark)[:-1] == 0
    out = []
    for d, words in enumerate(b.words):
        own = keep[b.start[d] : b.start[d + 1]]
        n = int(own.sum())
        out.append((b.rows["doc_id"].iat[d], len(words), len(words) - n, " ".join(words) if n == len(words) else " ".join(w for w, k in zip(words, own, strict=True) if k)))
    return pd.DataFrame(out, columns=cols)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed and ``kept`` (the words that stay, joined by one space)."""
    rows = _batches(docs, key, text, batch_rows)
    anchors = rows.groupBy("batch").applyInPandas(_send_anchors, "batch int, h long")
    w = Window.partitionBy("h")
    repeated = anchors.withColumn("n", F.count("batch").over(w)).where("n > 1 or batch < 0").select(F.greatest("batch", -1 - F.col("batch")).alias("batch"), "h")
    windows = rows.groupBy("batch").cogroup(repeated.groupBy("batch")).applyInPandas(_send_windows, "batch int, h long, c int, doc_id long")
    w = Window.partitionBy("h", "c").orderBy("doc_id", "batch")
    later = windows.withColumn("r", F.row_number().over(w)).where("r > 1").select("batch", "h")
    out = rows.groupBy("batch").cogroup(later.groupBy("batch")).applyInPandas(_remove, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NULL, F.col("doc_id")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
