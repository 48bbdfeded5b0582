"""Language identification by word-first backoff.

Known words score by their per-language log frequency; an unseen word falls back to its character
n-grams, longest first, shorter ones where the longer is unseen too.

Training uses at most ``max_rows`` different labelled rows a language (those with the smallest hashes of key and text), whole texts; predictions cover every row and its whole text and use nothing but the text.

Defined results: null text, or text without any letter, gives ``und`` with score 0; text with letters
but no trained language at all gives ``und`` with score 0; ties go to the smaller language name; repeated
rows give repeated results; very long texts are read whole; other columns pass through, save ``lang_pred`` and ``score``, which are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, table

#: Bound of the training sample: labelled rows a language.
MAX_ROWS = 500
#: Bound of the languages that are told apart.
MAX_LANGUAGES = 1000
#: Bound of the model: words, and n-grams of each length, a language.
MAX_TERMS = 20_000
ORDERS = (4, 3, 2, 1)
_WORDS = re.compile(r"[^\W\d_]+")
#: Of a language that has not seen a term that another has.
UNSEEN = 0.5


def letters(text: str) -> list[str]:
    """Runs of letters: superscripts, fractions and numerals are none, though ``\\w`` takes them."""
    out = []
    for w in _WORDS.findall(text):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, kind, term, n): kind 0 for words, else the n-gram length; summed over a task's rows."""
    total: dict[tuple[str, int], Counter] = defaultdict(Counter)

    def flush():
        rows = [(k[0], k[1], t, n) for k, c in total.items() for t, n in c.items()]
        total.clear()
        return pd.DataFrame(rows, columns=["lang", "kind", "term", "n"])

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            words = Counter(letters(text.lower()))
            total[lang, 0].update(words)
            for w, n in words.items():
                padded = f" {w} "
                for k in ORDERS:
                    c = total[lang, k]
                    for i in range(len(padded) - k + 1):
                        c[padded[i : i + k]] += n
        if sum(map(len, total.values())) > 500_000:
            yield flush()
    yield flush()


def _gram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit keys of all n-grams of a code point array."""
    return _gram_keys_at(codes, np.arange(max(0, len(codes) - n + 1)), n)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


class Model:
    """Per-language log frequencies of words and n-grams; ``predict`` scores a list of texts."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, _ in totals})
        at = {x: i for i, x in enumerate(self.langs)}
        counts: dict[tuple[int, str], list[float]] = {}
        for lang, kind, term, n in rows:
            counts.setdefault((kind, term), [0.0] * len(self.langs))[at[lang]] = n
        self.words: dict[str, int] = {}
        logs = []
        grams: dict[int, list[tuple[int, list[float]]]] = {k: [] for k in ORDERS}
        for (kind, term), c in sorted(counts.items()):
            x = [math.log((n + UNSEEN) / (totals.get((lang, kind), 0) + UNSEEN)) for n, lang in zip(c, self.langs, strict=True)]
            mean = sum(x) / len(x)
            x = [v - mean for v in x]
            if kind:
                grams[kind].append((int(_gram_keys(_codes(term), kind)[0]), x))
            else:
                self.words[term] = len(logs)
                logs.append(x)
        self.logs = np.array(logs, dtype=np.float64).reshape(len(logs), len(self.langs))
        self.grams = {}
        for k, found in grams.items():
            found.sort(key=lambda x: x[0])
            self.grams[k] = np.array([x[0] for x in found], dtype=np.uint64), np.array([x[1] for x in found], dtype=np.float64).reshape(len(found), len(self.langs))

    def backoff(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of unseen words: mean log frequencies over their positions, and whether any n-gram was seen."""
        codes = _codes(" " + " ".join(words) + " ")
        space = codes == 32
        word = np.cumsum(space) - 1  # the space before a word is the word's
        ends = np.flatnonzero(space)
        after = ends[np.minimum(word + 1, len(ends) - 1)]  # the space that ends the word
        sums, hits = np.zeros((len(words) + 1, len(self.langs))), np.zeros(len(words) + 1)
        open_at = np.arange(len(codes))
        for n in ORDERS:
            keys, logs = self.grams[n]
            if not len(keys):
                continue
            i = open_at[open_at + n - 1 <= after[open_at]]
            got = _gram_keys_at(codes, i, n)
            k = np.minimum(np.searchsorted(keys, got), len(keys) - 1)
            ok = keys[k] == got
            for c in range(len(self.langs)):
                sums[:, c] += np.bincount(word[i[ok]], logs[k[ok], c], len(words) + 1)
            hits += np.bincount(word[i[ok]], minlength=len(words) + 1)
            left = np.ones(len(codes), dtype=bool)
            left[i[ok]] = False
            open_at = open_at[left[open_at]]
        return (sums / np.maximum(hits, 1)[:, None])[:-1], hits[:-1] > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        tokens = [x.lower().split() if x else [] for x in texts]
        ids = dict.fromkeys(t for own in tokens for t in own)
        ids = dict(zip(ids, range(len(ids)), strict=True))
        at = np.fromiter((ids[t] for own in tokens for t in own), dtype=np.int64, count=sum(map(len, tokens)))
        # A token's words: most have one. Words are scored once each, tokens sum their words.
        words: dict[str, int] = {}
        owner, word = [], []
        for i, t in enumerate(ids):
            for w in (t,) if t.isalpha() else letters(t):
                owner.append(i)
                word.append(words.setdefault(w, len(words)))
        known = np.fromiter((self.words.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        logs, seen = np.zeros((len(words), len(self.langs))), known >= 0
        logs[seen] = self.logs[known[seen]]
        unseen, names = np.flatnonzero(~seen), list(words)
        for part in range(0, len(unseen), 20_000):
            i = unseen[part : part + 20_000]
            logs[i], seen[i] = self.backoff([names[j] for j in i])
        owner, word = np.array(owner, dtype=np.int64), np.array(word, dtype=np.int64)
        # By token: its words, those with evidence, and the sums by language.
        table = np.stack([np.bincount(owner, v, len(ids)) for v in (np.ones(len(word)), seen[word], *(logs[word, c] for c in range(len(self.langs))))], axis=1)
        out: tuple[list[str], list[float]] = ([], [])
        start = 0
        for own in tokens:
            total = table[at[start : start + len(own)]].sum(axis=0)
            start += len(own)
            sums, n = total[2:], total[1]
            if not total[0]:
                lang, score = "und", 0.0
            elif not n:
                lang, score = self.langs[0], 1.0 / len(self.langs)
            else:
                best = int(np.argmax(sums))
                # Words of a text are no independent witnesses: at most 20 of them.
                lang, score = self.langs[best], float(1.0 / np.exp(np.maximum(-700.0, (sums - sums[best]) * min(1.0, 20.0 / n))).sum())
            out[0].append(lang)
            out[1].append(score)
        return out


def _gram_keys_at(codes: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-grams that start at ``i``."""
    keys = np.full(len(i), n, dtype=np.uint64)
    for j in range(n):
        keys = (keys ^ codes[i + j]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def train(labelled: DataFrame, key: str = "doc_id", max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """Fit on (key, text, lang); null texts and languages are left out."""
    # The key may be shared by many rows, or null: the text counts for the hash as well.
    rows = labelled.select(F.col(key).alias("key"), "text", "lang").where("text is not null and lang is not null").select("text", "lang", F.xxhash64("key", "text").alias("h"))
    sizes = {x.lang: x.n for x in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()}  # a row a language
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return Model([], {})
    # Of the different rows of a language, those below the share that holds about four times max_rows, then the smallest of them exactly.
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, 4.0 * max_rows / max(1, n)))])
    w = Window.partitionBy("lang").orderBy("h", "text")
    near = rows.where(F.pmod("h", F.lit(1 << 31)) / float(1 << 31) < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    sample = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= max_rows)
    sample = sample.repartition(16, "h")
    counts = sample.select("lang", "text").mapInPandas(_term_counts, "lang string, kind int, term string, n long").groupBy("lang", "kind", "term").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "term")
    total = Window.partitionBy("lang", "kind")
    out = counts.withColumn("total", F.sum("n").over(total)).withColumn("r", F.row_number().over(top)).where(F.col("r") <= max_terms).select("lang", "kind", "term", "n", "total").collect()
    return Model([(x.lang, x.kind, x.term, x.n) for x in out], {(x.lang, x.kind): x.total for x in out})


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            parts = [own.predict(list(texts[i : i + 500])) for i in range(0, len(texts), 500)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": [x for p in parts for x in p[1]]})

    keep = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "__told")]
    return docs.select(*[F.col(f"`{c}`") for c in keep], tell(F.col("text")).alias("__told")).select(*[F.col(f"`{c}`") for c in keep], "__told.lang_pred", "__told.score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = (crc_mod("doc_id", 4) == 2).alias("held_out")
    model = train(docs.where(crc_mod("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text", held), model).select("doc_id", "held_out", "lang_pred", "score")
