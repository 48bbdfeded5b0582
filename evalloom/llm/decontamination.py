"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words (A-Z lower-cased). Of every ``w`` consecutive k-gram hashes of a text the smallest is
kept (the rightmost of equal ones), so that any two texts that share ``w + k - 1`` words share a
fingerprint. Training and test fingerprints are joined; each hit is extended to the windows of the
test item around it, which are compared word by word.

A window is ``span`` consecutive item words, or a whole item of fewer. ``w + k - 1`` is the shortest
window that the benchmark has, so every occurrence of every window is found.

Defined results: null or empty texts have no words, no hits and the hash of the empty list; an empty
benchmark gives no hits; items without words are ignored; equal items all count; repeated documents
give repeated rows; input columns other than the key and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPAN = 13
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmark windows up to this number are broadcast (some 20 MB); more are joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: Low bits of a packed hash that hold its position.
_MASK = (1 << 28) - 1


def words(text: Column) -> Column:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)


def _span_seq(last: Column) -> Column:
    """1..last, or nothing."""
    return F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def winnow(df: DataFrame, k: int, w: int, words_col: str = "words") -> DataFrame:
    """Adds ``hashes`` (of all k-grams) and ``picked`` (0-based positions of the fingerprints)."""
    gram = lambda i: F.xxhash64(F.slice(words_col, i, k))
    df = df.withColumn("hashes", F.transform(_span_seq(F.size(words_col) - (k - 1)), gram))
    packed = F.transform("hashes", lambda x, i: x.bitwiseAND(F.lit(~_MASK)).bitwiseOR((F.lit(_MASK) - i).cast("long")))
    df = df.withColumn("packed", packed)
    least = F.transform(_span_seq(F.size("packed") - (w - 1)), lambda i: F.array_min(F.slice("packed", i, w)))
    return df.withColumn("picked", F.transform(F.array_distinct(least), lambda x: (F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("int"))).drop("packed")


def contaminated_spans(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per document row: key, ``th`` (hash of its text), ``n_words``, ``spans`` (struct of start and length) and ``items`` (ids as text)."""
    bench = items.select(F.col(item_key).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    bench = bench.withColumn("len", F.least(F.lit(span), F.size("words")))
    lengths = [x.len for x in bench.select("len").distinct().collect()]  # at most ``span`` numbers
    t = min(lengths, default=span)
    k = (t + 1) // 2
    w = t - k + 1
    windows = bench.select("item", "len", F.explode_outer(F.transform(_span_seq(F.size("words") - F.col("len") + 1), lambda i: F.concat_ws(" ", F.slice("words", i, F.col("len"))))).alias("window"))
    windows = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
    prints = winnow(bench, k, w).select(F.explode_outer(F.transform("picked", lambda p: F.get("hashes", p))).alias("print")).distinct().withColumn("hit", F.lit(True))
    n_windows = bench.agg(F.sum(F.size("words"))).first()[0] or 0
    small = F.broadcast if n_windows <= BROADCAST_WINDOWS else (lambda df: df)

    d = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(text).alias("th"), words(F.col(f"`{text}`")).alias("words"))
    d = winnow(d, k, w)
    # Position -1 stands for the document itself, so that one pass gives both its size and its hits.
    d = d.select("key", "th", "words", "hashes", F.explode_outer(F.concat(F.array(F.lit(-1)), "picked")).alias("pos"))
    # The print itself joins. A document's own row (position -1) needs no partner: it gets a key of its own, as rows of one key, or of null, would meet in one task.
    lone = F.monotonically_increasing_id()
    d = d.select("key", "th", "words", "pos", F.when(F.col("pos") >= 0, F.get("hashes", F.col("pos"))).otherwise(F.xxhash64("th", lone)).alias("print"))
    d = d.join(small(prints), "print", "left").where("hit or pos < 0")
    n = F.size("words")

    def around(size: int) -> Column:
        """The windows of ``size`` words that hold the k-gram at ``pos``."""
        first = F.greatest(F.lit(0), F.col("pos") + (k - size))
        return F.transform(_span_seq(F.least(F.col("pos"), n - F.lit(size)) - first + 1), lambda i: F.struct((first + i - 1).alias("start"), F.lit(size).alias("len")))

    starts = [around(x) for x in sorted(lengths)]
    none = F.array(F.struct(F.lit(-1).alias("start"), F.lit(0).alias("len")))
    d = d.withColumn("at", F.when(F.col("pos") < 0, none).otherwise(F.concat(*starts)) if starts else none)
    d = d.select("key", "th", F.when(F.col("pos") < 0, n).alias("n_words"), "words", F.explode_outer("at").alias("at"))
    d = d.select("key", "th", "n_words", "at", F.when(F.col("at.len") > 0, F.concat_ws(" ", F.slice("words", F.col("at.start") + 1, F.col("at.len")))).otherwise(F.concat(F.lit(" "), lone.cast("string"))).alias("window"))
    d = d.join(small(windows), "window", "left").where("items is not null or at.len = 0")  # no window begins with a blank
    hit = F.col("at.len") > 0
    out = d.groupBy("key", "th").agg(
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
        F.collect_set(F.when(hit, F.col("at"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set(F.col("items")))).alias("items"),
    )
    return out.select(F.col("key").alias(key), "th", "n_words", "spans", "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_spans(docs, items, key, item_key, text, span)
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    found = found.select(key, F.col("n_words").cast("long").alias("n_words"), F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), "th")
    return found.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    bad = report(docs, items, key, text=text).where("contaminated").select(F.col(key).alias("__key"), F.col("th").alias("__th")).distinct()
    return docs.join(bad, F.col(f"`{key}`").eqNullSafe(F.col("__key")) & (F.xxhash64(text) == F.col("__th")), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS n, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, lens WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN win ON win.n = dw.n AND array_to_string(list_slice(w, i, i + dw.n - 1), ' ') = win.s),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
