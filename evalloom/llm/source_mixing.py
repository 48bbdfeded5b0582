"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating; they share all words, but none gets
more than ``max_repeat`` times its own, the excess being reshared by weight until none is above.

Schedule: slot i of the mix falls on the golden-ratio point frac((i + 1) * phi), which the cumulative
targets map to a source; the slots of a source are ranked. The words of a source, its documents shuffled
by hash, form a ring that is cut into blocks of equal size; slot r of the source takes block r of the ring,
so the ring is read again after its end. The last slot ends where the target is met. A source that the
schedule gives fewer slots than its target needs gets the missing ones after it, so each meets its target.

Ranks and word offsets are prefix sums in two levels (within a chunk, and over chunks), so no source is
sorted in one task.

Defined results: null texts have size 0; documents of size 0 and sources without words take 0; repeated
rows are documents of their own, each with its share; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
#: Slots a source, on average: their number sets how near the schedule comes to the targets.
SLOTS = 4096
#: Rows of a chunk, on average.
CHUNK_ROWS = 4096
PHI = 0.6180339887498949


def n_words(text: Column) -> Column:
    """The number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> dict[str | None, float]:
    """Words to take of each source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    left = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out = float(sum(sizes.values())), {}
    while left:
        share = total / sum(left.values())
        full = [s for s, w in left.items() if share * w >= max_repeat * sizes[s]]
        if not full:
            return out | {s: share * w for s, w in left.items()}
        for s in full:
            out[s] = float(max_repeat * sizes[s])
            total -= out[s]
            del left[s]
    return out


def _chunked_offsets(df: DataFrame, group: str, chunk: str, order: list, value: str, out: str) -> DataFrame:
    """Adds ``out``: the exclusive prefix sum of ``value`` within ``group`` in the order of (chunk, *order)."""
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("__sum"))
    w = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, chunk, F.coalesce(F.sum("__sum").over(w), F.lit(0)).alias("__before"))
    w = Window.partitionBy(group, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("__in", F.coalesce(F.sum(value).over(w), F.lit(0))).join(sums, [group, chunk]).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, slots: int = SLOTS) -> DataFrame:
    """Per row: key, size, source_size, target (its source's), taken, and first_slot (where the mix takes it first; null if never)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"), n_words(F.col(f"`{text}`")).alias("size"))
    rows = cut(rows)  # ids, sources and sizes: the texts are read once
    # One row a source comes to the driver.
    found = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {x.source: x["size"] for x in found}
    aim = targets(sizes, weights, max_repeat)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    total = sum(sizes.values())
    dim = spark.createDataFrame([(i, s, sizes[s], aim[s], round(aim[s])) for i, s in enumerate(names)], "sid int, source string, source_size long, target double, quota long")
    rows = rows.join(F.broadcast(dim.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    n_chunks = max(1, sum(x.n for x in found) // CHUNK_ROWS)
    h = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":mix")))
    full = rows.where("size > 0").withColumn("h", h).withColumn("chunk", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * n_chunks / (1 << 32)))
    full = _chunked_offsets(full, "sid", "chunk", ["h", "id", "size"], "size", "start")

    block = max(1, total // (slots * max(1, len(names))))
    # Cumulative targets.
    cum, x = [], 0.0
    for s in names:
        x += aim[s]
        cum.append(x)
    share = [c / x for c in cum] if x else []
    n_slots = -(-total // block)

    point = F.expr(f"({PHI}D * (id + 1)) - floor({PHI}D * (id + 1))")
    find = F.udf(lambda p: min(bisect_left(share, p), len(share) - 1), T.IntegerType()) if len(share) > 2000 else None
    pick = F.coalesce(*[F.when(F.col("point") < b, F.lit(i)) for i, b in enumerate(share[:-1])], F.lit(max(0, len(names) - 1))) if find is None else find("point")
    plan = spark.range(n_slots if share else 0).withColumn("point", point).withColumn("sid", pick).withColumn("chunk", F.floor(F.col("id") / (1 << 16))).withColumn("one", F.lit(1))
    plan = _chunked_offsets(plan, "sid", "chunk", ["id"], "one", "rank").select("sid", F.col("rank").cast("long").alias("slot"), F.col("id").alias("turn"))
    # The schedule gives a source about its share of slots, a small one perhaps none: the slots up to its quota that it lacks follow by rank.
    due = dim.where("quota > 0").select("sid", F.ceil(F.col("quota") / block).cast("long").alias("due"))
    plan = plan.join(F.broadcast(due), "sid").where("slot < due").select("sid", "slot", "turn")
    given = plan.groupBy("sid").agg(F.count("*").alias("given"))  # ranks run from 0 without gaps
    lacking = due.join(F.broadcast(given), "sid", "left").withColumn("given", F.coalesce("given", F.lit(0))).where("given < due")
    plan = plan.unionByName(lacking.select("sid", F.explode(F.sequence(F.col("given"), F.col("due") - 1)).alias("slot")).withColumn("turn", F.lit(n_slots) + F.col("slot")))

    # A document's places on the ring, once for each round that the target reaches, and the slots that they meet.
    rounds = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("long")))
    at = full.where("quota > 0").select("id", "sid", "size", "source_size", "target", "quota", "start", rounds.alias("round"))
    at = at.withColumn("lo", F.col("round") * F.col("source_size") + F.col("start")).withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("quota"))).where("lo < hi")
    at = at.withColumn("slot", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    at = at.join(plan, ["sid", "slot"]).withColumn("part", F.least("hi", (F.col("slot") + 1) * block) - F.greatest("lo", F.col("slot") * block))
    cols = ["id", "sid", "start", "size", "source_size", "target"]
    none = full.select(*cols, F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("turn"))
    taken = at.select(*cols, "part", "turn").unionByName(none).groupBy(*cols).agg(F.sum("part").alias("taken"), F.min("turn").alias("first_slot"))
    empty = rows.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    return taken.select("id", "size", "source_size", "target", "taken", "first_slot").unionByName(empty).withColumnRenamed("id", key)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
