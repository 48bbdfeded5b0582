"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines within ``max_edits`` edits are repeats. A line is cut into ``max_edits + 1`` segments; two lines
that are so close agree in at least one segment, at nearly the same place. The index holds the segments of
every different line by (line length, segment number, content); a line probes, for each length that can
match, the substrings of its own that can align with each segment (the multi-match-aware windows). Pairs
are verified by a banded bit-parallel edit distance.

For one edit, a segment that very many different lines share is not expanded into pairs: its lines go by
their one-character deletions instead (lines that agree after deleting the character at one place are one
substitution apart, a line that equals another's deletion is one insertion apart), which is exact and
linear. For more edits all its pairs are verified: exact too, but quadratic in the lines of the segment.

A line is a repeat if an earlier line (smaller document, then smaller line number) equals it or is within
``max_edits``; lines under ``min_chars`` are repeats only of equal lines, and blank lines never.

Defined results: null texts stay null and have no lines; documents are told apart by (key, text): of
equal rows the lines of all stay or go alike; null keys come before all others; lines of white space alone (a
carriage return, tabs) are blank; very long lines are compared whole; extra columns pass through,
save ``text``, which is replaced, and those named ``n_lines``, ``n_removed`` or ``n_near``, which are too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

MAX_EDITS = 1
MIN_CHARS = 24
#: Segments of more than this many (index lines x probing lines) are not expanded into pairs for one edit.
HOT_PAIRS = 2500
#: Up to this many places of lines (some 10 MB) are sent to all tasks.
BROADCAST_LINES = 200_000
#: Parts over which the places of one line are spread where repeats are not sent to all tasks.
SALT = 16
BLANKS = " \t\r\x0b\x0c"
_NULL = -(1 << 63)


def within_edits(a: Column, b: Column, t: int) -> Column:
    """Whether the edit distance of two strings is at most ``t`` (1 to 30).

    A band of 2t + 1 rows slides along the diagonal; its vertical steps up and down are bits of two integers, so a
    column costs a few integer operations (banded bit-parallel dynamic programming). The distance is followed
    down the band's lower edge until that meets the last row, then along the last row.
    """
    mask = (1 << (2 * t + 1)) - 1
    top = 1 << (2 * t)
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731 - evaluates x once
    bit = lambda x: F.lit(x).cast("long")
    inv = lambda x: x.bitwiseXOR(bit(mask))  # noqa: E731 - of values within the mask

    def run(s: Column) -> Column:
        m, n = F.size(s["a"]), F.size(s["b"])

        def column(acc: Column, j: Column) -> Column:
            char = F.get(s["b"], j - 1)
            same = bit(0)
            for k in range(2 * t + 1):  # row j - t + k, none above the first or below the last
                row = j - t + k
                same = same + F.when((row >= 1) & (F.get(s["a"], row - 1) == char), bit(1 << k)).otherwise(bit(0))

            def steps(x: Column) -> Column:
                carried = x["eq"].bitwiseAND(x["vp"]) + x["vp"]
                d = carried.bitwiseAND(bit(mask)).bitwiseXOR(x["vp"]).bitwiseOR(x["eq"]).bitwiseOR(x["vn"])
                return F.struct(d.alias("d"), x["vp"].alias("vp"), x["vn"].alias("vn"))

            def flat(x: Column) -> Column:
                hp = x["vn"].bitwiseOR(inv(x["d"].bitwiseOR(x["vp"])))
                return F.struct(hp.alias("hp"), x["d"].bitwiseAND(x["vp"]).alias("hn"), x["d"].alias("d"))

            def close(x: Column) -> Column:
                half = F.shiftright(x["d"], 1)
                edge = F.when(x["d"].bitwiseAND(bit(top)) == 0, 1).otherwise(0)
                at = F.pow(F.lit(2.0), (m - j + t).cast("double")).cast("long")  # the last row's bit
                last = F.when(x["hp"].bitwiseAND(at) != 0, 1).when(x["hn"].bitwiseAND(at) != 0, -1).otherwise(0)
                return F.struct(
                    x["hn"].bitwiseOR(inv(half.bitwiseOR(x["hp"]))).alias("vp"),
                    x["hp"].bitwiseAND(half).alias("vn"),
                    (acc["dist"] + F.when(j + t <= m, edge).otherwise(last)).cast("int").alias("dist"),
                )

            start = F.struct(same.alias("eq"), acc["vp"].alias("vp"), acc["vn"].alias("vn"))
            return let(let(let(start, steps), flat), close)

        begin = F.struct(bit(((1 << (t + 1)) - 1) << t).alias("vp"), bit(0).alias("vn"), F.least(m, F.lit(t)).cast("int").alias("dist"))
        total = F.aggregate(F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), begin, column, lambda acc: acc["dist"])
        return (F.abs(m - n) <= t) & (total <= t)

    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return let(F.struct(chars(a).alias("a"), chars(b).alias("b")), run)


def pieces_agree(a: Column, b: Column, size: Column, t: int) -> Column:
    """Whether all but ``t`` of 4 (t + 1) pieces of ``a`` stand in ``b`` at most ``t`` places away.

    An edit touches one piece at most, so no pair within ``t`` edits fails; most others do, before the edit distance is taken.
    """
    n = 4 * (t + 1)
    agree = F.lit(0)
    for i in range(n):
        start, end = F.floor(size * i / n).cast("int"), F.floor(size * (i + 1) / n).cast("int")
        piece = a.substr(start + 1, end - start)
        same = F.lit(False)
        for shift in sorted(range(-t, t + 1), key=abs):
            same = same | ((start + shift >= 0) & (b.substr(start + shift + 1, end - start) == piece))
        agree = agree + F.when(same, 1).otherwise(0)
    return agree >= n - t


def _segments(t: int, size: Column) -> list[tuple[Column, Column]]:
    """(0-based start, length) of the t + 1 segments of a line of ``size`` characters: even, the longer ones last."""
    n = t + 1
    short = F.floor(size / n).cast("int")
    longer = (size % n).cast("int")
    return [(short * i + F.greatest(F.lit(0), longer - (n - i)), short + F.when(F.lit(n - i) <= longer, 1).otherwise(0)) for i in range(n)]


def _keys(line: Column, size: Column, t: int) -> tuple[list[Column], list[Column]]:
    """The index keys and the further probe keys of a line; null where a segment does not fit."""

    def key(length: Column, i: int, start: Column, n: Column) -> Column:
        fits = (start >= 0) & (start + n <= size) & (n > 0)
        return F.when(fits, F.xxhash64(length, F.lit(i), line.substr(start + 1, n)))

    own = _segments(t, size)
    index = [key(size, i, start, n) for i, (start, n) in enumerate(own)]
    probes = []
    for less in range(t + 1):
        for i, (start, n) in enumerate(_segments(t, size - less)):
            # Edits before the segment: at most i, and after it at most t - i, if it is the first that agrees.
            for shift in range(-t, t + 1):
                if abs(shift) <= i and abs(shift - less) <= t - i and (less or shift):
                    probes.append(key(size - less, i, start + shift, n))
    return index, probes


def _place(doc: str = "doc", th: str = "th", no: str = "no") -> Column:
    """One number that orders lines by document, then text (30 bits of its hash), then line number."""
    whole = lambda x, digits: x.cast(f"decimal({digits},0)")
    row = whole(F.col(doc), 20) * whole(F.lit(1 << 30), 10) + whole(F.col(th).bitwiseAND(F.lit((1 << 30) - 1)), 10)
    return whole(row * whole(F.lit(1 << 31), 10) + whole(F.col(no), 10), 38)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)).alias("doc"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """The lines of documents that are not blank, and their sizes."""
    lines = rows.select("doc", "th", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    return lines.where(F.btrim("line", F.lit(BLANKS)) != "").withColumn("size", F.length("line"))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc, th, no, near): the places of the repeats; ``near`` tells those of an earlier line that differs."""
    t = max_edits
    rows = _rows(docs, key, text)
    lines = _lines(rows)
    hashes = [F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("h2")]
    index, probes = _keys(F.col("line"), F.col("size"), t)
    names = [f"i{k}" for k in range(len(index))], [f"p{k}" for k in range(len(probes))]
    long = F.col("size") >= min_chars
    keys = [F.when(long, c).alias(x) for x, c in zip([*names[0], *names[1]], [*index, *probes], strict=True)]
    # Different lines, each with its first place.
    made = lines.select(_place().alias("place"), *hashes, *keys)
    own = cut(made.groupBy("h", "h2").agg(F.min("place").alias("place"), F.count("*").alias("n"), *[F.max(x).alias(x) for x in [*names[0], *names[1]]]))

    def listed(columns: list[str], i: int) -> DataFrame:
        return own.select("h", F.explode(F.array_compact(F.array(*columns))).alias("key"), F.lit(i).alias("i"))

    keyed = listed(names[0], 1)
    if names[1]:
        keyed = keyed.unionByName(listed(names[1], 0))
    keyed = keyed.groupBy("key", "h").agg(F.max("i").alias("i"))
    full = keyed.groupBy("key").agg(F.sum("i").alias("ni"), F.count("*").alias("np")).where("ni > 0 and np > 1").withColumn("hot", F.col("ni") * F.col("np") > hot_pairs)
    active = cut(keyed.join(full, "key").select("key", "h", "i", "hot"))

    def pairs_of(some: DataFrame) -> DataFrame:
        found = some.where("i = 1").select("key", F.col("h").alias("a")).join(some.select("key", F.col("h").alias("b")), "key").where("a <> b")
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    hot = active.where("hot")
    pairs = cut(pairs_of(active if t > 1 else active.where("not hot")).distinct())

    # The texts of those lines alone.
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionByName(hot.select("h")).distinct()
    wanted = cut(wanted.join(own.select("h", "place"), "h").select("h", "place"))
    small = wanted.count() <= BROADCAST_LINES  # else both sides are shuffled
    texts = lines.where(long).withColumn("place", _place()).join(F.broadcast(wanted) if small else wanted, "place")
    texts = cut(texts.select("h", "place", "line", "size").dropDuplicates(["h"]))
    a = texts.select(F.col("h").alias("a"), F.col("line").alias("line_a"), F.col("size").alias("size_a"), F.col("place").alias("place_a"))
    b = texts.select(F.col("h").alias("b"), F.col("line").alias("line_b"), F.col("place").alias("place_b"))
    near = pairs.join(a, "a").join(b, "b").where(pieces_agree(F.col("line_a"), F.col("line_b"), F.col("size_a"), t) & within_edits(F.col("line_a"), F.col("line_b"), t))
    later = near.select(F.when(F.col("place_a") < F.col("place_b"), F.col("b")).otherwise(F.col("a")).alias("h"))
    if t == 1:
        crowd = texts.join(hot.select("h").distinct(), "h", "left_semi")
        without = lambda i: F.xxhash64(F.concat(F.col("line").substr(F.lit(1), i - 1), F.col("line").substr(i + 1, F.col("size"))))
        gone = crowd.select("h", "place", F.explode(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.struct(i.alias("at"), without(i).alias("d")))).alias("x"))
        gone = gone.select("h", "place", "x.*")
        # One substitution: equal after deleting the character at one place. The earliest is before all others.
        first = gone.groupBy("at", "d").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
        later = later.unionByName(gone.join(first, ["at", "d"]).where("place > first").select("h"))
        # One insertion: a line that equals the other's deletion.
        whole = crowd.select(F.xxhash64("line").alias("d"), F.col("h").alias("h2"), F.col("place").alias("place2"))
        insertion = gone.select("d", "h", "place").distinct().join(whole, "d")
        later = later.unionByName(insertion.select(F.when(F.col("place") < F.col("place2"), F.col("h2")).otherwise(F.col("h")).alias("h")))
    later = later.distinct().withColumn("near", F.lit(True))
    found = own.select("h", "h2", "place", "n").join(later, "h", "left").where("near or n > 1").select("h", "h2", F.col("place").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    found = cut(found)
    at = lines.select("doc", "th", "no", *hashes)
    if found.count() <= BROADCAST_LINES:
        at = at.join(F.broadcast(found), ["h", "h2"])
    else:  # the places of a common line are spread over tasks
        spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        at = at.withColumn("salt", F.pmod(F.xxhash64("doc", "th"), F.lit(SALT)).cast("int")).join(spread, ["h", "h2", "salt"])
    return at.where(F.col("near") | (_place() != F.col("first"))).select("doc", "th", "no", "near")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text`` without its repeated lines, and n_lines, n_removed, n_near (removed for an earlier line that differs)."""
    gone = repeated_lines(docs, key, text, max_edits, min_chars).distinct().groupBy("doc", "th").agg(F.collect_set("no").alias("__gone"), F.count_if("near").alias("__near"))
    gone = gone.withColumnsRenamed({"doc": "__doc", "th": "__th"})
    keep = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_near")]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep])
    out = rows.join(gone, (F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)) == F.col("__doc")) & (F.xxhash64(f"`{text}`") == F.col("__th")), "left")
    parts = F.split(F.col(f"`{text}`"), "\n", -1)
    kept = F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("__gone", i)), "\n"))
    cols = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in keep]
    n = F.coalesce(F.size(parts), F.lit(0))
    return out.select(*cols, F.when(F.col(f"`{text}`").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
