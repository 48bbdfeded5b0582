"""Near-duplicate documents by BagMinHash.

A document is the bag of its runs of five words (a document of fewer words is one run). Every element
carries Poisson processes over its discretised weight axis: one for each of the ranges [0,1), [1,2),
[2,4), [4,8) ..., with as many points a unit of time as the range is long. A point has a time, a place on
the weight axis and one of ``m`` slots; it counts for a bag if its place is below the element's weight.
The least time of each slot is the signature: two bags agree in a slot with the probability of their
weighted Jaccard similarity. Processes run in step and end once they are later than the bag's largest slot.

Signatures are cut into bands; documents that agree in a band are candidates, and candidate pairs are
verified on the exact bags. First all members of a bucket are compared with its first one, then with the
first one outside the classes of those before. What is then still in different classes of a bucket is
compared in full, whatever the bucket's size: its members are dealt into blocks, every pair of blocks is one task's
work and gives one edge for each two classes that it joins, so that pairs of texts never become rows.
Classes are the connected components of verified pairs.

Defined results: null and empty texts have no runs and are classes of their own; documents of equal words
are one node however many there are; class_id is the smallest doc_id of the class (null ids last); repeated
rows give repeated results; very long texts are compared whole; extra columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .wordhash import WordHashes, mix

RUN = 5
THRESHOLD = 0.8
SLOTS = 128
#: 25 bands of 5 slots: a pair of similarity 0.8 meets in some band with probability 0.99995.
BANDS, ROWS = 25, 5
#: First members that a bucket is compared with, one after another, before the rest is compared across classes.
ROUNDS = 3
#: Texts of a block of a bucket, and pairs of a hub that one task reads together with the hub's text.
BLOCK = 400
#: Pairs of equal elements that are held at once while blocks are compared.
HELD = 4_000_000
_NULL = (1 << 63) - 1
_CHUNK = 1000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def bag(texts: list[str | None], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray, WordHashes]:
    """(text, element, weight) of every distinct run, in order of text and element."""
    words = WordHashes(texts)
    doc, h = words.runs(run)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), dtype=bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], h[at], np.diff(np.append(at, len(h))), words


def bagminhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = SLOTS) -> np.ndarray:
    """Signatures (n x m) of weighted sets; infinite for empty ones."""
    sig = np.full(n * m, np.inf)
    # One process for each range of the weight axis that begins below the weight.
    ranges = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    i = np.repeat(np.arange(len(doc)), ranges)
    k = np.arange(len(i)) - np.repeat(np.cumsum(ranges) - ranges, ranges)
    low = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    length = np.where(k == 0, 1, low)
    low, length, limit, doc = low.astype(np.uint64), length.astype(np.uint64), weight[i].astype(np.uint64), doc[i]
    state = mix(element[i] + k.astype(np.uint64) * _STEP)
    time = np.zeros(len(i))
    rate = length.astype(np.float64)
    while len(state):
        state = state + _STEP
        z = mix(state)
        time = time - np.log(((mix(z + _STEP) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / rate
        hit = low + ((z >> np.uint64(16)) & (length - np.uint64(1))) < limit
        np.minimum.at(sig, doc[hit] * m + (z[hit] % np.uint64(m)).astype(np.int64), time[hit])
        most = sig.reshape(n, m).max(axis=1)
        on = time < most[doc]
        state, time, rate, low, length, limit, doc = (x[on] for x in (state, time, rate, low, length, limit, doc))
    return sig.reshape(n, m)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in range(0, len(pdf), _CHUNK):
            own = pdf.iloc[part : part + _CHUNK]
            doc, element, weight, words = bag(list(own["text"]))
            sig = bagminhash(doc, element, weight, len(own)).view(np.uint64)
            keys = np.zeros((len(own), BANDS), dtype=np.uint64)
            for b in range(BANDS):
                for j in range(b * ROWS, (b + 1) * ROWS):
                    keys[:, b] = mix(keys[:, b] * _STEP + sig[:, j] + np.uint64(b + 1))
            keys = keys.view(np.int64)
            node = words.whole().view(np.int64)
            yield pd.DataFrame({"doc_id": own["doc_id"].to_numpy(), "th": own["th"].to_numpy(), "node": node, "bands": [k if n else [] for k, n in zip(keys, words.n, strict=True)], "empty": words.n == 0})


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs whose bags overlap by THRESHOLD."""
    kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def bags(nodes: np.ndarray, texts: list[str]) -> None:
        new = {n: t for n, t in zip(nodes, texts, strict=True) if n not in kept}
        doc, element, weight, _ = bag(list(new.values()))
        cuts = np.searchsorted(doc, np.arange(len(new) + 1))
        for i, n in enumerate(new):
            kept[n] = element[cuts[i] : cuts[i + 1]], weight[cuts[i] : cuts[i + 1]]

    for pdf in batches:
        for part in range(0, len(pdf), 500):
            own = pdf.iloc[part : part + 500]
            while len(kept) > 1000:
                kept.popitem(last=False)
            bags(np.concatenate([own["a"], own["b"]]), [*own["text_a"], *own["text_b"]])
            ok = []
            for a, b in zip(own["a"], own["b"], strict=True):
                (ea, wa), (eb, wb) = kept[a], kept[b]
                at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
                both = int(np.minimum(wa, wb[at])[eb[at] == ea].sum())
                ok.append(both >= THRESHOLD * (int(wa.sum()) + int(wb.sum()) - both))
            yield own.loc[ok, ["a", "b", "fa", "fb"]]


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar: (a, b, fa, fb), the nodes and their first documents; ``texts`` has node, first and text.

    The pairs of a node that has many are spread, its text is sent with each part.
    """
    for side in ("a", "b"):
        parts = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
        own = texts.join(parts, "node").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        own = own.select(F.col("node").alias(side), "part", "parts", F.col("first").alias(f"f{side}"), F.col("text").alias(f"text_{side}"))
        other = F.xxhash64("b" if side == "a" else "a")
        pairs = pairs.join(parts.withColumnRenamed("node", side), side).withColumn("part", F.pmod(other, F.col("parts")).cast("int")).drop("parts")
        pairs = pairs.join(own.drop("parts"), [side, "part"]).drop("part")
    return pairs.select("a", "b", "fa", "fb", "text_a", "text_b").mapInPandas(_similar, "a long, b long, fa long, fb long")


def _compare(own: pd.DataFrame) -> pd.DataFrame:
    """One edge (a, b, fa, fb) for each two labels that similar texts of the two sides join."""
    doc, element, weight, _ = bag(list(own["text"]))
    # A weight of w is w elements, so that overlaps are counts.
    i = np.repeat(np.arange(len(doc)), weight)
    copy = np.arange(len(i)) - np.repeat(np.cumsum(weight) - weight, weight)
    doc, element = doc[i], mix(element[i] + copy.astype(np.uint64) * _STEP)
    side, label = own["side"].to_numpy(), own["label"].to_numpy()
    total = np.bincount(doc, minlength=len(own))
    right = side[doc] == 1
    order = np.argsort(element[right], kind="stable")
    others, elements = doc[right][order], element[right][order]
    left_doc, left = doc[~right], element[~right]  # in order of text
    lo, hi = np.searchsorted(elements, left, "left"), np.searchsorted(elements, left, "right")
    many = np.concatenate([[0], np.cumsum(hi - lo)])
    names, found = np.flatnonzero(side == 0), []
    cuts = np.searchsorted(left_doc, np.append(names, len(own)))
    at = 0
    while at < len(names):
        upto = max(at + 1, int(np.searchsorted(many[cuts], many[cuts[at]] + HELD, "right")) - 1)
        rows = slice(cuts[at], cuts[upto])
        n = hi[rows] - lo[rows]
        k = np.repeat(lo[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pair, both = np.unique(np.repeat(left_doc[rows], n).astype(np.int64) * len(own) + others[k], return_counts=True)
        x, y = pair // len(own), pair % len(own)
        ok = (both >= THRESHOLD * (total[x] + total[y] - both)) & (label[x] != label[y])
        found.append(np.stack([x[ok], y[ok]], axis=1))
        at = upto
    x, y = np.concatenate(found).T if found else (np.zeros(0, dtype=np.int64),) * 2
    low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
    keep = ~pd.DataFrame({"l": low, "h": high}).duplicated().to_numpy()
    node, first = own["node"].to_numpy(), own["first"].to_numpy()
    return pd.DataFrame({"a": node[x[keep]], "b": node[y[keep]], "fa": first[x[keep]], "fb": first[y[keep]]})


def _compare_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come in order of their group; the last one of a batch may go on in the next."""
    rest: list[pd.DataFrame] = []
    for pdf in batches:
        new = np.flatnonzero(pdf["grp"].to_numpy()[1:] != pdf["grp"].to_numpy()[:-1]) + 1
        for piece in np.split(np.arange(len(pdf)), new):
            if len(piece):
                some = pdf.iloc[piece]
                if rest and rest[0]["grp"].iloc[0] != some["grp"].iloc[0]:
                    yield _compare(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(some)
    if rest:
        yield _compare(pd.concat(rest, ignore_index=True))


def across_classes(members: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges between the classes of one bucket: (a, b, fa, fb), from ``members`` (bucket, node, label), all pairs of different labels compared.

    Every pair has a member outside the bucket's largest class: blocks of those are held against blocks of all.
    """
    # Bands often have the same members: one bucket of each kind is enough.
    kinds = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
    once = kinds.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"))
    sizes = members.join(once.select("bucket"), "bucket", "left_semi").groupBy("bucket", "label").agg(F.count("*").alias("n"))
    top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"), F.sum("n").alias("n")).where("classes > 1")
    top = top.select("bucket", F.col("top.label").alias("top"), F.ceil(F.col("n") / block).cast("int").alias("nr"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("nl"))
    rows = members.join(top, "bucket")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.where("label <> top").select("bucket", own("nl").alias("i"), each("nr").alias("j"), "node", "label", F.lit(0).alias("side"))
    right = rows.select("bucket", each("nl").alias("i"), own("nr").alias("j"), "node", "label", F.lit(1).alias("side"))
    dealt = left.unionByName(right).select(F.xxhash64("bucket", "i", "j").alias("grp"), "node", "label", "side").join(texts, "node")
    dealt = dealt.select("grp", "side", "node", "label", "first", "text").repartition("grp").sortWithinPartitions("grp", "side")
    return dealt.mapInPandas(_compare_groups, "a long, b long, fa long, fb long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): of each connected component of ``edges`` (a, b, fa, fb) the node with the smallest (first, node).

    Least labels of neighbours and label of the label, until nothing changes. As edges lead to the first members of
    buckets, labels in the order of first documents settle in a few rounds.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("fb").alias("fa"), F.col("fa").alias("fb"))
    both = cut(edges.select("a", "b", "fa", "fb").unionByName(turned).distinct())
    own = F.struct(F.min("fa").alias("first"), F.col("node"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min(F.struct(F.col("fb").alias("first"), F.col("b").alias("node"))), own).alias("label")))
    both = both.select("a", "b")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")).withColumn("to", F.col("label.node"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        new = cut(new.join(jump, "to").select("node", "old", F.least("label", "next").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label.node").alias("label"))


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """Per row: doc_id, ``th`` (hash of its text), ``node`` (hash of its words) and ``class_id``."""
    rows = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)).alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("th", F.xxhash64("text"))
    made = cut(rows.mapInPandas(_features, "doc_id long, th long, node long, bands array<long>, empty boolean"))
    # Different texts, each with its first document.
    nodes = made.where("not empty").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("bands").alias("bands"))
    members = nodes.select("node", "first", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("first", "node")).alias("hub")).where("size > 1")
    members = cut(members.join(sizes, "bucket").select("bucket", "size", "node", "first", F.col("hub.node").alias("hub")))
    involved = nodes.select("node", "first.*").join(members.select("node").distinct(), "node", "left_semi")
    texts = cut(rows.join(involved, ["doc_id", "th"]).select("node", F.col("doc_id").alias("first"), "text").dropDuplicates(["node"]))

    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    pairs = cut(members.where("node <> hub").select(F.col("hub").alias("x"), F.col("node").alias("y")).select(*pair).distinct())
    tested, edges = pairs, cut(verified(pairs, texts))
    labels = components(edges)
    hubs = members.select("bucket", "hub").distinct()
    for _ in range(rounds - 1):
        # The first member of each bucket that is outside the classes of its hubs so far.
        now = _labelled(members, labels).select("bucket", "node", "first", "label")
        taken = hubs.join(labels.select(F.col("node").alias("hub"), "label"), "hub", "left").select("bucket", F.coalesce("label", "hub").alias("label")).distinct()
        nexts = now.join(taken, ["bucket", "label"], "left_anti").groupBy("bucket").agg(F.min(F.struct("first", "node", "label")).alias("next"))
        nexts = cut(nexts.select("bucket", F.col("next.node").alias("next"), F.col("next.label").alias("next_label")))
        star = now.join(nexts, "bucket").where("label <> next_label").select(F.col("next").alias("x"), F.col("node").alias("y"))
        pairs = cut(star.select(*pair).distinct().join(tested, ["a", "b"], "left_anti"))
        if not pairs.limit(1).count():
            break
        tested, edges = tested.unionByName(pairs), edges.unionByName(cut(verified(pairs, texts)))
        labels = components(edges)
        hubs = hubs.unionByName(nexts.select("bucket", F.col("next").alias("hub")))
    # The rest: whatever is still in different classes of one bucket, without the first members, which all were held against.
    rest = members.select("bucket", "node").join(hubs.select("bucket", F.col("hub").alias("node")), ["bucket", "node"], "left_anti")
    more = cut(across_classes(cut(_labelled(rest, labels).select("bucket", "node", "label")), texts, block))
    if more.limit(1).count():
        labels = components(edges.unionByName(more))
    named = made.where("not empty").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    out = named.join(classes, "label").select("doc_id", "th", "node", "class_id").unionByName(made.where("empty").select("doc_id", "th", "node", F.col("doc_id").alias("class_id")))
    null = lambda c: F.when(F.col(c) != _NULL, F.col(c)).alias(c)
    return out.select(null("doc_id"), "th", "node", null("class_id"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their class (by key, then hash of the text), each once."""
    known = near_duplicates(docs, key, text).withColumn("doc", F.coalesce("doc_id", F.lit(_NULL)))
    alone = F.when(F.col("class_id").isNull(), F.col("node"))  # documents without a key are told apart by their words
    first = known.groupBy("class_id", alone).agg(F.min(F.struct("doc", "th")).alias("first")).select(F.col("first.doc").alias("__doc"), F.col("first.th").alias("__th"))
    rows = docs.withColumns({"__doc": F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_NULL)), "__th": F.xxhash64(text)})
    return rows.join(first, ["__doc", "__th"], "left_semi").dropDuplicates(["__doc", "__th"]).drop("__doc", "__th")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
