"""Findings of the third round: blocks of BM25, texts left behind, sides searched once, resampling, all pairs of methods."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from evalloom.functions import text as T
from evalloom.operators import postings, ranking, retrieval, stats

DATA = "/root/testdata/sf0.001"
ODD = ["Heat PUMP heat", "", None, "the a b c", "--- a-b -", "K-Wert İst ſs STRASSE", "null\x00mark heat", "日本heat語 x9 9", "heat" * 50, " \n\theat\r"]


def test_tokens_are_those_of_the_engine(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, t string").select("i", T.tokenize(F.col("t")).alias("w")).orderBy("i").collect()
    words, text = postings.tokens([(t or "").encode() for t in ODD])
    assert list(zip(text.tolist(), [w.decode() for w in words.to_pylist()], strict=True)) == [(r.i, w) for r in rows for w in r.w]


def brute(docs, queries, k, source=None):
    take = lambda t: [w for w in "".join(c if c.isascii() and (c.isalnum() or c == "-") else " " for c in (t or "").lower()).split() if len(w) > 1 and w not in T.STOPWORDS]
    own = [(c, s, o, take(t)) for c, s, o, t in docs]
    avg = sum(max(1, len(w)) for *_, w in own) / len(own)
    df = {w: sum(w in x for *_, x in own) for w in {w for *_, x in own for w in x}}
    out = {}
    for q, t in queries:
        scored = []
        for c, s, o, words in own:
            score = sum(math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * 2.2 / (words.count(w) + 1.2 * (0.25 + 0.75 * max(1, len(words)) / avg)) for w in take(t) if w in words)
            if round(score, 9) > 0 and source in (None, s):
                scored.append((-round(score, 9), o, c))
        out.update({(q, i + 1): (c, pytest.approx(-s, abs=2e-9)) for i, (s, _, c) in enumerate(sorted(scored)[:k])})
    return out


@pytest.mark.parametrize("size,sent", [(ranking.BLOCK_BYTES, ranking.BROADCAST_WORDS), (300, 2), (700, 0)])
def test_blocks_of_bm25_against_brute_force(spark, monkeypatch, size, sent):
    """Any blocks, words sent or not: one result, ties by order, copies included."""
    monkeypatch.setattr(ranking, "BLOCK_BYTES", size)
    monkeypatch.setattr(ranking, "BROADCAST_WORDS", sent)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["heat", "pump", "solar", "grid", "the", "x", "panel-9", "Öl"]) for _ in range(n))
    docs = [(f"c{i}", f"s{i % 3}", i, text(rng.randrange(1, 12))) for i in range(60)] + [("e", "s0", 60, None), ("f", None, 61, "heat"), *[(f"t{i}", "s1", 70 + i, "pump pump grid") for i in range(9)]]
    queries = [(1, "heat pump heat"), (2, "nothing here"), (3, None), (4, text(20)), (5, "GRID solar öl")]
    index = ranking.Bm25Index(spark.createDataFrame(docs, "chunk_id string, source string, ord long, chunk string"))
    asked = spark.createDataFrame(queries, "query_id int, query string")
    for source in (None, "s1"):
        got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in index.search(asked, 4, source, fallback=False).collect()}
        assert got == brute(docs, queries, 4, source)


@pytest.mark.parametrize("heavy,queries,chunks,added", [(2, 3, 5, 7), (0, 100, 100, 1 << 20), (100, 2, 1, 1)])
def test_a_block_passes_on_the_best_only(monkeypatch, heavy, queries, chunks, added):
    """A block of q queries gives at most k rows a query, whatever the pairs that it scores."""
    for name, value in (("HEAVY", heavy), ("QUERIES", queries), ("CHUNKS", chunks), ("ADDED", added)):
        monkeypatch.setattr(postings, name, value)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    pick = lambda: sorted(rng.choice(words, rng.integers(1, 9), replace=False))
    q, d = [pick() for _ in range(10)], [pick() for _ in range(40)]
    weights = [[float(rng.integers(1, 4)) for _ in x] for x in q]
    spell = lambda x: "".join(w + " " for w in x).encode()
    asked = pa.table({"query_id": list(range(10)), "words": [spell(x) for x in q], "weights": weights, "avgdl": [5.0] * 10})
    own = pa.table({"chunk_id": [f"c{i}" for i in range(40)], "source": ["s"] * 40, "ord": [39 - i for i in range(40)], "dl": [len(x) for x in d], "words": [spell(x) for x in d], "tf": [np.ones(len(x), dtype=np.int32).tobytes() for x in d]})
    got = postings.meet(3)(asked, own).to_pylist()
    want = []
    for i in range(10):
        part = lambda j: 2.2 / (1 + 1.2 * (0.25 + 0.75 * len(d[j]) / 5.0))
        scored = sorted((-round(sum(v * part(j) for w, v in zip(q[i], weights[i], strict=True) if w in d[j]), 9), 39 - j, f"c{j}") for j in range(40))
        want += [(i, c, pytest.approx(-s, abs=2e-9)) for s, _, c in scored[:3] if s < 0]
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == want


def test_candidates_of_the_queries_carry_no_texts(spark):
    """The texts of all candidates went through fusion and rerank before."""
    from evalloom.plans import registry

    found = registry._retriever(spark, DATA, 5)("hybrid").sides(registry._asked(spark, DATA))
    assert {e: "chunk" in rows.columns for e, rows in found.items()} == {"lexical": False, "vector": False}


def test_texts_are_there_where_they_are_asked_for(spark):
    chunks = spark.createDataFrame([("a", "s", 0, "rot apfel"), ("b", "gesetz", 1, "apfel")], "chunk_id string, source string, ord long, chunk string")
    queries = spark.createDataFrame([(1, "apfel")], "query_id int, query string")
    index = ranking.Bm25Index(chunks)
    with_texts, without = (retrieval.Retriever(retrieval.lexical(index, chunks, texts=t), mode="lexical_only").retrieve(queries).orderBy("rank").collect() for t in (True, False))
    assert [r.chunk for r in with_texts] == ["apfel", "rot apfel"]
    assert [(r.chunk_id, r.source, r.score, r.engine) for r in with_texts] == [(r.chunk_id, r.source, r.score, r.engine) for r in without]


def test_each_side_is_searched_once_for_all_modes(spark):
    calls = []
    kind = "query_id int, rank int, chunk_id string, source string, score double"

    def side(name):
        return lambda queries, k, source: (calls.append(name), spark.createDataFrame([(1, 1, "a", "s", 1.0)], kind))[1]

    got = retrieval.evaluate(lambda mode: retrieval.Retriever(side("l"), side("v"), mode), spark.createDataFrame([(1,)], "query_id int"), spark.createDataFrame([(1, "a"), (1, "A")], "query_id int, item string"), "chunk_id").collect()
    assert sorted(calls) == ["l", "v"]
    assert {(r.mode, r.n_queries, r.hit_at_5, r.mrr_at_10) for r in got} == {(m, 1, 1.0, 1.0) for m, _, _ in retrieval.EVALUATED}


@pytest.mark.parametrize("n", [2, 3, 4, 64, 1000, 70_001])
def test_resampling_draws_as_random_does(n):
    values = [random.Random(i).random() for i in range(n)]
    times = max(2, min(50, 200_000 // n))
    rng = random.Random(42)
    want = [sum(values[rng.randrange(n)] for _ in range(n)) / n for _ in range(times)]
    assert stats.resampled_means(np.array(values), times, 42) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("name", ["tasktype_delta_summary", "tasktype_heatmap"])
def test_task_types_hold_all_pairs_of_methods(spark, name):
    rows = entry.queries()[name](spark, DATA).select("comparison").distinct().collect()
    assert {r.comparison for r in rows} == {"Advanced Prompting - Zero-Shot", "RAG - Zero-Shot", "RAG - Advanced Prompting"}


@pytest.mark.parametrize("copies", [1, 10])
def test_blocks_of_bm25_do_not_grow_with_the_chunks(spark, copies):
    """Ten times the text gives ten times the blocks, so that no task holds more of it; rows are all dealt."""
    most, sizes = 1000, [40] * 250 * copies
    n = ranking.parts(spark.createDataFrame([(x,) for x in sizes], "size int"), most, 4)
    assert sum(sizes) / n <= most and n <= sum(sizes) / most + 1
