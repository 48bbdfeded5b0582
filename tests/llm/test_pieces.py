import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from evalloom.llm import pieces as P
from evalloom.llm import queries

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def noise(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(["a", "b", " ", " ", "the", "ing", "▁", "\n", "\t", "漢", "🎉", "é", "<s>", "<0x41>", "12", "\x00", "\x85"]) for _ in range(r.randrange(60))) for _ in range(n)]


def test_chunks_are_segmented_as_the_whole_text(library):
    import pyarrow as pa

    segment = P.Vocabulary.load(P.default_model()).segmenter()
    texts = [*noise(3000, 1), "", "   ", "a ", " a", "a" * 3000, " " * 333, "x" + " " * 40 + "y", None]
    for known in ([], ["the", "", "▁", "a", "12"]):
        ids = P._placed(P.chunks_of(pa.array(texts)), pa.array(known, pa.string()), segment(known), segment)
        for t, got in zip(texts, ids.to_pylist(), strict=True):
            assert got == library.encode(t or ""), t


def test_the_table_holds_the_most_frequent_chunks(spark):
    v = P.Vocabulary.load(P.default_model())
    df = spark.createDataFrame([("a b b c",), ("b  c c",), (None,), ("z" * 100,), ("z" * 100 + " b",)], "text string").repartition(3)
    assert P.chunk_table(df, v, known=2).column("chunk").to_pylist() == ["b", "c"]
    assert set(P.chunk_table(df, v).column("chunk").to_pylist()) == {"a", "b", "c", "▁c"}


@pytest.mark.parametrize("known", [3, 1000])
def test_encodes_and_decodes_whole_texts(spark, library, known):
    r = random.Random(2)
    texts = [*noise(300, 3), None, "", " ", " ".join(r.choice(["alpha", "Béta", "γάμμα", str(r.random())]) for _ in range(60_000)), "z" * 200_000]
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "same"), (7, "same")]
    df = spark.createDataFrame(rows, DOCS).withColumns({"ids": F.lit("clash"), "batch": F.lit(1), "key": F.lit(2)}).repartition(3)
    out = P.decode(P.encode(df, batch=20_000, known=known))
    assert out.columns == ["doc_id", "batch", "key", "ids", "text"]
    out = out.collect()
    want = sorted((str(k), library.encode(t or ""), library.decode(library.encode(t or ""))) for k, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.text) for r in out) == want


def test_empty_table(spark):
    assert P.decode(P.encode(spark.createDataFrame([], DOCS))).collect() == []


def test_decodes_any_ids(spark, library):
    r = random.Random(4)
    lists = [[r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randrange(12))] for _ in range(1500)] + [[3 + b for b in "é漢🎉".encode()], []]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(-1, None)], "n long, ids array<int>")
    got = {x.n: x.text for x in P.decode(df).collect()}
    assert got.pop(-1) == ""
    assert [(lists[i], t) for i, t in got.items() if t != library.decode(lists[i])] == []


def test_query_digests(spark, library):
    d = "/root/testdata/sf0.001"
    docs = {x.doc_id: x.text or "" for x in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = queries.QUERIES["op11_sentencepiece"](spark, d).collect()
    assert len(out) == len(docs)
    for x in out:
        ids = library.encode(docs[x.doc_id])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_rejects_models_that_cross_markers(monkeypatch):
    class Crossing(sentencepiece.SentencePieceProcessor):
        def id_to_piece(self, i):
            return "of▁the" if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cross"):
        P.Vocabulary.load(P.default_model())
