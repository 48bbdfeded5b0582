"""The pipeline on planted documents, stage by stage."""

import random

import corpus_pipeline
from tests.llm.test_llm import DOCS, rnd_text


def test_pipeline(spark, tmp_path):
    rnd = random.Random(11)
    words = {"en": [f"the{i}" for i in range(3000)], "de": [f"und{i}" for i in range(3000)]}
    text = lambda lang, n: "\n".join(" ".join("".join(c for c in rnd.choice(words[lang]) if c.isalpha()) + rnd.choice("abcdefgh") + str(rnd.randrange(900)) for _ in range(12)) for _ in range(n))
    passage = rnd_text(rnd, 40, 9000)
    rows = [(i, text(x, 6), x, f"s{i % 3}", 0) for i, x in enumerate(["en", "de"] * 15)]
    rows.append((100, rows[0][1], "en", "s0", 0))  # an exact copy
    rows.append((101, passage, "en", "s1", 0))  # a benchmark passage
    rows += [(102, "12 34", "en", "s1", 0), (103, None, None, None, None)]  # no language
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id for r in docs.collect()})
    clean = set(range(30))
    assert kept[0] == clean | {100, 101} and kept[1] == clean | {101} and kept[2] == kept[1] and kept[3] == clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == clean and all(r.taken <= 3 * r["size"] for r in out)
