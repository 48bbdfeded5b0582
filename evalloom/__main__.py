"""Command line: ``python -m evalloom query NAME DIR OUT`` | ``analyse IN OUT`` | ``merge BASE PATCH KEY,... OUT [--ids ID,...]``
| ``chunks DIR OUT`` | ``questions CATALOGUE OUT`` | ``preprocess DIR OUT [--force]``."""

from __future__ import annotations

import argparse

from .operators import chunking, tasks
from .plans import evaluation, registry
from .session import session
from .sources import catalogue, io


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="evalloom", description=__doc__)
    sub = p.add_subparsers(dest="do", required=True)
    for name, args in {"query": ["name", "dir", "out"], "analyse": ["input", "out"], "merge": ["base", "patch", "keys", "out"], "chunks": ["dir", "out"], "questions": ["input", "out"], "preprocess": ["dir", "out"]}.items():
        s = sub.add_parser(name)
        for a in args:
            s.add_argument(a)
    sub.choices["chunks"].add_argument("--size", type=int, default=400)
    sub.choices["chunks"].add_argument("--overlap", type=int, default=70)
    sub.choices["merge"].add_argument("--ids", default="")
    sub.choices["preprocess"].add_argument("--force", action="store_true")
    a = p.parse_args(argv)
    spark = session()
    if a.do == "query":
        registry.QUERIES[a.name](spark, a.dir).write.mode("overwrite").parquet(a.out)
    elif a.do == "analyse":
        for name, df in evaluation.analyse(io.read_table(spark, a.input)).items():
            df.write.mode("overwrite").parquet(f"{a.out}/{name}")
    elif a.do == "merge":
        keys = a.keys.split(",")
        tasks.upsert(io.read_table(spark, a.base, tuple(keys)), io.read_table(spark, a.patch, tuple(keys)), keys, {i.strip() for i in a.ids.split(",") if i.strip()} or None).write.mode("overwrite").parquet(a.out)
    elif a.do == "questions":
        io.write_json(catalogue.to_questions(io.read_table(spark, a.input)), a.out)
    elif a.do == "preprocess":
        print(io.preprocess(spark, a.dir, a.out, force=a.force))
    else:
        chunking.chunk_sections(io.text_folder(spark, a.dir), a.size, a.overlap).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
