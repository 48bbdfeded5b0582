"""Every query of the engine by name, and the SQL that it is compared with.

Doubles are rounded to 6 digits on both sides, as sums differ in their last bits with the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normal as N
from ..functions import scoring as S
from ..functions import text as T
from ..operators import chunking, exports, judging, normality, ranking, reports, retrieval, stats, tasks
from ..sources import vector_index
from . import frames as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    places = lambda c: 12 if "Cost" in c or c == "cost" else digits  # noqa: E731 - costs are small
    return df.select(*[F.round(F.col(f"`{c}`"), places(c)).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)
_TOK = "list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9-]+'), lambda x: length(x) > 1 AND x NOT IN (" + _STOP + "))"
_SRC = "CASE doc_id % 4 WHEN 0 THEN 'gesetz_' WHEN 1 THEN 'din_' WHEN 2 THEN 'blog_' ELSE 'handbuch_' END || source || '_' || doc_id"


@query(f"SELECT token, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(c='text')}) AS token FROM documents) GROUP BY ALL) GROUP BY token")
def tokenize_counts(spark, d):
    tf = R.table(spark, d, "documents").select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))
    return tf.groupBy("token").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n"))


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(s, '_t\\.txt|gesetz|verordnung|richtlinie|directive|csrd|sfdr|epbd|epra|eu-tax|geg|geig|bafa') THEN 'law' WHEN regexp_matches(s, 'din|iso|vdi|norm') THEN 'standard' WHEN regexp_matches(s, 'wikipedia|baunetz|wissen|blog|magazin') THEN 'web' ELSE 'technical' END AS kind FROM (SELECT lower({_SRC}) AS s FROM documents)) GROUP BY kind""")
def source_class_counts(spark, d):
    return R.corpus(spark, d).groupBy(T.source_class(F.col("source")).alias("kind")).agg(F.count("*").alias("n"))


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{T.SPACE}+|{T.SPACE}+$', '', 'g')"


_CLEAN = f"""ln AS (SELECT {_SRC} AS source, list_filter(list_transform(regexp_split_to_array({R.SQL_HEADED}, '{T.LINE_END}'), lambda x: {_strip("x")}),
  lambda x: NOT regexp_matches(x, '{T.PAGE_MARKERS}')) AS l FROM documents),
t AS (SELECT source, {_strip("regexp_replace(array_to_string(l, chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS t FROM ln)"""
_CUT = f"{_strip('substr(t, i * 330 + 1, 400)')} AS chunk"


@query(f"""WITH {_CLEAN},
p AS (SELECT source, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 400) / 330.0)) AS BIGINT) + 1)) AS i FROM t),
c AS (SELECT source, i, {_CUT} FROM p)
SELECT source, source || '::chunk_' || printf('%04d', row_number() OVER (PARTITION BY source ORDER BY i)) AS chunk_id, chunk FROM c WHERE chunk <> ''""")
def chunk_fixed(spark, d):
    return chunking.chunk_fixed(R.headed_corpus(spark, d))


@query(rf"""WITH {_CLEAN}, l AS (SELECT source, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t),
h AS (SELECT *, sum(CASE WHEN line <> '' AND (line LIKE '#%' OR regexp_matches(line, '^§\s*\d+[a-zA-Z]*') OR regexp_matches(line, '^\d+(\.\d+)*\s+[A-Za-z]') OR (line LIKE '%:' AND length(line) <= 120)) THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY n) AS sec FROM l),
g AS (SELECT source, sec, string_agg(line, chr(10) ORDER BY n) AS u FROM h GROUP BY source, sec), s AS (SELECT source, sec, {_strip("u")} AS t FROM g),
p AS (SELECT source, sec, t, unnest(range(0, CAST(greatest(0, ceil((length(t) - 400) / 330.0)) AS BIGINT) + 1)) AS i FROM s WHERE t <> ''),
c AS (SELECT source, sec, i, {_CUT} FROM p)
SELECT source, source || '::chunk_' || printf('%04d', row_number() OVER (PARTITION BY source ORDER BY sec, i)) AS chunk_id, chunk FROM c WHERE chunk <> ''""")
def chunk_sections(spark, d):
    return chunking.chunk_sections(R.headed_corpus(spark, d))


_BM = f"""tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(c='text')}) AS token FROM documents) GROUP BY ALL),
dl AS (SELECT doc_id, {_SRC} AS source, greatest(len({_TOK.format(c='text')}), 1) AS dl FROM documents), st AS (SELECT greatest(count(*), 1) AS n, avg(dl) AS avgdl FROM dl),
idf AS (SELECT token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, st GROUP BY token),
q AS (SELECT item_id AS query_id, token, count(*) AS qf FROM (SELECT item_id, unnest({_TOK.format(c='text')}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tf.doc_id, any_value(source) AS source, round(sum(qf * idf * tf * 2.2 / greatest(tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl), 1e-9)), 9) AS score FROM tf JOIN q USING (token) JOIN idf USING (token) JOIN dl USING (doc_id), st {{w}} GROUP BY query_id, tf.doc_id)"""


@query("WITH " + _BM.format(w="") + " SELECT token, df, round(idf, 6) AS idf FROM idf")
def bm25_idf(spark, d):
    return rounded(ranking.Bm25Index(R.whole_documents(spark, d)).terms)


def _top(where, k):
    return "WITH " + _BM.format(w=where) + f", r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS chunk_id, source, round(score, 6) AS score FROM r WHERE rank <= {k}"


@query(_top("", 5))
def bm25_topk(spark, d):
    return rounded(ranking.Bm25Index(R.whole_documents(spark, d)).search(R.benchmark_queries(spark, d), 5, fallback=False))


@query(_top("WHERE source = (SELECT min(source) FROM dl)", 5))
def bm25_topk_filtered(spark, d):
    chunks = R.whole_documents(spark, d)
    first = chunks.agg(F.min("source")).first()[0]
    return rounded(ranking.Bm25Index(chunks).search(R.benchmark_queries(spark, d), 5, source=first, fallback=False))


_ASKED = "SELECT n_nationkey AS query_id, CASE WHEN n_nationkey % 2 = 0 THEN 'xq9zw' || lower(n_name) || 'xq9zw' ELSE text END AS text FROM nation JOIN documents ON doc_id = n_nationkey"
_FALLBACK = _BM.format(w="").replace("SELECT item_id AS query_id, token", "SELECT query_id, token").replace(f"SELECT item_id, unnest({_TOK.format(c='text')}) AS token FROM benchmark", f"SELECT query_id, unnest({_TOK.format(c='text')}) AS token FROM ({_ASKED})")


@query(f"""WITH {_FALLBACK}, al AS (SELECT query_id FROM ({_ASKED})), fd AS (SELECT doc_id, {_SRC} AS source, row_number() OVER (ORDER BY doc_id) AS rank FROM documents),
r AS (SELECT query_id, doc_id, source, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS VARCHAR) AS chunk_id, source, round(score, 6) AS score FROM r WHERE rank <= 5
UNION ALL SELECT query_id, CAST(rank AS INTEGER), CAST(doc_id AS VARCHAR), source, 0.0 FROM al, fd WHERE rank <= 5 AND query_id NOT IN (SELECT query_id FROM r)""")
def bm25_topk_fallback(spark, d):
    """Queries that nothing matches get the first chunks with score 0."""
    name = F.concat(F.lit("xq9zw"), F.lower("n_name"), F.lit("xq9zw"))
    asked = R.table(spark, d, "nation").join(R.table(spark, d, "documents").select("doc_id", "text"), F.col("doc_id") == F.col("n_nationkey"))
    queries = asked.select(F.col("n_nationkey").alias("query_id"), F.when(F.col("n_nationkey") % 2 == 0, name).otherwise(F.col("text")).alias("query"))
    return rounded(ranking.Bm25Index(R.whole_documents(spark, d)).search(queries, 5))


def _vector(spark, d, k):
    v = R.table(spark, d, "embeddings")
    return ranking.vector_search(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), k)


_VEC = "vd AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))), 9) AS dist FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM vd)"


@query(f"WITH {_VEC} SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(dist, 6) AS dist FROM vr WHERE rank <= 10")
def vector_topk(spark, d):
    return rounded(_vector(spark, d, 10))


def _hybrid_lists(spark, d):
    """Both lists of the queries vec_id % 50 = 0: BM25 with the document's text, vectors with the embedding."""
    asked = R.table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    lex = ranking.Bm25Index(R.whole_documents(spark, d)).search(asked, ranking.CANDIDATES, fallback=False)
    vec = _vector(spark, d, ranking.CANDIDATES).withColumn("chunk_id", F.col("vec_id").cast("string"))
    return lex, vec


_HYB = _BM.format(w="").replace("SELECT item_id AS query_id, token", "SELECT doc_id AS query_id, token").replace(f"SELECT item_id, unnest({_TOK.format(c='text')}) AS token FROM benchmark", f"SELECT doc_id, unnest({_TOK.format(c='text')}) AS token FROM documents WHERE doc_id % 50 = 0")
_FUSE = f"""{_HYB}, lr AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0), {_VEC},
fu AS (SELECT query_id, chunk_id, min(lex) AS lex, min(vec) AS vec FROM (SELECT query_id, chunk_id, rank AS lex, NULL AS vec FROM lr WHERE rank <= 50 UNION ALL SELECT query_id, CAST(vec_id AS VARCHAR), NULL, rank FROM vr WHERE rank <= 50) GROUP BY ALL),
fs AS (SELECT *, round(coalesce(1.0::DOUBLE / (60 + lex), 0) + coalesce(1.0::DOUBLE / (60 + vec), 0), 9) AS fusion FROM fu),
fr AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, coalesce(lex, 1073741824), vec NULLS FIRST, chunk_id) AS rank, chunk_id, fusion FROM fs)"""


@query(f"WITH {_FUSE} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(fusion, 6) AS fusion FROM fr WHERE rank <= 10")
def rrf_hybrid(spark, d):
    lex, vec = _hybrid_lists(spark, d)
    return rounded(ranking.fuse(lex, vec).where("rank <= 10"))


# Greedy choice, pick by pick: the rest of a query's candidates in a list, the sources used so far in another.
_PICKS = """g0 AS (SELECT query_id, 0 AS n, list(struct_pack(c := chunk_id, s := source, v := value) ORDER BY rank) AS rest, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS STRUCT(f DOUBLE, i BIGINT, c VARCHAR, s VARCHAR)) AS ch FROM val GROUP BY query_id),
gr AS (SELECT * FROM g0 UNION ALL SELECT query_id, n + 1, list_filter(rest, lambda x: x.c <> pick.c), list_append(used, pick.s), pick FROM (
 SELECT *, CASE WHEN list_contains(used, so[1].s) THEN coalesce(list_filter(so[2:6], lambda y: NOT list_contains(used, y.s) AND so[1].f - y.f <= 0.04)[1], so[1]) ELSE so[1] END AS pick FROM (
 SELECT *, list_reverse_sort(list_transform(rest, lambda x, i: struct_pack(f := x.v - 0.03::DOUBLE * len(list_filter(used, lambda u: u = x.s)), i := -CAST(i AS BIGINT), c := x.c, s := x.s))) AS so FROM gr WHERE n < {k} AND len(rest) > 0)))"""
_KIND = "CASE WHEN regexp_matches({0}, '_t\\.txt|gesetz|verordnung|richtlinie|directive|csrd|sfdr|epbd|epra|eu-tax|geg|geig|bafa') THEN 0.18 WHEN regexp_matches({0}, 'din|iso|vdi|norm') THEN 0.08 WHEN regexp_matches({0}, 'wikipedia|baunetz|wissen|blog|magazin') THEN -0.08 ELSE 0.0 END::DOUBLE"
_SHARED = "CASE doc_id % 4 WHEN 0 THEN 'gesetz_' WHEN 1 THEN 'din_' WHEN 2 THEN 'blog_' ELSE 'handbuch_' END || source"
_CHOICE = f"""ns AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_SHARED} AS source FROM documents), ls AS (SELECT query_id, CAST(doc_id AS VARCHAR) AS chunk_id, score FROM sc),
sd AS (SELECT query_id, count(lex) > 0 AS l, count(vec) > 0 AS v FROM fu GROUP BY query_id),
rl AS (SELECT fr.query_id, fr.chunk_id, fr.rank, coalesce(ns.source, '') AS source, CASE WHEN l AND v THEN fusion WHEN l THEN ls.score ELSE 1 / (1 + greatest(dist, 0)) END AS rel, l FROM fr JOIN sd USING (query_id) LEFT JOIN ns USING (chunk_id) LEFT JOIN ls ON ls.query_id = fr.query_id AND ls.chunk_id = fr.chunk_id LEFT JOIN vr ON vr.query_id = fr.query_id AND CAST(vr.vec_id AS VARCHAR) = fr.chunk_id),
val AS (SELECT query_id, chunk_id, rank, source, CASE WHEN l THEN rel / max(rel) OVER (PARTITION BY query_id) ELSE rel END + {_KIND.format("lower(source)")} AS value FROM rl)"""


def _retriever(spark, d, k):
    """Both sides over the documents, whose sources are shared; the vector of a document asks for it."""
    chunks = R.whole_documents(spark, d).withColumn("source", F.regexp_replace("source", "_[0-9]+$", ""))

    def vector(queries, k, source):
        found = ranking.vector_search(R.table(spark, d, "embeddings"), queries.select("query_id", F.col("vector").alias("query")), k)
        named = found.select("query_id", "rank", F.col("vec_id").cast("string").alias("chunk_id"), F.col("dist").alias("score"))
        own = chunks.select("chunk_id", "source")
        listed = named.join(own, "chunk_id", "left").withColumn("source", F.coalesce("source", F.lit("")))  # vectors without a document stay
        return listed.select(*retrieval.listed_in(listed))

    lexical = retrieval.lexical(ranking.Bm25Index(chunks), chunks, fallback=False, texts=False)
    return lambda mode: retrieval.Retriever(lexical, vector, mode, k=k)


def _asked(spark, d):
    v = R.table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return R.table(spark, d, "documents").where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")).join(v, "query_id", "full")


@query(f"WITH RECURSIVE {_FUSE}, {_CHOICE}, {_PICKS.format(k=5)} SELECT query_id, CAST(n AS INTEGER) AS rank, ch.c AS chunk_id, ch.s AS source, round(ch.f, 6) AS score FROM gr WHERE n > 0")
def rerank_topk(spark, d):
    """The retriever in hybrid mode: queries without a vector, or without words, are ranked by their other side."""
    return rounded(_retriever(spark, d, 5)("hybrid").retrieve(_asked(spark, d)).select("query_id", "rank", "chunk_id", "source", "score"))


_HIT = f"""WITH RECURSIVE {_FUSE}, {_CHOICE}, {_PICKS.format(k=10)}, rel AS (SELECT q.vec_id AS query_id, CAST(v.vec_id AS VARCHAR) AS chunk_id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
m AS (SELECT 'lexical_only' AS mode, query_id, chunk_id, rank FROM lr WHERE rank <= 50 UNION ALL SELECT 'vector_only', query_id, CAST(vec_id AS VARCHAR), rank FROM vr WHERE rank <= 50 UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM fr UNION ALL SELECT 'hybrid_rerank', query_id, ch.c, n FROM gr WHERE n > 0),
f AS (SELECT mode, query_id, min(rank) AS first FROM m JOIN rel USING (query_id, chunk_id) WHERE rank <= 10 GROUP BY ALL), a AS (SELECT mode, query_id FROM (SELECT DISTINCT mode FROM m), (SELECT DISTINCT query_id FROM rel))
SELECT mode, count(*) AS n_queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr_at_10 FROM a LEFT JOIN f USING (mode, query_id) GROUP BY mode"""


@query(_HIT)
def retrieval_hit_mrr(spark, d):
    items = R.table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("item"), "label")
    asked = items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "item", "label")
    return ranking.hit_and_mrr_by_label(retrieval.evaluated(_retriever(spark, d, 10), _asked(spark, d), "chunk_id"), asked, items.drop("vec_id"))


@query(ORACLE_SQL["vector_topk"])
def indexed_topk(spark, d):
    """The same from a stored index, all cells visited."""
    path = vector_index.scratch(spark)
    vector_index.write_index(R.table(spark, d, "embeddings"), path, cells=16)
    v = R.table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return rounded(vector_index.open_index(spark, path).search(asked, 10))


@query(f"WITH {R.SQL_CLAIMS} SELECT event_id, round(sr, 6) AS Support_Rate, round(cor, 6) AS Contradiction_Rate, round(nir, 6) AS Not_In_Scope_Rate FROM cr")
def claim_rates(spark, d):
    c = R.claims(spark, d)
    return rounded(c.select("event_id", *[v.alias(k) for k, v in S.claim_rates(F.col("sup"), F.col("con"), F.col("nis")).items()]))


@query(f"WITH {R.SQL_CLAIMS} SELECT event_id, likert FROM lk")
def likert_from_claims(spark, d):
    return R.claims(spark, d).select("event_id", S.likert(F.col("sup"), F.col("con"), F.col("nis")).alias("likert"))


@query("""WITH a AS (SELECT doc_id, list_transform(regexp_extract_all(text || ' #' || (doc_id % 5) || '; x # ' || (doc_id % 3), '#\\s*([0-3])\\b', 1), lambda x: CAST(x AS DOUBLE)) AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(list_avg(m), 6) AS confidence, CAST(len(m) > 0 AS INTEGER) AS found FROM a""")
def confidence_markers(spark, d):
    text = F.concat(F.col("text"), F.lit(" #"), (F.col("doc_id") % 5).cast("string"), F.lit("; x # "), (F.col("doc_id") % 3).cast("string"))
    m = R.table(spark, d, "documents").where("text is not null").select("doc_id", S.confidence_scores(text).alias("m"))
    return rounded(m.select("doc_id", S.array_mean(F.col("m")).alias("confidence"), (F.size("m") > 0).cast("int").alias("found")))


def _judge_text():
    full = F.concat(F.lit('{"score": '), (F.col("k") % 6).cast("string"), F.lit(', "coverage": 0.'), (F.col("k") % 10).cast("string"), F.lit(', "supported": '), (F.col("k") % 5).cast("string"), F.lit(', "contradicted": '), (F.col("k") % 3).cast("string"), F.lit(', "not_in_scope": 1, "trap_pass": '), F.when(F.col("k") % 2 == 0, "true").otherwise("false"), F.lit(', "begruendung": "x"}'))
    return F.when(F.col("k") % 7 == 0, F.regexp_replace(full, r'"\}$', "")).when(F.col("k") % 7 == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).otherwise(full)


@query("""WITH a AS (SELECT event_id, k, k % 7 = 0 AS broken FROM (SELECT event_id, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
SELECT event_id, CASE WHEN k % 6 <= 4 THEN CAST(k % 6 AS DOUBLE) END AS score, CASE WHEN broken AND k % 6 > 4 THEN NULL ELSE round((k % 10) / 10.0::DOUBLE, 6) END AS coverage, k % 5 AS supported, k % 3 AS contradicted, CAST(1 AS BIGINT) AS not_in_scope, CASE WHEN k % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS trap_pass FROM a""")
def judge_json_parse(spark, d):
    raw = R._events(spark, d).select("event_id", _judge_text().alias("raw")).withColumn("obj", S.judge_object(F.col("raw")))
    score, coverage = S.judge_score(F.col("raw"), F.col("obj"))
    counts = [S.claim_count(F.col("raw"), n, F.col("obj")).alias(n) for n in ("supported", "contradicted", "not_in_scope")]
    return rounded(raw.select("event_id", score.alias("score"), coverage.alias("coverage"), *counts, S.trap_pass(F.col("raw"), F.col("obj")).alias("trap_pass")))


@query("""SELECT doc_id, CAST(len(f) AS INTEGER) AS n_facts, sha256(array_to_string(f, chr(31))) AS facts FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\\r?\\n|;|\\|'), lambda x: regexp_replace(x, '^[ \\t-]+|[ \\t-]+$', '', 'g')), lambda x: x <> '') AS f FROM documents)""")
def atomic_facts(spark, d):
    f = R.table(spark, d, "documents").select("doc_id", S.atomic_facts(F.col("text")).alias("f"))
    return f.select("doc_id", F.size("f").alias("n_facts"), F.sha2(F.array_join("f", "\x1f"), 256).alias("facts"))


def _plan(spark, d):
    q = R.checkpoint(spark, d).select("question_id").distinct()
    models = spark.createDataFrame([("m0",), ("m1",)], "model string")
    return tasks.plan(q, models, spark.createDataFrame([(m,) for m in stats.METHODS], "method string"), 5)


@query(f"""WITH {R.SQL_CHECK}, pl AS (SELECT * FROM (SELECT DISTINCT question_id FROM ck), (SELECT unnest(['m0', 'm1']) AS model), (SELECT unnest(['Zero-Shot', 'Advanced-Prompt', 'RAG']) AS method), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS run_number))
SELECT question_id, model, method, run_number FROM pl ANTI JOIN (SELECT * FROM lt WHERE error = '') USING (question_id, model, method, run_number)""")
def plan_pending(spark, d):
    return tasks.pending(_plan(spark, d), R.checkpoint(spark, d)).select("question_id", "model", "method", "run_number")


@query(f"WITH {R.SQL_CHECK} SELECT * FROM lt")
def checkpoint_latest(spark, d):
    return tasks.latest(R.checkpoint(spark, d))


@query(f"""WITH {R.SQL_CHECK}, s AS (SELECT *, error = '' AS ok, sum(CASE WHEN error = '' THEN 1 ELSE 0 END) OVER (PARTITION BY model, method ORDER BY ord) AS i FROM ck) SELECT model, method, ord, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY model, method, i ORDER BY ord) AS BIGINT) AS streak FROM s""")
def failure_streaks(spark, d):
    return tasks.failure_streaks(R.checkpoint(spark, d), ["model", "method"], "ord").select("model", "method", "ord", "streak")


@query("""SELECT model, round(sum(tin * CASE model WHEN 'm0' THEN 1.5e-7 WHEN 'm1' THEN 2.5e-6 ELSE 0 END + tout * CASE model WHEN 'm0' THEN 6.0e-7 WHEN 'm1' THEN 1.0e-5 ELSE 0 END), 12) AS cost FROM (SELECT 'm' || (event_id % 3) AS model, CAST(floor(value) AS BIGINT) AS tin, event_id % 100 AS tout FROM events) GROUP BY model""")
def cost_by_model(spark, d):
    prices = spark.createDataFrame([("m0", 1.5e-7, 6.0e-7), ("m1", 2.5e-6, 1.0e-5)], "model string, input double, output double")
    e = R.table(spark, d, "events").select(F.concat(F.lit("m"), (F.col("event_id") % 3).cast("string")).alias("model"), F.floor("value").alias("tin"), (F.col("event_id") % 100).alias("tout"))
    rows = e.join(F.broadcast(prices), "model", "left")  # a row a model
    return rounded(rows.groupBy("model").agg(F.sum(tasks.cost(F.col("tin"), F.col("tout"), F.col("input"), F.col("output"))).alias("cost")))


# Price lists and asked models from suppliers and customers: ids with providers and suffixes, some of them shared or unknown.
_FETCHED_SQL = "SELECT s_suppkey AS ord, 'prov' || (s_suppkey % 7) || '/Model-' || (s_suppkey % 40) || CASE WHEN s_suppkey % 3 = 0 THEN ':free' ELSE '' END AS id, s_suppkey * 1e-7 AS input, s_suppkey * 2e-7 AS output FROM supplier WHERE s_suppkey % 2 = 0"
_DEFAULT_SQL = "SELECT s_suppkey AS ord, 'prov' || (s_suppkey % 5) || '/model-' || (s_suppkey % 60) AS id, s_suppkey * 3e-7 AS input, s_suppkey * 4e-7 AS output FROM supplier WHERE s_suppkey % 2 = 1"
_MODELS_SQL = "SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'prov' || (c_custkey % 7) || '/model-' || (c_custkey % 40) || ':free' WHEN 1 THEN 'MODEL-' || (c_custkey % 70) WHEN 2 THEN 'prov' || (c_custkey % 9) || '/Model-' || (c_custkey % 80) ELSE 'other/model-' || (c_custkey % 90) || ':beta' END AS model FROM customer"
_FORMS = "unnest([lower({0}), split_part(lower({0}), ':', 1), regexp_replace(split_part(lower({0}), ':', 1), '^[^/]*/', '')])"


@query(f"""WITH f AS ({_FETCHED_SQL}), g AS ({_DEFAULT_SQL}), a AS ({_MODELS_SQL}),
p AS (SELECT 0 AS base, ord, input, output, unnest([0, 1, 2]) AS pf, {_FORMS.format("id")} AS alias FROM f UNION ALL SELECT 3, ord, input, output, unnest([0, 1, 2]), {_FORMS.format("id")} FROM g),
u AS (SELECT base, input, output, alias, row_number() OVER (PARTITION BY base, alias ORDER BY ord, pf) AS r FROM p), m AS (SELECT model, unnest([0, 1, 2]) AS form, {_FORMS.format("model")} AS alias FROM a),
c AS (SELECT model, input, output, base + form AS choice, row_number() OVER (PARTITION BY model ORDER BY base + form) AS k FROM m JOIN (SELECT * FROM u WHERE r = 1) USING (alias))
SELECT model, CAST(coalesce(input, 0) AS DOUBLE) AS input, CAST(coalesce(output, 0) AS DOUBLE) AS output, CASE choice WHEN 0 THEN 'fetched' WHEN 1 THEN 'fetched_base' WHEN 2 THEN 'fetched_providerless' WHEN 3 THEN 'default' WHEN 4 THEN 'default_base' WHEN 5 THEN 'default_providerless' ELSE 'missing' END AS matched FROM a LEFT JOIN (SELECT * FROM c WHERE k = 1) USING (model)""")
def pricing_resolve(spark, d):
    s, key = R.table(spark, d, "supplier"), F.col("s_suppkey")
    text = lambda n: n.cast("string")
    price = lambda a, b: [(key * a).cast("double").alias("input"), (key * b).cast("double").alias("output")]
    fetched = s.where("s_suppkey % 2 = 0").select(key.alias("ord"), F.concat(F.lit("prov"), text(key % 7), F.lit("/Model-"), text(key % 40), F.when(key % 3 == 0, ":free").otherwise("")).alias("id"), *price(1e-7, 2e-7))
    default = s.where("s_suppkey % 2 = 1").select(key.alias("ord"), F.concat(F.lit("prov"), text(key % 5), F.lit("/model-"), text(key % 60)).alias("id"), *price(3e-7, 4e-7))
    c = F.col("c_custkey")
    model = (
        F.when(c % 4 == 0, F.concat(F.lit("prov"), text(c % 7), F.lit("/model-"), text(c % 40), F.lit(":free")))
        .when(c % 4 == 1, F.concat(F.lit("MODEL-"), text(c % 70)))
        .when(c % 4 == 2, F.concat(F.lit("prov"), text(c % 9), F.lit("/Model-"), text(c % 80)))
        .otherwise(F.concat(F.lit("other/model-"), text(c % 90), F.lit(":beta")))
    )
    found = tasks.resolve_prices(R.table(spark, d, "customer").select(model.alias("model")).distinct(), fetched, default)
    return found


@query(f"""WITH {R.SQL_EVAL}, n AS (SELECT event_id, Model, Method, ID, Run_ID, KI_Antwort FROM ev), c AS (SELECT DISTINCT Model, Method, ID, Run_ID, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE KI_Antwort END AS KI_Antwort FROM ev WHERE Likert_Score IS NOT NULL AND event_id % 2 = 0)
SELECT event_id, c.ID IS NOT NULL AS hit FROM n LEFT JOIN c USING (Model, Method, ID, Run_ID, KI_Antwort)""")
def eval_cache_hits(spark, d):
    e = R.evaluated(spark, d)
    cache = e.where("event_id % 2 = 0").withColumn("KI_Antwort", F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("KI_Antwort"))).withColumnRenamed("Likert_Score", "score")
    return tasks.cached(e, cache, ["Model", "Method", "ID", "Run_ID"], ["KI_Antwort"]).select("event_id", "hit")


def _tasks(spark, d):
    return stats.task_level(stats.prepare(R.evaluated(spark, d)))


@query(f"""WITH {R.SQL_TASKS} SELECT Model, Method, ID, round(trap, 6) AS Is_Trap_Question, round(score, 6) AS Task_Score, round(score_std, 6) AS Task_Run_Score_Std, round(cost, 12) AS Avg_Cost, round(secs, 6) AS Avg_Time, round(prec, 6) AS Atomic_Precision, round(hall, 6) AS Hallucination_Rate,
 round(tpass, 6) AS Trap_Pass_Rate, round(oc, 6) AS Task_Overconfidence_Score, round(prec_std, 6) AS Task_Run_Precision_Std, round(hall_std, 6) AS Task_Run_Hallucination_Std, round(score_std, 6) AS Task_Run_Coverage_Std, round(score, 6) AS Atomic_Coverage_Score, round(score, 6) AS Support_Rate, round(score, 6) AS Task_Binary_Score,
 round(contra, 6) AS Contradiction_Rate, round(scope, 6) AS Not_In_Scope_Rate, round(1 - tpass, 6) AS Trap_Hallucination_Rate, round(trap, 6) AS Trap_Question_Share, round(confm, 6) AS Task_Confidence_Mean, round(conff, 6) AS Task_Confidence_Found_Rate, round(cons, 6) AS Semantic_Consistency, round(gap, 6) AS Task_Confidence_Accuracy_Gap, fail AS Critical_Fail, n_rows FROM tk""")
def task_level(spark, d):
    return rounded(_tasks(spark, d).select("Model", "Method", "ID", "Is_Trap_Question", "Task_Score", "Task_Run_Score_Std", "Avg_Cost", "Avg_Time", "Atomic_Precision", "Hallucination_Rate", "Trap_Pass_Rate", "Task_Overconfidence_Score", "Task_Run_Precision_Std", "Task_Run_Hallucination_Std", "Task_Run_Coverage_Std", "Atomic_Coverage_Score", "Support_Rate", "Task_Binary_Score", "Contradiction_Rate", "Not_In_Scope_Rate", "Trap_Hallucination_Rate", "Trap_Question_Share", "Task_Confidence_Mean", "Task_Confidence_Found_Rate", "Semantic_Consistency", "Task_Confidence_Accuracy_Gap", "Critical_Fail", "n_rows"))


@query(f"WITH {R.SQL_TASKS} SELECT Model, Method, ID, round(cons, 6) AS Semantic_Consistency FROM tk")
def jaccard_consistency(spark, d):
    return rounded(stats.jaccard_consistency(stats.prepare(R.evaluated(spark, d)), ["Model", "Method", "ID"]))


@query(f"""WITH {R.SQL_TASKS}, o AS (SELECT Model, Method, count(DISTINCT ID) AS N, avg(score) AS m, stddev_samp(score) AS s, avg(score_std) AS rs, avg(cons) AS cons, avg(fail) AS f, avg(cost) AS c, avg(secs) AS t, avg(oc) AS oc, avg(score) AS cover, avg(prec) AS prec, avg(hall) AS hall, avg(contra) AS contra, avg(scope) AS scope, avg(prec_std) AS ps, avg(hall_std) AS hs, avg(confm) AS cm, stddev_samp(confm) AS cs, avg(gap) AS gap FROM nt GROUP BY ALL),
tr AS (SELECT Model, Method, avg(tpass) AS tp, count(DISTINCT ID) AS n_trap FROM tk WHERE coalesce(trap, 0) >= 0.5 GROUP BY ALL), al AS (SELECT Model, Method, count(DISTINCT ID) AS n_all FROM tk GROUP BY ALL)
SELECT Model, Method, N, round(m, 6) AS Mean_Score, round(s, 6) AS Score_Std, round(rs, 6) AS run_level_score_std, round(rs, 6) AS run_level_coverage_std, round(cons, 6) AS Consistency, round(f, 6) AS Critical_Fail_Rate, round(c, 12) AS Avg_Cost, round(t, 6) AS Avg_Time, round(oc, 6) AS Overconfidence,
 round(cover, 6) AS Atomic_Coverage_Score, round(cover, 6) AS Support_Rate, round(prec, 6) AS Atomic_Precision, round(hall, 6) AS Hallucination_Rate, round(contra, 6) AS Contradiction_Rate, round(scope, 6) AS Not_In_Scope_Rate,
 round(ps, 6) AS run_level_precision_std, round(hs, 6) AS run_level_hallucination_std, round(cm, 6) AS confidence_mean, round(cs, 6) AS confidence_std, round(gap, 6) AS confidence_accuracy_gap,
 round(tp, 6) AS Trap_Pass_Rate, round(1 - tp, 6) AS Trap_Hallucination_Rate, round(coalesce(n_trap * 1.0::DOUBLE / n_all, 0), 6) AS Trap_Question_Share, round(c + t * 0.002, 12) AS Total_Real_Cost FROM o LEFT JOIN tr USING (Model, Method) LEFT JOIN al USING (Model, Method)""")
def model_method_stats(spark, d):
    return rounded(stats.model_method_stats(_tasks(spark, d)))


@query(f"WITH {R.SQL_TASKS} SELECT Model, Method, count(*) FILTER (trap >= 0.5) AS n_trap, round(coalesce(avg(tpass) FILTER (trap >= 0.5), 0), 6) AS pass_rate, round(coalesce(avg(1 - tpass) FILTER (trap >= 0.5), 0), 6) AS fail_rate FROM tk GROUP BY Model, Method")
def trap_summary(spark, d):
    return rounded(stats.trap_summary(_tasks(spark, d)))


@query(f"WITH {R.SQL_EVAL} SELECT Model, Method, count(*) AS n, round(avg(conf), 6) AS mean_confidence, round(avg(Atomic_Coverage_Score), 6) AS mean_coverage, round(CASE WHEN isnan(corr(conf, Atomic_Coverage_Score)) THEN NULL ELSE corr(conf, Atomic_Coverage_Score) END, 6) AS corr, round(avg(CASE WHEN conf >= 2 / 3.0::DOUBLE - 1e-12 AND Atomic_Coverage_Score < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS overconfident_rate FROM pr WHERE Is_Trap_Question < 0.5 GROUP BY Model, Method")
def overconfidence(spark, d):
    return rounded(stats.overconfidence(stats.prepare(R.evaluated(spark, d))))


@query(f"""WITH {R.SQL_TASKS}, rn AS (SELECT Model, Method, ID, list_distinct(list(Run_ID)) AS r FROM pr WHERE Is_Trap_Question < 0.5 GROUP BY ALL) SELECT a.Model, la || ' vs ' || lb AS comparison, round(avg(len(list_intersect(a.r, b.r)) * 1.0::DOUBLE / greatest(len(a.r), len(b.r))), 6) AS coverage FROM rn a JOIN cmp ON a.Method = ma JOIN rn b ON b.Method = mb AND a.Model = b.Model AND a.ID = b.ID GROUP BY ALL""")
def run_pair_coverage(spark, d):
    return rounded(stats.run_pair_coverage(stats.prepare(R.evaluated(spark, d))))


@query(f"WITH {R.SQL_TASKS} SELECT Model, comparison, ID, round(a, 6) AS a, round(b, 6) AS b, round(diff, 6) AS diff FROM df")
def paired_deltas(spark, d):
    return rounded(stats.pairs(stats.non_trap(_tasks(spark, d))))


@query(f"""WITH {R.SQL_TASKS}, rk AS (SELECT *, rank() OVER (PARTITION BY Model, comparison, diff <> 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY Model, comparison, diff <> 0, abs(diff)) - 1) / 2.0::DOUBLE AS rank FROM df),
g AS (SELECT Model, comparison, count(*) AS n_pairs, count(*) FILTER (diff <> 0) AS n_nonzero, coalesce(sum(rank) FILTER (diff > 0), 0) AS wp, coalesce(sum(rank) FILTER (diff < 0), 0) AS wm, coalesce(sum(rank * rank) FILTER (diff <> 0), 0) AS sq FROM rk GROUP BY ALL)
SELECT Model, comparison, n_pairs, n_nonzero, round(wp, 6) AS w_plus, round(wm, 6) AS w_minus, round(least(wp, wm), 6) AS statistic, round(CASE WHEN n_nonzero = 0 THEN 0 ELSE (wp - (wp + wm) / 2) / sqrt(sq / 4) END, 6) AS z, round(CASE WHEN n_nonzero = 0 THEN 0 ELSE (wp - (wp + wm) / 2) / sqrt(sq / 4) / sqrt(n_nonzero) END, 6) AS r, round(CASE WHEN n_nonzero = 0 THEN 0 ELSE (wp - wm) / (wp + wm) END, 6) AS effect FROM g""")
def wilcoxon_stat(spark, d):
    return rounded(stats.signed_ranks(stats.pairs(stats.non_trap(_tasks(spark, d))), ["Model", "comparison"]).select("Model", "comparison", "n_pairs", "n_nonzero", "w_plus", "w_minus", "statistic", "z", "r", "effect"))


@query("""WITH p AS (SELECT event_id, event_id % 20 AS g, CASE WHEN event_id % 17 <> 0 THEN (event_id * 7919 % 9973) / 9973.0::DOUBLE END AS p FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY g, p IS NULL ORDER BY p, event_id) AS k, count(p) OVER (PARTITION BY g) AS m FROM p)
SELECT event_id, g, round(p, 6) AS p, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(m * 1.0::DOUBLE / k * p) OVER (PARTITION BY g, p IS NULL ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS q FROM k""")
def bh_adjust(spark, d):
    p = R.table(spark, d, "events").select("event_id", (F.col("event_id") % 20).alias("g"), F.when(F.col("event_id") % 17 != 0, (F.col("event_id") * 7919 % 9973) / 9973.0).alias("p"))
    return rounded(stats.benjamini_hochberg(p, ["g"]))


# The Shapiro-Wilk test in SQL: order statistics, Royston's weights and p.
_SCORE = lambda i, n: N.quantile_sql(f"(({i}) - 0.375) / ({n} + 0.25)")
_SHAPIRO = f"""so AS (SELECT *, row_number() OVER (PARTITION BY metric, Model, comparison ORDER BY diff) AS i, count(*) OVER (PARTITION BY metric, Model, comparison) AS n FROM md),
sm AS (SELECT *, {_SCORE("i", "n")} AS m FROM so),
sg AS (SELECT metric, Model, comparison, any_value(n) AS n, sum(m * diff) AS mx, sum(m * m) AS mm, var_pop(diff) * count(*) AS ss, max(diff) - min(diff) AS o, min(diff) AS first, max(diff) FILTER (i = n - 1) - max(diff) FILTER (i = 2) AS inn, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2 FROM sm GROUP BY ALL),
sa AS (SELECT *, {N.polynomial_sql(normality.LAST_WEIGHT, "1 / sqrt(n)")} + m1 / sqrt(mm) AS a1, {N.polynomial_sql(normality.NEXT_WEIGHT, "1 / sqrt(n)")} + m2 / sqrt(mm) AS a2 FROM sg WHERE n >= 3 AND o > 1e-8 + 1e-5 * abs(first)),
sl AS (SELECT *, least(1.0, pow(CASE WHEN n = 3 THEN sqrt(0.5) * o WHEN n <= 5 THEN a1 * o + (mx - m1 * o) / sqrt((mm - 2 * m1 * m1) / (1 - 2 * a1 * a1)) ELSE a1 * o + a2 * inn + (mx - m1 * o - m2 * inn) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END, 2) / ss) AS w FROM sa),
sw AS (SELECT *, ln(1 - w) AS y FROM sl), sz AS (SELECT *, CASE WHEN n > 11 THEN (y - {N.polynomial_sql(normality.LARGE_MEAN, "ln(n)")}) / exp({N.polynomial_sql(normality.LARGE_SPREAD, "ln(n)")}) WHEN y < 0.459 * n - 2.273 THEN (-ln(0.459 * n - 2.273 - y) - {N.polynomial_sql(normality.SMALL_MEAN, "n")}) / exp({N.polynomial_sql(normality.SMALL_SPREAD, "n")}) END AS sz FROM sw),
sh AS (SELECT metric, Model, comparison, CASE WHEN n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75)))) WHEN sz IS NULL THEN 0 ELSE {N.upper_tail_sql("sz")} END AS shapiro FROM sz)"""
_ORDERED = "list_position(['{0}'], {1})"
_EFFECTS = f"""WITH {R.SQL_TASKS}, ml AS (SELECT Model, Method, ID, unnest([struct_pack(metric := 'atomic_coverage_score', v := cover), struct_pack(metric := 'atomic_precision', v := prec), struct_pack(metric := 'hallucination_rate', v := -hall)], recursive := true) FROM (SELECT nt.*, score AS cover FROM nt)),
md AS (SELECT a.metric, a.Model, la || ' vs ' || lb AS comparison, la, lb, round(b.v - a.v, 12) AS diff FROM ml a JOIN cmp ON a.Method = ma JOIN ml b ON b.Method = mb AND b.Model = a.Model AND b.ID = a.ID AND b.metric = a.metric WHERE a.v IS NOT NULL AND b.v IS NOT NULL),
mr AS (SELECT *, rank() OVER (PARTITION BY metric, Model, comparison, diff <> 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY metric, Model, comparison, diff <> 0, abs(diff)) - 1) / 2.0::DOUBLE AS rank FROM md),
mg AS (SELECT metric, Model, comparison, any_value(la) AS la, any_value(lb) AS lb, count(*) AS n, count(*) FILTER (diff <> 0) AS nz, coalesce(sum(rank) FILTER (diff > 0), 0) AS wp, coalesce(sum(rank) FILTER (diff < 0), 0) AS wm, coalesce(sum(rank * rank) FILTER (diff <> 0), 0) AS sq, avg(diff) AS mean, max(abs(diff)) AS most FROM mr GROUP BY ALL),
mz AS (SELECT *, CASE WHEN nz = 0 THEN 0.0 ELSE (wp - (wp + wm) / 2) / sqrt(sq / 4) END AS z FROM mg), me AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN nz = 0 THEN 0.0 ELSE z / sqrt(nz) END AS r FROM mz), {_SHAPIRO}
SELECT Model AS model, metric, comparison, n AS n_pairs, CASE WHEN n >= 2 THEN round_even(least(wp, wm), 4) END AS wilcoxon_statistic, round_even(r, 4) AS effect_size_r, CASE WHEN r IS NULL THEN 'unknown' WHEN abs(r) < 0.3 THEN 'klein' WHEN abs(r) < 0.5 THEN 'mittel' ELSE 'gross' END AS effect_size_label,
 CASE WHEN most <= 1e-8 THEN 'tie' WHEN mean > 0 THEN 'favours_' || lb ELSE 'favours_' || la END AS direction, round_even(shapiro, 4) AS shapiro_p_value FROM me LEFT JOIN sh USING (metric, Model, comparison)"""


@query(_EFFECTS)
def main_test_effects(spark, d):
    return exports.main_tests(stats.test_effects(_tasks(spark, d)).drop("p"))


_AGAINST = f"""bs AS (SELECT a.Model, b.Method, round(b.score - a.score, 12) AS diff FROM nt a JOIN nt b ON a.Method = 'Zero-Shot' AND b.Method <> 'Zero-Shot' AND a.Model = b.Model AND a.ID = b.ID),
br AS (SELECT *, rank() OVER (PARTITION BY Model, Method, diff <> 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY Model, Method, diff <> 0, abs(diff)) - 1) / 2.0::DOUBLE AS rank FROM bs),
bg AS (SELECT Model, Method, count(*) AS paired, coalesce(sum(rank) FILTER (diff > 0), 0) AS wp, coalesce(sum(rank) FILTER (diff < 0), 0) AS wm FROM br GROUP BY ALL),
be AS (SELECT Model, Method, paired, CASE WHEN wp + wm = 0 THEN 0.0 ELSE (wp - wm) / (wp + wm) END AS eff FROM bg),
rn AS (SELECT Model, Method, ID, list_distinct(list(Run_ID)) AS r FROM pr WHERE Is_Trap_Question < 0.5 GROUP BY ALL), rc AS (SELECT a.Model, b.Method, avg(len(list_intersect(a.r, b.r)) * 1.0::DOUBLE / greatest(len(a.r), len(b.r))) AS coverage FROM rn a JOIN rn b ON a.Method = 'Zero-Shot' AND b.Method <> 'Zero-Shot' AND a.Model = b.Model AND a.ID = b.ID GROUP BY ALL)"""
_STATS_NAMES = {"Std_Dev": "Score_Std", "Semantic_Consistency": "Consistency", "Critical_Fail": "Critical_Fail_Rate", "overconfidence_score": "Overconfidence", "comparison_method": "Method"}
_STATS_OWN = {
    "baseline_method": "'Zero-Shot'", "test_name": "CASE WHEN Method = 'Zero-Shot' THEN 'baseline_reference' ELSE 'wilcoxon_signed_rank' END", "paired_n": "CASE WHEN Method = 'Zero-Shot' THEN N ELSE coalesce(paired, 0) END",
    "effect_size": "round(CASE WHEN Method = 'Zero-Shot' THEN 0 ELSE eff END, 6)", "run_level_pair_coverage": "round(CASE WHEN Method = 'Zero-Shot' THEN 1 ELSE coverage END, 6)",
    "effect_size_interpretation": "CASE WHEN Method = 'Zero-Shot' OR abs(eff) < 0.1 THEN 'negligible' WHEN eff IS NULL THEN 'unknown' WHEN abs(eff) < 0.3 THEN 'small' WHEN abs(eff) < 0.5 THEN 'medium' ELSE 'large' END",
}
_TESTED = ("p_value", "q_value", "ci95_low", "ci95_high")


def _stats_sql() -> str:
    means = ORACLE_SQL["model_method_stats"].removeprefix("WITH ")
    at = means.rindex("SELECT Model, Method, N,")
    value = lambda c: f"'{exports.STATS_CONSTANTS[c]}'" if c in exports.STATS_CONSTANTS else _STATS_OWN.get(c, _STATS_NAMES.get(c, c))
    columns = ", ".join(f"{value(c)} AS {c}" for c in exports.STATS_COLUMNS if c not in _TESTED)
    return f"WITH {means[:at].rstrip()}, {_AGAINST}, ms AS ({means[at:]}) SELECT {columns} FROM ms LEFT JOIN be USING (Model, Method) LEFT JOIN rc USING (Model, Method)"


def _stats(spark, d, interval=True):
    prepared = stats.prepare(R.evaluated(spark, d))
    return exports.stats_table(stats.stats_table(stats.task_level(prepared), prepared, interval=interval))


@query(_stats_sql())
def stats_table_effects(spark, d):
    return rounded(_stats(spark, d, interval=False).drop(*_TESTED))


@query()
def stats_table(spark, d):
    return rounded(_stats(spark, d))


_TT_DELTAS = "td AS (SELECT lb || ' - ' || la AS comparison, coalesce(task_type, 'Unklar/sonstige') AS task_type, Model, ID, diff FROM df LEFT JOIN mt USING (ID) WHERE ma = 'Zero-Shot')"
_TT_ALL = _TT_DELTAS.replace(" WHERE ma = 'Zero-Shot'", "")


@query(f"""WITH {R.SQL_TASKS}, {_TT_DELTAS},
tr AS (SELECT *, rank() OVER (PARTITION BY comparison, task_type, diff <> 0 ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY comparison, task_type, diff <> 0, abs(diff)) - 1) / 2.0::DOUBLE AS rank FROM td),
tg AS (SELECT comparison, task_type, count(*) AS n, median(diff) AS med, count(*) FILTER (diff <> 0) AS nz, coalesce(sum(rank) FILTER (diff > 0), 0) AS wp, coalesce(sum(rank) FILTER (diff < 0), 0) AS wm, coalesce(sum(rank * rank) FILTER (diff <> 0), 0) AS sq FROM tr GROUP BY ALL),
tz AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN nz = 0 THEN 0 ELSE (wp - (wp + wm) / 2) / sqrt(sq / 4) / sqrt(nz) END AS r FROM tg)
SELECT task_type, comparison, n AS n_pairs, round_even(med, 4) AS median_delta, CASE WHEN n >= 2 THEN round_even(least(wp, wm), 4) END AS wilcoxon_statistic, round_even(r, 4) AS effect_size_r, CASE WHEN r IS NULL THEN 'unknown' WHEN abs(r) < 0.3 THEN 'klein' WHEN abs(r) < 0.5 THEN 'mittel' ELSE 'gross' END AS effect_size_label FROM tz""")
def tasktype_effects(spark, d):
    return reports.tasktype_tests(_deltas(spark, d)).drop("p_value_raw")


@query()
def tasktype_tests(spark, d):
    return reports.tasktype_tests(_deltas(spark, d))


@query()
def main_tests(spark, d):
    return exports.main_tests(stats.main_tests(_tasks(spark, d)))


@query()
def bootstrap_ci(spark, d):
    return rounded(stats.bootstrap_ci(stats.non_trap(_tasks(spark, d))))


@query()
def robustness(spark, d):
    return exports.robustness(stats.robustness(stats.prepare(R.evaluated(spark, d))))


_METHOD_LABEL = "CASE Method WHEN 'Advanced-Prompt' THEN 'Advanced Prompting' ELSE Method END"


@query(f"WITH {R.SQL_TASKS} SELECT Model AS model, {_METHOD_LABEL} AS method, count(*) FILTER (trap >= 0.5) AS n_trap_questions, round_even(coalesce(avg(tpass) FILTER (trap >= 0.5), 0), 4) AS correct_refusal_rate, round_even(coalesce(avg(1 - tpass) FILTER (trap >= 0.5), 0), 4) AS hallucinated_answer_rate FROM tk GROUP BY Model, Method")
def export_trap_summary(spark, d):
    return exports.trap_summary(_tasks(spark, d))


@query(f"WITH {R.SQL_EVAL} SELECT Model AS model, {_METHOD_LABEL} AS method, count(*) AS n_observations, round_even(avg(conf), 4) AS mean_confidence_score, round_even(avg(Atomic_Coverage_Score), 4) AS mean_atomic_coverage_score, round_even(CASE WHEN isnan(corr(conf, Atomic_Coverage_Score)) THEN NULL ELSE corr(conf, Atomic_Coverage_Score) END, 4) AS confidence_accuracy_correlation, round_even(avg(CASE WHEN conf >= 2 / 3.0::DOUBLE - 1e-12 AND Atomic_Coverage_Score < 0.5 THEN 1.0 ELSE 0.0 END), 4) AS overconfident_error_rate FROM pr WHERE Is_Trap_Question < 0.5 GROUP BY Model, Method")
def export_overconfidence(spark, d):
    return exports.overconfidence(stats.prepare(R.evaluated(spark, d)))


_POOLED = _SHAPIRO.replace("metric, Model, comparison", "comparison").replace("FROM md", "FROM df")


@query(f"WITH {R.SQL_TASKS}, {_POOLED} SELECT comparison, Model AS model, ID AS id, round(a, 6) AS value_a, round(b, 6) AS value_b, round(diff, 6) AS oriented_difference, round(shapiro, 6) AS shapiro_p_value FROM df LEFT JOIN sh USING (comparison)")
def normality_frame(spark, d):
    return rounded(reports.normality_frame(_tasks(spark, d)))


def _deltas(spark, d, comparisons=reports.TASKTYPE_COMPARISONS):
    return reports.tasktype_deltas(_tasks(spark, d), R.meta(spark, d), comparisons=comparisons)


@query(f"WITH {R.SQL_TASKS}, {_TT_ALL} SELECT comparison, task_type, count(*) AS n_pairs, round(median(diff), 6) AS median_delta FROM td GROUP BY ALL")
def tasktype_delta_summary(spark, d):
    """All pairs of methods."""
    return rounded(reports.tasktype_summary(_deltas(spark, d, stats.COMPARISONS)))


@query(f"WITH {R.SQL_TASKS}, {_TT_ALL} SELECT comparison, " + ", ".join(f"round(median(diff) FILTER (task_type = '{t}'), 6) AS \"{t}\"" for t in reports.TASK_TYPES) + " FROM td GROUP BY comparison")
def tasktype_heatmap(spark, d):
    """All pairs of methods."""
    return rounded(reports.tasktype_heatmap(_deltas(spark, d, stats.COMPARISONS)))


@query(f"WITH {R.SQL_TASKS}, e AS (SELECT comparison, least(-1.0, min(diff) - 0.05) AS lo, greatest(1.0, max(diff) + 0.05) AS hi FROM df GROUP BY ALL) SELECT comparison, CAST(least(8, floor((diff - lo) / (hi - lo) * 8) + 1) AS INTEGER) AS bin, count(*) AS n FROM df JOIN e USING (comparison) GROUP BY ALL")
def delta_histogram(spark, d):
    return reports.histogram(stats.pairs(stats.non_trap(_tasks(spark, d))), ["comparison"])


@query(f"WITH {R.SQL_TASKS} SELECT Model, Method, round(avg(prec), 6) AS Atomic_Precision, round(avg(hall), 6) AS Hallucination_Rate, round(avg(contra), 6) AS Contradiction_Rate, round(avg(scope), 6) AS Not_In_Scope_Rate FROM nt GROUP BY ALL")
def precision_risk(spark, d):
    return rounded(reports.precision_risk(_tasks(spark, d)))


@query(f"""WITH {R.SQL_TASKS}, l AS (SELECT Model, Method, 'Atomic_Coverage_Score' AS metric, score_std AS s FROM nt UNION ALL SELECT Model, Method, 'Atomic_Precision', prec_std FROM nt UNION ALL SELECT Model, Method, 'Hallucination_Rate', hall_std FROM nt) SELECT Model, Method, metric, round(avg(s), 6) AS mean_std, round(median(s), 6) AS median_std, count(*) AS n_tasks FROM l WHERE s IS NOT NULL GROUP BY ALL""")
def run_variance(spark, d):
    return rounded(reports.run_variance(_tasks(spark, d)))


_META = "me AS (SELECT ev.*, coalesce(category, 'Unbekannt') AS category, coalesce(difficulty, 'Unbekannt') AS difficulty FROM ev LEFT JOIN mt USING (ID))"


@query(f"WITH {R.SQL_TASKS}, {_META} SELECT category, Model, Method, round(avg(Atomic_Coverage_Score), 6) AS Atomic_Coverage_Score, round(avg(1 - Trap_Pass), 6) AS Trap_Fallibility FROM me GROUP BY ALL")
def category_means(spark, d):
    return rounded(reports.means_by(reports.with_meta(R.evaluated(spark, d), R.meta(spark, d)), ["category", "Model", "Method"], ["Atomic_Coverage_Score", "Trap_Fallibility"]))


@query(f"WITH {R.SQL_TASKS}, {_META} SELECT difficulty, Method, round(avg(Atomic_Coverage_Score), 6) AS Atomic_Coverage_Score FROM me GROUP BY ALL")
def difficulty_means(spark, d):
    return rounded(reports.means_by(reports.with_meta(R.evaluated(spark, d), R.meta(spark, d)), ["difficulty", "Method"], ["Atomic_Coverage_Score"]))


@query(f"WITH {R.SQL_TASKS} SELECT Model, Method, round(avg(Cost_USD), 12) AS Cost_USD FROM ev GROUP BY ALL")
def cost_means(spark, d):
    return rounded(reports.means_by(R.evaluated(spark, d), ["Model", "Method"], ["Cost_USD"]))


@query(f"""WITH {R.SQL_EVAL}, a AS (SELECT count(*) AS actual, count(*) FILTER (error <> '') AS error_rows, count(*) FILTER (Likert_Score IS NULL) AS unscored_rows FROM ev), x AS (SELECT count(DISTINCT ID) * 30 AS expected FROM ev)
SELECT actual, error_rows, unscored_rows, expected, greatest(expected - actual, 0) AS missing, CASE WHEN expected - actual <= 0 AND error_rows = 0 AND unscored_rows = 0 THEN 'ok' ELSE 'issues' END AS status FROM a, x""")
def data_quality(spark, d):
    e = R.evaluated(spark, d)
    return reports.data_quality(e, e.select("ID").distinct().count() * 2 * 3 * 5)


@query("""SELECT o_orderkey, CASE WHEN l_orderkey IS NOT NULL THEN 'patched' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN l_orderkey IS NOT NULL THEN v ELSE o_totalprice END, 6) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_orderkey % 7 = 0 GROUP BY l_orderkey) ON o_orderkey = l_orderkey""")
def patch_merge(spark, d):
    base = R.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    patch = R.table(spark, d, "lineitem").where("l_orderkey % 7 = 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.lit("patched").alias("o_orderstatus"), F.sum(F.col("l_extendedprice").cast("double")).alias("o_totalprice"))
    return rounded(tasks.upsert(base, patch, ["o_orderkey"]))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size FROM documents")
def corpus_fingerprint(spark, d):
    t = F.coalesce("text", F.lit(""))
    return R.table(spark, d, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), F.octet_length(t).cast("long").alias("size"))


def _usage(spark, d):
    return R.evaluated(spark, d).withColumns({"judge_input_tokens": F.col("event_id") % 500, "judge_output_tokens": F.col("event_id") % 90, "judge_cost_usd": (F.col("event_id") % 500) * 1e-6})


@query(f"""WITH {R.SQL_EVAL} SELECT count(*) AS rows, CAST(sum(event_id % 500) AS BIGINT) AS judge_input_tokens_total, CAST(sum(event_id % 90) AS BIGINT) AS judge_output_tokens_total, round(sum((event_id % 500) * 1e-6), 6) AS judge_cost_usd_total, round(avg(event_id % 500), 3) AS judge_input_tokens_avg, round(avg(event_id % 90), 3) AS judge_output_tokens_avg,
 round(avg(Support_Rate), 6) AS support_rate_avg, round(avg(Atomic_Precision), 6) AS atomic_precision_avg, round(avg(Hallucination_Rate), 6) AS hallucination_rate_avg, CAST(sum(Is_Trap_Question) AS BIGINT) AS trap_questions FROM ev""")
def judge_usage(spark, d):
    return judging.usage(_usage(spark, d))


@query(f"WITH {R.SQL_EVAL} SELECT CAST(event_id AS VARCHAR) AS event_id, Model, error FROM ev WHERE error <> '' ORDER BY ev.event_id LIMIT 8")
def error_samples(spark, d):
    return judging.error_samples(R.evaluated(spark, d), "event_id", ["event_id", "Model", "error"])


@query(f"WITH {R.SQL_TASKS}, {_META} SELECT category, Method, round(avg(Atomic_Coverage_Score), 6) AS Atomic_Coverage_Score FROM me WHERE category IN (SELECT DISTINCT category FROM me ORDER BY category LIMIT 6) GROUP BY ALL")
def top_categories(spark, d):
    return rounded(reports.means_by(judging.top_groups(reports.with_meta(R.evaluated(spark, d), R.meta(spark, d)), "category"), ["category", "Method"], ["Atomic_Coverage_Score"]))


_MEDIANS = "CASE WHEN i = n THEN pow(0.5, 1.0 / n) WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END"


@query(f"""WITH {R.SQL_TASKS}, q AS (SELECT comparison, diff, row_number() OVER (PARTITION BY comparison ORDER BY diff) AS i, count(*) OVER (PARTITION BY comparison) AS n FROM df), qm AS (SELECT *, {_MEDIANS} AS med FROM q), qt AS (SELECT *, {N.quantile_sql("med")} AS t FROM qm)
SELECT comparison, CAST(i AS INTEGER) AS i, round(t, 6) AS theoretical, round(diff, 6) AS value, round(regr_slope(diff, t) OVER (PARTITION BY comparison), 6) AS slope, round(regr_intercept(diff, t) OVER (PARTITION BY comparison), 6) AS intercept FROM qt""")
def qq_points(spark, d):
    return rounded(normality.qq_points(stats.pairs(stats.non_trap(_tasks(spark, d))), ["comparison"], "diff"))


@query(f"""WITH {R.SQL_TASKS}, {_TT_DELTAS}, bq AS (SELECT comparison, task_type, count(*) AS n, quantile_cont(diff, 0.25) AS q1, quantile_cont(diff, 0.5) AS median, quantile_cont(diff, 0.75) AS q3 FROM td GROUP BY ALL)
SELECT comparison, task_type, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3, round(min(diff) FILTER (diff >= q1 - 1.5 * (q3 - q1)), 6) AS low, round(max(diff) FILTER (diff <= q3 + 1.5 * (q3 - q1)), 6) AS high FROM td JOIN bq USING (comparison, task_type) GROUP BY comparison, task_type""")
def tasktype_boxes(spark, d):
    return rounded(normality.boxes(_deltas(spark, d), ["comparison", "task_type"], "diff"))


@query("SELECT a.label, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS consistency FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label")
def embedding_consistency(spark, d):
    return rounded(judging.group_consistency(R.table(spark, d, "embeddings"), "label", "embedding"))


@query("SELECT l.quality, l.toxic, count(*) AS n, count(*) FILTER (d.doc_id IS NULL) AS unknown FROM labels l LEFT JOIN documents d USING (doc_id) GROUP BY ALL")
def label_counts(spark, d):
    labels, docs = R.table(spark, d, "labels"), R.table(spark, d, "documents").select("doc_id", F.lit(1).alias("there"))
    return labels.join(docs, "doc_id", "left").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if(F.col("there").isNull()).alias("unknown"))


@query("SELECT conv_id, round(avg(j), 6) AS consistency FROM (SELECT a.conv_id, len(list_intersect(a.w, b.w)) * 1.0::DOUBLE / greatest(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 1) AS j FROM (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND text NOT LIKE '%API ERROR%') a JOIN (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM conversations WHERE role = 'assistant' AND trim(text) <> '' AND text NOT LIKE '%API ERROR%') b ON a.conv_id = b.conv_id AND a.turn < b.turn) GROUP BY conv_id")
def answer_consistency(spark, d):
    own = R.table(spark, d, "conversations").where("role = 'assistant' and trim(text) <> '' and not text like '%API ERROR%'")
    many = own.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    out = stats.jaccard_consistency(own.join(many, "conv_id", "left_semi"), ["conv_id"], "text")
    return rounded(out.withColumnRenamed("Semantic_Consistency", "consistency"))
