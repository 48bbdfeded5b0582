"""The engine's frames, made from the test tables by integer arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import stats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer parts than there are cores is dealt over all of them; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, text); source names hold a class marker by doc_id."""
    prefix = F.element_at(F.array(*map(F.lit, ["gesetz_", "din_", "blog_", "handbuch_"])), (F.col("doc_id") % 4 + 1).cast("int"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.concat(prefix, F.col("source"), F.lit("_"), F.col("doc_id").cast("string")).alias("source"), "text")


def headed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``corpus`` with headings of all kinds, indented page markers and several kinds of line ends."""
    kind = F.col("doc_id") % 3
    first = F.when(kind == 0, "Absatz:\r\n").when(kind == 1, "2.1 Teil\r").otherwise("\t--- PDF SEITE 3 ---\n12\nZahl\n")
    between = F.concat(F.lit("\n\t§ "), (F.col("doc_id") % 9).cast("string"), F.lit("a\n"))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), between)
    return corpus(spark, sf_dir).withColumn("text", F.concat(F.lit("# Kopf \n"), first, text))


def whole_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks."""
    return corpus(spark, sf_dir).select(F.col("doc_id").cast("string").alias("chunk_id"), "source", F.col("doc_id").alias("ord"), F.col("text").alias("chunk"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events"))
    return e.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).try_cast("bigint"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", (F.floor("value") % 5).alias("sup"), (F.col("k") % 3).alias("con"), (F.col("k") % 2).alias("nis"))


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated results: an event is one run of one question by one model and method."""
    e = _events(spark, sf_dir)
    sup, con, nis = F.floor("value") % 5, F.col("k") % 3, F.col("k") % 2
    rates = S.claim_rates(sup, con, nis)
    prec = S.precision(sup, sup + con)
    trap = F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(0.0)
    passed = F.when(F.col("user_id") % 10 == 0, (F.col("k") % 2).cast("double"))
    method = F.element_at(F.array(*map(F.lit, stats.METHODS)), (F.floor(F.col("event_id") / 2) % 3 + 1).cast("int"))
    return e.select(
        "event_id", F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("Model"), method.alias("Method"), F.col("user_id").cast("string").alias("ID"), (F.floor(F.col("event_id") / 6) % 5 + 1).alias("Run_ID"),
        S.likert(sup, con, nis).alias("Likert_Score"), F.concat_ws(" ", F.col("event_type"), (F.floor("value") % 7).cast("string"), (F.col("k") % 5).cast("string")).alias("KI_Antwort"),
        (F.col("value") / 1e6).alias("Cost_USD"), (F.col("event_id") % 97 / 10.0).cast("double").alias("Dauer_sek"), rates["Support_Rate"].alias("Atomic_Coverage_Score"), rates["Support_Rate"].alias("Support_Rate"),
        prec.alias("Atomic_Precision"), (1 - prec).alias("Hallucination_Rate"), rates["Contradiction_Rate"].alias("Contradiction_Rate"), rates["Not_In_Scope_Rate"].alias("Not_In_Scope_Rate"),
        passed.alias("Trap_Pass"), (1 - passed).alias("Trap_Hallucination"), (1 - passed).alias("Trap_Fallibility"), trap.alias("Is_Trap_Question"), (F.col("k") % 4).cast("double").alias("Confidence_Mean"), F.lit(1).alias("Confidence_Found_Flag"),
        F.when(F.col("event_id") % 11 == 0, "api down").otherwise("").alias("error"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ID, task_type, category, difficulty) of the questions; every thirteenth has none."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 13 <> 0")
    raw = F.element_at(F.array(*map(F.lit, ["Wissensfrage", "analytisch", "Kalkulation", "sonst"])), (F.col("user_id") % 4 + 1).cast("int"))
    return u.select(F.col("user_id").cast("string").alias("ID"), S.task_type(raw).alias("task_type"), F.concat(F.lit("K"), (F.col("user_id") % 7).cast("string")).alias("category"), F.concat(F.lit("D"), (F.col("user_id") % 3).cast("string")).alias("difficulty"))


def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint rows of evaluation tasks, from events; some failed, many tasks were tried more than once."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"), F.col("user_id").cast("string").alias("question_id"), F.element_at(F.array(*map(F.lit, stats.METHODS)), (F.floor(F.col("event_id") / 2) % 3 + 1).cast("int")).alias("method"), (F.floor(F.col("event_id") / 6) % 5 + 1).cast("int").alias("run_number"), F.when(F.floor("value") % 4 == 0, "api down").otherwise("").alias("error"), F.col("event_id").alias("ord"))


# The same frames in SQL.
SQL_HEADED = """'# Kopf ' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Absatz:' || chr(13) || chr(10) WHEN 1 THEN '2.1 Teil' || chr(13) ELSE chr(9) || '--- PDF SEITE 3 ---' || chr(10) || '12' || chr(10) || 'Zahl' || chr(10) END
 || replace(coalesce(text, ''), chr(10), chr(10) || chr(9) || '§ ' || (doc_id % 9) || 'a' || chr(10))"""
SQL_CHECK = """ck AS (SELECT 'm' || (event_id % 2) AS model, CAST(user_id AS VARCHAR) AS question_id, CASE (event_id // 2) % 3 WHEN 0 THEN 'Zero-Shot' WHEN 1 THEN 'Advanced-Prompt' ELSE 'RAG' END AS method,
 CAST((event_id // 6) % 5 + 1 AS INTEGER) AS run_number, CASE WHEN CAST(floor(value) AS BIGINT) % 4 = 0 THEN 'api down' ELSE '' END AS error, event_id AS ord FROM events),
lt AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, method, run_number ORDER BY CASE WHEN error = '' THEN 0 ELSE 1 END, ord DESC) AS r FROM ck) WHERE r = 1)"""
SQL_CLAIMS = """cl AS (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS sup, k % 3 AS con, k % 2 AS nis FROM (SELECT *, TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)),
cr AS (SELECT *, sup + con + nis AS tot, sup * 1.0::DOUBLE / greatest(sup + con + nis, 1) AS sr, con * 1.0::DOUBLE / greatest(sup + con + nis, 1) AS cor, nis * 1.0::DOUBLE / greatest(sup + con + nis, 1) AS nir FROM cl),
lk AS (SELECT *, CASE WHEN tot <= 0 THEN NULL WHEN sup >= tot AND con = 0 THEN 4.0 WHEN sr >= 0.75 AND con = 0 THEN 3.0 WHEN sr >= 0.5 THEN 2.0 WHEN sup > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS likert FROM cr)"""
SQL_EVAL = SQL_CLAIMS + """,
ev AS (SELECT event_id, 'm' || (event_id % 2) AS Model, CASE (event_id // 2) % 3 WHEN 0 THEN 'Zero-Shot' WHEN 1 THEN 'Advanced-Prompt' ELSE 'RAG' END AS Method, CAST(user_id AS VARCHAR) AS ID, (event_id // 6) % 5 + 1 AS Run_ID,
 likert AS Likert_Score, concat_ws(' ', event_type, CAST(CAST(floor(value) AS BIGINT) % 7 AS VARCHAR), CAST(k % 5 AS VARCHAR)) AS KI_Antwort, value / 1e6 AS Cost_USD, (event_id % 97) / 10.0::DOUBLE AS Dauer_sek, sr AS Atomic_Coverage_Score, sr AS Support_Rate,
 CASE WHEN sup + con > 0 THEN sup * 1.0::DOUBLE / (sup + con) END AS Atomic_Precision, 1 - CASE WHEN sup + con > 0 THEN sup * 1.0::DOUBLE / (sup + con) END AS Hallucination_Rate, cor AS Contradiction_Rate, nir AS Not_In_Scope_Rate,
 CASE WHEN user_id % 10 = 0 THEN CAST(k % 2 AS DOUBLE) END AS Trap_Pass, CASE WHEN user_id % 10 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS Is_Trap_Question, CAST(k % 4 AS DOUBLE) AS Confidence_Mean,
 CASE WHEN event_id % 11 = 0 THEN 'api down' ELSE '' END AS error FROM lk),
pr AS (SELECT *, 1 - Confidence_Mean / 3.0::DOUBLE AS conf, (1 - Confidence_Mean / 3.0::DOUBLE) * (1 - Support_Rate) AS oc, (1 - Confidence_Mean / 3.0::DOUBLE) - Support_Rate AS gap FROM ev WHERE Likert_Score IS NOT NULL)"""
SQL_CONSISTENCY = """wd AS (SELECT Model, Method, ID, event_id, list_distinct(string_split(lower(trim(KI_Antwort)), ' ')) AS w FROM pr WHERE trim(KI_Antwort) NOT IN ('', 'nan')),
jc AS (SELECT a.Model, a.Method, a.ID, avg(len(list_intersect(a.w, b.w)) * 1.0::DOUBLE / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))) AS j FROM wd a JOIN wd b ON a.Model = b.Model AND a.Method = b.Method AND a.ID = b.ID AND a.event_id < b.event_id GROUP BY ALL)"""
SQL_TASKS = SQL_EVAL + ", " + SQL_CONSISTENCY + """,
tk AS (SELECT p.Model, p.Method, p.ID, avg(Is_Trap_Question) AS trap, avg(Support_Rate) AS score, stddev_samp(Support_Rate) AS score_std, stddev_samp(Atomic_Precision) AS prec_std, stddev_samp(Hallucination_Rate) AS hall_std,
 CASE WHEN round(avg(Support_Rate), 12) < 0.5 THEN 1 ELSE 0 END AS fail, avg(Cost_USD) AS cost, avg(Dauer_sek) AS secs, avg(Atomic_Precision) AS prec, avg(Hallucination_Rate) AS hall, avg(Contradiction_Rate) AS contra, avg(Not_In_Scope_Rate) AS scope,
 avg(Trap_Pass) AS tpass, avg(Trap_Pass) AS tpass_all, avg(Confidence_Mean) AS confm, avg(1.0::DOUBLE) AS conff, avg(oc) AS oc, avg(gap) AS gap, count(*) AS n_rows, coalesce(max(jc.j), 0.0) AS cons FROM pr p LEFT JOIN jc ON p.Model = jc.Model AND p.Method = jc.Method AND p.ID = jc.ID GROUP BY p.Model, p.Method, p.ID),
nt AS (SELECT * FROM tk WHERE coalesce(trap, 0) < 0.5),
cmp AS (SELECT * FROM (VALUES ('Zero-Shot', 'Advanced-Prompt', 'Zero-Shot', 'Advanced Prompting'), ('Zero-Shot', 'RAG', 'Zero-Shot', 'RAG'), ('Advanced-Prompt', 'RAG', 'Advanced Prompting', 'RAG')) AS t(ma, mb, la, lb)),
df AS (SELECT a.Model, la || ' vs ' || lb AS comparison, ma, la, lb, a.ID, a.score AS a, b.score AS b, round(b.score - a.score, 12) AS diff FROM nt a JOIN cmp ON a.Method = ma JOIN nt b ON b.Method = mb AND b.Model = a.Model AND b.ID = a.ID),
mt AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS ID, CASE user_id % 4 WHEN 0 THEN 'Wissensbasiert' WHEN 1 THEN 'Analytisch / Reasoning' WHEN 2 THEN 'Rechen-/deterministisch' ELSE 'Unklar/sonstige' END AS task_type, 'K' || (user_id % 7) AS category, 'D' || (user_id % 3) AS difficulty FROM events WHERE user_id % 13 <> 0)"""
