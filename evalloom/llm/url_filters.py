"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated changes: an entry (list, rule) is added or removed on a date. The changes of an
entry become validity intervals [from, to); equal neighbours merge. A capture is evaluated against the
entries active at its fetch time: its URL gives the rules that could match it (its host, each parent
domain, and each leading path of its host and parents), and an as-of join finds those whose interval holds
the fetch time. Intervals and captures meet in slices of time and parts of a host's captures, so one host's captures are
dealt over many tasks and no list is collected.

Defined results: a URL that is null, empty or without a host matches nothing; captures without a time
match nothing; changes without a list, rule or date are ignored; of changes of an entry on one date,
removal comes last; repeated captures give repeated rows; extra columns pass through, save ``lists``,
``rules`` and ``blocked``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Days of a slice of time, and parts over which the captures of a rule in it are spread.
SLICE_DAYS, PARTS = 64, 8


def host(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r"\.?(?::\d*)?$", "")


def path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")


def url_rules(url: Column, labels_most: int, depth: int) -> Column:
    """The rules that match a URL: domain or domain/path, for the host and its parents, for the leading paths.

    Rules of more labels or path segments than the longest rules of the lists are left out.
    """
    labels = F.split(host(url), r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels_most))), lambda i: F.array_join(F.slice(labels, n - i + 1, i), "."))
    domains = F.filter(domains, lambda d: F.instr(d, ".") > 0)
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    paths = F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(depth))), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    rules = F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p))))
    return F.when(F.length(host(url)) > 0, rules).otherwise(F.array().cast("array<string>"))


def validity(changes: DataFrame) -> DataFrame:
    """(list, rule, since, until): intervals in which an entry is on its list; ``until`` is null if it still is.

    ``changes`` has list, rule, action (add or remove) and date.
    """
    own = changes.where("list is not null and rule is not null and date is not null and action in ('add', 'remove')").select("list", "rule", "action", "date")
    day = own.groupBy("list", "rule", "date").agg(F.max("action").alias("action"))  # remove comes after add
    w = Window.partitionBy("list", "rule").orderBy("date")
    turns = day.withColumn("last", F.lag("action").over(w)).where("last is null or last <> action")
    turns = turns.withColumn("until", F.lead("date").over(w))
    return turns.where("action = 'add'").select("list", "rule", F.col("date").alias("since"), "until")


def evaluate(captures: DataFrame, changes: DataFrame, url: str = "url", time: str = "fetched", key: str = "page_id") -> DataFrame:
    """``captures`` with ``lists`` (names of the lists that hold it at its time, sorted), ``rules`` (the entries) and ``blocked``."""
    slice_of = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / SLICE_DAYS)
    keep = [c for c in captures.columns if c.lower() not in ("lists", "rules", "blocked")]
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("own"), F.col(f"`{url}`").alias("url"), F.col(f"`{time}`").cast("date").alias("at"))
    # Different (url, day) only: repeated captures are evaluated once.
    asked = rows.select("url", "at").where("url is not null and at is not null").distinct()
    days = asked.agg(F.min(slice_of("at")).alias("start"), F.max(slice_of("at")).alias("end")).first()
    spans = validity(changes)
    # The longest host and path of any rule: one row.
    longest = spans.agg(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("labels"), F.max(F.size(F.split("rule", "/")) - 1).alias("depth")).first()
    asked = asked.withColumn("part", F.pmod(F.xxhash64("url", "at"), F.lit(PARTS)).cast("int"))
    asked = asked.withColumn("rule", F.explode(F.array_distinct(url_rules(F.col("url"), longest.labels or 1, longest.depth or 0)))).withColumn("slice", slice_of("at"))
    lo, hi = F.greatest(slice_of("since"), F.lit(days.start or 0)), F.least(F.coalesce(slice_of("until"), F.lit(days.end or 0)), F.lit(days.end or 0))
    spans = spans.select("list", "rule", "since", "until", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").withColumn("slice", F.explode(F.sequence("lo", "hi")))
    spans = spans.select("rule", "slice", "list", "since", "until").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    hit = asked.join(spans, ["rule", "slice", "part"]).where("at >= since and (until is null or at < until)")
    found = hit.groupBy("url", "at").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.array_sort(F.collect_set(F.concat_ws(":", "list", "rule"))).alias("rules"))
    out = rows.join(found, ["url", "at"], "left")
    none = F.array().cast("array<string>")
    return out.select(*[F.col("own")[c].alias(c) for c in keep], F.coalesce("lists", none).alias("lists"), F.coalesce("rules", none).alias("rules"), F.col("lists").isNotNull().alias("blocked"))


# The tables hold neither fetch times nor lists. The query makes both from the pages themselves, alike in
# Spark and SQL: page p is fetched on day p * 7919 mod 1461 of the four years from 2020; each host and each
# parent domain of a page, and the host with the whole path of every seventh page, is on list ads, spam or adult by its
# length, added, removed and added again on days that its length and the length of its first label give.


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.expr("date_add(DATE '2020-01-01', CAST(page_id * 7919 % 1461 AS INT))"))
    h = host(F.col("url"))
    whole = F.when((F.col("page_id") % 7 == 0) & (path(F.col("url")) != ""), F.concat(h, path(F.col("url"))))
    rules = pages.select(F.explode(F.array(h, F.regexp_replace(h, r"^[^.]*\.", ""), whole)).alias("rule")).where("rule like '%.%'").distinct()
    size, dot = F.length("rule"), F.instr("rule", ".")
    named = F.when(size % 3 == 0, "ads").when(size % 3 == 1, "spam").otherwise("adult")
    changes = rules.where(size % 4 != 1).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    day = (size * 37 + dot * 101) % 400 + F.col("k") * (60 + size * 7 % 90)
    changes = changes.select(named.alias("list"), "rule", F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"), F.date_add(F.lit("2020-01-01").cast("date"), day.cast("int")).alias("date"))
    out = evaluate(captures, changes)
    return out.select("page_id", "url", F.array_join("lists", ",").alias("lists"), F.array_join("rules", ",").alias("rules"), "blocked")


_H = r"regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')"
_P = r"regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_DAY = "(length(rule) * 37 + strpos(rule, '.') * 101) % 400 + {k} * (60 + length(rule) * 7 % 90)"
ORACLE = f"""
WITH p AS (SELECT page_id, url, {_H} AS host, {_P} AS path, DATE '2020-01-01' + CAST(page_id * 7919 % 1461 AS INTEGER) AS at FROM pages),
r AS (SELECT DISTINCT rule FROM (SELECT host AS rule FROM p UNION ALL SELECT regexp_replace(host, '^[^.]*\\.', '') FROM p UNION ALL SELECT host || path FROM p WHERE page_id % 7 = 0 AND path <> '')
      WHERE rule LIKE '%.%' AND length(rule) % 4 <> 1),
i AS (SELECT rule, CASE length(rule) % 3 WHEN 0 THEN 'ads' WHEN 1 THEN 'spam' ELSE 'adult' END AS list,
             DATE '2020-01-01' + CAST({_DAY.format(k="k")} AS INTEGER) AS since,
             CASE WHEN k < 4 THEN DATE '2020-01-01' + CAST({_DAY.format(k="(k + 1)")} AS INTEGER) END AS until
      FROM r, (SELECT unnest([0, 2, 4]) AS k)),
h AS (SELECT p.page_id, p.url, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT list || ':' || rule, ',' ORDER BY list || ':' || rule) AS rules
      FROM p JOIN i ON (CASE WHEN strpos(i.rule, '/') = 0 THEN p.host = i.rule OR ends_with(p.host, '.' || i.rule)
                        ELSE starts_with(p.host || p.path || '/', i.rule || '/') END) AND p.at >= since AND (until IS NULL OR p.at < until) GROUP BY ALL)
SELECT p.page_id, p.url, coalesce(lists, '') AS lists, coalesce(rules, '') AS rules, lists IS NOT NULL AS blocked
FROM p LEFT JOIN h ON p.page_id = h.page_id AND p.url IS NOT DISTINCT FROM h.url
"""
