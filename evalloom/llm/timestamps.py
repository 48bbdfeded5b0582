"""Mixed timestamp normalisation by candidate explosion.

A slashed date has two readings. Every reading that is a real date becomes a row; rows that stand alone vote for
their order in their source; then the readings of a stamp are ranked by the verdict of its source and the first stays.

Odd rows: null, empty and other texts, and stamps without an offset whose zone is null or unknown, are ``bad``: no time,
no vote. A null source is a source like any other. Repeated rows are stamps of their own and vote each. An empty table
gives an empty one. Columns of the input named as those added are replaced; all others stay as they are. A text of any
length is matched whole. A tie of votes counts as none: month first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The forms of the contract. Groups: year, month, day of each form, then hour, minute, second, half, offset.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_Y, _N = "(20[0-9]{2})", "([0-9]{2})"
_DATE = f"{_Y}-{_N}-{_N}|{_Y}{_N}{_N}|{_N}\\.{_N}\\.{_Y}|{_N} ({'|'.join(MONTHS)}) {_Y}|{_N}/{_N}/{_Y}"
_TIME = f"[T ]{_N}:{_N}(?::{_N})?(?: ?([AP]M))?(?: ?(Z|[+-][0-9]{{2}}:?[0-9]{{2}}))?"
STAMP = f"\\A(?:{_DATE})(?:{_TIME})?\\z"
EPOCH = r"\A(?:[0-9]{10}|[0-9]{13})\z"
#: What the groups are put together to: year, month, day, the two slashed numbers, hour, minute, second, half, offset.
_PARTS = "$1$4$9$12$15|$2$5$8$11|$3$6$7$10|$13|$14|$16|$17|$18|$19|$20"
ZONE = r"\A[A-Za-z0-9/_+:-]+\z"
#: Known without a look at the zone rules; other zones are looked up.
COMMON_ZONES = ["UTC", "Europe/Berlin", "Europe/London", "Europe/Paris", "America/New_York", "America/Chicago", "America/Los_Angeles", "Asia/Kolkata", "Asia/Shanghai", "Asia/Tokyo"]
WHITE = " \t\n\x0b\x0c\r"
DAY_US = 86_400_000_000
#: The verdict of a source is found under so many keys, so that the stamps of one source are dealt over as many parts.
SALTS = 32
_OWN = "__stamp"


def _wall(date: Column, seconds: Column) -> Column:
    """Microseconds of a local date and second of the day, counted as if they were UTC."""
    return F.unix_date(date).cast("long") * DAY_US + seconds * 1_000_000


def _local(us: Column, zone: Column) -> Column:
    """What the clocks of ``zone`` show at an instant, counted as if it were UTC."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _read(p: Column, zone: Column) -> Column:
    """A struct of all that is read from the parts ``p`` before an order is chosen: second of the day, offset (µs), zone, and the readings."""
    number = lambda i: F.nullif(p[i], F.lit("")).cast("int")
    hour, half = F.coalesce(number(5), F.lit(0)), p[8]
    in_day = F.when(half == "", F.when(hour < 24, hour)).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "PM", 12).otherwise(0))
    minute, second = F.coalesce(number(6), F.lit(0)), F.coalesce(number(7), F.lit(0))
    clock = F.when((minute < 60) & (second < 60), in_day * 3600 + minute * 60 + second)
    sign = F.when(p[9].startswith("-"), -1).otherwise(1)
    signed = F.when(~p[9].isin("", "Z"), p[9])
    off_h, off_m = F.substring(signed, 2, 2).cast("int"), F.right(signed, F.lit(2)).cast("int")
    offset = F.when(p[9] == "Z", 0).when((off_h <= 14) & (off_m < 60), sign * (off_h * 3600 + off_m * 60))
    # A zone that is not known gives no time: conversions would stop the query.
    known = F.when(zone.isin(*COMMON_ZONES), True).otherwise(zone.rlike(ZONE) & F.concat(F.lit("2000-01-01T00:00:00 "), zone).try_cast("timestamp").isNotNull())
    own_zone = F.when((p[9] == "") & known, zone)
    usable = clock.isNotNull() & F.when(p[9] == "", own_zone.isNotNull()).otherwise(offset.isNotNull())
    named = F.array_position(F.lit(MONTHS), p[1])
    date = lambda month, day: F.concat_ws("-", p[0], month, day).try_cast("date")
    month = F.when(named > 0, F.lpad(named.cast("string"), 2, "0")).otherwise(p[1])
    reading = lambda order, d: F.struct(F.lit(order).alias("order"), d.alias("date"))
    day_first, month_first = date(p[4], p[3]), date(p[3], p[4])
    dates = F.when(~usable, None).when(p[3] == "", F.array(reading("plain", date(month, p[2])))).when(day_first == month_first, F.array(reading("plain", day_first))).otherwise(F.array(reading("day", day_first), reading("month", month_first)))
    return F.struct(clock.cast("long").alias("clock"), (offset.cast("long") * 1_000_000).alias("offset"), own_zone.alias("zone"), F.filter(dates, lambda x: x["date"].isNotNull()).alias("dates"))


def candidates(stamps: DataFrame, raw: str = "raw", zone: str = "zone") -> DataFrame:
    """Candidate explosion: a row a reading, or one row without for a bad stamp.

    ``__epoch`` and ``__stamp`` hold what was read, ``__n`` how many readings there are (an epoch counts as one).
    """
    text = F.btrim(F.col(f"`{raw}`").cast("string"), F.lit(WHITE))
    epoch = F.when(text.rlike(EPOCH), F.rpad(text, 16, "0").try_cast("long"))
    parts = F.when(text.rlike(STAMP), F.split(F.regexp_replace(text, STAMP, _PARTS), r"\|", -1))
    # Generators of one row: filters on what was read stay above them, and a stamp is read once.
    rows = stamps.select("*", F.explode_outer(F.array(F.struct(epoch.alias("epoch"), parts.alias("p")))).alias("__text"))
    own = F.when(F.col("__text.p").isNotNull(), _read(F.col("__text.p"), F.col(f"`{zone}`")))
    rows = rows.select(*[F.col(f"`{c}`") for c in stamps.columns], F.col("__text.epoch").alias("__epoch"), F.explode_outer(F.array(own)).alias(_OWN))
    n = F.when(F.col("__epoch").isNotNull(), 1).otherwise(F.coalesce(F.size(f"{_OWN}.dates"), F.lit(0)))
    return rows.select("*", n.alias("__n"), F.explode_outer(f"{_OWN}.dates").alias("__reading"))


def verdicts(rows: DataFrame, source: str = "source") -> DataFrame:
    """(__source, __day, __month): votes of the slashed candidates of each source that stand alone in their stamp."""
    order = F.col("__reading.order")
    alone = rows.where((F.col("__n") == 1) & order.isin("day", "month"))
    return alone.groupBy(F.col(f"`{source}`").alias("__source")).agg(F.count_if(order == "day").alias("__day"), F.count_if(order == "month").alias("__month"))


def normalise(stamps: DataFrame, raw: str = "raw", zone: str = "zone", source: str = "source", salts: int = SALTS) -> DataFrame:
    """Adds ``utc_us`` (null if bad), ``rule`` (bad, epoch, votes, default, plain) and ``ambiguous`` to each stamp.

    Only stamps with two readings meet the verdicts, in a join over source and salt.
    """
    kept = [c for c in stamps.columns if c not in ("utc_us", "rule", "ambiguous")]
    rows = candidates(stamps, raw, zone)
    votes = verdicts(rows, source).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    open_ = rows.where("__n = 2").withColumn("__salt", (F.monotonically_increasing_id() % salts).cast("int"))
    met = open_.join(votes, F.col(f"`{source}`").eqNullSafe(F.col("__source")) & (open_["__salt"] == votes["__salt"]), "left")
    day, month = F.coalesce("__day", F.lit(0)), F.coalesce("__month", F.lit(0))
    wins = F.when(day > month, "day").otherwise("month")
    rank = F.when(F.col("__reading.order") == wins, 1).otherwise(2)
    ranked = met.withColumn("__rank", rank).where("__rank = 1").withColumn("__rule", F.when(day != month, "votes").otherwise("default"))
    alone = F.when(F.col("__n") == 0, "bad").when(F.col("__epoch").isNotNull(), "epoch").otherwise("plain")
    cols = [F.col(f"`{c}`") for c in kept]
    whole = rows.where("__n < 2").withColumn("__rule", alone).select(*cols, "__epoch", _OWN, "__reading", "__rule").unionByName(ranked.select(*cols, "__epoch", _OWN, "__reading", "__rule"))
    return whole.select(*cols, *_times())


def _times() -> list[Column]:
    """utc_us, rule and ambiguous of a row with its reading chosen."""
    own, date, rule = F.col(_OWN), F.col("__reading.date"), F.col("__rule")
    seconds, zone = own["clock"], own["zone"]
    wall = _wall(date, seconds)
    placed = F.unix_micros(F.try_make_timestamp(F.year(date), F.month(date), F.day(date), F.floor(seconds / 3600).cast("int"), (F.floor(seconds / 60) % 60).cast("int"), seconds % 60, zone))

    def in_zone(us: Column) -> Column:
        """Skipped: the clocks show another time then. Repeated: they show it again after going back within a day."""
        shown = _local(us, zone)
        back = shown - _local(us + DAY_US, zone) + DAY_US
        return F.struct(us.alias("us"), ((shown != wall) | ((back > 0) & (_local(us + back, zone) == wall))).alias("odd"))

    local = F.when(own["offset"].isNotNull(), F.struct((wall - own["offset"]).alias("us"), F.lit(False).alias("odd"))).otherwise(F.element_at(F.transform(F.array(placed), in_zone), 1))
    us = F.when(rule == "epoch", F.col("__epoch")).when(rule != "bad", local["us"])
    odd = F.when(rule.isin("epoch", "bad"), False).otherwise(local["odd"] | rule.isin("votes", "default"))
    return [us.alias("utc_us"), rule.alias("rule"), F.coalesce(odd, F.lit(False)).alias("ambiguous")]


def op12_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stamp of ``stamps``: its instant, the rule that gave it, and whether it was ambiguous."""
    return normalise(table(spark, sf_dir, "stamps")).select("stamp_id", "utc_us", "rule", "ambiguous")


_SQL_N = "TRY_CAST({0} AS INTEGER)"
ORACLE = rf"""WITH t AS (SELECT row_number() OVER () AS row, *, regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM stamps),
g AS (SELECT *, regexp_full_match(s, '[0-9]{{10}}|[0-9]{{13}}') AS ep, regexp_full_match(s, '(?:{_DATE})(?:{_TIME})?') AS ok,
 regexp_extract(s, '[T ]([0-9]{{2}}):[0-9]{{2}}', 1) AS h, regexp_extract(s, '[T ][0-9]{{2}}:([0-9]{{2}})', 1) AS mi, regexp_extract(s, '[T ][0-9]{{2}}:[0-9]{{2}}:([0-9]{{2}})', 1) AS se, regexp_extract(s, '([AP]M)', 1) AS half,
 regexp_extract(s, ':[0-9 APM:]*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$', 1) AS off FROM t),
n AS (SELECT *, CASE WHEN off = 'Z' THEN 0 WHEN off <> '' AND CAST(substr(off, 2, 2) AS INTEGER) <= 14 AND CAST(right(off, 2) AS INTEGER) < 60 THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (CAST(substr(off, 2, 2) AS INTEGER) * 3600 + CAST(right(off, 2) AS INTEGER) * 60) END AS o,
 CASE WHEN h = '' THEN 0 WHEN CAST(mi AS INTEGER) > 59 OR coalesce({_SQL_N.format("se")}, 0) > 59 THEN NULL WHEN half = '' AND CAST(h AS INTEGER) < 24 THEN CAST(h AS INTEGER) * 3600 + CAST(mi AS INTEGER) * 60 + coalesce({_SQL_N.format("se")}, 0)
 WHEN half <> '' AND CAST(h AS INTEGER) BETWEEN 1 AND 12 THEN (CAST(h AS INTEGER) % 12 + CASE WHEN half = 'PM' THEN 12 ELSE 0 END) * 3600 + CAST(mi AS INTEGER) * 60 + coalesce({_SQL_N.format("se")}, 0) END AS secs FROM g),
z AS (SELECT *, ok AND secs IS NOT NULL AND (o IS NOT NULL OR (off = '' AND zone IN (SELECT name FROM pg_timezone_names()))) AS fine, s[3] = '/' AS sl FROM n),
c AS (SELECT *, CASE WHEN NOT fine OR sl THEN NULL WHEN s[5] = '-' THEN TRY_CAST(left(s, 10) AS DATE) WHEN s[3] = '.' THEN TRY_CAST(substr(s, 7, 4) || '-' || substr(s, 4, 2) || '-' || left(s, 2) AS DATE)
 WHEN s[3] = ' ' THEN TRY_CAST(substr(s, 8, 4) || '-' || lpad(CAST(list_position({MONTHS!r}, substr(s, 4, 3)) AS VARCHAR), 2, '0') || '-' || left(s, 2) AS DATE) ELSE TRY_CAST(left(s, 4) || '-' || substr(s, 5, 2) || '-' || substr(s, 7, 2) AS DATE) END AS dt,
 CASE WHEN fine AND sl THEN TRY_CAST(substr(s, 7, 4) || '-' || substr(s, 4, 2) || '-' || left(s, 2) AS DATE) END AS dd, CASE WHEN fine AND sl THEN TRY_CAST(substr(s, 7, 4) || '-' || left(s, 2) || '-' || substr(s, 4, 2) AS DATE) END AS dm FROM z),
v AS (SELECT source, count(*) FILTER (dd IS NOT NULL AND dm IS NULL) AS nd, count(*) FILTER (dm IS NOT NULL AND dd IS NULL) AS nm FROM c GROUP BY source),
p AS (SELECT c.*, CASE WHEN ep THEN 'epoch' WHEN coalesce(dt, dd, dm) IS NULL THEN 'bad' WHEN dd <> dm THEN CASE WHEN nd <> nm THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule,
 CASE WHEN dd <> dm THEN CASE WHEN nd > nm THEN dd ELSE dm END ELSE coalesce(dt, dd, dm) END AS day FROM c JOIN v ON c.source IS NOT DISTINCT FROM v.source),
w AS (SELECT *, CAST(day AS TIMESTAMP) + to_seconds(secs) AS wall FROM p),
u AS (SELECT *, CASE WHEN off = '' AND rule NOT IN ('epoch', 'bad') THEN epoch_us(timezone(zone, wall)) END AS late FROM w),
b AS (SELECT *, (SELECT late - (epoch_us(timezone(zone, make_timestamptz(late - {DAY_US}))) - (late - {DAY_US}) - epoch_us(timezone(zone, make_timestamptz(late))) + late)) AS early FROM u)
SELECT stamp_id, CASE rule WHEN 'bad' THEN NULL WHEN 'epoch' THEN CAST(rpad(s, 16, '0') AS BIGINT) ELSE CASE WHEN off <> '' THEN epoch_us(wall) - CAST(o AS BIGINT) * 1000000 WHEN early < late AND epoch_us(timezone(zone, make_timestamptz(early))) = epoch_us(wall) THEN early ELSE late END END AS utc_us, rule,
 coalesce(rule IN ('votes', 'default') OR (off = '' AND rule = 'plain' AND ((early < late AND epoch_us(timezone(zone, make_timestamptz(early))) = epoch_us(wall)) OR epoch_us(timezone(zone, make_timestamptz(late))) <> epoch_us(wall))), false) AS ambiguous FROM b"""
