import datetime as dt
import random
import re
from collections import Counter
from zoneinfo import ZoneInfo

import pytest

from evalloom.llm import timestamps as T

KIND = "stamp_id long, source string, zone string, raw string"
UTC = dt.timezone.utc
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
TIME = r"(?:[T\x20](\d\d):(\d\d)(?::(\d\d))?(?:\x20?([AP]M))?(?:\x20?(Z|[+-]\d\d:?\d\d))?)?"


def day(y, m, d):
    try:
        return dt.date(int(y), int(m), int(d))
    except ValueError:
        return None


def read(raw, zone):
    """None, ("epoch", us), or (readings, seconds, offset seconds or None)."""
    if raw is None:
        return None
    s = raw.strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}|[0-9]{13}", s):
        return "epoch", int(s) * (10**6 if len(s) == 10 else 10**3)
    forms = {"ymd": r"(20\d\d)-(\d\d)-(\d\d)", "y": r"(20\d\d)(\d\d)(\d\d)", "dot": r"(\d\d)\.(\d\d)\.(20\d\d)", "b": rf"(\d\d) ({'|'.join(MONTHS)}) (20\d\d)", "/": r"(\d\d)/(\d\d)/(20\d\d)"}
    for kind, form in forms.items():
        m = re.fullmatch(form + TIME, s, re.ASCII)
        if not m:
            continue
        a, b, c, h, mi, se, half, off = m.groups()
        h, mi, se = int(h or 0), int(mi or 0), int(se or 0)
        if mi > 59 or se > 59 or (not 1 <= h <= 12 if half else h > 23):
            return None
        h = h % 12 + 12 * (half == "PM") if half else h
        offset = None
        if off == "Z":
            offset = 0
        elif off:
            oh, om = int(off[1:3]), int(off[-2:])
            if oh > 14 or om > 59:
                return None
            offset = (oh * 3600 + om * 60) * (-1 if off[0] == "-" else 1)
        elif zone is None or zone == "No/Where":
            return None
        found = {"ymd": lambda: {"plain": day(a, b, c)}, "y": lambda: {"plain": day(a, b, c)}, "dot": lambda: {"plain": day(c, b, a)}, "b": lambda: {"plain": day(c, MONTHS.index(b) + 1, a)}, "/": lambda: {"day": day(c, b, a), "month": day(c, a, b)}}[kind]()
        found = {k: v for k, v in found.items() if v}
        return (found, h * 3600 + mi * 60 + se, offset) if found else None
    return None


def brute(rows):
    votes, out = {}, []
    for _, source, zone, raw in rows:
        r = read(raw, zone)
        if r and r[0] != "epoch" and len(r[0]) == 1 and "plain" not in r[0]:
            votes.setdefault(source, Counter())[next(iter(r[0]))] += 1
    for key, source, zone, raw in rows:
        r = read(raw, zone)
        if r is None:
            out.append((key, None, "bad", False))
            continue
        if r[0] == "epoch":
            out.append((key, r[1], "epoch", False))
            continue
        found, seconds, offset = r
        rule, date = "plain", next(iter(found.values()))
        if len(set(found.values())) == 2:
            v = votes.get(source, Counter())
            rule = "votes" if v["day"] != v["month"] else "default"
            date = found["day"] if v["day"] > v["month"] else found["month"]
        wall = dt.datetime.combine(date, dt.time()) + dt.timedelta(seconds=seconds)
        odd = False
        if offset is None:
            z = ZoneInfo(zone)
            at = [wall.replace(tzinfo=z, fold=f).astimezone(UTC) for f in (0, 1)]
            odd, when = at[0] != at[1], at[0]
        else:
            when = wall.replace(tzinfo=UTC) - dt.timedelta(seconds=offset)
        out.append((key, (when - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1), rule, odd or rule != "plain"))
    return out


def made(n, seed):
    """Stamps of all forms, right and nearly right, near changes of the clocks and elsewhere."""
    r = random.Random(seed)
    zones = ["UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Pacific/Apia", "Africa/Casablanca", "America/Sao_Paulo", None, "No/Where", "+03:00"]
    odd_days = [(2024, 3, 31), (2024, 10, 27), (2024, 3, 10), (2024, 11, 3), (2024, 4, 7), (2024, 10, 6), (2011, 12, 30), (2018, 2, 18), (2018, 11, 4), (2023, 4, 23)]
    out = []
    for i in range(n):
        y, m, d = r.choice(odd_days) if r.random() < 0.4 else (r.randint(2000, 2099), r.randint(0, 13), r.randint(0, 32))
        date = r.choice(["{y}-{m:02}-{d:02}", "{y}{m:02}{d:02}", "{d:02}.{m:02}.{y}", "{d:02} {b} {y}", "{d:02}/{m:02}/{y}", "{m:02}/{d:02}/{y}", "{d}/{m}/{y}"]).format(y=y, m=m, d=d, b=r.choice([*MONTHS[max(0, min(m, 12) - 1) :][:1], "jan"]))
        if r.random() < 0.8:
            date += r.choice("T  ") + r.choice(["{h:02}:{n:02}", "{h:02}:{n:02}:{s:02}", "{h}:{n:02}"]).format(h=r.choice([0, 1, 2, 3, 12, 13, 23, 24]), n=r.choice([0, 29, 30, 59, 60]), s=r.choice([0, 59, 60]))
            date += r.choice(["", "", "", " AM", "PM", " PM", " pm"]) + r.choice(["", "", "", "Z", " Z", "+02:00", "-0800", " +14:59", "+15:00", "-05:60", "+2:00"])
        raw = r.choice([date] * 12 + [None, "", " \t", "0123456789", "1719447523", "1719923782256", "17199237822561", "x" * 5000, date + " ", date + "\x85", f"\x0b{date}\r\n", "|" + date, date + "|"])
        out.append((i, r.choice(["a", "b", None, "c"]), r.choice(zones[:8] * 3 + zones), raw))
    return out


def rows_of(df):
    return sorted((r.stamp_id, r.utc_us, r.rule, r.ambiguous) for r in df.select("stamp_id", "utc_us", "rule", "ambiguous").collect())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_against_a_plain_reader(spark, zone):
    rows = [x for x in made(3000, 7) if x[2] != "+03:00"]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = rows_of(T.normalise(spark.createDataFrame(rows, KIND)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    want = sorted(brute(rows))
    assert [(g, w) for g, w in zip(got, want, strict=True) if g != w] == []
    assert {w[2] for w in want} == {"bad", "epoch", "votes", "plain"}


def test_votes_ties_and_repeats(spark):
    z = "UTC"
    rows = [(1, "d", z, "13/01/2024"), (2, "d", z, "02/03/2024"), (3, "t", z, "13/01/2024"), (4, "t", z, "01/13/2024"), (5, "t", z, "02/03/2024"), (6, "t", z, "05/05/2024"), (7, "n", z, "02/03/2024 24:00"), (8, "n", z, "13/02/2024 24:00"), (9, "n", z, "02/03/2024"), (2, "d", z, "02/03/2024")]
    got = rows_of(T.normalise(spark.createDataFrame(rows, KIND)))
    march2, feb3 = 1709337600000000, 1706918400000000
    assert [g for g in got if g[0] == 2] == [(2, march2, "votes", True)] * 2
    assert (5, feb3, "default", True) in got and (9, feb3, "default", True) in got
    assert [g[2:] for g in got if g[0] == 6] == [("plain", False)]
    assert [g[1:] for g in got if g[0] in (7, 8)] == [(None, "bad", False)] * 2


def test_empty_and_clashing_columns(spark):
    assert T.normalise(spark.createDataFrame([], KIND)).count() == 0
    df = spark.createDataFrame([(1, "s", "UTC", "01/02/2024", "old", 5, 6)], KIND + ", rule string, day int, `a.b` int")
    row = T.normalise(df).first()
    assert (row["rule"], row["day"], row["a.b"]) == ("default", 5, 6)


def test_a_hot_source_is_dealt_out(spark):
    rows = spark.range(40_000).selectExpr("id as stamp_id", "if(id % 10 = 0, cast(id as string), 'hot') as source", "'UTC' as zone", "if(id % 2 = 0, '02/03/2024', '25/03/2024') as raw")
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        from pyspark.sql import functions as F

        out = T.normalise(rows).where("rule in ('votes', 'default')").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in out) == 20_000 and max(r["count"] for r in out) < 4_000
