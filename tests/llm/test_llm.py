"""Small tests of the training-data operators: brute force, hostile rows, planted cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalloom.llm import ann_search, decontamination, html_extraction, language_id, line_dedup, lm_scoring, minhash_dedup, source_mixing, substring_dedup, url_filters

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rnd_text(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def hostile(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing extra columns."""
    rnd = random.Random(3)
    long = rnd_text(rnd, 3000)
    rows = [(1, None, None, None, None), (2, "", "en", "b", 0), (3, "  \n\t ", "en", None, 1), (4, long, "en", "a", 9), (4, long, "en", "a", 9), (None, long, None, None, None), (5, long + " tail", "de", "a", 3), (6, "one", "de", "c", 3), (7, rnd_text(rnd, 40), "en", "a", None)]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("size", "words", "hashes", "batch", "score", "key", "th")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


# 1 ----------------------------------------------------------------------------------------------


def test_lm_scores_match_the_base_and_are_probabilities(spark):
    rnd = random.Random(1)
    rows = [(i, rnd_text(rnd, 30, 50).upper()) for i in range(60)] + [(None, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    from evalloom.llm.common import crc_mod

    got = lm_scoring.score(df, crc_mod("doc_id", 5) == 1).collect()
    assert len(got) == len(rows)
    tokens = {i: WORD.findall((t or "").lower()) + ["END"] for i, t in rows}
    c = collections.Counter(w for i, own in tokens.items() if not held(i) for w in own)
    total, different = sum(c.values()), len(c)
    for r in got:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(w in c for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (different + 1))) for w in own))
        assert r.score < 0


def test_lm_empty_table(spark):
    from evalloom.llm.common import crc_mod

    assert lm_scoring.score(empty(spark), crc_mod("doc_id", 5) == 1).count() == 0


# 2 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        ("<nav><a>Home</a></nav><article><h1>T</h1><p>a &amp; b<br>c  d</p></article><footer>x</footer>", "T\n\na & b c d"),
        ("<article><p>One<p>Two <b>bold</article><aside>no</aside>", "One\n\nTwo bold"),
        ("<script>var a='<p>x</p>'</script><main><p>Body text</p><div class='comments'><p>rude</p></div></main>", "Body text"),
        ("<div class=menu><a href=x>Home</a></div><p>" + "Plain words here. " * 10 + "</p><form><p>Name</p></form>", ("Plain words here. " * 10).strip()),
        ("<p>unclosed <b>tag", "unclosed tag"),
        ("<!-- <p>hidden</p> --><article><p>&#233;&eacute;&nbsp;x</p></article>", "éé x"),
    ],
)
def test_html(html, text):
    assert html_extraction.extract_main_text(html) == text


def test_html_keeps_links_of_a_marked_article():
    page = "<nav><a>Home</a></nav><main><h2><a href=x>Linked heading</a></h2><p>Text.</p><ul><li><a>Ref&nbsp;&amp; one</a><li><a>Ref two</a>, p. 3</ul></main><p>outside</p>"
    assert html_extraction.extract_main_text(page) == "Linked heading\n\nText.\n\nRef & one\n\nRef two, p. 3"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<body><form id=aspnet><div class=menu><a>Home</a></div><article><h1>T</h1><p>Inside a form.</p></article></form></body>", "T\n\nInside a form."),
        ("<article><div class='entry-header'><h1>Title</h1></div><p>Text.</p></article>", "Title\n\nText."),
        ("<article><p title=it's>One</p><p>it's two</p></article><p class='x'>no</p>", "One\n\nit's two"),
        ("<article><p>See <a href=x>a long linked paragraph of the text</a></p></article>", "See a long linked paragraph of the text"),
        ("<article><p>Short.</p></article><p>" + "Unmarked text. " * 60 + "</p>", "Short.\n\n" + ("Unmarked text. " * 60).strip()),
        ("<p>Lead</p><article><p>Short.</p></article><p>after</p>", "Short."),
    ],
)
def test_html_structure_and_weights(html, text):
    assert html_extraction.extract_main_text(html) == text


def test_html_marks_do_not_decide(spark):
    """The test pages with their article and main elements turned into plain ones give the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]
    assert pages
    for page in pages:
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page)
        assert html_extraction.extract_main_text(plain) == html_extraction.extract_main_text(page)


def test_html_counts_link_text_decoded():
    assert html_extraction.html_lines("<p><a>&eacute;&eacute;\n  &amp;</a> plain words</p>") == [("éé & plain words", 4, False)]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", "clash"), (1, "u", None, None)], "page_id long, url string, html string, text string")
    assert sorted((r.text, r.n_chars) for r in html_extraction.extract(df).collect()) == [("", 0), ("é", 1)]
    assert html_extraction.extract(df.limit(0)).count() == 0


# 3 ----------------------------------------------------------------------------------------------


def test_language(spark):
    rnd = random.Random(2)
    words = {"en": "the and of house water".split(), "de": "der und das haus wasser".split()}
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(20)), x) for i, x in enumerate(["en", "de"] * 20)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    df = spark.createDataFrame([("the water",), ("DAS WASSER",), ("wasserhaus",), (None,), ("",), ("12 !!",), ("日本",)], "text string").withColumn("score", F.lit("clash"))
    got = {r.text: (r.lang_pred, r.score) for r in language_id.predict(df, model).collect()}
    assert [got[t][0] for t in ("the water", "DAS WASSER", "wasserhaus", None, "", "12 !!")] == ["en", "de", "de", "und", "und", "und"]
    assert got["日本"][0] in ("en", "de") and all(0 <= s <= 1 for _, s in got.values())


def test_language_letters():
    assert language_id.letters("x² ½ ①Ⅷ añb_c1d Straße") == ["x", "añb", "c", "d", "Straße"]
    assert language_id.Model([("en", 0, "a", 1)], {("en", 0): 1}).predict(["² ½ ①", "Ⅷ"])[0] == ["und", "und"]


def test_language_hostile(spark):
    model = language_id.train(hostile(spark))
    assert language_id.predict(hostile(spark), model).count() == 9
    none = language_id.train(empty(spark))
    assert {r.lang_pred for r in language_id.predict(hostile(spark), none).collect()} == {"und"}


# 4 ----------------------------------------------------------------------------------------------


def test_targets():
    assert source_mixing.targets({"a": 100, "b": 100, "c": 100}) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = source_mixing.targets({"a": 1000, "b": 10, None: 10})
    assert got == {"a": 960.0, "b": 30.0, None: 30.0}


def test_mix(spark):
    rnd = random.Random(4)
    rows = [(i, rnd_text(rnd, rnd.randint(0, 60)), "en", rnd.choice(["a", "b", "c", None, "a", "a"]), 0) for i in range(300)] + [(7, "same row", "en", "b", 0)] * 2
    out = source_mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    sizes = collections.Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t))
    aim = source_mixing.targets(dict(sizes))
    assert len(out) == len(rows) and all(r.taken <= 3 * r["size"] for r in out)
    taken = collections.Counter()
    for r in out:
        taken[r.source_size, round(r.target, 6)] += r.taken
    for s, n in sizes.items():
        assert taken[n, round(aim[s], 6)] == pytest.approx(aim[s], rel=0.01, abs=2)


@pytest.mark.parametrize("slots", [16, 256])
def test_mix_small_sources_meet_their_targets(spark, slots):
    rows = [(i, "w " * 5000, "en", "a", 0) for i in range(200)] + [(1000 + i, "w " * n, "en", f"s{i:02}", 0) for i, n in enumerate([1, 7, 40, 3, 900, 25, 2, 5000] * 5)]
    out = source_mixing.mix(spark.createDataFrame(rows, DOCS), slots=slots).collect()
    sizes = {s: sum(len(t) // 2 for _, t, _, x, _ in rows if x == s) for s in {r[3] for r in rows}}
    aim, taken = source_mixing.targets(sizes), collections.Counter()
    for r in out:
        taken["a" if r.doc_id < 1000 else f"s{r.doc_id - 1000:02}"] += r.taken
    assert {s: taken[s] for s in sizes} == {s: round(aim[s]) for s in sizes}


def test_mix_hostile(spark):
    assert source_mixing.mix(hostile(spark)).count() == 9
    assert source_mixing.mix(empty(spark)).count() == 0


# 5 ----------------------------------------------------------------------------------------------


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


@pytest.mark.parametrize("hot", [5, 10**6])
def test_line_dedup(spark, hot):
    rnd = random.Random(5)
    base = [f"the quick brown fox jumps over number {i}" for i in range(12)] + ["short", ""]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(3):
            x = rnd.choice(base)
            for _ in range(rnd.choice([0, 1, 1, 2]) if x else 0):
                j, c = rnd.randrange(len(x)), rnd.choice("ab")
                x = rnd.choice([x[:j] + c + x[j:], x[:j] + x[j + 1 :], x[:j] + c + x[j + 1 :]])
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    first = {}
    for d, t in rows:
        for no, x in enumerate(t.split("\n")):
            if x.strip(" "):
                first.setdefault(x, (d, no))
    old = sorted(first, key=first.get)
    late = {b for i, b in enumerate(old) for a in old[:i] if min(len(a), len(b)) >= 24 and near(a, b)}
    gone = {(d, no) for d, t in rows for no, x in enumerate(t.split("\n")) if x.strip(" ") and (x in late or first[x] != (d, no))}
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), hot_pairs=hot).distinct().collect()
    assert {(r.doc, r.no) for r in got} == gone


@pytest.mark.parametrize("t", [2, 3])
def test_line_dedup_hot_segments_of_more_edits(spark, t):
    """Later lines of a shared segment are near each other, but not near its earliest line."""
    rnd = random.Random(15 + t)
    lines = []
    for _ in range(15):
        base = "licence of the package with the name " + "".join(rnd.choice("abcdefgh") for _ in range(12))
        lines += [base, base[:-2] + "xy", base[:-1]]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    late = {d for d, x in enumerate(lines) if any(distance(x, y) <= t for y in lines[:d])}
    got = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), max_edits=t, hot_pairs=20)
    assert {r.doc for r in got.collect()} == late


def test_bit_parallel_distance(spark):
    rnd = random.Random(12)
    rows = []
    for _ in range(300):
        a = "".join(rnd.choice("abä") for _ in range(rnd.randint(0, 12)))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            j = rnd.randint(0, len(b))
            b[j : j + rnd.randint(0, 1)] = rnd.choice(["", "a", "c"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    for t in (1, 2, 3):
        assert df.where(line_dedup.within_edits(F.col("a"), F.col("b"), t) != (F.levenshtein("a", "b") <= t)).count() == 0
        assert df.where(line_dedup.within_edits(F.col("a"), F.col("b"), t).isNull()).count() == 0


def test_line_dedup_hostile(spark):
    out = line_dedup.dedup_lines(hostile(spark)).collect()
    assert len(out) == 9 and out[0].size == "clash"
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# 6 ----------------------------------------------------------------------------------------------


def test_url_filters(spark):
    changes = spark.createDataFrame([("ads", "x.com", "add", "2020-01-10"), ("ads", "x.com", "remove", "2020-02-01"), ("ads", "x.com", "add", "2020-03-01"), ("spam", "b.x.com/p", "add", "2020-01-01"), ("ads", None, "add", "2020-01-01"), ("ads", "q.org", "add", "2020-05-05"), ("ads", "q.org", "remove", "2020-05-05")], "list string, rule string, action string, date string").withColumn("date", F.to_date("date"))
    rows = [(1, "http://a.b.x.com:80/p/q?z", "2020-01-15"), (2, "HTTP://X.COM", "2020-02-15"), (3, "https://x.com./", "2020-03-01"), (4, "https://b.x.com/pq", "2020-01-05"), (5, None, "2020-01-15"), (6, "http://x.com", None), (7, "notx.com", "2020-01-15"), (8, "http://q.org", "2021-01-01"), (1, "http://a.b.x.com:80/p/q?z", "2020-01-15")]
    df = spark.createDataFrame(rows, "page_id long, url string, day string").select("page_id", "url", F.to_date("day").alias("fetched"), F.lit(1).alias("lists"))
    got = sorted((r.page_id, ",".join(r.lists)) for r in url_filters.evaluate(df, changes).collect())
    assert got == [(1, "ads,spam"), (1, "ads,spam"), (2, ""), (3, "ads"), (4, ""), (5, ""), (6, ""), (7, ""), (8, "")]
    assert url_filters.evaluate(df.limit(0), changes).count() == 0
    assert url_filters.evaluate(df, changes.limit(0)).where("blocked").count() == 0


def test_url_filters_long_hosts_and_deep_paths(spark):
    changes = spark.createDataFrame([("ads", "a.b.c.d.e.f.g.com", "2020-01-10"), ("spam", "x.com/1/2/3/4/5", "2020-01-10")], "list string, rule string, date string").select("list", "rule", F.lit("add").alias("action"), F.to_date("date").alias("date"))
    rows = [(1, "http://a.b.c.d.e.f.g.com/q"), (2, "http://z.a.b.c.d.e.f.g.com"), (3, "http://b.c.d.e.f.g.com"), (4, "http://w.x.com/1/2/3/4/5/6?q"), (5, "http://x.com/1/2/3/4")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("fetched", F.to_date(F.lit("2020-02-01")))
    got = {r.page_id: ",".join(r.lists) for r in url_filters.evaluate(df, changes).collect()}
    assert got == {1: "ads", 2: "ads", 3: "", 4: "spam", 5: ""}


# 7 ----------------------------------------------------------------------------------------------


def test_search_finds_the_nearest(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 16)).astype(np.float32) * rng.uniform(0.5, 2, (600, 1)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 15), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann_search.search(df, df.where("vec_id % 20 = 0"), k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q, found in got.items():
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 10)))[:10]
        hits += len({v for v, _ in found} & set(best.tolist()))
        assert len(found) == 10 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert [v for _, v in found] == pytest.approx([s[v] for v, _ in found], abs=1e-9)
    assert len(got) == 30 and hits / 300 >= 0.9
    assert ann_search.search(df.limit(0), df.limit(0)).count() == 0


# 8 ----------------------------------------------------------------------------------------------


def test_bagminhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(7)
    for share in (0.3, 0.8):
        n = 300
        elements = rng.integers(0, 2**63, n).astype(np.uint64)
        wa, wb = rng.integers(1, 9, n), rng.integers(1, 9, n)
        keep = rng.random(n) < share
        wb[keep] = wa[keep]
        sig = minhash_dedup.bagminhash(np.repeat([0, 1], n), np.concatenate([elements, elements]), np.concatenate([wa, wb]), 2, m=4096)
        assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.03)


def test_near_duplicates(spark):
    rnd = random.Random(8)
    rows, group = [], {}
    for g in range(12):
        base = rnd_text(rnd, 150, 5000).split()
        for k in range(5):
            own = list(base)
            if k:
                own[rnd.randrange(150)] = "changed"
            rows.append((g * 10 + k, " ".join(own)))
            group[g * 10 + k] = g * 10
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == group


def test_near_duplicates_in_a_large_bucket_of_many_classes(spark, monkeypatch):
    """Every text meets every other in all buckets; of 25 texts of common boilerplate each has one partner."""
    features = minhash_dedup._features

    def one_bucket(batches):
        for pdf in features(batches):
            yield pdf.assign(bands=[[1, 2] if len(b) else [] for b in pdf["bands"]])

    monkeypatch.setattr(minhash_dedup, "_features", one_bucket)
    rnd = random.Random(18)
    common = rnd_text(rnd, 60, 5000).split()
    rows = []
    for g in range(25):
        own = rnd_text(rnd, 60, 5000).split()
        for k in range(2):
            other = list(own)
            other[k * 7] = f"x{k}"
            rows.append((g * 2 + k, " ".join(common + other)))
    rows += [(100 + k, "again again " * (40 + k)) for k in range(5)]  # heavy runs
    bags = {}
    for i, t in rows:
        w = t.split()
        bags[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    label = {i: i for i in bags}
    for a in bags:
        for b in bags:
            if a < b and (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total():
                la, lb = sorted((label[a], label[b]))
                label = {i: la if x == lb else x for i, x in label.items()}
    assert 25 <= len(set(label.values())) < 32
    for block in (400, 7):
        got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
        assert got == label


def test_near_duplicates_hostile(spark):
    out = minhash_dedup.near_duplicates(hostile(spark)).collect()
    by = collections.defaultdict(set)
    for r in out:
        by[r.class_id].add(r.doc_id)
    assert len(out) == 9 and by[4] == {4, 5, None} and by[2] == {2} and by[3] == {3}
    kept = [r.doc_id for r in minhash_dedup.keep_first(hostile(spark)).collect()]
    assert sorted(kept) == [1, 2, 3, 4, 6, 7]
    assert minhash_dedup.near_duplicates(empty(spark)).count() == 0


# 9 ----------------------------------------------------------------------------------------------


def brute_hits(text, items):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    hit, found = set(), set()
    for item, own in items:
        n = min(13, len(own))
        windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if n and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("lengths", [(30, 20, 14), (30, 9, 13), (3, 1, 25)])
def test_decontamination(spark, lengths):
    rnd = random.Random(9)
    items = [(i, rnd_text(rnd, lengths[i % 3], 3000)) for i in range(6)] + [(50, None), (51, "!!"), (52, None)]
    items.append((99, items[0][1]))
    rows = []
    for d in range(60):
        w = rnd_text(rnd, rnd.randint(0, 80), 3000).split()
        if d % 3 == 0:
            own = rnd.choice(items[:6])[1].split()
            a = rnd.randrange(len(own))
            w[len(w) // 2 : len(w) // 2] = own[a:] if d % 2 else own
        rows.append((d, rnd.choice([" ", ", ", "\n"]).join(w).upper()))
    rows += [(100, None), (None, "")]
    split = [(i, re.findall(r"[a-z0-9]+", t or "")) for i, t in items]
    got = {r.doc_id: r for r in decontamination.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        n, hit, found = brute_hits(t, split)
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)


def test_decontamination_hostile(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.report(hostile(spark), items).count() == 9
    assert decontamination.decontaminate(hostile(spark), items.limit(0)).count() == 9
    assert decontamination.report(empty(spark), items).count() == 0


# 10 ---------------------------------------------------------------------------------------------


def test_difference_cover():
    for shift in range(substring_dedup.PERIOD):
        assert any((c + shift) % substring_dedup.PERIOD in substring_dedup.COVER for c in substring_dedup.COVER)


def test_substring_dedup(spark):
    rnd = random.Random(10)
    shared = rnd_text(rnd, 60, 9000).split()
    rows = []
    for d in range(80):
        w = rnd_text(rnd, rnd.randint(0, 90), 9000).split()
        if d % 4 == 0:
            a = rnd.randrange(30)
            w[len(w) // 3 : len(w) // 3] = shared[a : a + rnd.randint(15, 40)]
        if d % 10 == 0:
            w = w + w
        rows.append((d, " ".join(w)))
    rows += [(200, rows[3][1]), (201, None), (202, "")]
    seen, want = set(), {}
    for d, t in sorted(rows):
        w = WORD.findall(t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                keep[i : i + 20] = [False] * 20
            seen.add(key)
        want[d] = (len(w), " ".join(x for x, k in zip(w, keep, strict=True) if k))
    got = {r.doc_id: (r.n_words, r.kept) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), batch_rows=7).collect()}
    assert got == want


def test_substring_dedup_hostile(spark):
    out = {}
    for r in substring_dedup.dedup(hostile(spark)).collect():
        out.setdefault(r.doc_id, []).append(r.n_words - r.n_removed)
    assert out[None] == [3000] and out[4] == [0, 0] and out[5] == [1]
    assert substring_dedup.dedup(empty(spark)).count() == 0
