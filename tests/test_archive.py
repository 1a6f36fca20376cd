"""The archive's operators on small literals, and the properties its own self-check states."""

import datetime as dt
import itertools
import random
import zlib
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from newslake.functions import fold as folding
from newslake.operators import archive, collect, ingest, quiet, search, stories
from newslake.plans import postings, request
from newslake.sources import feeds
from newslake.plans.request import parse
from newslake.session import cut
from newslake.streaming import jobs

T0 = dt.datetime(2026, 9, 1)
H = "row_id long, ts timestamp_ntz, domain string, url string, title string"


def headlines(spark, n=240, seed=1, days=20):
    r = random.Random(seed)
    stems = [f"Story {i} about {w}" for i, w in enumerate(["bridges", "nurses", "trams", "el niño", "Łódź"] * 6)]
    rows = []
    for i in range(n):
        d = r.choice(["hot.example"] * 6 + ["b.example", "c.example"])
        stem = r.choice([stems[0]] * 5 + stems)
        rows.append((i, T0 + dt.timedelta(minutes=r.randrange(days * 24 * 4) * 15), d, f"https://{d}/{i % 50}", stem + r.choice([f" | {d[0].upper()} Daily", f" - News | {d[0].upper()} Daily", "", " – odd"])))
    return spark.createDataFrame(rows, H)


def test_fold_and_tokens(spark):
    texts = ["El Niño", "Łódź straße Æon œuf", "Trump’s", "ÅNGSTRÖM", None, "", "한국", "Ωμέγα"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(folding.fold(F.col("t")).alias("f")).collect()
    assert [x.f for x in got] == [t and folding.fold_py(t) if t is not None else None for t in texts]
    assert [folding.fold_py(folding.fold_py(t)) for t in texts if t] == [folding.fold_py(t) for t in texts if t]
    toks = spark.createDataFrame([("Trump’s el-nino 9",)], "t string").select(folding.tokens(folding.fold(F.col("t"))).alias("x")).first().x
    assert toks == ["trump’s", "el", "nino", "9"]


def test_request_rules():
    for bad in ({"q": "x"}, {"q": "a" * 201}, {"q": " OR ".join("abcdefghi")}, {"q": "a b c d e f g h i"}, {"q": "!!"}, {"domain": ",".join(f"{c}.example" for c in "abcdefghijk")}, {"domain": "no spaces"}, {"from": "2026-13-01"}, {"from": "2026-02-02", "to": "2026-02-01"}, {"src": "x"}, {"before": "2026"}):
        with pytest.raises(ValueError):
            parse(bad)
    q = parse({"q": "OR El Niño OR or OR", "domain": "B.example,a.example,b.example"})
    assert q.groups == (("el", "nino"), ("or",)) and q.domains == ("a.example", "b.example")
    assert parse({"q": "new OR", "mode": "substring"}).q == "new OR"
    mixed = parse({"q": "", "src": "feeds,gdelt", "from": "2026-08-20", "to": "2026-09-03"})
    assert [(p.first.day, p.last.day, p.unified) for p in mixed.parts()] == [(20, 31, False), (1, 3, True)]
    assert parse({"src": "blogs", "to": "2026-08-01"}).parts() == [] and mixed.both_news
    assert parse({"q": "ab", "src": "blogs,gdelt"}).canonical() == parse({"q": " ab", "src": "gdelt, blogs"}).canonical()
    s = request.series("snow site:b.example,a.example in:blogs rain", parse({"q": "x1"}))
    assert s.q == "snow rain" and s.domains == ("a.example", "b.example") and s.src == ("blogs",)
    assert request.windows(dt.date(2024, 3, 5), dt.date(2025, 6, 7))[0] == (dt.date(2024, 7, 1), dt.date(2025, 6, 7))
    assert request.shifted(dt.date(2026, 9, 3), dt.date(2026, 9, 4), -1) == (dt.date(2026, 9, 1), dt.date(2026, 9, 2))
    assert request.source_name(" https://www.BBC.com/news ") == "bbc.com"


def brute_flags(rows):
    out, week = {}, dt.timedelta(days=7)
    for r in rows:
        before = [x for x in rows if x.key == r.key and (x.ts, x.url, x.row_id) < (r.ts, r.url, r.row_id)]
        any_, same = max((x.ts for x in before), default=None), max((x.ts for x in before if x.domain == r.domain), default=None)
        out[r.row_id] = 0 if any_ is None or any_ < r.ts - week else 1 if same is None or same < r.ts - week else 2
    return out


def test_keys_and_flags(spark):
    h = headlines(spark)
    labels = cut(stories.learn_labels(h, 8))
    assert {(x.domain, x.tail) for x in labels.collect()} >= {("hot.example", "H Daily")}
    keyed = cut(stories.with_key(h, labels))
    key = {x.row_id: (x.title, x.key) for x in keyed.collect()}
    assert all(" | H Daily" not in k for _, k in key.values()) and any(t.endswith("– odd") and k.endswith("– odd") for t, k in key.values())
    want = brute_flags(keyed.collect())
    assert {x.row_id: x.flag for x in stories.copy_flags(keyed).collect()} == want and set(want.values()) == {0, 1, 2}
    cuts = [T0 + dt.timedelta(days=d) for d in (0, 6, 13, 99)]
    got = {}
    for a, b in itertools.pairwise(cuts):
        part = stories.copy_flags_of_batch(keyed.where(F.col("ts") < F.lit(str(a)).cast("timestamp_ntz")), keyed.where((F.col("ts") >= F.lit(str(a)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(b)).cast("timestamp_ntz"))))
        got |= {x.row_id: x.flag for x in part.collect()}
    assert got == want
    assert stories.copy_flags(stories.with_key(h.limit(0), labels.limit(0))).count() == 0


def test_flag_edge(spark):
    rows = [(1, T0, "a", "u", "t", "k"), (2, T0 + dt.timedelta(days=7), "a", "u", "t", "k"), (3, T0 + dt.timedelta(days=14, seconds=1), "a", "u", "t", "k"), (4, None, "a", "u", None, None)]
    df = spark.createDataFrame(rows, H + ", key string")
    assert {x.row_id: x.flag for x in stories.copy_flags(df).collect()} == {1: 0, 2: 2, 3: 0}


def test_paging_shows_every_row_once(spark):
    h = stories.copy_flags(stories.with_key(headlines(spark, 150, 3, 2), headlines(spark).limit(0).select("domain", F.col("title").alias("tail")))).cache()
    q, seen, pages = parse({"q": "story"}), 0, 0
    from dataclasses import replace

    while True:
        p = search.page(search.selected(h, q), q, size=20, window=60)
        pages += 1
        seen += p.used
        if p.cursor is None:
            break
        q = replace(q, cursor=p.cursor, skip=p.skip)
    assert seen == 150 and pages > 2


@pytest.mark.parametrize("seed", range(3))
def test_collapse_is_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i + 1, r.choice("abcdefgh"), T0, r.choice(["x", "y"]), f"u{i}", "t") for i in range(40)]
    groups, used = {}, 0
    for pos, k, _, d, u, _ in rows:
        if k not in groups and len(groups) == 5:
            break
        groups.setdefault(k, []).append((d, u))
        used += 1
    got = search.collapse(spark.createDataFrame(rows, "pos int, key string, ts timestamp_ntz, domain string, url string, title string"), 5).orderBy("story").collect()
    assert [[(x.domain, x.url), *((c.domain, c.url) for c in x.copies)] for x in got] == list(groups.values())
    assert sum(x.n for x in got) == used and [x.sites for x in got] == [len({d for d, _ in g}) for g in groups.values()]


def test_postings_equal_scan(spark):
    h = headlines(spark)
    for text in ("bridges story", "nurses OR trams", "el nino OR lodz about"):
        q = parse({"q": text})
        assert {x.row_id for x in postings.candidates(postings.postings(h), q).collect()} == {x.row_id for x in search.selected(h, q).collect()} != set()


def test_counts_shares_series(spark):
    rows = [("a", dt.date(2026, 8, 1), 0, 0, 0), ("a", dt.date(2026, 9, 1), 5, 6, 7), ("a", dt.date(2026, 10, 1), 5, 5, 5), ("z", dt.date(2026, 8, 1), 0, 0, 0)]
    s = spark.createDataFrame(rows, "series string, month date, stories long, outlets long, articles long")
    got = {x.series: x for x in archive.peaks(s).collect()}
    assert (got["a"].total, got["a"].peak_month, got["a"].peak, got["a"].last_month) == (10, dt.date(2026, 9, 1), 5, dt.date(2026, 10, 1)) and got["z"].first_month is None
    t = spark.createDataFrame([(dt.date(2026, 9, 1), 20), (dt.date(2026, 10, 1), 0)], "month date, stories long")
    assert sorted(x.share for x in archive.shares(s.where("series = 'a'"), t).collect()) == [0.0, 0.0, 25.0]
    assert archive.filled(s, "2026-07-01", "2026-10-01").count() == 8


def test_versions(spark):
    cols = H + ", seen timestamp_ntz, kind string"
    old = [(1, T0, "d", "u", "A", T0, "feed"), (2, T0, "d", "u", "B", T0, "feed")]
    new = [(3, T0, "d", "u", "A", T0, "feed"), (4, T0, "d", "u", "C", T0, "feed"), (5, T0, "d", "u", "D", T0 + dt.timedelta(1), "feed"), (6, T0, "d", "u", "C", T0, "sitemap"), (7, T0, "d", None, "X", T0, None), (8, T0, "d", "u", None, T0, "feed")]
    got = {x.row_id: x.version for x in ingest.new_versions(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols)).collect()}
    assert got == {4: 3, 5: 4, 6: 1, 7: 1}


def test_quiet(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=7 * i) for i in range(6)]
    rows = [(d, "dark", min(i, 3) * 700, days[min(i, 3)]) for i, d in enumerate(days)] + [(d, "thin", i * 700 if i < 4 else 2100 + i, d) for i, d in enumerate(days)] + [(d, "fine", i * 700, d) for i, d in enumerate(days)] + [(days[0], "gap", 1, days[0]), (days[2], "gap", 9000, days[2])]
    rep = {x.domain: x for x in quiet.report(spark.createDataFrame(rows, "day date, domain string, n long, last date")).collect()}
    assert {k: v.why for k, v in rep.items()} == {"dark": "dark", "thin": "thinning"} and rep["dark"].baseline == 700
    now, before = spark.createDataFrame([("a",), ("b",)], "domain string"), spark.createDataFrame([("b", dt.date(2026, 1, 1)), ("c", dt.date(2026, 1, 1))], "domain string, since date")
    assert {x.domain: x.state for x in quiet.compared(now, before, "2026-02-02").collect()} == {"a": "new", "b": "still", "c": "recovered"}


def test_collect_expressions(spark):
    urls = [" https://A.Example:80/p?utm_source=x&b=1%20é*~&c&ref=2&s1=%26&&mc_id=4#f", "http://www.b.co.uk", "ftp://x", None, "https://m.example/p/some-long-title-1a2b3c4d5e"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(collect.canonical_url(F.col("u")).alias("c"), collect.registrable(F.col("u")).alias("s"), collect.slug_title(F.col("u")).alias("t")).collect()
    assert [x.c for x in got] == ["https://a.example:80/p?b=1+%C3%A9%2A~&c=&s1=%26", "http://www.b.co.uk/", "", "", "https://m.example/p/some-long-title-1a2b3c4d5e"]
    assert [feeds.canonical(u) for u in urls] == [x.c for x in got]
    assert got[0].s == "a.example" and got[1].s == "b.co.uk" and got[4].t == "some long title"
    assert spark.range(1).select(collect.reactions(F.create_map(F.lit("x"), F.lit(-3).cast("long"))).alias("r")).first().r == 0
    state = spark.createDataFrame([("a", "ok", T0, "x")], "site string, status string, fetched timestamp_ntz, domain string")
    upd = spark.createDataFrame([("a", "error", T0 + dt.timedelta(1), None), ("b", "ok", T0, None)], state.schema)
    m = {x.site: x for x in collect.merge_state(state, upd, ["site"]).collect()}
    assert m["a"].fetched == T0 and m["a"].status == "error" and m["a"].domain == "x" and m["b"].fetched == T0
    cand = spark.createDataFrame([("d", "sitemap", i, f"u{i}", i == 1) for i in range(4)] + [("d", "sitemap", 9, "u0", False)], "domain string, kind string, place int, url string, ok boolean")
    assert {x.url for x in collect.chosen_candidates(cand).collect()} == {"u0", "u1"}


def test_unified_rebuild_and_dirty_days(spark):
    g = stories.copy_flags(stories.with_key(headlines(spark, 60), headlines(spark).limit(0).select("domain", F.col("title").alias("tail"))))
    staged = headlines(spark, 40, 9).withColumn("row_id", F.col("row_id") + 1000).withColumn("src", F.when(F.col("row_id") % 2 == 0, "feeds").otherwise("blogs")).withColumn("platform", F.lit("p")).withColumn("key", F.col("title"))
    u = ingest.unified(g, staged).cache()
    assert u.count() == 100 and u.where("src = 'blogs' and copy <> copy_news").count() == 0 and u.where("copy_news = 255 and src <> 'feeds'").count() == 0
    counts = ingest.day_counts(u)
    assert ingest.dirty_days(counts, counts, "2026-09-20", "2026-09-01").count() == 4
    fewer = counts.where("day <> date'2026-09-10'")
    assert {x.day.day for x in ingest.dirty_days(counts, fewer, "2026-09-12", "2026-09-05").collect()} == set(range(5, 13))


def test_streams(spark, tmp_path):
    h = headlines(spark, 120).orderBy("ts", "row_id")
    rows = h.collect()
    src = str(tmp_path / "in")
    for i in range(3):
        part = spark.createDataFrame(rows[i * 40 : i * 40 + 40], H).coalesce(1)
        part.write.mode("append").parquet(src)
    key = lambda df: df.withColumn("key", F.col("title"))
    for _ in range(2):  # the second run finds nothing new
        jobs.run(jobs.stream(spark, src, H, 1), jobs.flagged_batches(str(tmp_path / "out"), key), str(tmp_path / "ck")).awaitTermination()
        jobs.run(jobs.stream(spark, src, H, 1), jobs.source_states(str(tmp_path / "st")), str(tmp_path / "ck2")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 120
    assert {(x.domain, x.n) for x in jobs.read_states(spark, str(tmp_path / "st")).collect()} == {(x.domain, x.n) for x in archive.rollup(h, "domain").collect()}
    days = h.withColumn("day", F.to_date("ts"))
    t = str(tmp_path / "days")
    jobs.replace_days(days, t)
    one = days.where("day = date'2026-09-05'").limit(1)
    k = one.count()
    jobs.replace_days(one, t, ["2026-09-05", "2026-09-06"], k)
    now = spark.read.parquet(t)
    assert now.where("day = date'2026-09-05'").count() == k and now.where("day = date'2026-09-06'").count() == 0 and now.where("day = date'2026-09-07'").count() > 0
    with pytest.raises(RuntimeError):
        jobs.replace_days(one, t, None, k + 1)
    assert jobs.expire(spark, t, "2026-09-04") and spark.read.parquet(t).agg(F.min("day")).first()[0] >= dt.date(2026, 9, 4)
    n = spark.read.parquet(t).count()
    jobs.compact(spark, t, 1)
    assert spark.read.parquet(t).count() == n and len(spark.read.parquet(t).inputFiles()) == 1
    assert jobs.new_block(one, 0, str(tmp_path / "b")) and not jobs.new_block(one, 5, str(tmp_path / "b")) and jobs.new_block(days, 6, str(tmp_path / "b"))


def test_polling_and_listings(spark):
    board = spark.createDataFrame([(2, "tech", "a", "A", 5), (1, "news", "a", "AA", 7), (3, "tech", "a", None, None), (1, "x", "b", "B", None)], "place int, category string, subdomain string, name string, subscribers int")
    got = {x.subdomain: (x.name, x.subscribers, x.categories) for x in collect.leaderboard(board).collect()}
    assert got == {"a": ("AA", 7, "news, tech"), "b": ("B", 0, "x")}
    found = spark.createDataFrame([("d", "sitemap", "s1", 3, "ok"), ("d", "sitemap", "s2", 9, "ok"), ("d", "sitemap", "s3", 99, "http 403"), ("d", "feed", "f", 1, "ok"), ("e", "feed", "g", 0, "blocked")], "domain string, kind string, url string, items int, label string")
    assert {x.domain: (x.sitemap, x.feeds, x.blocked) for x in collect.best_sitemaps(found).collect()} == {"d": ("s2", 1, "http 403"), "e": (None, 0, "blocked")}
    day = lambda n: T0 + dt.timedelta(days=n)
    index = spark.createDataFrame([("changed", day(5)), ("same", day(1)), ("new", day(5)), ("old", day(-90)), ("gone", day(9))], "site string, lastmod timestamp_ntz")
    state = spark.createDataFrame([("changed", day(1), "", None, "ok"), ("same", day(1), "", None, "ok"), ("own", day(1), "x.example", day(0), "ok"), ("gone", day(1), "", None, "blocked")], "site string, lastmod timestamp_ntz, domain string, due timestamp_ntz, status string")
    now, horizon = F.lit(str(day(6))).cast("timestamp_ntz"), F.lit(str(day(-30))).cast("timestamp_ntz")
    assert {x.site: x.reason for x in collect.poll_queue(index, state, now, horizon).collect()} == {"changed": "changed", "new": "new", "own": "due"}
    feeds_ = spark.createDataFrame([("d", "https://d/search/?f=rss", "d", True), ("d", "https://x.d/feed", "x.d", True), ("e", "https://e/feed", "e", True), ("f", "https://f", "f", False)], "domain string, url string, host string, enabled boolean")
    assert sorted(x.group for x in collect.feed_groups(feeds_).collect()) == ["blox", "blox", "e"]
    caps = spark.createDataFrame([(f"c{i:02}", "u", "feed", "t") for i in range(5)] + [("c01", "u", "feed", "other")], "capture string, url string, kind string, title string")
    assert sorted((x.capture, x.title) for x in collect.capture_rows(caps, 2).collect()) == [("c00", "t"), ("c01", "other"), ("c02", "t"), ("c04", "t")]
    log = spark.createDataFrame([("a", "ok", day(0)), ("a", "error", day(5)), ("b", "304", day(5)), ("c", "error", day(5))], "feed string, label string, ts timestamp_ntz")
    assert {x.feed for x in collect.due(log, now, 48).collect()} == {"a", "c"}
    fetch = spark.createDataFrame([(304, None), (0, None), (None, None), (403, "x"), (503, "Just a moment..."), (503, "x"), (404, "Just a moment"), (200, " \n"), (200, None), (200, " <!DOCTYPE html>"), (200, "\ufeff<html>DataDome"), (200, "<rss>captcha, just a moment"), (301, "<rss>")], "http int, body string")
    want = ["304", "error", "error", "blocked", "blocked", "http 503", "http 404", "empty", "empty", "html", "blocked", "ok", "ok"]
    assert [x.o for x in fetch.select(collect.classify_fetch(F.col("http"), F.col("body")).alias("o")).collect()] == want


def test_collectors_selections(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    pages = spark.createDataFrame([("a", p, day(20 - p), 10) for p in range(6)] + [("b", 0, day(9), 10), ("b", 1, day(5), 10), ("b", 2, day(1), 10), ("c", 0, day(9), 4), ("c", 1, day(8), 10), ("d", 0, None, 0), ("d", 1, day(1), 10)], "site string, page int, oldest timestamp_ntz, posts int")
    since = spark.createDataFrame([("b", day(6)), ("d", None)], "site string, ts timestamp_ntz")
    got = sorted((x.site, x.page) for x in collect.pages_to_read(pages, since).collect())
    assert got == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("c", 0), ("d", 0)]
    listed = spark.createDataFrame([(f"f{i}", day(i).date(), f"v{i}") for i in range(12)], "file string, day date, lastmod string")
    state = spark.createDataFrame([("f9", "v9", "ok"), ("f8", "old", "ok"), ("f7", "v7", "error"), ("f6", "v6", "304")], "file string, lastmod string, status string")
    assert [x.file for x in collect.files_to_read(listed, state, str(day(10).date()), 5).collect()] == ["f5", "f7", "f8", "f10"]
    sites = spark.createDataFrame([("a", day(5), "ok", day(1)), ("b", day(9), "http 410", None), ("c", day(7), None, None), ("d", day(-9), "ok", None), ("e", day(8), "ok", None)], "site string, lastmod timestamp_ntz, status string, fetched timestamp_ntz")
    marks = spark.createDataFrame([("e", True), ("c", False)], "site string, done boolean")
    assert [x.site for x in collect.walk_queue(sites, marks, F.lit(day(0))).collect()] == ["c", "a"] and [x.site for x in collect.walk_queue(sites, marks, F.lit(day(0)), True).collect()] == ["c"]
    files_ = spark.createDataFrame([(f"{m}-{d}-{i}", dt.date(2026, m, d)) for m in (8, 9) for d in range(1, 8) for i in range(5)], "file string, day date")
    one, two = (sorted(x.file for x in collect.sampled_files(files_, 2, 3, 7).collect()) for _ in range(2))
    assert one == two and len(one) == 12 and one != sorted(x.file for x in collect.sampled_files(files_, 2, 3, 8).collect())
    names = spark.createDataFrame([("b",), ("a",), ("c",)], "name string")
    assert [x.name for x in collect.file_queue(names, True, 2).collect()] == ["c", "b"] and [x.name for x in collect.file_queue(names, False).collect()] == ["a", "b", "c"]
    lost = spark.createDataFrame([("a", 7), ("z", 9)], "site string, was long")
    assert {x.site: x.n for x in collect.lost_outlets(spark.createDataFrame([("a", 2)], "site string, n long"), lost).collect()} == {"a": 2, "z": None}


def test_mixed_pages_show_every_row_once(spark):
    plain = headlines(spark, 150, 3, 40).withColumn("ts", F.col("ts") - F.expr("INTERVAL 20 DAY")).withColumn("key", F.col("title"))
    uni = plain.where("ts >= '2026-09-01'").select("*", F.when(F.col("row_id") % 3 == 0, "blogs").when(F.col("row_id") % 3 == 1, "feeds").otherwise("gdelt").alias("src"), F.lit("").alias("platform"), F.lit(0).alias("copy_news"))
    for sort in ("newest", "oldest"):
        q = parse({"q": "", "src": "gdelt,feeds,blogs", "sort": sort})
        want = [(x.row_id, x.key) for x in search.mixed(plain, uni, q, 1000).orderBy("pos").collect()]
        assert len(want) == 150 and any(k.startswith("blogs\t") for _, k in want)
        shown, at = [], q
        while True:
            one = search.page(lambda n, at=at: search.mixed(plain, uni, at, n), at, 20, 60)
            shown += [x.row_id for x in search.mixed(plain, uni, at, one.used).orderBy("pos").collect()] if one.used else []
            if one.cursor is None:
                break
            at = replace(at, cursor=one.cursor, skip=one.skip)
        assert shown == [i for i, _ in want]
    late = parse({"q": "", "src": "feeds", "before": "20260820000000", "skip": "3"})
    assert late.reading() == [] and search.mixed(plain, uni, late, 5).count() == 0
    first = parse({"src": "gdelt,feeds", "before": "20260901000000", "skip": "3"}).reading()
    assert [(p.unified, k) for p, k in first] == [(True, 3), (False, 0)]


def test_rebuilt_days_and_self_check(spark):
    g = stories.copy_flags(stories.with_key(headlines(spark, 160), headlines(spark).limit(0).select("domain", F.col("title").alias("tail"))))
    staged = headlines(spark, 80, 9).withColumn("row_id", F.col("row_id") + 1000).withColumn("src", F.when(F.col("row_id") % 2 == 0, "feeds").otherwise("blogs")).withColumn("platform", F.lit("p")).withColumn("key", F.col("title"))
    u = ingest.unified(g, staged).cache()
    days = spark.createDataFrame([(dt.date(2026, 9, d),) for d in (9, 10, 15)], "day date")
    wrong = u.withColumn("copy_news", F.when(F.to_date("ts").isin(dt.date(2026, 9, 9), dt.date(2026, 9, 15)), 0).otherwise(F.col("copy_news")))
    got = {(x.src, x.row_id, x.copy, x.copy_news) for x in ingest.rebuilt(g, staged, wrong, days).collect()}
    assert got == {(x.src, x.row_id, x.copy, x.copy_news) for x in u.join(days, F.to_date("ts") == F.col("day")).collect()} and got
    ok = ingest.self_check(u, "2026-09-01", "2026-09-05").first()
    assert ok.rows > 50 and (ok.own_differ, ok.blogs_differ, ok.news_differ) == (0, 0, 0)
    bad = ingest.self_check(u.withColumn("copy", F.lit(1)), "2026-09-01", "2026-09-05").first()
    assert bad.own_differ > 0 and bad.early_differ > 0


def test_late_batch_is_flagged_among_its_history(spark):
    rows = headlines(spark, 200).withColumn("key", F.col("title")).cache()
    late = rows.where("row_id % 5 = 0")
    want = {x.row_id: x.flag for x in stories.copy_flags(rows).collect()}
    got = {x.row_id: x.flag for x in stories.copy_flags_of_batch(rows.where("row_id % 5 <> 0"), late).collect()}
    assert got == {k: want[k] for k in got} and len(got) == 40
    part = {x.row_id: x.flag for x in stories.backfilled(rows, "2026-09-10 00:00:00", "2026-09-14 00:00:00").collect()}
    assert part == {k: want[k] for k in part} and part


def test_poll_interval(spark):
    gaps = {"a": 1.0, "b.example": 10.0, "ü": 900.0, "": 20.0}
    got = {x.site: x.hours for x in collect.poll_interval(spark.createDataFrame(list(gaps.items()), "site string, gap_hours double")).collect()}
    want = {k: max(min(g * 0.5, 24), 3) * (0.8 + 0.4 * (zlib.crc32(k.encode()) % 1000 / 1000)) for k, g in gaps.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
