"""Problems 3, 4 and 6 against brute force, with nulls, ties, repeats, hot keys and empty tables."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from newslake.operators import history, late, ordered, skew

T0 = dt.datetime(2026, 9, 1)


@pytest.mark.parametrize("seed", range(4))
def test_value_runs_brute(spark, seed):
    r = random.Random(seed)
    hot = ["hot"] * 6
    rows = [(r.choice([*hot, "a", "b", "c", None]), r.choice(["x", "y", "y", None]), r.choice([*range(60), None])) for _ in range(r.choice([0, 5, 700]))]
    got = ordered.value_runs(spark.createDataFrame(rows, "k string, v string, at int"), F.col("k"), F.col("v"), F.col("at"))
    want = []
    by = defaultdict(list)
    for k, v, at in rows:
        if None not in (k, v, at):
            by[k].append((at, v))
    for k, x in by.items():
        runs = [(v, list(g)) for v, g in itertools.groupby(sorted(x), key=lambda p: p[1])]
        for i, (v, g) in enumerate(runs):
            want.append((k, v, g[0][0], runs[i + 1][1][0][0] if i + 1 < len(runs) else None, len(g)))
    key = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("seed", range(3))
def test_adjacent_copies_brute(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["hot"] * 5 + ["a", "b", "long" * 5000, "", None, f"u{i}"]), i) for i in r.sample(range(10_000), r.choice([0, 600]) if seed else 900)]
    got = ordered.adjacent_copies(spark.createDataFrame(rows, "k string, i long"), F.col("k"), F.col("i"))
    keep = {}
    for k, i in rows:
        keep[k] = min(i, keep.get(k, i))
    assert sorted(map(tuple, got.select("copy_id", "keep_id").collect())) == sorted((i, keep[k]) for k, i in rows if k is not None and i != keep[k])


def test_ledger_batches_equal_one_load(spark):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "p", "q"]), r.choice(["A", "B", "C"]), r.randrange(40)) for _ in range(120)]
    schema = "entity string, value string, seen long"
    ledger = history.load(spark.createDataFrame(rows[:40], schema), 1)
    for i, lo in enumerate((40, 80), 2):
        ledger = history.record(ledger, spark.createDataFrame(rows[:lo], schema), spark.createDataFrame(rows[lo : lo + 40], schema), i)
    cols = ["entity", "value", "valid_from", "valid_to"]
    once = history.periods(spark.createDataFrame(rows, schema))
    full = sorted(map(str, once.select(*cols).collect()))
    assert sorted(map(str, history.as_of(ledger, 3).select(*cols).collect())) == full
    assert sorted(map(str, history.as_of(ledger, 1).select(*cols).collect())) == sorted(map(str, history.periods(spark.createDataFrame(rows[:40], schema)).select(*cols).collect()))
    assert ledger.where("recorded_to is not null").count() > 0


def test_ledger_late_update_splits(spark):
    schema = "entity string, value string, seen long"
    log = spark.createDataFrame([("e", "A", 10), ("e", "A", 30)], schema)
    ledger = history.load(log, 100)
    ledger = history.record(ledger, log, spark.createDataFrame([("e", "B", 20)], schema), 200)
    got = {(x.value, x.valid_from, x.valid_to) for x in history.as_of(ledger, 200).collect()}
    assert got == {("A", 10, 20), ("B", 20, 30), ("A", 30, None)}
    assert {(x.value, x.valid_from, x.valid_to) for x in history.as_of(ledger, 150).collect()} == {("A", 10, None)}
    assert [x.value for x in history.as_of(ledger, 200, 25).collect()] == ["B"]


def test_title_periods(spark):
    s = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [
        (1, "HTTPS://www.A.example/x/", " One  title ", s(1), "feed", 9), (2, "http://a.example/x", "One title", s(2), "feed", 9), (3, "a.example/x", "Two", s(5), "feed", 9),
        (4, "a.example/x", "   ", s(6), "feed", 9), (5, "a.example/x", "One title", s(7), "feed", 9), (6, "a.example/x", "Only", s(1), "sitemap", 9), (7, None, "X", s(1), "feed", 9), (8, "a.example/x", None, s(9), None, 9),
    ]
    df = spark.createDataFrame(rows, "row_id long, url string, title string, seen timestamp_ntz, kind string, page int")
    e = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    got = sorted(map(tuple, history.changed_titles(history.loaded_by_days(df)).collect()))
    assert got == [("a.example/x", "feed", e + 60, e + 300), ("a.example/x", "feed", e + 300, e + 420), ("a.example/x", "feed", e + 420, 0)]
    assert history.changed_titles(history.loaded_by_days(df.limit(0))).count() == 0


def test_site_totals(spark):
    r = random.Random(1)
    sites = ["www.Hot.example."] * 5 + ["hot.example"] * 3 + ["b.example", "c.example", None]
    rows = [(r.choice(sites), T0 + dt.timedelta(minutes=r.randrange(99)), r.choice(["t1", "t1", "T1", "", None, f"u{i}"]), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "domain string, ts timestamp_ntz, title string, site int")
    want = defaultdict(list)
    for d, ts, t, _ in rows:
        want[d and {"www.Hot.example.": "hot.example"}.get(d, d)].append((ts, t))
    got = {x.site: (x.n, x.first_ts, x.last_ts, x.titles) for x in skew.site_totals(df).collect()}
    assert got == {k: (len(v), min(t for t, _ in v), max(t for t, _ in v), len({x for _, x in v if x is not None})) for k, v in want.items()}
    n = Counter(d and {"www.Hot.example.": "hot.example"}.get(d, d) for d, *_ in rows)
    assert {x.site for x in skew.hot_sites(df, 0.09).collect()} == {k for k, v in n.items() if k and v > 0.09 * 500}
    assert skew.site_totals(df.limit(0)).count() == 0 and skew.hot_sites(df.limit(0)).count() == 0


def test_late_events(spark):
    d = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        (1, d(1), d(2), "a.example/1", "feed", "A.example"), (2, d(1), d(30), "a.example/2", "feed", "a.example"), (3, d(1), d(24 + 72), "a.example/3", "feed", "a.example"),
        (4, d(1), d(95.99), "a.example/4", "feed", "a.example"), (5, None, d(50), "a.example/5", "feed", "a.example"), (6, dt.datetime(1970, 1, 1), d(3), "a.example/6", "feed", "a.example"),
        (7, d(9), d(3), "a.example/7", "feed", "a.example"), (8, d(1), d(99), "https://www.A.example/1/", "feed", "a.example"), (9, d(1), d(24), "a.example/1", "sitemap", "a.example"),
        (10, d(1), None, "a.example/9", "feed", "a.example"), (11, d(1), d(25), None, None, None),
    ]
    df = spark.createDataFrame(rows, "row_id long, ts timestamp_ntz, seen timestamp_ntz, url string, kind string, domain string").withColumn("period", F.lit("clash"))
    events = late.first_events(df, "t")
    changes = late.deltas(events)
    got = {x.id: x.outcome for x in late.ruled(events, changes).collect()}
    assert got == {2: "corrects", 3: "dropped", 4: "corrects", 9: "corrects", 11: "corrects"}
    assert {x.id for x in late.ruled(events, late.deltas(events, 30)).where("outcome = 'corrects'").collect()} == {2, 9, 11}
    assert late.ruled(events.limit(0), late.deltas(events.limit(0))).count() == 0
    final = {(x.site, x.period): x.n for x in changes.groupBy("site", "period").agg(F.sum("n").alias("n")).collect()}
    want = Counter((x.site, x.period) for x in events.collect() if got.get(x.id) != "dropped")
    assert final == dict(want)
    empty = late.apply_deltas(changes.limit(0), changes)
    v = changes.agg(F.min("version")).first()[0]
    step = late.apply_deltas(late.apply_deltas(changes.limit(0), changes.where(F.col("version") <= v)), changes.where(F.col("version") > v))
    assert sorted(map(str, empty.collect())) == sorted(map(str, step.collect()))
