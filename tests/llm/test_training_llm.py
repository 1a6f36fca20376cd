"""The llm operators against brute force or exact round trips, with nulls, repeats, ties, hot groups and empty tables."""

import datetime as dt
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newslake.llm import batches, copies, language, lines, mixing, packing, queries, sentences, tokens

T0 = dt.datetime(2026, 9, 1)
DOCS = "doc_id long, text string, lang string, source string"


def key(text):
    return "".join(c for c in text.upper() if c.isalnum())


def test_copies(spark):
    r = random.Random(2)
    titles = ["One  two", "ONE TWO!", "one​two", "Other", "", "--", None] + ["Hot story 9"] * 8
    rows = [(i, r.choice(["www.A.example", "a.example.", "b.example", None]), r.choice(titles), 1, "x") for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, domain string, title string, k int, record string")
    groups = defaultdict(list)
    for i, d, t, *_ in rows:
        if t and key(t):
            groups[(re.sub(r"^www\.|\.$", "", (d or "").lower()), key(t))].append(i)
    want = sorted((min(g), i) for g in groups.values() for i in g if i != min(g))
    assert sorted((x.keep_id, x.copy_id) for x in copies.copies(copies.headline_records(df)).collect()) == want
    assert sorted((x.keep_id, x.copies) for x in copies.collapsed(copies.headline_records(df)).collect()) == sorted((min(g), len(g)) for g in groups.values())
    assert copies.copies(copies.headline_records(df.limit(0))).count() == 0


def test_line_records(spark):
    rows = [(1, '{"a":"x y","b":"2"}'), (2, '{ "b" : "2", "a":"X-Y" }'), (3, '{"a":"x y"}'), (4, '{"a":"x y","b":"2"'), (5, None), (6, '{"a":"..."}'), (7, "{}"), (8, '{"a":"xy","b":null}')]
    got = copies.copies(copies.line_records(spark.createDataFrame(rows, "line_id long, line string"))).collect()
    assert [(x.keep_id, x.copy_id) for x in got] == [(1, 2)]


def brute_lines(rows):
    """(id, pos) of lines that 4 rows and 5 percent of their source hold."""
    held, total = defaultdict(set), Counter()
    only = lambda s: "".join(c for c in s.upper() if c.isalpha())
    for i, t, s in rows:
        total[s] += 1
        for x in (t or "").split("\n"):
            if only(x):
                held[s, only(x)].add(i)
    return {(i, p) for i, t, s in rows if t is not None for p, x in enumerate(t.split("\n"), 1) if only(x) and len(held[s, only(x)]) >= max(4, 0.05 * total[s])}


def doc_lines(seed, n):
    r = random.Random(seed)
    pool = ["Sign up now!", "SIGN UP NOW", "Page 3 of 4", "", "* * *", "By X"] + [f"text {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)]
    return [(i, None if i % 29 == 0 else "\n".join(r.choice(pool[:6] if r.random() < 0.2 else pool) for _ in range(r.randrange(1, 7))), r.choice(["hot.example"] * 5 + ["b.example", None])) for i in range(n)]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_repeated_lines(spark, limit, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)  # 0: the salted join
    data = doc_lines(1, 300)
    df = spark.createDataFrame([(*x, 7) for x in data], "doc_id long, text string, source string, _found int")
    rows = lines.document_rows(df)
    found = lines.repeated(lines.count_lines(rows))
    want = brute_lines([(i, t, s or "") for i, t, s in data])
    assert want and {(x.id, x.pos) for x in lines.found_places(rows, found).collect()} == want
    clean = {x.id: x.text for x in lines.cleaned(rows, found).collect()}
    assert clean == {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n"), 1) if (i, p) not in want) for i, t, _ in data}


def test_lines_incremental(spark):
    data = doc_lines(3, 240)
    df = lambda x: lines.document_rows(spark.createDataFrame(x, "doc_id long, text string, source string"))
    a, b = df(data[:120]), df(data[120:])
    first = lines.count_lines(a)
    both = lines.merge_counts(first, lines.count_lines(b))
    assert sorted(map(str, both.collect())) == sorted(map(str, lines.count_lines(df(data)).select(*both.columns).collect()))
    before, after = lines.repeated(first), lines.repeated(both)
    crossed = lines.crossings(before, after)
    old = {x.id: x.text for x in lines.cleaned(a, before).collect()}
    old |= {x.id: x.text for x in lines.rebuild(a, crossed, after).collect()}
    assert old == {x.id: x.text for x in lines.cleaned(a, after).collect()}
    assert lines.crossings(after, after).count() == 0
    assert lines.found_places(a.limit(0), after.limit(0)).count() == 0


def test_cleaned_query_takes_deltas(spark, tmp_path, monkeypatch):
    data = doc_lines(7, 200)
    spark.createDataFrame(data, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    merged, merge = [], lines.merge_counts
    monkeypatch.setattr(lines, "merge_counts", lambda *x: merged.append(1) or merge(*x))
    got = {x.id: x.text for x in queries.p5_cleaned(spark, str(tmp_path)).collect()}
    rows = lines.document_rows(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert merged and got == {x.id: x.text for x in lines.cleaned(rows, lines.repeated(lines.count_lines(rows))).collect()}
    assert got == {x.id: x.text for x in lines.by_deltas([rows.where(f"id % 3 = {k}") for k in range(3)]).collect()}


def test_title_pieces(spark):
    rows = [(i, "a.example", f"Story number {'abcdefgh'[i]} | A​ Daily", None) for i in range(6)] + [(9, "a.example", None, None), (10, None, " - ", None)]
    df = spark.createDataFrame(rows, "row_id long, domain string, title string, url string")
    t = lines.title_rows(df)
    assert {(x.id, x.pos) for x in lines.found_places(t, lines.repeated(lines.count_lines(t))).collect()} == {(i, 2) for i in range(6)}


def test_cleaned_titles(spark):
    rows = [(i, "a.example", f"A Daily - Story {'abcdefgh'[i]} – part two | more", None) for i in range(6)] + [(7, "a.example", "A  DAILY", None), (8, "a.example", None, None), (9, "b.example", "A Daily - x", None)]
    rows[5] = (5, "a.example", "Alone | A Daily — told", None)
    df = spark.createDataFrame(rows, "row_id long, domain string, title string, url string")
    got = {x.id: x.text for x in lines.cleaned_titles(df, lines.repeated(lines.count_lines(lines.title_rows(df)))).collect()}
    assert got == {**{i: f"Story {'abcde'[i]}" for i in range(5)}, 5: "Alone — told", 7: "", 8: None, 9: "A Daily - x"}


def test_known_stories(spark):
    verbs, places = ["opens", "closes", "sells", "plans"], [f"{a}{b}town" for a in "BDFGKLMNPR" for b in ("a", "e", "i", "o", "u")]
    people = [f"{a}{b}sen" for a in "BDFGK" for b in ("ar", "er", "or")]
    r = random.Random(4)
    heads = [(i, "s.example", f"Mayor {r.choice(people)} {r.choice(verbs)} {100 + i % 300} new homes near {places[i % 50]} after long talks | S Daily", T0) for i in range(1, 500)]
    base = heads[50][2].split(" |")[0]
    w = base.split()
    same = [base.upper() + " | S DAILY", "After long talks, " + " ".join(w[:8]), base.replace("homes", "hoems"), "Update: " + base.replace("long", "lengthy"), base.replace("near", "n​ear") + " - S Daily"]
    other = [base.replace(w[3], str(int(w[3]) + 1)) if w[3].isdigit() else base, base.replace(w[7], "Zuztown"), "", None, "- | -"]
    inc = [(1000 + i, 1, "t.example", t, T0) for i, t in enumerate([*same, *other])] + [(2000, 2, "t.example", "Quite new words about 77 ships", T0), (2001, 3, "u.example", "QUITE NEW WORDS about 77 ships!", T0), (2002, 3, None, "Quite new words about 78 ships", T0)]
    got = batches.known_stories(spark.createDataFrame(heads, "row_id long, domain string, title string, ts timestamp_ntz"), spark.createDataFrame(inc, "row_id long, batch int, domain string, title string, ts timestamp_ntz"))
    found = {x.in_id: x.kept_id for x in got.collect()}
    assert {k: found.get(k) for k in range(1000, 1005)} == dict.fromkeys(range(1000, 1005), 51)
    assert 1006 not in found and not found.keys() & {1007, 1008, 1009, 2000, 2002} and found[2001] == 2000
    empty = spark.createDataFrame([], "row_id long, batch int, domain string, title string")
    assert batches.known_stories(empty, empty).count() == 0


def _pairs(spark, posted, batch):
    """All pairs of two small tables that verification accepts, without any key."""
    a = posted.select(F.col("form").alias("a"), F.col("first_id").alias("a_id"), "figs", "names", F.col("loose").alias("a_loose"), F.col("anchor").alias("a_anchor"), F.col("rare").alias("a_rare"))
    b = batch.select(F.col("form").alias("b"), F.col("figs").alias("b_figs"), F.col("names").alias("b_names"), F.col("loose").alias("b_loose"), F.col("rare").alias("b_rare"))
    hit = a.crossJoin(b).where("figs = b_figs and names = b_names").where((F.col("a") == F.col("b")) | batches._same_story())
    return {x.b: x.i for x in hit.groupBy("b").agg(F.min("a_id").alias("i")).collect()}


def test_probe_against_brute_force(spark):
    """The index loses no pair that verification accepts, whatever figures, names, misspellings and new words they have."""
    r = random.Random(9)
    words = ["plain", "words", "about", "harbour", "council", "nurses", "winter", "report", "library", "protest"]
    known = dict.fromkeys(words, False) | {"barsen": True, "dorsen": True}

    def slip(w):
        i = r.randrange(len(w) - 1)
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + "x" + w[i:]])

    def title():
        ws = [slip(w) for w in r.sample(words, r.choice([2, 3, 5]))] + r.sample(["kivutown", "loratown"], r.choice([0, 1, 2])) + r.sample(["barsen", "dorsen"], r.choice([0, 0, 1]))
        ws += r.sample(["additional", "schemes", "quarrels"], r.choice([0, 0, 1, 2])) + r.choice([[], ["7"], ["8"], ["8", "9"]])
        return " ".join(sorted(set(ws)))

    old, new = ({title() for _ in range(250)} for _ in range(2))
    frame = lambda fs: spark.createDataFrame([(f, i, f) for i, f in enumerate(sorted(fs))], "form string, first_id long, text string")
    posted, batch = batches.segmented(frame(old), known).cache(), batches.segmented(frame(new), known).cache()
    got, want = {x.form: x.first_id for x in batches.probe(posted, batch).collect()}, _pairs(spark, posted, batch)
    assert got == want and len(got) > 50


def test_substrings_meet_segments():
    """Strings within SLIPS edits share a segment, against all pairs."""
    r = random.Random(3)
    texts = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(160)})
    for a in texts:
        cut = {(len(a), i, a[s : s + n]) for i, (s, n) in enumerate(batches.cuts(len(a)))}
        assert all(cut & set(batches.substrings(b)) for b in texts if batches.edits(a, b) <= batches.SLIPS)
    assert batches.edits("unpiad", "unpaid") == 2 and batches.edits("abcdef", "fedcba") == 3


def test_a_misspelling_is_no_titles_only_key(spark):
    pairs = [("5 bartown mayor unpiad", "5 bartown mayor unpaid"), ("7 late mayor unpiad", "7 late mayor unpaid"), ("8 9 unpiad", "8 9 unpaid"), ("12", "12")]
    common = {"bartown": True, "mayor": False, "unpaid": False, "late": False}
    frame = lambda k: spark.createDataFrame([(p[k], 10 * k + i, p[k]) for i, p in enumerate(pairs)], "form string, first_id long, text string")
    got = {x.form: x.first_id for x in batches.probe(batches.segmented(frame(0), common), batches.segmented(frame(1), common)).collect()}
    assert got == {b: i for i, (_, b) in enumerate(pairs)}


def test_packing_round_trip(spark):
    r = random.Random(1)
    docs = [(i, None if i == 3 else "" if i == 4 else "Title\n" + "word " * r.choice([1, 30, 200, 900, 5000]), "en", "s") for i in range(150)] + [(7000, "x" * 3, "en", "s")]
    df = spark.createDataFrame(docs, DOCS).withColumn("tokens", F.lit("clash"))
    placed = packing.containers(df, capacity=512, segments=5, loss_limit=500, shard=40)
    got = placed.collect()
    count = {x.doc_id: x.tokens for x in tokens.count_tokens(df).collect()}
    per, pieces = defaultdict(list), defaultdict(list)
    for x in got:
        per[x.container].append(x)
        pieces[x.doc_id].append(x)
    assert pieces.keys() == count.keys()
    for x in per.values():
        assert sum(p.tokens for p in x) <= 512 and len(x) <= 5 and sum(p.loss for p in x) <= 500
        spans = sorted((p.place, p.place + p.tokens) for p in x)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    for i, x in pieces.items():
        x.sort(key=lambda p: p.piece)
        assert sum(p.tokens for p in x) == count[i] and [p.first_token for p in x] == list(np.cumsum([0] + [p.tokens for p in x])[:-1])
        assert len(x) == 1 or count[i] > 500
    assert packing.containers(df.limit(0)).count() == 0


def test_instruction_limits_bind(spark):
    r = random.Random(5)
    docs = [(i, "Ask me\n" + "word " * r.choice([3, 3, 40, 300, 700]), "en", "s") for i in range(300)]
    got = packing.containers(spark.createDataFrame(docs, DOCS), segments=12, loss_limit=1024).toPandas().groupby("container").agg({"tokens": "sum", "loss": "sum", "doc_id": "count"})
    assert got.tokens.max() <= 2048 and got.loss.max() <= 1024 and got.doc_id.max() <= 12
    assert (got.loss > 1000).any() and (got.doc_id == 12).any()


def test_pack_fills(spark):
    r = np.random.default_rng(0)
    t = r.integers(1, 1500, 2000)
    box = packing.pack(t, t // 2, (2048, 64, 2048))
    assert np.bincount(box, t).max() <= 2048 and t.sum() / ((box.max() + 1) * 2048) > 0.98


def test_tokens_add_up(spark):
    texts = ["Head line  \n\n rest of it", "  \nlead\nx", "one", "a\n", "Ünï \n 12 ok", None, ""]
    got = {x.doc_id: (x.tokens, x.loss) for x in tokens.count_tokens(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)).collect()}
    enc = tokens.encoding(tokens.TOKENIZER)
    assert {i: n for i, (n, _) in got.items()} == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert all(0 <= v <= n for n, v in got.values())


def test_mixture(spark):
    docs = [(i, "word " * (i % 40 + 1), "en", ["big", "mid", "small"][0 if i % 10 < 7 else 1 if i % 10 < 9 else 2]) for i in range(600)] + [(900, None, "en", "big"), (901, "x", "en", None)]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("none", 0.0, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mixture(df, targets)
    rep = {x.source: x for x in report.collect()}
    for s, share, most in (("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4)):
        assert abs(rep[s].reached_share - share) < 0.01 and rep[s].most_repeats <= most
    size = {x.doc_id: x.tokens for x in tokens.count_tokens(df).collect()}
    got = chosen.collect()
    assert len({x.doc_id for x in got}) == len(got) and all(x.tokens == size[x.doc_id] for x in got)
    assert sorted((x.doc_id, x.repeats) for x in got) == sorted((x.doc_id, x.repeats) for x in mixing.mixture(df, targets)[0].collect())
    assert {(x.doc_id, x.repeats) for x in got} != {(x.doc_id, x.repeats) for x in mixing.mixture(df, targets, seed=1)[0].collect()}
    _, big = mixing.mixture(df, targets, total=10**6)
    assert {x.source: x.tokens for x in big.collect() if x.source == "small"}["small"] == 4 * sum(n for i, n in size.items() if i < 600 and i % 10 == 9)
    assert mixing.mixture(df.limit(0), targets)[0].count() == 0


EN = ["The mayor opened the new bridge in the morning and said that it was late", "Nobody wanted to answer the question about the cost of the school", "Two hundred people came to the meeting after the long talks"]
DE = ["Der Bürgermeister hat am Morgen die neue Brücke eröffnet und sagte nichts", "Niemand wollte auf die Frage nach den Kosten der Schule antworten", "Zweihundert Menschen kamen nach langen Gesprächen zu der Sitzung"]
RU = ["Мэр города утром открыл новый мост и сказал что уже поздно", "Никто не захотел отвечать на вопрос о стоимости школы"]


def labelled(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang, pool = r.choice([("en", EN), ("de", DE), ("ru", RU)])
        out.append((r.choice(["en", "de"]) if r.random() < 0.1 else lang, " ".join(r.choice(pool).replace("neue", r.choice(["neue", "alte", "grosse"])).replace("new", r.choice(["new", "old"])) + "." for _ in range(4)), lang))
    return out


def test_language_held_out():
    model = language.fit([(x, t) for x, t, _ in labelled(120, 1)])
    test = labelled(80, 2)
    seg = language.segments([t for _, t, _ in test])
    lang, sure = model.classify(seg)
    true = np.array([t[2] for t in test], object)[seg.text]
    clear = seg.n >= language.LEAST_LATIN
    assert (lang == true)[clear].mean() > 0.97 and sure[clear].mean() > 0.3
    slug = language.segments(["zweihundert menschen kamen nach langen gesprachen zu der sitzung", "nobody wanted to answer the question"])
    assert model.classify(slug)[0].tolist() == ["de", "en"]


def test_automaton_counts_longest_matches():
    r = random.Random(3)
    text = [r.randrange(4) for _ in range(300)]
    a = language.Automaton()
    a.extend(text)
    s = "".join(map(str, text))
    for _ in range(40):
        z = "".join(str(r.randrange(5)) for _ in range(60))
        i = n = 0
        while i < len(z):
            k = 1
            while i + k <= len(z) and z[i : i + k] in s:
                k += 1
            n, i = n + 1, i + max(1, k - 1)
        flat = language._Flat([a.packed()])
        seg = language.Segments(*[np.zeros(1, np.int64)] * 5, np.array([int(c) for c in z], np.uint8), np.zeros(1, np.int64), np.array([len(z)]))
        assert abs(language.phrases(flat, seg, np.array([0]))[0, 0] - a.phrases([int(c) for c in z])) == 0
        assert abs(a.phrases([int(c) for c in z]) - n) <= z.count("4")  # an unknown symbol may end the phrase before it


def test_stretches_and_cases(spark):
    train = [(i, t, x, f"s{i % 9}.example") for i, (x, t, _) in enumerate(labelled(150, 5))]
    mixed = [(900, EN[0] + ". " + RU[0] + ".", "en", "z.example"), (901, DE[1] + ".", None, "z.example"), (902, None, "en", "z.example"), (903, "", None, "z.example"), (904, "...", "xx", "z.example"), (905, EN[1] + ".", "en-GB", "z.example")]
    docs = spark.createDataFrame(train + mixed, DOCS).withColumn("letters", F.lit(1))
    posts = spark.createDataFrame([(1, EN[0], DE[2], "en"), (2, "nobody wanted to answer the question", None, "deu"), (3, None, None, None), (4, DE[0], DE[1], "German")], "row_id long, title string, subtitle string, lang string")
    heads = spark.createDataFrame([(1, EN[2]), (2, DE[2]), (3, RU[1]), (4, None), (5, " ")], "row_id long, title string")
    got = {(x.tbl, x.id, x.lang) for x in language.found_languages(docs, posts, heads).collect()}
    assert {x for x in got if x[0] == "documents" and x[1] >= 900} == {("documents", 900, "en"), ("documents", 900, "ru"), ("documents", 901, "de")}
    assert {x for x in got if x[0] == "blogs_posts"} == {("blogs_posts", 1, "en"), ("blogs_posts", 1, "de"), ("blogs_posts", 2, "en")}
    assert {x for x in got if x[0] == "collect_headlines"} == {("collect_headlines", 2, "de"), ("collect_headlines", 3, "ru")}
    model, rows = language.fit_model(docs)
    spans = sorted(language.stretches(rows, model).where("id = 900").collect())
    assert [(x.lang, mixed[0][1][x.start : x.stop]) for x in spans] == [("en", EN[0]), ("ru", RU[0])] and all(0 < x.confidence <= 1 for x in spans)


def test_fit_sample_is_of_400_a_language(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.lit("x").alias("text"))
    drawn = Counter(x for x, _ in language.labelled_sample(rows, F.col("lang")))
    assert all(330 <= drawn[x] <= 470 for x in ("en", "de"))


def test_stretches_of_all_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, x, f"s{i % 9}.example") for i, (x, t, _) in enumerate(labelled(150, 5))], DOCS)
    posts = spark.createDataFrame([(1, EN[0], DE[2], "en"), (2, None, None, None)], "row_id long, title string, subtitle string, lang string")
    heads = spark.createDataFrame([(1, EN[2]), (2, DE[2]), (3, None)], "row_id long, title string")
    for name, df in (("documents", docs), ("blogs_posts", posts), ("collect_headlines", heads)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.p1_stretches(spark, str(tmp_path)).collect()
    assert {x.tbl for x in got} == {"documents", "blogs_posts", "collect_headlines"} and all(0 < x.confidence <= 1 for x in got)
    assert sorted((x.id, x.lang, x.start, x.stop) for x in got if x.tbl == "blogs_posts") == [(1, "de", len(EN[0]) + 1, len(EN[0]) + 1 + len(DE[2])), (1, "en", 0, len(EN[0]))]
    assert sorted((x.id, x.lang) for x in got if x.tbl == "collect_headlines") == [(1, "en"), (2, "de")]


def corpus(seed, n):
    r = random.Random(seed)
    names = [a + b + "sen" for a in ("Bar", "Dor", "Fal", "Gim", "Kel") for b in ("i", "o", "a", "u")]
    clauses = ["The old bridge is 3.5 km away.", "It closed last year.", "Nobody came to the meeting.", "Was it late?", "They moved to Mt. {} in spring.", "He told us that Dr. {} was at home.", "“We waited. Nobody came,” said Mr. {} in the hall.", "“Stop!” she shouted.", "Only {} knew the way."]
    out = []
    for _ in range(n):
        text = []
        for _ in range(r.randrange(1, 4)):
            text.append([c.format(r.choice(names)) for c in (r.choice(clauses) for _ in range(r.randrange(1, 5)))])
        out.append(text)
    return out


def test_sentences_held_out(spark):
    model = sentences.fit(["\n".join(" ".join(x) for x in t) for t in corpus(1, 1500)])
    ok = total = 0
    for t in corpus(2, 200):
        for x in t:
            want = [y for c in x for y in (["“We waited.", c[len("“We waited. ") :]] if c.startswith("“We") else [c])]
            line = " ".join(x)
            got = [line[a:b] for a, b in model.split(line)]
            ok += sum((Counter(got) & Counter(want)).values())
            total += max(len(got), len(want))
    assert ok / total > 0.97
    text = "  A title without a stop \n\n* * *\nOne here. Two there?  Three!\n為何這麼晚？沒有人回答。「走吧。」他說。"
    docs = spark.createDataFrame([(1, text, None, None), (2, None, None, None), (3, "", None, None), (4, "x" * 300_000, None, None)], DOCS)
    got = [(x.doc_id, x.start_pos, x.end_pos) for x in sentences.sentences(docs, model).collect()]
    assert [text[a:b] for i, a, b in sorted(got) if i == 1] == ["A title without a stop", "One here.", "Two there?", "Three!", "為何這麼晚？", "沒有人回答。", "「走吧。」他說。"]
    assert (4, 0, 300_000) in got and not [g for g in got if g[0] in (2, 3)]
    assert sentences.sentences(docs.limit(0)).count() == 0


def test_sentence_counts_are_of_all_documents(spark):
    texts = ["\n".join(" ".join(x) for x in t) for t in corpus(3, 3200)] + [f"판사는 학교 {i}곳을 거부했다. 시장은 새 주택 {i}채를 약속했다." for i in range(4)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    got, want = sentences.fit_model(docs), sentences.fit(texts)
    for part in ("right", "right_any", "right_shape", "left", "left_shape"):
        a, b = getattr(got, part), getattr(want, part)
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a), part
    assert got.starts == want.starts and sentences.fit_model(docs.limit(0)).right == {}


def test_sentence_words_are_known_at_any_size(spark):
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(["\n".join(" ".join(x) for x in t) for t in corpus(4, 40)] + ["Zarbo sat\nZarbo ran\nWe met him. Quill left. It rained. Quill ran.", "Zarbo hid"])], DOCS)
    # 16 million words in lines of their own, which add only the word "a" and their first
    letter = lambda x: F.chr(x % 26 + 97)
    many = spark.range(320).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("L"), letter(F.col("id")), letter(F.floor(F.col("id") / 26)), F.repeat(F.lit(" a"), 50_000)).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    small, large = sentences.fit_model(docs), sentences.fit_model(docs.union(many))
    assert {"Zarbo", "Quill"} & set(small.starts) == {"Zarbo"} and "Quill" in small.right and "zarbo" in small.right_any
    assert set(large.starts) >= set(small.starts) and all(getattr(large, x).keys() >= getattr(small, x).keys() for x in ("left", "right", "right_any"))


def test_sentence_lines_equal_but_for_any_figures(spark):
    texts = [f"The old mill sold {x} chairs. Nobody came." for x in ("7", "٣", "𝟏", "𝟐𝟑", "𑁧")]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    got, want = sentences.fit_model(docs), sentences.fit(texts)
    assert got.right_shape == want.right_shape and got.left_shape == want.left_shape


def test_sentence_events_word_by_word():
    r = random.Random(6)
    tokens = ["a", "Bo", "c.", "D!", "–", "“Hm.”", "7", "x\xa0»", "字。字", "?", "\u3000", "ab\tc", "Ü…", "_"]
    lines = [x for _ in range(300) if (x := " ".join(r.choice(tokens) for _ in range(r.randrange(1, 9))).strip()) and sentences._ALNUM.search(x)]
    want = Counter()
    for line in lines:
        at = {b for _, b, _, _ in sentences.gaps(line)}
        found = [(m.start(), m[0]) for m in re.finditer(r"\S+", line)]
        for (_, x), (b, y) in zip(found, found[1:]):
            if b not in at and sentences._ALNUM.search(x) and sentences._ALNUM.search(y):
                want[sentences._right_key(y).lower()] += 1
    got = sentences.counted(lines)
    one_by_one = sum((sentences.counted([x]) for x in lines), Counter())
    assert {k[1]: n for k, n in got.items() if k[0] == "mid_any"} == want and got == one_by_one
    assert sum(n for k, n in got.items() if k[0] == "start_any") == sum(n for k, n in got.items() if k[0] == "end") == len(lines)


def test_held_sentence_events_are_bounded():
    events = sentences.Events()
    for i in range(40):
        events.add(["字" * 800_000 + chr(0x4E00 + i)])
    assert events.full() and len(events) < 100


def test_words_as_a_mapping():
    r = random.Random(5)
    want = {"".join(r.choice("aβ字😀.") for _ in range(r.randrange(6))): r.random() for _ in range(500)}
    got = sentences.Words(pa.chunked_array([pa.array(list(want)[:200], pa.string()), pa.array(list(want)[200:], pa.string())]), np.array(list(want.values())))
    got = pickle.loads(pickle.dumps(got))
    assert got == want and len(got) == len(want) and "b" not in got and got.get("b", 2.0) == 2.0 and got.get("b") is None
    assert sentences.Words(pa.chunked_array([], pa.string()), np.array([])) == {}


def test_batch_by_batch_against_brute_force(spark):
    """Labels and words come from the history alone; each batch meets it and the batches before, as all pairs do."""
    r = random.Random(12)
    places = [f"{a}{b}ville" for a in "BDFGKLMNPRST" for b in ("a", "e", "i", "o", "u")]
    tell = lambda i: f"Mayor {r.choice(['Barsen', 'Dorsen', 'Falsen'])} {r.choice(['opens', 'closes'])} {i % 40 + 10} new homes near {places[i % 60]} after talks"
    rows = [(i, i // 100, "s.example", tell(r.randrange(90)) if i % 3 else tell(r.randrange(90)).replace("new", r.choice(["nwe", "brand new"])).upper()) for i in range(1, 420)]
    df = spark.createDataFrame(rows, "row_id long, batch int, domain string, title string")
    got = {x.in_id: x.kept_id for x in batches.known_stories(df.where("row_id <= 200"), df.where("row_id > 200")).collect()}
    stored = batches.store(df.where("row_id <= 200"))
    all_ = batches.forms(df, stored.labels, stored.heads).cache()
    form = {x.row_id: x.form for x in all_.collect()}
    classed = batches.classes(all_)
    first = _pairs(spark, batches.segmented(classed, stored.words), batches.segmented(classed, stored.words))
    assert got == {i: first[f] for i, f in form.items() if i > 200 and first[f] < i} and len(got) > 100


def test_batches_meet_stored_and_earlier_batches(spark, tmp_path):
    heads = spark.createDataFrame([(i, "s.example", f"Mayor opens {i} new homes near Dorville") for i in range(1, 30)], "row_id long, domain string, title string")
    inc = spark.createDataFrame([(100, 1, "t.example", "MAYOR opens 7 new homes near Dorville"), (101, 1, "t.example", "Ships leave 77 ports"), (102, 2, "u.example", "Ships leave 77 PORTS"), (103, None, None, "Ships leave 77 ports"), (104, 1, "t.example", None)], "row_id long, batch int, domain string, title string")
    for name, df in (("headlines", heads), ("incoming", inc), ("site_labels", spark.createDataFrame([], "domain string, tail string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert {(x.kept_id, x.in_id) for x in queries.QUERIES["p7_found"](spark, str(tmp_path)).collect()} == {(7, 100), (101, 102), (101, 103)}
