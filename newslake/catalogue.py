"""Queries of the archive's own operators over the headline tables, each with its DuckDB SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newslake.functions import fold as folding
from newslake.functions.text import moment, page
from newslake.operators import archive, collect, ingest, quiet, search, stories
from newslake.plans import postings as inverted
from newslake.plans.request import Request, parse
from newslake.session import cut, partitions, shared_folder, stored, table
from newslake.sources import feeds, files

NOW = "2026-10-01 00:00:00"
FEEDS_START, BLOGS_START, SPLIT = "2026-09-05 00:00:00", "2026-09-03 00:00:00", "2026-09-20 00:00:00"
MONTHS = ("2026-08-01", "2026-10-01")
SERIES = ("bridges", "nurses", "trams OR ferries")
SNAPSHOTS = [dt.date(2026, 9, 4) + dt.timedelta(days=3 * i) for i in range(9)]

Query = Callable[[SparkSession, str], DataFrame]


def titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "headlines").where("title is not null and ts is not null").drop("copy")


def built(spark: SparkSession, d: str) -> DataFrame:
    """The archive as it is kept: story key, copy flag, folded words and month of every row."""
    rows = titled(spark, d)
    flagged_ = stories.copy_flags(stories.with_key(rows, stories.learn_labels(rows)))
    return flagged_.withColumn("words", folding.tokens(folding.fold(F.col("title")))).withColumn("month", F.date_format("ts", "yyyy-MM"))


def flagged(spark: SparkSession, d: str) -> DataFrame:
    """`built`, written once by month; counts, pages and series read it."""
    return stored(spark, d, "headlines", lambda: built(spark, d).repartitionByRange(partitions(spark), "ts"), ("month",))


def by_site(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in the order of site and time, so that a site's rows are in few files."""
    return stored(spark, d, "headlines_by_site", lambda: flagged(spark, d).repartitionByRange(partitions(spark), "domain", "ts").sortWithinPartitions("domain", "ts"))


def keyed(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).drop("flag", "words", "month")


def known_labels(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "labels", lambda: labels(spark, d))


def ask(q: str = "", **more: str) -> Request:
    return parse({"q": q, **more})


def _words(name: str, q: Request) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.selected(flagged(spark, d), q).select("row_id", "domain")

    run.__name__ = name
    return run


def labels(spark: SparkSession, d: str) -> DataFrame:
    return stories.learn_labels(titled(spark, d))


def story_key(spark: SparkSession, d: str) -> DataFrame:
    return keyed(spark, d).select("row_id", "key")


def copy_flag(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d).select("row_id", "flag")


def copy_flag_incremental(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(keyed(spark, d))
    return stories.copy_flags_of_batch(rows.where(F.col("ts") < moment(SPLIT)), rows.where(F.col("ts") >= moment(SPLIT))).select("row_id", "flag")


def copy_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stories.histogram(flagged(spark, d), F.to_date("ts"), "day")


def monthly_counts_word(spark: SparkSession, d: str) -> DataFrame:
    return archive.counts(flagged(spark, d), None, ask("bridges"))


def monthly_totals(spark: SparkSession, d: str) -> DataFrame:
    return archive.monthly(flagged(spark, d))


def monthly_counts_domain(spark: SparkSession, d: str) -> DataFrame:
    return archive.counts(by_site(spark, d), None, ask("", domain="zarurupo-tribune.example,virevaki-tribune.example", **{"from": "2026-09-05", "to": "2026-09-20"}))


def _page(name: str, q: Request) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.in_order(search.selected(flagged(spark, d), q), q, 100).select("pos", "row_id", "ts", "domain", "url")

    run.__name__ = name
    return run


def _collapsed(spark: SparkSession, d: str) -> DataFrame:
    q = ask("nurses")
    return search.collapse(search.in_order(search.selected(flagged(spark, d), q), q, 1000), 40)


MIXED = ask("bridges", src="gdelt,feeds,blogs")


def search_page_mixed(spark: SparkSession, d: str) -> DataFrame:
    return search.mixed(flagged(spark, d), unified_table(spark, d), MIXED, 100).select("pos", "src", "row_id", "ts", "domain", "url", "key")


def search_page_mixed_cursor(spark: SparkSession, d: str) -> DataFrame:
    q = ask("nurses", src="gdelt,feeds,blogs", sort="oldest", after="20260910120000", skip="2")
    return search.mixed(flagged(spark, d), unified_table(spark, d), q, 100).select("pos", "src", "row_id", "ts", "domain", "url", "key")


def collapse_page_mixed(spark: SparkSession, d: str) -> DataFrame:
    return search.collapse(search.mixed(flagged(spark, d), unified_table(spark, d), MIXED, 1000), 40).select("story", "ts", "domain", "url", "title", "n", "sites")


def search_next_page(spark: SparkSession, d: str) -> DataFrame:
    """The page after the first one of 40 stories, from the cursor the first one gives."""
    q = ask("nurses")
    rows = search.selected(flagged(spark, d), q)
    one = search.page(rows, q, 40)
    q = replace(q, cursor=one.cursor, skip=one.skip)
    return search.in_order(rows, q, 40).select("pos", "row_id", "ts", "domain", "url")


def collapse_page(spark: SparkSession, d: str) -> DataFrame:
    return _collapsed(spark, d).select("story", "ts", "domain", "url", "title", "n", "sites", F.array_join(F.transform("copies", lambda c: F.concat(c["domain"], F.lit(" "), c["url"])), "\n").alias("copies"))


def story_copies(spark: SparkSession, d: str) -> DataFrame:
    return search.other_sites(_collapsed(spark, d))


def sources_rollup(spark: SparkSession, d: str) -> DataFrame:
    return archive.rollup(table(spark, d, "headlines"), "domain")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return archive.merged(table(spark, d, "sources"), "domain")


def sources_merged(spark: SparkSession, d: str) -> DataFrame:
    return _sites(spark, d)


def sources_typeahead(spark: SparkSession, d: str) -> DataFrame:
    return archive.typeahead(_sites(spark, d), "ve")


def sources_letter(spark: SparkSession, d: str) -> DataFrame:
    return archive.listing(_sites(spark, d), "v", "vam")


def _unified_states(spark: SparkSession, d: str) -> DataFrame:
    return archive.rollup(table(spark, d, "unified_headlines"), "src", "platform", "domain")


def sources_kinds(spark: SparkSession, d: str) -> DataFrame:
    return archive.kinds_of(_unified_states(spark, d))


def stats_global(spark: SparkSession, d: str) -> DataFrame:
    return archive.stats(archive.rollup(table(spark, d, "headlines"), "domain"))


def stats_by_src(spark: SparkSession, d: str) -> DataFrame:
    return archive.stats(_unified_states(spark, d), "src")


def _series(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = flagged(spark, d)
    per = [archive.monthly(search.selected(rows, ask(s))).withColumn("series", F.lit(s)) for s in SERIES]
    return reduce(DataFrame.unionByName, per), archive.monthly(rows)


def compare_share(spark: SparkSession, d: str) -> DataFrame:
    return archive.shares(*_series(spark, d))


def month_series_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return archive.filled(_series(spark, d)[0], *MONTHS, begins={SERIES[1]: "2026-09-01"})


def series_peak(spark: SparkSession, d: str) -> DataFrame:
    return archive.peaks(archive.filled(_series(spark, d)[0], *MONTHS))


def postings_search(spark: SparkSession, d: str) -> DataFrame:
    index = stored(spark, d, "postings", lambda: inverted.postings(titled(spark, d)).repartitionByRange(partitions(spark), "token").sortWithinPartitions("token"))
    return inverted.candidates(index, ask("outside bridges OR nurses"))


def version_insert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_headlines").where("seen is not null")
    return ingest.new_versions(rows.where(F.col("seen") < moment(SPLIT)), rows.where(F.col("seen") >= moment(SPLIT))).select("row_id", "version")


def latest_row_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_headlines").where("url is not null and kind is not null and version is not null")
    return ingest.latest(rows.select("url", "kind", "version", "row_id", "title"), ["url", "kind"], "version", "row_id")


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    label = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "304").otherwise("ok")
    return e.select("ts", F.concat(F.lit("feed"), F.col("user_id").cast("string")).alias("feed"), label.alias("label"), F.when(F.col("value") < 20, "").otherwise(F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("etag"), (F.floor("value") * 10).cast("int").alias("http"))


def cond_headers(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_where(_fetches(spark, d), "feed", "etag")


def fetches_due(spark: SparkSession, d: str) -> DataFrame:
    return collect.due(_fetches(spark, d), moment("2024-01-31 00:00:00"), 24)


def fetch_classify(spark: SparkSession, d: str) -> DataFrame:
    f = _fetches(spark, d)
    http = F.when(F.col("label") == "304", 304).when(F.col("label") == "error", 0).when(F.col("http") > 500, F.col("http")).when(F.col("http") > 400, 503).when(F.col("http") > 300, 403).otherwise(200)
    body = F.when(F.col("http") == 0, " ").when(F.col("etag") == "", "\n<!DOCTYPE html>").when(F.col("http") % 100 == 50, "<p>Just a moment").when(F.col("http") % 100 == 60, " <x><html>DataDome").otherwise("<rss>")
    return f.groupBy(collect.classify_fetch(http, body).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def stage_feeds(spark: SparkSession, d: str) -> DataFrame:
    return ingest.stage_feeds(table(spark, d, "collect_headlines"), FEEDS_START).drop("platform")


def stage_blogs(spark: SparkSession, d: str) -> DataFrame:
    return ingest.stage_blogs(table(spark, d, "blogs_posts"), BLOGS_START)


def _staged(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.stage_feeds(table(spark, d, "collect_headlines"), FEEDS_START).unionByName(ingest.stage_blogs(table(spark, d, "blogs_posts"), BLOGS_START))
    return stored(spark, d, "staged", lambda: stories.with_key(rows, known_labels(spark, d)))


def built_unified(spark: SparkSession, d: str) -> DataFrame:
    return ingest.unified(flagged(spark, d), _staged(spark, d)).withColumn("day", F.to_date("ts"))


def unified_table(spark: SparkSession, d: str) -> DataFrame:
    """The unified table, written once by day."""
    return stored(spark, d, "unified", lambda: built_unified(spark, d).repartition("day"), ("day",))


def unified_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A unified table that ends on SPLIT brought up to date: only the days whose counts differ, and those around them, are built."""
    want, old = unified_table(spark, d), unified_table(spark, d).where(F.col("ts") < moment(SPLIT))
    days = cut(ingest.dirty_days(ingest.day_counts(want), ingest.day_counts(old), "2026-10-31", "2026-08-01"))
    new = ingest.rebuilt(flagged(spark, d), _staged(spark, d), old, days)
    kept = old.join(F.broadcast(days), "day", "left_anti")
    cols = ["src", "row_id", "copy", "copy_news"]
    return kept.select(*cols).unionByName(new.select(*cols))


def unified_check(spark: SparkSession, d: str) -> DataFrame:
    return ingest.self_check(unified_table(spark, d), "2026-09-01", FEEDS_START)


def unified_flags(spark: SparkSession, d: str) -> DataFrame:
    return unified_table(spark, d).select("src", "row_id", "copy", "copy_news")


def unified_counts_news(spark: SparkSession, d: str) -> DataFrame:
    q = ask("bridges", src="gdelt,feeds")
    return archive.counts(flagged(spark, d), unified_table(spark, d), q)


def dirty_days(spark: SparkSession, d: str) -> DataFrame:
    have = ingest.day_counts(table(spark, d, "unified_headlines"))
    return ingest.dirty_days(ingest.day_counts(unified_table(spark, d)), have, "2026-09-28", "2026-09-01")


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    days = F.array(*(F.lit(x) for x in SNAPSHOTS))
    rows = titled(spark, d).select("domain", F.to_date("ts").alias("t")).where("domain is not null").groupBy("domain", "t").agg(F.count(F.lit(1)).alias("k"))
    each = rows.select("domain", "t", "k", F.explode(F.filter(days, lambda x: x >= F.col("t"))).alias("day"))
    return each.groupBy("day", "domain").agg(F.sum("k").alias("n"), F.max("t").alias("last"))


def quiet_report(spark: SparkSession, d: str) -> DataFrame:
    return quiet.report(_snapshots(spark, d), 6, 1, 3, 0.5)


def quiet_stop_groups(spark: SparkSession, d: str) -> DataFrame:
    return quiet.stop_groups(quiet_report(spark, d), 2)


def seed_snapshots(spark: SparkSession, d: str) -> DataFrame:
    rows = titled(spark, d).where("domain is not null")
    monday = F.trunc("ts", "WEEK")
    weekly = rows.groupBy("domain", monday.alias("monday")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.to_date("ts")).alias("last"))
    current = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.max(F.to_date("ts")).alias("last"))
    return quiet.seeded(cut(weekly), current, 5)


def poll_gaps(spark: SparkSession, d: str) -> DataFrame:
    return collect.poll_gaps(table(spark, d, "blogs_posts").where("ts is not null and site is not null"), moment(NOW))


def poll_interval(spark: SparkSession, d: str) -> DataFrame:
    return collect.poll_interval(poll_gaps(spark, d))


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collect_headlines").select("row_id", page(F.col("url")).alias("page"))


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("kind") == "sitemap", F.col("url")).otherwise(F.concat("url", F.lit("?utm_source=x&b=1%20\u00e9*~&ref=2&c&amp;s=3#top")))
    return table(spark, d, "collect_headlines").select("row_id", collect.canonical_url(url).alias("url"))


def page_sites(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "unified_headlines").groupBy(collect.registrable(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))


def slug_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "headlines").select("row_id", collect.slug_title(F.col("url")).alias("title"))


def guess_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blogs_posts").where("title is not null").select("row_id", collect.guess_lang(F.col("title")).alias("guess"))


def english_letters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collect_headlines").where("title is not null").select("row_id", ingest.english_letters(F.col("title")).alias("english"))


def top_sites(spark: SparkSession, d: str) -> DataFrame:
    return archive.top(table(spark, d, "headlines"), "domain", 40)


def folded_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "headlines").where("title is not null").select("row_id", folding.fold(F.col("title")).alias("folded"))


def gkg_extract(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "headlines").where("title is not null and domain is not null and url is not null and ts is not null")
    title = F.concat(F.lit("<X>1</X><PAGE_TITLE>"), F.regexp_replace("title", "[\t\n]", " "), F.lit("</PAGE_TITLE>"))
    line = F.concat_ws("\t", F.lit("id"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(""), "domain", "url", *[F.lit("")] * 21, title)
    return files.crawl_rows(h.select(line.alias("line"), "row_id"), "row_id").select("row_id", "ts", "domain", "url", "title")


def feed_parse(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "headlines").where("title is not null and url is not null and ts is not null")
    body = F.concat(F.lit("\n<rss><channel><item><title>"), F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</title><guid>g1</guid><pubDate>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</pubDate><link>"), F.col("url"), F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x#top</link></item></channel></rss>"))
    return feeds.parsed(h.select(F.col("row_id").cast("string").alias("url"), F.encode(body, "utf-8").alias("body")), dt.datetime(2026, 12, 1)).select(F.col("url").cast("long").alias("row_id"), "format", "item_url", "title", "ts", "guid")


def archive_json_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "raw_lines").select("line_id", F.from_json("line", "domain string, url string, title string, kind string, guid string").alias("r"))
    return rows.where("r.url is not null").select("line_id", "r.*")


def backfill_flags(spark: SparkSession, d: str) -> DataFrame:
    return stories.backfilled(keyed(spark, d), "2026-09-10 00:00:00", SPLIT).select("row_id", "flag")


def staged_once(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_headlines").where("title is not null and seen is not null")
    return collect.staged(rows, "domain", "url", "kind", "title").select("row_id")


def run_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_headlines")
    return collect.new_and_changed(rows, "feed", F.lit(rows.agg(F.max("seen")).first()[0]))


def item_extent(spark: SparkSession, d: str) -> DataFrame:
    items = titled(spark, d).where("domain is not null").select("domain", "ts", "title", F.col("url").alias("item_url"), F.col("row_id").alias("place"))
    return collect.item_extent(items, "domain")


def page_report(spark: SparkSession, d: str) -> DataFrame:
    return collect.page_report(table(spark, d, "headlines").select(F.date_format("ts", "yyyyMMddHH").alias("file"), "ts", "url", "title"))


def lost_outlets(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "headlines").groupBy(collect.registrable(F.col("url")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    lost = table(spark, d, "sources").where("n is not null").groupBy(F.col("domain").alias("site")).agg(F.sum("n").alias("was"))
    return collect.lost_outlets(sites, lost)


def _post_days(spark: SparkSession, d: str, until: str) -> DataFrame:
    rows = table(spark, d, "blogs_posts").where(F.col("seen") < moment(until)).where("ts is not null")
    return rows.groupBy(F.to_date("ts").alias("day")).agg(F.date_format(F.max("seen"), "yyyyMMddHHmmss").alias("lastmod")).withColumn("file", F.concat(F.lit("posts-"), F.col("day").cast("string")))


def day_files_to_read(spark: SparkSession, d: str) -> DataFrame:
    return collect.files_to_read(_post_days(spark, d, NOW), _post_days(spark, d, SPLIT).withColumn("status", F.lit("ok")), "2026-09-22", 14)


def archive_pages_to_read(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blogs_posts").where("ts is not null and site is not null")
    place = F.row_number().over(Window.partitionBy("site").orderBy(F.col("ts").desc(), "row_id"))
    pages = rows.withColumn("page", F.floor((place - 1) / 10)).groupBy("site", "page").agg(F.min("ts").alias("oldest"), F.count(F.lit(1)).alias("posts"))
    return collect.pages_to_read(pages, rows.where(F.col("seen") < moment("2026-09-10")).groupBy("site").agg(F.max("ts").alias("ts")))


def walk_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blogs_posts").where("site is not null")
    sites = rows.groupBy("site").agg(F.max("ts").alias("lastmod"), F.when(F.bool_or(F.col("lang").isNull()), "blocked").otherwise("ok").alias("status"))
    marks = rows.groupBy("site").agg((F.count(F.lit(1)) > 15).alias("done"))
    return collect.walk_queue(sites, marks, moment("2026-09-10"))


def own_domain_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blogs_posts").where("site is not null")
    sites = rows.groupBy("site").agg(F.when(F.bool_or(F.startswith("domain", F.col("site"))), "").otherwise(F.max("domain")).alias("domain"))
    return collect.on_own_domain(rows, sites).select("row_id")


def queued_sources(spark: SparkSession, d: str) -> DataFrame:
    return collect.queued(table(spark, d, "sources"), table(spark, d, "incoming"), "domain").groupBy("domain").agg(F.sum("n").alias("n"))


def slug_posts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "headlines").where("url is not null and ts is not null")
    body = F.concat(F.lit("<urlset><url><loc>"), F.regexp_replace("url", "[?#].*$", ""), F.lit("-0123456789ab</loc><lastmod>x</lastmod></url></urlset>"))
    return files.slug_posts(rows.select(F.col("row_id").cast("string").alias("source"), F.to_date("ts").alias("day"), body.alias("body")), moment(NOW)).select(F.col("source").cast("long").alias("row_id"), "ts", "site", "title", "post_id", "lang")


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "blogs_posts").where("site <> '' and type is not null")
    return collect.leaderboard(rows.select(F.col("row_id").alias("place"), F.col("type").alias("category"), F.upper("site").alias("subdomain"), "domain", F.col("url").alias("base_url"), F.col("author").alias("name"), F.col("lang").alias("language"), F.col("reactions").alias("subscribers")))


def feed_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "headlines").where("domain is not null and url is not null")
    feeds_ = rows.select("row_id", "domain", "url", F.lower("domain").alias("host"), (F.col("copy") < 2).alias("enabled"), F.when(F.col("copy") == 1, "blox").alias("platform"))
    return collect.feed_groups(feeds_).select("row_id", "group")


def master_list(spark: SparkSession, d: str) -> DataFrame:
    rows = titled(spark, d)
    line = F.concat_ws(" ", F.col("row_id").cast("string"), F.md5(F.encode("title", "utf-8")), F.concat(F.lit("http://h/"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".gkg.csv.zip")))
    return files.master_list(rows.select(line.alias("line"), "row_id"), "20260910000000", place="row_id")


def archive_days(spark: SparkSession, d: str) -> DataFrame:
    """The archive written as text files by day, and two of its days read back."""
    folder = f"{shared_folder(spark)}/text-archive-{abs(hash(d))}"
    files.write_archive(titled(spark, d).select("ts", "domain", "url", "title"), folder)
    return files.read_archive(spark, folder, dt.date(2026, 9, 10), dt.date(2026, 9, 11)).select("ts", "domain", "url", "title")


def slug_ids(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("-0a1b2c3d4e?x=1"))
    return table(spark, d, "headlines").where("url is not null").select("row_id", collect.slug_post_id(url).alias("post_id"), collect.slug_site(url).alias("site"))


def capture_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "collect_headlines").where("seen is not null and title is not null").select(F.date_format("seen", "yyyyMMddHHmm").alias("capture"), "url", "kind", "title")
    return collect.capture_rows(rows)


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.as_lines(table(spark, d, "headlines").select("row_id", "domain", "title"))


def stored_parts(spark: SparkSession, d: str) -> DataFrame:
    flagged(spark, d)
    fs = files.folder_parts(spark, str(flagged(spark, d).inputFiles()[0]).split("/month=")[0])
    return fs.select("part")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        monthly_counts_word, monthly_totals, monthly_counts_domain, _words("word_and", ask("bridges Mayor")), _words("word_or_single", ask("bridges OR nurses OR trams")), _words("word_or_phrase", ask("new homes OR free buses")),
        _words("substring_search", ask("oman coi", mode="substring")), labels, story_key, copy_flag, copy_flag_incremental, copy_histogram, _page("search_page_newest", ask("bridges")), _page("search_page_oldest", ask("bridges", sort="oldest")),
        _page("search_page_cursor", ask("nurses", before="20260920120000", skip="1")), _page("latest_headlines", ask("")), collapse_page, story_copies, sources_rollup, sources_merged, sources_typeahead, sources_letter, sources_kinds, stats_global, stats_by_src,
        compare_share, month_series_zero_filled, series_peak, postings_search, version_insert, latest_row_wins, cond_headers, fetches_due, fetch_classify, stage_feeds, stage_blogs, unified_flags, unified_counts_news, dirty_days, quiet_report,
        quiet_stop_groups, seed_snapshots, poll_gaps, poll_interval, url_normalize, url_canonical, page_sites, slug_titles, guess_lang, english_letters, top_sites, folded_titles, gkg_extract, feed_parse, archive_json_parse,
        search_page_mixed, search_page_mixed_cursor, collapse_page_mixed, search_next_page, unified_rebuild, unified_check, backfill_flags, staged_once, run_counts, item_extent, page_report, lost_outlets, day_files_to_read,
        archive_pages_to_read, walk_queue, own_domain_posts, queued_sources, slug_posts, leaderboard, feed_groups, master_list, archive_days, slug_ids, capture_rows, result_lines, stored_parts,
    )
}

# ---------------------------------------------------------------- SQL

_SEP = "'(?s)^(.*) ([|\\-\\x{2013}\\x{2014}]) (.*)$'"
_PAGE = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '')"
_TOK = "regexp_split_to_array(strip_accents(lower(title)), '[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+')"
_H = "h as (select row_id, ts, domain, url, title from headlines where title is not null and ts is not null)"
_L = f"labels as (select domain, tail, count(*) as n from (select domain, regexp_extract(title, {_SEP}, 3) as tail from h where domain is not null) where octet_length(encode(tail)) between 1 and 160 group by all having count(*) >= 20)"


def _key(source: str, out: str) -> str:
    one = f"{out}_1 as (select a.*, case when l.tail is not null then regexp_extract(a.title, {_SEP}, 1) else a.title end as k1 from {source} a left join labels l on a.domain = l.domain and regexp_extract(a.title, {_SEP}, 3) = l.tail)"
    two = f"{out} as (select a.* exclude (k1), case when l.tail is not null then regexp_extract(a.k1, {_SEP}, 1) else a.k1 end as key from {out}_1 a left join labels l on a.domain = l.domain and regexp_extract(a.k1, {_SEP}, 3) = l.tail)"
    return f"{one}, {two}"


def _flag(any_: str, same: str) -> str:
    return f"case when {any_} is null or {any_} < ts - interval 7 day then 0 when {same} is null or {same} < ts - interval 7 day then 1 else 2 end"


def _lag(by: str) -> str:
    return f"lag(ts) over (partition by {by} order by ts, url, row_id)"


_K = f"{_H}, {_L}, {_key('h', 'k')}"
_F = f"{_K}, f as (select *, {_flag('pa', 'ps')} as flag from (select *, {_lag('key')} as pa, {_lag('key, domain')} as ps from k))"
_TRIPLE = "cast(date_trunc('month', ts) as date) as month, count(*) filter (flag = 0) as stories, count(*) filter (flag <= 1) as outlets, count(*) as articles"


def _has(*words: str) -> str:
    return " and ".join(f"list_contains({_TOK}, '{w}')" for w in words)


def _page_sql(where: str, way: str, skip: int = 0) -> str:
    order = ", ".join(f"{c} {way}" for c in ("ts", "domain", "url", "row_id"))
    return f"with {_H} select row_number() over (order by {order}) as pos, row_id, ts, domain, url from (select * from h where {where} order by {order} limit 100 offset {skip})"


_COLLAPSE = f"""with {_K}, top as (select *, row_number() over (order by ts desc, domain desc, url desc, row_id desc) as pos from k where {_has('nurses')} qualify pos <= 1000),
r as (select *, dense_rank() over (order by lead) as story from (select *, min(pos) over (partition by key) as lead from top)),
u as (select * from r where pos < coalesce((select min(pos) from r where story > 40), 9999))"""
_SERIES = f"""{_F}, s as (
  select 'bridges' as series, {_TRIPLE} from f where {_has('bridges')} group by month union all
  select 'nurses', {_TRIPLE} from f where {_has('nurses')} group by month union all
  select 'trams OR ferries', {_TRIPLE} from f where {_has('trams')} or {_has('ferries')} group by month),
z as (select n.series, m.month, coalesce(s.stories, 0) as stories, coalesce(s.outlets, 0) as outlets, coalesce(s.articles, 0) as articles
  from (select distinct series from s) n cross join (select cast(unnest(generate_series(date '2026-08-01', date '2026-10-01', interval 1 month)) as date) as month) m left join s using (series, month))"""
_FETCHES = """f as (select ts, 'feed' || user_id as feed, case event_type when 'error' then 'error' when 'view' then '304' else 'ok' end as label,
  case when value < 20 then '' else 'e' || event_id end as etag, cast(floor(value) * 10 as int) as http from events)"""
_FEEDS = f"""sf as (select ts, 'feeds' as src, domain, url, title, row_id from (
  select domain, url, row_id, least(ts, seen) as ts, seen, title from (
    select *, row_number() over (partition by domain, url order by (kind <> 'sitemap') nulls first, seen, row_id) as rn from collect_headlines where version = 1 and seen >= timestamp '{FEEDS_START}') where rn = 1)
  where ts >= timestamp '{FEEDS_START}' and ts >= seen - interval 3 day and title <> ''
  and not (domain in ('bbc.com', 'bbc.co.uk') and regexp_extract(url, '^https?://[^/]+/([^/]+)/', 1) not in ('news', 'sport', 'sounds', 'iplayer', 'weather', 'newsround', 'culture', 'future', 'programmes', 'food', 'bitesize',
    'mediacentre', 'travel', 'articles', 'worklife', 'reel', 'innovation', 'business', 'arts', 'audio', 'videos', 'live')) and len(regexp_extract_all(title, '[A-Za-z]')) * 2 >= len(regexp_extract_all(title, '\\p{{L}}')))"""
_BLOGS = f"""sb as (select least(ts, first_seen) as ts, 'blogs' as src, platform, regexp_replace(domain, '^www\\.', '') as domain, url, title, row_id from (
  select *, min(seen) over (partition by platform, url) as first_seen, row_number() over (partition by platform, url order by seen, row_id) as rn from blogs_posts where version = 1 and ts >= timestamp '{BLOGS_START}')
  where rn = 1 and least(ts, first_seen) >= timestamp '{BLOGS_START}' and lang = 'en' and title <> '')"""
_UNIFIED = f"""{_F}, {_FEEDS}, {_BLOGS},
st as (select row_id, ts, src, '' as platform, domain, url, title from sf union all select row_id, ts, src, platform, domain, url, title from sb), {_key('st', 'sk')},
gp as (select distinct {_PAGE} as p, cast(ts as date) as d from f),
u0 as (select row_id, ts, 'gdelt' as src, domain, url, title, key, flag as g, false as inn from f
  union all select row_id, ts, src, domain, url, title, key, null, src = 'feeds' and exists (select 1 from gp where gp.p = {_PAGE} and abs(date_diff('day', gp.d, cast(sk.ts as date))) <= 7) from sk),
u1 as (select *, src <> 'blogs' and not inn as news from u0),
u as (select *, coalesce(g, own) as copy, case when src = 'blogs' then own when inn then 255 else nws end as copy_news from (
  select *, {_flag('oa', 'os')} as own, {_flag('na', 'ns')} as nws from (
    select *, {_lag('src, key')} as oa, {_lag('src, key, domain')} as os, {_lag('news, key')} as na, {_lag('news, key, domain')} as ns from u1)))"""
_MIXED = f"""{_UNIFIED}, mx as (select ts, domain, url, row_id, title, key, '' as src from f where ts < timestamp '2026-09-01'
  union all select ts, domain, url, row_id, title, case when src = 'blogs' then 'blogs' || chr(9) || key else key end, src from u where ts >= timestamp '2026-09-01' and copy_news <> 255)"""
_ENGLISH = """the a an of to in is are and for on with how why what your you my this that it its not from by at be as or we i can do will new about vs into than more most all when who one our their has have was
were up out no get make just over after before first best top guide review tips things ways should could would every don't dont without between through"""
_OTHER = """yang dan dengan untuk tidak ini itu dari adalah kita saya que con una las los del como para uma não você dos das der und ist mit für nicht eine les des est une pour dans che per non gli sono della
och att för är med ile bir için ve bu"""
_SUFFIXES = "co.uk com.au co.nz co.za com.ph co.in org.uk gov.uk ac.uk net.au org.au com.br com.mx co.jp com.sg com.hk com.pk com.bd com.ng co.ke com.my com.tr"


def _quoted(words: str) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words.split())


def _guess(words: str) -> str:
    return f"case when list_has_any({words}, [{_quoted(_OTHER)}]) then '' when list_has_any({words}, [{_quoted(_ENGLISH)}]) then 'en' else '' end"


def _slug(url: str) -> str:
    return f"trim(regexp_replace(replace(url_decode(replace(regexp_replace(regexp_extract(regexp_replace({url}, '[?#].*$', ''), '^[^:]+://[^/]*.*?/([^/]*)/*$', 1), '-[0-9a-f]{{8,16}}$', ''), '+', '%2B')), '-', ' '), '\\s+', ' ', 'g'))"


def _registrable(url: str) -> str:
    p = f"string_split(regexp_replace(regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#]+)', 1)), ':\\d+$', ''), '^www\\.', ''), '.')"
    return f"case when len({p}) > 2 and array_to_string({p}[-2:], '.') in ({_quoted(_SUFFIXES)}) then array_to_string({p}[-3:], '.') else array_to_string({p}[-2:], '.') end"


def _post_days_sql(until: str) -> str:
    return f"(select 'posts-' || day as file, day, lastmod from (select cast(ts as date) as day, strftime(max(seen), '%Y%m%d%H%M%S') as lastmod from blogs_posts where ts is not null and seen < timestamp '{until}' group by 1))"


_SNAP = f"""{_H}, days as (select unnest([{', '.join(f"date '{x}'" for x in SNAPSHOTS)}]) as day),
snap as (select day, domain, count(*) as n, max(cast(ts as date)) as last from h join days on cast(ts as date) <= day where domain is not null group by all)"""
_QUIET = f"""{_SNAP}, step as (select day, lag(day) over (order by day) as before from days),
inc as (select *, row_number() over (partition by domain order by day desc) as age from (
  select domain, day, (n - pn) * 7.0 / greatest(day - pd, 1) as inc from (
    select s.*, step.before, lag(n) over w as pn, lag(s.day) over w as pd from snap s join step using (day) window w as (partition by domain order by s.day)) where pd = before)),
rates as (select domain, count(*) as k, avg(inc) filter (age <= 2) as recent, avg(inc) filter (age between 3 and 10) as base from inc group by domain),
q as (select domain, case when day - last >= 6 and base >= 1 then 'dark' when base >= 3 and recent < 0.5 * base then 'thinning' end as why,
  cast(round_even(base, 0) as bigint) as baseline, cast(round_even(recent, 0) as bigint) as recent, last, n as rows from snap join rates using (domain) where day = (select max(day) from snap) and k >= 3)"""
_GAPS = f"""g as (select site, round(floor(epoch(timestamp '{NOW}' - min(t)) / 60) / count(*) / 60, 6) as gap_hours from (
  select * from (select site, url, min(ts) as t from blogs_posts where ts is not null and site is not null group by site, url) qualify row_number() over (partition by site order by t desc, url) <= 10) group by site)"""
_STATES = "us as (select src, platform, domain, count(*) as n, min(ts) as first, max(ts) as last from unified_headlines group by all)"
_SITES = "s as (select domain, cast(sum(n) as bigint) as n, min(\"first\") as \"first\", max(\"last\") as \"last\" from sources group by domain)"

ORACLES: dict[str, str] = {
    "monthly_counts_word": f"with {_F} select {_TRIPLE} from f where {_has('bridges')} group by month",
    "monthly_totals": f"with {_F} select {_TRIPLE} from f group by month",
    "monthly_counts_domain": f"with {_F} select {_TRIPLE} from f where domain in ('zarurupo-tribune.example', 'virevaki-tribune.example') and ts >= timestamp '2026-09-05' and ts < timestamp '2026-09-21' group by month",
    "word_and": f"with {_H} select row_id, domain from h where {_has('bridges', 'mayor')}",
    "word_or_single": f"with {_H} select row_id, domain from h where list_has_any({_TOK}, ['bridges', 'nurses', 'trams'])",
    "word_or_phrase": f"with {_H} select row_id, domain from h where ({_has('new', 'homes')}) or ({_has('free', 'buses')})",
    "substring_search": f"with {_H} select row_id, domain from h where contains(lower(title), 'oman coi')",
    "labels": f"with {_H}, {_L} select * from labels",
    "story_key": f"with {_K} select row_id, key from k",
    "copy_flag": f"with {_F} select row_id, flag from f",
    "copy_flag_incremental": f"with {_F} select row_id, flag from f where ts >= timestamp '{SPLIT}'",
    "copy_histogram": f"with {_F} select cast(ts as date) as day, count(*) filter (flag = 0) as copy0, count(*) filter (flag = 1) as copy1, count(*) filter (flag = 2) as copy2 from f group by day",
    "search_page_newest": _page_sql(_has("bridges"), "desc"),
    "search_page_oldest": _page_sql(_has("bridges"), "asc"),
    "search_page_cursor": _page_sql(_has("nurses") + " and ts <= timestamp '2026-09-20 12:00:00'", "desc", 1),
    "latest_headlines": _page_sql("true", "desc"),
    "collapse_page": _COLLAPSE
    + """select story, arg_min(ts, pos) as ts, arg_min(domain, pos) as domain, arg_min(url, pos) as url, arg_min(title, pos) as title, count(*) as n, count(distinct domain) as sites,
  coalesce(string_agg(domain || ' ' || url, chr(10) order by pos) filter (pos <> lead), '') as copies from u group by story""",
    "story_copies": _COLLAPSE + "select story, domain, arg_min(url, pos) as url, count(*) as n from (select *, arg_min(domain, pos) over (partition by story) as own from u) where pos <> lead and domain <> own group by story, domain",
    "sources_rollup": 'select domain, count(*) as n, min(ts) as "first", max(ts) as "last" from headlines group by domain',
    "sources_merged": f"with {_SITES} select * from s",
    "sources_typeahead": f"with {_SITES} select * from s where contains(domain, 've') order by starts_with(domain, 've') desc, n desc, domain limit 12",
    "sources_letter": f"with {_SITES} select * from s where starts_with(domain, 'v') and domain > 'vam' order by domain limit 10000",
    "sources_kinds": f"""with {_STATES} select domain, cast(sum(n) as bigint) as n, min("first") as "first", max("last") as "last",
  array_to_string(list_filter(['gdelt', 'feeds', 'substack', 'medium', 'wordpress'], lambda x: list_contains(list(case when src = 'blogs' then platform else src end), x)), ',') as kinds from us group by domain""",
    "stats_global": 'select min(ts) as "first", max(ts) as "last", count(*) as rows, count(distinct domain) as sources from headlines',
    "stats_by_src": f'with {_STATES} select src, min("first") as "first", max("last") as "last", cast(sum(n) as bigint) as rows, count(distinct domain) as sources from us group by src',
    "compare_share": f"with {_SERIES}, t as (select {_TRIPLE} from f group by month) select series, month, s.stories as value, round(case when coalesce(t.stories, 0) = 0 then 0.0 else s.stories * 100.0 / t.stories end, 6) as share from s left join t using (month)",
    "month_series_zero_filled": f"with {_SERIES} select series, month, case when t then stories end as stories, case when t then outlets end as outlets, case when t then articles end as articles from (select *, series <> 'nurses' or month >= date '2026-09-01' as t from z)",
    "series_peak": f"""with {_SERIES} select series, cast(sum(stories) as bigint) as total, arg_max(month, struct_pack(v := stories, d := -date_diff('day', date '2000-01-01', month))) as peak_month, max(stories) as peak,
  min(month) filter (stories > 0) as first_month, max(month) filter (stories > 0) as last_month from z group by series""",
    "postings_search": f"with {_H} select row_id from h where ({_has('outside', 'bridges')}) or {_has('nurses')}",
    "version_insert": f"""with s as (select * from collect_headlines where seen >= timestamp '{SPLIT}' and title is not null qualify row_number() over (partition by domain, url, kind, title order by seen, ts nulls first, row_id) = 1),
e as (select * from collect_headlines where seen < timestamp '{SPLIT}')
select row_id, cast((select count(*) from e where e.domain is not distinct from s.domain and e.url is not distinct from s.url and e.kind is not distinct from s.kind)
  + row_number() over (partition by domain, url, kind order by seen, ts nulls first, title, row_id) as int) as version
from s where not exists (select 1 from e where e.domain is not distinct from s.domain and e.url is not distinct from s.url and e.kind is not distinct from s.kind and e.title is not distinct from s.title)""",
    "latest_row_wins": "select url, kind, version, row_id, title from collect_headlines where url is not null and kind is not null and version is not null qualify row_number() over (partition by url, kind order by version desc, row_id desc) = 1",
    "cond_headers": f"with {_FETCHES} select feed, arg_max(etag, struct_pack(t := ts, e := etag)) filter (etag <> '') as etag from f group by feed",
    "fetches_due": f"with {_FETCHES} select feed from f group by feed having max(ts) filter (label in ('ok', '304')) is null or max(ts) filter (label in ('ok', '304')) < timestamp '2024-01-30 00:00:00'",
    "fetch_classify": f"""with {_FETCHES}, g as (select *, case when label = '304' then 304 when label = 'error' then 0 when http > 500 then http when http > 400 then 503 when http > 300 then 403 else 200 end as code from f)
select case when code = 304 then '304' when code = 0 then 'error' when code = 403 or (code = 503 and http <> 0 and etag <> '' and http % 100 in (50, 60)) then 'blocked' when code >= 400 then 'http ' || code
  when http = 0 then 'empty' when etag = '' then 'html' when http % 100 = 60 then 'blocked' else 'ok' end as outcome, count(*) as n from g group by outcome""",
    "stage_feeds": f"with {_FEEDS} select ts, src, domain, url, title, row_id from sf",
    "stage_blogs": f"with {_BLOGS} select ts, src, platform, domain, url, title, row_id from sb",
    "unified_flags": f"with {_UNIFIED} select src, row_id, copy, copy_news from u",
    "unified_counts_news": f"""with {_UNIFIED} select cast(date_trunc('month', ts) as date) as month, count(*) filter (flag = 0) as stories, count(*) filter (flag <= 1) as outlets, count(*) as articles from (
  select ts, title, flag from f where ts < timestamp '2026-09-01' union all select ts, title, copy_news from u where src <> 'blogs' and copy_news <> 255 and ts >= timestamp '2026-09-01') where {_has('bridges')} group by month""",
    "dirty_days": f"""with {_UNIFIED}, w as (select cast(ts as date) as day, src, count(*) as n from u group by all), o as (select cast(ts as date) as day, src, count(*) as n from unified_headlines group by all),
c as (select coalesce(w.day, o.day) as day from w full join o on w.day = o.day and w.src = o.src where coalesce(w.n, 0) <> coalesce(o.n, 0))
select distinct day from (select cast(c.day + cast(k as int) as date) as day from c, (select unnest(range(-7, 8)) as k) union all select cast(date '2026-09-28' - cast(k as int) as date) from (select unnest(range(0, 4)) as k)) where day between date '2026-09-01' and date '2026-09-28'""",
    "quiet_report": f"with {_QUIET} select * from q where why is not null",
    "quiet_stop_groups": f"with {_QUIET} select last, string_agg(domain, ',' order by domain) as sites from q where why = 'dark' group by last having count(*) >= 2",
    "seed_snapshots": f"""with {_H}, w as (select domain, cast(date_trunc('week', ts) as date) as monday, count(*) as rows, max(cast(ts as date)) as last from h where domain is not null group by all),
cur as (select domain, count(*) as n, max(cast(ts as date)) as last from h where domain is not null group by domain), ms as (select distinct monday from w)
select * from (select cast(monday + 6 as date) as day, domain, n - coalesce((select cast(sum(rows) as bigint) from w where w.domain = cur.domain and w.monday > ms.monday), 0) as n,
  coalesce((select max(w.last) from w where w.domain = cur.domain and w.monday <= ms.monday), case when last <= monday + 6 then last end) as last
  from cur, ms where monday < (select max(monday) from ms)) where last is not null and n >= 5""",
    "poll_gaps": f"with {_GAPS} select * from g",
    "url_normalize": f"select row_id, {_PAGE} as page from collect_headlines",
    "page_sites": f"select {_registrable('url')} as site, count(*) as n from unified_headlines group by site",
    "slug_titles": f"select row_id, {_slug('url')} as title from headlines",
    "guess_lang": f"select row_id, {_guess('w')} as guess from (select row_id, regexp_extract_all(lower(title), '[a-zà-ÿ'']+') as w from blogs_posts where title is not null)",
    "english_letters": "select row_id, len(regexp_extract_all(title, '[A-Za-z]')) * 2 >= len(regexp_extract_all(title, '\\p{L}')) as english from collect_headlines where title is not null",
    "top_sites": "select domain, count(*) as n from headlines group by domain order by n desc, domain nulls first limit 40",
    "folded_titles": "select row_id, strip_accents(lower(title)) as folded from headlines where title is not null",
    "gkg_extract": """select row_id, ts, domain, url, title from (select row_id, ts, domain, url, trim(regexp_replace(title, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as title from headlines)
where title <> '' and domain <> '' and url <> '' and ts is not null""",
    "feed_parse": """select row_id, 'rss' as format, regexp_extract(url, '^(https?)', 1) || '://' || lower(regexp_extract(url, '://([^/]+)', 1)) || regexp_extract(url, '://[^/]+(/[^?#]*)', 1) || coalesce('?' || nullif(regexp_extract(url, '(page=[0-9]+)', 1), ''), '') as item_url,
  trim(regexp_replace(title, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g')) as title, ts, 'g1' as guid from headlines where title is not null and url is not null and ts is not null""",
    "archive_json_parse": "select line_id, json_extract_string(j, '$.domain') as domain, json_extract_string(j, '$.url') as url, json_extract_string(j, '$.title') as title, json_extract_string(j, '$.kind') as kind, json_extract_string(j, '$.guid') as guid from (select line_id, case when json_valid(line) then line::json end as j from raw_lines) where json_extract_string(j, '$.url') is not null",
    "url_canonical": """select row_id, case when url is null then '' else regexp_extract(url, '^(https?)', 1) || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || case when p = '' then '/' else p end || case when kind = 'sitemap' then '' else '?b=1+%C3%A9%2A~&c=&amp%3Bs=3' end end as url
from (select *, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as p from collect_headlines)""",
    "search_page_mixed": f"with {_MIXED} select row_number() over (order by ts desc, domain desc, url desc, row_id desc) as pos, src, row_id, ts, domain, url, key from (select * from mx where {_has('bridges')} order by ts desc, domain desc, url desc, row_id desc limit 100)",
    "search_page_mixed_cursor": f"with {_MIXED} select row_number() over (order by ts, domain, url, row_id) as pos, src, row_id, ts, domain, url, key from (select * from mx where {_has('nurses')} and ts >= timestamp '2026-09-10 12:00:00' order by ts, domain, url, row_id limit 100 offset 2)",
    "collapse_page_mixed": f"""with {_MIXED}, top as (select *, row_number() over (order by ts desc, domain desc, url desc, row_id desc) as pos from mx where {_has('bridges')} qualify pos <= 1000),
r as (select *, dense_rank() over (order by lead) as story from (select *, min(pos) over (partition by key) as lead from top)), z as (select * from r where pos < coalesce((select min(pos) from r where story > 40), 9999))
select story, arg_min(ts, pos) as ts, arg_min(domain, pos) as domain, arg_min(url, pos) as url, arg_min(title, pos) as title, count(*) as n, count(distinct domain) as sites from z group by story""",
    "search_next_page": f"""with {_K}, top as (select *, row_number() over (order by ts desc, domain desc, url desc, row_id desc) as p from k where {_has('nurses')}),
r as (select *, dense_rank() over (order by lead) as story from (select *, min(p) over (partition by key) as lead from top where p <= 1000)),
used as (select case when (select count(*) from top) >= 40 and (select count(distinct key) from top where p <= 40) < 20 then coalesce((select min(p) from r where story > 40), (select max(p) from r) + 1) - 1 else least(40, (select count(*) from top)) end as n)
select p - n as pos, row_id, ts, domain, url from top, used where p > n and p <= n + 40""",
    "unified_rebuild": f"with {_UNIFIED} select src, row_id, copy, copy_news from u",
    "unified_check": f"""with {_UNIFIED}, v as (select *, src <> 'blogs' and copy_news <> 255 as part from (select ts, url, row_id, domain, src, key, copy, copy_news from u)),
w as (select *, {_flag('oa', 'os')} as own, {_flag('na', 'ns')} as nws from (select *, {_lag('src, key')} as oa, {_lag('src, key, domain')} as os, {_lag('part, key')} as na, {_lag('part, key, domain')} as ns from v)), x as (select *, ts >= timestamp '2026-09-08' as i from w)
select count(*) filter (i) as rows, count(*) filter (i and src <> 'gdelt' and copy <> own) as own_differ, count(*) filter (i and src = 'blogs' and copy_news <> own) as blogs_differ, count(*) filter (i and part and copy_news <> nws) as news_differ,
  count(*) filter (src = 'gdelt' and ts < timestamp '{FEEDS_START}') as early, count(*) filter (src = 'gdelt' and ts < timestamp '{FEEDS_START}' and copy_news <> copy) as early_differ from x""",
    "backfill_flags": f"with {_F} select row_id, flag from f where ts >= timestamp '2026-09-10' and ts < timestamp '{SPLIT}'",
    "staged_once": "select row_id from collect_headlines where title is not null and seen is not null qualify row_number() over (partition by domain, url, kind, title order by seen, row_id) = 1",
    "run_counts": "select feed, count(*) as new, count(*) filter (version > 1) as changed from collect_headlines where seen = (select max(seen) from collect_headlines) group by feed",
    "item_extent": f"with {_H} select domain, count(*) as items, max(ts) as newest, min(ts) as oldest, substring(arg_min(title, row_id), 1, 120) as sample, arg_min(url, row_id) as sample_url from h where domain is not null group by domain",
    "page_report": f"""with p as (select count(*) as pages, count(*) filter (title <> '') as titled, count(distinct strftime(ts, '%Y%m%d%H')) as files, count(distinct {_registrable('url')}) as sites from headlines)
select *, pages // greatest(files, 1) as pages_a_file, 16 * pages // greatest(files, 1) as pages_a_day, 16 * sites // greatest(files, 1) as sites_a_day from p""",
    "lost_outlets": f"""select l.site, s.n, l.was from (select domain as site, cast(sum(n) as bigint) as was from sources where n is not null group by 1) l left join (select {_registrable('url')} as site, count(*) as n from headlines group by 1) s using (site)""",
    "day_files_to_read": f"select l.file, l.day, l.lastmod from {_post_days_sql(NOW)} l left join {_post_days_sql(SPLIT)} h using (file) where l.day between date '2026-09-08' and date '2026-09-22' and (h.file is null or h.lastmod <> l.lastmod)",
    "archive_pages_to_read": """with r as (select * from blogs_posts where ts is not null and site is not null),
p as (select site, (n - 1) // 10 as page, min(ts) as oldest, count(*) as posts from (select *, row_number() over (partition by site order by ts desc, row_id) as n from r) group by all),
o as (select p.*, posts >= 10 and (s.ts is null or oldest > s.ts) as going from p left join (select site, max(ts) as ts from r where seen < timestamp '2026-09-10' group by site) s using (site) where page < 4)
select site, page from (select *, bool_and(going) over (partition by site order by page rows between unbounded preceding and 1 preceding) as reached from o) where coalesce(reached, true)""",
    "walk_queue": """select site, lastmod from (select site, max(ts) as lastmod, bool_or(lang is null) as blocked, count(*) > 15 as done from blogs_posts where site is not null group by site)
where lastmod >= timestamp '2026-09-10' and not blocked and not done""",
    "own_domain_posts": "select row_id from blogs_posts where site in (select site from blogs_posts where site is not null group by site having not bool_or(starts_with(domain, site)) and max(domain) <> '')",
    "queued_sources": "select domain, cast(sum(n) as bigint) as n from sources where domain in (select domain from incoming where domain is not null) group by domain",
    "slug_posts": f"""select * from (select row_id, cast(cast(ts as date) as timestamp) as ts, lower(regexp_extract(url, '://([^/?#]+)', 1)) as site, t as title, '0123456789ab' as post_id, {_guess("regexp_extract_all(lower(t), '[a-zà-ÿ'']+')")} as lang
  from (select *, {_slug("regexp_replace(url, '[?#].*$', '') || '-0123456789ab'")} as t from headlines where url is not null and ts is not null)) where title <> ''""",
    "leaderboard": """with r as (select lower(site) as subdomain, row_id, type, coalesce(domain, '') as domain, coalesce(url, '') as url, coalesce(author, '') as author, coalesce(lang, '') as lang, coalesce(reactions, 0) as reactions from blogs_posts where site <> '' and type is not null),
c as (select subdomain, string_agg(type, ', ' order by p) as categories from (select subdomain, type, min(row_id) as p from r group by all) group by subdomain)
select subdomain, arg_min(domain, row_id) as domain, arg_min(url, row_id) as base_url, arg_min(author, row_id) as name, arg_min(lang, row_id) as language, max(reactions) as subscribers, any_value(substring(categories, 1, 500)) as categories from r join c using (subdomain) group by subdomain""",
    "feed_groups": """select row_id, case when bool_or(coalesce(copy = 1, false) or regexp_matches(url, '/search/\\?f=rss|/tncms/')) over (partition by domain) then 'blox' else lower(domain) end as group
from headlines where domain is not null and url is not null and copy < 2""",
    "master_list": f"""with {_H}, m as (select strftime(ts, '%Y%m%d%H%M%S') as name, row_id, md5(title) as md5 from h)
select name, max(row_id) as size, arg_max(md5, row_id) as md5, 'http://h/' || name || '.gkg.csv.zip' as url from m where name >= '20260910000000' group by name""",
    "archive_days": f"with {_H} select ts, coalesce(replace(domain, chr(13), ''), '') as domain, coalesce(replace(url, chr(13), ''), '') as url, replace(title, chr(13), '') as title from h where ts >= timestamp '2026-09-10' and ts < timestamp '2026-09-12'",
    "slug_ids": "select row_id, '0a1b2c3d4e' as post_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) as site from headlines where url is not null",
    "capture_rows": """with r as (select strftime(seen, '%Y%m%d%H%M') as capture, url, kind, title from collect_headlines where seen is not null and title is not null),
o as (select capture, (row_number() over (order by capture) - 1) // 24 as b from (select distinct capture from r)) select url, kind, title, min(capture) as capture from r join o using (capture) group by b, url, kind, title""",
    "result_lines": r"""select concat(row_id, chr(9), coalesce(replace(replace(replace(domain, '\', '\\'), chr(9), '\t'), chr(10), '\n'), '\N'), chr(9), coalesce(replace(replace(replace(title, '\', '\\'), chr(9), '\t'), chr(10), '\n'), '\N')) as value from headlines""".replace("\\\\", "\\\\"),
    "stored_parts": f"with {_H} select distinct 'month=' || strftime(ts, '%Y-%m') as part from h",
}
