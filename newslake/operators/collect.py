"""Urls, slugs, language guesses, fetch logs and polling of the collectors, as expressions and small plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Query parameters that only track, two-level suffixes, function words of English and of other languages,
# phrases of challenge pages, urls of a platform's feeds.
TRACKING = r"^(utm_.*|fbclid|gclid|ocid|cmpid|cmp|ns_.*|mc_.*|ito|ftag|src|ref|sref|rss|output|s|ss|smid|smtyp|partner|icid|ICID|itm_.*|_gl|taid|guccounter|guce_referrer.*|syn-.*)$"
SUFFIXES = (
    "co.uk com.au co.nz co.za com.ph co.in org.uk gov.uk ac.uk net.au org.au com.br com.mx co.jp com.sg com.hk com.pk com.bd com.ng co.ke com.my com.tr"
).split()
ENGLISH = """
the a an of to in is are and for on with how why what your you my this that it its not from
by at be as or we i can do will new about vs into than more most all when who one our their has have was
were up out no get make just over after before first best top guide review tips things ways should could
would every don't dont without between through
""".split()
OTHER = """
yang dan dengan untuk tidak ini itu dari adalah kita saya que con una las los del como para
uma não você dos das der und ist mit für nicht eine les des est une pour dans che per non gli sono della
och att för är med ile bir için ve bu och
""".split()
CHALLENGE = r"(?i)Just a moment|Please enable JS|challenge-platform|_cf_chl|cf-browser-verification|captcha-delivery|DataDome|Access Denied|Request unsuccessful|Incapsula|perimeterx|px-captcha|/_fs-ch-"
PLATFORM_FEED = r"/search/\?f=rss|/tncms/"


def canonical_url(url: Column) -> Column:
    """Host in lower case, `/` for no path, tracking parameters and fragment dropped, the others encoded anew; '' for null and other schemes."""
    m = lambda i: F.regexp_extract(F.trim(url), r"^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", i)
    plain = lambda x: F.coalesce(F.try_url_decode(x), F.replace(x, F.lit("+"), F.lit(" ")))
    coded = lambda x: F.replace(F.replace(F.url_encode(plain(x)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = lambda p: F.regexp_extract(p, "^[^=]*", 0)
    kept = F.filter(F.split(m(4), "&"), lambda p: (p != "") & ~plain(name(p)).rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(name(p)), F.lit("="), coded(F.regexp_extract(p, "=(.*)$", 1)))), "&")
    path = F.when(m(3) == "", "/").otherwise(m(3))
    full = F.concat(m(1), F.lit("://"), F.lower(m(2)), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(m(1), F.lit("")) != "", full).otherwise("")


def registrable(url: Column) -> Column:
    """The site of a url: its host without port and `www.`, cut to the last two labels, or three under a two-level suffix."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), r"^[a-zA-Z]+://([^/?#]+)", 1)), r":\d+$", ""), r"^www\.", "")
    parts = F.split(host, r"\.")
    tail = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(tail(2).isin(*SUFFIXES), tail(3)).otherwise(tail(2))


def slug_title(url: Column) -> Column:
    """A title from the last path segment: a trailing id of 8 to 16 hex digits dropped, percent codes decoded, hyphens as spaces."""
    words = F.try_url_decode(F.replace(F.regexp_replace(_last_segment(url), _POST_ID, ""), F.lit("+"), F.lit("%2B")))
    return F.trim(F.regexp_replace(F.replace(words, F.lit("-"), F.lit(" ")), r"\s+", " "))


_POST_ID = r"-[0-9a-f]{8,16}$"


def _last_segment(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[^:]+://[^/]*.*?/([^/]*)/*$", 1)


def slug_post_id(url: Column) -> Column:
    """The trailing id of a slug, else ''."""
    return F.regexp_extract(_last_segment(url), r"-([0-9a-f]{8,16})$", 1)


def slug_site(url: Column, shared: str = "medium.com") -> Column:
    """The publication of a post: the first of two or more path segments on the shared host, else the host."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1))
    segments = F.filter(F.split(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    return F.when((host == shared) & (F.size(segments) >= 2), F.get(segments, F.lit(0))).otherwise(host)


def guess_lang(title: Column) -> Column:
    """'en' if an English marker word is there and none of other languages, else ''."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"([a-zà-ÿ']+)"), F.lit(1))
    lit = lambda ws: F.array(*map(F.lit, ws))
    return F.when(F.arrays_overlap(words, lit(OTHER)), "").when(F.arrays_overlap(words, lit(ENGLISH)), "en").otherwise("")


def classify_fetch(http: Column, body: Column) -> Column:
    """The label of a fetch, the first that holds: status 0 or null is a network error; a body counts by what it begins with."""
    challenged = F.substring(body, 1, 20_000).rlike(CHALLENGE)
    head = F.lower(F.regexp_replace(F.substring(body, 1, 2000), r"^[\ufeff\s]+", ""))
    page = head.rlike(r"^(<!doctype html|<html)") | F.contains(F.substring(head, 1, 300), F.lit("<html"))
    challenge_too = http.isin(429, 503) & F.coalesce(challenged, F.lit(False))
    return (
        F.when(http == 304, "304").when(F.coalesce(http, F.lit(0)) == 0, "error").when(http.isin(401, 403) | challenge_too, "blocked").when(http >= 400, F.concat(F.lit("http "), http.cast("string")))
        .when(F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", "")) == "", "empty").when(page, F.when(challenged, "blocked").otherwise("html")).otherwise("ok")
    )


def poll_gaps(posts: DataFrame, now: Column, k: int = 10) -> DataFrame:
    """(site, gap_hours): mean hours between each site's ten latest posts and now, a post once, by its earliest ts."""
    first = posts.groupBy("site", "url").agg(F.min("ts").alias("t"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.col("t").desc(), "url"))
    best = first.withColumn("_r", rank).where(F.col("_r") <= k).groupBy("site").agg(F.min("t").alias("oldest"), F.count(F.lit(1)).alias("n"))
    minutes = F.floor((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("oldest").cast("timestamp"))) / 60)
    return best.select("site", F.round(minutes / F.col("n") / 60, 6).alias("gap_hours"))


def poll_interval(gaps: DataFrame) -> DataFrame:
    """(site, hours): half the gap between 3 and 24 hours, spread by a hash of the site between 0.8 and 1.2."""
    spread = 0.8 + 0.4 * (F.pmod(F.crc32(F.encode("site", "utf-8")), F.lit(1000)) / 1000)
    return gaps.select("site", (F.greatest(F.least(F.col("gap_hours") * 0.5, F.lit(24.0)), F.lit(3.0)) * spread).alias("hours"))


def poll_queue(index: DataFrame, state: DataFrame, now: Column, horizon: Column) -> DataFrame:
    """(site, reason): sites to ask: listed with a newer change than stored, unseen and changed since the horizon, or due with a domain of their own; blocked ones never."""
    both = index.select("site", "lastmod").join(state.select("site", F.col("lastmod").alias("_had"), "domain", "due", "status"), "site", "full_outer")
    reason = F.when(F.col("_had").isNotNull() & (F.col("lastmod") > F.col("_had")), "changed").when(F.col("_had").isNull() & F.col("status").isNull() & (F.col("lastmod") > horizon), "new").when((F.coalesce("domain", F.lit("")) != "") & (F.col("due") <= now), "due")
    return both.withColumn("reason", reason).where("reason is not null and coalesce(status, '') <> 'blocked'").select("site", "reason")


def feed_groups(feeds: DataFrame) -> DataFrame:
    """Enabled `feeds` (domain, url, host, enabled, perhaps platform) with the group that shares a rate limit: one for all sites of a platform, else the host."""
    blox = F.coalesce(F.col("url").rlike(PLATFORM_FEED), F.lit(False))
    if "platform" in feeds.columns:
        blox |= F.coalesce(F.col("platform") == "blox", F.lit(False))
    w = Window.partitionBy("domain")  # a site's few feeds
    return feeds.where("enabled").withColumn("group", F.when(F.max(blox).over(w), "blox").otherwise(F.col("host")))


def best_sitemaps(found: DataFrame) -> DataFrame:
    """(domain, sitemap, feeds, blocked): per site the sitemap with most items, the number of good feeds and the labels of failures."""
    ok = F.col("label") == "ok"
    return found.groupBy("domain").agg(
        F.max_by(F.when(ok & (F.col("kind") == "sitemap"), F.col("url")), F.when(ok & (F.col("kind") == "sitemap"), F.struct("items", "url"))).alias("sitemap"),
        F.count_if(ok & (F.col("kind") == "feed")).alias("feeds"), F.array_join(F.array_sort(F.collect_set(F.when(~ok, F.col("label")))), ",").alias("blocked"),
    )


def chosen_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates (domain, kind, place, url, ok) in order, each url once, sitemaps up to the first that works, feeds up to the third."""
    once = candidates.groupBy("domain", "kind", "url").agg(F.min_by(F.struct("place", "ok"), "place").alias("_x")).select("domain", "kind", "url", "_x.*")
    before = F.coalesce(F.sum(F.col("ok").cast("int")).over(Window.partitionBy("domain", "kind").orderBy("place", "url").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return once.withColumn("_b", before).where(F.col("_b") < F.when(F.col("kind") == "sitemap", 1).otherwise(3)).drop("_b")


def merge_state(state: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Site states after updates: an update's values where it has any, `fetched` only of good fetches; a `domain` is where a site's own subdomain redirected to."""
    rest = [c for c in state.columns if c not in keys]
    both = state.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in rest)).join(updates.select(*keys, *(F.col(c).alias(f"_n_{c}") for c in rest)), keys, "full_outer")
    good = F.coalesce("_n_status", F.lit("")).isin("ok", "304")
    pick = lambda c: F.when(good, F.col("_n_fetched")).otherwise(F.col("_o_fetched")) if c == "fetched" else F.coalesce(f"_n_{c}", f"_o_{c}")
    return both.select(*keys, *(pick(c).alias(c) for c in rest))


def capture_rows(captures: DataFrame, batch: int = 24) -> DataFrame:
    """Rows (capture, url, kind, title, ...) once a batch of captures in order, by their first capture."""
    order = captures.select("capture").distinct().withColumn("_b", F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("capture")) - 1) / batch))  # one row a capture
    rows = captures.join(order, "capture")
    rest = [c for c in captures.columns if c not in ("url", "kind", "title")]
    return rows.groupBy("_b", "url", "kind", "title").agg(F.min_by(F.struct(*rest), "capture").alias("_x")).select("url", "kind", "title", "_x.*")


def due(log: DataFrame, now: Column, hours: float, key: str = "feed") -> DataFrame:
    """(key): what was last fetched well more than `hours` ago, or never."""
    good = F.max(F.when(F.col("label").isin("ok", "304"), F.col("ts"))).alias("_t")
    return log.groupBy(key).agg(good).where(F.col("_t").isNull() | (F.col("_t") < now - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND"))).select(key)


def reactions(counts: Column) -> Column:
    """The sum over a map of reaction counts, floored at 0."""
    return F.greatest(F.lit(0), F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0))))


def leaderboard(rows: DataFrame) -> DataFrame:
    """(subdomain, domain, base_url, name, language, subscribers, categories): listings (place, category, subdomain, ...) as one row a blog.

    The first listing gives the fields, categories keep their order once each, cut at 500 characters; null counts are 0.
    """
    cats = F.transform(F.array_sort(F.collect_list(F.struct("place", "category"))), lambda x: x["category"])  # a blog is in a few dozen categories
    first = [F.min_by(F.coalesce(c, F.lit("")), "place").alias(c) for c in ("domain", "base_url", "name", "language") if c in rows.columns]
    per = rows.where("subdomain <> ''").groupBy(F.lower("subdomain").alias("subdomain"))
    return per.agg(*first, F.max(F.coalesce("subscribers", F.lit(0))).alias("subscribers"), F.substring(F.array_join(F.array_distinct(cats), ", "), 1, 500).alias("categories"))


def pages_to_read(pages: DataFrame, since: DataFrame, most: int = 4, full: int = 10) -> DataFrame:
    """(site, page): the archive pages read of each site: on while the page before is full and all newer than what is stored.

    pages: (site, page from 0, oldest, posts); since: (site, ts). A site without `since` has nothing stored; a page without dates ends it.
    """
    known = pages.join(since.select("site", F.col("ts").alias("_since")), "site", "left")
    on = F.coalesce((F.col("posts") >= full) & (F.col("_since").isNull() | (F.col("oldest") > F.col("_since"))) & F.col("oldest").isNotNull(), F.lit(False))
    before = Window.partitionBy("site").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # at most a few pages a site
    return known.where(F.col("page") < most).withColumn("_on", F.coalesce(F.min(on).over(before), F.lit(True))).where("_on").select("site", "page")


def files_to_read(listed: DataFrame, state: DataFrame, today: str, days: int = 7) -> DataFrame:
    """(file, day, lastmod) of daily files within `days` before `today` that are new, failed, or changed since they were read; by day."""
    t = F.lit(today).cast("date")
    had = state.select("file", F.col("lastmod").alias("_had"), F.col("status").alias("_status"))
    recent = listed.where((F.col("day") >= F.date_sub(t, days)) & (F.col("day") <= t)).join(had, "file", "left")
    read = F.coalesce(F.col("_status").isin("ok", "304") & (F.col("_had") == F.col("lastmod")), F.lit(False))
    return recent.where(~read).select("file", "day", "lastmod").orderBy("day", "file")


def walk_queue(sites: DataFrame, marks: DataFrame, since: Column, unfetched: bool = False) -> DataFrame:
    """(site, lastmod): sites whose archive is to be walked back: active since, not refused or gone, not walked to the end, newest first."""
    open_ = sites.where((F.col("lastmod") >= since) & ~F.coalesce("status", F.lit("")).isin("blocked", "robots", "http 404", "http 410"))
    if unfetched:
        open_ = open_.where("fetched is null or year(fetched) <= 2000")
    return open_.join(marks.where("done").select("site"), "site", "left_anti").select("site", "lastmod").orderBy(F.col("lastmod").desc(), "site")


def queued(rows: DataFrame, queue: DataFrame, key: str = "site") -> DataFrame:
    """The rows of the queued sites."""
    return rows.join(queue.select(key), key, "left_semi")


def on_own_domain(posts: DataFrame, sites: DataFrame) -> DataFrame:
    """The posts of the sites that have a domain of their own."""
    return queued(posts, sites.where("domain <> ''"))


def new_and_changed(rows: DataFrame, key: str, seen: Column) -> DataFrame:
    """(key, new, changed): what one run stored of each feed or site, and how much of it were edits."""
    return rows.where(F.col("seen") == seen).groupBy(key).agg(F.count(F.lit(1)).alias("new"), F.count_if(F.col("version") > 1).alias("changed"))


def item_extent(items: DataFrame, key: str = "url") -> DataFrame:
    """(key, items, newest, oldest, sample, sample_url): the items of each candidate; the sample is its first by `place`, cut at 120 characters."""
    first = F.min_by(F.struct("title", "item_url"), "place")
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.max("ts").alias("newest"), F.min("ts").alias("oldest"), F.substring(first["title"], 1, 120).alias("sample"), first["item_url"].alias("sample_url"))


def page_report(pages: DataFrame, files_a_day: int = 16) -> DataFrame:
    """(pages, titled, files, sites, pages_a_file, pages_a_day, sites_a_day) of sampled pages (file, ts, url, title); one row, whole-number estimates."""
    n, k = F.col("pages"), F.greatest(F.col("files"), F.lit(1))
    per = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("title") != "").alias("titled"), F.countDistinct("file").alias("files"), F.countDistinct(registrable(F.col("url"))).alias("sites"))
    whole = lambda x: F.floor(x).cast("long")
    return per.select("*", whole(n / k).alias("pages_a_file"), whole(n * files_a_day / k).alias("pages_a_day"), whole(F.col("sites") * files_a_day / k).alias("sites_a_day"))


def lost_outlets(sites: DataFrame, lost: DataFrame) -> DataFrame:
    """(site, n, was): which lost outlets (site, was) are among the counted sites (site, n); n is null for the absent."""
    return lost.select("site", "was").join(sites.select("site", "n"), "site", "left").select("site", "n", "was")


def sampled_files(files: DataFrame, days: int, per_day: int, seed: int = 0) -> DataFrame:
    """(month, day, file): of each month `days` days and of each of those `per_day` files (file, day), drawn by a hash and the seed."""
    rows = files.withColumn("month", F.trunc("day", "MONTH"))
    drawn = lambda *c: F.xxhash64(*c, F.lit(seed))
    kept = rows.select("month", "day").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("month").orderBy(drawn("day"), "day"))).where(F.col("_r") <= days)
    chosen = rows.join(F.broadcast(kept.drop("_r")), ["month", "day"]).withColumn("_r", F.row_number().over(Window.partitionBy("day").orderBy(drawn("file"), "file")))  # a day's few files
    return chosen.where(F.col("_r") <= per_day).select("month", "day", "file")


def file_queue(files: DataFrame, newest_first: bool = True, most: int | None = None) -> DataFrame:
    """Files (name, ...) in the order they are read, at most so many."""
    out = files.orderBy(F.col("name").desc() if newest_first else F.col("name"))
    return out if most is None else out.limit(most)


def staged(rows: DataFrame, *keys: str) -> DataFrame:
    """One row a key of what a run collected, the first by (seen, row_id)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("seen", "row_id")).alias("_x")).select(*keys, "_x.*").select(*rows.columns)
