"""Versioned edits, latest rows, staging of feeds and blogs, and the unified table with its incremental rebuild."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions.text import moment, page
from newslake.operators.stories import flag, with_previous
from newslake.session import cut

# Staging rules.
FEED_LAG_DAYS, SETTLE_DAYS, WINDOW_DAYS = 3, 3, 7
BBC_SITES = ("bbc.com", "bbc.co.uk")
BBC_ENGLISH = (
    "news sport sounds iplayer weather newsround culture future programmes food bitesize mediacentre travel articles worklife reel innovation business arts audio videos live"
).split()


def latest(rows: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The newest row of each key: an aggregation that combines before the shuffle, so a hot key is no load."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, tie)).alias("_r"))
    return best.select(*keys, "_r.*")


def new_versions(history: DataFrame, staging: DataFrame, keys: tuple[str, ...] = ("domain", "url", "kind")) -> DataFrame:
    """Rows of `staging` whose title their page never had, numbered after the versions there are.

    A title seen before is no new version, even if it was changed since, and a title is staged once a page, by its first row
    (seen, ts, row_id). Only history of staged pages is read on. Null keys match null keys; rows with a null title are left
    out. `staging` is one batch: its pages' windows are small.
    """
    rest = [c for c in staging.columns if c not in (*keys, "title")]
    once = staging.where("title is not null").groupBy(*keys, "title").agg(F.min_by(F.struct(*rest), F.struct("seen", "ts", "row_id")).alias("_x"))
    staged = once.select(*keys, "title", "_x.*").select(*staging.columns)
    on = lambda a, b, cols: [a[c].eqNullSafe(b[c]) for c in cols]
    pages = staged.select(*keys).distinct()
    old = history.join(pages, on(history, pages, keys), "left_semi")
    had = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    titles = old.select(*keys, "title").distinct()
    fresh = staged.join(titles, on(staged, titles, [*keys, "title"]), "left_anti")
    w = Window.partitionBy(*keys).orderBy("seen", "ts", "title", "row_id")
    out = fresh.join(had, on(fresh, had, keys), "left").select(*(fresh[c] for c in fresh.columns if c != "version"), had["_n"])
    return out.withColumn("version", (F.coalesce("_n", F.lit(0)) + F.row_number().over(w)).cast("int")).drop("_n")


def english_letters(title: Column) -> Column:
    """At least half of the letters are unaccented Latin ones."""
    return F.regexp_count(title, F.lit("[A-Za-z]")) * 2 >= F.regexp_count(title, F.lit(r"\p{L}"))


def allowed_section(domain: Column, url: Column) -> Column:
    """Of the two BBC sites only English sections; a url without a section isn't one."""
    return ~(domain.isin(*BBC_SITES) & ~F.regexp_extract(url, r"^https?://[^/]+/([^/]+)/", 1).isin(*BBC_ENGLISH))


def stage_feeds(collected: DataFrame, start: str) -> DataFrame:
    """(ts, src, platform, domain, url, title, row_id): one row a page of the feeds, its first version first seen by a feed rather than a sitemap."""
    rows = collected.where((F.col("version") == 1) & (F.col("seen") >= moment(start)))
    first = F.struct((F.col("kind") != "sitemap"), F.col("seen"), F.col("row_id"))
    per = rows.groupBy("domain", "url").agg(F.min_by(F.struct(F.least("ts", "seen").alias("ts"), "seen", "title", "row_id"), first).alias("x"))
    out = per.select("x.ts", F.lit("feeds").alias("src"), F.lit("").alias("platform"), "domain", "url", "x.title", "x.row_id", "x.seen")
    keep = (F.col("ts") >= moment(start)) & (F.col("ts") >= F.col("seen") - F.expr(f"INTERVAL '{FEED_LAG_DAYS}' DAY")) & (F.col("title") != "") & english_letters(F.col("title"))
    return out.where(keep & allowed_section(F.col("domain"), F.col("url"))).drop("seen")


def stage_blogs(posts: DataFrame, start: str) -> DataFrame:
    """The same of the blogs: English posts by their first sighting."""
    rows = posts.where((F.col("version") == 1) & (F.col("ts") >= moment(start)))
    per = rows.groupBy("platform", "url").agg(F.min_by(F.struct("ts", "domain", "title", "lang", "row_id"), F.struct("seen", "row_id")).alias("x"), F.min("seen").alias("_seen"))
    out = per.select(F.least("x.ts", "_seen").alias("ts"), F.lit("blogs").alias("src"), "platform", F.regexp_replace("x.domain", r"^www\.", "").alias("domain"), "url", "x.title", "x.row_id", "x.lang")
    return out.where((F.col("ts") >= moment(start)) & (F.col("lang") == "en") & (F.col("title") != "")).drop("lang")


_UNIFIED = ["row_id", "ts", "src", "platform", "domain", "url", "title", "key"]


def _taking_part(gdelt: DataFrame, staged: DataFrame) -> DataFrame:
    """Rows of the collections with `_g`, gdelt's carried flag, and `_in`, whether a feed row is a page that gdelt has within the days around."""
    feeds = staged.where("src = 'feeds'").withColumn("_p", page(F.col("url"))).withColumn("_d", F.to_date("ts"))
    near = gdelt.select(page(F.col("url")).alias("_np"), F.to_date("ts").alias("_nd"))
    near = near.join(feeds.select(F.col("_p").alias("_np")).distinct(), "_np", "left_semi").distinct()  # only pages of the feeds go on
    band = (F.col("_p") == F.col("_np")) & (F.abs(F.datediff("_d", "_nd")) <= WINDOW_DAYS)
    hits = feeds.join(near, band, "left_semi").select(F.col("row_id").alias("_h")).distinct()
    marked = feeds.join(hits, F.col("row_id") == F.col("_h"), "left")
    none = F.lit(None).cast("int").alias("_g")
    feeds = marked.select(*_UNIFIED, none, F.col("_h").isNotNull().alias("_in"))
    blogs = staged.where("src = 'blogs'").select(*_UNIFIED, none, F.lit(False).alias("_in"))
    own = gdelt.select("row_id", "ts", F.lit("gdelt").alias("src"), F.lit("").alias("platform"), "domain", "url", "title", "key", F.col("flag").cast("int").alias("_g"), F.lit(False).alias("_in"))
    return own.unionByName(feeds).unionByName(blogs).where("ts is not null")


def _both_flags(rows: DataFrame) -> DataFrame:
    """`rows` (with `_in`) with `_own`, the flag within their collection, and `_nws`, that within gdelt and feeds together: four look-backs on one cut."""
    base = cut(rows.withColumn("_news", (F.col("src") != "blogs") & ~F.col("_in")))
    out = base
    for name, keys in (("_oa", ["src", "key"]), ("_os", ["src", "key", "domain"]), ("_na", ["_news", "key"]), ("_ns", ["_news", "key", "domain"])):
        out = with_previous(out, keys, name, base)
    return out.withColumn("_own", flag(F.col("_oa"), F.col("_os"))).withColumn("_nws", flag(F.col("_na"), F.col("_ns"))).drop("_oa", "_os", "_na", "_ns")


def _news_flag() -> Column:
    return F.when(F.col("src") == "blogs", F.col("_own")).when(F.col("_in"), 255).otherwise(F.col("_nws")).cast("int")


def unified(gdelt: DataFrame, staged: DataFrame) -> DataFrame:
    """The unified table in one build, without day boundaries: gdelt (flag carried as `flag`) and staged rows, all keyed.

    `copy` is each collection's own flag, carried for gdelt. `copy_news` windows gdelt and feeds together, leaving out feed
    rows that gdelt has (255); blogs keep their own. A feed row is gdelt's if gdelt has the page within the days around.
    """
    return _both_flags(_taking_part(gdelt, staged)).select(*_UNIFIED, F.coalesce("_g", "_own").alias("copy"), _news_flag().alias("copy_news"))


def rebuilt(gdelt: DataFrame, staged: DataFrame, stored: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of `unified` of only some days (day): their own rows, looked back on the stored rows of the seven days before.

    Rows of other days are read as stored, as what excludes them is stored too; days are a few dozen at most.
    """
    of_day = F.to_date("ts") == F.col("_day")
    days = F.broadcast(days.select(F.col("day").alias("_day")).distinct())
    named = lambda df: df.join(days, of_day, "left_semi")
    near = F.broadcast(days.select(F.explode(F.sequence(F.date_sub("_day", WINDOW_DAYS), F.date_add("_day", WINDOW_DAYS))).alias("_day")).distinct())
    around = gdelt.join(near, of_day, "left_semi")
    new = named(_taking_part(around, named(staged))).withColumn("_new", F.lit(True))
    before = stored.join(near, of_day, "left_semi").join(days, of_day, "left_anti")
    old = before.select(*_UNIFIED, F.lit(None).cast("int").alias("_g"), ((F.col("src") == "feeds") & (F.col("copy_news") == 255)).alias("_in"), F.lit(False).alias("_new"))
    out = _both_flags(new.unionByName(old)).where("_new")
    return out.select(*_UNIFIED, F.coalesce("_g", "_own").alias("copy"), _news_flag().alias("copy_news"))


def self_check(stored: DataFrame, start: str, feeds_start: str) -> DataFrame:
    """(rows, own_differ, blogs_differ, news_differ, early, early_differ): stored flags against all recomputed in one go; one row.

    Counted are rows whose look-back lies inside the table, from seven days after `start`; gdelt's own flag is carried, so it is
    not compared. Before the feeds begin gdelt's two flags have to be the same.
    """
    rows = stored.withColumn("_in", (F.col("src") != "blogs") & (F.col("copy_news") == 255))
    inside = F.col("ts") >= moment(start) + F.expr(f"INTERVAL '{WINDOW_DAYS}' DAY")
    early = (F.col("src") == "gdelt") & (F.col("ts") < moment(feeds_start))
    news = (F.col("src") != "blogs") & (F.col("copy_news") != 255)
    return _both_flags(rows).agg(
        F.count_if(inside).alias("rows"), F.count_if(inside & (F.col("src") != "gdelt") & (F.col("copy") != F.col("_own"))).alias("own_differ"),
        F.count_if(inside & (F.col("src") == "blogs") & (F.col("copy_news") != F.col("_own"))).alias("blogs_differ"), F.count_if(inside & news & (F.col("copy_news") != F.col("_nws"))).alias("news_differ"),
        F.count_if(early).alias("early"), F.count_if(early & (F.col("copy_news") != F.col("copy"))).alias("early_differ"),
    )


def day_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.to_date("ts").alias("day"), "src").agg(F.count(F.lit(1)).alias("n"))


def dirty_days(want: DataFrame, have: DataFrame, today: str, start: str) -> DataFrame:
    """(day): days to rebuild: where a count (day, src, n) differs and the 7 days after and before, and the last 3 days and today.

    The days before are added because a feed row's exclusion looks ahead; counts alone can't show an edit of equal size.
    """
    both = want.select("day", "src", F.col("n").alias("_w")).join(have.select("day", "src", F.col("n").alias("_h")), ["day", "src"], "full_outer")
    changed = both.where(F.coalesce("_w", F.lit(0)) != F.coalesce("_h", F.lit(0)))
    around = changed.select(F.explode(F.sequence(F.date_sub("day", WINDOW_DAYS), F.date_add("day", WINDOW_DAYS))).alias("day"))
    t = F.lit(today).cast("date")
    settle = want.sparkSession.range(SETTLE_DAYS + 1).select(F.date_sub(t, F.col("id").cast("int")).alias("day"))
    return around.unionByName(settle).distinct().where((F.col("day") >= F.lit(start).cast("date")) & (F.col("day") <= t))


def last_where(rows: DataFrame, key: str, value: str, ts: str = "ts") -> DataFrame:
    """(key, value): the newest non-empty value of each key."""
    return rows.groupBy(key).agg(F.max_by(F.when(F.col(value) != "", F.col(value)), F.when(F.col(value) != "", F.struct(ts, value))).alias(value))


