"""Term predicates, result pages with cursors, and the collapse of copies into stories."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions.fold import fold, tokens
from newslake.functions.text import moment
from newslake.plans.request import PAGE, WINDOW, Part, Request


def matches(q: Request, title: str = "title", words: Column | None = None) -> Column:
    """Word mode: some group has all its words among the title's tokens, accents aside. Substring mode: the text itself, case aside.

    `words` are the title's tokens where they are stored; else they are made.
    """
    if not q.q:
        return F.lit(True)
    if q.mode == "substring":
        return F.contains(F.lower(title), F.lit(q.q.lower()))
    have = tokens(fold(F.col(title))) if words is None else words
    if all(len(g) == 1 for g in q.groups) and len(q.groups) > 1:
        return F.arrays_overlap(have, F.array(*(F.lit(g[0]) for g in q.groups)))
    return reduce(Column.__or__, (reduce(Column.__and__, (F.array_contains(have, w) for w in g)) for g in q.groups))


def selected(table: DataFrame, q: Request, part: Part | None = None) -> DataFrame:
    """The rows of a table a request selects, paging aside. Range and site predicates reach the scan."""
    first, last = (part.first, part.last) if part else (q.first, q.last)
    out = table.where((F.col("ts") >= moment(dt.datetime.combine(first, dt.time()))) & (F.col("ts") < moment(dt.datetime.combine(last + dt.timedelta(days=1), dt.time()))))
    if "month" in table.columns:  # partitions of a stored archive
        out = out.where(F.col("month").between(f"{first:%Y-%m}", f"{last:%Y-%m}"))
    if q.domains:
        out = out.where(F.col("domain").isin(*q.domains))
    if part and part.unified:
        out = out.where(F.col("src").isin(*q.src))
        if q.both_news:
            out = out.where("copy_news <> 255")
    return out.where(matches(q, words=F.col("words") if "words" in table.columns else None))


ORDER = ("ts", "domain", "url", "row_id")


def in_order(rows: DataFrame, q: Request, limit: int, skip: int | None = None) -> DataFrame:
    """The first `limit` rows from the cursor in the page's total order, with their place `pos`: a top-k, then a window over k rows."""
    way = [F.col(c).desc() if q.newest else F.col(c).asc() for c in ORDER]
    if q.cursor:
        rows = rows.where(F.col("ts") <= moment(q.cursor) if q.newest else F.col("ts") >= moment(q.cursor))
    skip = q.skip if skip is None else skip
    top = rows.orderBy(*way).offset(skip).limit(limit) if skip else rows.orderBy(*way).limit(limit)
    return top.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*way)))


def mixed(plain: DataFrame, unified: DataFrame, q: Request, limit: int) -> DataFrame:
    """`in_order` over the parts a request reads: one top-k a part, from the cursor on, then the first `limit` of all.

    Both tables have a `key`; a blog post's is kept apart from any news story's. `src` and `platform` are '' on the plain one.
    """
    cols = [*ORDER, "title", "key", "src", "platform"]
    out = None
    for part, skip in q.reading():
        rows = selected(unified if part.unified else plain, q, part)
        if part.unified:
            rows = rows.withColumn("key", F.when(F.col("src") == "blogs", F.concat(F.lit("blogs\t"), F.col("key"))).otherwise(F.col("key")))
        else:
            rows = rows.withColumn("src", F.lit("")).withColumn("platform", F.lit(""))
        one = in_order(rows.select(*cols), q, limit, skip)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return plain.limit(0).select(*ORDER, "title", "key", F.lit("").alias("src"), F.lit("").alias("platform"), F.lit(0).alias("pos"))
    return out if len(q.reading()) == 1 else in_order(out.drop("pos"), q, limit, 0)


def collapse(page: DataFrame, want: int = PAGE) -> DataFrame:
    """(story, ts, domain, url, title, n, sites, copies): rows (pos, key, ...) of a page as stories in order of first appearance.

    Rows from the first one on that would begin story `want` + 1 are not used. `copies` are the other rows' site and url.
    """
    one = Window.partitionBy(F.lit(0))  # a page has at most WINDOW rows
    ranked = page.withColumn("_first", F.min("pos").over(Window.partitionBy("key")))
    ranked = ranked.withColumn("story", F.dense_rank().over(one.orderBy("_first")))
    ranked = ranked.withColumn("_cut", F.min(F.when(F.col("story") > want, F.col("pos"))).over(one)).where("_cut is null or pos < _cut")
    lead = F.min_by(F.struct("ts", "domain", "url", "title"), "pos").alias("lead")
    rest = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "domain", "url"))), 2, WINDOW), lambda x: F.struct(x["domain"].alias("domain"), x["url"].alias("url")))
    out = ranked.groupBy("story").agg(lead, F.count(F.lit(1)).alias("n"), F.countDistinct("domain").alias("sites"), rest.alias("copies"))
    return out.select("story", "lead.*", "n", "sites", "copies")


def other_sites(stories: DataFrame) -> DataFrame:
    """(story, domain, url, n): the other sites of each story, with their first url and number of copies."""
    flat = stories.select("story", F.col("domain").alias("_own"), F.posexplode("copies").alias("i", "c"))
    return flat.where("c.domain <> _own").groupBy("story", F.col("c.domain").alias("domain")).agg(F.min_by("c.url", "i").alias("url"), F.count(F.lit(1)).alias("n"))


@dataclass
class Page:
    stories: DataFrame
    used: int
    cursor: dt.datetime | None
    skip: int


def page(rows: DataFrame | Callable[[int], DataFrame], q: Request, size: int = PAGE, window: int = WINDOW) -> Page:
    """One page of `rows` (already selected, with `key`; or a function of the limit, as `mixed` is) and where the next one begins.

    `size` rows are read; if they make fewer than half as many stories, `window` rows. A next page exists while rows are
    left over or the read was full: it starts at the last used ts, skipping the rows shown there.
    """
    limit = size
    read = rows if callable(rows) else lambda n: in_order(rows, q, n)
    top = read(limit).cache()
    got = top.count()
    stories = collapse(top, size).cache()
    if got == size and stories.count() < size / 2:
        top.unpersist()
        limit = window
        top = read(limit).cache()
        got = top.count()
        stories = collapse(top, size).cache()
    used = stories.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not used or (used == got and got < limit):
        return Page(stories, used, None, 0)
    last = top.where(F.col("pos") == used).first()["ts"]
    at = top.where((F.col("pos") <= used) & (F.col("ts") == moment(last))).count()
    return Page(stories, used, last, at + (q.skip if q.cursor == last else 0))
