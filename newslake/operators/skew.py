"""Problem 3: per-key results where a few keys hold most rows.

A frequent-items sketch (one bounded state a task, merged) names the candidates; their exact counts decide which are
heavy. The heavy list has at most 1/share keys, whatever the data, so it is broadcast: its rows are salted by the value
they hold, aggregated per (key, salt) and merged; all other keys take an ordinary shuffle; the two are united.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import site
from newslake.session import cut, partitions

SKETCH_ITEMS = 4096


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, n, total): the keys with more than `share` of all rows of `df`, with exact counts. Null is no key, but counts as a row.

    The sketch misses no key above total * 3.5 / SKETCH_ITEMS; at most ceil(1 / share) keys can pass.
    """
    assert share > 3.5 / SKETCH_ITEMS, "the sketch can't tell shares this small"
    k = math.ceil(1 / share) * 2
    rows = df.select(F.col(key).alias("_k"))
    top = rows.agg(F.expr(f"approx_top_k(_k, {k}, {SKETCH_ITEMS})").alias("t"), F.count(F.lit(1)).alias("total"))
    likely = cut(top.select(F.explode("t").alias("t"), "total").select(F.col("t.item").alias("_k"), "total").where("_k is not null"))
    counted = rows.join(F.broadcast(likely), "_k").groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    return counted.where(F.col("n") > F.col("total") * share).select(F.col("_k").alias(key), "n", "total")


def _totals(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("title").alias("titles")
    )


def site_totals(headlines: DataFrame, share: float = 0.01, salts: int | None = None) -> DataFrame:
    """(site, n, first_ts, last_ts, titles) of every site, null domains as the site null.

    Counts rows, not records: repeated rows count again. `titles` are distinct non-null titles as typed.
    Hot sites (more than `share` of all rows, null included) are salted by the title's hash, so equal titles of a site
    meet in one salt and distinct counts add up; a title that is hot itself is reduced before the shuffle.
    """
    salts = salts or max(8, partitions(headlines.sparkSession))
    rows = headlines.select(site(F.col("domain")).alias("site"), "ts", "title")
    hot = cut(heavy_keys(rows, "site", share))
    marked = rows.join(F.broadcast(hot.select("site", F.lit(True).alias("_hot"))), "site", "left")
    is_hot = F.coalesce("_hot", F.lit(False)) | F.col("site").isNull()
    heavy = marked.where(is_hot).withColumn("_salt", F.pmod(F.xxhash64("title"), F.lit(salts)))
    parts = heavy.groupBy("site", "_salt", "title").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    heavy = parts.groupBy("site").agg(F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.count("title").alias("titles"))
    return heavy.unionByName(_totals(marked.where(~is_hot), "site"))


def source_totals(sources: DataFrame) -> DataFrame:
    """(site, n, first_seen, last_seen): partial states of `sources` added up by site; null counts add nothing."""
    return sources.groupBy(site(F.col("domain")).alias("site")).agg(F.sum("n").alias("n"), F.min("first").alias("first_seen"), F.max("last").alias("last_seen"))


def hot_sites(headlines: DataFrame, share: float = 0.04) -> DataFrame:
    """(site): the sites with more than `share` of the rows of `headlines`."""
    return heavy_keys(headlines.select(site(F.col("domain")).alias("site")), "site", share).select("site")
