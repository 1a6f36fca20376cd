"""Monthly counts, shares and series; the source index; statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.operators.search import selected
from newslake.plans.request import Request

KINDS = ("gdelt", "feeds", "substack", "medium", "wordpress")


def monthly(rows: DataFrame, flag: str = "flag", extra: tuple[str, ...] = ()) -> DataFrame:
    """(month, stories, outlets, articles): rows flagged 0, flagged 0 or 1, and all."""
    return rows.groupBy(*extra, F.trunc("ts", "MONTH").alias("month")).agg(
        F.count_if(F.col(flag) == 0).alias("stories"), F.count_if(F.col(flag) <= 1).alias("outlets"), F.count(F.lit(1)).alias("articles")
    )


def counts(plain: DataFrame, unified: DataFrame | None, q: Request) -> DataFrame:
    """The monthly triple of a request over the parts it reads, partial counts added up."""
    out = None
    for part in q.parts():
        flag = "copy_news" if part.unified and q.both_news else "flag"
        one = monthly(selected(unified if part.unified else plain, q, part), flag)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("the request reads no part of the archive")
    return out.groupBy("month").agg(*(F.sum(c).alias(c) for c in ("stories", "outlets", "articles")))


def share(value: Column, total: Column) -> Column:
    """Percent; 0 where the total is 0 or missing."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise(value * 100.0 / total)


def shares(series: DataFrame, totals: DataFrame, measure: str = "stories") -> DataFrame:
    """(series, month, value, share): each month's value against the totals of the same month."""
    t = totals.select("month", F.col(measure).alias("_t"))
    return series.join(t, "month", "left").select("series", "month", F.col(measure).alias("value"), F.round(share(F.col(measure), F.col("_t")), 6).alias("share"))


def filled(series: DataFrame, first: str, last: str, begins: dict[str, str] | None = None) -> DataFrame:
    """Every month of a range of every series: 0 where there is nothing, null before the month a series' collections begin (`begins`, by name)."""
    months = series.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 month)) as month")
    names = series.select("series").distinct()
    frame = names.crossJoin(F.broadcast(months))  # series are at most MAX_SERIES, months a few hundred
    out = frame.join(series, ["series", "month"], "left")
    start = F.lit(None).cast("date")
    for name, day in (begins or {}).items():
        start = F.when(F.col("series") == name, F.trunc(F.lit(day).cast("date"), "MONTH")).otherwise(start)
    there = start.isNull() | (F.col("month") >= start)
    return out.select("series", "month", *(F.when(there, F.coalesce(c, F.lit(0))).alias(c) for c in ("stories", "outlets", "articles")))


def peaks(series: DataFrame, measure: str = "stories") -> DataFrame:
    """(series, total, peak_month, peak, first_month, last_month): the earliest greatest month, first and last months with any."""
    v = F.col(measure)
    best = F.max_by(F.struct("month", v.alias("v")), F.struct(v, -F.unix_date("month")))
    out = series.groupBy("series").agg(F.sum(v).alias("total"), best.alias("b"), F.min(F.when(v > 0, F.col("month"))).alias("first_month"), F.max(F.when(v > 0, F.col("month"))).alias("last_month"))
    return out.select("series", "total", F.col("b.month").alias("peak_month"), F.col("b.v").alias("peak"), "first_month", "last_month")


def rollup(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, first, last): rows of each site."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def merged(states: DataFrame, *keys: str) -> DataFrame:
    """Partial states (n, first, last) added up."""
    return states.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))


def kinds_of(unified_states: DataFrame) -> DataFrame:
    """(domain, n, first, last, kinds): sites over all collections, with the kinds that have them in a fixed order."""
    kind = F.when(F.col("src") == "blogs", F.col("platform")).otherwise(F.col("src"))
    out = unified_states.withColumn("_kind", kind).groupBy("domain").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.collect_set("_kind").alias("_k"))
    listed = F.filter(F.array(*map(F.lit, KINDS)), lambda k: F.array_contains("_k", k))
    return out.select("domain", "n", "first", "last", F.array_join(listed, ",").alias("kinds"))


def typeahead(sites: DataFrame, text: str, limit: int = 12) -> DataFrame:
    """The sites whose name has the text, those beginning with it first, then the largest."""
    q = F.lit(text.lower())
    return sites.where(F.contains("domain", q)).orderBy(F.startswith("domain", q).desc(), F.col("n").desc(), F.col("domain")).limit(limit)


def listing(sites: DataFrame, letter: str, after: str = "", limit: int = 10_000) -> DataFrame:
    """Sites by name beginning with a letter, or with a digit for '0', after a name."""
    hit = F.col("domain").rlike("^[0-9]") if letter == "0" else F.startswith("domain", F.lit(letter))
    return sites.where(hit & (F.col("domain") > after)).orderBy("domain").limit(limit)


def stats(states: DataFrame, *keys: str) -> DataFrame:
    """(keys, first, last, rows, sources): extent of the archive, exact."""
    agg = (F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("rows"), F.countDistinct("domain").alias("sources"))
    return states.groupBy(*keys).agg(*agg)


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n): the k most frequent values, ties by value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(key)).limit(k)


