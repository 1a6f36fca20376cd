"""The queries of the core, by name; see `newslake.catalogue` for those of the reference's own operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.operators import history, late, skew
from newslake.session import cut, table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hot_sites(table(spark, d, "headlines"))


def p3_site_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.site_totals(table(spark, d, "headlines"))


def p3_source_totals(spark: SparkSession, d: str) -> DataFrame:
    return skew.source_totals(table(spark, d, "sources"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return history.changed_titles(history.loaded_by_days(table(spark, d, "collect_headlines")))


def p4_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The ledger after three loads by day of sighting, the middle days last: what was known, and what was superseded when."""
    return history.split_entity(history.loaded_by_days(table(spark, d, "collect_headlines")))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return cut(reduce(DataFrame.unionByName, (late.first_events(table(spark, d, t), t) for t in ("collect_headlines", "blogs_posts"))))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return late.ruled(events, late.deltas(events)).distinct()


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts after the deltas of each arrival day up to the middle one, and then the later ones onto that state."""
    changes = cut(late.deltas(_events(spark, d)))
    middle = changes.agg(F.median("version")).first()[0]
    middle = 0 if middle is None else int(middle)
    state = cut(late.apply_deltas(changes.limit(0), changes.where(F.col("version") <= middle)))
    return late.apply_deltas(state, changes.where(F.col("version") > middle)).select("tbl", "period", "site", "n")


def p6_deltas(spark: SparkSession, d: str) -> DataFrame:
    return late.deltas(_events(spark, d)).drop("until")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p3_site_totals, p3_source_totals, p4_found, p4_ledger, p6_found, p6_counts, p6_deltas)}

_SITE = "regexp_replace(lower(trim(domain)), '^www\\.|\\.$', '', 'g')"
_PAGE = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://', ''), '^www\\.', ''), '/+$', '')"
_SQUEEZED = "trim(regexp_replace(title, '[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+', ' ', 'g'))"
_SIGHTINGS = f"""s as (
  select {_PAGE} as page, coalesce(kind, '') as kind, {_SQUEEZED} as value, cast(floor(epoch(seen)) as bigint) as seen_at, row_id as tie
  from collect_headlines where {_SQUEEZED} <> '' and seen is not null and url is not null
)"""


def _periods(source: str) -> str:
    return f"""select page, kind, value, seen_at as valid_from, lead(seen_at) over (partition by page, kind order by seen_at, tie) as valid_to from (
    select *, lag(value) over (partition by page, kind order by seen_at, tie) as was from {source}) where was is distinct from value"""


_EVENTS = f"""e as (
  select *, case when seen < (period + 1) * 86400 then 'on_time' when seen < (period + 1) * 86400 + 72 * 3600 then 'corrects' else 'dropped' end as outcome from (
    select *, cast(floor(event / 86400.0) as bigint) as period from (
      select tbl, id, site, cast(floor(epoch(s)) as bigint) as seen, cast(floor(epoch(case when ts is null or epoch(ts) = 0 or ts > s then s else ts end)) as bigint) as event from (
        select *, row_number() over (partition by tbl, page, kind order by s, id) as rn from (
          select 'collect_headlines' as tbl, row_id as id, {_SITE} as site, seen as s, ts, coalesce({_PAGE}, chr(31) || row_id) as page, coalesce(kind, '') as kind from collect_headlines
          union all
          select 'blogs_posts', row_id, {_SITE}, seen, ts, coalesce({_PAGE}, chr(31) || row_id), coalesce(kind, '') from blogs_posts
        ) where s is not null) where rn = 1))
)"""
_DELTAS = f"""{_EVENTS}, d as (
  select tbl, period, site, version, sum(added) over w as new, sum(added) over w - added as old from (
    select tbl, period, site, seen // 86400 as version, count(*) as added from e where outcome <> 'dropped' group by all)
  window w as (partition by tbl, period, site order by version)
)"""

ORACLES: dict[str, str] = {
    "p3_found": f"select site from (select {_SITE} as site, count(*) as n from headlines group by 1) where site is not null and n > 0.04 * (select count(*) from headlines)",
    "p3_site_totals": f"select {_SITE} as site, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, count(distinct title) as titles from headlines group by 1",
    "p3_source_totals": f"select {_SITE} as site, cast(sum(n) as bigint) as n, min(\"first\") as first_seen, max(\"last\") as last_seen from sources group by 1",
    "p4_found": f"""with {_SIGHTINGS}, p as ({_periods('s')})
select page, kind, valid_from, coalesce(valid_to, 0) as valid_to from (select *, count(*) over (partition by page, kind) as k from p) where k > 1 group by all""",
    "p6_found": f"with {_EVENTS} select tbl, id, outcome from e where outcome <> 'on_time'",
    "p6_counts": f"with {_EVENTS} select tbl, period, site, count(*) as n from e where outcome <> 'dropped' group by all",
    "p6_deltas": f"with {_DELTAS} select tbl, period, site, version, 'retract' as kind, cast(-old as bigint) as n from d where old <> 0 union all select tbl, period, site, version, 'assert', cast(new as bigint) from d",
    "p4_ledger": f"""with {_SIGHTINGS}, p1 as ({_periods("(select * from s where seen_at // 86400 % 3 = 0)")}), p2 as ({_periods("(select * from s where seen_at // 86400 % 3 <> 1)")}), p3 as ({_periods("s")}),
a as (select page, kind, value, valid_from, valid_to, bool_or(k = 1) as in1, bool_or(k = 2) as in2, bool_or(k = 3) as in3 from (select *, 1 as k from p1 union all select *, 2 from p2 union all select *, 3 from p3) group by all)
select page, kind, value, valid_from, valid_to, cast(f as bigint) as recorded_from, cast(t as bigint) as recorded_to from (
  select *, 1 as f, case when not in2 then 2 when not in3 then 3 end as t from a where in1
  union all select *, 2, case when not in3 then 3 end from a where in2 and not in1
  union all select *, 3, null from a where in3 and not in2)""",
}
