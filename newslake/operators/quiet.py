"""Sites going quiet: increments between snapshots, baselines, alarms, and snapshots made up from weekly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the report.
DARK_DAYS, DARK_BASELINE, THIN_BASELINE, THIN_RATIO, MIN_ROWS, GROUP = 14, 100, 200, 0.2, 5000, 3


def increments(snapshots: DataFrame) -> DataFrame:
    """(domain, day, inc, age): rows gained a week between neighbouring snapshots (day, domain, n, last); `age` 1 is the newest.

    A domain missing from a snapshot gives no increment there. Snapshots are a few dozen, so a domain's window is small.
    """
    days = snapshots.select("day").distinct()
    step = days.withColumn("_before", F.lag("day").over(Window.partitionBy(F.lit(0)).orderBy("day")))  # one row a snapshot
    w = Window.partitionBy("domain").orderBy("day")
    rows = snapshots.join(F.broadcast(step), "day").withColumn("_n", F.lag("n").over(w)).withColumn("_d", F.lag("day").over(w))
    per = rows.where(F.col("_d") == F.col("_before")).select("domain", "day", ((F.col("n") - F.col("_n")) * 7.0 / F.greatest(F.datediff("day", "_d"), F.lit(1))).alias("inc"))
    return per.withColumn("age", F.row_number().over(Window.partitionBy("domain").orderBy(F.col("day").desc())))


def report(snapshots: DataFrame, dark_days: int = DARK_DAYS, dark: float = DARK_BASELINE, thin: float = THIN_BASELINE, ratio: float = THIN_RATIO) -> DataFrame:
    """(domain, why, baseline, recent, last, rows): sites in the newest snapshot that are dark or thinning; halves round to even."""
    inc = increments(snapshots)
    rates = inc.groupBy("domain").agg(
        F.count(F.lit(1)).alias("_k"), F.avg(F.when(F.col("age") <= 2, F.col("inc"))).alias("_recent"), F.avg(F.when(F.col("age").between(3, 10), F.col("inc"))).alias("_base")
    )
    newest = snapshots.agg(F.max("day").alias("_day"))
    now = snapshots.join(F.broadcast(newest), F.col("day") == F.col("_day"))
    is_dark = (F.datediff("_day", "last") >= dark_days) & (F.col("_base") >= dark)
    why = F.when(is_dark, "dark").when((F.col("_base") >= thin) & (F.col("_recent") < ratio * F.col("_base")), "thinning")
    out = now.join(rates.where("_k >= 3"), "domain").withColumn("why", why).where("why is not null")
    return out.select("domain", "why", F.bround("_base").cast("long").alias("baseline"), F.bround("_recent").cast("long").alias("recent"), "last", F.col("n").alias("rows"))


def compared(now: DataFrame, before: DataFrame, today: str) -> DataFrame:
    """(domain, state, since): `new`, `still` or `recovered` against the alarms (domain, since) of the report before."""
    a, b = now.select("domain", F.lit(True).alias("_now")), before.select("domain", F.col("since").alias("_since"))
    both = a.join(b, "domain", "full_outer")
    state = F.when(F.col("_now").isNull(), "recovered").when(F.col("_since").isNull(), "new").otherwise("still")
    return both.select("domain", state.alias("state"), F.coalesce("_since", F.lit(today).cast("date")).alias("since"))


def stop_groups(alarms: DataFrame, least: int = GROUP) -> DataFrame:
    """(last, sites): dark sites that stopped on the same day, `least` or more."""
    per = alarms.where("why = 'dark'").groupBy("last").agg(F.array_join(F.array_sort(F.collect_list("domain")), ",").alias("sites"), F.count(F.lit(1)).alias("_n"))
    return per.where(F.col("_n") >= least).select("last", "sites")


def seeded(weekly: DataFrame, current: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    """(day, domain, n, last): snapshots as of each week's Sunday but the newest week's, from (domain, monday, rows, last) and (domain, n, last)."""
    weeks = weekly.select("monday").distinct().withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("monday").desc()))).where("_i > 1").drop("_i")
    frame = current.select("domain", F.col("n").alias("_now"), F.col("last").alias("_last")).crossJoin(F.broadcast(weeks))  # a few dozen weeks
    per = frame.join(weekly.select("domain", "monday", "rows", F.col("last").alias("_wlast")), ["domain", "monday"], "left")
    newest = weekly.agg(F.max("monday").alias("_m"))
    tail = weekly.join(F.broadcast(newest), F.col("monday") == F.col("_m")).select("domain", F.col("rows").alias("_tail"))
    w = Window.partitionBy("domain").orderBy("monday")
    later = F.coalesce(F.sum("rows").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)) + F.coalesce("_tail", F.lit(0))
    past = F.last("_wlast", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = per.join(tail, "domain", "left").withColumn("n", F.col("_now") - later).withColumn("day", F.date_add("monday", 6))
    out = out.withColumn("last", F.coalesce(past, F.when(F.col("_last") <= F.col("day"), F.col("_last"))))
    return out.where(F.col("last").isNotNull() & (F.col("n") >= least)).select("day", "domain", "n", "last")
