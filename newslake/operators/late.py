"""Problem 6: counts by event time, corrected by retractions as late events come in, with a cut-off.

Each event has a period (its UTC day) and an arrival. Per key (table, period, site) the state is a count with a
version, the day of arrival. An event in time changes the state of its arrival's version; the change goes downstream as
a pair of deltas, the old value negative and the new one positive. Events past the cut-off change nothing. What became of a
late event is read off the deltas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions.text import page, seconds, site

LATENESS_HOURS = 72
_DAY = 86400


def first_events(rows: DataFrame, tbl: str) -> DataFrame:
    """(tbl, id, site, event, seen, period): a page of a kind once, by its row with the earliest seen, then the smallest row_id.

    The event time is ts, or seen where ts is null, 1970-01-01 or after seen. A row without url is a page by itself; a null
    kind is the kind ''. Rows without seen never arrived and are left out. The reduction combines before the shuffle.
    """
    at, seen = seconds(F.col("ts")), seconds(F.col("seen"))
    event = F.when(F.col("ts").isNull() | (at == 0) | (F.col("ts") > F.col("seen")), seen).otherwise(at)
    flat = rows.where("seen is not null and row_id is not null").select(
        F.coalesce(page(F.col("url")), F.concat(F.lit("\x1f"), F.col("row_id").cast("string"))).alias("page"),
        F.coalesce("kind", F.lit("")).alias("kind"),
        F.struct(F.col("seen").alias("at"), F.col("row_id").cast("long").alias("id"), event.alias("event"), seen.alias("seen"), site(F.col("domain")).alias("site")).alias("x"),
    )
    one = flat.groupBy("page", "kind").agg(F.min_by("x", F.struct("x.at", "x.id")).alias("x"))
    out = one.select(F.lit(tbl).alias("tbl"), "x.id", "x.site", "x.event", "x.seen")
    return out.withColumn("period", F.floor(F.col("event") / _DAY).cast("long"))


def deltas(events: DataFrame, lateness_hours: int = LATENESS_HOURS) -> DataFrame:
    """(tbl, period, site, version, kind, n, until): the differential stream of the counts.

    Version v is the day of arrival. Events seen `lateness_hours` or more after their period's end are past the cut-off and
    change nothing. The first version of a key emits one positive delta; each later one retracts the value before (negative,
    kind `retract`) and asserts the new one (positive, kind `assert`). The sum of all deltas of a key up to a version is the
    count as of that version; `until` is the last arrival it holds. At most 1 + lateness/24 h versions exist a key, so the
    window is small.
    """
    taken = events.where(F.col("seen") < (F.col("period") + 1) * _DAY + lateness_hours * 3600)
    per = taken.groupBy("tbl", "period", "site", F.floor(F.col("seen") / _DAY).cast("long").alias("version")).agg(F.count(F.lit(1)).alias("added"), F.max("seen").alias("until"))
    w = Window.partitionBy("tbl", "period", "site").orderBy("version")
    run = per.withColumn("new", F.sum("added").over(w)).withColumn("old", F.col("new") - F.col("added"))
    both = run.select("tbl", "period", "site", "version", "until", F.explode(F.array(
        F.struct(F.lit("retract").alias("kind"), (-F.col("old")).alias("n")), F.struct(F.lit("assert").alias("kind"), F.col("new").alias("n")))).alias("d"))
    return both.select("tbl", "period", "site", "version", "d.kind", "d.n", "until").where("n <> 0")


def ruled(events: DataFrame, emitted: DataFrame) -> DataFrame:
    """(tbl, id, outcome) of the events seen after their period's end, read off the emitted deltas.

    A late event `corrects` if the version of its arrival asserted a new value that holds it, else it was `dropped`.
    """
    version = F.floor(F.col("seen") / _DAY).cast("long")
    late = events.where(F.col("seen") >= (F.col("period") + 1) * _DAY).select("tbl", "id", "period", "site", "seen", version.alias("version"))
    said = emitted.where("kind = 'assert'").select(F.col("tbl").alias("_t"), F.col("period").alias("_p"), F.col("site").alias("_s"), F.col("version").alias("_v"), "until")
    hit = (F.col("tbl") == F.col("_t")) & (F.col("period") == F.col("_p")) & F.col("site").eqNullSafe(F.col("_s")) & (F.col("version") == F.col("_v"))
    return late.join(said, hit, "left").select("tbl", "id", F.when(F.col("seen") <= F.col("until"), "corrects").otherwise("dropped").alias("outcome"))


def apply_deltas(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Keyed state (tbl, period, site, version, n) after a batch of deltas; the version is the newest that touched the key."""
    cols = ["tbl", "period", "site", "version", "n"]
    both = state.select(*cols).unionByName(changes.select(*cols))
    return both.groupBy("tbl", "period", "site").agg(F.max("version").alias("version"), F.sum("n").alias("n")).where("n <> 0").select(*cols)
