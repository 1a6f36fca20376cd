"""Problem 4: a bitemporal ledger of changing attributes (valid time and recorded time).

The log of sightings (entity, value, seen) is append-only. A sweep line over each entity's sightings in the order
of valid time gives its periods. A batch of updates touches only the entities it names: their periods are swept
again, periods that no longer hold are closed in recorded time (never overwritten or deleted), new ones are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import page, seconds, squeezed
from newslake.operators.ordered import value_runs
from newslake.session import cut

LEDGER = "entity string, value string, valid_from bigint, valid_to bigint, recorded_from bigint, recorded_to bigint"
_SEP = "\x1f"


def periods(sightings: DataFrame) -> DataFrame:
    """(entity, value, valid_from, valid_to): sightings (entity, value, seen bigint) as periods; valid_to is null for the last.

    Null or blank values and null entities or times are no sightings. Repeated rows change nothing. Two values at one
    moment follow each other by a column `tie` if there is one, else in value order, the earlier one with an empty period.
    """
    tie = F.col("tie") if "tie" in sightings.columns else None
    runs = value_runs(sightings.where(F.trim("value") != ""), F.col("entity"), F.col("value"), F.col("seen"), tie)
    return runs.select(F.col("k").alias("entity"), F.col("v").alias("value"), F.col("start").alias("valid_from"), F.col("stop").alias("valid_to"))


def load(sightings: DataFrame, at: int) -> DataFrame:
    """The ledger a first batch gives: what `record` gives on an empty ledger and log, without joining them."""
    return periods(sightings).select("*", F.lit(at).cast("long").alias("recorded_from"), F.lit(None).cast("long").alias("recorded_to"))


def record(ledger: DataFrame, log: DataFrame, batch: DataFrame, at: Column | int) -> DataFrame:
    """The ledger after `batch` (entity, value, seen) came in at recorded time `at`; `log` holds the sightings before it.

    Late sightings split or move the periods they fall into: the old row gets `recorded_to = at`, the new rows
    `recorded_from = at`. Rows recorded and closed earlier are kept as they are.
    """
    at = F.lit(at).cast("long") if isinstance(at, int) else at.cast("long")
    named = batch.select("entity").distinct()
    cols = ["entity", "value", "seen", *(["tie"] if "tie" in batch.columns and "tie" in log.columns else [])]
    swept = periods(log.join(named, "entity", "left_semi").select(*cols).unionByName(batch.select(*cols)))
    closed = ledger.where("recorded_to is not null")
    live = ledger.where("recorded_to is null")
    key = ["entity", "value", "valid_from"]
    new = swept.select(*key, F.col("valid_to").alias("_to"), F.lit(True).alias("_new"))
    old = live.withColumn("_old", F.lit(True)).join(named.withColumn("_named", F.lit(True)), "entity", "left")
    both = old.join(new, key, "full_outer")
    kept = F.coalesce("_old", F.lit(False)) & (F.col("_named").isNull() | (F.coalesce("_new", F.lit(False)) & F.col("valid_to").eqNullSafe(F.col("_to"))))
    was = both.where("_old").select(*key, "valid_to", "recorded_from", F.when(kept, F.lit(None).cast("long")).otherwise(at).alias("recorded_to"))
    now = both.where("_new").where(~kept).select(*key, F.col("_to").alias("valid_to"), at.alias("recorded_from"), F.lit(None).cast("long").alias("recorded_to"))
    return closed.unionByName(was).unionByName(now)


def as_of(ledger: DataFrame, recorded: int, valid: int | None = None) -> DataFrame:
    """What was known at recorded time `recorded` (and held at valid time `valid`)."""
    out = ledger.where((F.col("recorded_from") <= recorded) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > recorded)))
    if valid is not None:
        out = out.where((F.col("valid_from") <= valid) & (F.col("valid_to").isNull() | (F.col("valid_to") > valid)))
    return out


def title_sightings(rows: DataFrame) -> DataFrame:
    """Sightings of `collect_headlines`: the entity is page and kind, the value the squeezed title. Rows without url have no page and are left out; a null kind is its own kind ''."""
    return rows.select(
        F.concat_ws(_SEP, page(F.col("url")), F.coalesce("kind", F.lit(""))).alias("entity"),
        squeezed(F.col("title")).alias("value"),
        seconds(F.col("seen")).alias("seen"),
        F.col("row_id").alias("tie"),
        F.col("url").isNotNull().alias("_ok"),
    ).where("_ok and value <> '' and seen is not null").drop("_ok")


def empty_ledger(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], LEDGER)


def split_entity(df: DataFrame) -> DataFrame:
    """Page and kind back out of `entity`."""
    parts = F.split("entity", _SEP)
    return df.withColumn("page", parts[0]).withColumn("kind", parts[1]).drop("entity")


def loaded_by_days(rows: DataFrame, loads: tuple[int, ...] = (0, 2, 1)) -> DataFrame:
    """The ledger of `collect_headlines` after several loads, one a recorded time from 1 on: load k takes the sightings whose UTC day is `loads[k]` by its remainder.

    So later loads bring sightings from between those known, and supersede periods that these split.
    """
    log = cut(title_sightings(rows))
    mine = F.pmod(F.floor(F.col("seen") / 86400), F.lit(len(loads)))
    ledger = load(log.where(mine == loads[0]), 1)
    for k in range(1, len(loads)):
        ledger = cut(record(ledger, log.where(mine.isin(*loads[:k])), log.where(mine == loads[k]), k + 1))
    return ledger


def changed_titles(ledger: DataFrame) -> DataFrame:
    """(page, kind, valid_from, valid_to): the rows of a ledger that still hold, of entities with at least two periods; valid_to 0 for the last."""
    live = ledger.where("recorded_to is null")
    # An entity has two periods or more exactly if one of its periods has an end.
    several = live.where("valid_to is not null").select("entity").distinct()
    shown = split_entity(live.join(several, "entity", "left_semi"))
    return shown.select("page", "kind", "valid_from", F.coalesce("valid_to", F.lit(0)).cast("long").alias("valid_to")).distinct()
