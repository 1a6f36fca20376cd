"""Site labels, story keys and copy flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.functions.text import moment
from newslake.session import cut, small

# The separator pattern and the thresholds.
SEPARATED = r"(?s)^(.*) ([|\-\x{2013}\x{2014}]) (.*)$"
LABEL_MIN, TAIL_MAX, WINDOW_DAYS = 20, 160, 7
#: Labels are broadcast up to this many rows.
BROADCAST_ROWS = 200_000


def learn_labels(headlines: DataFrame, least: int = LABEL_MIN) -> DataFrame:
    """(domain, tail, n): what follows the last separator of a site's titles `least` times or more, 1 to 160 bytes long."""
    tail = F.regexp_extract("title", SEPARATED, 3)
    rows = headlines.select("domain", tail.alias("tail")).where(F.octet_length("tail").between(1, TAIL_MAX) & F.col("domain").isNotNull())
    return rows.groupBy("domain", "tail").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def with_key(rows: DataFrame, labels: DataFrame, title: str = "title", key: str = "key") -> DataFrame:
    """`rows` with the story key: the title without the site's labels, stripped from the end twice; null titles keep a null key.

    The labels of a row's site decide, so each strip is a join on (domain, tail); small label tables are broadcast.
    """
    known = small(cut(labels.select(F.col("domain").alias("_ld"), F.col("tail").alias("_lt")).distinct()), BROADCAST_ROWS)
    out = rows.withColumn("_key", F.col(title))
    for _ in range(2):
        out = out.withColumn("_tail", F.regexp_extract("_key", SEPARATED, 3))
        out = out.join(known, (F.col("domain") == F.col("_ld")) & (F.col("_tail") == F.col("_lt")), "left")
        out = out.withColumn("_key", F.when(F.col("_ld").isNotNull(), F.regexp_extract("_key", SEPARATED, 1)).otherwise(F.col("_key"))).drop("_ld", "_lt", "_tail")
    return out.withColumn(key, F.col("_key")).drop("_key")


def with_previous(rows: DataFrame, keys: list[str], out: str, among: DataFrame | None = None) -> DataFrame:
    """`rows` with the ts of the row before, by (ts, url, row_id), among those of `among` (the same rows and perhaps others) with equal `keys`; null for the first.

    A window over a key would put a story of any size into one task. Here rows are first combined to one a key and ts, with
    the row that leads it; only those, at most one a batch time, pass through a window. The leader of a ts takes the ts
    before, every other row its own; the join back is an ordinary one that AQE splits where a key is hot.
    """
    lead = F.struct("url", "row_id")
    names = [f"_k{i}" for i in range(len(keys))]
    slots = (rows if among is None else among).select(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col("ts").alias("_t"), lead.alias("_l")).groupBy(*names, "_t").agg(F.min("_l").alias("_lead"))
    per = slots.withColumn("_before", F.lag("_t").over(Window.partitionBy(*names).orderBy("_t")))
    joined = rows.join(per, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip([*keys, "ts"], [*names, "_t"])], "left")
    return joined.withColumn(out, F.when(lead.eqNullSafe(F.col("_lead")), F.col("_before")).otherwise(F.col("ts"))).drop(*names, "_t", "_lead", "_before")


def flag(prev_any: Column, prev_same: Column, days: int = WINDOW_DAYS) -> Column:
    """0: no sighting in the `days` before; 1: none by this site; 2: this site's repeat. A gap of exactly `days` is a repeat."""
    edge = F.col("ts") - F.expr(f"INTERVAL '{days}' DAY")
    return F.when(prev_any.isNull() | (prev_any < edge), 0).when(prev_same.isNull() | (prev_same < edge), 1).otherwise(2).cast("int")


def copy_flags(keyed: DataFrame, extra: tuple[str, ...] = (), out: str = "flag", days: int = WINDOW_DAYS) -> DataFrame:
    """`keyed` (ts, domain, url, row_id, key) with its copy flag, windowed by `extra` columns too. Rows without ts are left out; null keys are one key."""
    base = cut(keyed.where("ts is not null"))  # read by each look-back and the rows themselves
    rows = with_previous(base, [*extra, "key"], "_any", base)
    rows = with_previous(rows, [*extra, "key", "domain"], "_same", base)
    return rows.withColumn(out, flag(F.col("_any"), F.col("_same"), days)).drop("_any", "_same")


def copy_flags_of_batch(history: DataFrame, batch: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The flags of a batch: its own rows before, and the history's last `days`.

    Both are keyed. Only the history's keys that the batch has are read on, one last sighting a key and a key and site. Rows
    of the history that are not older than the batch stand among its rows, so a batch that comes late is flagged right too;
    what it changes in the flags of such rows is left to a rebuild of their days (`ingest.rebuilt`).
    """
    base = cut(batch.where("ts is not null"))
    first = base.agg(F.min("ts").alias("_t")).first()[0]
    since = history.where(F.col("ts") >= moment(first)).join(base.select("key").distinct(), "key", "left_semi") if first else history.limit(0)
    among = base.select("ts", "key", "domain", "url", "row_id").unionByName(since.select("ts", "key", "domain", "url", "row_id"))
    rows = with_previous(with_previous(base, ["key"], "_a", among), ["key", "domain"], "_s", among)
    past = history.where((F.col("ts") >= moment(first) - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("ts") < moment(first))) if first else history.limit(0)
    past = past.join(base.select("key").distinct(), "key", "left_semi")
    any_ = past.groupBy("key").agg(F.max("ts").alias("_pa"))
    same = past.groupBy("key", "domain").agg(F.max("ts").alias("_ps"))
    out = rows.join(any_, "key", "left").join(same, ["key", "domain"], "left")
    return out.withColumn("flag", flag(F.greatest("_a", "_pa"), F.greatest("_s", "_ps"), days)).drop("_a", "_s", "_pa", "_ps")


def backfilled(keyed: DataFrame, start: str, end: str, days: int = WINDOW_DAYS) -> DataFrame:
    """The flags of the rows from `start` to before `end`, from those and the `days` before: a month is flagged without the rest."""
    padded = keyed.where((F.col("ts") >= moment(start) - F.expr(f"INTERVAL '{days}' DAY")) & (F.col("ts") < moment(end)))
    return copy_flags(padded, days=days).where(F.col("ts") >= moment(start))


def histogram(flagged: DataFrame, by: Column, name: str) -> DataFrame:
    """Rows of each flag by a period."""
    return flagged.groupBy(by.alias(name)).agg(*(F.count_if(F.col("flag") == k).alias(f"copy{k}") for k in (0, 1, 2)))
