"""Problem 5: lines repeated across one site's documents, found from incremental per-source line counts and removed.

State: `counts` (tbl, source, line, n) and `totals` (tbl, source, rows). A new partition of rows is counted into a delta
of the same form and merged; lines whose verdict changed are the crossings, and only rows of the new partition and rows
holding a crossed line are rebuilt. A line is its letters in order, so counts see through case, digits and marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import ZERO_WIDTH, letters, site, squeezed
from newslake.session import cut, partitions, small

LEAST_ROWS = 4
LEAST_SHARE = 0.05
#: Found lines are broadcast up to this many rows (hashes and short ids, about 100 bytes each); beyond, a salted shuffle joins them.
BROADCAST_ROWS = 200_000
DASHES = r" [|\-–—] "


def document_rows(documents: DataFrame) -> DataFrame:
    """(tbl, id, source, parts): texts cut at line feeds, per source. A null source is the source ''; a null text has no lines but counts as a row."""
    parts = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1)
    return documents.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("source"), parts.alias("parts"))


def title_rows(headlines: DataFrame, *more: str) -> DataFrame:
    """(tbl, id, source, parts, *more): tidied titles cut at spaced separators, per site. A null domain is the site ''; a null title has no pieces."""
    return headlines.select(F.lit("headlines").alias("tbl"), F.col("row_id").alias("id"), F.coalesce(site(F.col("domain")), F.lit("")).alias("source"), F.split(_tidy(), DASHES, -1).alias("parts"), *more)


def _tidy() -> Column:
    return squeezed(F.regexp_replace("title", ZERO_WIDTH, ""))


def _keys(parts: Column) -> Column:
    return F.transform(parts, letters)


def count_lines(rows: DataFrame) -> DataFrame:
    """(tbl, source, line, n): in how many rows of a source each line stands; `line` is null for the number of its rows.

    One pass: a row adds one to each distinct line it holds and one to its source. Counts are combined before the shuffle,
    so a hot source or line costs one partial row a task.
    """
    held = F.array_union(F.array_distinct(F.filter(F.coalesce(_keys(F.col("parts")), F.array()), lambda k: k != "")), F.array(F.lit(None).cast("string")))
    return rows.select("tbl", "source", F.explode(held).alias("line")).groupBy("tbl", "source", "line").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """The line counts after a delta; negative deltas (removed rows) are allowed."""
    cols = ["tbl", "source", "line", "n"]
    return counts.select(*cols).unionByName(delta.select(*cols)).groupBy("tbl", "source", "line").agg(F.sum("n").alias("n")).where("n <> 0")


def repeated(counts: DataFrame, least_rows: int = LEAST_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """(tbl, source, line): lines that at least `least_rows` rows and `least_share` of all rows of their source hold.

    A source has at most (lines a row) / least_share of them. Sources under `least_rows` rows are left out before the join;
    counts below `least_rows` never take part in it.
    """
    totals = counts.where(F.col("line").isNull() & (F.col("n") >= least_rows)).select("tbl", "source", F.col("n").alias("rows"))
    lines = counts.where(F.col("line").isNotNull() & (F.col("n") >= least_rows))
    return lines.join(totals, ["tbl", "source"]).where(F.col("n") >= F.col("rows") * least_share).select("tbl", "source", "line")


def crossings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tbl, source, line, now): lines whose verdict differs between two states of `repeated`; `now` is the new verdict."""
    old = before.select("tbl", "source", "line", F.lit(True).alias("_was"))
    new = after.select("tbl", "source", "line", F.lit(True).alias("now"))
    return new.join(old, ["tbl", "source", "line"], "full_outer").where("_was is null or now is null").select("tbl", "source", "line", F.coalesce("now", F.lit(False)).alias("now"))


def _by_source(found: DataFrame) -> DataFrame:
    """One row a source with its found lines: at most (lines a row) / least_share of them, so a bounded array."""
    return found.groupBy("tbl", "source").agg(F.collect_set("line").alias("_found"))


def with_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` with the array `_found` of their source's repeated lines, null where it has none.

    Where the found lines are few (counted), their table is broadcast. Beyond that rows are salted and the table is copied
    once a salt, so a hot source is joined by many tasks.
    """
    found = cut(found)
    table = _by_source(found)
    if found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), ["tbl", "source"], "left")
    salts = max(8, partitions(rows.sparkSession) // 4)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(salted, ["tbl", "source", "_salt"], "left").drop("_salt")


def found_places(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, id, pos): the places of repeated lines, counted from 1 over all lines or pieces, empty ones too."""
    hit = with_found(rows, found).where("_found is not null and parts is not null")
    places = F.filter(F.transform(_keys(F.col("parts")), lambda k, i: F.when(F.array_contains(F.col("_found"), k), (i + 1).cast("long"))), lambda p: p.isNotNull())
    return hit.select("tbl", "id", F.explode(places).alias("pos"))


def cleaned(rows: DataFrame, found: DataFrame, joiner: str = "\n") -> DataFrame:
    """(tbl, id, text): every row's text without its repeated lines; null stays null, a text of nothing else is ''."""
    all_ = with_found(rows, found)
    keep = F.filter("parts", lambda p: ~F.coalesce(F.array_contains(F.col("_found"), letters(p)), F.lit(False)))
    return all_.select("tbl", "id", F.when(F.col("parts").isNotNull(), F.concat_ws(joiner, keep)).alias("text"))


def cleaned_titles(headlines: DataFrame, found: DataFrame) -> DataFrame:
    """(tbl, id, text): every tidied title without its repeated pieces; a kept piece keeps the separator before it, unless it is the first left.

    Null stays null, a title of nothing else is ''.
    """
    marked = headlines.select("row_id", "domain", "title", F.regexp_extract_all(_tidy(), F.lit(DASHES), F.lit(0)).alias("_gaps"))
    all_ = with_found(title_rows(marked, "_gaps"), found)
    pieces = F.transform("parts", lambda p, i: F.struct(p.alias("p"), F.get("_gaps", i - 1).alias("gap")))
    keep = F.filter(pieces, lambda x: ~F.coalesce(F.array_contains(F.col("_found"), letters(x["p"])), F.lit(False)))
    text = F.array_join(F.transform(keep, lambda x, i: F.when(i == 0, x["p"]).otherwise(F.concat(x["gap"], x["p"]))), "")
    return all_.select("tbl", "id", text.alias("text"))


def rebuild(rows: DataFrame, crossed: DataFrame, found: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame] = cleaned) -> DataFrame:
    """`make` (rows, found) for only those rows that hold a line of `crossings`."""
    return make(touched(rows, crossed).where("touched"), found)


def touched(rows: DataFrame, crossed: DataFrame) -> DataFrame:
    """`rows` with `touched`: whether a row holds a line of `crossings`."""
    held = F.arrays_overlap(_keys(F.col("parts")), F.col("_found"))
    return with_found(rows, crossed).withColumn("touched", F.coalesce(held, F.lit(False))).drop("_found")


def by_deltas(parts: list[DataFrame], make: Callable[[DataFrame, DataFrame], DataFrame] = cleaned) -> DataFrame:
    """`make` of all partitions, taken in one after the other: each one's counts are merged as a delta, rows before it that hold a crossed line are rebuilt.

    What isn't touched has the result it had, as no line of it has another verdict; it is made from the lines found before.
    """
    counts = cut(count_lines(parts[0]))
    found = cut(repeated(counts))
    out, rows = make(parts[0], found), parts[0]
    for k, part in enumerate(parts[1:], 2):
        counts = merge_counts(counts, count_lines(part))
        counts = cut(counts) if k < len(parts) else counts  # the last state is read once
        now = cut(repeated(counts))
        crossed = cut(crossings(found, now))
        same = touched(rows, crossed).where("not touched").drop("touched")
        out = make(same, found).unionByName(rebuild(rows, crossed, now, make)).unionByName(make(part, now))
        rows, found = rows.unionByName(part), now
    return out


def halves(rows: DataFrame) -> list[DataFrame]:
    """Two partitions of rows by their ids, where the data has no better ones."""
    half = F.coalesce(F.pmod(F.xxhash64("id"), F.lit(2)), F.lit(0))
    return [rows.where(half == k) for k in (0, 1)]


def repeated_places(documents: DataFrame, headlines: DataFrame) -> DataFrame:
    """(tbl, id, pos) over both tables, taken in as two partitions."""
    rows = document_rows(documents).unionByName(title_rows(headlines))
    return by_deltas(halves(rows), found_places).distinct()
