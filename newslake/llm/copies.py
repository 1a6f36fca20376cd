"""Problem 2: records equal but for formatting, collapsed into one each with their number of copies.

Canonical records are range-partitioned, sorted externally and scanned in adjacent runs that compare full keys
(`operators.ordered`): a group of copies of any size is spread over as many partitions as it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions.text import same_text, site
from newslake.operators.ordered import adjacent_copies

_SEP = "\x1f"


def headline_records(headlines: DataFrame) -> DataFrame:
    """(tbl, id, record): site and text of the title. A null domain is the site ''; blank titles are no records."""
    key = same_text(F.col("title"))
    return headlines.where(key != "").select(F.lit("headlines").alias("tbl"), F.col("row_id").alias("id"), F.concat_ws(_SEP, F.coalesce(site(F.col("domain")), F.lit("")), key).alias("record"))


def unified_records(unified: DataFrame) -> DataFrame:
    """(tbl, id, record): the text of the key, whatever the site. Blank keys are no records."""
    key = same_text(F.col("key"))
    return unified.where(key != "").select(F.lit("unified_headlines").alias("tbl"), F.col("row_id").alias("id"), key.alias("record"))


def line_records(raw_lines: DataFrame) -> DataFrame:
    """(tbl, id, record): the fields of a JSON object in the order of their names, each with the text of its value.

    Lines that are not one whole JSON object, and objects without any letter or digit in their values, are no records.
    """
    whole = F.trim(F.regexp_replace("line", r"^[\s\ufeff]+|\s+$", ""))
    fields = F.from_json(whole, "map<string,string>", {"mode": "PERMISSIVE", "allowTrailingTokens": "false"})
    rows = raw_lines.where(whole.startswith("{") & whole.endswith("}")).select("line_id", F.sort_array(F.map_entries(fields)).alias("f")).where("size(f) > 0")
    texts = F.transform("f", lambda x: F.concat(x["key"], F.lit("\x1e"), F.coalesce(same_text(x["value"]), F.lit("\x1d"))))
    said = F.exists("f", lambda x: F.coalesce(same_text(x["value"]), F.lit("")) != "")
    return rows.where(said).select(F.lit("raw_lines").alias("tbl"), F.col("line_id").alias("id"), F.concat_ws(_SEP, texts).alias("record"))


def _members(records: DataFrame, heads_too: bool) -> DataFrame:
    tagged = records.select(F.concat_ws(_SEP, "tbl", "record").alias("k"), "id", "tbl").where("record is not null")
    return adjacent_copies(tagged, F.col("k"), F.col("id"), F.col("tbl"), heads_too).withColumnRenamed("label", "tbl")


def copies(records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copy_id): every member of a group of equal records but its smallest id, with that id.

    Null records are left out. Ids are unique within a table. Records of several tables share one sort: the table leads the key.
    """
    return _members(records, False).select("tbl", "keep_id", "copy_id")


def collapsed(records: DataFrame) -> DataFrame:
    """(tbl, keep_id, copies): each record once, by its smallest id, with the exact number of rows that hold it."""
    return _members(records, True).groupBy("tbl", "keep_id").agg(F.count(F.lit(1)).alias("copies"))


def all_records(headlines: DataFrame, unified: DataFrame, raw_lines: DataFrame) -> DataFrame:
    """The records of the three tables together."""
    return headline_records(headlines).unionByName(unified_records(unified)).unionByName(line_records(raw_lines))
