"""An optional inverted index: tokens to rows, so that a rare word reads its rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.functions.fold import fold, tokens
from newslake.plans.request import Request


def postings(rows: DataFrame) -> DataFrame:
    """(token, month, row_id): write it partitioned by month and sorted by token."""
    return rows.select(F.explode(F.array_distinct(tokens(fold(F.col("title"))))).alias("token"), F.trunc("ts", "MONTH").alias("month"), "row_id")


def candidates(index: DataFrame, q: Request) -> DataFrame:
    """(row_id): rows with all words of some group; the exact test is not needed after it."""
    out = None
    for g in q.groups:
        words = sorted(set(g))
        hit = index.where(F.col("token").isin(*words)).groupBy("row_id").agg(F.countDistinct("token").alias("_n")).where(F.col("_n") == len(words)).select("row_id")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()
