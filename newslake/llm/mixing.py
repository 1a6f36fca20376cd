"""Problem 9: sources mixed to target shares of all tokens, small ones repeated up to a cap.

Each document gets a hash-random key; documents are range-sorted by (source, key) and their token counts summed up in
that order across partitions (`operators.ordered.prefix_sums`). A source's budget is whole epochs plus a cut in the order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.tokens import TOKENIZER, count_tokens
from newslake.operators.ordered import prefix_sums
from newslake.session import cut, small

#: More sources than this are joined by a shuffle.
MOST_SOURCES = 100_000


def budgets(totals: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, available, target_share, max_repeats, budget): tokens each source is to give.

    `total` is the size asked for; unless given, the largest at which every source that has tokens reaches its share. A source
    gives its share of the total, or max_repeats times all it has if that is less: where a larger total is asked for, the
    sources that reach their budgets still stand to each other as their targets, and the report says what the others reached.
    Repeated rows of `targets` count once; null shares or repeats and shares of 0 or less give nothing.
    """
    wanted = targets.select("source", F.col("target_share").cast("double"), F.greatest("max_repeats", F.lit(0)).cast("long").alias("max_repeats")).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = wanted.join(totals.select(F.col("k").alias("source"), F.col("total").alias("available")), "source", "left").fillna(0, ["available", "max_repeats", "target_share"])
    most = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0) & (F.col("target_share") > 0), F.col("available") * F.col("max_repeats") / F.col("target_share"))
    size = F.lit(total).cast("double") if total is not None else F.coalesce(F.min(most).over(_all()), F.lit(0.0))
    ask = F.greatest(F.col("target_share"), F.lit(0.0)) * size
    return have.withColumn("budget", F.least(F.floor(ask + 1e-6), F.col("available") * F.col("max_repeats")).cast("long"))


def _all():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over the sources, one row each


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """((doc_id, source, tokens, repeats), report): the chosen documents and what became of each source.

    The last document of a cut is taken if more than half of it lies within the budget. Texts without tokens are never
    chosen. report: (source, target_share, reached_share, target_tokens, tokens, documents, most_repeats, epochs).
    """
    wanted = small(targets.select("source").where("source is not null").distinct(), MOST_SOURCES)
    counted = cut(count_tokens(documents.join(wanted, "source", "left_semi"), tokenizer).where("tokens > 0"))  # else the range bounds' sample counts them again
    summed, totals = prefix_sums(counted, F.col("source"), F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id"), F.col("tokens"))
    plan = budgets(totals, targets, total).withColumn("epochs", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available"))
    rows = summed.withColumnRenamed("k", "source").join(F.broadcast(plan), "source")  # a row a listed source, as `wanted`
    more = (F.col("epochs") < F.col("max_repeats")) & (F.col("before") + F.col("size") / 2 < F.col("rest"))
    repeats = (F.col("epochs") + more.cast("long")).cast("long")
    chosen = rows.select(F.col("id").alias("doc_id"), "source", F.col("size").alias("tokens"), repeats.alias("repeats")).where("repeats > 0")
    per = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    report = plan.join(per, "source", "left").fillna(0, ["tokens", "documents", "most_repeats"])
    reached = F.col("tokens") / F.nullif(F.sum("tokens").over(_all()), F.lit(0))
    return chosen, report.select("source", "target_share", F.coalesce(reached, F.lit(0.0)).alias("reached_share"), F.col("budget").alias("target_tokens"), "tokens", "documents", "most_repeats", "epochs")
