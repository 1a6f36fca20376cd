"""Structured Streaming wrappers: exact work in foreachBatch, so late rows are corrected rather than dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newslake.operators.archive import merged, rollup
from newslake.operators.stories import copy_flags_of_batch
from newslake.session import file_system

BATCH_FILES = 24


def stream(spark: SparkSession, folder: str, schema: str, files: int = BATCH_FILES) -> DataFrame:
    """Parquet files of a folder as they come, a fixed number a batch; the checkpoint is the ledger of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def run(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; a second run goes on after the last."""
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _have(spark: SparkSession, folder: str) -> DataFrame | None:
    fs, at = file_system(spark, folder)
    return spark.read.parquet(folder) if fs.exists(at) else None


def new_block(batch: DataFrame, n: int, ledger: str, window: int = 1000) -> bool:
    """Whether none of the last `window` blocks before batch `n` had the same rows; the block's digest is then entered in the ledger folder.

    The digest adds up row hashes, so it does not depend on the order of rows.
    """
    spark = batch.sparkSession
    d = batch.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(*batch.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    had = _have(spark, ledger)
    if had is not None and had.where((F.col("batch") < n) & (F.col("batch") >= n - window) & (F.col("rows") == d.rows) & (F.col("digest") == d.digest)).limit(1).count():
        return False
    spark.createDataFrame([(d.rows, d.digest)], "rows long, digest string").coalesce(1).write.mode("overwrite").parquet(f"{ledger}/batch={n}")
    return True


def flagged_batches(target: str, key: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batches to rows with key and copy flag at `target`/batch=N; a batch that is written again replaces itself, one that repeats an earlier block is dropped."""

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if not new_block(batch, n, f"{target}.blocks"):
            return
        keyed = key(batch)
        old = _have(spark, target)
        history = old.where(F.col("batch") < n) if old is not None else keyed.limit(0)
        copy_flags_of_batch(history, keyed).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return each


def source_states(target: str) -> Callable[[DataFrame, int], None]:
    """Batches to partial site states (domain, n, first, last) at `target`/batch=N, added up on reading by `read_states`."""

    def each(batch: DataFrame, n: int) -> None:
        rollup(batch, "domain").write.mode("overwrite").parquet(f"{target}/batch={n}")

    return each


def read_states(spark: SparkSession, target: str) -> DataFrame:
    return merged(spark.read.parquet(target), "domain")


def replace_days(rows: DataFrame, table: str, days: list[str] | None = None, expected: int | None = None) -> int:
    """Rows (with a `day` column) in place of their days' partitions of a Parquet folder; of `days`, those left without rows are dropped.

    The rows are built once, into a folder beside the table; what was written is counted, and moved only if its number is the
    expected one.
    """
    spark = rows.sparkSession
    beside = f"{table}.new"
    rows.write.mode("overwrite").partitionBy("day").parquet(beside)
    fs, new = file_system(spark, beside)
    built = {x.getPath().getName(): x.getPath() for x in fs.listStatus(new) if x.getPath().getName().startswith("day=")}
    n = spark.read.parquet(beside).count() if built else 0
    if expected is not None and n != expected:
        fs.delete(new, True)
        raise RuntimeError(f"{n} rows built, {expected} expected; nothing was replaced")
    _, home = file_system(spark, table)
    fs.mkdirs(home)
    for name in sorted({*built, *(f"day={d}" for d in days or ())}):
        _, at = file_system(spark, f"{table}/{name}")
        fs.delete(at, True)
        if name in built:
            fs.rename(built[name], at)
    fs.delete(new, True)
    return n


def expire(spark: SparkSession, table: str, before: str) -> list[str]:
    """Drops the day partitions before a day; their names."""
    fs, home = file_system(spark, table)
    old = [x.getPath() for x in fs.listStatus(home) if x.getPath().getName().startswith("day=") and x.getPath().getName() < f"day={before}"]
    for path in old:
        fs.delete(path, True)
    return sorted(p.getName() for p in old)


def swap(spark: SparkSession, table: str, new: str) -> None:
    """A folder written beside a table in its place, by renames; a reader sees the one or the other."""
    fs, home = file_system(spark, table)
    _, fresh = file_system(spark, new)
    _, old = file_system(spark, f"{table}.old")
    if not fs.exists(fresh):
        raise ValueError(f"{new} is not there")
    fs.delete(old, True)
    if fs.exists(home):
        fs.rename(home, old)
    fs.rename(fresh, home)
    fs.delete(old, True)


def compact(spark: SparkSession, table: str, files: int) -> None:
    """A Parquet folder rewritten into fewer files, in its place."""
    spark.read.parquet(table).coalesce(files).write.mode("overwrite").parquet(f"{table}.new")
    swap(spark, table, f"{table}.new")
