"""Session helpers: a tuned local session, table reads, lineage cuts."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the driver's own session is used as it is."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    spark = SparkSession.builder.master(f"local[{cores}]").appName("newslake").config(map=base).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, used wherever a width has to be spelled out."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, shared by all executors, so a lost executor costs nothing.

    A local session without one gets a temporary folder; on a cluster it has to be named.
    """
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="newslake-ckpt-"))
        have = sc._jsc.sc().getCheckpointDir()
    return have.get()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and return a reader of it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def file_system(spark: SparkSession, path: str):  # noqa: ANN201
    """(Hadoop file system, path) of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """A table derived from a data directory, written once to the shared folder (partitioned `by`) and read from there.

    It is built anew for another session, and when a table of the directory was written since.
    """
    fs, at = file_system(spark, sf_dir)
    mark = hashlib.md5(repr(sorted((x.getPath().toString(), x.getModificationTime(), x.getLen()) for x in fs.listStatus(at))).encode()).hexdigest()
    path = f"{shared_folder(spark)}/stored/{mark}/{name}"
    out, done = file_system(spark, f"{path}/_SUCCESS")
    if not out.exists(done):
        build().write.mode("overwrite").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """Hint a broadcast of `df` if, counted, it has at most `most_rows` rows; else leave the join to shuffle.

    `df` has to be cheap to count (a `cut` result).
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


SF_DEFAULT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
