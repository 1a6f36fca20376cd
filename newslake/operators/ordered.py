"""Adjacent-run scans over range-partitioned, sorted rows.

A hash shuffle puts all rows of one key into one task. Here rows are range-partitioned on (key, order, tie),
so a key that holds a third of all rows is spread over a third of the partitions; each partition is sorted
externally by Spark and scanned once, keeping one row of state. What a partition can't know (whether its first
run goes on from the partition before, where its last run ends) is one small row per partition, stitched on the
driver: its size is bounded by the number of partitions, not by the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newslake.session import cut, partitions

_COPIES = "part int, label string, copy_id bigint, keep_id bigint, open boolean, first_key binary, last_key binary"
_RUNS = "part int, k string, v string, start bigint, stop bigint, n bigint, edge string, k_hash binary, v_hash binary"


def _hash(x: str) -> bytes:
    return hashlib.sha256(x.encode("utf-8", "surrogatepass")).digest()


def sorted_parts(df: DataFrame, *order: str) -> DataFrame:
    """Rows range-partitioned over the session's shuffle width and sorted within each partition."""
    return df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)


def _scan_copies(batches: Iterator[pa.RecordBatch], heads_too: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("label", pa.string()), ("copy_id", pa.int64()), ("keep_id", pa.int64()), ("open", pa.bool_()), ("first_key", pa.binary()), ("last_key", pa.binary())])
    first = last = None
    head, begun, opened = 0, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        k, ids = batch.column(0).to_pandas(), batch.column(1).to_pandas()
        new = k.ne(k.shift())
        new.iloc[0] = last is None or k.iloc[0] != last
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        heads = np.where(at >= 0, ids.to_numpy()[at], head)
        if first is None:
            first, begun = k.iloc[0], int(ids.iloc[0])
        in_first = (new.cumsum() == int(new.iloc[0] and last is None)) if opened else new & False
        opened = opened and bool(in_first.iloc[-1])
        out = (~new | in_first | heads_too).to_numpy()
        last, head = k.iloc[-1], int(heads[-1])
        if m := int(out.sum()):
            label = batch.column(2).filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int32()), label, pa.array(ids[out], pa.int64()), pa.array(heads[out], pa.int64()), pa.array(in_first[out], pa.bool_()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], schema=schema)
    if first is not None:
        # The partition's own row: where its first run began, in `copy_id` null; the head of its last run, in `keep_id`.
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([str(begun)]), pa.array([None], pa.int64()), pa.array([head], pa.int64()), pa.array([opened]), pa.array([_hash(first)], pa.binary()), pa.array([_hash(last)], pa.binary())], schema=schema)


def adjacent_copies(df: DataFrame, key: Column, id_: Column, label: Column | None = None, heads_too: bool = False) -> DataFrame:
    """(label, copy_id, keep_id): every row whose full key another row with a smaller id has, with the smallest such id.

    With `heads_too` also every other row, with its own id twice. Rows with a null key or id are left out. Ids have to be
    unique among equal keys. `label` (text) is carried along. An empty input gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(key.alias("k"), id_.cast("long").alias("i"), (F.lit(None) if label is None else label).cast("string").alias("l")).where("k is not null and i is not null")
    rows = cut(rows)  # else the range bounds' sample makes the keys again
    scanned = cut(sorted_parts(rows, "k", "i").mapInArrow(lambda it: _scan_copies(it, heads_too), _COPIES))
    edges = scanned.where("copy_id is null").select("part", "keep_id", "label", "open", "first_key", "last_key").collect()  # one row a partition
    moved, carry = [], None
    for r in sorted(edges, key=lambda r: r.part):
        head, goes_on = r.keep_id, carry is not None and carry[0] == bytes(r.first_key)
        if goes_on:
            moved.append((r.part, carry[1]))
            head = carry[1] if r.open else head  # the whole partition is one run
        carry = (bytes(r.last_key), head)
    found = scanned.where("copy_id is not null").select("part", "label", "copy_id", "keep_id", "open")
    if moved:
        fix = F.broadcast(spark.createDataFrame(moved, "part int, moved bigint"))
        found = found.join(fix, "part", "left").withColumn("keep_id", F.when(F.col("open"), F.coalesce("moved", "keep_id")).otherwise(F.col("keep_id")))
    if not heads_too:
        found = found.where("copy_id <> keep_id")
    return found.select("label", "copy_id", "keep_id")


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = ["part", "k", "v", "start", "stop", "n", "edge", "k_hash", "v_hash"]
    schema = pa.schema([("part", pa.int32()), ("k", pa.string()), ("v", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n", pa.int64()), ("edge", pa.string()), ("k_hash", pa.binary()), ("v_hash", pa.binary())])
    held: pd.DataFrame | None = None  # the run that isn't over yet
    any_out = False

    def give(x: pd.DataFrame, edge: list[str | None]) -> pa.RecordBatch:
        x = x.assign(part=part, edge=edge, k_hash=[_hash(k) if e else None for k, e in zip(x.k, edge)], v_hash=[_hash(v) if e else None for v, e in zip(x.v, edge)])
        return pa.RecordBatch.from_pandas(x[names], schema=schema, preserve_index=False)

    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.to_pandas()
        x.columns = ["k", "v", "at", "n"]
        new = x.k.ne(x.k.shift()) | x.v.ne(x.v.shift())
        new.iloc[0] = True
        n = x.n.groupby(new.cumsum().to_numpy()).sum().to_numpy()
        runs = x.loc[new, ["k", "v", "at"]].rename(columns={"at": "start"}).assign(n=n).reset_index(drop=True)
        if held is not None:
            if held.k[0] == runs.k[0] and held.v[0] == runs.v[0]:
                runs.loc[0, "start"], runs.loc[0, "n"] = held.start[0], runs.n[0] + held.n[0]
            else:
                runs = pd.concat([held, runs], ignore_index=True)
        same = runs.k.eq(runs.k.shift(-1))
        runs["stop"] = runs.start.astype("Int64").shift(-1).where(same)
        done = runs.iloc[:-1]
        held = runs.iloc[-1:][["k", "v", "start", "n"]].reset_index(drop=True)
        if len(done):
            yield give(done, [None if any_out or i else "first" for i in range(len(done))])
            any_out = True
    if held is not None:
        yield give(held.assign(stop=pd.array([pd.NA], "Int64")), ["last" if any_out else "only"])


def value_runs(df: DataFrame, key: Column, value: Column, at: Column, tie: Column | None = None) -> DataFrame:
    """(k, v, start, stop, n): for each key the rows in the order of `at`, each run of equal values as one row.

    `start` is the first `at` of the run, `stop` the start of the key's next run (null for its last), `n` its rows.
    Rows with a null key, value or place are left out. Values tied at one place follow each other by their smallest `tie`,
    then in value order; without `tie`, in value order.
    A sweep line whose state is one row, so a key of any size is no load on one task.
    """
    spark = df.sparkSession
    rows = df.select(key.alias("k"), value.alias("v"), at.cast("long").alias("at"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"))
    rows = rows.where("k is not null and v is not null and at is not null").groupBy("k", "at", "v").agg(F.min("tie").alias("tie"), F.count(F.lit(1)).alias("n"))
    scanned = cut(sorted_parts(rows, "k", "at", "tie", "v").select("k", "v", "at", "n").mapInArrow(_scan_runs, _RUNS))
    edges = scanned.where("edge is not null").select("part", "edge", "k_hash", "v_hash", "start", "n").collect()
    by: dict[int, dict] = {}
    for r in edges:
        by.setdefault(r.part, {})[r.edge] = r
    # A run of several partitions: its first piece gets the whole, later pieces vanish; stops are filled from the next run.
    stops, starts, gone = [], [], []
    open_ = None  # (part, edge, k, v, n) of the run that goes on
    for part in sorted(by):
        b = by[part]
        first = b.get("first") or b["only"]
        if open_ and open_[2] == bytes(first.k_hash) and open_[3] == bytes(first.v_hash):
            gone.append((part, first.edge))
            open_[4] += first.n
            if first.edge == "only":
                continue
            # the rest of the partition holds the true stop of the piece that vanished
            starts.append((part, open_[0], open_[1]))
            stops.append((open_[0], open_[1], None, open_[4]))
        elif open_:
            stops.append((open_[0], open_[1], first.start if open_[2] == bytes(first.k_hash) else None, open_[4]))
        last = b.get("last") or b["only"]
        open_ = [part, last.edge, bytes(last.k_hash), bytes(last.v_hash), last.n]
    if open_:
        stops.append((open_[0], open_[1], None, open_[4]))
    carried = {(p, e): part for part, p, e in starts}
    lost = {r.part: r.stop for r in scanned.where("edge = 'first'").select("part", "stop").collect()} if carried else {}
    fixes = [(p, e, lost[carried[p, e]] if (p, e) in carried else s, n, False) for p, e, s, n in stops] + [(p, e, None, None, True) for p, e in gone]
    if not fixes:
        return scanned.select("k", "v", "start", "stop", "n")
    fix = spark.createDataFrame(fixes, "part int, edge string, new_stop bigint, new_n bigint, gone boolean")
    out = scanned.join(F.broadcast(fix), ["part", "edge"], "left").where("gone is null or not gone")
    return out.select("k", "v", "start", F.coalesce("new_stop", "stop").alias("stop"), F.coalesce("new_n", "n").alias("n"))


def _scan_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, key, run = TaskContext.get().partitionId(), None, 0
    total: dict[str, int] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.to_pandas()
        x.columns = ["k", "id", "size"]
        before = x.groupby("k", sort=False)["size"].cumsum() - x["size"]
        if key is not None:
            before = before.where(x.k != key, before + run)
        last = x.k.iloc[-1]
        key, run = last, int(before.iloc[-1] + x["size"].iloc[-1])
        for k, n in x.groupby("k", sort=False)["size"].sum().items():
            total[k] = total.get(k, 0) + int(n)
        out = pd.DataFrame({"part": part, "k": x.k, "id": x.id, "size": x["size"], "before": before})
        yield pa.RecordBatch.from_pandas(out, schema=_SUMS_ARROW, preserve_index=False)
    if total:
        out = pd.DataFrame({"part": part, "k": list(total), "id": None, "size": list(total.values()), "before": None})
        yield pa.RecordBatch.from_pandas(out, schema=_SUMS_ARROW, preserve_index=False)


_SUMS_ARROW = pa.schema([("part", pa.int32()), ("k", pa.string()), ("id", pa.int64()), ("size", pa.int64()), ("before", pa.int64())])


def prefix_sums(df: DataFrame, key: Column, order: Column, id_: Column, size: Column) -> tuple[DataFrame, DataFrame]:
    """((k, id, size, before), (k, total)): per key the sum of `size` over the rows before each one in (order, id).

    Rows with a null key, id or size are left out. One sum a key and partition is all that goes through the driver: at
    most partitions + keys rows.
    """
    spark = df.sparkSession
    rows = df.select(key.alias("k"), order.alias("o"), id_.cast("long").alias("id"), size.cast("long").alias("size")).where("k is not null and id is not null and size is not null")
    scanned = cut(sorted_parts(rows, "k", "o", "id").select("k", "id", "size").mapInArrow(_scan_sums, "part int, k string, id bigint, size bigint, before bigint"))
    edges = scanned.where("id is null").select("k", "part", "size").collect()
    run: dict[str, int] = {}
    offsets = []
    for k, part, size_ in sorted(edges, key=lambda r: r.part):
        offsets.append((k, part, run.get(k, 0)))
        run[k] = run.get(k, 0) + size_
    shift = spark.createDataFrame(offsets, "k string, part int, shift bigint")
    totals = spark.createDataFrame(list(run.items()), "k string, total bigint")
    out = scanned.where("id is not null").join(F.broadcast(shift), ["k", "part"]).select("k", "id", "size", (F.col("before") + F.col("shift")).alias("before"))
    return out, totals
