"""Problem 8: whole documents into containers of fixed capacity, by vector bin packing.

Items have three sizes: tokens, segments (one each) and loss-bearing tokens; a container has a limit for each. Containers
are filled one after another: of the items that still fit, the one with the greatest dot product of its sizes and the room
left, both relative to the limits, goes in next. Items are packed in shards of about SHARD documents drawn by a hash, so
the work is even and local; a shard leaves at most about one container half empty, under 0.3 % of its room.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslake.llm.tokens import TOKENIZER, count_tokens
from newslake.session import partitions

CAPACITY = 2048
SEGMENTS = 64
SHARD = 2048


def pack(tokens: np.ndarray, loss: np.ndarray, limits: tuple[int, int, int]) -> np.ndarray:
    """The container of each item, from 0. Every item has to fit an empty container."""
    n = len(tokens)
    order = np.lexsort((loss, tokens))  # ascending, so those that fit by tokens are a prefix
    t, v = tokens[order].astype(float), loss[order].astype(float)
    alive = np.ones(n, bool)
    out = np.zeros(n, np.int64)
    a, b = 1 / limits[0] ** 2, 1 / limits[2] ** 2
    box, left = 0, n
    room_t, room_s, room_v = map(float, limits)
    while left:
        end = int(np.searchsorted(t, room_t, "right")) if room_s >= 1 else 0
        ok = alive[:end] & (v[:end] <= room_v)
        if not ok.any():
            box += 1
            room_t, room_s, room_v = map(float, limits)
            if left < len(t) // 2:  # forget the dead
                t, v, order, alive = t[alive], v[alive], order[alive], alive[alive]
            continue
        score = np.where(ok, t[:end] * (room_t * a) + v[:end] * (room_v * b), -1.0)
        i = end - 1 - int(np.argmax(score[::-1]))
        out[order[i]] = box
        alive[i] = False
        left -= 1
        room_t, room_s, room_v = room_t - t[i], room_s - 1, room_v - v[i]
    return out


def containers(documents: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_limit: int | None = None, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(container, place, doc_id, piece, first_token, tokens, loss): where each document lies.

    `place` is the token offset within the container. Only texts longer than the capacity are cut: every full piece is a
    container of its own, what is left over is an item like others; `first_token` is where a piece begins. Empty and null
    texts are items without tokens. Container numbers are unique, not dense. Each doc_id is one document; repeated ids are
    packed once each. Loss-bearing tokens are limited by `loss_limit`, the capacity unless given.
    """
    limits = (capacity, segments, capacity if loss_limit is None else loss_limit)
    assert min(limits) > 0
    counted = count_tokens(documents, tokenizer).where("doc_id is not null").select("doc_id", "tokens", "loss")
    shards = max(1, math.ceil(documents.count() / shard))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["doc_id", "tokens"], kind="stable").reset_index(drop=True)
        step = min(limits[0], limits[2])
        full = np.where((x.tokens > limits[0]) | (x.loss > limits[2]), np.maximum(x.tokens - 1, 0) // step, 0)
        rest = x.tokens.to_numpy() - full * step
        rest_loss = np.minimum(x.loss.to_numpy(), rest)  # loss-bearing tokens are a text's last ones
        box = pack(rest, rest_loss, limits)
        base = int(box.max()) + 1
        tail = pd.DataFrame({"box": box, "doc_id": x.doc_id, "piece": full, "first_token": full * step, "tokens": rest, "loss": rest_loss})
        tail["place"] = tail.groupby("box")["tokens"].cumsum() - tail["tokens"]
        at = np.repeat(np.arange(len(x)), full)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full)
        head_loss = np.clip(x.loss.to_numpy()[at] - (x.tokens.to_numpy()[at] - (nth + 1) * step), 0, step)
        heads = pd.DataFrame({"box": base + np.arange(len(at)), "doc_id": x.doc_id.to_numpy()[at], "piece": nth, "first_token": nth * step, "tokens": step, "loss": head_loss, "place": 0})
        out = pd.concat([tail, heads], ignore_index=True)
        out["container"] = x.shard.iloc[0] * (1 << 24) + out["box"]
        return out[["container", "place", "doc_id", "piece", "first_token", "tokens", "loss"]].astype("int64")

    sharded = counted.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    spread = sharded.repartition(min(shards, partitions(documents.sparkSession)), "shard")  # a width asked for isn't coalesced: packing costs more than its bytes tell
    return spread.groupBy("shard").applyInPandas(run, "container bigint, place bigint, doc_id bigint, piece bigint, first_token bigint, tokens bigint, loss bigint")


def fill(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, documents, tokens, room_share): how much of the containers' room is left over; one row."""
    per = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("room_share"))
