"""Texts into containers of fixed capacity with little space left over.

Vector bin packing: a container is limited in tokens, in segments and in loss-bearing tokens at once. Containers are
filled one after the other; the next item is the one whose demand has the largest dot product with the room left. Items
are dealt at random to groups of bounded size that are packed independently; what ended in poorly filled containers is
dealt and packed once more.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimatrix.llm.tokens import TOKENIZER, sized
from specimatrix.session import cut, fixed_rows


@dataclass(frozen=True)
class PackLimits:
    """Limits of a container as shares of its capacity in tokens, and how the work is divided."""

    tokens_per_segment: int = 8  # a container holds at most capacity / this many segments
    loss_share: float = 0.98  # of the capacity may be loss-bearing tokens, unless all are of one whole text
    group_items: int = 4096  # items that are packed together
    well_filled: float = 0.97  # containers below are packed once more


def pack(demand: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container (0, 1, ...) of each item; ``demand`` is items x dimensions, each item within ``limits``.

    Of equally good items the first is taken.
    """
    size = demand / limits
    weight = size.mean(axis=0)
    order = np.lexsort(tuple(-size[:, d] for d in range(size.shape[1] - 1, -1, -1)))
    left, where = order, np.full(len(demand), -1)
    bin_no = 0
    while len(left):
        room, gone = np.ones(size.shape[1]), np.zeros(len(left), dtype=bool)
        here = size[left]
        while True:
            fits = ~gone & (here <= room + 1e-12).all(axis=1)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, here @ (weight * room), -1.0)))
            where[left[k]], gone[k] = bin_no, True
            room = room - here[k]
        left = left[~gone]
        bin_no += 1
    return where


def _pieces(items: DataFrame, kinds: list[tuple[str, int]], limits: PackLimits) -> DataFrame:
    """Every item for every kind of container; split only if it exceeds the capacity, into equal pieces within the limits."""
    most = F.greatest(F.lit(1), F.floor(F.col("capacity_tokens") * limits.loss_share)).cast("bigint")
    parts = F.when(F.col("tokens") <= F.col("capacity_tokens"), F.lit(1)).otherwise(F.ceil(F.col("tokens") / most)).cast("int")
    every = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("int").alias("capacity_tokens")) for k, c in kinds])
    rows = items.select("*", F.inline(every)).withColumn("parts", parts)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("piece"))
    start = F.floor(F.col("tokens") * F.col("piece") / F.col("parts"))
    end = F.floor(F.col("tokens") * (F.col("piece") + 1) / F.col("parts"))
    free = F.least(end, F.greatest(start, F.col("prompt_tokens"))) - start
    return rows.select("container_kind", "capacity_tokens", "doc_id", "piece", "parts", start.cast("bigint").alias("start_token"), (end - start).cast("bigint").alias("tokens"), (end - start - free).cast("bigint").alias("loss_tokens"))


_PACKED = "container_kind string, capacity_tokens int, doc_id bigint, piece int, parts int, start_token bigint, tokens bigint, loss_tokens bigint, container_id string, filled double"


def _packer(turn: int, limits: PackLimits):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "piece", "start_token"], kind="stable").reset_index(drop=True)
        capacity = int(f["capacity_tokens"].iloc[0])
        most = np.array([capacity, max(1, capacity // limits.tokens_per_segment), max(1, math.floor(capacity * limits.loss_share))], dtype=float)
        demand = np.stack([f["tokens"], np.ones(len(f)), np.minimum(f["loss_tokens"], most[2])], axis=1).astype(float)  # an item beyond the loss limit takes all of it
        where = pack(demand, most)
        filled = np.bincount(where, weights=demand[:, 0]) / capacity
        f["container_id"] = [f"{key[0]}-{turn}-{key[1]}-{w}" for w in where]
        f["filled"] = filled[where]
        return f[[c.split()[0] for c in _PACKED.split(", ")]]

    return run


def _packed(pieces: DataFrame, turn: int, limits: PackLimits, seed: int) -> DataFrame:
    each = {r[0]: r[1] for r in pieces.groupBy("container_kind").count().collect()}  # a row for each kind
    groups = F.coalesce(*[F.when(F.col("container_kind") == k, F.lit(max(1, math.ceil(n / limits.group_items)))) for k, n in each.items()], F.lit(1))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(seed)), groups))
    return dealt.groupBy("container_kind", "part").applyInPandas(_packer(turn, limits), _PACKED)


def fill_containers(documents: DataFrame, container_size: DataFrame, limits: PackLimits = PackLimits(), path: str = TOKENIZER) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, parts, start_token, tokens, loss_tokens) of every text for each kind.

    A text is split only if it exceeds the capacity, then into as few pieces of equal size as the loss limit allows. A
    whole text may exceed the loss limit; then no other loss-bearing token is in its container. A null text has no row, an
    empty one is a segment of 0 tokens. Repeated rows are items of their own. Kinds with a null or non-positive capacity
    are left out; more kinds than a fixed table has are refused. Extra columns are not read. Empty tables: empty result.
    """
    found = container_size.where("capacity_tokens > 0 and container_kind is not null").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    kinds = sorted((r.container_kind, int(r.capacity)) for r in fixed_rows(found, "kinds of containers"))
    if not kinds:
        return documents.sparkSession.createDataFrame([], "container_kind string, container_id string, doc_id bigint, piece int, parts int, start_token bigint, tokens bigint, loss_tokens bigint")
    pieces = cut(_pieces(sized(documents, path=path), kinds, limits))
    once = cut(_packed(pieces, 1, limits, 1))
    again = _packed(once.where(F.col("filled") < limits.well_filled).drop("container_id", "filled"), 2, limits, 2)
    return once.where(F.col("filled") >= limits.well_filled).unionAll(again).select("container_kind", "container_id", "doc_id", "piece", "parts", "start_token", "tokens", "loss_tokens")


def filling(packed: DataFrame, container_size: DataFrame) -> DataFrame:
    """Per kind of container: how many were used, at least needed, and which share of their room is filled."""
    kinds = container_size.groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity_tokens"))
    used = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.count(F.lit(1)).alias("segments"), F.sum("tokens").alias("tokens"))
    return used.join(kinds, "container_kind").select("container_kind", "containers", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), "segments", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))
