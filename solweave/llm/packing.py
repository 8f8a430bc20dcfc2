"""Filling containers of fixed capacity with whole items: best fit decreasing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solweave.staging import stage


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf counts the open bins with that much room."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, bin_no: int) -> None:
        self.bins.setdefault(room, []).append(bin_no)
        node, count = room + self.leaves, self.count
        while node:
            count[node] += 1
            node >>= 1

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """The open bin with the least room that is at least ``size``, removed: (room, bin)."""
        node, count = size + self.leaves, self.count
        if not count[node]:
            # climb until a right sibling holds a bin, then descend to its leftmost
            while True:
                if node == 1:
                    return None
                if node % 2 == 0 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.leaves
        bin_no = self.bins[room].pop()
        while node:
            count[node] -= 1
            node >>= 1
        return room, bin_no


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in bins 0, 1, ...; sizes are at most ``capacity``, equal ones go in the given order."""
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable")
    out, tree, opened = np.empty(len(order), dtype=np.int64), OpenBins(capacity), 0
    for i, size in zip(order.tolist(), np.asarray(sizes)[order].tolist(), strict=True):
        got = tree.take_tightest(size)
        if got is None:
            got = (capacity, opened)
            opened += 1
        tree.add(got[0] - size, got[1])
        out[i] = got[1]
    return out


def box_kinds(spec: DataFrame, box: str, capacity: str, most: int = 10_000) -> list[tuple[str, int]]:
    """The different kinds of boxes (a specification, not data: more than ``most`` are refused); rows without a name or capacity are left out."""
    rows = spec.select(F.col(box).alias("b"), F.col(capacity).cast("bigint").alias("c")).dropna().dropDuplicates().limit(most + 1).collect()
    if len(rows) > most or len({r.b for r in rows}) < len(rows):
        raise ValueError(f"at most {most} kinds of boxes, each with one capacity")
    return [(r.b, r.c) for r in rows]


def pack(
    items: DataFrame,
    item_id: str,
    size: str,
    boxes: Sequence[tuple[str, int]],
    shard_items: int = 200_000,
) -> DataFrame:
    """One row per item piece and kind of box: ``box, <item_id>, piece, pieces, piece_size, bin, capacity``.

    Items no larger than the capacity stay whole (one piece). A larger one is cut into full pieces and a
    rest, and the rest is packed like an item. Pieces are spread by a hash of id and number over shards of about
    ``shard_items`` pieces, and each shard is packed by best fit decreasing; the rule is the same at every size, and
    shards cost at most a few partly filled bins each. ``bin`` is unique within a box kind. Sizes are taken once and written to
    the shared folder, so whatever they are computed from (whole texts) is read once.

    Items of size 0 go into any bin. A null size or id leaves the item out, as does a negative size. Equal sizes are
    placed in the order of their ids. An id that occurs on several rows is packed as often. An empty table gives
    no rows; other columns are not read.
    """
    if not boxes or any(c is None or c <= 0 for _, c in boxes):
        raise ValueError("boxes need positive capacities")
    spec = F.array(*[F.struct(F.lit(b).alias("box"), F.lit(int(c)).cast("bigint").alias("capacity")) for b, c in boxes])
    base = items.select(F.col(item_id).alias("__id"), F.col(size).cast("bigint").alias("__size"))
    base = stage(base.filter(F.col("__id").isNotNull() & (F.col("__size") >= 0)), "sizes")
    number = lambda size, capacity: F.greatest(F.lit(1), F.ceil(size / capacity)).cast("bigint")
    counts = base.agg(*[F.sum(number(F.col("__size"), F.lit(int(c)))) for _, c in boxes]).first()
    shards = F.element_at(F.create_map(*[y for (b, _), n in zip(boxes, counts, strict=True) for y in (F.lit(b), F.lit(max(1, -(-(n or 0) // shard_items))))]), F.col("box"))
    spread = base.withColumn("b", F.explode(spec)).select("__id", "__size", "b.*")
    spread = spread.withColumn("pieces", number(F.col("__size"), F.col("capacity")))
    cut = spread.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)))
    cut = cut.withColumn("piece_size", F.least(F.col("capacity"), F.col("__size") - F.col("piece") * F.col("capacity")))
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("__id", "piece"), shards).cast("int"))
    kind = items.schema[item_id].dataType.simpleString()
    schema = f"box string, __id {kind}, piece bigint, pieces bigint, piece_size bigint, bin bigint, capacity bigint"
    out = cut.groupBy("box", "shard").applyInPandas(_pack_shard(), schema)
    return out.withColumnRenamed("__id", item_id)


def _pack_shard() -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__id", "piece"], kind="stable")
        sizes, capacity = pdf["piece_size"].to_numpy(), int(pdf["capacity"].iloc[0])
        pdf["bin"] = best_fit_decreasing(sizes, capacity) + (int(pdf["shard"].iloc[0]) << 40)
        return pdf[["box", "__id", "piece", "pieces", "piece_size", "bin", "capacity"]]

    return run


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind of box: items, items cut, pieces, bins, tokens, the fullest bin, and the share of the room that is used."""
    cut = (F.col("piece") == 0) & (F.col("pieces") > 1)
    bins = packed.groupBy("box", "bin").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum((F.col("piece") == 0).cast("bigint")).alias("items"), F.sum(cut.cast("bigint")).alias("cut_items"),
        F.sum("piece_size").alias("tokens"), F.max("capacity").alias("capacity"),
    )
    return bins.groupBy("box").agg(
        F.sum("pieces").alias("pieces"), F.sum("items").alias("items"), F.sum("cut_items").alias("cut_items"), F.count(F.lit(1)).alias("bins"),
        F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.max("capacity").alias("capacity"),
        (F.sum("tokens") / (F.count(F.lit(1)) * F.max("capacity"))).alias("fill"),
    )
