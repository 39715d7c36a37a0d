"""Documents into containers of fixed capacity: first-fit decreasing in randomised groups.

Documents are spread over groups by a hash of their id, so that every group is a random draw of all sizes and has
about ``GROUP`` members however large the table is; each group is packed on its own, in parallel. Within a group, the
largest piece first, each piece goes into the first container with room, found in a tournament tree over the rooms
left. Only the last, least full containers of a group are wasted by the division.

A document larger than the capacity is cut: its full pieces are containers by themselves and never reach a group; what
remains of it is packed like any document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP = 20_000
RESULT = "pack_name string, capacity bigint, doc_id bigint, piece bigint, size bigint, container string"


class Rooms:
    """Tournament tree: every node holds the largest room below it; ``fit`` finds the first container with room for size and takes it."""

    def __init__(self, n: int, capacity: int) -> None:
        self.width = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.width)

    def fit(self, size: int) -> int:
        at, room = 1, self.room
        while at < self.width:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.width
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each size, none larger than the capacity; sizes are taken largest first, ties in the order given."""
    rooms, out = Rooms(len(sizes), capacity), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = rooms.fit(sizes[k])
    return out


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece"], kind="stable")
    where = first_fit_decreasing(rows["size"].tolist(), int(rows["capacity"].iloc[0]))
    rows["container"] = [f"{key[1]}-{w}" for w in where]
    return rows[["pack_name", "capacity", "doc_id", "piece", "size", "container"]]


def packed(sizes: DataFrame, packs: DataFrame, group: int = GROUP) -> DataFrame:
    """sizes: doc_id, size. packs: pack_name, capacity_tokens, a short list of tasks. One row for each piece of each document and task.

    piece counts from 0 within a document. An empty document, or one of null size, is a piece of size 0 and takes no
    room. A capacity that is null or not positive is no task. A doc_id that occurs twice is two documents with one name.
    Every row has a container; none is left out.
    """
    tasks = [(r.pack_name, r.capacity_tokens) for r in packs.select("pack_name", "capacity_tokens").distinct().collect() if r.capacity_tokens and r.capacity_tokens > 0]
    spark = sizes.sparkSession
    if not tasks:
        return spark.createDataFrame([], RESULT)
    groups = max(1, -(-sizes.count() // group))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in sorted(tasks)])).alias("t")
    rows = sizes.select("doc_id", F.coalesce(F.col("size"), F.lit(0)).cast("bigint").alias("size"), each).select("t.pack_name", "t.capacity", "doc_id", "size")
    full = F.expr("size div capacity")
    cut = rows.where("size > capacity").select("pack_name", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    alone = cut.select("pack_name", "capacity", "doc_id", "piece", F.col("capacity").alias("size"), F.concat(F.lit("d"), "doc_id", F.lit("-"), "piece").alias("container"))
    rest = rows.withColumn("piece", F.when(F.col("size") > F.col("capacity"), full).otherwise(0)).withColumn("size", F.col("size") - F.col("piece") * F.col("capacity")).where("piece = 0 OR size > 0")
    grouped = rest.withColumn("_group", F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(groups)))
    return alone.unionByName(grouped.groupBy("pack_name", "_group").applyInPandas(_pack, RESULT))


def unused(pieces: DataFrame) -> DataFrame:
    """For each task: pieces, containers, the fewest containers that could hold the sizes, and the share of the space unused."""
    containers = pieces.groupBy("pack_name", "capacity", "container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    total = containers.groupBy("pack_name", "capacity").agg(F.sum("n").alias("n_pieces"), F.count("*").alias("n_containers"), F.sum("used").alias("used"), F.max("used").alias("fullest"))
    return total.select("pack_name", "capacity", "n_pieces", "n_containers", F.expr("(used + capacity - 1) div capacity").alias("least_containers"), "fullest", (F.lit(1) - F.col("used") / (F.col("n_containers") * F.col("capacity"))).alias("unused_share"))
