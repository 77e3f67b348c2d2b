"""Filling containers of fixed capacity: sum-of-squares packing.

For every residual gap g the number N(g) of open containers with that gap is kept. An item of size s goes where the sum of
N(g)^2 over all gaps becomes smallest: into a container of some gap g >= s, or into a new one. Large items come first.
An item above the capacity is split into full containers and a rest; nothing else is ever split.

Items are spread over shards by a hash of their id, about ``shard_items`` in each, and every shard is packed by itself: a
shard is one task's bounded group whatever the table's size, and since a shard leaves at most a few containers
partly open, the space lost by sharding is about one container in ``shard_items`` items. Contents ride along in Arrow and
are not looked at in Python. Container numbers are (shard << 32) + number within the shard, unique per limit.

Sizes: ``token_count`` of the latest row; where it is null, negative, or zero on a text that is not blank, the estimate
max(1, floor(characters / 3.56)). A blank text with no positive count has size 0 and takes no space.

Defined results: rows with a null id are left out; exact repeats and older rows of an id collapse to the latest row; ties are
resolved by the greater order and count; a limit that is null or below 1 is left out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.runtime import latest_by_id


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[list[list[tuple[int, int]]], int]:
    """For each item, in the given order, its pieces as (container, tokens); and the number of containers."""
    counts = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    big = np.iinfo(np.int64).max
    out: list[list[tuple[int, int]]] = []
    made = 0
    for size in sizes.tolist():
        pieces = []
        while size > capacity:
            pieces.append((made, capacity))
            made += 1
            size -= capacity
        if size == 0:
            if not pieces:
                pieces.append((-1, 0))
            out.append(pieces)
            continue
        fits = counts[size:]
        after = counts[: capacity + 1 - size].copy()
        after[0] = 0  # a full container is closed and counts for nothing
        cost = np.where(fits > 0, 2 * (after - fits) + 2, big)
        cost[0] -= cost[0] != big  # an exact fit adds no gap
        gap = int(cost.argmin())
        fresh = capacity - size
        new = 2 * int(counts[fresh]) + 1 if fresh else 0
        if cost[gap] <= new:
            box = open_at[gap + size].pop()
            counts[gap + size] -= 1
            rest = gap
        else:
            box, rest = made, fresh
            made += 1
        if rest:
            open_at[rest].append(box)
            counts[rest] += 1
        pieces.append((box, size))
        out.append(pieces)
    zero = next((k for k, p in enumerate(out) if p[0][0] == -1), None)
    if zero is not None:  # items without size lie in container 0, which is there if anything is
        made = max(made, 1)
        out = [[(0, 0)] if p[0][0] == -1 else p for p in out]
    return out, made


_PIECE = pa.struct([("limit_name", pa.string()), ("container", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("tokens", pa.int32()), ("before", pa.int32())])


def _pack(limits: list[tuple[str, int]]) -> Callable[[pa.Table], pa.Table]:
    def work(items: pa.Table) -> pa.Table:
        ids, sizes = items.column("id").to_pylist(), items.column("size").to_numpy()
        shard = items.column("shard")[0].as_py()
        order = sorted(range(len(ids)), key=lambda k: (-sizes[k], ids[k]))
        cells: list[list[tuple]] = [[] for _ in ids]
        for name, capacity in limits:
            placed, _ = sum_of_squares(sizes[order], capacity)
            for k, pieces in zip(order, placed, strict=True):
                before = 0
                for part, (box, tokens) in enumerate(pieces):
                    cells[k].append((name, (shard << 32) + box, part, len(pieces), tokens, before))
                    before += tokens
        flat = [c for row in cells for c in row]
        cols = [pa.array([c[j] for c in flat], t.type) for j, t in enumerate(_PIECE)]
        ends = np.cumsum([0] + [len(row) for row in cells]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(cols, fields=list(_PIECE)))
        return pa.table([items.column("id"), items.column("size"), items.column("content"), pa.chunked_array([lists])], names=["id", "size", "content", "pieces"])

    return work


def sized(elements: DataFrame) -> DataFrame:
    """The latest row of each id with its size in tokens."""
    rows = elements.select("id", "created_at", "atomic_order", "token_count", "content")
    last = latest_by_id(rows, "id", ["created_at", "atomic_order", "token_count"], ["created_at", "atomic_order", "token_count", "content"])
    text = F.coalesce("content", F.lit(""))
    guess = F.when(F.trim(text) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), (F.length(text) / F.lit(3.56)).cast("int")))
    return last.select("id", "content", F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(guess).cast("int").alias("size"))


def pack(elements: DataFrame, limits: DataFrame, shard_items: int = 25_000) -> DataFrame:
    """(limit_name, container, id, part, parts, tokens, content): every element, or every part of one, in its container."""
    caps = [(r[0], r[1]) for r in limits.where("limit_name is not null and capacity >= 1").groupBy("limit_name").agg(F.min("capacity").alias("c")).orderBy("limit_name").toLocalIterator()]
    shards = max(1, -(-elements.count() // shard_items))
    items = sized(elements).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    kinds = "array<struct<limit_name:string,container:bigint,part:int,parts:int,tokens:int,before:int>>"
    packed = items.groupBy("shard").applyInArrow(_pack(caps), f"id string, size int, content string, pieces {kinds}")
    one = packed.select("id", "size", "content", F.explode("pieces").alias("p"))
    # a part's share of the text follows its share of the tokens, with the ends of neighbouring parts meeting
    piece = F.expr("substring(content, cast(floor(length(content) * p.before / size) as int) + 1, cast(floor(length(content) * (p.before + p.tokens) / size) - floor(length(content) * p.before / size) as int))")
    return one.select("p.limit_name", "p.container", "id", "p.part", "p.parts", "p.tokens", F.when(F.col("p.parts") > 1, piece).otherwise(F.col("content")).alias("content"))


def fill_report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """Per limit: containers, tokens, share of unused space, and the least number of containers that could do."""
    by = packed.groupBy("limit_name", "container").agg(F.sum("tokens").alias("t")).groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    caps = limits.where("limit_name is not null and capacity >= 1").groupBy("limit_name").agg(F.min("capacity").alias("capacity"))
    room = F.col("containers") * F.col("capacity")
    return by.join(caps, "limit_name").select("limit_name", "capacity", "containers", "tokens", "fullest", F.round(1 - F.col("tokens") / room, 6).alias("unused"), F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"))
