"""Packing items into containers of fixed capacity, with a fixed number of open containers for each partition.

Each partition streams its items past ``open_windows`` open containers for every capacity: an item goes into the fullest one it fits into; if it fits into none, the
fullest is emitted and a new one opened. What is open at the end of a partition is merged in groups of at most ``merge_rows`` containers, the
fullest first, each into the fullest container it fits into. An item larger than the capacity is the only one split: into full
containers of its own and a rest that is packed like an item.

Memory: ``open_windows`` containers a partition, ``merge_rows`` of them a group. Items are spread by a hash of their identifier, so the result depends on the
table's rows and the parameters only.

Defined results: items of size 0 (null or empty texts) take a place; rows with a null identifier, a null or negative size take no part; a repeated
identifier is packed as often as it occurs, each time in a place of its own (containers are named by partition and running number); capacities that are null or under 1 are left out, of equal names the largest counts; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.session import cut

PLACED = "bin_name string, container string, item long, piece int, place int, start long, tokens long, offset long, closed boolean"
_COLS = [c.split()[0] for c in PLACED.split(", ")]


class _Windows:
    """The open containers of one capacity."""

    def __init__(self, name: str, capacity: int, most: int, partition: int):
        self.name, self.capacity, self.most, self.partition = name, capacity, most, partition
        self.room: list[tuple[int, int]] = []  # (room left, number), ascending
        self.content: dict[int, list] = {}
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, item: int, piece: int, start: int, size: int) -> list[tuple]:
        """Places an item; the rows of the containers that are done by it."""
        out = []
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            if len(self.room) >= self.most:
                out += self.rows(self.room.pop(0)[1], True)
            room, number = self.capacity, self.new()
            self.content[number] = []
        held = self.content[number]
        held.append((item, piece, len(held), start, size, self.capacity - room))
        if room == size and size:
            out += self.rows(number, True)
        else:
            insort(self.room, (room - size, number))
        return out

    def fill(self, item: int, piece: int, start: int) -> list[tuple]:
        """A container for a piece that takes all of it."""
        number = self.new()
        self.content[number] = [(item, piece, 0, start, self.capacity, 0)]
        return self.rows(number, True)

    def rows(self, number: int, closed: bool) -> list[tuple]:
        name = f"{self.name}/{self.partition}/{number}"
        return [(self.name, name, *c, closed) for c in self.content.pop(number)]


def pack(items: DataFrame, bins: list[tuple[str, int]], open_windows: int = 64, partition_rows: int = 20_000, merge_rows: int = 20_000) -> DataFrame:
    """``(bin_name, container, item, piece, place, start, tokens, offset)`` for ``(id, tokens)``: ``start`` is the piece's first token within
    its item, ``offset`` within its container."""
    sizes = {}
    for n, c in bins:
        if n is not None and c is not None and c >= 1:
            sizes[n] = max(c, sizes.get(n, 0))
    items = items.filter("id is not null and tokens >= 0").select("id", "tokens")
    parts = max(1, -(-items.count() // partition_rows))

    def run(batches):
        open_ = [_Windows(n, c, open_windows, TaskContext.get().partitionId()) for n, c in sorted(sizes.items())]
        for pdf in batches:
            out = []
            for item, size in zip(pdf["id"].tolist(), pdf["tokens"].tolist(), strict=True):
                for w in open_:
                    pieces, start = 0, 0
                    while size - start > w.capacity:
                        out += w.fill(item, pieces, start)
                        pieces, start = pieces + 1, start + w.capacity
                    out += w.put(item, pieces, start, size - start)
            yield pd.DataFrame(out, columns=_COLS)
        yield pd.DataFrame([r for w in open_ for c in list(w.content) for r in w.rows(c, False)], columns=_COLS)

    spread = F.xxhash64("id")
    placed = cut(items.repartition(parts, "id").sortWithinPartitions(spread, "id", "tokens").mapInPandas(run, PLACED))
    rest = placed.filter("not closed").groupBy("bin_name", "container").agg(F.sum("tokens").alias("load"), F.count("*").cast("int").alias("n"))
    groups = max(1, -(-(parts * open_windows) // merge_rows))
    rest = rest.withColumn("g", F.pmod(F.xxhash64("container"), F.lit(groups)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = sizes[pdf["bin_name"].iloc[0]]
        room: list[tuple[int, str]] = []
        used: dict[str, int] = {}
        out = []
        for r in pdf.sort_values(["load", "container"], ascending=[False, True]).itertuples(index=False):
            at = bisect_left(room, (r.load, ""))
            left, into = room.pop(at) if at < len(room) else (capacity, r.container)
            out.append((r.bin_name, r.container, into, capacity - left, used.get(into, 0)))
            used[into] = used.get(into, 0) + r.n
            insort(room, (left - int(r.load), into))
        return pd.DataFrame(out, columns=["bin_name", "container", "into", "shift", "before"])

    moved = rest.groupBy("bin_name", "g").applyInPandas(merge, "bin_name string, container string, into string, shift long, before int")
    late = placed.filter("not closed").join(moved, ["bin_name", "container"])
    cols = ["bin_name", "container", "item", "piece", "place", "start", "tokens", "offset"]
    late = late.select("bin_name", F.col("into").alias("container"), "item", "piece", (F.col("place") + F.col("before")).alias("place"), "start", "tokens", (F.col("offset") + F.col("shift")).alias("offset"))
    return placed.filter("closed").select(*cols).unionByName(late)


def usage(placed: DataFrame, capacities: DataFrame) -> DataFrame:
    """``(bin_name, containers, tokens, least, fill)``: ``least`` is the number that no packing can go below, ``fill`` the share of space used."""
    each = placed.groupBy("bin_name", "container").agg(F.sum("tokens").alias("load"))
    out = each.groupBy("bin_name").agg(F.count("*").alias("containers"), F.sum("load").alias("tokens")).join(capacities, "bin_name")
    return out.select("bin_name", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
