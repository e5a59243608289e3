"""Problem 8: items of varying length put into containers of fixed capacity.

Sizes are whole numbers of at most the largest capacity, so the histogram of sizes has at most that many rows however
many items there are. Variable-capacity best-fit runs on the histogram: sizes from large to small, each item into the
fullest container that takes it, else a new container of the permitted length of least cost for the tokens it will
hold; equal containers are handled together, with a multiplicity. At the end each container is downsized to the smallest
permitted length that takes its contents. The lengths are optimised jointly: the whole plan is made for every set of
them that holds the largest, and the set of least total cost wins.

Two costs are given. FULL counts what containers hold besides tokens plus an opening cost, under which one capacity
wins: the statement of containers of 2,048 tokens with little room left over. ATTENTION adds a cost that grows with the
square of the length, as training on a sequence does; under it several lengths are opened.

Items are numbered within their size as they are written, part by part, and the parts get their offsets from running
sums over the counts of a size in each part, so a size that most items have is never gathered.

Defined results: items without room (null, negative or zero size) get no row; an item above the capacity is cut into
pieces of the capacity and a rest; equal sizes are numbered as they lie; an empty table gives an empty result; every
item is placed whole and once.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saltmarsh.llm.tokens import token_counts
from saltmarsh.session import written

#: Capacity, and the lengths a container may be downsized to.
CAPACITY = 2048
LENGTHS = (256, 512, 1024, 2048)
#: What a container costs besides its length, and the length at which attention costs as much as everything else.
OPENING, QUADRATIC = 64, 4096


def FULL(length: int) -> float:  # noqa: N802
    """Cost of a container where only its room and its opening count."""
    return OPENING + length


def ATTENTION(length: int) -> float:  # noqa: N802
    """Cost of a container where every token attends to every other of its container."""
    return OPENING + length + length * length / QUADRATIC


def best_plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = FULL) -> list[tuple[int, int, int, int, int, int, int]]:
    """The plan of least total cost over all sets of permitted lengths that hold the largest."""
    *short, most = sorted(lengths)
    sets = [(*some, most) for n in range(len(short) + 1) for some in itertools.combinations(short, n)]
    plans = [plan(histogram, own, cost, tuple(lengths)) for own in sets]
    # a container is counted once, by the row of what lies at its beginning
    return min(plans, key=lambda rows: sum(cost(length) * count for _, _, _, count, _, offset, length in rows if offset == 0))


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = FULL, final: tuple[int, ...] | None = None) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (size, first item, items a container, containers, first container, offset in container, final length).

    histogram has the number of items of each size, sizes from 1 to the largest length; lengths may be opened, containers
    are downsized to one of `final`.
    """
    lengths = tuple(sorted(lengths))
    final = tuple(sorted(final or lengths))
    left = sum(s * n for s, n in histogram.items())
    # open containers: room -> list of [containers, contents], contents as (earlier contents, size, first item, items a container, offset)
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def push(room: int, count: int, contents, used: int) -> None:
        if count:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append([count, contents, used])

    def least(size: int) -> int:
        """The permitted length of least cost for each token that it will hold; what is left goes into one container if it can."""
        if left <= lengths[-1]:
            return min(x for x in lengths if x >= max(left, size))
        return min((x for x in lengths if x >= size), key=lambda x: (cost(x) / max(size, min(x, left)), -x))

    for size in sorted(histogram, reverse=True):
        n, item = histogram[size], 0
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                count, contents, used = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room = least(size)
                count, contents, used = max(1, n // (room // size)), None, 0
            each = room // size
            full = min(count, n // each)
            if full:
                push(room - each * size, full, (contents, size, item, each, used), used + each * size)
                n, item, left = n - full * each, item + full * each, left - full * each * size
            if full < count:
                rest = min(n, each) if n < each else 0
                if rest:
                    push(room - rest * size, 1, (contents, size, item, rest, used), used + rest * size)
                    n, item, left = n - rest, item + rest, left - rest * size
                    full += 1
                if contents is not None:
                    push(room, count - full, contents, used)
    rows, first = [], 0
    for groups in open_.values():
        for count, contents, used in groups:
            own = min(x for x in final if x >= used)
            chain = []
            while contents is not None:
                chain.append(contents)
                contents = contents[0]
            rows.append((count, own, chain, first))
            first += count
    return _rows(rows)


def _rows(groups) -> list[tuple[int, int, int, int, int, int, int]]:
    """Groups of equal containers as plan rows. A group's contents may be shared with others that split off it; each takes its share of the items."""
    taken: dict[int, int] = {}
    out = []
    for count, final, chain, first in groups:
        for c in chain:
            _, size, item, each, offset = c
            start = item + taken.get(id(c), 0)
            taken[id(c)] = taken.get(id(c), 0) + count * each
            out.append((size, start, each, count, first, offset, final))
    return sorted(out)


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, part, start, size: an item as it is, or cut where it alone exceeds the capacity."""
    n = F.ceil(F.col("size") / F.lit(capacity)).cast("int")
    return (
        items.where("size > 0")
        .select("item", "size", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
        .select("item", "part", (F.col("part") * capacity).alias("start"), F.least(F.lit(capacity), F.col("size") - F.col("part") * capacity).cast("int").alias("size"))
    )


def _numbered(capacity: int):
    """A function over Arrow batches of pieces that adds the part (the task) and the number of a piece among those of its size in the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_id = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            size = np.asarray(b.column("size")).astype(np.int64)
            order = np.argsort(size, kind="stable")
            starts = np.flatnonzero(np.diff(size[order], prepend=-1))
            within = np.arange(len(size)) - np.repeat(starts, np.diff(np.append(starts, len(size))))
            number = np.empty(len(size), dtype=np.int64)
            number[order] = within
            number += seen[size]
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), part_id), pa.int32()), pa.array(number, pa.int64())], [*b.schema.names, "of", "number"])

    return run


def pack(items: DataFrame, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = FULL) -> DataFrame:
    """item, part, start, size, bin, bin_offset, bin_length for items (item, size)."""
    most = max(lengths)
    cut = pieces(items.select(F.col("item").cast("long").alias("item"), F.col("size").cast("int").alias("size")), most)
    cut = written(cut.mapInArrow(_numbered(most), "item long, part int, start int, size int, of int, number long"), "pieces")  # numbers are fixed when they are written
    counts = cut.groupBy("of", "size").agg(F.count("*").alias("n"))
    before = counts.select("of", "size", (F.sum("n").over(Window.partitionBy("size").orderBy("of").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))  # a row a part
    histogram = {s: n for s, n in counts.groupBy("size").agg(F.sum("n")).collect()}  # at most `capacity` rows, whatever the number of items
    by_size: dict[int, list] = {}
    for r in best_plan(histogram, lengths, cost):
        by_size.setdefault(r[0], []).append(r[1:])
    sent = items.sparkSession.sparkContext.broadcast({s: np.array(r, dtype=np.int64) for s, r in by_size.items()})  # bounded by the capacity
    shape = "bin long, bin_offset int, bin_length int"

    def place(size: pd.Series, number: pd.Series) -> pd.DataFrame:
        plans = sent.value
        out = np.zeros((len(size), 3), dtype=np.int64)
        s_, n_ = size.to_numpy(), number.to_numpy()
        for s in np.unique(s_):
            own = np.flatnonzero(s_ == s)
            n = n_[own]
            p = plans[s]
            row = np.searchsorted(p[:, 0], n, side="right") - 1
            at = n - p[row, 0]
            out[own, 0] = p[row, 3] + at // p[row, 1]
            out[own, 1] = p[row, 4] + at % p[row, 1] * s
            out[own, 2] = p[row, 5]
        return pd.DataFrame({"bin": out[:, 0], "bin_offset": out[:, 1].astype("int32"), "bin_length": out[:, 2].astype("int32")})

    return (
        cut.join(before, ["of", "size"])
        .withColumn("at", F.pandas_udf(place, shape)("size", F.col("number") + F.coalesce("before", F.lit(0))))
        .select("item", "part", "start", "size", "at.bin", "at.bin_offset", "at.bin_length")
    )


def pack_documents(documents: DataFrame, vocabulary: str | None = None, lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = FULL) -> DataFrame:
    """doc_id, part, token_start, n_tokens, container, container_offset, container_length."""
    sized = documents.select(F.col("doc_id").alias("item"), token_counts(documents.sparkSession, "text", vocabulary).alias("size"))
    return pack(sized, lengths, cost).select(
        F.col("item").alias("doc_id"), "part", F.col("start").cast("int").alias("token_start"), F.col("size").alias("n_tokens"),
        F.col("bin").alias("container"), F.col("bin_offset").alias("container_offset"), F.col("bin_length").alias("container_length"),
    )
