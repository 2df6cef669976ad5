"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each task takes its documents in the order of its input split and packs groups of
`group_windows` windows: the documents of a group become partial partitions, and the
two partitions of the largest imbalance are merged with opposing order until one is
left.  With cutting allowed the few tokens above a window's capacity move into
windows with room, so that full windows have no padding; without it the window count
rises until every window holds its documents whole.
"""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, values
from .tokens import encoder

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, capacity long"
)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k sets of item indexes with near-equal sums."""
    if not sizes:
        return [[] for _ in range(k)]
    heap = []
    for i, s in enumerate(sizes):
        bins = [(0, ())] * (k - 1) + [(s, (i, None))]
        heap.append((-s, i, bins))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b), strict=True):
            merged.append((x + y, (p, q) if p and q else p or q))
        merged.sort(key=lambda t: t[0])
        low = merged[0][0]
        merged = [(x - low, p) for x, p in merged]
        heapq.heappush(heap, (-merged[-1][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2]:
        found, stack = [], [tree] if tree else []
        while stack:
            t = stack.pop()
            if t[1] is None:
                found.append(t[0])
            else:
                stack += t
        out.append(sorted(found))
    return out


def whole_windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """No cuts: the window count starts at the least possible and rises while any window overflows."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item is larger than the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in x) <= capacity for x in sets):
            return [x for x in sets if x]
        k += 1


def filled_windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Cuts allowed, the sizes summing to whole windows: (item, start, length) lists that fill each window."""
    k = sum(sizes) // capacity
    windows, spare = [], []
    for found in differencing(sizes, k):
        window, room = [], capacity
        for i in sorted(found, key=lambda i: -sizes[i]):
            take = min(room, sizes[i])
            if take:
                window.append((i, 0, take))
                room -= take
            if take < sizes[i]:
                spare.append([i, take, sizes[i] - take])
        windows.append((window, room))
    for window, room in windows:
        while room:
            i, at, left = spare[-1]
            take = min(room, left)
            window.append((i, at, take))
            room -= take
            if take == left:
                spare.pop()
            else:
                spare[-1] = [i, at + take, left - take]
    return [w for w, _ in windows]


class Packer:
    """Takes documents one by one and gives the rows of full groups; bounded by one group and one document."""

    def __init__(self, first_sequence: int, capacity: int, group_windows: int):
        self.next, self.capacity, self.group = first_sequence, capacity, capacity * group_windows
        self.items: list[tuple] = []  # doc_id, ids, start, doc_tokens, length
        self.held = 0

    def _rows(self, windows, sizes_of) -> list[tuple]:
        rows = []
        for window in windows:
            offset = 0
            for i, at, length in window:
                doc_id, ids, start, total, _ = self.items[i]
                piece = ids[4 * (start + at) : 4 * (start + at + length)]
                rows.append((doc_id, start + at, length, zlib.crc32(piece), total, self.next, offset, sizes_of))
                offset += length
            self.next += 1
        return rows

    def add(self, doc_id, ids: bytes) -> list[tuple]:
        rows, total, start = [], len(ids) // 4, 0
        while start < total:
            take = min(total - start, self.group - self.held)
            self.items.append((doc_id, ids, start, total, take))
            self.held += take
            start += take
            if self.held == self.group:
                rows += self._flush()
        return rows

    def _flush(self) -> list[tuple]:
        # items longer than a window are cut first, so that differencing sees only what can balance
        cut, whole = [], []
        for doc_id, ids, start, total, length in self.items:
            while length > self.capacity:
                whole.append((doc_id, ids, start, total, self.capacity))
                start, length = start + self.capacity, length - self.capacity
            cut.append((doc_id, ids, start, total, length))
        self.items = whole
        rows = self._rows([[(i, 0, self.capacity)] for i in range(len(whole))], self.capacity)
        self.items = cut
        rows += self._rows(filled_windows([x[4] for x in cut], self.capacity), self.capacity)
        self.items, self.held = [], 0
        return rows

    def close(self) -> list[tuple]:
        """The rest: whole windows as in a group, then sequences of falling powers of two, which need no padding."""
        rows, parts, size = [], [], self.capacity
        left = self.held % self.capacity
        if room := self.held - left:
            front, items = [], self.items
            while room:
                doc_id, ids, start, total, length = items[len(front)]
                take = min(room, length)
                front.append((doc_id, ids, start, total, take))
                room -= take
            rest = items[len(front) :]
            if take < length:
                rest = [(doc_id, ids, start + take, total, length - take), *rest]
            self.items = front
            rows += self._flush()
            self.items = rest
        while left:
            while size > left:
                size //= 2
            parts.append(size)
            left -= size
        queue = [list(x) for x in self.items]
        at = 0
        for size in parts:
            window, room = [], size
            while room:
                take = min(room, queue[at][4])
                doc_id, ids, start, total, length = queue[at]
                window.append((doc_id, ids, start, total, take))
                queue[at][2], queue[at][4] = start + take, length - take
                room -= take
                at += take == length
            self.items = window
            rows += self._rows([[(i, 0, x[4]) for i, x in enumerate(window)]], size)
        self.items, self.held = [], 0
        return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    kind: str = "word",
    end_id: int = 2,
    capacity: int = 4096,
    group_windows: int = 24,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, capacity.

    capacity: the sequence's padded size; 4096, or at the end of a task's input a
    power of two that its tokens fill.  Null and empty texts are the end id alone;
    null ids and repeated rows are packed row by row; an empty table gives no rows.
    A sequence id is the task's number times 2^32 plus a running number: the same
    split gives the same ids when a lost task runs again.  `capacity` must be a power
    of two.  There is no shuffle.
    """
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    end = int(end_id).to_bytes(4, "little")
    types = [pa.int64()] * 8
    names = [x.split()[0] for x in PIECES.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names
        )

    def run(batches):
        from pyspark import TaskContext

        one = encoder(tokenizer_path, kind, "ids")
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, group_windows)
        for b in batches:
            rows = []
            for doc_id, text in zip(values(b.column(0)), values(b.column(1)), strict=True):
                rows += packer.add(doc_id, one.ids(text) + end)
                if len(rows) > 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)
        if rows := packer.close():
            yield batch(rows)

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).cast("long"), text).mapInArrow(releasing(run), PIECES)
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def padding(packed: DataFrame) -> DataFrame:
    """sequences, tokens, padded: what the packing costs."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("capacity").alias("cap"))
    return each.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.col("cap") - F.col("n")).alias("padded")
    )

