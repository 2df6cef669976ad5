"""Exact Jaccard join of word-shingle sets in the metric space of Jaccard distance.

1. Documents with the same shingle set are one node.
2. A pair within the radius shares a shingle among the first ones of both sets in one
   global order (frequent shingles last), so nodes meet by those shingles only.
3. Each shingle's nodes take the most central of them as their pivot.  A pivot's region
   are the nodes of its shingles, each with its distance from the pivot; those within the
   radius are linked with it.  Two nodes that share a leading shingle share a region.
4. Regions of one component are done.  The others are joined recursively: a region of
   many nodes takes pivots of its own, its nodes go to the nearest (a Voronoi region) and
   by the triangle inequality to each other region that may hold a node within the radius
   of them, until a region fits a task.  A region that its pivots do not part is dealt
   into blocks, and every two blocks meet.
5. In a task, pairs of different components inside the triangle window of their
   distances from the pivot are bounded by the shared leading shingles.  Few survivors
   leave as pairs; where there are many, their nodes meet once more with their whole sets
   and give one link for each two components that have any: no task lists all pairs.
6. Components of the links are found by label propagation with pointer jumping.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, releasing, scratch, values, whole_row, written

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's word shingles."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(h))
    g = h[: len(h) - w + 1]
    for k in range(1, w):
        g = _mix(g * MULTIPLIER + h[k : len(h) - w + 1 + k])
    return np.unique((_mix(g) >> np.uint64(1)).astype(np.int64))


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return int(xxh3_64_intdigest(found.tobytes()) >> 1)


def raw_of(text: str) -> int:
    """Digest of a text as it stands: cheaper than its shingles, for texts that need none."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


SLOTS = 1 << 24
CHUNK = 1 << 16


def _frequent(docs: DataFrame, width: int, least: int) -> np.ndarray:
    """One bit per slot of a counting sketch of fixed size: set where clearly more texts than average meet.

    Shingles of set slots come last in the order.  The sketch counts all texts; a shingle
    that shares a slot with a frequent one only comes last too, which changes no result.
    """

    def run(batches):
        held = np.zeros(SLOTS, np.uint16)
        beyond: dict[int, int] = {}  # what 16 bits don't hold
        waiting: list[np.ndarray] = []
        size = 0
        seen: set[int] = set()

        def add():
            at, n = np.unique(np.concatenate(waiting) & (SLOTS - 1), return_counts=True)
            total = held[at].astype(np.int64) + n
            for i in np.flatnonzero(total > 65_535).tolist():
                beyond[int(at[i])] = beyond.get(int(at[i]), 0) + int(total[i])
                total[i] = 0
            held[at] = total.astype(np.uint16)
            waiting.clear()

        for b in batches:
            for t in values(b.column(1)):
                raw = raw_of(t)
                if raw in seen:
                    continue  # a copy is no other text
                if len(seen) < 200_000:
                    seen.add(raw)
                x = shingles(t, width)
                waiting.append(x)
                size += len(x)
                if size > 500_000:
                    add()
                    size = 0
        if waiting:
            add()
        blocks = held.reshape(-1, CHUNK)
        used = sorted({i for i in range(len(blocks)) if blocks[i].any()} | {k // CHUNK for k in beyond})
        for i in range(0, len(used), 32):
            packed = []
            for k in used[i : i + 32]:
                counts = blocks[k].astype(np.uint64)
                for at, n in beyond.items():
                    if at // CHUNK == k:
                        counts[at % CHUNK] += np.uint64(n)
                packed.append(zlib.compress(counts.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([pa.array(used[i : i + 32], pa.int64()), pa.array(packed, pa.binary())], names=["chunk", "counts"])

    def summed(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), values(b.column(1)), strict=True):
                if k not in held:
                    held[k] = np.zeros(CHUNK, np.uint64)
                held[k] += np.frombuffer(zlib.decompress(packed), np.uint64)
        for k, counts in held.items():
            packed = zlib.compress(counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([packed], pa.binary())], names=["chunk", "counts"])

    kind = "chunk long, counts binary"
    local = docs.mapInArrow(releasing(run), kind).repartition("chunk").mapInArrow(releasing(summed), kind)
    total = np.zeros((SLOTS // CHUNK, CHUNK), np.uint64)
    for r in written(local, "jaccard-sketch").toLocalIterator():  # SLOTS / CHUNK rows, whatever the input
        total[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    total = total.reshape(-1)
    load = float(total.mean())
    # the bar rises with the slots' mean, so a shingle that comes early has few texts above it at any size
    return np.packbits(total >= load + 6 * np.sqrt(load) + least)


def _leading(docs: DataFrame, width: int, share: int, frequent) -> DataFrame:
    """Per row: id, node, n, and for a task's first row of a node its leading shingles."""

    def run(batches):
        late = frequent.value
        seen: set[int] = set()
        for b in batches:
            nodes, sizes, cold, hot, cuts, raws = [], [], [], [], [], []
            for t in values(b.column(1)):
                found = shingles(t, width)
                n = len(found)
                node = node_of(found) if n else None
                nodes.append(node)
                sizes.append(n)
                if not n or node in seen:
                    cold.append(found[:0])
                    hot.append(found[:0])
                    cuts.append(None)
                    raws.append(None)
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                k = n - -(-share * n // 100) + 1
                at = found & (SLOTS - 1)
                is_late = (late[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                early = found[~is_late][:k]
                rest = found[is_late][: k - len(early)]
                cold.append(early)
                hot.append(rest)
                cuts.append(int(rest[-1] if len(rest) else early[-1]))
                raws.append(raw_of(t))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(cold), _lists(hot), pa.array(cuts, pa.int64()),
                 pa.array(raws, pa.int64())],
                names=["id", "node", "n", "cold", "hot", "cut", "raw"],
            )

    return docs.mapInArrow(releasing(run), "id long, node long, n long, cold array<long>, hot array<long>, cut long, raw long")


MOST_BITS = 1 << 28


def _bits(wanted: DataFrame, size: int) -> np.ndarray:
    """Text digests as a bitmap: it may hold strangers, but misses none."""
    at = F.pmod(F.col("raw"), F.lit(size))
    found = (
        wanted.groupBy(F.shiftright(at, 5).alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(raw, {size}) & 31 as int))")).alias("b"))
        .toPandas()  # at most size / 32 rows
    )
    words = np.zeros(size // 32, np.uint32)
    words[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).astype(np.uint32)
    return words


def _sets(docs: DataFrame, width: int, wanted: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(node, set) of the texts whose digest, raw, is wanted, and of a few others; few other texts are cut into shingles.

    The digests go out as a bitmap of 16 bits each; beyond `most_bits` the texts' own digests are joined with them.
    """
    wanted = wanted.distinct()
    size = 1 << 22
    n = wanted.count()
    while size < 16 * n and size <= most_bits:
        size *= 2
    bits = None
    if size <= most_bits:
        bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted, size))
    else:
        names = docs.columns

        def keyed(batches):
            for b in batches:
                raws = [raw_of(t) for t in values(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raws, pa.int64())], names=["i", "t", "raw"])

        docs = docs.mapInArrow(releasing(keyed), "i long, t string, raw long").join(wanted, "raw", "left_semi").select("i", "t").toDF(*names)

    def run(batches):
        words = None if bits is None else bits.value
        seen: set[int] = set()
        for b in batches:
            names, found = [], []
            for t in values(b.column(1)):
                raw = raw_of(t)
                if raw not in seen and (words is None or words[(raw % size) >> 5] >> np.uint32(raw & 31) & 1):
                    if len(seen) < 200_000:
                        seen.add(raw)
                    x = shingles(t, width)
                    if len(x):
                        names.append(node_of(x))
                        found.append(x)
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(found)], names=["node", "set"])

    # equal sets of several texts or tasks are one
    return docs.mapInArrow(releasing(run), "node long, set array<long>").dropDuplicates(["node"])


# ---- cells: the nodes that meet in a task ------------------------------------------------


def cells_of(batches):
    """Tables of one cell each, from batches sorted by their first column."""
    held, name = [], None
    for b in batches:
        c = b.column(0).to_numpy()
        cuts = (np.flatnonzero(np.diff(c)) + 1).tolist()
        for s, e in zip([0, *cuts], [*cuts, len(c)], strict=True):
            if s < e and c[s] != name:
                if held:
                    yield pa.Table.from_batches(held)
                held, name = [], c[s]
            if s < e:
                held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values, and each value's row."""
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in column.chunks])
    return np.concatenate(parts), np.repeat(np.arange(len(sizes)), sizes)


def overlaps(tokens: np.ndarray, row: np.ndarray, m: int) -> np.ndarray:
    """How many tokens every two of m rows share; a row's tokens are distinct.

    Tokens of few rows add their pairs one by one, those of many by matrix products.
    """
    out = np.zeros((m, m), np.int32)
    if not len(tokens):
        return out
    order = np.argsort(tokens, kind="stable")
    t, r = tokens[order], row[order]
    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
    held = np.diff(first, append=len(t))
    few = max(8, m // 16)
    flat = out.reshape(-1)
    for d in np.unique(held[(held > 1) & (held <= few)]).tolist():
        rows = r[first[held == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        step = max(1, 1_000_000 // len(i))
        for c in range(0, len(rows), step):
            part = rows[c : c + step]
            np.add.at(flat, (part[:, i] * m + part[:, j]).reshape(-1), 1)
    many = np.flatnonzero(held > few)
    for c in range(0, len(many), 2048):
        part = many[c : c + 2048]
        some = np.zeros((len(part), m), np.float32)
        at = np.repeat(np.arange(len(part)), held[part])
        some[at, r[np.concatenate([np.arange(first[k], first[k] + held[k]) for k in part])]] = 1
        out += np.triu((some.T @ some).astype(np.int32), 1)
    return out + out.T


def _compare(share: int, radius: float, most: int):
    """Pairs of a cell that the bounds allow; beyond `most` a node, the nodes that have any."""

    def one(cell: pa.Table):
        get = lambda c: cell.column(c).to_numpy()
        node, comp, side, d = get("node"), get("component"), get("side"), get("d")
        n, k, late, at = get("n"), get("k"), get("late").astype(np.int64), get("at")
        m = len(node)
        both = overlaps(*_flat(cell.column("shared")), m)
        ok = np.zeros((m, m), bool)
        for s in range(0, m, 256):
            x = slice(s, min(s + 256, m))
            col = lambda v: v[x, None]
            b = both[x]
            first = (col(late) < late) | ((col(late) == late) & (col(at) <= at))
            most_ = np.minimum(np.minimum(b + np.where(first, col(n - k), n - k), col(n)), n)
            here = (b > 0) & (100 * most_ >= share * (col(n) + n - most_)) & (col(comp) != comp)
            here &= (col(side) != side) | (col(side) == 0)
            # the triangle window; a distance that is not known is NaN and decides nothing
            here &= ~(np.abs(col(d) - d) > radius + 1e-9)
            here &= np.arange(m) > np.arange(x.start, x.stop)[:, None]
            ok[x] = here
        i, j = np.nonzero(ok)
        return node, n, i, j

    def run(batches):
        names = ["a", "b", "n_a", "n_b", "cell"]
        out: list[list] = [[], [], [], [], []]
        for cell in cells_of(batches):
            if cell.num_rows < 2:
                continue
            node, n, i, j = one(cell)
            if len(i) > max(most * len(node), 32):
                busy = np.unique(np.concatenate([i, j]))
                part = [node[busy], node[busy], n[busy], n[busy], np.full(len(busy), cell.column("cell")[0].as_py())]
            else:
                low = node[i] < node[j]
                i, j = np.where(low, i, j), np.where(low, j, i)
                part = [node[i], node[j], n[i], n[j], np.full(len(i), -1)]
            for o, p in zip(out, part, strict=True):
                o.append(p)
            if sum(map(len, out[0])) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=names)
                out = [[], [], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names=names)

    return run


def spanning(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Places of links (i, j) that join labels not joined by those before."""
    pair, place = np.unique(np.sort(np.stack([labels[i], labels[j]], 1), axis=1), axis=0, return_index=True)
    up: dict[int, int] = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    out = []
    for (x, y), at in zip(pair.tolist(), place.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append(at)
    return out


def _linked(share: int):
    """A cell's links by whole sets, one for each two components that it joins."""

    def run(batches):
        for cell in cells_of(batches):
            node, comp, side = (cell.column(c).to_numpy() for c in ("node", "component", "side"))
            m = len(node)
            both = overlaps(*_flat(cell.column("set")), m)
            n = np.concatenate([np.diff(c.offsets.to_numpy()) for c in cell.column("set").chunks]).astype(np.int64)
            ok = np.zeros((m, m), bool)
            for s in range(0, m, 256):
                x = slice(s, min(s + 256, m))
                b = both[x].astype(np.int64)
                here = (100 * b >= share * (n[x, None] + n - b)) & (comp[x, None] != comp)
                here &= (side[x, None] != side) | (side[x, None] == 0)
                ok[x] = here & (np.arange(m) > np.arange(x.start, x.stop)[:, None])
            i, j = np.nonzero(ok)
            if len(i):
                at = spanning(comp, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(node[i[at]], pa.int64()), pa.array(node[j[at]], pa.int64())], names=["a", "b"])

    return run


HOT = 1000  # pairs of one node that a task verifies
PART = 256  # nodes of a large cell that meet its pivots in a task


class Join:
    def __init__(self, docs: DataFrame, width: int, share: int, least: int, cell_nodes: int, cell_weight: int):
        self.spark, self.docs, self.width, self.share = docs.sparkSession, docs, width, share
        self.cell_nodes, self.cell_weight, self.radius = cell_nodes, cell_weight, 1 - share / 100
        late = self.spark.sparkContext.broadcast(_frequent(docs, width, least))
        self.rows = written(_leading(docs, width, share, late), "jaccard-rows")
        self._meet()

    def _meet(self) -> None:
        """`groups` (shingle, node): leading shingles of two nodes at least; `nodes`: what bounds need."""
        first = self.rows.where(F.col("cut").isNotNull())
        cold = first.select(F.explode("cold").alias("s"), "node")
        # no shingle that comes early has many more nodes than the mean slot, so a window holds few of the rows
        each = Window.partitionBy("s")
        cold = cold.select("s", "node", F.min("node").over(each).alias("a"), F.max("node").over(each).alias("b"))
        cold = cold.where(F.col("a") != F.col("b")).select("s", "node")
        hot = first.select(F.explode("hot").alias("s"), "node")
        many = hot.groupBy("s").agg(F.min("node").alias("a"), F.max("node").alias("b")).where(F.col("a") != F.col("b"))
        hot = hot.join(many.select("s"), "s", "left_semi").distinct()
        self.groups = written(cold.distinct().unionAll(hot), "jaccard-groups")
        facts = first.select(
            "node", "n", "raw", F.size("cold").alias("early"), (F.size("cold") + F.size("hot")).alias("k"),
            F.struct((F.size("hot") > 0).alias("late"), F.col("cut").alias("at")).alias("cut"),
        ).dropDuplicates(["node"])
        # a node's leading shingles, at most a quarter of its own
        lists = self.groups.groupBy("node").agg(F.collect_list("s").alias("shared"))
        self.nodes = written(lists.join(facts, "node"), "jaccard-nodes")
        names = written(self.rows.select("id", "node", "n"), "jaccard-names")
        discard(self.rows)  # the lists of all rows are as large as the texts' quarter
        self.rows = names

    def stars(self) -> DataFrame:
        """(pivot, node): the most central node of each shingle, and all nodes of its shingles."""
        sizes = self.groups.groupBy("s").agg(F.count("*").alias("c"))
        central = self.groups.join(sizes, "s").groupBy("node").agg(F.sum("c").alias("c"))
        ranked = self.groups.join(central, "node")
        pivots = ranked.groupBy("s").agg(F.max(F.struct("c", "node")).alias("p")).select("s", F.col("p.node").alias("pivot"))
        return written(self.groups.join(pivots, "s").select("pivot", "node").distinct(), "jaccard-stars")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose bound allows the similarity: shared leading shingles and what may follow them."""
        side = lambda k: self.nodes.select(*[F.col(c).alias(f"{c}_{k}") for c in ("node", "shared", "n", "k", "cut")])
        x = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
        both = F.size(F.array_intersect("shared_a", "shared_b"))
        rest = F.when(F.col("cut_a") <= F.col("cut_b"), F.col("n_a") - F.col("k_a")).otherwise(F.col("n_b") - F.col("k_b"))
        most = F.least(both + rest, F.col("n_a"), F.col("n_b"))
        return x.where(100 * most >= self.share * (F.col("n_a") + F.col("n_b") - most)).select(*pairs.columns, "n_a", "n_b")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, both, n_a, n_b): exact intersections."""
        pairs = written(pairs, "jaccard-pairs")
        wanted = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct()
        sets = _sets(self.docs, self.width, wanted.join(self.nodes.select("node", "raw"), "node").select("raw"))
        # a node of very many pairs is dealt over tasks, its set copied to each
        many = written(pairs.groupBy("b").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("b", F.ceil(F.col("c") / HOT).cast("int").alias("k")), "jaccard-many")
        right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
        if many.take(1):
            k = F.coalesce("k", F.lit(1))
            right = right.join(many, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), k - 1))).drop("k")
            pairs = pairs.join(many, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), k.cast("long")).cast("int")).drop("k")
            x = pairs.join(right, ["b", "salt"])
        else:
            x = pairs.join(right, "b")
        x = x.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
        return written(
            x.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).alias("both"), "n_a", "n_b"), "jaccard-verified"
        )

    def reached(self, cells: DataFrame, pivots: DataFrame) -> DataFrame:
        """The rows of `cells` with each pivot of theirs: pivot as b, n_a, n_b, and both, the exact intersection.

        A node's set goes once to its part of a cell, where the sets of all its pivots are; no set goes with each pair.
        """
        wanted = cells.select("node").distinct().join(self.nodes.select("node", "raw"), "node").select("raw")
        sets = _sets(self.docs, self.width, wanted)
        parts = F.ceil(F.col("was") / PART).cast("int")
        near = cells.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts.cast("long")).cast("int")).join(sets, "node")
        far = pivots.join(sets, "node").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        far = far.select("cell", "part", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("set").alias("set_b"))
        x = near.join(far, ["cell", "part"])  # few pivots, so the right side of a key is small
        return x.select("cell", "node", "component", "n", "was", "b", F.col("n").alias("n_a"), "n_b", F.size(F.array_intersect("set", "set_b")).alias("both"))

    def linked(self):
        return 100 * F.col("both") >= self.share * (F.col("n_a") + F.col("n_b") - F.col("both"))

    @staticmethod
    def distance():
        return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))

    def run(self) -> DataFrame:
        """(node, component): nodes with links only; a component's name is its smallest node."""
        stars = self.stars()
        pairs = stars.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        found = self.verified(self.possible(pairs))
        links = found.where(self.linked()).select("a", "b")
        labels = components(links)
        facts = self.nodes.select("node", "n").join(labels, "node", "left")
        facts = facts.select("node", "n", F.coalesce("component", "node").alias("component"))
        met = stars.join(facts, "node")
        mixed = met.groupBy("pivot").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("pivot")
        apart = found.select(F.col("a").alias("node"), F.col("b").alias("pivot"), self.distance().alias("d"))
        apart = met.join(mixed, "pivot", "left_semi").join(apart, ["node", "pivot"], "left")
        cells = apart.select(
            F.xxhash64("pivot").alias("cell"), "node", "component", "n", F.lit(0).alias("side"),
            F.when(F.col("node") == F.col("pivot"), F.lit(0.0)).otherwise(F.coalesce("d", F.lit(float("nan")))).alias("d"),
        )
        cells, more = self.parted(written(cells, "jaccard-cells"))
        links = links.unionAll(more) if more is not None else links
        return components(links.unionAll(self.compared(cells)))

    PIVOTS = 16

    def parted(self, cells: DataFrame, levels: int = 6):
        """The cells, those too large for a task parted recursively, and the links seen on the way.

        A large cell takes about PIVOTS of its nodes as pivots.  A node is at home with the nearest, and a guest
        of each other pivot p with d(node, p) <= r_p + radius and d(node, p) <= d(node, home) + 2 * radius: no
        other region can hold a link of it.  Guests of one region do not meet there, as they do at home.
        """
        parts, links = [], None
        for level in range(levels + 1):
            sizes = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
            large = written(sizes.where((F.col("m") > self.cell_nodes) | (F.col("w") > self.cell_weight)), "jaccard-large")
            if not large.take(1):
                return self._union([*parts, cells]), links
            parts.append(cells.join(large.select("cell"), "cell", "left_anti"))
            cells = cells.join(large, "cell").withColumn("was", F.col("m")).drop("m", "w")
            if level == levels:
                break
            # large cells hold more than `cell_nodes` nodes or very long ones; one pivot at least
            draw = F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.floor(F.col("was") / self.PIVOTS), F.lit(1))) == 0
            least = cells.groupBy("cell").agg(F.min(F.struct("node", "n", "was")).alias("x")).select("cell", "x.*")
            pivots = written(cells.where(draw).select("cell", "node", "n", "was").unionAll(least).distinct(), "jaccard-pivots")
            reach = written(self.reached(cells, pivots), "jaccard-reach")
            new = reach.where(self.linked() & (F.col("node") != F.col("b"))).select(F.col("node").alias("a"), "b")
            links = new if links is None else links.unionAll(new)
            # the distance of a pivot from itself is 0
            reach = reach.select("cell", "node", "component", "n", "was", F.col("b").alias("pivot"), self.distance().alias("e"))
            home = reach.groupBy("cell", "node").agg(F.min(F.struct("e", "pivot")).alias("h")).select("cell", "node", F.col("h.e").alias("near"), F.col("h.pivot").alias("home"))
            far = home.groupBy("cell", F.col("home").alias("pivot")).agg(F.max("near").alias("r"))
            reach = reach.join(home, ["cell", "node"]).join(far, ["cell", "pivot"])
            inside = (F.col("e") <= F.col("r") + self.radius + 1e-9) & (F.col("e") <= F.col("near") + 2 * self.radius + 1e-9)
            reach = reach.where((F.col("pivot") == F.col("home")) | inside)
            cells = reach.select(
                F.xxhash64("cell", "pivot").alias("cell"), "node", "component", "n",
                F.when(F.col("pivot") == F.col("home"), 0).otherwise(1).alias("side"), F.col("e").alias("d"), "was",
            )
            # a region of nearly all nodes of its cell would only be parted again in vain
            share = cells.groupBy("cell").agg(F.count("*").alias("m"), F.max("was").alias("x"), F.sum("n").alias("w"))
            vain = share.where((F.col("m") > 0.7 * F.col("x")) & ((F.col("m") > self.cell_nodes) | (F.col("w") > self.cell_weight)))
            cells = written(cells, "jaccard-cells")
            vain = written(vain.select("cell"), "jaccard-vain")
            parts.append(self.blocks(cells.join(vain, "cell", "left_semi").drop("was")))
            cells = cells.join(vain, "cell", "left_anti").drop("was")
        parts.append(self.blocks(cells.drop("was")))
        return self._union(parts), links

    @staticmethod
    def _union(parts: list[DataFrame]) -> DataFrame:
        names = ["cell", "node", "component", "n", "side", "d"]
        out = parts[0].select(*names)
        for x in parts[1:]:
            out = out.unionAll(x.select(*names))
        return out

    def blocks(self, cells: DataFrame) -> DataFrame:
        """Cells dealt into blocks of which a task holds two: every two blocks are a cell."""
        sizes = cells.groupBy("cell").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
        wanted = F.greatest(F.ceil(2.5 * F.col("m") / self.cell_nodes), F.ceil(2.5 * F.col("w") / self.cell_weight))
        x = cells.join(sizes.select("cell", wanted.cast("int").alias("nb")), "cell")
        x = x.withColumn("i", F.pmod(F.xxhash64("node", F.lit("block")), F.col("nb").cast("long")).cast("int"))
        x = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        # in the cell of a block with itself guests keep their side; in others the blocks are the sides
        side = F.when(F.col("i") == F.col("j"), F.col("side")).when(F.col("i") < F.col("j"), 1).otherwise(2)
        return x.select(F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "node", "component", "n", side.alias("side"), "d")

    def _in_cells(self, rows: DataFrame, n: int) -> DataFrame:
        return rows.repartition(max(partitions(self.spark), n // 200_000), "cell").sortWithinPartitions("cell")

    def compared(self, cells: DataFrame) -> DataFrame:
        """(a, b): links between components."""
        cells = written(cells, "jaccard-parts")
        n = cells.count()
        facts = self.nodes.select("node", "shared", "k", F.col("cut.late").alias("late"), F.col("cut.at").alias("at"))
        rows = self._in_cells(cells.join(facts, "node").select("cell", "node", "component", "side", "d", "n", "k", "late", "at", "shared"), n)
        found = rows.mapInArrow(releasing(_compare(self.share, self.radius, 4)), "a long, b long, n_a long, n_b long, cell long")
        found = written(found, "jaccard-open")
        few = found.where("cell = -1").drop("cell").dropDuplicates(["a", "b"])
        links = self.verified(few).where(self.linked()).select("a", "b")
        many = found.where("cell <> -1").select("cell", F.col("a").alias("node"))
        if not many.take(1):
            return links
        wanted = many.select("node").distinct().join(self.nodes.select("node", "raw"), "node").select("raw")
        sets = _sets(self.docs, self.width, wanted)
        many = many.join(cells.select("cell", "node", "component", "side"), ["cell", "node"])
        rows = self._in_cells(many.join(sets, "node").select("cell", "node", "component", "side", "set"), n)
        return links.unionAll(written(rows.mapInArrow(releasing(_linked(self.share)), "a long, b long"), "jaccard-links"))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable; nodes with links only."""
    edges = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = written(edges, "components-edges")
    labels = written(
        edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "components"
    )
    for _ in range(most_rounds):
        # the smallest label among neighbours, then the label of that label
        around = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(around, "node").select("node", F.least("component", "m").alias("m"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("m"), F.col("component").alias("c"))
        step = step.join(jump, "m").select("node", F.least("m", "c").alias("component"), "was")
        new = written(step, "components")
        changed = new.where(F.col("component") != F.col("was")).take(1)
        labels = new.select("node", "component")
        if not changed:
            labels._written_to = new._written_to
            return labels
    raise RuntimeError("the components did not settle")


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    share: int = 75,
    least: int = 12,
    cell_nodes: int = 2048,
    cell_weight: int = 4_000_000,
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Words are split at space and \\x09-\\x0D, A-Z lower-cased; a set is the distinct
    shingles of `width` words, the whole sequence where there are fewer.  Two rows link
    when 100 * intersection >= share * union.  Rows without words (null, empty or blank
    texts) are linked with nothing: their component is their own id.  Rows of one set
    are one node, so repeated rows and copies share a component.  Null ids rank last.
    An empty table gives no rows; extra columns are ignored.  `least`, `cell_nodes` (nodes that
    a task compares) and `cell_weight` (their shingles) only steer the work: the result is
    exact for any of them.
    """
    source = docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit("")))
    with scratch(docs.sparkSession) as keep:
        join = Join(source, width, share, least, cell_nodes, cell_weight)
        labels = keep(join.run())
        rows = keep(join.rows).select("id", "node", "n")
    firsts = rows.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("first"))
    named = firsts.join(labels, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = named.join(least_id, "component").select("node", "component_id")
    return rows.join(names, "node", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their component, with the columns of `docs`, which may have any names.

    Rows of a null id stay, as do those without words and repeated rows of a staying id.
    An empty table stays empty.
    """
    found = jaccard_components(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), whole_row(docs).alias("_row"))
    return rows.join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")
