"""Language-model scoring by a weighted backoff automaton.

Smoothed n-grams become states.  A state has an arc for each continuation and a failure
arc, weighted by the backoff mass, to the state of its longest shorter suffix; a text is
scored left to right by its arcs and failure arcs.

Every n-gram of the training rows is in the model, so it grows with the input and no
task holds it: it is sharded by its contexts.  Texts form blocks.  Shards of the words
number all words and count them; a block then asks the shards of the n-grams for its
own, with their counts in its training texts, the shards add up the blocks' counts, and
the block scores its texts by the part of the automaton that it was told.  Words are
known by 64 bits of a hash, n-grams by their words' numbers, which are small for common
words; only contexts whose numbers do not fit 64 bits are hashed.

`Automaton` is the same model in one process.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, releasing, scratch, values, written

END = "\n"  # the end token; no word holds white space


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class Grams:
    """Kept n-grams by level: level 1 are words; an entry above is (context entry below, word)."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words = words
        self.size = len(words)
        self.codes: list[np.ndarray] = [np.arange(len(words), dtype=np.int64)]
        self.counts = [counts]

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(codes)
        self.codes.append(codes[order])
        self.counts.append(counts[order])


class Automaton:
    """States by number, 0 the root; arcs, failure arcs and their log10 weights."""

    def __init__(self, grams: Grams, tokens: int, distinct: int, discount: float = 0.5):
        self.size = M = grams.size
        p1 = (grams.counts[0] + 0.1) / (tokens + 0.1 * (distinct + 1))
        probs, dest, first = [p1], [], [1]
        for k in range(1, len(grams.codes)):
            first.append(first[-1] + len(grams.codes[k - 1]))
        backoffs = []
        for k in range(1, len(grams.codes)):
            codes, counts, context = grams.codes[k], grams.counts[k], grams.codes[k] // M
            share = (counts - discount) / grams.counts[k - 1][context]
            mass = 1.0 - np.bincount(context, share, len(grams.codes[k - 1])) if len(codes) else np.ones(len(grams.codes[k - 1]))
            backoffs.append(np.maximum(mass, 1e-12))
            suffix = self._suffix(grams, k)
            probs.append(share + backoffs[-1][context] * probs[k - 1][suffix])
        # an entry is a state of its own if it has arcs, else it is the state of its suffix
        for k in range(len(grams.codes)):
            arcs = np.zeros(len(grams.codes[k]), bool)
            if k + 1 < len(grams.codes):
                arcs[grams.codes[k + 1] // M] = True
            lower = dest[k - 1][self._suffix(grams, k)] if k else np.zeros(len(arcs), np.int64)
            dest.append(np.where(arcs, first[k] + np.arange(len(arcs)), lower))
        states = first[-1] + len(grams.codes[-1])
        self.root = list(zip(np.log10(p1).tolist(), dest[0].tolist(), strict=True))
        self.log_p1 = np.log10(p1).tolist()
        fail, weight = np.zeros(states, np.int64), np.zeros(states)
        for k in range(len(grams.codes) - 1):
            at = first[k] + np.arange(len(grams.codes[k]))
            if k:
                fail[at] = dest[k - 1][self._suffix(grams, k)]
            weight[at] = np.log10(backoffs[k])
        self.fail, self.weight = fail.tolist(), weight.tolist()
        self.arcs: dict[int, tuple[float, int]] = {}
        for k in range(1, len(grams.codes)):
            key = (first[k - 1] + grams.codes[k] // M) * M + grams.codes[k] % M
            self.arcs.update(zip(key.tolist(), zip(np.log10(probs[k]).tolist(), dest[k].tolist(), strict=True), strict=True))

    @staticmethod
    def _suffix(grams: Grams, k: int) -> np.ndarray:
        """Entries one level down without the first word."""
        codes, M = grams.codes[k], grams.size
        if k == 1:
            return codes % M
        below = Automaton._suffix(grams, k - 1)[codes // M]
        return np.searchsorted(grams.codes[k - 1], below * M + codes % M)

    def score(self, ids) -> float:
        """log10 probability of the ids; a negative id's own probability is left out."""
        arcs, fail, weight, root, M = self.arcs, self.fail, self.weight, self.root, self.size
        state, total = 0, 0.0
        for w in ids:
            if w < 0:
                while state:
                    total += weight[state]
                    state = fail[state]
                continue
            while state:
                arc = arcs.get(state * M + w)
                if arc is not None:
                    break
                total += weight[state]
                state = fail[state]
            else:
                arc = root[w]
            total += arc[0]
            state = arc[1]
        return total


# ---- the model in shards -----------------------------------------------------------------

DISCOUNT = 0.5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
DEALT = np.uint64(15)  # the continuations of a single word are dealt over this many shards and one


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(widths: tuple, *columns: np.ndarray) -> bytes:
    """Whole numbers by the planes of their low bytes, compressed: empty and repeating bytes cost nothing."""
    planes = [np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T) for a, w in zip(columns, widths, strict=True)]
    return _zstd()[0].compress(b"".join(x.tobytes() for x in planes))


def _unpacked(body: bytes, widths: tuple) -> list[np.ndarray]:
    body = _zstd()[1].decompress(body)
    n, at, out = len(body) // sum(widths), 0, []
    for width in widths:
        found = np.zeros((n, 8), np.uint8)
        found[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
        out.append(found.view("<u8").reshape(n))
        at += n * width
    return out


#: What the messages hold, by bytes: (context step, continuation, count) asked of an n-gram shard, (hash step,
#: count) of a word shard; (place in the shard, count) told of words, and of their followers; what a shard tells.
GRAM, WORD, PLACED, FOLLOWED, SEEN, LONGER = (8, 5, 5), (8, 5), (5, 5), (5,), (5,), (5, 5, 5)
NUMBERED_WORDS = (5, 5, 4)  # a block's words: number, count, place in the order in which it asked


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def _grouped(context, continued, used: int, bits: int) -> tuple:
    """The distinct pairs in the order of (context, continued), and each row's pair."""
    if used + bits <= 64:
        both, pair = np.unique(context << np.uint64(bits) | continued, return_inverse=True)
        return both >> np.uint64(bits), both & np.uint64((1 << bits) - 1), pair
    order = np.lexsort((continued, context))
    x, y = context[order], continued[order]
    new = np.ones(len(order), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    pair = np.empty(len(order), np.int64)
    pair[order] = np.cumsum(new) - 1
    return x[new], y[new], pair


def _by_shard(shard: np.ndarray) -> tuple:
    """The order by shard, and (shard, start, end) of the shards in it."""
    order = np.argsort(shard, kind="stable")
    found = shard[order]
    first = np.flatnonzero(np.diff(found, prepend=-1))
    return order, [(int(found[s]), s, e) for s, e in zip(first, [*first[1:], len(found)], strict=True)]


def _range(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _gram_shard(context, continued, k: int, shards: int) -> np.ndarray:
    return _range(_mix(context * MULTIPLIER + (continued & DEALT if k == 2 else np.uint64(0))), shards)


CLASSES = 48  # of counts by their binary digits


def _class(seen: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, np.log2(np.maximum(seen, 1)).astype(np.int64) + 1, 0)


class Numbering:
    """Numbers of all words: by class of their count, common ones first, then by shard and place in it."""

    def __init__(self, entries: np.ndarray):
        shards = len(entries)
        self.distinct = int(entries.sum())
        falling = entries[:, ::-1]
        local = np.cumsum(falling, axis=1) - falling
        flat = falling.T.reshape(-1)
        whole = (np.cumsum(flat) - flat).reshape(CLASSES, shards).T
        self.starts = whole.T.reshape(-1)
        self.shift = (whole - local)[:, ::-1]  # by shard and class: number less place
        self.shards = shards

    def number(self, shard: int, place: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return (place.astype(np.int64) + self.shift[shard][_class(seen.astype(np.int64))]).astype(np.uint64)

    def home(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place of words."""
        at = np.searchsorted(self.starts, number, side="right") - 1
        shard, cls = at % self.shards, CLASSES - 1 - at // self.shards
        return shard, number - self.shift[shard, cls]


class Block:
    """Some texts as numbers of the block's own words."""

    def __init__(self, row: dict):
        self.id, self.held_out = row["block"], np.array(row["h"], bool)
        self.lengths = np.array(row["n"], np.int64)
        self.stream = _unpacked(row["stream"], (4,))[0].astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.stream)) - np.repeat(self.starts, self.lengths)
        self.train = np.repeat(~self.held_out, self.lengths)
        if "names" in row:
            self.names = np.frombuffer(row["names"], "<u8")
        else:
            self.number, count, self.asked = _unpacked(row["words"], NUMBERED_WORDS)
            self.count = count.astype(np.int64)

    def grams(self, k: int, bits: int) -> tuple:
        """(positions, contexts, continuations, each position's pair) of the n-grams of length k."""
        at = np.flatnonzero(self.place >= k - 1)
        words = self.number[self.stream]
        context, used = words[at - k + 1], bits
        for j in range(k - 2, 0, -1):
            if used + bits <= 64:
                context, used = context << np.uint64(bits) | words[at - j], used + bits
            else:
                context, used = _mix(context * MULTIPLIER + words[at - j]), 64
        return (at, *_grouped(context, words[at], used, bits))


def _of_level(answers: pa.Table, k: int) -> list[tuple[int, bytes]]:
    """(shard, body) of one level, by shard."""
    level, shard, bodies = answers.column("level").to_numpy(), answers.column("shard").to_numpy(), answers.column("body")
    mine = np.flatnonzero(level == k)
    return [(int(shard[i]), bodies[int(i)].as_py()) for i in mine[np.argsort(shard[mine])]]


ASKS = "level int, shard long, block long, body binary"
ANSWERS = "level int, block long, shard long, body binary, tokens long, words long"
RAW = "block long, i array<long>, h array<boolean>, n array<long>, names binary, stream binary, size long, distinct long"
BLOCKS = "block long, i array<long>, h array<boolean>, n array<long>, words binary, stream binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.table([pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _blocks_of(most: int):
    """Texts to blocks of about `most` tokens."""
    from xxhash import xxh3_64_intdigest

    class Numbers(dict):
        def __missing__(self, word):
            self[word] = n = len(self)
            return n

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        numbers, streams, ids, held, lengths, size = Numbers(), [], [], [], [], 0

        def closed():
            nonlocal numbers, size, block
            names = np.fromiter(map(xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            stream = _packed((4,), np.concatenate(streams))
            cells = [[block], [list(ids)], [list(held)], [list(lengths)], [names.astype("<u8").tobytes()], [stream], [size], [len(names)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["block", "i", "h", "n", "names", "stream", "size", "distinct"]
            )
            for x in (streams, ids, held, lengths):
                x.clear()
            numbers, size, block = Numbers(), 0, block + 1
            return out

        end = END.encode()
        for b in batches:
            for t, i, h in zip(values(b.column(0)), values(b.column(1)), values(b.column(2)), strict=True):
                words = words_of(t)
                words.append(end)
                streams.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)).astype(np.uint32))
                ids.append(i)
                held.append(h)
                lengths.append(len(words))
                size += len(words)
                if size >= most:
                    yield closed()
        if ids:
            yield closed()

    return run


def _blocks(batches):
    for b in batches:
        for r in range(b.num_rows):
            yield Block(b.slice(r, 1).to_pylist()[0])


def _ask_words(shards: int):
    """A block's distinct words with their counts in its training texts, by shard."""

    def run(batches):
        for block in _blocks(batches):
            order = np.argsort(block.names)
            names = block.names[order]
            counts = np.bincount(block.stream[block.train], minlength=len(names))[order]
            _, cuts = _by_shard(_range(names, shards))
            rows = [(1, n, block.id, _packed(WORD, _steps(names[s:e]), counts[s:e])) for n, s, e in cuts]
            yield from _table(ASKS, rows).to_batches()

    return run


def _tell_words(table: pa.Table) -> pa.Table:
    """A word shard's places, common words first, and exact counts, for each block as it asked."""
    shard = table.column("shard")[0].as_py()
    parts = [_unpacked(x.as_py(), WORD) for x in table.column("body")]
    hashes = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _ in parts])
    found, rank = np.unique(hashes, return_inverse=True)
    seen = np.zeros(len(found), np.int64)
    np.add.at(seen, rank, np.concatenate([y for _, y in parts]).astype(np.int64))
    cls = _class(seen)
    place = np.empty(len(found), np.int64)
    place[np.argsort(-cls, kind="stable")] = np.arange(len(found))
    entries = np.bincount(cls, minlength=CLASSES).astype("<i8").tobytes()
    rows, at = [(-1, -1, shard, entries, int(seen.sum()), int((seen > 0).sum()))], 0
    for block, (x, _) in zip(table.column("block").to_pylist(), parts, strict=True):
        mine = rank[at : at + len(x)]
        rows.append((1, block, shard, _packed(PLACED, place[mine], seen[mine]), 0, 0))
        at += len(x)
    return _table(ANSWERS, rows)


def _number(numbering: Numbering):
    """A block with the numbers and counts of its words in place of their hashes."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        numbers, counts = [], []
        for shard, body in _of_level(answers, 1):  # the shards' ranges are in the order of the hashes
            place, seen = _unpacked(body, PLACED)
            numbers.append(numbering.number(shard, place, seen))
            counts.append(seen)
        order = np.argsort(np.frombuffer(blocks.column("names")[0].as_py(), "<u8"))
        number, count, asked = (np.empty(len(order), np.uint64) for _ in range(3))
        number[order], count[order], asked[order] = np.concatenate(numbers), np.concatenate(counts), np.arange(len(order))
        words = pa.array([_packed(NUMBERED_WORDS, number, count, asked)], pa.binary())
        return blocks.select(["block", "i", "h", "n"]).append_column("words", words).append_column("stream", blocks.column("stream"))

    return run


def _ask_grams(k: int, shards: int, bits: int):
    """A block's distinct n-grams of length k with their counts in its training texts, by shard."""

    def run(batches):
        for block in _blocks(batches):
            at, context, continued, pair = block.grams(k, bits)
            if not len(at):
                continue
            counts = np.bincount(pair[block.train[at]], minlength=len(context))
            by, cuts = _by_shard(_gram_shard(context, continued, k, shards))
            context, continued, counts = context[by], continued[by], counts[by]
            rows = [(k, n, block.id, _packed(GRAM, _steps(context[s:e]), continued[s:e], counts[s:e])) for n, s, e in cuts]
            yield from _table(ASKS, rows).to_batches()

    return run


def _tell_grams(k: int, bits: int, numbering: Numbering):
    """A shard's exact counts, for each block in the order in which it asked.

    Level 2 tells the count, longer ones the count, the context's count and its distinct
    followers.  Level 2 also gives the followers that it sees to the words' shards, as level 0.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        parts = [_unpacked(x.as_py(), GRAM) for x in table.column("body")]
        context = np.concatenate([np.cumsum(x, dtype=np.uint64) for x, _, _ in parts])
        continued, counts = np.concatenate([y for _, y, _ in parts]), np.concatenate([z for _, _, z in parts]).astype(np.int64)
        sizes = [len(x) for x, _, _ in parts]
        del parts
        x, _, pair = _grouped(context, continued, min(64, (k - 1) * bits), bits)
        del context, continued
        seen = np.zeros(len(x), np.int64)
        np.add.at(seen, pair, counts)
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        after = np.add.reduceat((seen > 0).astype(np.int64), first)
        rows, at = [], 0
        if k == 2:
            tell, widths = [seen], SEEN
            home, place = numbering.home(x[first].astype(np.int64))
            by, cuts = _by_shard(home)
            rows += [(0, -1, n, _packed(PLACED, place[by[s:e]], after[by[s:e]]), 0, 0) for n, s, e in cuts]
        else:
            run_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(x)))
            tell, widths = [seen, np.add.reduceat(seen, first)[run_of], after[run_of]], LONGER
        for block, size in zip(blocks, sizes, strict=True):
            mine = pair[at : at + size]
            rows.append((k, block, shard, _packed(widths, *(t[mine] for t in tell)), 0, 0))
            at += size
        return _table(ANSWERS, rows)

    return run


def _tell_followers(table: pa.Table) -> pa.Table:
    """A word shard's distinct followers, summed up and told to each block in the order of its words."""
    shard = table.column("shard")[0].as_py()
    blocks, bodies = table.column("block").to_pylist(), table.column("body")
    parts = [(b, *_unpacked(x.as_py(), PLACED)) for b, x in zip(blocks, bodies, strict=True)]
    after = np.zeros(int(max(r.max() for _, r, _ in parts)) + 1, np.int64)
    for block, place, n in parts:
        if block < 0:
            np.add.at(after, place.astype(np.int64), n.astype(np.int64))
    return _table(ANSWERS, [(0, b, shard, _packed(FOLLOWED, after[r.astype(np.int64)]), 0, 0) for b, r, _ in parts if b >= 0])


def _scored(order: int, tokens: int, words: int, shards: int, bits: int):
    """A block's texts, scored by the arcs and failure weights that the shards told it."""
    unit = float(tokens) + 0.1 * (words + 1)

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        block = Block(row)
        count, after = block.count[block.stream], np.zeros(len(block.stream), np.int64)
        if order > 1:
            told = np.concatenate([_unpacked(x, FOLLOWED)[0] for _, x in _of_level(answers, 0)]).astype(np.int64)
            after = told[block.asked.astype(np.int64)][block.stream]
        p = (count + 0.1) / unit
        known = np.add.reduceat((count > 0).astype(np.int64), block.starts)
        base = np.add.reduceat(np.log10(p), block.starts)
        for k in range(2, order + 1):
            at, context, continued, pair = block.grams(k, bits)
            if not len(at):
                break
            widths = SEEN if k == 2 else LONGER
            parts = [_unpacked(x, widths) for _, x in _of_level(answers, k)]
            by, _ = _by_shard(_gram_shard(context, continued, k, shards))
            told = []
            for x in zip(*parts, strict=True):
                back = np.empty(len(by), np.int64)
                back[by] = np.concatenate(x)
                told.append(back[pair])
            seen, whole, followers = (told[0], count[at - 1], after[at - 1]) if k == 2 else told
            ok = whole > 0
            at, seen, whole, followers = at[ok], seen[ok], whole[ok], followers[ok]
            # the arc, or the failure arc's mass alone where there is none
            p[at] = np.maximum(seen - DISCOUNT, 0) / whole + DISCOUNT * followers / whole * p[at]
        score = np.add.reduceat(np.log10(p), block.starts)
        cells = [row["i"], row["h"], row["n"], known, base, score]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["i", "h", "n", "known", "base", "score"])

    return run


def lm_scores(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    folds: int = 10,
    block_tokens: int = 1_000_000,
    shard_tokens: int = 1_500_000,
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod `folds` is 0 are held out, the others train.  A text
    is its words and one end token; null and empty texts are the end token alone.  A null
    id counts as the empty text (held out).  Repeated rows train and are scored each.
    Without training rows every probability is that of one unseen token, 0.1/0.1 = 1.
    An empty table gives no rows; extra columns are ignored.  Every n-gram of the training
    rows counts, single ones too.  `block_tokens` and `shard_tokens` only steer the work.
    """
    spark = docs.sparkSession
    out_rows = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = docs.select(
        F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.col(id_col).cast("long").alias("i"), out_rows.alias("h")
    )
    # groups of a few blocks or shards a task, however many there are
    dealt = lambda x, by, n: x.repartition(max(partitions(spark), n // 4), by).groupBy(by)
    with scratch(spark) as keep:
        raw = written(rows.mapInArrow(releasing(_blocks_of(block_tokens)), RAW), "lm-texts")
        size, distinct, many = raw.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0)), F.count("*")).first()
        word_shards, shards = (max(partitions(spark), -(-n // shard_tokens)) for n in (distinct, size))
        asked = raw.mapInArrow(releasing(_ask_words(word_shards)), ASKS)
        single = keep(written(dealt(asked, "shard", word_shards).applyInArrow(_tell_words, ANSWERS), "lm-words"))
        # a row a word shard
        each = {r["shard"]: r for r in single.where("level = -1").select("shard", "body", "tokens", "words").collect()}
        entries = np.zeros((word_shards, CLASSES), np.int64)
        for n, r in each.items():
            entries[n] = np.frombuffer(r["body"], "<i8")
        tokens, words = (sum(r[c] for r in each.values()) for c in ("tokens", "words"))
        numbering = Numbering(entries)
        bits = max(1, numbering.distinct.bit_length())
        single = single.where("level = 1")
        numbered = dealt(raw, "block", many).cogroup(dealt(single, "block", many)).applyInArrow(_number(numbering), BLOCKS)
        blocks = keep(written(numbered, "lm-blocks"))
        discard(raw)
        answers, followers = blocks.limit(0).selectExpr("0 AS level", "block", "block AS shard", "words AS body"), None
        for k in range(2, order + 1):
            asked = dealt(blocks.mapInArrow(releasing(_ask_grams(k, shards, bits)), ASKS), "shard", shards)
            told = keep(written(asked.applyInArrow(_tell_grams(k, bits, numbering), ANSWERS), "lm-grams"))
            if k == 2:
                followers = dealt(single.unionAll(told.where("level = 0")), "shard", word_shards).applyInArrow(_tell_followers, ANSWERS)
                answers = answers.unionAll(followers.select("level", "block", "shard", "body"))
            answers = answers.unionAll(told.where("level > 0").select("level", "block", "shard", "body"))
    scored = dealt(blocks, "block", many).cogroup(dealt(answers, "block", many)).applyInArrow(
        _scored(order, tokens, words, shards, bits), "i long, h boolean, n long, known long, base double, score double"
    )
    return scored.select(
        F.col("i").alias(id_col),
        F.col("h").alias("held_out"),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
