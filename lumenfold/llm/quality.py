"""Quality by importance resampling.

Two hashed n-gram generative models are fitted: one of the target (texts labelled
good), one of the raw corpus (all documents).  A document's log weight is the log ratio
of the two models over its n-grams; Gumbel noise turns the top k of (log weight +
noise) into a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import releasing, values, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Hash buckets of the three models: triples of word shapes, word pairs and words.  They are few, so that
#: a few dozen labelled texts fill them.
SHAPES, PAIRS, WORDS = 4096, 1024, 1024
BUCKETS = SHAPES + PAIRS + WORDS
#: Pseudo-counts of the raw model in each target model: what has not been labelled is taken as raw.
PRIORS = (20 * 512, 20 * PAIRS, 20 * WORDS)
MOST_HELD = 150_000
REPEAT, EDGE = 3, 4


def _hash(x: int) -> int:
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 32)


def _shape(token: str) -> int:
    """Case pattern of a word, or its punctuation as it stands."""
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 5
        if token.isupper() and len(token) > 1:
            return 6
        return 7 if token[0].isupper() else 8
    return 16 + _hash(int.from_bytes(token[:8].encode(), "little")) % 1009


class _Tokens(dict):
    """token -> hash << 16 | shape"""

    def __missing__(self, token: str) -> int:
        if len(self) > MOST_HELD:
            self.clear()
        low = token.lower().encode()
        h = 0
        for i in range(0, len(low), 8):
            h = _hash(h ^ int.from_bytes(low[i : i + 8], "little"))
        found = self[token] = (h >> 17) << 16 | _shape(token)
        return found


def features(text: str, tokens: _Tokens) -> np.ndarray:
    """Buckets of a text's n-grams: words, word pairs and shape triples."""
    found = TOKEN.findall(text)
    if not found:
        return np.zeros(0, np.int64)
    both = np.fromiter(map(tokens.__getitem__, found), np.int64, len(found))
    word, shape = both >> 16, both & 0xFFFF
    seen = np.zeros(len(word), np.int64)
    for d in (1, 2, 3):
        seen[d:] |= word[d:] == word[:-d]
    shape = np.where(seen & (shape < 16), REPEAT, shape)
    s = np.r_[EDGE, EDGE, shape]
    triple = (s[2:] * 1_000_003 + s[1:-1] * 10_007 + s[:-2] * 101) % SHAPES
    pair = (word[1:] * 31 + word[:-1] * 1_000_033) % PAIRS + SHAPES
    return np.concatenate([triple, pair, word % WORDS + SHAPES + PAIRS])


def _counted(batches):
    """Local bucket counts of each group (column 1): a row per group and bucket block."""
    held: dict[int, np.ndarray] = {}
    tokens = _Tokens()
    for b in batches:
        for text, group in zip(values(b.column(0)), values(b.column(1)), strict=True):
            if group not in held:
                held[group] = np.zeros(BUCKETS, np.int64)
            held[group] += np.bincount(features(text, tokens), minlength=BUCKETS)
    for group, counts in held.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), group, np.int64)), pa.array(at), pa.array(counts[at])], names=["g", "bucket", "c"]
        )


def _totals(rows: DataFrame) -> dict[int, np.ndarray]:
    """Bucket counts by group; the result has at most BUCKETS rows a group."""
    out: dict[int, np.ndarray] = {}
    local = rows.mapInArrow(releasing(_counted), "g long, bucket long, c long")
    for r in written(local.groupBy("g", "bucket").agg(F.sum("c").alias("c")), "quality-counts").toLocalIterator():
        out.setdefault(r["g"], np.zeros(BUCKETS))[r["bucket"]] = r["c"]
    return out


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    labelled_rows: int = 20_000,
    smoothing: float = 0.5,
) -> np.ndarray:
    """log(target model / raw model) by bucket.

    The target model is fitted on at most `labelled_rows` labelled rows (in the order of a
    hash of the id, so that every size takes an even sample), the raw model on all rows.
    Without target rows the log ratio is 0 everywhere.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_l")).where(F.col("_l").isNotNull()).distinct()
    good = good.orderBy(F.xxhash64("_l"), "_l").limit(labelled_rows)
    rows = docs.select(F.col(id_col).alias("_i"), text.alias("_t"))
    target = rows.join(F.broadcast(good), F.col("_i") == F.col("_l"), "left_semi")  # `labelled_rows` ids at most
    positive = _totals(target.select("_t", F.lit(1).cast("long"))).get(1, np.zeros(BUCKETS))
    raw = _totals(rows.select("_t", F.lit(0).cast("long"))).get(0, np.zeros(BUCKETS))
    if not positive.sum():
        return np.zeros(BUCKETS)
    out = np.zeros(BUCKETS)
    # each order is a model of its own
    for low, size, mass in zip((0, SHAPES, SHAPES + PAIRS), (SHAPES, PAIRS, WORDS), PRIORS, strict=True):
        part = slice(low, low + size)
        p, q = positive[part], raw[part]
        prior = (q + smoothing) / (q.sum() + smoothing * size)
        out[part] = np.log((p + mass * prior) / (p.sum() + mass)) - np.log(prior)
    return out


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash: the same for an id on every run and partitioning."""
    u = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _weighed(rows: DataFrame, ratio: np.ndarray, text_at: int, carry: int, features_told: int) -> DataFrame:
    """The first `carry` columns of `rows`, _n and _weight: feature count and tempered log importance weight of the whole text."""
    held = rows.sparkSession.sparkContext.broadcast(ratio)
    names = rows.columns[:carry]

    def run(batches):
        tokens, table = _Tokens(), held.value
        for b in batches:
            sizes, weights = [], []
            for t in values(b.column(text_at)):
                x = features(t or "", tokens)
                sizes.append(len(x))
                weights.append(float(table[x].sum()) * min(1.0, features_told / max(len(x), 1)))
            columns = [*b.columns[:carry], pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_n", "_weight"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:carry])
    return rows.mapInArrow(releasing(run), f"{schema}, _n long, _weight double")


def _decided(docs, labels, carry, id_col, text_col, seed, margin, features_told, k, ratio):
    """c0, c1, ... (the columns `carry` of `docs`), _n, _weight, _key, _kept: one pass over the texts, written."""
    if ratio is None:
        ratio = fit(docs, labels, id_col, text_col)
    plain = lambda c: F.col("`" + c.replace("`", "``") + "`")
    columns = [plain(c).alias(f"c{i}") for i, c in enumerate(carry)]
    at = carry.index(text_col) if text_col in carry else len(carry) + 1
    name = F.coalesce(plain(id_col).cast("string"), F.lit(""))
    rows = docs.select(*columns, name.alias("_id"), *([] if at < len(carry) else [plain(text_col).alias("_t")]))
    rows = _weighed(rows, ratio, at, len(carry) + 1, features_told)
    rows = written(rows.withColumn("_key", F.col("_weight") + gumbel(F.col("_id"), seed)).drop("_id"), "quality-rows")
    if k is None:
        k = round(rows.agg(F.coalesce(F.sum(F.exp(F.least(F.lit(0.0), F.col("_weight") + F.lit(margin)))), F.lit(0.0))).first()[0])
    least = kth_largest(rows.select("_key"), k)
    return rows.withColumn("_kept", F.col("_key") >= F.lit(least))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 17,
    margin: float = 4.0,
    features_told: int = 64,
    k: int | None = None,
    ratio: np.ndarray | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns `carry` of `docs` (all) and _n, _weight, _key (weight + noise), _kept.

    The weight is the log ratio of the two models over a text's features, tempered: a text
    of more than `features_told` features has the weight of so many of its average ones, as
    neighbouring n-grams are no independent evidence; so the noise decides near the border
    for texts of any length.  The k rows of the largest keys are kept.  Unless it is given, k
    is the number of rows that rejection sampling by the weights would keep in expectation,
    sum(min(1, exp(weight + margin))): `margin` nats against a text still keep it.  The k-th
    key is found as a threshold from histograms of the keys, each inside one cell of the
    last, so no sort of all rows meets in one task; rows that tie with it are kept.  A text
    without features has weight 0.  Null texts are empty; null ids share one noise value;
    repeated rows are decided each; an empty table keeps nothing.  Columns of `docs` may
    have any names; those of the four names above stand beside the new ones.
    """
    carry = docs.columns if carry is None else carry
    out = _decided(docs, labels, carry, id_col, text_col, seed, margin, features_told, k, ratio)
    return out.toDF(*carry, "_n", "_weight", "_key", "_kept")


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that resampling keeps, with the columns of `docs`, which may have any names.

    Nulls, ties, repeated rows and empty tables are as in `resample`; without a good label
    every weight is 0 and all rows stay.
    """
    out = _decided(docs, labels, docs.columns, id_col, text_col, 17, 4.0, 64, None, None)
    return out.where("_kept").select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def kth_largest(keys: DataFrame, k: int, cells: int = 4096) -> float:
    """The k-th largest value of a column of doubles: +inf for k = 0, -inf for k >= rows."""
    name = keys.columns[0]
    low, high, total = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if k <= 0 or not total:
        return math.inf
    if k >= total:
        return -math.inf
    above = 0
    while low < high:
        width = (high - low) / cells
        if width == 0 or low + width == low:
            break
        cell = F.least(F.floor((F.col(name) - F.lit(low)) / F.lit(width)), F.lit(cells - 1))
        found = keys.where(F.col(name).between(low, high)).groupBy(cell.alias("cell"))
        rows = found.agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).collect()
        for r in sorted(rows, key=lambda r: -r["cell"]):
            if above + r["n"] >= k:
                if r["n"] == 1 or r["a"] == r["b"]:
                    return r["a"]
                if above + r["n"] == k:
                    return r["a"]
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low


