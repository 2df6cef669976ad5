"""Token counts and ids by public tokenizers, and the digest cache of counts.

A text is cut into the tokenizer's own pre-tokens and each distinct piece is
encoded once per process by the library itself; the pieces' ids are joined again.
This shortcut holds for an alphabet on which the pattern's classes are certain;
every other text, and every text with a special string, goes to the library whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, releasing, values, written

# Letters and numbers of the alphabet of the shortcut.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿŒœ"
NUMBERS = "0-9²³¹¼-¾"
SAFE = re.compile("[\t\n\r\x20-\x7e¡-¬®-ÿŒœ]*")
SPECIAL = re.compile(r"<\|(?:start|end)oftext\|>")
# The published pre-token patterns, with their classes written out.
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PIECES = re.compile(
    f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\\s{LETTERS}{NUMBERS}]+|\\s+(?!\\S)|\\s+"
)
WORD_PIECES = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
MOST_PIECES = 400_000


class Encoder:
    """Whole-text ids or counts of one tokenizer file; `kind` is byte or word."""

    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.kind = kind
        self.pieces = BYTE_PIECES if kind == "byte" else WORD_PIECES
        self.known: dict[str, object] = {}

    def _fresh(self, pieces: list[str], value) -> None:
        missing = list(set(pieces).difference(self.known))
        if len(self.known) + len(missing) > MOST_PIECES:
            self.known.clear()
            missing = list(set(pieces))
        if missing:
            for p, e in zip(missing, self.library.encode_batch_fast(missing, add_special_tokens=False), strict=True):
                self.known[p] = value(e.ids)

    def _cut(self, text: str) -> list[str] | None:
        if SAFE.fullmatch(text) and not SPECIAL.search(text):
            return self.pieces.findall(text if self.kind == "byte" else text.lower())
        return None

    def count(self, text: str) -> int:
        pieces = self._cut(text)
        if pieces is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        try:
            return sum(map(self.known.__getitem__, pieces))
        except KeyError:
            self._fresh(pieces, len)
            return sum(map(self.known.__getitem__, pieces))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        pieces = self._cut(text)
        if pieces is None:
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            self._fresh(pieces, lambda x: np.asarray(x, dtype="<u4").tobytes())
            return b"".join(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=8)
def encoder(path: str, kind: str, use: str) -> Encoder:
    """One per process; `use` keeps counts and ids apart."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, kind)


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: counts of another file are never reused."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class DigestCache:
    """A Parquet table (digest, n_tokens) partitioned by tokenizer version, that only grows.

    It lies at `path`, else where the session's spark.lumenfold.tokenCache says, so that
    later runs find it; else it lives for one call.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or spark.conf.get("spark.lumenfold.tokenCache", None) or new_path(spark, "token-cache")

    def _exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def counts(self, version: str) -> DataFrame | None:
        if not self._exists():
            return None
        held = self.spark.read.schema("digest binary, n_tokens long, version string").parquet(self.path)
        # two jobs may have added the same digest at once
        return held.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def add(self, counts: DataFrame, version: str) -> None:
        rows = counts.select("digest", "n_tokens", F.lit(version).alias("version"))
        rows.write.mode("append").partitionBy("version").parquet(self.path)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    kind: str = "byte",
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    cache: DigestCache | None = None,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are
    kept row by row; equal texts share one cached count; an empty table gives no rows;
    extra columns are ignored.  The counts of texts that a sample shows to be hot are
    broadcast, so that no task holds all rows of one.  Only texts whose digest the cache lacks are encoded, each once;
    their counts are appended before the result is joined, so a second run over the
    same texts encodes nothing.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    cache = cache or DigestCache(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    held = cache.counts(version)
    missing = rows.select("digest", "_text")
    if held is not None:
        missing = missing.join(held, "digest", "left_anti")
    missing = missing.dropDuplicates(["digest"])

    def encode(batches):
        one = encoder(tokenizer_path, kind, "count")
        for b in batches:
            counts = [one.count(t) for t in values(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    cache.add(missing.mapInArrow(releasing(encode), "digest binary, n_tokens long"), version)
    counts = cache.counts(version)
    slim = rows.select("_id", "digest", F.octet_length("_text").cast("long").alias("n_bytes"))
    n = partitions(spark)
    fraction = min(1.0, 64 * n / max(docs.count(), 1))
    # 64 samples a partition are drawn, so that at most 4 n texts have 16 of them
    hot = slim.sample(fraction, seed=11).groupBy("digest").agg(F.count("*").alias("c")).where("c >= 16").select("digest").collect()
    hot = spark.createDataFrame([(r["digest"],) for r in hot], "digest binary")
    few = written(counts.join(F.broadcast(hot), "digest"), "hot-counts").select("digest", F.col("n_tokens").alias("_hot"))
    slim = slim.join(F.broadcast(few), "digest", "left")
    # a hot row's count is there already: it goes anywhere
    at = F.when(F.col("_hot").isNull(), F.col("digest")).otherwise(F.encode(F.concat_ws(" ", "_id", F.hex("digest")), "utf-8"))
    out = slim.withColumn("_at", at).join(counts.withColumnRenamed("digest", "_at"), "_at", "left")
    tokens = F.coalesce("_hot", "n_tokens")
    return out.select(F.col("_id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
