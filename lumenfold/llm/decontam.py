"""Benchmark decontamination by a broadcast hash set of the test windows.

Every run of `width` consecutive words of a benchmark item is hashed; the windows
of each document are scanned against that set, hits are verified word by word, and
hit spans or whole documents can be removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az, whole_row, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _windows(length: int) -> Column:
    """Hashes of all windows of a length, each of the hashes of its words."""
    h, n = F.col("_hashes"), F.size("_hashes")
    one = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(length)])
    return F.when(n >= length, F.transform(F.sequence(F.lit(0), n - length), one)).otherwise(F.array().cast("array<bigint>"))


def _placed(rows: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """keep, _start (from 0), _len, _hash: the windows of all lengths, one array a row."""
    x = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))  # a word is hashed once, not in each window
    every = F.concat(*[_windows(w) for w in lengths]) if len(lengths) > 1 else _windows(lengths[0])
    x = x.select(*keep, F.size("_words").alias("_size"), F.posexplode(every).alias("_pos", "_hash"))
    start, length, before = F.col("_pos"), F.lit(lengths[0]), F.lit(0)
    for w, longer in zip(lengths, lengths[1:], strict=False):
        before = before + F.greatest(F.col("_size") - w + 1, F.lit(0))
        start = F.when(F.col("_pos") >= before, F.col("_pos") - before).otherwise(start)
        length = F.when(F.col("_pos") >= before, longer).otherwise(length)
    return x.select(*keep, start.cast("int").alias("_start"), length.cast("int").alias("_len"), "_hash")


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, list[int]]:
    """Distinct (_item, _len, _window, _hash), and the lengths: an item of fewer words than `width`, but not none, is one window."""
    items = benchmark.select(F.col(id_col).alias("_item"), words_of(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    # at most `width` rows
    lengths = sorted(r[0] for r in items.select(F.least(F.size("_words"), F.lit(width))).distinct().collect())
    out = None
    for w in lengths:
        own = items.where(F.size("_words") == w) if w < width else items.where(F.size("_words") >= w)
        x = _placed(own, [w], ["_item", "_words"])
        x = x.select("_item", "_len", F.slice("_words", F.col("_start") + 1, w).alias("_window"), "_hash").distinct()
        out = x if out is None else out.unionAll(x)
    if out is None:
        out = items.select("_item", F.lit(width).alias("_len"), F.col("_words").alias("_window"), F.lit(0).cast("long").alias("_hash"))
    return out, lengths or [width]


def contamination_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    broadcast_bytes: int = 256 << 20,
) -> DataFrame:
    """(_id, _key, _start, _len, _item): verified occurrences; _start counts words from 0.

    One scan of the texts gives the windows of all lengths.  The benchmark's windows are
    broadcast only while they have at most `broadcast_bytes` as rows; beyond that the same
    join is shuffled by the hash, without the texts, and its hits meet their text to be
    verified.
    """
    bench, lengths = benchmark_windows(benchmark, item_id, item_text, width)
    # a row takes its words, 16 bytes a word beside them, and 64 bytes
    size = F.coalesce(F.sum(F.octet_length(F.array_join("_window", "")) + 16 * F.col("_len") + 64), F.lit(0))
    small = bench.agg(size).first()[0] <= broadcast_bytes
    base = docs.select(
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(doc_text), F.lit(""))).alias("_key"),
        words_of(F.col(doc_text)).alias("_words"),
    )
    same = F.slice("_words", F.col("_start") + 1, F.col("_len")) == F.col("_window")
    out = ["_id", "_key", "_start", "_len", "_item"]
    side = bench.select("_hash", F.col("_len").alias("_blen"), "_window", "_item")
    fits = F.col("_len") == F.col("_blen")
    if small:
        scan = _placed(base, lengths, ["_id", "_key", "_words"])
        return scan.join(F.broadcast(side), "_hash").where(fits & same).select(*out)
    maybe = _placed(base, lengths, ["_id", "_key"]).join(side, "_hash").where(fits).select(*out, "_window").distinct()
    texts = base.select(F.col("_id").alias("_tid"), F.col("_key").alias("_tkey"), "_words").dropDuplicates(["_tid", "_tkey"])
    mine = F.col("_id").eqNullSafe(F.col("_tid")) & (F.col("_key") == F.col("_tkey"))
    return maybe.join(texts, mine).where(same).select(*out)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
) -> DataFrame:
    """Per document row: id, n_words, n_hit, n_items, items_sha256, contaminated, spans.

    spans: merged [start, end) word ranges that lie inside an occurring window.  Null
    or wordless texts have no words and no hits; null item ids hit words but are not
    counted as items.  Repeated rows get equal results.  Item ids that tie as strings count
    once.  An empty benchmark hits nothing, an empty table gives no rows.  Extra columns are
    ignored.
    """
    # the hits, not the texts, are read twice
    hits = written(contamination_hits(docs, benchmark, doc_id, doc_text, item_id, item_text, width), "hits")
    key = Window.partitionBy("_id", "_key").orderBy("_start", "_end")
    edges = hits.select("_id", "_key", "_start", (F.col("_start") + F.col("_len")).alias("_end")).distinct()
    before = F.max("_end").over(key.rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("_before", F.coalesce(before, F.lit(-1)))
    edges = edges.withColumn("_run", F.sum((F.col("_start") > F.col("_before")).cast("int")).over(key))
    runs = edges.groupBy("_id", "_key", "_run").agg(F.min("_start").alias("_s"), F.max("_end").alias("_e"))
    covered = runs.groupBy("_id", "_key").agg(
        F.sum(F.col("_e") - F.col("_s")).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end")))).alias("spans"),
    )
    items = hits.groupBy("_id", "_key").agg(F.array_sort(F.collect_set(F.col("_item").cast("string"))).alias("_items"))
    found = covered.join(
        items.withColumnsRenamed({"_id": "_id2", "_key": "_key2"}),
        F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_key") == F.col("_key2")),
    ).select(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey"), "n_hit", "spans", "_items")
    rows = docs.select(
        F.col(doc_id).alias("_id"),
        F.xxhash64(F.coalesce(F.col(doc_text), F.lit(""))).alias("_key"),
        F.size(words_of(F.col(doc_text))).cast("long").alias("n_words"),
    )
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_key") == F.col("_hkey")), "left")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("_id").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("_items", none)), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
    )


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, doc_id: str = "doc_id", doc_text: str = "text"
) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, with their columns, which may have any names.

    Null, empty and wordless texts and an empty benchmark hit nothing: their rows stay.  Repeated rows
    go or stay together, whatever their id; an empty table stays empty.
    """
    hits = contamination_hits(docs, benchmark, doc_id, doc_text, width=width)
    hits = hits.select(F.col("_id").alias("_hid"), F.col("_key").alias("_hkey")).distinct()
    rows = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(doc_text), F.lit(""))).alias("_key"), whole_row(docs).alias("_row")
    )
    same = F.col("_id").eqNullSafe(F.col("_hid")) & (F.col("_key") == F.col("_hkey"))
    return rows.join(hits, same, "left_anti").select("_row.*")
