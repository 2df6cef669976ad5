"""Generated signal records for the tests."""

from pyspark.sql import functions as F

from lumenfold.operators import signals


# The row formulas and planted gaps that the expected means belong to.
def fixture(spark):
    """660 generated records of three files: formula rows with two lists of NaN planted."""
    parts = []
    for k, d in enumerate(("commoncrawl", "wikipedia", "github")):
        i = F.col("id")
        parts.append(
            spark.range(200).select(
                F.lit(0).alias("code"), (F.lit(200 * k) + i).alias("line"), F.format_string(f"{d}-%04d", i).alias("name"),
                F.format_string(f"{d}/part-%d.txt", i % 4).alias("sub_path"), F.lit(d).alias("_source_domain"), F.lit(None).cast("string").alias("file_domain"),
                i.alias("i"), ((i == 11) & F.lit(d == "commoncrawl")).alias("planted"),
            )
        )
    for code, d, prefix, base in ((1, "arxiv", "arxiv", 1000), (2, "github", "github-ext", 2000)):
        r = F.col("id")
        parts.append(
            spark.range(30).select(
                F.lit(code).alias("code"), r.alias("line"), F.format_string(f"{prefix}-%04d", r).alias("name"),
                F.format_string(f"{d}/part-%d.txt", r % 3).alias("sub_path"), F.lit(None).cast("string").alias("_source_domain"), F.lit(d).alias("file_domain"),
                (r + base).alias("i"), ((r == 7) & F.lit(code == 2)).alias("planted"),
            )
        )
    x = parts[0]
    for p in parts[1:]:
        x = x.unionByName(p)
    i = F.col("i")
    seventeenth = (i % 17) / 17.0
    special = {
        "rps_doc_word_count": 120.0 + 37 * (i % 53), "rps_doc_num_sentences": 5.0 + (i % 41), "rps_doc_mean_word_length": 3.5 + (i % 23) / 3.0,
        "rps_doc_unigram_entropy": 3 + 4 * seventeenth,
    } | {c: -60000.0 + 5000 * (i % 25) for c in signals.RELEVANCE}
    cols = {c: special.get(c, seventeenth).cast("double") for c in [*signals.RULES, *signals.RELEVANCE]}
    cols["fineweb_edu"] = F.array(F.round(0.2 + 0.05 * (i % 60), 4))
    pair = lambda yes, a, b: F.when(yes, F.array(F.lit(a), F.lit(b))).otherwise
    cols["ad_en"] = pair(i % 7 == 0, 0.9, 0.1)(F.array(F.lit(0.05), F.lit(0.95)))
    cols["fluency_en"] = pair(i % 5 != 0, 0.1, 0.9)(F.array(F.lit(0.8), F.lit(0.2)))
    cols["qurater"] = F.array(*[F.round(0.5 * ((i + k) % 13) - 3, 4) for k in range(4)])
    for k, c in enumerate(signals.ORDINAL):
        cols[c] = F.array(*[F.round(0.2 * ((i + k + l) % 7), 4) for l in range(6)])
    nan = F.array(*[F.lit(float("nan"))] * 6)
    cols["modernbert_professionalism"] = F.when(F.col("planted"), nan).otherwise(cols["modernbert_professionalism"])
    return x.select("code", "line", F.col("name").alias("id"), "sub_path", "_source_domain", "file_domain", *[v.alias(k) for k, v in cols.items()])
