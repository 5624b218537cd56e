"""Mixing sources to target weights by systematic sampling.

Sources are weighed in code point order (null last) by a repeating pattern. Together they get a share of
all words; no source gets more than a multiple of its own size, and what that limit cuts off goes to the
others by weight. Within a source every document expects ``target / size of the source`` copies. Documents
are ordered by size class and id digest, expected copies are summed up along that order, one random offset
is added, and a document is taken once per whole number its interval crosses.

The running sum never runs through a whole source in one task. Documents fall into cells (source, size
class, three hex digits of the id's digest); a count per cell is summed over cells (their number does not
grow with the documents), and rows are numbered within their cell only.

Nulls: a null text has size 0 and takes 0 words; a null source is a source of its own; a null id is ordered
like an id. Repeated rows are documents of their own. Ties in the order are between rows that are equal
in every returned column but the text. An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_TIMES = 2


def offset(seed: int) -> float:
    return random.Random(seed).random()


def word_count(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_share=TOTAL_SHARE, most_times=MOST_TIMES) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source, null included.

    A source stops at its limit where the level (words per unit of weight) passes limit / weight. With the
    sources in that order, the stopped ones are a prefix, and the level is the rest of the words over the
    rest of the weights at the first source that does not stop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    ahead = Window.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    pattern = F.array(*[F.lit(w) for w in weights])
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("nth", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(pattern, ((F.col("nth") - 1) % len(weights) + 1).cast("int")))
        .withColumn("limit", F.col("source_size") * most_times)
        .withColumn("full_at", F.col("limit") / F.col("weight").cast("double"))
        .withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(total_share)))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("used", F.coalesce(F.sum("limit").over(ahead), F.lit(0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
        .withColumn("words_left", F.col("all_words") - F.col("used"))
        .withColumn("weights_left", F.col("all_weights") - F.col("gone"))
        .withColumn("open", F.col("words_left") / F.col("weights_left") <= F.col("full_at"))
        .withColumn("level_words", F.max(F.when(F.col("open"), F.col("words_left"))).over(everything))
        .withColumn("level_weights", F.max(F.when(F.col("open"), F.col("weights_left"))).over(everything))
    )
    by_weight = F.col("weight") * F.col("level_words") / F.col("level_weights")
    target = F.least(F.col("limit").cast("double"), F.coalesce(by_weight, F.col("limit").cast("double")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, seed: int = 7, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most_times: int = MOST_TIMES,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, and the columns in ``keep``."""
    keep = keep or []
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = (
        docs.select("doc_id", F.col("source").cast("string"), "text", *[c for c in keep if c not in ("doc_id", "source", "text")])
        .withColumn("size", word_count("text"))
        .withColumn("size_class", F.floor(F.log2(F.col("size") + F.lit(1.0)) * 4).cast("int"))
        .withColumn("part", F.substring(digest, 1, 3))
    )
    rows = rows if "text" in keep else rows.drop("text")
    # One key without nulls for window and join, so that rows are dealt once.
    named = F.concat(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), F.lit("|"), "size_class", F.lit("|"), "part")
    rows = rows.withColumn("cell", named)
    counts = rows.groupBy("cell", "source", "size_class", "part").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source").orderBy("size_class", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "source", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    targets = source_targets(rows.select("source", "size"), weights, total_share, most_times)
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        "cell", "before", "source_size", "target"
    )
    # Rows with the same id and size are told apart by what is kept of them.
    inside = Window.partitionBy("cell").orderBy("size", "doc_id", *([F.xxhash64(*keep)] if keep else []))
    numbered = rows.withColumn("nth", F.row_number().over(inside))
    placed = numbered.join(starts, "cell")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before") + F.col("nth")
    u = F.lit(offset(seed))
    copies = F.floor(rate * rank + u) - F.floor(rate * (rank - 1) + u)
    names = list(dict.fromkeys(["doc_id", "source", *keep]))
    return placed.select(*names, "size", "source_size", "target", copies.cast("long").alias("copies"))
