"""Sources mixed to target shares of the total size in tokens, by hash-threshold histograms.

Each document has a uniform hash. Tokens are summed by source and hash bucket; the budget of a source is reached at a threshold between two
hashes, which is found by nesting: only the boundary bucket of each source is summed again, ten bits finer, until it is one hash. Documents
below the threshold are taken, so the selection is a filter: nothing is sorted, and no source is gathered in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lcspark.llm.tokens import count_tokens
from lcspark.session import materialise, small

BITS, LEVELS = 10, 4


def source_key(source: Column) -> Column:
    """Spellings of a source brought together: case, blanks around it, and blanks or ``_`` inside."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_]+", "_")


def sized(documents: DataFrame) -> DataFrame:
    """``(doc_id, key, h, n_tokens)``, written once, so that texts are tokenised once. Documents without an id are told apart by their texts."""
    h = F.shiftrightunsigned(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), 64 - BITS * LEVELS)
    return materialise(count_tokens(documents.select("doc_id", source_key(F.col("source")).alias("key"), h.alias("h"), "text"), "text", ["doc_id", "key", "h"]))


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets(source, target_share, max_repeats)`` with ``available`` tokens, ``total`` of all documents, ``wanted`` = share of the total, ``reachable`` = what repeats allow.

    Documents of null or other sources count in the total only; null and empty texts have no tokens; a document given twice counts twice.
    Without documents nothing is wanted. Null shares or repeats make a source neither reachable nor short.
    """
    sums = docs.groupBy("key", F.shiftright("h", BITS * (LEVELS - 1)).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
    per = sums.groupBy("key").agg(F.sum("n").alias("available"))
    t = targets.select("source", "target_share", "max_repeats").filter(F.col("source").isNotNull()).withColumn("key", source_key(F.col("source")))
    t = t.join(per, "key", "left").withColumn("total", F.coalesce(docs.agg(F.sum("n_tokens")).scalar(), F.lit(0)))
    t = t.withColumn("available", F.coalesce("available", F.lit(0)))
    return t.withColumn("wanted", F.col("target_share") * F.col("total")).withColumn("reachable", (F.col("max_repeats") * F.col("available")).cast("double"))


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """``budget`` with ``passes`` (times every document of the source is taken) and ``below`` (hashes below it are taken once more)."""
    take = F.least("wanted", "reachable")
    b = budget.withColumn("passes", F.when(F.col("available") > 0, F.floor(take / F.col("available"))).otherwise(0).cast("bigint"))
    b = b.withColumn("left", take - F.col("passes") * F.col("available")).withColumn("prefix", F.lit(0).cast("bigint"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = docs.join(small(b.select("key", "prefix")), "key").filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("key", F.shiftright("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
        hist = hist.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
        hist = hist.withColumn("before", F.coalesce("before", F.lit(0)))
        edge = hist.join(small(b.select("key", "left")), "key").filter((F.col("before") <= F.col("left")) & (F.col("before") + F.col("n") > F.col("left"))).groupBy("key").agg(F.min(F.struct("bucket", "before")).alias("e"))
        # no boundary bucket: all of the level's documents are taken, the threshold is the end of the prefix
        b = materialise(
            b.join(edge, "key", "left")
            .withColumn("prefix", F.coalesce("e.bucket", F.when(F.col("left") > 0, (F.col("prefix") + 1) * 2**BITS).otherwise(F.col("prefix") * 2**BITS)))
            .withColumn("left", F.col("left") - F.coalesce("e.before", F.lit(0)))
            .drop("e")
        )
    return b.withColumnRenamed("prefix", "below").drop("left")


def mix(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """``(doc_id, source, n_tokens, copies)``: the documents of the mix and how often each is taken."""
    t = small(limits.select("key", "source", "passes", "below"))
    copies = F.col("passes") + (F.col("h") < F.col("below")).cast("bigint")
    return docs.join(t, "key").select("doc_id", "source", "n_tokens", copies.alias("copies")).filter("copies > 0")


def report(limits: DataFrame, mixed: DataFrame) -> DataFrame:
    """Wanted and reached share of each source; ``reached_share`` is of the mix as it came out."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies"))
    r = limits.join(got, "source", "left").withColumn("all", got.agg(F.sum("taken")).scalar())
    taken = F.coalesce("taken", F.lit(0))
    return r.select("source", "target_share", "max_repeats", "available", taken.alias("taken"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce(F.try_divide(taken, "all"), F.lit(0.0)).alias("reached_share"), (F.col("reachable") < F.col("wanted")).alias("short"))
