"""Deduplication, seeded sampling, ranks, set operations and work lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfix.sources.shared import cut

from .ordered import join_groups, with_previous


def seeded(key: Column, seed: int) -> Column:
    """A fixed order that looks random: the md5 of seed and key. It does not depend on partitions."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")).cast("binary"))


#: Rows that share a bucket of a seeded order, about, and the most hex digits that tell buckets apart.
BUCKET_ROWS, BUCKET_DIGITS = 50_000, 4


def seeded_places(df: DataFrame, key: str, seed: int, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row in the seeded order of key, in all or in each group. key is unique.

    The first digits of the order deal rows to buckets; places count within a bucket and start where the buckets before it
    end. So no task sorts more than a bucket, and what is summed up in order is one number a bucket (65,536 at most a group).
    """
    by, digits, n = by or [], 0, df.count()
    while digits < BUCKET_DIGITS and n > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = df.withColumn("_o", seeded(F.col(key), seed)).withColumn("_b", F.substring("_o", 1, digits) if digits else F.lit(""))
    sizes = rows.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    starts = sizes.select(*by, "_b", before.alias("_start"))
    inside = F.row_number().over(W.partitionBy(*by, "_b").orderBy("_o", key)) - 1
    return rows.withColumn("_at", inside).join(starts, [*by, "_b"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_o", "_b", "_at", "_start")


def ranked(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in that order."""
    return ranked(df, by, order, "_at").where("_at = 1").drop("_at")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).where(F.col(name) <= k)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in order."""
    return first_of(df, keys, [F.col(c).desc() for c in order])


def first_valid(df: DataFrame, keys: list[str], valid: Column, order: list[str]) -> DataFrame:
    """One row for each key: the first valid one. Rows that are not valid do not use up the key."""
    return first_of(df.where(valid), keys, [F.col(c) for c in order])


def sample_each(df: DataFrame, group: str, key: str, cap: int, seed: int) -> DataFrame:
    """At most cap rows of each group, chosen by the seeded order."""
    return top_k(df, [group], [seeded(F.col(key), seed), F.col(key)], cap, "_at").drop("_at")


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in seeded order."""
    return df.orderBy(seeded(F.col(key), seed), key).limit(n)


def first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_success(df: DataFrame, key: str, success: Column, attempts: int, seed: int) -> DataFrame:
    """The first success among so many rows in seeded order; no row if there is none."""
    tried = sample(df, key, attempts, seed)
    return tried.where(success).orderBy(seeded(F.col(key), seed), key).limit(1)


def merged(sources: list[DataFrame], keys: list[str], order: str) -> DataFrame:
    """Union of sources; on the same key the last source wins, in it the last row."""
    every = reduce(DataFrame.unionByName, [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)])
    return last_wins(every, keys, ["_source", order]).drop("_source")


def pooled(sources: list[DataFrame]) -> DataFrame:
    """Union of sources with all their rows."""
    return reduce(DataFrame.unionByName, sources)


def merged_results(sources: list[DataFrame], key: str, fields: str) -> DataFrame:
    """(key, fields): the result maps of several files merged key by key; a name in several maps has the value of the last.
    Null where any file lacks the key."""
    every = reduce(
        DataFrame.unionByName, [s.select(key, F.col(fields).alias("_map"), F.lit(i).alias("_source")) for i, s in enumerate(sources)],
    )
    own = [F.first(F.when(F.col("_source") == i, F.col("_map")), True) for i in range(len(sources))]
    later = lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
    return every.groupBy(key).agg(*(m.alias(f"_{i}") for i, m in enumerate(own))).select(
        key, reduce(later, (F.col(f"_{i}") for i in range(len(own)))).alias(fields),
    )


def capped_counts(df: DataFrame, group: str, cap: int) -> DataFrame:
    """(group, total, chosen): rows, and those that a cap leaves."""
    return df.groupBy(group).agg(F.count("*").alias("total")).withColumn("chosen", F.least(F.col("total"), F.lit(cap).cast("long")))


def pending(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Work whose keys are not among what is done."""
    return work.join(done.select(*keys), list(keys), "left_anti")


def progress(log: DataFrame, time: str, total: int, by: str, tie: str | None = None) -> DataFrame:
    """A work log with done, rate (a second) and eta_s at each entry of each worker or run (`by`); `time` is in seconds, ties go
    by `tie`. Entries are ordered in ranges, so that one worker may have them all."""
    placed = with_previous(log, [by], [time, *([tie] if tie else [])], [])
    begun = cut(log.groupBy(by).agg(F.min(time).alias("_begun")), "work-begun")
    out = join_groups(placed, begun, [by]).withColumn("elapsed", F.col(time) - F.col("_begun"))
    out = out.select(*log.columns, F.col("place").alias("done"), "elapsed")
    some = F.col("elapsed") > 0
    left = F.greatest(F.lit(total) - F.col("done"), F.lit(0))
    return out.withColumn("rate", F.when(some, F.col("done") / F.col("elapsed"))).withColumn(
        "eta_s", F.when(some, left * F.col("elapsed") / F.col("done")),
    )
