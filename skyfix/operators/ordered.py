"""Order statistics and running values of groups of any size, without a task that holds a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfix.sources.shared import cut

#: Values that one aggregate holds at most; rows that a range aims at; rows up to which a table of groups is broadcast.
FEW, RANGE_ROWS, SMALL_GROUPS = 100_000, 1_000_000, 10_000
#: Splitters of a band in a pass, the accuracy of the sketch that finds them (its state is of that order), and passes at most.
GRID, ACCURACY, PASSES = 500, 10_000, 60


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> tuple[DataFrame, Column]:
    """right with its keys renamed, and the condition that keys are equal, null being a key like any other."""
    named = right.withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)})
    return named, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)), F.lit(True))


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """left with the columns of right, one row a group; null is a key like any other. Few groups are broadcast. right is read twice."""
    named, same = _same(left, right, by)
    if not by:
        return left.join(named, how=how) if how != "inner" else left.crossJoin(F.broadcast(named))
    named = F.broadcast(named) if right.limit(SMALL_GROUPS + 1).count() <= SMALL_GROUPS else named
    return left.join(named, same, how).drop(*[f"_by_{i}" for i in range(len(by))])


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None, name: str = "quantiles") -> DataFrame:
    """(by..., quantiles): of each group with a value the exact quantiles, as an array in order of probs, between ranks by linear
    interpolation. Nulls and NaN do not count; null is a group like any other.

    Groups of FEW values are aggregated whole. For the others a sketch of bounded size proposes a band of values for each
    quantile, the rows below, at its lower end and inside are counted, and the band narrows until few rows lie between its ends:
    the counts make it exact, whatever the sketch gives. df should be cheap to read twice: it is written here, but for its values and groups only.
    """
    by = by or []
    rows = cut(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*by, F.col(value).cast("double").alias("_v")), "values")
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sizes = cut(sizes.where("_n > 0"), "group-sizes")
    large = sizes.where(F.col("_n") > FEW)
    whole = F.percentile("_v", [float(p) for p in probs]).alias(name)
    if large.isEmpty():
        return rows.groupBy(*by).agg(whole).where(F.col(name).isNotNull())
    small = join_groups(rows, large.select(*by), by, "left_anti") if by else rows.where(F.lit(False))
    out = small.groupBy(*by).agg(whole).where(F.col(name).isNotNull())
    target = F.posexplode(F.array(*(F.lit(float(p)) for p in probs)))
    bands = large.select(*by, "_n", "_lo", "_hi", target.alias("_i", "_p")).withColumn("_at", F.col("_p") * (F.col("_n") - 1))
    bands = bands.select(
        *by, "_i", (F.col("_at") - F.floor("_at")).alias("_part"), F.floor("_at").alias("_first"), F.ceil("_at").alias("_last"), "_lo", "_hi",
        F.col("_lo").alias("_try_lo"), F.col("_hi").alias("_try_hi"), F.col("_n").alias("_between"), F.lit(0).cast("bigint").alias("_ties"),
        F.lit(1).alias("_spare"),
    )
    done: list[DataFrame] = []
    for _ in range(PASSES):
        bands = cut(bands, "bands")
        ready = (F.col("_lo") == F.col("_hi")) | (F.col("_between") <= FEW)
        done.append(bands.where(ready))
        bands = bands.where(~ready)
        if bands.isEmpty():
            break
        bands = _narrowed(rows, bands, by)
    else:
        raise RuntimeError(f"quantiles of {value} did not settle in {PASSES} passes")
    return out.unionByName(_read_off(rows, reduce(DataFrame.unionByName, done), by, name))


def _narrowed(rows: DataFrame, bands: DataFrame, by: list[str]) -> DataFrame:
    """Bands after a pass. A band is [_lo, _hi], with the ranks of its targets, _first and _last, from its first row, _ties rows of
    its lower end and _between ones between its ends. [_try_lo, _try_hi], inside it, becomes the band if its rows have both ranks,
    and splitters of what lies between its ends propose the next one."""
    v, measured = F.col("_v"), []
    for low, high, mark in (("_try_lo", "_try_hi", "t"), ("_lo", "_hi", "o")):
        between = (v > F.col(low)) & (v < F.col(high))
        measured += [
            F.count_if(v < F.col(low)).alias(f"_below_{mark}"), F.count_if(v == F.col(low)).alias(f"_ties_{mark}"), F.count_if(between).alias(f"_m_{mark}"),
            F.count_if(v.between(F.col(low), F.col(high))).alias(f"_all_{mark}"),
            F.percentile_approx(F.when(between, v), [i / GRID for i in range(GRID + 1)], ACCURACY).alias(f"_cuts_{mark}"),
        ]
    told = join_groups(rows, bands, by).where(v.between(F.col("_lo"), F.col("_hi"))).groupBy(*by, "_i").agg(*measured)
    both = join_groups(bands.drop("_ties"), told, [*by, "_i"])
    good = (F.col("_below_t") <= F.col("_first")) & (F.col("_last") < F.col("_below_t") + F.col("_all_t"))
    of = lambda name: F.when(good, F.col(f"_{name}_t")).otherwise(F.col(f"_{name}_o"))
    now = both.select(
        *by, "_i", "_part", *((F.col(c) - of("below")).alias(c) for c in ("_first", "_last")), F.when(good, F.col("_try_lo")).otherwise(F.col("_lo")).alias("_lo"),
        F.when(good, F.col("_try_hi")).otherwise(F.col("_hi")).alias("_hi"), of("ties").alias("_ties"), of("m").alias("_between"), of("cuts").alias("_cuts"),
        F.when(good, 1).otherwise(F.col("_spare") * 2).alias("_spare"),
    )
    first, last, m = F.col("_first") - F.col("_ties"), F.col("_last") - F.col("_ties"), F.col("_between")
    # Some splitters more on either side than the ranks need, twice as many after a miss, which the counts show.
    low = F.floor(first * GRID / m).cast("int") - F.col("_spare")
    high = F.ceil((last + 1) * GRID / m).cast("int") + F.col("_spare")
    at = lambda i: F.element_at("_cuts", F.least(F.greatest(i, F.lit(0)), F.lit(GRID)) + 1)
    try_lo = F.when(first >= m, F.col("_hi")).when((first < 0) | (low <= 0), F.col("_lo")).otherwise(at(low))
    try_hi = F.when(last < 0, F.col("_lo")).when((last >= m) | (high >= GRID), F.col("_hi")).otherwise(at(high))
    settled = (last < 0) | (first >= m)
    return now.select(
        *by, "_i", "_part", F.when(settled, 0).otherwise(F.col("_first")).alias("_first"), F.when(settled, 0).otherwise(F.col("_last")).alias("_last"),
        F.when(settled, try_lo).otherwise(F.col("_lo")).alias("_lo"), F.when(settled, try_hi).otherwise(F.col("_hi")).alias("_hi"),
        try_lo.alias("_try_lo"), try_hi.alias("_try_hi"), "_between", "_ties", "_spare",
    )


def _read_off(rows: DataFrame, bands: DataFrame, by: list[str], name: str) -> DataFrame:
    """The quantiles of narrow bands: of one value, or with FEW rows at most between their ends."""
    bands = cut(bands, "bands")
    wide = F.col("_lo") < F.col("_hi")
    met = join_groups(rows, bands.where(wide), by).where((F.col("_v") > F.col("_lo")) & (F.col("_v") < F.col("_hi")))
    held = met.groupBy(*by, "_i").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    held = join_groups(bands, held, [*by, "_i"], "left")

    def at(rank: str) -> Column:
        i = (F.col(rank) - F.col("_ties")).cast("int")
        return F.when((i < 0) | ~wide, F.col("_lo")).otherwise(F.coalesce(F.get("_vs", i), F.col("_hi")))

    found = held.select(*by, F.struct("_i", (at("_first") + (at("_last") - at("_first")) * F.col("_part")).alias("_q")).alias("_x"))
    return found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_q"]).alias(name))


def in_ranges(df: DataFrame, by: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """df with _range, dealt by group and order to ranges of about `rows` rows, whatever the groups' sizes; a written table. Rows
    that tie in group and order are in one range."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (rows or RANGE_ROWS)))
    return cut(df.repartitionByRange(n, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _edges(ranged: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """(by..., _range, _before, _carried): for each group and range the group's rows in earlier ranges, and the values of the last
    of them. As many rows as ranges and groups, not as df."""
    last = F.max_by(F.struct(*values), F.struct(*order)) if values else F.lit(None).cast("int")
    edges = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_rows"), last.alias("_last"))
    w = W.partitionBy(*by).orderBy("_range")
    before = F.coalesce(F.sum("_rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut(edges.select(*by, "_range", before.alias("_before"), F.lag("_last").over(w).alias("_carried")), "range-edges")


def with_previous(df: DataFrame, by: list[str], order: list[str], values: list[str], rows: int | None = None) -> DataFrame:
    """df with prev_<value> of the row before in its group's order (null at the first), and place, the row's number (from 1) in it.

    Rows are sorted in ranges; what crosses a border, a row and a number for each group and range, is carried to the next one. A
    group that has all rows is so spread over all tasks. Rows that tie in order come in any order.
    """
    ranged = in_ranges(df, by, order, rows)
    edges = _edges(ranged, by, order, values)
    w = W.partitionBy(*by, "_range").orderBy(*order)
    inside = ranged.select("*", F.row_number().over(w).alias("_at"), *(F.lag(F.struct(v)).over(w).alias(f"_lag_{v}") for v in values))
    met = join_groups(inside, edges, [*by, "_range"])
    own = [F.when(F.col("_at") > 1, F.col(f"_lag_{v}")[v]).otherwise(F.col("_carried")[v]).alias(f"prev_{v}") for v in values]
    return met.select(*df.columns, *own, (F.col("_before") + F.col("_at")).alias("place"))
