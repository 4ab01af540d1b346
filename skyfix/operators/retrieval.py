"""Exact top-k inner-product search over descriptor tables, with rotation variants."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from skyfix.functions.ids import ROTATIONS, add_rotation
from skyfix.functions.vectors import checked, distance, norm

from .select import top_k
from .tile_index import TileIndex, build_index, search_index

#: Rows of a block of tiles and of queries that meet in generated code, rows that a block of tiles is not cut below to keep all tasks
#: busy, tasks for each that Spark shuffles to, and numbers of a product that are one method.
TILE_BLOCK, QUERY_BLOCK, LEAST_BLOCK, CELL_TASKS, RUN = 32_768, 4_096, 256, 4, 16
#: Bits of a number of a rounded vector, their levels, and what the rounding of sums may add to a length.
BITS, LEVELS, SLACK = 6, 64, 1e-9
#: Bytes of centroids that are sent to all tasks.
CENTROID_BYTES = 16 << 20


def expand_rotations(tiles: DataFrame, tile: str = "tile_id", degrees: tuple[int, ...] = ROTATIONS) -> DataFrame:
    """One row for each tile and rotation, with rotation and variant_id."""
    return tiles.withColumn("rotation", F.explode(F.array(*(F.lit(d) for d in degrees)))).withColumn(
        "variant_id", add_rotation(F.col(tile).cast("string"), F.col("rotation")),
    )


def _blocks(rows: int, size: int, least: int = 1) -> int:
    return max(least, -(-rows // size))


def in_blocks(left: DataFrame, right: DataFrame, blocks: int, key: Column) -> DataFrame:
    """Each row of left with each row of right, by an equi-join: right is dealt to blocks by the hash of `key`, and a row of left
    visits every block. Nothing is broadcast, whatever the sizes."""
    dealt = right.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, "_block").drop("_block")


def _whole(a: Column, dim: int) -> Column:
    """A vector in its own type without nulls: NaN where there is no number. Another length fails the query."""
    nan = F.lit(float("nan")).cast("float")
    return F.coalesce(F.transform(checked(a, dim), lambda x: F.coalesce(x, nan)), F.array(nan))


def _sum(terms: list[Column]) -> Column:
    """A sum by halves, whose additions need not wait for each other."""
    half = len(terms) // 2
    return _sum(terms[:half]) + _sum(terms[half:]) if half else terms[0]


def _sliced(rows: DataFrame, v: str, dim: int) -> DataFrame:
    """Rows with vector v rounded to LEVELS steps between its smallest and largest number: v_lo, v_step, the bits of its steps' numbers
    as one long for each bit and 64 numbers (v_<bit>_<word>), sums of the numbers and of the rounded vector, the length of both
    vectors and, with what rounding of sums may add, of their difference. A vector that has not only finite numbers differs by inf or NaN."""
    at = lambda name: F.col(f"{v}_{name}")
    finite = F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x.cast("double")))
    rows = rows.withColumn(f"{v}_finite", finite).withColumn(f"{v}_lo", F.array_min(at("finite")))
    rows = rows.withColumn(f"{v}_step", (F.array_max(at("finite")) - at("lo")) / (LEVELS - 1))
    nth = lambda x: F.when(at("step") > 0, (x - at("lo")) / at("step") + 0.5).otherwise(0.0)
    codes = F.transform(at("finite"), lambda x: F.least(F.greatest(nth(x), F.lit(0.0)), F.lit(LEVELS - 1.0)).cast("int"))
    rows = rows.withColumn(f"{v}_codes", codes).withColumn(f"{v}_near", F.transform(f"{v}_codes", lambda c: at("lo") + at("step") * c))
    rows = rows.withColumns({f"{v}_norm": norm(F.col(v)), f"{v}_size": norm(at("near"))})

    def word(b, w):
        bits = F.transform(F.slice(at("codes"), 64 * w + 1, 64), lambda c, i: F.call_function("shiftleft", F.shiftright(c, b).bitwiseAND(1).cast("long"), i))
        return F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x)), F.lit(0).cast("long"))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    more = {f"{v}_{b}_{w}": word(b, w) for b in range(BITS) for w in range(-(-dim // 64))}
    more |= {f"{v}_codesum": total(at("codes")), f"{v}_nearsum": total(at("near"))}
    more[f"{v}_err"] = distance(F.col(v), at("near")) + SLACK * (at("norm") + at("size"))
    return rows.withColumns(more).drop(*(f"{v}_{c}" for c in ("finite", "codes", "near")))


def _at_most(q: str, t: str, dim: int) -> Column:
    """A number that the product of two sliced vectors does not exceed: that of the rounded ones and what was rounded away; NaN, the
    largest number to Spark, where this cannot be told."""
    at = lambda v, name: F.coalesce(F.col(f"{v}_{name}"), F.lit(float("nan")))
    words = range(-(-dim // 64))
    both = lambda i, j, w: F.bit_count(F.col(f"{q}_{i}_{w}").bitwiseAND(F.col(f"{t}_{j}_{w}"))).cast("double")
    codes = _sum([_sum([both(i, j, w) for w in words]) * float(1 << i + j) for i in range(BITS) for j in range(BITS)])
    near = at(t, "lo") * at(q, "nearsum") + at(t, "step") * (at(q, "lo") * at(t, "codesum") + at(q, "step") * codes)
    return near + at(q, "norm") * at(t, "err") + at(q, "err") * at(t, "size")


def similarities(queries: DataFrame, descriptors: DataFrame, dim: int, n: int, floor: str | None = None) -> DataFrame:
    """All (columns of queries, tile_id, similarity), but for pairs whose similarity lies below the query's `floor`, if that is given:
    most of these are told by a bound made of a few counts of bits, and are not multiplied. n: how many queries there are.

    Each block of queries meets each block of tiles, as one cell, and cells are dealt to all tasks, however few files the tables
    have. The JVM compiles short methods only: a product is made of runs of numbers, each of which an explode of one value keeps
    apart, and keeps from being written into every filter that follows.
    """
    tasks = CELL_TASKS * int(descriptors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q_blocks, m = _blocks(n, QUERY_BLOCK), descriptors.count()
    t_blocks = _blocks(m, TILE_BLOCK, min(_blocks(16 * tasks, q_blocks), _blocks(m, LEAST_BLOCK)))
    others, one = [c for c in queries.columns if c != "descriptor"], F.lit(t_blocks)
    q = queries.select(*others, _whole(F.col("descriptor"), dim).alias("_q"), (F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)) * one).alias("_at"))
    t = descriptors.where("descriptor is not null").select("tile_id", _whole(F.col("descriptor"), dim).alias("_t"), F.pmod(F.xxhash64("tile_id"), one).alias("_at"))
    if floor is not None:
        # Tiles are dealt first, as slicing takes some 0.3 ms a vector and a table of one file would come in one task.
        q, t = _sliced(q, "_q", dim), _sliced(t.repartition(tasks, "tile_id"), "_t", dim)
    q = q.withColumn("_cell", F.explode(F.sequence(F.col("_at"), F.col("_at") + one - 1))).drop("_at").repartition(tasks, "_cell")
    t = t.withColumn("_cell", F.explode(F.sequence(F.col("_at"), F.col("_at") + one * (q_blocks - 1), one))).drop("_at").repartition(tasks, "_cell")
    met = t.hint("merge").join(q, "_cell")
    met = met if floor is None else met.where(_at_most("_q", "_t", dim) >= F.col(floor))
    met = met.select(*others, "tile_id", "_q", "_t", F.lit(0.0).alias("similarity"))
    for low in range(0, dim, RUN):
        run = _sum([F.col("_q")[i].cast("double") * F.col("_t")[i].cast("double") for i in range(low, min(dim, low + RUN))])
        met = met.select(*others, "tile_id", "_q", "_t", F.explode(F.array(F.col("similarity") + run)).alias("similarity"))
    return met.drop("_q", "_t")


def _floors(queries: DataFrame, descriptors: DataFrame, dim: int, n: int, k: int, exclude: bool) -> DataFrame:
    """(query_id, floor, floor_tile): the k-th of the best tiles among a share of them, about the square root of k times their number.
    No tile behind it is among the k best of all. A query that meets fewer has no row."""
    share = max(1, isqrt(descriptors.count() // max(k, 1)))
    met = similarities(queries, descriptors.where(F.pmod(F.xxhash64("tile_id"), F.lit(share)) == 0), dim, n)
    met = met.where("not isnan(similarity)")
    met = met.where("tile_id <> own_tile or own_tile is null") if exclude else met
    best = top_k(met.groupBy("query_id", "tile_id").agg(F.max("similarity").alias("floor")), ["query_id"], [F.col("floor").desc(), F.col("tile_id")], k)
    return best.where(F.col("rank") == k).select("query_id", "floor", F.col("tile_id").alias("floor_tile"))


def _kept(queries: DataFrame, descriptors: DataFrame, dim: int, k: int, exclude: bool) -> DataFrame:
    """(query_id, tile_id, similarity) of the best variants of each query, all pairs met in generated code. A pair behind its query's
    floor goes where it is met; of the rest every task keeps a bounded heap a query and sends only that: k times the variants of a
    tile, so that k tiles are among them."""
    variants = descriptors.groupBy("tile_id").count().agg(F.max("count")).first()[0] or 1
    q = queries.select("query_id", *(["own_tile"] if exclude else []), "descriptor")
    n = q.count()
    known = q.join(_floors(q, descriptors, dim, n, k, exclude), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    # The first condition is all that most pairs are asked; ties with the floor go by tile, as ranks do.
    met = similarities(known, descriptors, dim, n, "floor").where("similarity >= floor").where("not isnan(similarity)")
    met = met.where("similarity > floor or floor_tile is null or tile_id <= floor_tile")
    met = met.where("tile_id <> own_tile or own_tile is null") if exclude else met
    best = InternalFunction.collect_top_k(F.struct((-F.col("similarity")).alias("far"), "tile_id"), k * variants, True)
    return met.groupBy("query_id").agg(best.alias("best")).select("query_id", F.explode("best").alias("b")).groupBy(
        "query_id", F.col("b.tile_id").alias("tile_id"),
    ).agg(F.max(-F.col("b.far")).alias("similarity"))


def search_tiles(
    queries: DataFrame, descriptors: DataFrame | TileIndex, dim: int, k: int, method: str = "gemm", exclude_own: bool = False,
) -> DataFrame:
    """(query_id, tile_id, similarity, rank): the k tiles of each query with the largest similarity over their rotation
    variants, best first, ties by tile. k is capped by the number of tiles; ids may be of any type that has an order.

    queries: query_id, descriptor (and own_tile with exclude_own, which is left out of the query's result). descriptors:
    tile_id, descriptor, one row for each variant; rows without tile_id are left out. `gemm` multiplies blocks of an index (see
    tile_index), built here or once before; `native` meets all pairs in generated code, for small dims.
    """
    if method == "native":
        rows = descriptors.where("tile_id is not null").select("tile_id", "descriptor")
        return top_k(_kept(queries, rows, dim, k, exclude_own), ["query_id"], [F.col("similarity").desc(), F.col("tile_id")], k)
    if isinstance(descriptors, TileIndex):
        return search_index(queries, descriptors, k, exclude_own)[0]
    index = build_index(descriptors, dim)
    hits, _ = search_index(queries, index, k, exclude_own)
    index.delete()
    return hits


def with_tiles(hits: DataFrame, tiles: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Hits with the metadata of their tiles."""
    return hits.join(tiles, tile)


def nearest_centroid(rows: DataFrame, centroids: DataFrame, key: str) -> DataFrame:
    """(key, cluster_id, centroid_distance): the nearest centroid (L2), the smallest id on ties. Centroids of CENTROID_BYTES are
    broadcast; rows visit more of them block by block."""
    centroids = centroids.select("cluster_id", F.col("descriptor").alias("centroid"))
    size = centroids.agg(F.coalesce(F.sum(F.size("centroid") * 8), F.lit(0))).first()[0]
    few = size <= CENTROID_BYTES
    met = rows.crossJoin(F.broadcast(centroids)) if few else in_blocks(rows, centroids, _blocks(size, CENTROID_BYTES), F.col("cluster_id"))
    far = met.withColumn("d", distance(F.col("descriptor"), F.col("centroid")))
    return far.groupBy(key).agg(
        F.min_by("cluster_id", F.struct("d", "cluster_id")).alias("cluster_id"), F.min("d").alias("centroid_distance"),
    )
