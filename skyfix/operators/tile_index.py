"""A standing index of descriptors for exact top-k search: blocks of bounded bytes around pivots, each with its centre and radius.

A block is one row: ids, vectors, the mean of its vectors and the largest distance from that. An inner product with any vector of
the block is at most that with the mean plus the query's length times the radius, so a block whose bound lies below the k-th score
that a query has already is not visited. Vectors keep their element type; products are computed in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfix.functions.vectors import checked
from skyfix.sources.shared import arrow_batches, cut, delete

from .select import sample, top_k

#: Bytes of the vectors of a block of tiles, of one of queries, and of pivots that are sent to all tasks.
BLOCK_BYTES, QUERY_BYTES, PIVOT_BYTES = 16 << 20, 4 << 20, 8 << 20
#: Rows of a block at most, doubles that a task turns vectors and scores into at a time, and blocks from which bounds are worked out.
BLOCK_ROWS, STEP_DOUBLES, PRUNE_FROM = 32_768, 1 << 20, 17
#: A bound must lie below a score by so much of the vectors' lengths, for what rounding may add.
SLACK = 1e-9


@dataclass(frozen=True)
class TileIndex:
    """blocks: d_block, tiles (array of ids), vectors, center (binaries), radius, element, most; a written table. tile: Spark's type of
    the ids. most: the largest k that may be asked for, if the index was built for one."""

    blocks: DataFrame
    dim: int
    tile: str
    element: str
    count: int
    most: int | None = None

    def save(self, path: str) -> TileIndex:
        """The index at another place, for later sessions and streams."""
        self.blocks.write.mode("overwrite").parquet(path)
        return load_index(self.blocks.sparkSession, path, self.dim)

    def delete(self) -> None:
        """Remove the written table, when nothing is to be searched any more."""
        delete(self.blocks)


def load_index(spark: SparkSession, path: str, dim: int) -> TileIndex:
    blocks = spark.read.parquet(path)
    kinds = {f.name: f.dataType for f in blocks.schema}
    first = blocks.select("element", "most" if "most" in kinds else F.lit(None).cast("int").alias("most")).first()
    return TileIndex(blocks, dim, kinds["tiles"].elementType.simpleString(), first[0] if first else "float", blocks.count(), first[1] if first else None)


def _element(df: DataFrame, column: str) -> str:
    kind = df.schema[column].dataType.elementType.simpleString()
    return "float" if kind == "float" else "double"


def _dtype(element: str) -> type:
    return np.float32 if element == "float" else np.float64


def _matrix(column: pa.Array | pa.ChunkedArray, dtype: type, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=dtype).reshape(-1, dim)


def _nearest(pivots: np.ndarray):
    """A function of a vector to the number of the pivot that is nearest to it."""
    half = (pivots * pivots).sum(1) / 2

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            m, out = _matrix(array, np.float64, pivots.shape[1]), []
            step = max(1, STEP_DOUBLES // max(pivots.shape))
            for a in range(0, len(m), step):
                out.append(np.argmax(m[a : a + step] @ pivots.T - half, axis=1))
            yield pa.array(np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32))

    return F.arrow_udf(run, "int")


def _first_tiles(rows: DataFrame, most: int) -> DataFrame:
    """Rows (tile_id, v) but for tiles that no search for `most` tiles can find by that vector: of equal vectors, which all have the
    same score, the first `most` tiles come before the others, and one more may be the query's own. Spark limits groups before
    they are moved."""
    order = W.partitionBy(F.xxhash64("v"), "v").orderBy("tile_id")
    return rows.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= most + 1).drop("nth")


def build_index(descriptors: DataFrame, dim: int, block_bytes: int | None = None, seed: int = 0, most: int | None = None) -> TileIndex:
    """An index of descriptors: tile_id (of any type that has an order), descriptor (array of dim floats or doubles), a row for
    each variant of a tile.

    Rows go to the nearest of some pivots, descriptors drawn by a seeded order, and those of a pivot to as many blocks as its
    bytes need. Rows without a tile_id are left out; a descriptor of another length fails the job; no rows make no blocks. With
    `most`, an index for searches of that many tiles at most, many tiles of one vector take no more room than these searches need.
    """
    element, tile = _element(descriptors, "descriptor"), descriptors.schema["tile_id"].dataType.simpleString()
    width = dim * np.dtype(_dtype(element)).itemsize
    rows = descriptors.where("tile_id is not null").select("tile_id", checked(F.col("descriptor"), dim).cast(f"array<{element}>").alias("v"))
    first = cut(_first_tiles(rows, most), "first-tiles") if most is not None else None
    rows = rows if first is None else first
    n, tasks = rows.count(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    room = max(1, min(BLOCK_ROWS, (block_bytes or BLOCK_BYTES) // width))
    wanted, near = -(-n // room), None
    if wanted < PRUNE_FROM:
        # Too few to leave any out: only a share for each task.
        block = F.pmod(F.xxhash64("tile_id", "v"), F.lit(max(1, wanted, min(tasks, PRUNE_FROM - 1))))
        dealt = rows.withColumn("d_block", block)
    else:
        pivots = min(wanted, max(1, PIVOT_BYTES // (8 * dim)))
        drawn = sample(rows.select("v", F.xxhash64("v").alias("h")), "h", pivots, seed).select("v").toArrow()  # PIVOT_BYTES at most
        near = cut(rows.withColumn("pivot", _nearest(_matrix(drawn.column("v"), np.float64, dim))("v")), "near-pivots")
        parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / room).cast("int").alias("parts"))
        # Rows of a pivot are dealt out in turn: near is written, so a task that runs again numbers its rows alike.
        turn = near.withColumn("turn", F.monotonically_increasing_id()).join(F.broadcast(parts), "pivot")
        dealt = turn.select("tile_id", "v", F.xxhash64("pivot", F.pmod("turn", "parts")).alias("d_block"))
    kind = _dtype(element)

    def pack(key, table):
        order = pc.sort_indices(table.column("tile_id"))
        vectors = _matrix(table.column("v"), kind, dim)[np.asarray(order)]
        center = vectors.mean(0, dtype=np.float64)
        step = max(1, STEP_DOUBLES // dim)
        radius = max(float(np.sqrt(np.square(vectors[a : a + step] - center).sum(1).max())) for a in range(0, len(vectors), step))
        ids = table.column("tile_id").take(order).combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        return pa.table(
            [pa.array([key[0].as_py()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vectors.tobytes()]), pa.array([center.tobytes()]), pa.array([radius]), pa.array([element]), pa.array([most], pa.int32())],
            names=["d_block", "tiles", "vectors", "center", "radius", "element", "most"],
        )

    shape = f"d_block bigint, tiles array<{tile}>, vectors binary, center binary, radius double, element string, most int"
    blocks = cut(dealt.groupBy("d_block").applyInArrow(pack, shape), "tile-index")
    if near is not None:
        delete(near)
    if first is not None:
        delete(first)
    return TileIndex(blocks, dim, tile, element, blocks.count(), most)


def _best(matrix: np.ndarray, own: np.ndarray | None, code: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, codes), the k best tiles of each query in a block whose vectors come in order of their tiles' codes; ties go to the
    smaller code."""
    best_s, best_t = np.full((len(matrix), 0), -np.inf), np.zeros((len(matrix), 0), np.int64)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    bounds = np.append(first, len(code))
    step = max(1, STEP_DOUBLES // max(vectors.shape[1], len(matrix)))
    low = 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + step, "right")) - 1)
        part = vectors[bounds[low] : bounds[high]].astype(np.float64)
        score = np.maximum.reduceat(matrix @ part.T, first[low:high] - bounds[low], axis=1)
        tiles = np.broadcast_to(code[first[low:high]], score.shape)
        if own is not None:
            score = np.where(own[:, None] == tiles, -np.inf, score)
        # All tiles differ and come in order, so a stable sort by score breaks ties by tile.
        score, tiles = np.hstack((best_s, score)), np.hstack((best_t, tiles))
        at = np.argsort(-score, axis=1, kind="stable")[:, :k]
        best_s, best_t = np.take_along_axis(score, at, 1), np.take_along_axis(tiles, at, 1)
        low = high
    return best_s, best_t


_VISIT = ["q_block", "queries", "own", "floor", "q_vectors", "tiles", "vectors"]


def _visited(met: DataFrame, dim: int, element: str, query: str, tile: str, k: int, exclude: bool) -> DataFrame:
    """(q_block, floor, found) of blocks of queries that met blocks of tiles: found lists (query_id, tile_id, similarity), k at most
    of each query and none below its floor; floor is then the k-th score of each query."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in _VISIT}
                matrix = np.frombuffer(row["q_vectors"].as_buffer(), np.float64).reshape(-1, dim)
                floor = np.frombuffer(row["floor"].as_buffer(), np.float64)
                vectors = np.frombuffer(row["vectors"].as_buffer(), _dtype(element)).reshape(-1, dim)
                coded = row["tiles"].values.dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                own = None
                if exclude:
                    own = pc.fill_null(pc.index_in(row["own"].values.cast(coded.dictionary.type), coded.dictionary), -1).to_numpy()
                score, tiles = _best(matrix, own, code, vectors, k)
                at, place = np.nonzero((score > -np.inf) & (score >= floor[:, None]))
                ids = pa.StructArray.from_arrays(
                    [row["queries"].values.take(pa.array(at)), coded.dictionary.take(pa.array(tiles[at, place])), pa.array(score[at, place])],
                    ["query_id", "tile_id", "similarity"],
                )
                kth = score[:, k - 1] if score.shape[1] >= k else np.full(len(matrix), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("q_block").slice(i, 1), pa.array([np.maximum(kth, floor).tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)],
                    ["q_block", "floor", "found"],
                )

    found = f"array<struct<query_id: {query}, tile_id: {tile}, similarity: double>>"
    return met.select(_VISIT).mapInArrow(run, f"q_block bigint, floor binary, found {found}")


def _packed_queries(queries: DataFrame, index: TileIndex, exclude: bool, pivots: np.ndarray | None) -> DataFrame:
    """(q_block, queries, own, floor, q_vectors): queries near the same pivot share blocks of at most QUERY_BYTES."""
    own = F.col("own_tile") if exclude else F.lit(None)
    rows = queries.select("query_id", own.cast(index.tile).alias("own"), checked(F.col("descriptor"), index.dim).cast("array<double>").alias("v"))
    n, most = rows.count(), max(1, QUERY_BYTES // (8 * index.dim))
    near = rows.withColumn("pivot", _nearest(pivots)("v") if pivots is not None else F.lit(0))
    if pivots is None:
        near = near.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // most)))))
    else:
        parts = near.groupBy("pivot").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
        near = near.join(F.broadcast(parts), "pivot").withColumn("q_block", F.xxhash64("pivot", F.pmod(F.xxhash64("query_id", "v"), "parts")))
    query, dim = queries.schema["query_id"].dataType.simpleString(), index.dim

    def pack(key, table):
        one = lambda c: pa.concat_arrays(table.column(c).chunks)
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), one(c)) for c in ("query_id", "own")]
        vectors = _matrix(table.column("v"), np.float64, dim)
        floor = np.full(table.num_rows, -np.inf)
        return pa.table([pa.array([key[0].as_py()]), *lists, pa.array([floor.tobytes()]), pa.array([vectors.tobytes()])], names=["q_block", "queries", "own", "floor", "q_vectors"])

    shape = f"q_block bigint, queries array<{query}>, own array<{index.tile}>, floor binary, q_vectors binary"
    return cut(near.select("q_block", "query_id", "own", "v").groupBy("q_block").applyInArrow(pack, shape), "query-blocks")


def _by_shuffle(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An equi-join that broadcasts neither side. Spark takes a table for as large as its compressed files, and its copies in many
    cells for no more than that, so what it takes for small may be more than the driver holds."""
    return left.hint("merge").join(right, key)


def _home(queries: DataFrame, index: TileIndex) -> DataFrame:
    """(q_block, d_block, bound) of the block of tiles with the largest bound in each pack of centres, of PIVOT_BYTES, for each block
    of queries."""
    dim = index.dim
    packs = max(1, -(-index.count * 8 * dim // PIVOT_BYTES))
    centers = index.blocks.select("d_block", "center", "radius").withColumn("pack", F.pmod("d_block", F.lit(packs)).cast("int"))
    centers = centers.groupBy("pack").agg(F.collect_list(F.struct("d_block", "center", "radius")).alias("centers"))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = _in_packs(queries, "q_block", "q_vectors", QUERY_BYTES, tasks, "q", ["q_block", "floor", "q_vectors"])
    met = _by_shuffle(grouped.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1)))), centers, "pack").repartition(tasks, "q")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries, packed = batch.column("q_blocks")[i].values, batch.column("centers")[i].values
                matrix, _, ends = _split(queries, dim)
                center, far = _spheres(packed, dim)
                ats, bests = [], []
                for j in range(len(queries)):
                    # The sum of bounds over a block's queries, from the sums of vectors and of lengths.
                    part = matrix[ends[j] : ends[j + 1]]
                    total = part.sum(0) @ center.T + np.sqrt(np.square(part).sum(1)).sum() * far
                    ats.append(int(np.argmax(total)))
                    bests.append(float(total[ats[-1]]))
                yield pa.RecordBatch.from_arrays([queries.field("q_block"), packed.field("d_block").take(pa.array(ats)), pa.array(bests)], ["q_block", "d_block", "bound"])

    return met.select("q_blocks", "centers").mapInArrow(run, "q_block bigint, d_block bigint, bound double")


def _spheres(packed: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres of blocks and their radii, with what rounding may add."""
    center = np.frombuffer(b"".join(packed.field("center").to_pylist()), np.float64).reshape(-1, dim)
    return center, packed.field("radius").to_numpy() + SLACK * (1 + np.sqrt(np.square(center).sum(1)))


def _reached(matrix: np.ndarray, floor: np.ndarray, center: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which blocks of tiles have a bound that reaches some query's floor."""
    out, step = np.zeros(len(far), bool), max(1, STEP_DOUBLES // len(far))
    for a in range(0, len(matrix), step):
        part = matrix[a : a + step]
        bound = part @ center.T + np.sqrt(np.square(part).sum(1))[:, None] * far
        out |= np.any(bound >= floor[a : a + step, None], axis=0)
    return out


def _split(packed: pa.StructArray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, floors, first row of each block and the end) of a pack of blocks of queries."""
    floors = packed.field("floor").to_pylist()
    ends = np.cumsum([0] + [len(x) // 8 for x in floors])
    return np.frombuffer(b"".join(packed.field("q_vectors").to_pylist()), np.float64).reshape(-1, dim), np.frombuffer(b"".join(floors), np.float64), ends


def _in_packs(blocks: DataFrame, block: str, size: str, most: int, tasks: int, name: str, columns: list[str]) -> DataFrame:
    """(name, <name>_blocks): blocks put together in packs of some `most` bytes, more packs if there are fewer than tasks. A block of
    more than half of that is a pack by itself."""
    n, total = blocks.agg(F.count("*"), F.coalesce(F.sum(F.length(size)), F.lit(0))).first()
    packs = max(-(-total * 2 // most), min(n, tasks), 1)
    alone = F.length(size) * 2 > most
    pack = F.when(alone, F.concat(F.lit("b"), F.col(block))).otherwise(F.pmod(F.xxhash64(block), F.lit(packs)).cast("string"))
    return blocks.groupBy(pack.alias(name)).agg(F.collect_list(F.struct(*columns)).alias(f"{name}_blocks"))


_QUERY, _SPHERE = ["q_block", "d_block", "queries", "own", "floor", "q_vectors"], ["d_block", "center", "radius"]


def _pack_pairs(queries: DataFrame, tiles: DataFrame, dim: int) -> DataFrame:
    """(q, t, n): packs of queries and of tiles in which n blocks of tiles besides the first ones reach some query's floor, so there
    is a row for each two packs at most, however small the blocks are. They meet in a grid of cells, one for each task: a pack of
    queries is copied to the cells of its row, the spheres of one of tiles to those of its column."""
    spheres = tiles.select("t", F.transform("t_blocks", lambda b: F.struct(*(b[c].alias(c) for c in _SPHERE))).alias("t_blocks"))
    told = queries.select("q", F.transform("q_blocks", lambda b: F.struct(*(b[c].alias(c) for c in ("d_block", "floor", "q_vectors")))).alias("q_blocks"))
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, min(isqrt(tasks), queries.count()))
    across = -(-tasks // down)
    row, column = F.pmod(F.xxhash64("q"), F.lit(down)).cast("int"), F.pmod(F.xxhash64("t"), F.lit(across)).cast("int")
    told = told.withColumn("cell", F.explode(F.sequence(row * across, row * across + (across - 1))))
    spheres = spheres.withColumn("cell", F.explode(F.sequence(column, column + across * (down - 1), F.lit(across))))
    met = _by_shuffle(told, spheres, "cell")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                packed, blocks = batch.column("q_blocks")[i].values, batch.column("t_blocks")[i].values
                matrix, floor, ends = _split(packed, dim)
                center, far = _spheres(blocks, dim)
                homes, ids, n = packed.field("d_block").to_numpy(), blocks.field("d_block").to_numpy(), 0
                for j, home in enumerate(homes):
                    rows = slice(ends[j], ends[j + 1])
                    n += int((_reached(matrix[rows], floor[rows], center, far) & (ids != home)).sum())
                if n:
                    yield pa.RecordBatch.from_arrays([batch.column("q").slice(i, 1), batch.column("t").slice(i, 1), pa.array([n])], ["q", "t", "n"])

    return met.select("q", "t", "q_blocks", "t_blocks").mapInArrow(run, "q string, t string, n bigint")


def _visited_packs(met: DataFrame, dim: int, element: str, query: str, tile: str, k: int, exclude: bool) -> DataFrame:
    """(found) of packs of queries that met packs of tiles, as in _visited: k tiles at most of each query in a pack, from the blocks
    that its own block of queries reaches. Blocks of queries that reach the same ones are searched together."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                packed, blocks = batch.column("q_blocks")[i].values, batch.column("t_blocks")[i].values
                matrix, floor, ends = _split(packed, dim)
                center, far = _spheres(blocks, dim)
                queries, ids = packed.field("queries").flatten(), blocks.field("tiles").flatten()
                order = np.asarray(pc.sort_indices(ids))
                coded = ids.take(pa.array(order)).dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                vectors = np.frombuffer(b"".join(blocks.field("vectors").to_pylist()), _dtype(element)).reshape(-1, dim)[order]
                block = np.repeat(np.arange(len(far)), pc.list_value_length(blocks.field("tiles")).to_numpy())[order]
                own = None
                if exclude:
                    own = pc.fill_null(pc.index_in(packed.field("own").flatten().cast(coded.dictionary.type), coded.dictionary), -1).to_numpy()
                alike: dict[bytes, list[int]] = {}
                for j, home in enumerate(packed.field("d_block").to_pylist()):
                    rows = slice(ends[j], ends[j + 1])
                    reached = _reached(matrix[rows], floor[rows], center, far)
                    if len(far) == 1 and blocks.field("d_block")[0].as_py() == home:
                        continue  # visited before; in a pack it is looked at again, so that more blocks of queries are alike
                    if reached.any():
                        alike.setdefault(reached.tobytes(), []).append(j)
                for mask, members in alike.items():
                    reached = np.frombuffer(mask, bool)
                    rows = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in members])
                    some = slice(None) if reached.all() else np.flatnonzero(reached[block])
                    score, tiles = _best(matrix[rows], None if own is None else own[rows], code[some], vectors[some], k)
                    at, place = np.nonzero((score > -np.inf) & (score >= floor[rows][:, None]))
                    found = pa.StructArray.from_arrays(
                        [queries.take(pa.array(rows[at])), coded.dictionary.take(pa.array(tiles[at, place])), pa.array(score[at, place])],
                        ["query_id", "tile_id", "similarity"],
                    )
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), found)], ["found"])

    return met.select("q_blocks", "t_blocks").mapInArrow(run, f"found array<struct<query_id: {query}, tile_id: {tile}, similarity: double>>")


@dataclass(frozen=True)
class Visits:
    """What a search did: blocks of queries and of tiles, pairs of them that were visited, and the share of pairs skipped."""

    query_blocks: int
    tile_blocks: int
    visited: int

    @property
    def skipped_share(self) -> float:
        pairs = self.query_blocks * self.tile_blocks
        return 1 - self.visited / pairs if pairs else 0.0


def search_index(queries: DataFrame, index: TileIndex, k: int, exclude_own: bool = False) -> tuple[DataFrame, Visits]:
    """(query_id, tile_id, similarity, rank) of the k best tiles of each query, ties by tile, and what it took to find them.

    queries: query_id (of any type), descriptor (and own_tile with exclude_own, which the query then does not find). Each block of
    queries first visits the block of tiles with the largest bound, then those whose bound reaches the k-th score found there;
    with few blocks it visits all. Blocks meet by equi-joins, small ones in packs: neither side passes the driver or is held whole.
    """
    if index.most is not None and k > index.most:
        raise ValueError(f"the index was built for {index.most} tiles at most, not {k}")
    prune, pivots, spark = index.count >= PRUNE_FROM, None, queries.sparkSession
    if prune:
        centers = index.blocks.select("center").limit(max(1, PIVOT_BYTES // (8 * index.dim))).toArrow()  # only deals queries to blocks
        pivots = np.frombuffer(b"".join(centers.column("center").to_pylist()), np.float64).reshape(-1, index.dim)
    query = queries.schema["query_id"].dataType.simpleString()
    visit = lambda met: _visited(met, index.dim, index.element, query, index.tile, k, exclude_own)
    tiles = index.blocks.select("d_block", "tiles", "vectors")
    with arrow_batches(spark, 2 * BLOCK_BYTES):
        own = [_packed_queries(queries, index, exclude_own, pivots)]
        packed, n = own[0], own[0].count()
        if not prune:
            pairs = packed.select("q_block").crossJoin(F.broadcast(index.blocks.select("d_block")))  # fewer than PRUNE_FROM blocks
            found, visited = visit(packed.join(pairs, "q_block").join(tiles, "d_block")), n * index.count
        else:
            home = cut(_home(packed, index).groupBy("q_block").agg(F.max_by("d_block", "bound").alias("d_block")), "home-blocks")
            first = cut(visit(_by_shuffle(packed.join(home, "q_block"), tiles, "d_block")), "home-found")
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            known = packed.drop("floor").join(first.select("q_block", "floor"), "q_block").join(home, "q_block")
            q_packs = cut(_in_packs(known, "q_block", "q_vectors", QUERY_BYTES, 1, "q", _QUERY), "query-packs")
            t_packs = cut(_in_packs(index.blocks, "d_block", "vectors", BLOCK_BYTES, tasks, "t", [*_SPHERE, "tiles", "vectors"]), "tile-packs")
            pairs = cut(_pack_pairs(q_packs, t_packs, index.dim), "pack-pairs")
            # Dealt by hand: a pair of packs is few bytes and much work.
            met = _by_shuffle(pairs.join(q_packs, "q").repartition(tasks, "t"), t_packs.repartition(tasks, "t"), "t").select("q_blocks", "t_blocks")
            rest = _visited_packs(met, index.dim, index.element, query, index.tile, k, exclude_own)
            found, visited = first.select("found").unionByName(rest), n + (pairs.agg(F.sum("n")).first()[0] or 0)
            own += [home, first, q_packs, t_packs, pairs]
        hits = found.select(F.inline("found")).groupBy("query_id", "tile_id").agg(F.max("similarity").alias("similarity"))
        hits = cut(top_k(hits, ["query_id"], [F.col("similarity").desc(), F.col("tile_id")], k), "hits")
    for table in own:
        delete(table)
    return hits, Visits(n, index.count, visited)
