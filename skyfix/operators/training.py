"""Tables for training retrieval models: clusters, batch plans and losses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyfix.functions.vectors import dot
from skyfix.sources.shared import cut, delete

from .retrieval import CENTROID_BYTES
from .select import sample, seeded_places

#: Of the multi-similarity loss: weights of positives and negatives, base similarity, mining margin.
ALPHA, BETA, BASE, MARGIN = 2.0, 50.0, 0.5, 0.1


def fit_clusters(rows: DataFrame, key: str, k: int = 50, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(cluster_id, descriptor): k centroids of descriptors by Lloyd's rounds from the first k rows in seeded order of key, fewer
    if there are fewer rows. A cluster that loses all its rows keeps its centroid.

    Tasks sum the rows of each cluster and send k sums; the centroids, CENTROID_BYTES at most, go to all tasks in the next round.
    The order alone decides the start, so any engine and partitioning gives the same up to rounding.
    """
    given = cut(rows.select(key, F.col("descriptor").cast("array<double>").alias("descriptor")), "cluster-rows")
    start = sample(given, key, k, seed).select("descriptor").toArrow().column(0)  # k rows
    centers = np.array(start.to_pylist(), np.float64)
    if centers.nbytes > CENTROID_BYTES:
        raise ValueError(f"{k} centroids are {centers.nbytes} bytes; {CENTROID_BYTES} at most can be sent to all tasks")
    for _ in range(rounds if len(centers) else 0):
        table = _added(_sums(given, centers)).toArrow()  # k rows
        centers = centers.copy()
        centers[np.asarray(table.column("cluster_id"))] = np.array(table.column("sums").to_pylist()) / np.asarray(table.column("n"))[:, None]
    delete(given)
    return rows.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster_id int, descriptor array<double>")


def _nearest_of(matrix: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first on ties."""
    half = (centers * centers).sum(1) / 2
    return np.argmax(matrix @ centers.T - half, axis=1)


def _sums(rows: DataFrame, centers: np.ndarray) -> DataFrame:
    """(cluster_id, n, sums) of the rows of each task that are nearest to each centre."""

    def run(batches):
        n, total = np.zeros(len(centers), np.int64), np.zeros_like(centers)
        for batch in batches:
            matrix = np.asarray(batch.column("descriptor").flatten(), np.float64).reshape(-1, centers.shape[1])
            near = _nearest_of(matrix, centers)
            n += np.bincount(near, minlength=len(centers))
            np.add.at(total, near, matrix)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.float64()))], ["cluster_id", "n", "sums"])

    return rows.select("descriptor").mapInArrow(run, "cluster_id int, n bigint, sums array<double>")


def _added(parts: DataFrame) -> DataFrame:
    """(cluster_id, n, sums) of all tasks, summed number by number and put together again: no task holds the parts of a cluster."""
    flat = parts.select("cluster_id", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return flat.groupBy("cluster_id").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sums"))


def assign_clusters(centroids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, cluster_id) by the nearest centroid, the smallest id on ties. No row moves but to the task that it is in."""
    table = centroids.orderBy("cluster_id").select("cluster_id", "descriptor").toArrow()  # CENTROID_BYTES at most, see fit_clusters
    ids, centers = np.asarray(table.column("cluster_id")), np.array(table.column("descriptor").to_pylist(), np.float64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            near = _nearest_of(np.asarray(array.flatten(), np.float64).reshape(-1, centers.shape[1]), centers)
            yield pa.array(ids[near].astype(np.int32))

    return rows.select(key, F.arrow_udf(run, "int")(F.col("descriptor").cast("array<double>")).alias("cluster_id"))


def recluster(tiles: DataFrame, queries: DataFrame, k: int, rounds: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Clusters of tiles, and of queries by the same centroids."""
    centroids = fit_clusters(tiles, "tile_id", k, rounds, seed)
    return assign_clusters(centroids, tiles, "tile_id"), assign_clusters(centroids, queries, "query_id")


def training_table(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Pairs with the cluster of their tile."""
    return pairs.join(clusters, "tile_id")


def _number(*parts) -> Column:
    """48 bits of the md5 of parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def batch_plan(pairs: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """(batch, part, slot, pair_idx): floor(n / batch_size) batches over pairs (pair_idx, cluster_id).

    Half of a batch (`random`) is uniform without replacement in the epoch: the pairs in seeded order, cut into runs. The
    rest (`cluster`) comes from clusters drawn in proportion to their size, again and again until the batch is full. The order
    in which such draws first meet the clusters is that of clocks, -log(u) / size for each cluster, so nothing is drawn in vain
    and no number of draws is too few. A batch takes a run of a cluster's pairs, in seeded order from a seeded start, those
    already in the batch left out. All numbers are md5 sums, alike on every run and partitioning. Clusters are few (each batch
    looks at each); pairs meet batches by their places in clusters, so no cluster is sent whole.
    """
    batches, half = pairs.count() // batch_size, batch_size // 2
    rest = batch_size - half
    uniform = seeded_places(pairs.select("pair_idx"), "pair_idx", seed, name="at").where(F.col("at") < batches * half)
    uniform = uniform.select(
        F.floor(F.col("at") / F.lit(max(half, 1))).alias("batch"), F.lit("random").alias("part"),
        (F.col("at") % max(half, 1)).cast("int").alias("slot"), "pair_idx",
    )

    sizes = pairs.groupBy("cluster_id").agg(F.count("*").alias("size")).withColumn("c", F.row_number().over(W.orderBy("cluster_id")))
    sizes = cut(sizes, "clusters")
    k = sizes.count()
    drawn = pairs.sparkSession.range(batches).select(
        F.col("id").alias("batch"), F.explode(F.sequence(F.lit(1), F.lit(max(k, 1)))).alias("c"),
    ).join(sizes, "c")
    u = (_number(F.lit(f"{seed}|clock"), "batch", "cluster_id") + 1) / F.lit(float(1 << 48))
    start = _number(F.lit(f"{seed}|start"), "batch", "cluster_id") % F.col("size")
    drawn = drawn.select("batch", "cluster_id", "size", (-F.log(u) / F.col("size")).alias("clock"), start.alias("start"))
    order = W.partitionBy("batch").orderBy("clock", "cluster_id")
    before = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    drawn = drawn.withColumn("draw", F.row_number().over(order)).withColumn("before", before).where(F.col("before") < batch_size)
    taken = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("size", F.lit(batch_size) - F.col("before")) - 1)))
    taken = taken.select("batch", "cluster_id", "draw", "j", ((F.col("start") + F.col("j")) % F.col("size")).alias("pos"))
    placed = seeded_places(pairs.select("pair_idx", "cluster_id"), "pair_idx", seed, ["cluster_id"], "pos")
    inside = taken.join(placed, ["cluster_id", "pos"]).join(uniform.select("batch", "pair_idx"), ["batch", "pair_idx"], "left_anti")
    slot = F.row_number().over(W.partitionBy("batch").orderBy("draw", "j")) - 1
    chosen = inside.withColumn("slot", slot.cast("int")).where(F.col("slot") < rest).select(
        "batch", F.lit("cluster").alias("part"), "slot", "pair_idx",
    )
    return uniform.unionByName(chosen)


def mined_pairs(rows: DataFrame, dim: int | None = None, margin: float = MARGIN) -> DataFrame:
    """(batch, anchor, other, positive, similarity): the hard pairs of each batch of (batch, item, label, embedding).

    A positive is kept if it is less similar than the hardest negative plus the margin, a negative if it is more similar than
    the hardest positive less the margin; an anchor that lacks either kind keeps none.
    """
    b = rows.select("batch", F.col("item").alias("other"), F.col("label").alias("other_label"), F.col("embedding").alias("other_embedding"))
    pairs = rows.join(b, "batch").where("item <> other").select(
        "batch", F.col("item").alias("anchor"), "other", (F.col("label") == F.col("other_label")).alias("positive"),
        dot(F.col("embedding"), F.col("other_embedding"), dim).alias("similarity"),
    )
    w = W.partitionBy("batch", "anchor")
    hard = pairs.withColumn("hardest_positive", F.min(F.when(F.col("positive"), F.col("similarity"))).over(w)).withColumn(
        "hardest_negative", F.max(F.when(~F.col("positive"), F.col("similarity"))).over(w),
    )
    keep = (F.col("positive") & (F.col("similarity") - margin < F.col("hardest_negative"))) | (~F.col("positive") & (F.col("similarity") + margin > F.col("hardest_positive")))
    return hard.where(keep).select("batch", "anchor", "other", "positive", "similarity")


def _losses(rows: DataFrame, labels: list[str], dim: int | None, alpha: float, beta: float, base: float, margin: float) -> DataFrame:
    """(batch, and for each label column loss_<label>, anchors_<label>): pairs meet and are compared once, whatever the number of labels.

    An item meets itself too, as neither a positive nor a negative, so that every batch has a row.
    """
    b = rows.select("batch", F.col("item").alias("other"), *(F.col(x).alias(f"_other_{x}") for x in labels), F.col("embedding").alias("other_embedding"))
    like = {x: F.when(F.col("item") != F.col("other"), F.col(x) == F.col(f"_other_{x}")).alias(f"_like_{x}") for x in labels}
    pairs = rows.join(b, "batch", "left").select("batch", F.col("item").alias("anchor"), dot(F.col("embedding"), F.col("other_embedding"), dim).alias("s"), *like.values())
    w, s = W.partitionBy("batch", "anchor"), F.col("s")
    hard = pairs.select(
        "*", *(F.min(F.when(F.col(f"_like_{x}"), s)).over(w).alias(f"_hp_{x}") for x in labels),
        *(F.max(F.when(~F.col(f"_like_{x}"), s)).over(w).alias(f"_hn_{x}") for x in labels),
    )
    sums, out = [], []
    for x in labels:
        positive = F.col(f"_like_{x}") & (s - margin < F.col(f"_hn_{x}"))
        negative = ~F.col(f"_like_{x}") & (s + margin > F.col(f"_hp_{x}"))
        sums += [F.sum(F.when(positive, F.exp(-alpha * (s - base)))).alias(f"_p_{x}"), F.sum(F.when(negative, F.exp(beta * (s - base)))).alias(f"_n_{x}")]
        each = F.log1p(f"_p_{x}") / alpha + F.log1p(f"_n_{x}") / beta
        out += [F.coalesce(F.avg(each), F.lit(0.0)).alias(f"loss_{x}"), F.count(each).alias(f"anchors_{x}")]
    return hard.groupBy("batch", "anchor").agg(*sums).groupBy("batch").agg(*out)


def multi_similarity_loss(
    rows: DataFrame, dim: int | None = None, alpha: float = ALPHA, beta: float = BETA, base: float = BASE, margin: float = MARGIN,
) -> DataFrame:
    """(batch, loss, valid_anchors): mean over anchors with a mined positive and a mined negative; 0.0 without any."""
    found = _losses(rows.select("batch", "item", "label", "embedding"), ["label"], dim, alpha, beta, base, margin)
    return found.select("batch", F.col("loss_label").alias("loss"), F.col("anchors_label").alias("valid_anchors"))


def paired_rows(batch: DataFrame, embeddings_q: DataFrame, embeddings_t: DataFrame, *labels: str) -> DataFrame:
    """(batch, item, labels, embedding) of both sides of a batch of pairs: labels are columns of `batch`, alike for both."""
    side = lambda mark, e, key: batch.join(e, key).select("batch", F.concat(F.lit(mark), F.col("pair_idx")).alias("item"), *labels, "embedding")
    return side("q", embeddings_q, "query_id").unionByName(side("t", embeddings_t, "tile_id"))


def _paired_losses(batch: DataFrame, q: DataFrame, t: DataFrame, dim: int | None, **names: str) -> DataFrame:
    """(batch, a loss for each name) by the label columns that the names stand for."""
    found = _losses(paired_rows(batch, q, t, *names.values()), list(names.values()), dim, ALPHA, BETA, BASE, MARGIN)
    return found.select("batch", *(F.col(f"loss_{x}").alias(name) for name, x in names.items()))


def pairwise_loss(batch: DataFrame, q: DataFrame, t: DataFrame, dim: int | None = None) -> DataFrame:
    """The loss where a query and its tile are alike and all else differs."""
    return _paired_losses(batch, q, t, dim, loss="pair_idx")


def cluster_loss(batch: DataFrame, q: DataFrame, t: DataFrame, dim: int | None = None) -> DataFrame:
    """The loss where all items of a cluster are alike."""
    return _paired_losses(batch, q, t, dim, loss="cluster_id")


def total_loss(batch: DataFrame, q: DataFrame, t: DataFrame, dim: int | None = None) -> DataFrame:
    """(batch, pairwise_loss, cluster_loss, total_loss). The plan of the batches is written, as both sides of a pair look it up."""
    found = _paired_losses(cut(batch, "batches"), q, t, dim, pairwise_loss="pair_idx", cluster_loss="cluster_id")
    return found.withColumn("total_loss", F.col("pairwise_loss") + F.col("cluster_loss"))
