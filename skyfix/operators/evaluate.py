"""Recall, fix rates, errors, miss taxonomy, latency and resource reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfix.sources.shared import cut

from .ordered import exact_quantiles, join_groups, with_previous


def first_hits(ranked: DataFrame, positives: DataFrame) -> DataFrame:
    """(query_id, first_rank) for each query with a positive: the rank of its first relevant tile, null if none was found."""
    hits = ranked.join(
        positives.select("query_id", "tile_id").distinct(), ["query_id", "tile_id"],
    ).groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return positives.select("query_id").distinct().join(hits, "query_id", "left")


def label_hits(ranked: DataFrame, queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """As first_hits, where the positives of a query are the tiles with a variant of its label, but for its own: they are looked up
    for what was ranked only, as there are as many of them as queries times tiles.

    queries: query_id, own_tile, label. tiles: tile_id, label, a row for each variant."""
    span = tiles.where("tile_id is not null").groupBy("label").agg(F.min("tile_id").alias("_low"), F.max("tile_id").alias("_high"))
    some = queries.join(span, "label").where("_low <> own_tile or _high <> own_tile").select("query_id").distinct()
    hits = with_labels(ranked, queries, tiles).where("correct").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return some.join(hits, "query_id", "left")


def with_labels(ranked: DataFrame, queries: DataFrame, tiles: DataFrame) -> DataFrame:
    """ranked with own_tile and correct: whether the tile has a variant of the query's label and is not its own."""
    known = tiles.select("tile_id", "label").distinct().withColumn("_same", F.lit(True))
    met = ranked.join(queries.select("query_id", "own_tile", "label"), "query_id").join(known, ["tile_id", "label"], "left")
    return met.withColumn("correct", F.col("_same").isNotNull() & F.coalesce(F.col("tile_id") != F.col("own_tile"), F.lit(False))).drop("_same", "label")


def recall(hits: DataFrame, ks: tuple[int, ...], by: list[str] | None = None) -> DataFrame:
    """recall_<k> in percent and num_evaluated from first_hits; 0.0 if no query has a positive."""
    at = [F.coalesce(F.avg(F.when(F.col("first_rank") <= k, 100.0).otherwise(0.0)), F.lit(0.0)).alias(f"recall_{k}") for k in ks]
    return hits.groupBy(*(by or [])).agg(*at, F.count("*").alias("num_evaluated"))


def matching_report(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, mean_inliers over all frames, fix_rate in percent, and the exact median of error_km over fixes (null without)."""
    by, fix = by or [], F.col("status") == "fix"
    rows = cut(results.select(*by, "status", "confidence", F.when(fix, F.col("error_km")).alias("error_km")), "matching")
    report = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("confidence").alias("mean_inliers"),
        (F.coalesce(F.avg(F.when(fix, 100.0).otherwise(0.0)), F.lit(0.0))).alias("fix_rate"),
    )
    return _with_quantile(report, rows, "error_km", 0.5, by, "median_error_km")


def coordinate_report(top1: DataFrame, by: list[str] | None = None) -> DataFrame:
    """num_scored, top1_correct_tile_rate, median and mean coordinate error, from (correct, error_km) of the best tiles."""
    by = by or []
    rows = cut(top1.select(*by, "correct", "error_km"), "coordinates")
    report = rows.groupBy(*by).agg(
        F.count("*").alias("num_scored"),
        F.coalesce(F.avg(F.when(F.col("correct"), 100.0).otherwise(0.0)), F.lit(0.0)).alias("top1_correct_tile_rate"),
        F.avg("error_km").alias("mean_coord_error_km"),
    )
    return _with_quantile(report, rows, "error_km", 0.5, by, "median_coord_error_km")


def latency_report(log: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """mean_latency and the exact p95_latency, between ranks by linear interpolation."""
    by = by or []
    rows = cut(log.select(*by, F.col(latency).alias("latency")), "latencies")
    return _with_quantile(rows.groupBy(*by).agg(F.avg("latency").alias("mean_latency")), rows, "latency", 0.95, by, "p95_latency")


def _with_quantile(report: DataFrame, rows: DataFrame, value: str, p: float, by: list[str], name: str) -> DataFrame:
    """report, a row for each group of rows, with a quantile of the group's values (null where it has none)."""
    found = cut(exact_quantiles(rows, value, [p], by), "quantiles")
    return join_groups(report, found, by, "left").withColumn(name, F.col("quantiles")[0]).drop("quantiles")


def counter_power(samples: DataFrame, ts: str, counter: str, most: float, by: list[str]) -> DataFrame:
    """samples with power_w: the counter's step (micro-joules) over the time step (seconds, 1e-6 at least). A counter that
    fell has wrapped at `most`. Null at the first sample and next to an unreadable one. Ties in ts go by counter.

    Samples are ordered in ranges, so that one run may have them all."""
    near = with_previous(samples, by, [ts, counter], [ts, counter])
    step = F.col(counter) - F.col(f"prev_{counter}")
    step = F.when(step < 0, step + most).otherwise(step)
    power = step / 1e6 / F.greatest(F.col(ts) - F.col(f"prev_{ts}"), F.lit(1e-6))
    return near.select(*samples.columns, power.alias("power_w"))


def resource_report(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Peaks and means of rss_mb and power_w (nulls are skipped), and whether any power was read."""
    return samples.groupBy(*(by or [])).agg(
        F.max("rss_mb").alias("peak_rss_mb"), F.avg("rss_mb").alias("mean_rss_mb"), F.max("power_w").alias("peak_power_w"),
        F.avg("power_w").alias("mean_power_w"), (F.count("power_w") > 0).alias("power_available"),
    )


def first_clearing(candidates: DataFrame, least: int) -> DataFrame:
    """(query_id, clearing_inliers): inliers of the first candidate by rank that has enough, null if none has."""
    return candidates.groupBy("query_id").agg(
        F.min_by(
            F.when(F.col("num_inliers") >= least, F.col("num_inliers")), F.when(F.col("num_inliers") >= least, F.col("rank")),
        ).alias("clearing_inliers")
    )


def outcomes(queries: DataFrame, positives: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """queries with outcome and best_inliers: unscoreable (no positive), retrieval_miss (no positive among the candidates),
    matcher_shortfall (no retrieved candidate has enough inliers) or verified, with the inliers of the first that has."""
    positive = positives.select("query_id", "tile_id").distinct()
    scoreable = positive.select("query_id").distinct().withColumn("scoreable", F.lit(True))
    hit = candidates.join(positive, ["query_id", "tile_id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(True))
    out = queries.join(scoreable, "query_id", "left").join(hit, "query_id", "left").join(first_clearing(candidates, least), "query_id", "left")
    label = F.when(F.col("scoreable").isNull(), "unscoreable").when(F.col("hit").isNull(), "retrieval_miss").when(F.col("clearing_inliers").isNull(), "matcher_shortfall").otherwise("verified")
    return out.withColumn("outcome", label).withColumn(
        "best_inliers", F.when(F.col("outcome") == "verified", F.col("clearing_inliers")),
    ).drop("scoreable", "hit", "clearing_inliers")


def outcome_counts(labelled: DataFrame) -> DataFrame:
    count = lambda name: F.count_if(F.col("outcome") == name)
    return labelled.agg(
        F.count("*").alias("n_sampled"), count("retrieval_miss").alias("n_retrieval_miss"),
        count("matcher_shortfall").alias("n_matcher_shortfall"), count("verified").alias("n_verified"),
    )


def macro_average(rows: DataFrame, values: list[str], by: str = "model") -> DataFrame:
    """Unweighted means over regions, nulls skipped, and the number of regions."""
    return rows.groupBy(by).agg(*(F.avg(v).alias(f"avg_{v}") for v in values), F.count("*").alias("n_regions"))


def strict_macro_average(rows: DataFrame, values: list[str], by: str = "model") -> DataFrame:
    """As macro_average, but null where a region has none."""
    return rows.groupBy(by).agg(
        *(F.when(F.count(v) == F.count("*"), F.avg(v)).alias(f"avg_{v}") for v in values), F.count("*").alias("n_regions"),
    )


def leaderboard(rows: DataFrame, values: list[str]) -> DataFrame:
    """Model and region rows with values to one decimal (half-even), in order of region and model."""
    return rows.select("region", "model", *(F.bround(v, 1).alias(v) for v in values)).orderBy("region", "model")


def result_document(rows: DataFrame, fields: list[str], key: str = "region", by: list[str] | None = None) -> DataFrame:
    """One JSON document, or one for each group (`by`, then document): a map from region to its fields, in order of regions."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value")))
    entries = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return rows.groupBy(*(by or [])).agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def metric_rows(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Tidy (keys, metric, value) rows."""
    return rows.unpivot(keys, values, "metric", "value")


def export_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("num_frames"),
        F.coalesce(F.avg(F.when(F.col("status") == "fix", 100.0).otherwise(0.0)), F.lit(0.0)).alias("fix_rate_percent"),
    )


def residuals(rows: DataFrame, angle: Column, by: str, *more: Column) -> DataFrame:
    """(by, rms, worst, n, more aggregates) of an angle of each row."""
    return rows.withColumn("_a", angle).groupBy(by).agg(
        F.sqrt(F.avg(F.col("_a") * F.col("_a"))).alias("rms"), F.max("_a").alias("worst"), F.count("*").alias("n"), *more,
    )
