import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from skyfix.sources.shared import shared_dir
from skyfix.operators import evaluate, localize, plugins, retrieval, select, spatial, tile_index, training
from skyfix.plans.queries import plugin_chain
from skyfix.sources import sinks, tables
from skyfix.sources.shared import shared_dir
from skyfix.streaming import jobs, power

RING = "array<struct<lat: double, lon: double>>"


def box(y, x, h):
    return [(y - h, x - h), (y + h, x - h), (y + h, x + h), (y - h, x + h)]


def test_overlap_join_for_any_cell(spark):
    rnd = random.Random(2)
    q = [(i, rnd.uniform(-60, 60), rnd.uniform(-180, 180), rnd.choice([0.1, 1, 9])) for i in range(60)] + [(60, 0.0, 0.0, 1.0)]
    t = [(i, rnd.uniform(-60, 60), rnd.uniform(-180, 180), rnd.choice([0.1, 1, 9])) for i in range(80)] + [(80, 2.0, 0.0, 1.0)]
    expect = {(a[0], b[0]) for a in q for b in t if abs(a[1] - b[1]) <= a[3] + b[3] and abs(a[2] - b[2]) <= a[3] + b[3]}
    qs = spark.createDataFrame([(i, box(y, x, h)) for i, y, x, h in q], f"query_id int, corners {RING}")
    ts = spark.createDataFrame([(i, box(y, x, h)) for i, y, x, h in t], f"tile_id int, corners {RING}")
    for cell in (None, 0.7, 5.0, 400.0):
        got = [(r.query_id, r.tile_id) for r in spatial.overlapping(qs, ts, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == expect
    assert spatial.overlapping(qs.limit(0), ts).count() == 0


def test_nearest_tile_everywhere(spark):
    rnd = random.Random(5)
    tiles = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(25)] + [(25, 10.0, 179.9), (26, 10.0, 179.9)]
    points = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(60)] + [(60, 10.0, -179.9), (61, 90.0, 0.0), (62, -90.0, 50.0)]

    def km(a, b):
        y1, x1, y2, x2 = map(np.radians, (*a, *b))
        return 12742 * np.arcsin(np.sqrt(np.sin((y2 - y1) / 2) ** 2 + np.cos(y1) * np.cos(y2) * np.sin((x2 - x1) / 2) ** 2))

    ts = spark.createDataFrame(tiles, "tile_id int, tile_lat double, tile_lon double").withColumn("ord", F.col("tile_id"))
    got = {r.p: (r.tile_id, r.km) for r in spatial.nearest_tile(spark.createDataFrame(points, "p int, lat double, lon double"), ts, "p", "tile_id", "ord").collect()}
    for i, y, x in points:
        d, best = min((round(km((y, x), t[1:]), 9), t[0]) for t in tiles)
        assert abs(got[i][1] - d) < 1e-6 and (got[i][0] == best or abs(y) == 90)
    assert got[60][0] == 25


def test_points_of_one_place_are_searched_once(spark, monkeypatch):
    seen, real = [], spatial._nearest_places
    monkeypatch.setattr(spatial, "_nearest_places", lambda points, spots, cell: seen.append((points.count(), spots.count())) or real(points, spots, cell))
    points = spark.range(200).select(F.col("id").alias("p"), (F.col("id") % 2 * 10.0).alias("lat"), F.lit(3.0).alias("lon"))
    points = points.unionByName(spark.sql("select 999L p, cast(null as double) lat, 1.0D lon"))
    tiles = spark.range(300).select(F.concat(F.lit("t"), "id").alias("tile_id"), (300 - F.col("id")).alias("ord"), (F.col("id") % 3 * 4.0).alias("tile_lat"), F.lit(3.5).alias("tile_lon"))
    got = {r.p: r.tile_id for r in spatial.nearest_tile(points, tiles, "p", "tile_id", "ord").collect()}
    assert seen == [(2, 3)] and got == {i: "t299" if i % 2 else "t297" for i in range(200)}


def test_radius_is_strict_and_first_region_wins(spark):
    regions = spark.createDataFrame(
        [(0, "a", 0.0, 0.0), (1, "b", 0.0, 10.0)], "ord int, region string, center_lat double, center_lon double",
    )
    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 30.0), (3, 0.0, 9.0)], "i int, lat double, lon double")
    edge = rows.where("i = 1").select(F.lit(6371.0) * F.radians(F.lit(5.0))).first()[0]
    assert spatial.in_regions(rows, regions, "lat", "lon", edge * 0.999999).where("i = 1").count() == 0
    got = spatial.first_region(rows, regions, "i", "lat", "lon", 1100.0)
    assert {(r.i, r.region) for r in got.collect()} == {(1, "a"), (3, "a")}
    assert {r.i for r in spatial.outside_regions(rows, regions, "lat", "lon", 1100.0).collect()} == {2}
    assert {r.i for r in spatial.in_any_region(rows, regions, "lat", "lon", 1100.0).collect()} == {1, 3}


def test_search_caps_ties_and_checks(spark):
    d = spark.createDataFrame(
        [(1, 0, [1.0, 0.0]), (1, 90, [0.0, 1.0]), (2, 0, [0.0, 1.0]), (3, 0, [-1.0, 0.0])],
        "tile_id long, rotation int, descriptor array<float>",
    )
    q = spark.createDataFrame([(7, [0.0, 1.0])], "query_id long, descriptor array<float>")
    for method in ("gemm", "native"):
        got = [(r.tile_id, r.similarity, r["rank"]) for r in retrieval.search_tiles(q, d, 2, 9, method).orderBy("rank").collect()]
        assert got == [(1, 1.0, 1), (2, 1.0, 2), (3, 0.0, 3)]
        assert [r.tile_id for r in retrieval.search_tiles(q, d, 2, 1, method).collect()] == [1]
    assert retrieval.search_tiles(q.limit(0), d, 2, 3).count() == 0
    with pytest.raises(Exception, match="descriptor length"):
        retrieval.search_tiles(q, d, 3, 2).collect()


def _search_tables(spark, rnd, tiles, queries, dim, near=0.0, kind="float"):
    home = rnd.normal(size=(12, dim))
    vectors = [(home[i % 12] * near + rnd.normal(size=dim)).tolist() for i in range(tiles * 3)]
    d = spark.createDataFrame([(f"t{i // 3 % 31}@{i // 3}", v) for i, v in enumerate(vectors)], f"tile_id string, descriptor array<{kind}>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", f"t{i * 7 % 31}@{i * 7}", vectors[i * 21]) for i in range(queries)], f"query_id string, own_tile string, descriptor array<{kind}>")
    return q, d


def _plain_search(q, d, k, exclude):
    rows = d.collect()
    matrix = np.array([r.descriptor for r in rows])
    out = {}
    for r in q.collect():
        best = {}
        for t, s in zip((x.tile_id for x in rows), matrix @ np.array(r.descriptor), strict=True):
            if not (exclude and t == r.own_tile):
                best[t] = max(best.get(t, -np.inf), s)
        out[r.query_id] = [(t, round(s, 6)) for t, s in sorted(best.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]]
    return out


def _found(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.tile_id, round(r.similarity, 6)))
    return out


@pytest.mark.parametrize("near", [0.0, 20.0])
def test_an_index_of_many_blocks_finds_the_same(spark, monkeypatch, near):
    monkeypatch.setattr(tile_index, "QUERY_BYTES", 7 * 8 * 8)
    q, d = _search_tables(spark, np.random.default_rng(3), 400, 30, 8, near)
    index = tile_index.build_index(d, 8, block_bytes=40 * 4 * 8)
    hits, seen = tile_index.search_index(q, index, 6, exclude_own=True)
    assert _found(hits) == _plain_search(q, d, 6, True)
    assert seen.tile_blocks >= 30 and seen.query_blocks >= 4 and 0 < seen.visited <= seen.query_blocks * seen.tile_blocks
    if near:
        assert seen.skipped_share > 0.5  # tiles lie in twelve crowds
    again, _ = tile_index.search_index(q, index.save(f"{shared_dir(spark)}/index-test-{near}"), 6, exclude_own=True)
    assert _found(again) == _found(hits)
    for method in ("gemm", "native"):
        assert _found(retrieval.search_tiles(q, d, 8, 6, method, exclude_own=True)) == _found(hits)


def test_small_blocks_meet_in_packs(spark):
    """Blocks of 16 vectors: rows that are moved grow with packs, not with pairs of blocks."""
    q, d = _search_tables(spark, np.random.default_rng(6), 400, 30, 8)
    index = tile_index.build_index(d, 8, block_bytes=16 * 4 * 8)
    tiles = tile_index._in_packs(index.blocks, "d_block", "vectors", 64 * 4 * 8, 4, "t", [*tile_index._SPHERE, "tiles", "vectors"])
    assert tiles.count() < index.count and tiles.agg(F.sum(F.size("t_blocks"))).first()[0] == index.count
    hits, seen = tile_index.search_index(q, index, 6, exclude_own=True)
    assert _found(hits) == _plain_search(q, d, 6, True) and seen.tile_blocks >= 75


def test_packs_do_not_pass_the_driver(spark, monkeypatch):
    """To Spark, packs of queries in many cells are as small as their compressed files: it would broadcast all copies."""
    plans, cut = {}, tile_index.cut

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(tile_index, "cut", kept)
    q, d = _search_tables(spark, np.random.default_rng(8), 400, 30, 8)
    hits, _ = tile_index.search_index(q, tile_index.build_index(d, 8, block_bytes=16 * 4 * 8), 6, exclude_own=True)
    assert _found(hits) == _plain_search(q, d, 6, True)
    assert all("SortMergeJoin" in plans[name] for name in ("home-blocks", "home-found", "pack-pairs", "hits"))
    assert not any("Broadcast" in plans[name] for name in ("home-blocks", "pack-pairs"))


def test_blocks_of_wide_vectors_are_bounded(spark):
    """Vectors of 4,096 numbers, as encoders give them, in blocks of 16 MB at most."""
    dim = 4096
    d = spark.range(2500).select(F.concat(F.lit("t"), "id").alias("tile_id"), F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda j: F.sin(j * (F.col("id") % 2000 + 1)).cast("float")).alias("descriptor"))
    q = d.where("tile_id in ('t3', 't1999')").select(F.col("tile_id").alias("query_id"), "descriptor")
    index = tile_index.build_index(d, dim)
    assert index.blocks.agg(F.max(F.length("vectors"))).first()[0] <= tile_index.BLOCK_BYTES
    found = _found(tile_index.search_index(q, index, 2)[0])
    assert [t for t, _ in found["t1999"]][0] == "t1999" and [t for t, _ in found["t3"]] == ["t2003", "t3"]


def test_one_vector_of_many_tiles_is_cut(spark, monkeypatch):
    d = spark.range(3000).select("id", F.array(F.lit(1.0), F.lit(0.5)).alias("descriptor")).withColumnRenamed("id", "tile_id")
    index = tile_index.build_index(d, 2, block_bytes=100 * 16)
    assert index.blocks.agg(F.max(F.size("tiles"))).first()[0] <= 110
    q = spark.createDataFrame([(1, [1.0, 1.0])], "query_id int, descriptor array<double>")
    assert [t for t, _ in _found(tile_index.search_index(q, index, 4)[0])[1]] == [0, 1, 2, 3]


def test_an_index_for_few_tiles_keeps_few_of_one_vector(spark):
    d = spark.range(3000).select(F.col("id").alias("tile_id"), F.array((F.col("id") % 3).cast("float"), F.lit(1.0).cast("float")).alias("descriptor"))
    d = d.unionByName(d.where("tile_id < 6"))
    q = spark.createDataFrame([(i, i, [1.0, 0.5]) for i in (2, 5, 8, 2999)], "query_id long, own_tile long, descriptor array<double>")
    index = tile_index.build_index(d, 2, most=4)
    assert index.blocks.agg(F.sum(F.size("tiles"))).first()[0] <= 3 * 5 + 6
    again = tile_index.load_index(spark, index.save(f"{shared_dir(spark)}/index-most").blocks.inputFiles()[0].rpartition("/")[0], 2)
    for x in (index, again):
        assert _found(tile_index.search_index(q, x, 4, exclude_own=True)[0]) == _plain_search(q, d, 4, True)
        with pytest.raises(ValueError, match="built for 4"):
            tile_index.search_index(q, x, 5)


def test_native_search_sends_heaps_only(spark):
    q, d = _search_tables(spark, np.random.default_rng(4), 300, 20, 8)
    plan = retrieval._kept(q, d, 8, 5, True)._jdf.queryExecution().executedPlan().toString()
    assert "partial_collect_top_k" in plan


def test_native_search_of_64_numbers_is_compiled(spark):
    """The join of all pairs is generated code, in methods that the JVM compiles (8,000 bytes at most), and most pairs are not multiplied."""
    q, d = _search_tables(spark, np.random.default_rng(5), 30, 4, 64)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = retrieval._kept(q, d, 64, 5, True)._jdf.queryExecution().executedPlan()
        codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    parts = [codes.apply(i) for i in range(codes.size())]
    joins = [p for p in parts if "bit_count" in p._1() and "SortMergeJoin" in p._1()]
    assert joins and all(0 < p._3().maxMethodCodeSize() <= 8000 for p in joins)


def test_bounds_of_sliced_vectors_hold(spark):
    rnd = np.random.default_rng(9)
    vectors = [*(rnd.normal(size=(40, 70)) * rnd.uniform(0.01, 100, (40, 1)) + rnd.normal(size=(40, 1))).tolist(), [0.0] * 70, [3.0] * 70]
    odd = [[1.0] * 69 + [x] for x in (float("nan"), float("inf"), float("-inf"), 1e308)] + [[-1e308] + [1e308] * 69]
    rows = spark.createDataFrame(list(enumerate(vectors + odd)), "i int, v array<double>")
    sliced = [retrieval._sliced(rows.select(F.col("i").alias(f"{n}i"), F.col("v").alias(n)), n, 70) for n in ("a", "b")]
    met = sliced[0].crossJoin(sliced[1]).select("ai", "bi", retrieval._at_most("a", "b", 70).alias("most"))
    got = {(r.ai, r.bi): r.most for r in met.collect()}
    product = np.array(vectors) @ np.array(vectors).T
    scale = np.outer(*[np.linalg.norm(vectors, axis=1)] * 2)
    for i in range(len(vectors)):
        for j in range(len(vectors)):
            assert product[i, j] <= got[i, j] <= product[i, j] + 0.2 * scale[i, j] + 1e-9
    assert all(np.isnan(m) or m == float("inf") for (i, j), m in got.items() if max(i, j) >= len(vectors) and vectors[min(i, j, 41)] != [0.0] * 70)


def test_native_search_of_odd_vectors(spark):
    """Vectors without a number are left out, and tiles of one vector are ranked by tile."""
    q, d = _search_tables(spark, np.random.default_rng(11), 200, 10, 8)
    odd = spark.createDataFrame([("a", [None] + [9.0] * 7), ("b", [float("nan")] * 8), ("c", None)], d.schema)
    copies = d.select(F.concat(F.lit("u"), "tile_id").alias("tile_id"), "descriptor")
    many = d.unionByName(copies)
    assert _found(retrieval.search_tiles(q, many.unionByName(odd), 8, 6, "native", exclude_own=True)) == _plain_search(q, many, 6, True)


def test_nearest_centroids_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(50)], "id int, descriptor array<double>")
    centroids = spark.createDataFrame([(i, rnd.normal(size=4).tolist()) for i in range(20)], "cluster_id int, descriptor array<double>")
    key = lambda df: sorted((r.id, r.cluster_id, round(r.centroid_distance, 9)) for r in df.collect())
    sent = key(retrieval.nearest_centroid(rows, centroids, "id"))
    monkeypatch.setattr(retrieval, "CENTROID_BYTES", 100)
    assert key(retrieval.nearest_centroid(rows, centroids, "id")) == sent and len(sent) == 50


def candidates(spark, rows):
    c = [(1.0, 2.0, 3.0, 4.0, True), (5.0, 6.0, 7.0, 8.0, False)] * 3
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    data = [(q, t, r, 0.5, n, c, one if h else None, box(10.0, 20.0, 1.0), 11, 21) for q, t, r, n, h in rows]
    return spark.createDataFrame(
        data,
        f"query_id long, tile_id long, rank int, similarity double, num_inliers int, correspondences array<struct<qu: double, qv: double, "
        f"tu: double, tv: double, inlier: boolean>>, homography array<double>, corners {RING}, tile_h int, tile_w int",
    )


def test_localize_decides(spark):
    frames = spark.createDataFrame([(i, 480, 640) for i in range(1, 7)], "query_id long, query_h int, query_w int")
    c = candidates(
        spark,
        [
            (1, 10, 1, 29, True), (2, 10, 1, 30, True), (3, 10, 1, 31, False), (4, 10, 2, 40, True), (4, 11, 1, 40, True),
            (5, 10, 1, 3, True),
        ],
    )
    got = {r.query_id: r for r in localize.localize(frames, c).collect()}
    assert [got[i].status for i in range(1, 7)] == ["no_fix", "fix", "fix", "fix", "no_fix", "no_fix"]
    assert got[1].confidence == 29 and got[1].matched_tile_id == 10 and got[1].tie_points == [] and got[1].query_footprint is None
    assert got[6].confidence == 0 and got[6].matched_tile_id is None and got[6].candidates == []
    assert got[4].matched_tile_id == 11 and [x.tile_id for x in got[4].candidates] == [11, 10]
    assert len(got[2].tie_points) == 3 and len(got[2].query_footprint) == 4 and got[3].query_footprint is None
    none = localize.localize(frames, c.limit(0)).collect()
    assert {r.status for r in none} == {"no_fix"}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_winners_alone_are_looked_up(spark):
    frames = spark.createDataFrame([(i, 480, 640, f"r{i}") for i in range(1, 5)], "query_id long, query_h int, query_w int, region string")
    c = candidates(spark, [(1, 10, 1, 29, True), (2, 10, 2, 40, True), (2, 11, 1, 40, True), (3, 12, 1, 50, True)])
    matches = c.select(F.col("tile_id").alias("matched_tile_id"), "correspondences", "homography", "tile_h", "tile_w").dropDuplicates(["matched_tile_id"])
    corners = c.where("tile_id <> 12").select(F.col("tile_id").alias("matched_tile_id"), "corners").dropDuplicates(["matched_tile_id"])
    asked = []

    def look_up(best):
        asked.extend(tuple(r) for r in best.select("query_id", "matched_tile_id").collect())
        return best.join(matches, "matched_tile_id", "left").join(corners, "matched_tile_id", "left")

    light = c.select("query_id", "tile_id", "rank", "similarity", "num_inliers")
    got = {r.query_id: r for r in localize.localize(frames, light, look_up=look_up).collect()}
    assert sorted(asked, key=str) == [(1, 10), (2, 11), (3, 12), (4, None)]
    whole = {r.query_id: r for r in localize.localize(frames, c).collect()}
    assert all(got[i] == whole[i] for i in (1, 2, 4)) and got[2].region == "r2" and len(got[2].tie_points) == 3
    # A fix whose tile is gone keeps its tile's name and its candidates, and has no place.
    assert got[3].status == "fix" and got[3].matched_tile_id == 12 and got[3].tie_points == [] and got[3].query_footprint is None
    assert [x.tile_id for x in got[3].candidates] == [12]


def test_best_candidates_stay_where_they_are(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        c = candidates(spark, [(q, 10 + r, r, n, r != 2) for q in range(5) for r, n in ((1, 20), (2, 31), (3, 31))]).repartition(3, "query_id")
        assert exchanges(localize.best_candidates(c)) == exchanges(c)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    best = localize.best_candidates(c)
    assert best.columns == c.columns and best.schema["correspondences"].dataType == c.schema["correspondences"].dataType
    assert [(r.tile_id, r.rank, r.num_inliers, r.homography) for r in best.collect()] == [(12, 2, 31, None)] * 5


def test_footprint_needs_four_inliers(spark):
    c = candidates(spark, [(1, 1, 1, 3, True), (2, 1, 1, 4, True)]).withColumn(
        "f",
        localize.query_footprint(
            F.col("homography"), F.col("num_inliers"), F.col("corners"), F.lit(11), F.lit(21), F.col("tile_h"), F.col("tile_w"),
        ),
    )
    got = {r.query_id: r.f for r in c.collect()}
    assert got[1] is None and [tuple(p) for p in got[2]] == [(11.0, 19.0), (11.0, 21.0), (9.0, 21.0), (9.0, 19.0)]
    centre = c.select("query_id", localize.center_of(F.col("f"), F.lit(1.0), F.lit(2.0)).alias("m")).collect()
    assert {r.query_id: tuple(r.m) for r in centre} == {1: (1.0, 2.0), 2: (10.0, 20.0)}


def test_first_clearing_is_not_the_largest(spark):
    c = spark.createDataFrame(
        [(1, 5, 1, 10), (1, 6, 2, 31), (1, 7, 3, 90), (2, 5, 1, 1)], "query_id int, tile_id int, rank int, num_inliers int",
    )
    assert {r.query_id: r.clearing_inliers for r in evaluate.first_clearing(c, 30).collect()} == {1: 31, 2: None}


def test_recall_without_queries_is_zero(spark):
    none = spark.createDataFrame([], "query_id int, first_rank int")
    assert tuple(evaluate.recall(none, (1, 5)).first()) == (0.0, 0.0, 0)


def test_positives_by_label_are_those_written_out(spark):
    """Also of queries whose label no other tile has, and of those without a tile; no row for each query and tile of a label."""
    tiles = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None)], "tile_id long, label string")
    q = spark.createDataFrame([(10, 1, "a"), (11, 2, "b"), (12, 3, "c"), (13, None, "a"), (14, 9, "z"), (15, 1, "b"), (16, 4, None)], "query_id long, own_tile long, label string")
    ranked = spark.createDataFrame([(i, t, r) for i in range(10, 17) for r, t in enumerate((3, 1, 2, 4), 1)], "query_id long, tile_id long, rank int")
    pairs = q.join(tiles.distinct(), "label").where("tile_id <> own_tile").select("query_id", "tile_id")
    want = {tuple(r) for r in evaluate.first_hits(ranked, pairs).collect()}
    got = evaluate.label_hits(ranked, q, tiles)
    assert {tuple(r) for r in got.collect()} == want == {(10, 3), (11, 2)}


def test_power_wraps_and_skips(spark):
    s = spark.createDataFrame(
        [(0.0, 90.0), (1.0, 95.0), (2.0, 5.0), (3.0, None), (3.0, 7.0), (4.0, 9.0)], "ts double, c double",
    ).withColumn("rss_mb", F.lit(1.0))
    got = [r.power_w for r in evaluate.counter_power(s.withColumn("run", F.lit(1)), "ts", "c", 100.0, ["run"]).orderBy("ts", "c").collect()]
    assert got[:3] == [None, 5e-6, 1e-5] and got[3:5] == [None, None] and got[5] == 2e-6


def test_first_valid_does_not_use_up_the_key(spark):
    rows = spark.createDataFrame([("k", 1, None), ("k", 2, 5.0), ("k", 3, 6.0), ("z", 4, None)], "k string, line int, v double")
    assert [(r.k, r.line) for r in select.first_valid(rows, ["k"], F.col("v").isNotNull(), ["line"]).collect()] == [("k", 2)]
    assert [r.line for r in select.last_wins(rows.where("k = 'k'"), ["k"], ["line"]).collect()] == [3]


def loss_by_hand(labels, x):
    s = x @ x.T
    out = []
    for i in range(len(x)):
        pos = [s[i, j] for j in range(len(x)) if j != i and labels[j] == labels[i]]
        neg = [s[i, j] for j in range(len(x)) if labels[j] != labels[i]]
        if pos and neg:
            p, n = [v for v in pos if v - 0.1 < max(neg)], [v for v in neg if v + 0.1 > min(pos)]
            if p and n:
                out.append(np.log1p(sum(np.exp(-2 * (np.array(p) - 0.5)))) / 2 + np.log1p(sum(np.exp(50 * (np.array(n) - 0.5)))) / 50)
    return float(np.mean(out)) if out else 0.0


def test_losses(spark):
    rnd = np.random.default_rng(1)
    rows, expect = [], {}
    for b, labels in enumerate([[0, 0, 1, 1, 2], [0] * 4, [0, 1, 2, 3], [0, 0, 0, 1, 1, 1]]):
        x = rnd.normal(size=(len(labels), 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(b, i, k, v.tolist()) for i, (k, v) in enumerate(zip(labels, x, strict=True))]
        expect[b] = loss_by_hand(labels, x)
    df = spark.createDataFrame(rows, "batch int, item int, label int, embedding array<double>")
    for dim in (None, 6):
        got = {r.batch: r.loss for r in training.multi_similarity_loss(df, dim).collect()}
        assert all(abs(got[b] - v) < 1e-9 for b, v in expect.items()) and got[1] == got[2] == 0.0


def test_total_loss_works_its_batches_out_once(spark):
    rnd, made = np.random.default_rng(2), spark.sparkContext.accumulator(0)
    x = rnd.normal(size=(12, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, embedding array<double>")
    shape = "batch int, pair_idx int, cluster_id int, query_id int, tile_id int"

    def one(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    rows = [(i // 6, i, i % 2, i, (i + 1) % 12) for i in range(12)]
    batch = spark.createDataFrame(rows, shape).mapInArrow(one, shape)
    q, t = (e.withColumnRenamed("id", k) for k in ("query_id", "tile_id"))
    got = {r.batch: r for r in training.total_loss(batch, q, t, 6).collect()}
    assert made.value == 12 and sorted(got) == [0, 1]
    for b, r in got.items():
        mine = [row for row in rows if row[0] == b]
        vectors = x[[row[3] for row in mine] + [row[4] for row in mine]]
        by = lambda k: loss_by_hand([row[k] for row in mine] * 2, vectors)  # noqa: B023, E731
        assert abs(r.pairwise_loss - by(1)) < 1e-9 and abs(r.cluster_loss - by(2)) < 1e-9 and r.total_loss == r.pairwise_loss + r.cluster_loss
    lone = spark.createDataFrame([(1, 1, 1, [1.0]), (None, 2, 1, [1.0])], "batch int, item int, label int, embedding array<double>")
    assert {tuple(r) for r in training.multi_similarity_loss(lone).collect()} == {(1, 0.0, 0), (None, 0.0, 0)}


@pytest.mark.parametrize("size", [10, 7])
def test_batch_plan(spark, size):
    pairs = spark.createDataFrame([(i, 0 if i < 60 else i % 9 + 1) for i in range(100)], "pair_idx int, cluster_id int")
    plan = training.batch_plan(pairs, size, 4).toPandas()
    assert plan.groupby("batch").size().eq(size).all() and plan.batch.nunique() == 100 // size
    assert not plan.duplicated(["batch", "pair_idx"]).any()
    assert not plan[plan.part == "random"].duplicated("pair_idx").any()
    assert (plan[plan.part == "random"].groupby("batch").size() == size // 2).all()
    again = training.batch_plan(pairs.repartition(7), size, 4).toPandas()
    key = lambda p: set(map(tuple, p[["batch", "part", "slot", "pair_idx"]].to_numpy().tolist()))
    assert key(plan) == key(again)


def test_clusters(spark):
    rnd = np.random.default_rng(0)
    x = np.vstack([rnd.normal(c, 0.5, size=(20, 3)) for c in (0, 4, 9)])
    tiles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "tile_id int, descriptor array<double>").repartition(5)
    queries = tiles.withColumnRenamed("tile_id", "query_id")
    order = sorted(range(60), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    centers = x[order[:3]]
    near = lambda: np.argmin(((x[:, None] - centers) ** 2).sum(2), 1)
    for _ in range(4):
        at = near()
        centers = np.array([x[at == c].mean(0) for c in range(3)])
    t, q = training.recluster(tiles, queries, 3, 4, 7)
    assert [r.cluster_id for r in t.orderBy("tile_id").collect()] == near().tolist() == [r.cluster_id for r in q.orderBy("query_id").collect()]
    assert training.fit_clusters(tiles.limit(2), "tile_id", 5).count() == 2
    assert training.fit_clusters(tiles.where("tile_id < 0"), "tile_id", 5).count() == 0


NAME = "@44.0@9.0@46.0@9.0@46.0@11.0@44.0@11.0@img{}@20210724@45.0@10.0@3@0.0@.jpg"


def test_listings(spark, tmp_path):
    for place in ("2021_09/a", "2021_10", "2020_09"):
        (tmp_path / "db" / place).mkdir(parents=True)
        (tmp_path / "db" / place / NAME.format(place[:7])).write_bytes(b"x")
    (tmp_path / "db" / "2021_10" / "note.txt").write_bytes(b"x")
    found = tables.reference_tiles(spark, str(tmp_path / "db"))
    assert {(r.year, r.zoom) for r in found.collect()} == {(2021, 9), (2021, 10), (2020, 9)}
    assert tables.scoped(found, 2021, (9,)).count() == 1
    for scope, want in (((2021, (9,)), {(2021, 9)}), ((None, (9,)), {(2021, 9), (2020, 9)}), ((2021, None), {(2021, 9), (2021, 10)})):
        part = tables.reference_tiles(spark, str(tmp_path / "db"), True, *scope)
        assert {(r.year, r.zoom) for r in part.collect()} == want
    flat = tmp_path / "db" / "2021_09"
    (flat / NAME.format("q")).write_bytes(b"x")
    assert [r.tile_id for r in tables.query_set(spark, str(flat)).collect()] == ["imgq@20210724"]
    (tmp_path / "f").mkdir()
    for n in ("b.JPG", "a.png", "c.jpeg", "d.gif"):
        (tmp_path / "f" / n).write_bytes(b"xyz")
    assert [r.frame_id for r in tables.frames(spark, str(tmp_path / "f")).collect()] == ["a", "b", "c"]
    got = plugins.embed(
        tables.frames(spark, str(tmp_path / "f"), content=True), lambda: lambda images: [[len(i.as_py()), 1.0] for i in images], key="frame_id",
    ).collect()
    assert sorted((r.frame_id, r.descriptor) for r in got) == [("a", [3.0, 1.0]), ("b", [3.0, 1.0]), ("c", [3.0, 1.0])]


def test_scoped_scan_prunes(spark, tmp_path):
    rows = spark.createDataFrame([(i, 2018 + i % 4, 9 + i % 2) for i in range(40)], "tile_id int, year int, zoom int")
    sinks.save_tiles(rows, str(tmp_path / "t"))
    plan = tables.scoped(spark.read.parquet(str(tmp_path / "t")), 2021, (9,))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_manifest(spark, tmp_path):
    full = {f"{c}_{k}": "1.0" for c in ("ul", "ur", "lr", "ll") for k in ("lat", "lon")} | {
        "mission": "m", "roll": "r", "frame": "f", "nadir_lat": "1", "nadir_lon": "2", "orientation": "0",
    }
    lines = [full, full | {"nadir_lat": "bad"}, {k: v for k, v in full.items() if k != "nadir_lon"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, lines)))
    raw = tables.manifest(spark, str(tmp_path / "m.jsonl"))
    assert [r.nadir_lat for r in raw.orderBy("line").collect()] == ["1", "bad", "1"]
    assert raw.count() == 3 and tables.manifest_numbers(raw).select("nadir_lat").collect() == [(1.0,)]


def test_result_files_and_databases(spark, tmp_path):
    doc = {
        "Alps": {
            "recalls": {"1": 50.0}, "num_evaluated": 4,
            "coords": {"num_scored": 4, "top1_correct_tile_rate": 25.0, "median_coord_error_km": None, "mean_coord_error_km": None},
        }
    }
    for name in ("big", "smoketest"):
        (tmp_path / f"results_{name}.json").write_text(json.dumps(doc))
    got = tables.results(spark, str(tmp_path)).collect()
    assert [(r.model, r.region, r.recalls["1"], r.coords.median_coord_error_km) for r in got] == [("big", "Alps", 50.0, None)]
    tiles = spark.createDataFrame([(1, "Alps"), (2, "Gobi")], "tile_id int, region string")
    path = str(tmp_path / "db")
    sinks.save_reference_db(tiles, tiles, path)
    sinks.save_reference_db(tiles.limit(0), tiles.limit(0), path)
    assert tables.reference_db(spark, path, "Alps")[0].count() == 1
    sinks.save_reference_db(tiles.where("tile_id = 1"), tiles, path, rebuild=True)
    assert tables.reference_db(spark, path)[0].count() == 1
    verified = spark.createDataFrame([("a", 31), ("b", 77)], "tile_id string, best_inliers int")
    counts = spark.createDataFrame([(5, 1, 2, 2)], "n_sampled long, n_retrieval_miss long, n_matcher_shortfall long, n_verified long")
    sinks.save_verified(verified, counts, str(tmp_path / "v"))
    assert [r.tile_id for r in tables.verified_cache(spark, str(tmp_path / "v")).orderBy("place").collect()] == ["b", "a"]
    assert spark.read.json(str(tmp_path / "v" / "stats")).first().n_sampled == 5
    report = spark.createDataFrame([("Alps", 1.0), ("Gobi", None)], "region string, err double")
    sinks.save_document(evaluate.result_document(report, ["err"]), str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0])["Alps"] == {"err": 1.0}
    sinks.save_table(tiles, str(tmp_path / "pairs"))
    assert tables.training_pairs(spark, str(tmp_path / "pairs")).count() == 2


def test_export(spark, tmp_path):
    frames = spark.createDataFrame([(1, 480, 640), (2, 480, 640)], "query_id long, query_h int, query_w int")
    out = localize.localize(frames, candidates(spark, [(1, 10, 1, 44, True)]))
    sinks.save_export(out, evaluate.export_summary(out), str(tmp_path / "e"))
    back = spark.read.json(str(tmp_path / "e/frames"))
    assert back.where("query_footprint is not null").count() == back.where("status = 'fix'").count() == 1
    assert spark.read.json(str(tmp_path / "e/summary")).first().fix_rate_percent == 50.0


def test_export_works_results_out_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def one(rows):
        for batch in rows:
            made.add(batch.num_rows)
            yield batch

    frames = spark.createDataFrame([(i, 480, 640) for i in range(20)], "query_id long, query_h int, query_w int").mapInArrow(one, "query_id long, query_h int, query_w int")
    out = localize.localize(frames, candidates(spark, [(i, 10, 1, 20 + i, True) for i in range(20)]))
    sinks.save_export(out, evaluate.export_summary, str(tmp_path / "e"))
    rows, summary = tables.saved_export(spark, str(tmp_path / "e"), out.schema)
    assert made.value == 20 and tuple(summary.first()) == (20, 50.0)
    assert sorted(map(str, rows.collect())) == sorted(map(str, out.collect()))
    assert all(f.suffix in (".gz", ".crc") for f in (tmp_path / "e/frames").glob("*part-*"))


def test_matcher_plugin_sees_tiles_together(spark):
    pairs = spark.createDataFrame(
        [(f"q{q}", t, b"q", b"t%d" % t) for q in range(6) for t in range(3)], "query_id string, tile_id int, query_image binary, tile_image binary",
    )

    def factory():
        seen = []

        def run(query, tile, tile_id):
            if tile not in seen:
                seen.append(tile)
            points = [(float(tile_id), 2.0, 3.0, 4.0)] * (tile_id * 3)
            return points, [i < len(seen) for i in range(len(points))], None if tile_id else [1.0] * 9

        return run

    got = plugins.match(pairs, factory, 1)
    assert got.count() == 18 and got.where("homography is null").count() == 12
    assert {(r.tile_id, r.num_matches) for r in got.collect()} == {(0, 0), (1, 3), (2, 6)}
    assert got.groupBy("tile_id").agg(F.countDistinct("num_inliers").alias("n")).where("n > 1").count() == 0
    one = got.where("tile_id = 2").first()
    assert one.correspondences[0].asDict() == {"qu": 2.0, "qv": 2.0, "tu": 3.0, "tv": 4.0, "inlier": True} and one.num_inliers == sum(c.inlier for c in one.correspondences)
    left = select.pending(pairs, got.where("tile_id < 2"), "query_id", "tile_id")
    assert {r.tile_id for r in left.collect()} == {2} and plugins.match(left.limit(0), factory, 1).count() == 0


def test_plugin_chain_matches_every_candidate(spark, monkeypatch):
    """Both runs together match the best five tiles of each frame, none left out; what has no match result counts as no inlier."""
    given, match = [], plugins.match
    monkeypatch.setattr(plugins, "match", lambda pairs, *more: given.extend(tuple(r) for r in pairs.select("query_id", "tile_id", "rank").collect()) or match(pairs, *more))
    out = plugin_chain(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 10 and len(given) == len(set(given)) == 50 and any(t % 3 == 0 for _, t, _ in given)
    assert any(r.status == "fix" and r.matched_tile_id % 3 == 0 for r in out)
    hits = spark.createDataFrame(given, "query_id long, tile_id long, rank int")
    found = localize.with_matches(hits, hits.where("rank = 1").select("query_id", "tile_id", F.lit(7).alias("num_inliers")))
    assert {(r["rank"] == 1, r.num_inliers) for r in found.collect()} == {(True, 7), (False, 0)}


def test_streams_equal_tables(spark, tmp_path):
    rows = pd.DataFrame(
        {
            "ts": pd.date_range("2024-01-01", periods=300, freq="97s"), "camera": [i % 2 for i in range(300)], "frame_id": range(300),
            "rss_mb": [float(i % 50) for i in range(300)],
        }
    )
    df = spark.createDataFrame(rows)
    for i in range(3):
        df.where(f"frame_id between {i * 100} and {i * 100 + 99}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, job in (("arcs", jobs.measurement_arcs), ("windows", jobs.resource_windows)):
        q = job(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got, whole = spark.read.parquet(str(tmp_path / name)), job(df)
        assert 0 < got.count() <= whole.count() and got.exceptAll(whole).count() == 0
        late = whole.exceptAll(got).collect()
        assert all(r[2 if name == "arcs" else 1] >= rows.ts.max().to_pydatetime() - pd.Timedelta("11min") for r in late)
    q = jobs.localize_stream(
        stream.select(F.col("frame_id").alias("query_id")), lambda b: b.withColumn("status", F.lit("fix")), str(tmp_path / "loc"),
        str(tmp_path / "loc-state"),
    )
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "loc")).select("query_id").distinct().count() == 300


def _boxes(spark, rows, key):
    return spark.createDataFrame([(i, box(lat, lon, half)) for i, (lat, lon, half) in enumerate(rows)], f"{key} int, corners {RING}")


def _plain_overlaps(q, t):
    meet = lambda a, b: all(abs(a[i] - b[i]) <= a[2] + b[2] for i in (0, 1))
    return sorted((i, j) for i, a in enumerate(q) for j, b in enumerate(t) if meet(a, b))


def test_boxes_of_all_sizes_meet_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWDED", 7)
    monkeypatch.setattr(spatial, "CROWDED_TILES", 11)
    rnd = random.Random(9)
    some = lambda n: [(rnd.randrange(-80, 80) / 2, rnd.randrange(-200, 200) / 2, rnd.choice([0.0, 0.25, 0.25, 0.5, 1.0, 4.0, 32.0])) for _ in range(n)]
    q, t = some(60) + [(0.0, 0.0, 90.0)] + [(10.0, 10.0, 0.25)] * 30, some(80) + [(0.0, 0.0, 128.0)] + [(10.0, 10.0, 0.5)] * 40
    got = spatial.overlapping(_boxes(spark, q, "query_id"), _boxes(spark, t, "tile_id"), cell=0.5)
    assert sorted((r.query_id, r.tile_id) for r in got.collect()) == _plain_overlaps(q, t)
    assert got.columns == ["query_id", "query_corners", "tile_id", "tile_corners"]


def test_a_global_box_among_small_ones_is_a_few_rows(spark):
    rows = spatial._leveled(_boxes(spark, [(0.0, 0.0, 80.0), (1.0, 1.0, 0.01)], "query_id"), "corners", "query_box", 0.01)
    assert spatial._cells(rows, "query_box", F.col("query_box_level"), 0.01).groupBy("query_id").count().agg(F.max("count")).first()[0] <= 9


def test_copies_of_a_footprint_meet_once(spark, monkeypatch):
    """300 copies on either side are one pair of classes; every pair of copies is in the results all the same."""
    monkeypatch.setattr(spatial, "LIST_ROWS", 16)
    q = _boxes(spark, [(1.0, 1.0, 1.0)] * 300 + [(50.0, 50.0, 1.0), (2.9, 2.9, 1.0)], "query_id")
    t = _boxes(spark, [(1.0, 1.5, 1.0)] * 300 + [(1.0, 0.9, 1.0)] * 2 + [(-50.0, 50.0, 1.0)], "tile_id")
    a, b = spatial.footprints(q, "query"), spatial.footprints(t, "tile")
    assert spatial.class_pairs(a, b).count() == 4 and spatial.class_pairs(a, b, least_iou=0.2).count() == 2
    assert a.listed().agg(F.max(F.size("query_list"))).first()[0] < 60
    assert spatial.overlapping(q, t).count() == 301 * 302
    found = spatial.positives(q, t)
    assert found.columns == ["query_id", "query_corners", "tile_id", "tile_corners", "iou"]
    assert found.select("query_id", "tile_id").distinct().count() == found.count() == 300 * 302
    assert {(r.query_id, r.tile_id) for r in spatial.positive_pairs(q, t, "query_id", "tile_id", "tile_id").collect()} == {(i, 300) for i in range(300)}
    assert {tuple(r) for r in spatial.overlap_counts(q, t, "query_id", "tile_id").collect()} == {(i, 302, 0, 301) for i in [*range(300), 301]}
    inside, hit = spatial.positive_sides(q, t)
    assert inside.count() == 300 and hit.count() == 302


def test_no_boxes_meet_none(spark):
    none, some = _boxes(spark, [(0.0, 0.0, 1.0)], "query_id").where("query_id > 5"), _boxes(spark, [(0.0, 0.0, 1.0)], "tile_id")
    assert spatial.overlapping(none, some).count() == 0


def test_localize_takes_ids_of_any_type(spark):
    c = candidates(spark, [(1, 10, 1, 40, True)]).withColumn("tile_id", F.concat(F.lit("img@"), "tile_id")).withColumn("query_id", F.concat(F.lit("q"), "query_id"))
    frames = spark.createDataFrame([("q1", 480, 640), ("q2", 480, 640)], "query_id string, query_h int, query_w int")
    out = {r.query_id: r for r in localize.localize(frames, c).collect()}
    assert out["q1"].matched_tile_id == "img@10" and out["q1"].candidates[0].tile_id == "img@10" and out["q2"].candidates == []


def test_power_of_samples_out_of_order(spark, tmp_path):
    """Samples of several files, some later than others, give what the whole table gives in order."""
    rows = [(i % 2, (pd.Timestamp("2024-01-01") + pd.Timedelta(f"{i * 7 + (11 if i % 3 else 0)}s")).to_pydatetime(), None if i % 11 == 0 else float(i * 37 % 500), float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "run int, ts timestamp, counter double, rss double")
    for i in range(3):
        df.where(f"rss between {i * 40} and {i * 40 + 39}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with power.keyed_state(spark):
        q = power.counter_power_stream(stream, "run", "counter", "rss", 500.0, "5 minutes").writeStream.outputMode("append").format("parquet")
        q = q.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {(r.run, r.ts): r.power_w for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = evaluate.counter_power(df.withColumn("s", F.unix_micros("ts") / 1e6), "s", "counter", 500.0, ["run"])
    want = {(r.run, r.ts): r.power_w for r in whole.collect()}
    assert len(got) > 60 and all(want[k] == pytest.approx(v) if v is not None else want[k] is None for k, v in got.items())
