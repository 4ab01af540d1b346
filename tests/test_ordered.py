"""Exact quantiles and running values against plain Python, with limits so small that every way is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from skyfix.operators import ordered


@pytest.mark.parametrize(("few", "grid"), [(10_000, 500), (40, 500)])
def test_quantiles_are_exact(spark, monkeypatch, few, grid):
    monkeypatch.setattr(ordered, "FEW", few)
    monkeypatch.setattr(ordered, "GRID", grid)
    rnd = np.random.default_rng(2)
    groups = {
        "even": rnd.normal(size=1000), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "same": np.full(500, 2.5), "wide": 10.0 ** rnd.uniform(-300, 300, 700),
        "steps": rnd.integers(0, 4, 900).astype(float), None: rnd.exponential(size=333), "signs": np.concatenate([np.full(200, -1.0), [0.0], np.full(200, 1.0)]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs = [0.0, 0.5, 0.95, 1.0]
    got = {r.g: r.quantiles for r in ordered.exact_quantiles(df, "x", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, probs), rtol=1e-12), g
    whole = ordered.exact_quantiles(df, "x", [0.3]).first().quantiles
    assert np.allclose(whole, np.quantile(np.concatenate(list(groups.values())), 0.3), rtol=1e-12)
    assert ordered.exact_quantiles(df.where("x is null"), "x", [0.5]).count() == 0


def test_a_sketch_that_misses_only_costs_passes(spark, monkeypatch):
    """The proposals of a sketch are checked by counts: a very coarse one gives the same."""
    monkeypatch.setattr(ordered, "FEW", 50)
    monkeypatch.setattr(ordered, "ACCURACY", 100)
    x = np.random.default_rng(6).normal(size=3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(9)
    assert np.allclose(ordered.exact_quantiles(df, "x", [0.5, 0.9]).first().quantiles, np.quantile(x, [0.5, 0.9]), rtol=1e-12)


def test_previous_rows_cross_ranges(spark):
    rnd = np.random.default_rng(4)
    rows = [("hot", float(t), int(rnd.integers(0, 9)) if t % 5 else None) for t in rnd.permutation(2000)] + [(None, 1.0, 1), (None, 0.5, None), ("cold", 3.0, 4)]
    df = spark.createDataFrame(rows, "g string, ts double, c int").repartition(6)
    out = ordered.with_previous(df, ["g"], ["ts", "c"], ["ts", "c"], rows=100).collect()
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        for i, r in enumerate(own):
            want[r[0], r[1]] = (r[2], *((None, None) if i == 0 else own[i - 1][1:]), i + 1)
    assert {(r.g, r.ts): (r.c, r.prev_ts, r.prev_c, r.place) for r in out} == want and len(out) == len(rows)


def test_no_range_holds_a_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), F.col("id").alias("ts"))
    sizes = [r["count"] for r in ordered.in_ranges(df, ["g"], ["ts"], 1000).groupBy("_range").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 3000
