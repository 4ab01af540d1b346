import numpy as np
import pandas as pd
import pytest

from skyfix.llm.bayes import WORD_BUCKETS
from pyspark.sql import functions as F
from skyfix.llm.mixing import DOMAINS, fit_rates, mix_to_targets, mixed_documents, rate_of, word_weights

SF = "/root/testdata/sf0.1"


def test_weak_evidence_of_a_rare_domain_is_weighed():
    counts = {d: np.zeros(WORD_BUCKETS + 1) for d in DOMAINS}
    counts["clean"][-1], counts["low"][-1], counts["toxic"][-1] = 300, 50, 50
    counts["clean"][:1000], counts["low"][:1000], counts["toxic"][:1000] = 30, 5, 5
    counts["toxic"][1000:1020], counts["toxic"][1020], counts["toxic"][1021], counts["clean"][1022] = 20, 5, 3, 5
    for d, n in (("clean", 2), ("toxic", 6)):
        counts[d][1023] = n
    whole, own, other = word_weights(counts)[:, DOMAINS.index("toxic")]
    # Words of 5 or 3 texts are not 8 standard deviations above chance. More of the same evidence weighs more.
    assert whole[1000] > whole[1020] > whole[1021] > 0.5 and whole[1023] > 0.5
    assert abs(whole[1022]) < 0.1 and abs(whole[0]) < 0.1 and whole[WORD_BUCKETS - 1] == 0
    assert own[1020] < whole[1020] and own[1023] < whole[1023] < other[1023]
    assert not word_weights(counts)[:, DOMAINS.index("clean")].any() and not word_weights({}).any()


def test_mixing_judges_labels_that_it_has_not_seen(spark):
    """Each half of the labels is judged by what the other half taught."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    halves = [labels.where(f"doc_id % 2 = {half}") for half in (0, 1)]
    got = pd.concat([mix_to_targets(docs, learn).join(judge, "doc_id").toPandas() for learn, judge in (halves, halves[::-1])])
    clean, toxic = got[(got.quality == 1) & (got.toxic == 0)], got[got.toxic == 1]
    assert (clean.copies >= 1).mean() > 0.985 and (toxic.copies == 0).mean() > 0.95


def test_rates_meet_the_targets_by_projected_steps(spark):
    """The rates are those of dense steps, each projected, and near to what a plain projected gradient ends in."""
    rnd = np.random.default_rng(5)
    tokens, p = rnd.integers(1, 400, 300), rnd.dirichlet((0.3, 0.1, 0.05), 300)
    targets = {"a": 0.95, "b": 0.04, "c": 0.01}
    rows = spark.createDataFrame(
        [(int(t), [float(v) for v in x], False) for t, x in zip(tokens, p)], "tokens long, p array<double>, banned boolean",
    )
    steps, miss = fit_rates(rows, targets, tolerance=1e-7)
    rates = np.ones(300)
    for step in steps:
        rates = np.maximum(0, rates - p @ step)
    column = np.array([r.rate for r in rows.select("tokens", rate_of(F.col("p"), steps).alias("rate")).collect()])
    assert len(steps) > 1 and miss <= 1e-7 and np.abs(column - rates).max() < 1e-12
    goal = (tokens @ p)[0] / 0.95 * np.array(list(targets.values()))
    assert np.abs((tokens * rates) @ p / goal - 1).max() < 1e-5
    dense = np.ones(300)
    for _ in range(200_000):
        dense = np.maximum(0, dense - p @ (((tokens * dense) @ p - goal) * 2e-5))
    assert np.abs((tokens * dense) @ p / goal - 1).max() < 1e-5 and np.abs(dense - rates).mean() < 0.02


def test_targets_that_cannot_be_met_are_told(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "b") for i in range(20)], "doc_id long, kind string")
    with pytest.warns(UserWarning, match="from its target"):
        assert mix_to_targets(docs, labels, {"a": 0.9, "b": 0.1}, of=F.col("kind")).count() == 20


def test_other_domains_and_null_columns(spark):
    docs = spark.createDataFrame(
        [(str(i), f"word{i % 7} more words here {i}", "x", i) for i in range(60)] + [(None, None, None, None), ("x", "", None, None)],
        "doc_id string, text string, rate string, copies int",
    )
    labels = spark.createDataFrame([(str(i), "old" if i % 2 else "new") for i in range(0, 60, 3)], "doc_id string, kind string")
    got = mix_to_targets(docs, labels, {"new": 1.0, "old": 0.0}, of=F.col("kind")).toPandas()
    assert len(got) == 62 and {"p_new", "p_old"} <= set(got.columns)
    barred = [str(i) for i in range(3, 60, 6)]
    without_them = mix_to_targets(docs, labels, {"new": 1.0, "old": 0.0}, of=F.col("kind"), ban=True).toPandas()
    assert len(without_them) == 62 and (without_them[without_them.doc_id.isin(barred)].rate == 0).all()
    banned = mixed_documents(docs, labels, {"new": 1.0, "old": 0.0}, of=F.col("kind"), ban=True)
    assert banned.count() == int((without_them.copies > 0).sum()) and banned.where(F.col("doc_id").isin(barred)).isEmpty()
    kept = mixed_documents(docs, labels, {"new": 1.0, "old": 0.0}, of=F.col("kind"))
    assert kept.columns == ["doc_id", "text", "rate", "copies"] and dict(kept.dtypes)["rate"] == "double"
    assert kept.where("copies < 1").count() == 0 and kept.count() == int((got.copies > 0).sum())
