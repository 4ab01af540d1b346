"""Phrase collocations, exact dedup and fill-in-middle against plain Python, and their odd cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from skyfix.llm import collocations as phrases
from skyfix.llm import exact_dedup as dedup
from skyfix.llm.fill_middle import UNIT, fill_in_middle, restored, unit_ends


def _plain_collocations(rows, least):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    good = {k: c for k, c in counts.items() if c >= least}
    out = []
    for (lang, p), a in good.items():
        if len(p) < 2:
            continue
        inside = any(g == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (g, q), c in good.items())
        score, k = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        if not inside:
            out.append((lang, " ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], n[lang], score))
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"BROADCAST_BYTES": 0, "HOT_ROWS": 4, "MOST_HOT": 10**9, "GATHERED": 50}, {"HOT_ROWS": 3, "MOST_HOT": 10**9, "FLUSH_BYTES": 300}])
def test_collocations_match_plain_counts(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(phrases, name, value)
    rng = np.random.default_rng(5)
    vocabulary = ["Aa", "b", "ç", "d d", "e-e", "f", "aa"]
    rows = [(" ".join(rng.choice(vocabulary, 40, p=[0.4, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05])) + ".\tb ç;\nAa b ç d", ["en", None, "a\tb"][i % 3]) for i in range(40)]
    rows += [(None, "en"), ("", None), ("  ,;. \n", "en"), ("alone", "de")] + [("New  York\tcity hall", "de")] * 9
    df = spark.createDataFrame([(*r, "x") for r in rows], "text string, lang string, phrase string").repartition(3)
    found = phrases.collocations(df, least=9, top=None)
    assert sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect()) == _plain_collocations(rows, 9)
    top = phrases.collocations(df, least=9, top=2).where("lang = 'und'").orderBy("rank").collect()
    want = sorted((r for r in _plain_collocations(rows, 9) if r[0] == "und"), key=lambda r: (-r[6], -r[2], r[1].encode()))[:2]
    assert [(r.rank, r.phrase) for r in top] == [(i + 1, w[1]) for i, w in enumerate(want)]


def test_collocation_scores_pass_64_bits(spark):
    found = spark.createDataFrame([("x", "a b", 2, 10**13), ("x", "a", 1, 3 * 10**13), ("x", "b", 1, 2 * 10**13)], "lang string, phrase string, size int, times bigint")
    totals = spark.createDataFrame([("x", 10**15)], "lang string, n bigint")
    assert phrases._rated(found, totals).first().score == 1000 * 10**13 * 10**15 // (6 * 10**26)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_equal_parts_count_all_prefixes():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 4, (500, 3)).astype(np.int32)
    rows[:, 1:] *= rows[:, :1] > 0
    rows[:, 2] *= rows[:, 1] > 0
    times = rng.integers(1, 5, 500)
    want = Counter()
    for row, t in zip(rows.tolist(), times.tolist(), strict=True):
        for d in range(1, 4):
            if all(row[:d]):
                want[tuple(row[:d])] += t
    for least, first in ((1, 1), (30, 2)):
        at, depth, count = phrases.equal_parts(rows, times, least, first)
        assert {tuple(rows[a, :d].tolist()): c for a, d, c in zip(at, depth, count, strict=True)} == {k: c for k, c in want.items() if c >= least and len(k) >= first}
        assert len(at) == len({tuple(rows[a, :d].tolist()) for a, d in zip(at, depth, strict=True)})


@pytest.mark.parametrize("gaps", [[], [0], [0, 0, 0], [5, 1 << 40, 0], list(range(100)), [1 << 59]])
def test_golomb_code_comes_back(gaps):
    gaps = np.array(gaps, np.int64)
    assert dedup.golomb_decode(dedup.golomb_encode(gaps), len(gaps)).tolist() == gaps.tolist()


def _plain_groups(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(t or "", []).append(i)
    some = {t: [i for i in ids if i is not None] for t, ids in texts.items()}
    return {t: (max(some[t], default=None), len(ids)) for t, ids in texts.items()}


@pytest.mark.parametrize("bits", [None, 4])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_exact_duplicates_match_plain_groups(spark, monkeypatch, kind, bits):
    if bits:
        monkeypatch.setattr(dedup, "SPARE_BITS", -bits)  # almost every fingerprint collides: bytes decide
    rows = [(i, ["same", "same ", None, "", "ü" * 9000][i % 5] if i % 3 else f"own {i}") for i in range(200)]
    rows += [(7, "twice"), (7, "twice"), (7, "twice"), (3, "twice"), (None, "twice"), (None, "nobody"), (None, "nobody"), (500, "other")]
    rows = [(None if i is None else i if kind == "bigint" else f"{i:04d}", t) for i, t in rows]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], f"doc_id {kind}, text string, keep_id int, kept string").repartition(5)
    out = dedup.exact_duplicates(df).collect()
    groups = _plain_groups(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    assert len(out) == len(rows)
    assert all((r.keep_id, r.group_size) == by_sha[r.text_sha256] for r in out)
    stays = Counter(r.text_sha256 for r in out if r.kept)
    assert stays == Counter(dict.fromkeys(by_sha, 1)) and all(r.doc_id == r.keep_id for r in out if r.kept)


def test_exact_duplicates_of_changed_texts_and_none(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "ab")], "doc_id int, text string")
    out = dedup.exact_duplicates(df, normalized=lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))).collect()
    assert {r.doc_id: (r.keep_id, r.kept) for r in out} == {1: (2, False), 2: (2, True), 3: (3, True)}
    assert dedup.exact_duplicates(df.where("doc_id > 9")).count() == 0


def test_parts_stay_where_they_are(spark):
    """Neither the table of texts nor its fingerprints are shuffled to meet what is told by part."""
    path = f"{dedup.shared_dir(spark)}/parts-test"
    table = dedup._in_parts(spark.range(100).select("id", F.lit(b"x").alias("bytes")), 8, "parts_test", path)
    try:
        marks = spark.createDataFrame([(0, [1])], "part int, words array<bigint>").hint("shuffle_hash")
        plan = table.join(marks, "part")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    finally:
        spark.sql("drop table parts_test")
        dedup.delete(spark, path)


_TEXTS = ["", None, "one", "one\n", "\n\n\n", "a\nb\nc", "é\n😀😀\nz" * 50, "has <P> inside\nx", "<\n<P\nP>\nS>", "x" * 200_000, "line\n" * 50_000, "\r\n a"]


@pytest.mark.parametrize("options", [{}, {"spm_percent": 0}, {"spm_percent": 100}, {"fim_percent": 40}])
def test_fill_in_middle_matches_plain_python(spark, options):
    rows = [(i, _TEXTS[i % len(_TEXTS)]) for i in range(60)] + [(5, "same\nid"), (None, "no\nid\n")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id int, text string, form string")
    out = restored(fill_in_middle(df, **options)).collect()
    assert sorted(r.restored for r in out) == sorted(t or "" for _, t in rows)
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    want = Counter()
    for i, t in rows:
        t = t or ""
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * j : 8 * j + 8], 16) for j in range(4))
        units = re.findall(r"[^\n]*\n|[^\n]+", t)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= options.get("fim_percent", 100):
            want[i, n, "plain", None, None, t] += 1
        elif h4 % 100 < options.get("spm_percent", 50):
            want[i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"] += 1
        else:
            want[i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"] += 1
    assert got == want


def test_fill_in_middle_units(spark):
    assert unit_ends("ab\n\nc", regex.compile(f"({UNIT})*+")) == [3, 4, 5]
    with pytest.raises(ValueError):
        unit_ends("ab", regex.compile("(a)*"))
    assert fill_in_middle(spark.createDataFrame([], "doc_id int, text string")).count() == 0
