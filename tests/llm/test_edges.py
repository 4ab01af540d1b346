"""Nulls, ties, repeated rows, very long texts, ids of any type and clashing columns, for each operator and stage; and the two
classifiers against plain Python."""

import base64
import hashlib
import math
import re
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pyspark.sql.types as T
import pytest
from pyspark.sql import functions as F
from skyfix.llm.bayes import BUCKETS, ORDERS, language_ids
from skyfix.llm.chat import format_chats, read_chats
from skyfix.llm.decontamination import decontaminate
from skyfix.llm.html_text import extract
from skyfix.llm.mixing import mix_to_targets
from skyfix.llm.ngram_join import ngram_components
from skyfix.llm.quality_model import quality_scores
from skyfix.llm.repetition import quality_rules
from skyfix.llm.shared import cut, lookup, tidy, without
from skyfix.llm.url_filter import judge_urls
from skyfix.llm.warc import archive_round_trip

SF = "/root/testdata/sf0.001"
#: Names that operators use inside, as columns of the input.
CLASHES = [
    "id", "key_a", "key_b", "n", "told", "found", "verdict", "measured", "score", "predicted", "held_out", "tokens", "p", "banned", "rate",
    "copies", "h", "g", "prints", "class_id", "grams", "text_", "may_be_key", "mix_verdict", "language_verdict",
]


def with_clashes(df):
    return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHES) if c not in df.columns))


def string_docs(spark):
    long = " ".join(f"word{i % 977}" for i in range(150_000))
    rows = [
        ("a", "one two three four five six seven eight", "en"), ("a", "one two three four five six seven eight", "en"), ("b", None, None),
        (None, "one two three four five six seven eight", "fr"), ("c", "", "en"), ("d", long, "en"), ("e", long + " end", "en"),
        ("a", "another text under a known name", "fr"), (None, None, None),
    ]
    return rows, with_clashes(spark.createDataFrame(rows, "doc_id string, text string, lang string"))


def test_operators_on_documents(spark):
    rows, docs = string_docs(spark)
    labels = with_clashes(spark.createDataFrame([("a", 1, 0), ("c", 0, 0), ("d", 1, 1), ("zz", 0, 0), (None, 1, 1)], "doc_id string, quality int, toxic int"))
    items = with_clashes(
        spark.createDataFrame(
            [
                ("i1", "two three four"), ("i2", "two three four"), (None, "six seven"), ("i3", None),
                ("i4", " ".join(f"word{i}" for i in range(500, 520))),
            ],
            "item_id string, text string",
        )
    )
    got = sorted(map(tuple, ngram_components(docs).collect()), key=str)
    assert got == sorted(
        [
            ("a", 4, "a"), ("a", 4, "a"), ("b", 0, "b"), (None, 4, None), ("c", 0, "c"), ("d", 977, "d"), ("e", 978, "d"), ("a", 2, "a"),
            (None, 0, None),
        ],
        key=str,
    )
    hits = sorted(((r.doc_id or "", r.n_words, r.n_hit, ",".join(r["items"])) for r in decontaminate(docs, items).collect()))
    long_hit = sum(500 <= i % 977 < 520 for i in range(150_000))
    assert hits == sorted(
        [("a", 8, 5, "i1,i2")] * 2 + [
            ("b", 0, 0, ""), ("", 8, 5, "i1,i2"), ("c", 0, 0, ""), ("d", 150_000, long_hit, "i4"), ("e", 150_001, long_hit, "i4"),
            ("a", 6, 0, ""), ("", 0, 0, ""),
        ]
    )
    assert Counter(r.doc_id for r in quality_rules(docs).collect()) == Counter(r[0] for r in rows)
    for out in (language_ids(docs), quality_scores(docs, labels), mix_to_targets(docs, labels)):
        assert Counter(r.doc_id for r in out.collect()) == Counter(r[0] for r in rows)
    ones = {tuple(r)[1:] for r in quality_scores(docs, labels).where("doc_id = 'a' and score is not null").collect()}
    assert len(ones) <= 2  # equal texts have equal scores


def test_operators_on_pages(spark):
    page = "<article><p>" + "Some words that go on and on, as pages do. " * 40_000 + "</p></article>"
    rows = [
        ("p1", "http://casino.com/x", page), ("p1", "http://casino.com/x", page), ("p2", None, None), (None, "u", page),
        ("p3", "http://a.net/", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    pages = pages.select(
        "*",
        *(F.lit("x").alias(c) for c in ("id", "found", "host", "path", "rule", "hit", "payload", "digest", "bytes", "refers", "key_a", "value", "same")),
    )
    got = sorted((r.page_id or "", r.n_chars) for r in extract(pages).collect())
    n = len("Some words that go on and on, as pages do. " * 40_000) - 1
    assert got == [("", n), ("p1", n), ("p1", n), ("p2", 0), ("p3", 0)]
    assert sorted((r.page_id or "", r.verdict) for r in judge_urls(pages).collect()) == [
        ("", "allow"), ("p1", "block"), ("p1", "block"), ("p2", "allow"), ("p3", "block"),
    ]
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {"p1": ("response", None), "p2": ("response", None), "": ("response", None), "p3": ("revisit", "p2")}
    assert sorted((r.page_id or "", r.payload_digest, r.record_type, str(r.refers_to)) for r in archive_round_trip(pages).collect()) == sorted((i or "", digest(h), kinds[i or ""][0], str(kinds[i or ""][1])) for i, _, h in rows)


def test_chats_with_names_as_ids(spark):
    rows = [("c", 1, "user", "a"), ("c", 1, "user", "a"), ("c", 2, "assistant", "z" * 60_000), (None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    turns = turns.select(
        "*",
        *(F.lit(1).alias(c) for c in ("conv", "chunk", "window", "head", "body", "tokens", "starts", "all", "w", "again", "upto", "parts")),
    )
    got = {r.conv_id: r for r in read_chats(format_chats(turns)).collect()}
    assert [t.text for t in got["c"].turns] == ["a", "a", "z" * 60_000] and len(got["c"].loss_text) == 60_000 and [tuple(t) for t in got[None].turns] == [("", "")]


def test_languages_tie_by_name(spark):
    rows = [(i, "same words here", lang, i) for i, lang in enumerate(["fr", "de", "en"] * 6)]
    found = {r.lang_pred for r in language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").where("doc_id in (0, 1, 2, 3, 4, 5, 6, 7, 8)")).collect()}
    assert len(found) == 1


def mixed(x):
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def grams_of(text):
    text = re.sub(
        r" +", " ",
        "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 and ord(c) < 0x590 else c if c.isalpha() else " " for c in text or ""),
    )
    text, out = text.removeprefix(" "), []
    for n in ORDERS:
        for i in range(len(text) - n + 1):
            h = ord(text[i]) + n
            for c in text[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) & ((1 << 64) - 1)
            out.append(mixed(h) % BUCKETS)
    return out


def test_languages_against_plain_bayes(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    rows = docs.select("doc_id", "text", "lang").collect()
    counts, n_docs = {}, Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            counts.setdefault(r.lang, Counter()).update(grams_of(r.text))
            n_docs[r.lang] += 1
    total = {k: sum(c.values()) + 0.5 * BUCKETS for k, c in counts.items()}
    got = {r.doc_id: r for r in language_ids(docs).collect()}
    for r in rows[:120]:
        if not re.search(r"[^\W\d_]", r.text or ""):
            continue
        log = {k: math.log(n_docs[k] / sum(n_docs.values())) + sum(math.log((c[g] + 0.5) / total[k]) for g in grams_of(r.text)) for k, c in counts.items()}
        best = max(sorted(log), key=log.get)
        score = 1 / sum(math.exp(v - log[best]) for v in log.values())
        assert got[r.doc_id].lang_pred == best and abs(got[r.doc_id].score - score) < 1e-3


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    chars, n = max(sum(map(len, words)), 1), max(len(words), 1)
    count = lambda pattern: len(re.findall(pattern, text))
    known = count(r"[#*$%&|<>]") + count("[A-Za-z0-9]") + count(r"[.,;:'\"\-()?]") + count("!")
    high = len(re.sub(r"[\x00-\x7F]", "", text).encode()) // 2
    lengths = [len(w) for w in words]
    mean = sum(lengths) / n
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        own = len(re.sub(r"[\x20\x09-\x0D]", "", line))
        dup += own if own and line in seen else 0
        seen.add(line)
    share = lambda x, y: math.sqrt(min(max(x / y, 0), 1))
    return [
        share(count(r"[#*$%&|<>]"), chars), share(count("[A-Z]"), chars), share(count("[0-9]"), chars), share(count(r"[.,;:'\"\-()?]"), chars), share(count("!"), chars), share(max(chars - known - high, 0), chars),
        math.log1p(mean), math.log1p(math.sqrt(max(sum(x * x for x in lengths) / n - mean**2, 0))), len(set(words)) / n, share(len(repeat), n), share(dup, chars),
        share(sum(w[-1] in "#*$%&|<>!" for w in words), n), share(max(Counter(words).values(), default=0), n), share(sum(len(w) == 1 for w in words), n),
    ]


def test_quality_against_plain_densities(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs.collect()}
    learnt = [(x[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in x]
    parts = [np.array([v for v, y in learnt if y == k]) for k in (0, 1)]
    covs = [np.cov(p.T, bias=True) for p in parts]
    pooled = sum(len(p) * c for p, c in zip(parts, covs)) / len(learnt)

    def density(v, k):
        cov = 0.9 * covs[k] + 0.1 * pooled
        cov = cov + 1e-3 * np.trace(cov) / len(cov) * np.eye(len(cov))
        d = v - parts[k].mean(0)
        return math.log(len(parts[k]) / len(learnt)) - 0.5 * (np.linalg.slogdet(cov)[1] + d @ np.linalg.solve(cov, d))

    for r in quality_scores(docs, labels).collect():
        odds = density(x[r.doc_id], 0) - density(x[r.doc_id], 1)
        assert abs(r.score - 1 / (1 + math.exp(min(max(odds, -700), 700)))) < 1e-4


def test_long_key_tables_and_hot_keys(spark, monkeypatch):
    import skyfix.llm.shared as shared

    rows = spark.range(3000).select(
        "id", F.when(F.col("id") < 1000, 7).when(F.col("id") < 1100, None).otherwise(F.col("id")).alias("k"),
        F.lit("t").alias("may_be_key"),
    )
    keys = spark.range(3000).where("id % 3 = 0").select(F.col("id").alias("k"))
    expect = sorted(r.id for r in rows.collect() if r.k is None or r.k % 3)
    for limit in (48 << 20, 0):
        monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
        left = without(rows, keys, ["k"])
        assert left.columns == rows.columns and sorted(r.id for r in left.collect()) == expect
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    right = cut(spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "right")
    with tidy(spark):
        found = {r.id: r.v for r in lookup(cut(rows, "rows"), right, "k").collect()}
    assert found == {r.id: None if r.k is None else 2 * r.k for r in rows.collect()}


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.mark.parametrize("stage", [name for name, _ in P.STAGES])
def test_stages_on_odd_rows(spark, stage):
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clean = some.where("doc_id is not null").limit(1).first()
    rows = [
        (None, clean.text, "en", "s", 1), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0),
        (clean.doc_id, clean.text, clean.lang, clean.source, clean.n_chars), (10**6 + 2, "x " * 60_000, "en", "s", 1),
    ]
    docs = with_clashes(some.unionByName(spark.createDataFrame(rows, SCHEMA)))
    out = dict(P.STAGES)[stage](spark, docs, SF)
    want = [c for c in docs.columns if c not in ("rate", "copies")] + ["rate", "copies"] if stage == "source_mixing" else docs.columns
    assert out.columns == want
    before, after = Counter((r.doc_id, r.text) for r in docs.collect()), Counter((r.doc_id, r.text) for r in out.collect())
    assert not after - before
    if stage == "ngram_jaccard_join":
        assert after[(clean.doc_id, clean.text)] <= 1 and after[(None, clean.text)] == 1 and after[(10**6, None)] == 1
    else:  # each row by its own text
        assert (after[(None, clean.text)] == 1) == (after[(clean.doc_id, clean.text)] == 2) or stage == "source_mixing"
