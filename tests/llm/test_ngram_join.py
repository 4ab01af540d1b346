import random
import re

import pyspark.sql.types as T
from skyfix.llm.ngram_join import ngram_components, ngram_links

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, words=5, percent=75):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = set()
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                links.add((i, j))
                up[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[root(i)] = min(best.get(root(i), d), d)
    return {d: (len(sets[i]), best[root(i)]) for i, (d, _) in enumerate(rows)}, {(a, b) for a, b in links if sets[a] != sets[b]}


def corpus(seed, n=220):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    passage = [rnd.choice(vocab) for _ in range(25)]
    texts, rows = [], []
    for i in range(n):
        kind = rnd.random()
        if texts and kind < 0.5:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 4)):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
        else:
            words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 4, 5, 6, 30, 80]))]
            if kind > 0.8:
                words = words[:10] + passage + words[10:]
        texts.append(" ".join(words))
        rows.append((1000 - i * 3, rnd.choice([texts[-1], texts[-1].upper(), texts[-1].replace(" ", "\n\t", 1)])))
    return rows


def test_components_match_brute_force(spark):
    rows = corpus(1) + [(5000, None), (5001, ""), (5002, " \n\t"), (5003, "é É ñ"), (5004, "é É ñ"), (5005, "É é ñ")]
    expect, links = brute(rows)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n string, class_id int").repartition(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()}
    assert got == expect
    pairs, members = ngram_links(docs)
    of = {r.class_id: r.id for r in members.collect()}
    assert pairs.count() == pairs.distinct().count() > 20
    sets_of = {d: i for i, (d, _) in enumerate(rows)}
    classes = {r.id: r.class_id for r in members.collect()}
    assert {(r.a, r.b) for r in pairs.collect()} == {tuple(sorted((classes[rows[i][0]], classes[rows[j][0]]))) for i, j in links}
    assert set(of.values()) <= set(sets_of)


def test_large_group_is_cut_into_blocks(spark, monkeypatch):
    import skyfix.llm.ngram_join as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 7)
    monkeypatch.setattr(m, "FRAGMENT", 50)
    monkeypatch.setattr(m, "SLICE", 100)
    monkeypatch.setattr(m, "PIECE", 16)
    rows = corpus(2, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs).collect()} == brute(rows)[0]


def test_repeats_nulls_and_empty_tables(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    assert ngram_components(spark.createDataFrame([], schema)).collect() == []
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text), (3, text), (1, text), (None, text), (None, None), (7, None), (8, "x " * 30000), (9, "x " * 29000)]
    got = sorted(map(tuple, ngram_components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(3, 36, 1), (3, 36, 1), (1, 36, 1), (None, 36, None), (None, 0, None), (7, 0, 7), (8, 1, 8), (9, 1, 8)], key=str)
