"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of each text's k-word hashes the minimum of every `window` of consecutive ones is a fingerprint, kept with its position. Two
texts that share a span of k + window - 1 words share the fingerprint of that span, so the join of fingerprints misses no such
span. Each joined fingerprint is extended where it stands: the spans around it are hashed from the words beside it and meet
the items' spans. No text is read a second time for that, and none moves.

Items with fewer words than a span are one span of their own length. Those of k words and more are found by the smallest of
their k-word hashes among all k-word hashes of a text, shorter ones by the hash of all their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, maybe_broadcast, row_keys, tidy

#: Bytes that part words, after lower-casing A-Z; fixed by the task.
PARTERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = "cast(array() as array<bigint>)"


def words_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), PARTERS), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def gram_hash(n: int, at: str) -> str:
    """SQL for the hash of the n words of `h` from position `at`."""
    return "xxhash64(" + ", ".join(f"get(h, {at} + {j})" for j in range(n)) + ")"


def gram_hashes(n: int) -> Column:
    """Hashes of each n consecutive words of `h`, by position."""
    return F.expr(f"if(size(h) < {n}, {_NONE}, transform(sequence(0, size(h) - {n}), i -> {gram_hash(n, 'i')}))")


def fingerprints(rows: DataFrame, k: int, window: int) -> DataFrame:
    """rows with the word hashes `h`, plus `g`, their k-word hashes, and `prints` (at, print): those k-word hashes that are the
    minimum of some window of consecutive ones. A text with fewer than a window of them has the minimum of all it has."""
    least = ", ".join(f"coalesce(get(g, i + {j}), {2**63 - 1}L)" for j in range(window))
    most = ", ".join(f"coalesce(get(m, p - {j}), {-(2**63) + 1}L)" for j in range(window))
    rows = rows.select("*", gram_hashes(k).alias("g"))
    rows = rows.select(
        "*", F.expr(f"if(size(g) = 0, {_NONE}, transform(sequence(0, greatest(size(g) - {window}, 0)), i -> least({least})))").alias("m"),
    )
    chosen = f"filter(sequence(0, greatest(size(g) - 1, 0)), p -> get(g, p) = greatest({most}))"
    return rows.select("*", F.expr(f"transform({chosen}, p -> struct(p as at, get(g, p) as print))").alias("prints")).drop("m")


def _spans(items: DataFrame, lengths: list[int], span: int) -> DataFrame:
    """(item, n, key): the hashes of all spans of all items."""
    parts = [items.where(f"n >= {span}").select("item", F.lit(span).alias("n"), F.explode_outer(gram_hashes(span)).alias("key"))]
    parts += [items.where(f"n = {n}").select("item", "n", F.expr(gram_hash(n, "0")).alias("key")) for n in lengths if n < span]
    return reduce(DataFrame.unionByName, parts).distinct()


def _anchors(items: DataFrame, lengths: list[int], span: int, k: int, window: int) -> DataFrame:
    """(way, n, low, high, print): what to look for. way: among the fingerprints (`print`), all k-word hashes (`all`) or all
    n-word hashes (`short`) of a text; an item's span of n words may start low to high words before the place of the hit."""
    longs = fingerprints(items.where(f"n >= {span}"), k, window).select(F.explode_outer("prints").alias("p")).select(F.col("p.print").alias("print"))
    parts = [longs.select(F.lit("print").alias("way"), F.lit(span).alias("n"), F.lit(0).alias("low"), F.lit(window - 1).alias("high"), "print")]
    if any(k <= n < span for n in lengths):
        middle = items.where(f"n >= {k} and n < {span}").select("n", gram_hashes(k).alias("g")).select("n", F.array_min("g").alias("print"), "g")
        at = (F.array_position("g", F.col("print")) - 1).cast("int")
        parts.append(middle.select(F.lit("all").alias("way"), "n", at.alias("low"), at.alias("high"), "print"))
    parts += [items.where(f"n = {n}").select(F.lit("short").alias("way"), "n", F.lit(0).alias("low"), F.lit(0).alias("high"), F.expr(gram_hash(n, "0")).alias("print")) for n in lengths if n < k]
    return reduce(DataFrame.unionByName, parts).where("print is not null").distinct()


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, span: int, k: int,
) -> DataFrame:
    """(key_a, key_b, n_hit, items): for each row of docs with a hit, by its row keys. A written table."""
    window = span - k + 1
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), word_hashes(F.col(item_text).cast("string")).alias("h"))
    items = cut(items.select("*", F.size("h").alias("n")).where("n > 0"), "items")
    lengths = sorted(r.n for r in items.select(F.least("n", F.lit(span)).alias("n")).distinct().collect())  # at most `span` of them
    spans = cut(_spans(items, lengths, span), "spans")
    anchors = cut(_anchors(items, lengths, span, k, window), "anchors")
    n_spans, n_anchors = spans.count(), anchors.count()

    rows = docs.select(*row_keys(id_col, text_col), word_hashes(F.col(text_col).cast("string")).alias("h"))
    # explode_outer, not explode: its filter for empty arrays would make all hashes twice.
    place = lambda hashes: F.transform(hashes, lambda g, at: F.struct(at.alias("at"), g.alias("print")))
    ways = []
    if span in lengths:
        ways.append(("print", None, fingerprints(rows, k, window).select("key_a", "key_b", "h", F.explode_outer("prints").alias("p"))))
    if any(k <= n < span for n in lengths):
        ways.append(("all", None, rows.select("key_a", "key_b", "h", F.explode_outer(place(gram_hashes(k))).alias("p"))))
    ways += [("short", n, rows.select("key_a", "key_b", "h", F.explode_outer(place(gram_hashes(n))).alias("p"))) for n in lengths if n < k]
    hits = []
    for way, length, found in ways:
        known = anchors.where(F.col("way") == way).where(F.lit(True) if length is None else F.col("n") == length).drop("way")
        found = found.select("key_a", "key_b", "h", "p.at", "p.print").where("print is not null")
        few = maybe_broadcast(known, n_anchors, 40)
        if few is known:  # too many to send: what is shuffled takes only the words around its place along
            reach = span - 1
            low = F.greatest(F.col("at") - reach, F.lit(0))
            found = found.select("key_a", "key_b", "print", "at", low.alias("base"), F.slice("h", low + 1, F.lit(2 * reach + 1)).alias("h"))
        else:
            found = found.withColumn("base", F.lit(0))
        found = found.join(few, "print")
        starts = F.sequence(F.greatest(F.col("at") - F.col("high"), F.lit(0)), F.col("at") - F.col("low"))
        found = found.where(F.col("at") >= F.col("low")).select("key_a", "key_b", "n", "base", "h", F.explode_outer(starts).alias("start"))
        found = found.where(F.col("start") - F.col("base") + F.col("n") <= F.size("h"))
        sizes = [n for n in lengths if (n == span if way == "print" else k <= n < span if way == "all" else n == length)]
        key = reduce(
            lambda rest, n: F.when(F.col("n") == n, F.expr(gram_hash(n, "start - base"))).otherwise(rest), sizes, F.lit(None).cast("long"),
        )
        found = found.select("key_a", "key_b", "n", "start", key.alias("key"))
        hits.append(found.join(maybe_broadcast(spans, n_spans, 200), ["n", "key"]).select("key_a", "key_b", "start", "n", "item"))
    if not hits:
        return cut(
            rows.limit(0).select(
                "key_a", "key_b", F.lit(0).cast("long").alias("n_hit"), F.expr("cast(array() as array<string>)").alias("items"),
            ),
            "hits", keep=True,
        )
    hits = reduce(DataFrame.unionByName, hits).distinct()
    packed = hits.groupBy("key_a", "key_b").agg(
        F.collect_set(F.struct("start", "n")).alias("places"), F.sort_array(F.collect_set("item")).alias("items"),
    )
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["n"] - 1))))
    return cut(packed.select("key_a", "key_b", F.size(covered).cast("long").alias("n_hit"), "items"), "hits", keep=True)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    span: int = 10,
    k: int = 5,
) -> DataFrame:
    """For every row of docs: id, n_words, n_hit (words inside an occurrence of some item's span), n_items (items of which
    some span occurs), items (their ids, sorted as strings), contaminated (n_hit > 0).

    A span is `span` consecutive words of an item; an item of fewer words, but not none, is one span. Null and empty texts
    have no words, on either side. Items with equal texts or ids each count; items without id make hits and are not listed.
    Every row is judged by its own text: rows that repeat an id, or have none, do not share hits unless their texts are equal.
    Ids may have any type. Other columns are ignored, whatever their names; an empty table on either side gives what is left.
    k must be below span; the fingerprint window is span - k + 1. Words, spans and rows are told apart by 64-bit hashes (rows
    by two).
    """
    with tidy(docs.sparkSession):
        hits = benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text, span, k)
    rows = docs.select(
        F.col(id_col), *row_keys(id_col, text_col), F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("n_words"),
    )
    known = maybe_broadcast(hits.withColumnsRenamed({"key_a": "hit_a", "key_b": "hit_b"}), *_size(hits))
    out = rows.join(known, (F.col("key_a") == F.col("hit_a")) & (F.col("key_b") == F.col("hit_b")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    listed = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select(
        F.col(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def _size(hits: DataFrame) -> tuple[int, int]:
    """Rows of the hits, and the bytes that one takes on average with its list of items."""
    n, items = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    return n, 64 + 40 * -(-items // max(n, 1))


def contaminated_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    span: int = 10,
    k: int = 5,
) -> DataFrame:
    """(key_a, key_b) of the rows of docs that decontaminate calls contaminated; see shared.drop_rows."""
    with tidy(docs.sparkSession):
        return benchmark_hits(docs, benchmark, id_col, text_col, item_col, item_text, span, k).select("key_a", "key_b")
