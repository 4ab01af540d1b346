"""Exact dedup by an exchange of Golomb-coded fingerprints.

The documents are written once in parts, each part by one task, with a short fingerprint of every text. A part sends the sorted
fingerprints of each owner's range as one Golomb-coded row, an owner answers each with a bitmap of those it met more than once,
and only the rows that a bitmap names, the suspects, move with their texts, to be compared byte by byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, delete, lookup, shared_dir, tidy

#: Rows of a part and fingerprints of an owner that the numbers of parts and owners aim at, and the most buckets of the parts' table.
PART_ROWS, OWNER_ROWS, MOST_PARTS = 400_000, 2_000_000, 50_000
#: Bits of a fingerprint beyond those that number the rows: so few texts are suspects by chance. The digest gives 60 at most.
SPARE_BITS, MOST_BITS = 16, 60


def golomb_encode(gaps: np.ndarray) -> bytes:
    """Gaps (integers from 0) in Golomb's code of a power of two near their mean: its exponent in a byte, then all quotients in
    unary and all remainders in binary, as bits."""
    if not len(gaps):
        return b"\0"
    k = max(0, int(np.log2(max(0.69 * float(gaps.mean()), 1.0))))
    quotients = (gaps >> k).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k, dtype=np.int64)) & 1).astype(np.uint8).ravel()
    return bytes([k]) + np.packbits(np.concatenate((unary, rest))).tobytes()


def golomb_decode(code: bytes, n: int) -> np.ndarray:
    """The n gaps of a code."""
    k, bits = code[0], np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(bits)[:n]  # the unary ends are the first n ones
    quotients = np.diff(ends, prepend=-1) - 1
    rest = bits[ends[-1] + 1 :][: n * k].reshape(n, k).astype(np.int64)
    return (quotients << k) + rest @ (np.int64(1) << np.arange(k, dtype=np.int64))


def _sent(prints: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """(part, owner, n, code): the different fingerprints of a part in an owner's range, sorted and coded."""

    def send(key, table):
        own = np.unique(table.column("print").to_numpy())
        owner = own >> (bits - owner_bits)
        edges = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = []
        for a, b in zip(edges, np.append(edges[1:], len(own)), strict=True):
            start = int(owner[a]) << (bits - owner_bits)
            rows.append((key[0].as_py(), int(owner[a]), int(b - a), golomb_encode(np.diff(own[a:b], prepend=start))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["part", "owner", "n", "code"])

    return prints.groupBy("part").applyInArrow(send, "part int, owner int, n int, code binary")


def _answered(sent: DataFrame) -> DataFrame:
    """(part, owner, seen): for each row sent, a bitmap in its order of the fingerprints that other parts sent too."""

    def answer(key, table):
        counts = table.column("n").to_numpy()
        every = np.concatenate([np.cumsum(golomb_decode(c.as_buffer().to_pybytes(), int(n))) for c, n in zip(table.column("code"), counts, strict=True)])
        _, back, times = np.unique(every, return_inverse=True, return_counts=True)
        again = times[back] > 1
        maps = [np.packbits(x).tobytes() for x in np.split(again, np.cumsum(counts)[:-1])]
        return pa.table([table.column("part"), table.column("owner"), pa.array(maps, pa.binary())], ["part", "owner", "seen"])

    return sent.groupBy("owner").applyInArrow(answer, "part int, owner int, seen binary")


def _suspects(prints: DataFrame, answers: DataFrame, bits: int, owner_bits: int) -> DataFrame:
    """(part, words): of each part a bit for each row in order, in words of 64, set where the row's fingerprint is met again, in
    the part itself or, as the bitmaps say, in another."""

    def mark(key, own, seen):
        own = own.sort_by("at")
        found, back, times = np.unique(own.column("print").to_numpy(), return_inverse=True, return_counts=True)
        again = times > 1
        owner = found >> (bits - owner_bits)
        for o, bitmap in zip(seen.column("owner").to_pylist(), seen.column("seen"), strict=True):
            a, b = np.searchsorted(owner, [o, o + 1])
            again[a:b] |= np.unpackbits(np.frombuffer(bitmap.as_buffer(), np.uint8))[: b - a].astype(bool)
        flags = np.zeros(-(-own.num_rows // 64) * 64, bool)
        flags[own.column("at").to_numpy()] = again[back]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(flags, bitorder="little").view(np.int64)])], ["part", "words"])

    return prints.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(mark, "part int, words array<bigint>")


def _in_parts(rows: DataFrame, parts: int, name: str, path: str) -> DataFrame:
    """rows with part and at (from 0, in order within it), written as a table that is bucketed by part, so that whatever meets it
    by part moves to where it lies. A part is what one task wrote; no row moves."""
    placed = rows.coalesce(parts).withColumn("_place", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("_place", 33).cast("int")).withColumn("at", F.col("_place").bitwiseAND((1 << 33) - 1).cast("int"))
    placed.drop("_place").write.bucketBy(parts, "part").option("path", path).saveAsTable(name)
    return rows.sparkSession.table(name)


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalized: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size (long), kept and text_sha256 (lowercase hex of the normalised text).

    Texts are equal if their normalised texts (`normalized`: from the text column to a string column; nothing changes without)
    are, byte by byte; a null text is an empty one, and empty texts are equal. Of equal texts the row with the largest id stays;
    null is the smallest id. Where rows share that id too, exactly one of them stays, whichever it is. Ids may repeat and be of
    any type that has an order; other columns are ignored, whatever their names; an empty table gives none.

    What moves: a few bytes a fingerprint and a bit back, and the texts of suspects, combined by the tasks that read them, so a
    group of any size arrives as a row a task. Fingerprints that collide cost a comparison, never a wrong group.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = F.coalesce(normalized(text).cast("string"), F.lit("")) if normalized else text
    rows = docs.select(F.col(id_col).alias("id"), text.cast("binary").alias("bytes")).withColumn("sha", F.sha2("bytes", 256))
    name = f"dedup_parts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    with tidy(spark):
        n, shuffles = docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        parts = max(shuffles, min(MOST_PARTS, -(-n // PART_ROWS)))
        bits = min(MOST_BITS, n.bit_length() + SPARE_BITS)
        owner_bits = min(bits, max(2 * shuffles, -(-n // OWNER_ROWS)).bit_length())
        short = F.shiftright(F.conv(F.substring("sha", 1, MOST_BITS // 4), 16, 10).cast("bigint"), MOST_BITS - bits)
        try:
            table = _in_parts(rows.withColumn("print", short), parts, name, path)
            prints = table.select("part", "at", "print")
            answers = _answered(_sent(prints.select("part", "print"), bits, owner_bits))
            marks = cut(_suspects(prints, answers, bits, owner_bits), "dedup-marks").hint("shuffle_hash")
            word = F.element_at("words", F.shiftright("at", 6) + 1)
            told = table.join(marks, "part").withColumn("suspect", F.getbit(word, F.col("at") % 64) == 1)
            # Grouping by the bytes compares them; each task sends a text once, whatever its copies there.
            classes = told.where("suspect").groupBy("bytes", "sha").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
            classes = cut(classes.where("group_size > 1").select("sha", "keep_id", "group_size"), "dedup-classes")
            place = F.shiftleft(F.col("part").cast("bigint"), 32) + F.col("at")
            keys = cut(told.select("id", "sha", "suspect", place.alias("place")), "dedup-keys")
        finally:
            spark.sql(f"drop table if exists {name}")
            delete(spark, path)
        alone = keys.where("not suspect").select("id", F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "sha")
        found = lookup(keys.where("suspect"), classes, "sha")
        size = F.coalesce("group_size", F.lit(1).cast("bigint"))
        found = found.select("id", F.when(size > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), size.alias("group_size"), "sha", "place")
        found = found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
        # Rows that share text and id: the last by place stays.
        row = F.concat_ws(":", "sha", F.col("id").cast("string"))
        again = keys.where("suspect").groupBy(row.alias("row")).agg(F.max("place").alias("last"), F.count("*").alias("times"))
        again = cut(again.where("times > 1").select("row", "last"), "dedup-again")
        if not again.isEmpty():
            found = lookup(cut(found.withColumn("row", row), "dedup-found"), again, "row")
            found = found.withColumn("kept", F.col("kept") & F.coalesce(F.col("place") == F.col("last"), F.lit(True)))
        out = alone.unionByName(found.select(alone.columns))
        return cut(out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")), "dedup", keep=True)
