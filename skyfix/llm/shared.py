"""Helpers that several operators use: tables in the shared folder, joins with hot keys, and vectorised text handling."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import threading
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

U = np.uint64
#: Bytes of text that one numpy step takes at a time; a longer single text is a step of its own.
STEP_BYTES = 1 << 18
#: Rows and bytes of an Arrow batch at most: whole texts are long, and each batch is held by Spark and by Python at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Rows times bytes up to which a table may be broadcast; beyond it the same join is shuffled.
BROADCAST_BYTES = 48 << 20
#: A key is hot with so many rows at least, and with one in so many of all rows: so hot keys are at most HOT_SHARE.
HOT_ROWS, HOT_SHARE = 64, 100_000

_written: contextvars.ContextVar[list | None] = contextvars.ContextVar("written", default=None)
_lock, _cleaning = threading.Lock(), {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares: spark.checkpoint.dir. Only a local session may lack it and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor loses nothing. Inside `tidy` the
    table goes when the block ends, but for those that the block's result reads (keep)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    paths = _written.get()
    if paths is not None and not keep:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """While it lasts, Spark removes the shuffle files of each finished query; after it, the tables cut inside it are gone.

    The session's setting comes back when the last block that runs in the session ends, so blocks may overlap in threads.
    """
    small_batches(spark)
    key = id(spark._jsparkSession)
    with _lock:
        users, old = _cleaning.get(key, (0, spark.conf.get(_CLEANUP)))
        _cleaning[key] = (users + 1, old)
        spark.conf.set(_CLEANUP, "true")
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        with _lock:
            users, old = _cleaning.pop(key)
            if users > 1:
                _cleaning[key] = (users - 1, old)
            else:
                spark.conf.set(_CLEANUP, old)
        for path in paths:
            delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends texts to Python in small Arrow batches, if it does not do so yet."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only for a table of a known size; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with the columns of right, which has one row for each key at most (left join; null keys match nothing).

    Rows of hot keys meet their row of right by a broadcast: hot keys are few, whatever the size of left. Rows without key
    stay where they are. The rest is shuffled. left is read several times, so it should be a written table.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_times"))
    hot = cut(counts.where(F.col("_times") >= max(HOT_ROWS, -(-left.count() // HOT_SHARE))).select(key), "hot-keys", keep=True)
    few = F.broadcast(hot)
    some = cut(right.join(few, key, "left_semi"), "hot-rows", keep=True)
    parts = [left.where(F.col(key).isNotNull()).join(few, key, "left_anti").join(right, key, "left")]
    parts.append(left.join(few, key, "left_semi").join(F.broadcast(some), key, "left"))
    parts.append(left.where(F.col(key).isNull()))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """key_a, key_b: two hashes of a row's id and text, which tell rows apart whatever their ids are."""
    text = F.col(text_col).cast("string")
    return [F.xxhash64(F.col(id_col), text).alias("key_a"), F.xxhash64(text, F.lit(7), F.col(id_col)).alias("key_b")]


def drop_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose row keys are not in keys (key_a, key_b), a written table; see without."""
    names = [spare_name(docs, n) for n in ("key_a", "key_b")]
    named = docs.select("*", *(k.alias(n) for k, n in zip(row_keys(id_col, text_col), names, strict=True)))
    return without(named, keys.toDF(*names), names).select(docs.columns)


#: Bits of a filter that tells most rows apart from a key table too large to send, at most and for each key, its hash functions,
#: and the tasks that make it.
FILTER_BITS, KEY_BITS, FILTER_HASHES, FILTER_PARTS = 1 << 27, 16, 4, 16


def without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose `on` columns are not in keys (a written table of these columns); nulls are in no table.

    Few keys are broadcast. Of many, a bit filter of fixed size is: rows that it tells apart stay where they are, and only
    those that may be in keys, texts and all, are shuffled to the exact test.
    """
    small = keys.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate(on)))
    same = [F.col(c) == F.col(f"_key_{i}") for i, c in enumerate(on)]
    if keys.count() * 24 * len(on) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), same, "left_anti")
    flag = spare_name(rows, "may_be_key")
    flagged = rows.select("*", _may_be(keys, on)(F.xxhash64(*on)).alias(flag))
    sure, unsure = flagged.where(~F.col(flag)).drop(flag), flagged.where(F.col(flag)).drop(flag)
    return sure.unionByName(unsure.join(small, same, "left_anti"))


def perhaps_among(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose `on` columns are in keys (a written table of these columns), and, where the keys are too many to send,
    some others that the bit filter takes for them. No row moves."""
    if keys.count() * 24 * len(on) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(keys.select(on)), on, "left_semi")
    return rows.where(_may_be(keys, on)(F.xxhash64(*on)))


def _may_be(keys: DataFrame, on: list[str]):
    """A function of key hashes: whether the bit filter of the keys has them."""
    bits = keys.sparkSession.sparkContext.broadcast(bit_filter(keys.select(F.xxhash64(*on).alias("h"))))

    def may(hashes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for h in hashes:
            places = bit_places(np.asarray(h).view(U), bits.value)
            yield pa.array(np.all((bits.value[places >> 3] >> (places & 7).astype(np.uint8)) & 1, axis=0))

    return F.arrow_udf(may, "boolean").asNondeterministic()


def bit_places(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of each 64-bit hash, its places in a bit filter; those of a key that the filter has are all set."""
    return np.stack([(mix(h + U(i)) % U(8 * len(bits))).astype(np.int64) for i in range(FILTER_HASHES)])


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """The bit filter of all hashes (h) of a written table, of KEY_BITS bits a row and FILTER_BITS at most: each task makes one
    of its rows, and the driver ors them, FILTER_PARTS of them."""
    size = min(FILTER_BITS, 1 << max(16, (KEY_BITS * hashes.count()).bit_length())) >> 3

    def make(batches):
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            places = bit_places(np.asarray(batch.column("h")).view(U), bits).ravel()
            np.bitwise_or.at(bits, places >> 3, (1 << (places & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    made = hashes.coalesce(FILTER_PARTS).mapInArrow(make, "bits binary")
    bits = np.zeros(size, np.uint8)
    for row in made.toLocalIterator():  # FILTER_PARTS arrays of FILTER_BITS at most, one at a time
        bits |= np.frombuffer(row["bits"], np.uint8)
    return bits


def spare_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_function(run, shape: str):
    """A function from a text column to a struct column of that shape, so that what it tells of a row stays with the row.

    run: from an Arrow string array to the struct's Arrow arrays in order; it gets slices of about STEP_BYTES of text.
    """
    names, kind = [f.name for f in StructType.fromDDL(shape)], to_arrow_type(StructType.fromDDL(shape))

    def apply(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            done = [pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in run(part)], names) for part in slices(array)]
            yield pa.concat_arrays(done) if done else pa.array([], kind)
            pa.default_memory_pool().release_unused()

    return F.arrow_udf(apply, shape).asNondeterministic()  # not to be run again for each place that the plan names it


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def separators(keep) -> np.ndarray:
    """A table of 256 flags: True for bytes that part words. Bytes of 0x80 and more belong to words."""
    return np.array([not (b >= 0x80 or keep(b)) for b in range(256)])


#: Words are runs of anything but the six ASCII white-space characters.
SPACES = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Texts:
    """Some rows of an Arrow string column as one byte array with row offsets."""

    def __init__(self, column: pa.Array, lower: bool):
        if column.null_count:
            column = column.fill_null("")
        offs = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)
        offs = offs[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        self.offs = offs - offs[0]
        self.bytes = _LOWER[raw] if lower else raw

    def words(self, sep: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of each word; no word crosses a row's end."""
        inside = ~sep[self.bytes]
        edge = np.zeros(len(inside) + 1, bool)
        edge[self.offs] = True
        before = np.concatenate(([False], inside[:-1])) if len(inside) else inside
        after = np.concatenate((inside[1:], [False])) if len(inside) else inside
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(self.offs, start, "right") - 1

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span [start, end); spans are in order and do not overlap."""
        return self.stems(start, end, ())[0]

    def stems(self, start: np.ndarray, end: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """The hashes of the spans, then for each size those of the first bytes of the spans that are longer, and which spans."""
        if not len(start):
            return [np.zeros(0, U), *((np.zeros(0, U), np.zeros(0, np.int64)) for _ in sizes)]
        size = end - start
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        weight = mix(np.arange(1, int(size.max()) + 1).astype(U)) | U(1)
        sums = np.concatenate(([U(0)], np.cumsum((self.bytes[at + np.repeat(start, size)].astype(U) + U(1)) * weight[at], dtype=U)))
        out = [mix(sums[first + size] - sums[first] + size.astype(U))]
        for k in sizes:
            some = np.flatnonzero(size > k)
            out.append((mix(sums[first[some] + k] - sums[first[some]] + U(k)), some))
        return out


def slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[pa.Array]:
    """Slices of a string array whose texts together have about `limit` bytes."""
    for a, b in _bounds(texts, limit):
        yield texts.slice(a, b - a)


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts together have about `limit` bytes."""
    for a, b in _bounds(batch.column(column), limit):
        yield batch.slice(a, b - a)


def _bounds(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    return [(a, b) for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True) if b > a]


#: Of the rolling hash: its odd base and the inverse of that, modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Rolling:
    """Hashes of all windows of any length over a row of word hashes: one pass of prefix sums, then a difference a window."""

    def __init__(self, words: np.ndarray):
        def powers(of: int) -> np.ndarray:
            return np.multiply.accumulate(np.concatenate(([U(1)], np.full(len(words), of, U))))

        self.sums = np.concatenate(([U(0)], np.cumsum(words * powers(BASE)[:-1], dtype=U)))
        self.shift = powers(INVERSE)

    def of(self, n: int) -> np.ndarray:
        """Hash of each n consecutive words, the order counting."""
        if n >= len(self.sums):
            return np.zeros(0, U)
        return mix((self.sums[n:] - self.sums[:-n]) * self.shift[: len(self.sums) - n] + U(n))
