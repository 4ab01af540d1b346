"""Phrase collocation mining by multikey three-way quicksort of suffix pointers.

Every word of a piece of text begins a suffix of up to five words. Suffixes are routed by their leading words (two, or more
where so few lead too many), so that a task has all suffixes that begin alike; there it parts pointers to them by one word after
another, less, equal and greater than a pivot. The weight of an equal part is the count of its words as a phrase; parts too
small to hold a candidate are abandoned. What is left are joins of frequent phrases with their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import BASE, BROADCAST_BYTES, STEP_BYTES, Texts, U, bit_filter, bit_places, cut, maybe_broadcast, mix, separators, slices, steps, tidy

#: Words of a candidate at most, its least count, and phrases of each language in the report.
DEPTH, LEAST, TOP = 5, 100, 2000
#: Pieces end at these bytes, words at these and at spaces and tabs.
_BREAKS = frozenset(b".,;:!?\n\x0b\x0c\r")
_BREAK = np.array([b in _BREAKS for b in range(256)])
_NO_WORD = separators(lambda b: b not in _BREAKS and b not in b" \t")
#: Bytes of text that a task splits into words at a time, suffixes that it packs at a time, and suffixes that a route aims at.
FLUSH_BYTES, GATHERED, ROUTE_ROWS = 3 << 20, 1_200_000, 2_000_000
#: Leading words are split further where they lead so many suffixes, a share of a route, or where so many of them could be met.
HOT_ROWS, MOST_HOT = ROUTE_ROWS // 8, 500_000
#: Bytes of a frequent word, about, as it is sent to all tasks where all of them are few enough.
WORD_BYTES = 64


class _Words:
    """The words of some rows: hash, language and text of each, and whether it follows the word before within a piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        lang_hash = _lang_hashes(self.langs)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        parts, rows, base = [], 0, 0
        for part in slices(texts, STEP_BYTES):
            t = Texts(part, lower=True)
            start, end, row = t.words(_NO_WORD)
            breaks = np.cumsum(_BREAK[t.bytes], dtype=np.int32)
            at = breaks[start] if len(start) else np.zeros(0, np.int32)
            follows = np.concatenate(([False], (row[1:] == row[:-1]) & (at[1:] == at[:-1])))[: len(start)]
            parts.append((t.hashes(start, end), code[rows + row], follows, start + base, end + base, t.bytes))
            rows, base = rows + len(part), base + len(t.bytes)
        join = lambda i, kind: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, kind)
        self.hash, self.lang, self.follows = join(0, U), join(1, np.int32), join(2, bool)
        self.start, self.end, self.bytes = join(3, np.int64), join(4, np.int64), join(5, np.uint8)
        # The same word of two languages is two words, told apart by hash.
        self.hash = mix(self.hash + lang_hash[self.lang]) | U(1)
        self.size = base

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, number of each word's hash, first word of each hash, times of each hash)."""
        hashes, first, number, times = np.unique(self.hash, return_index=True, return_inverse=True, return_counts=True)
        return hashes, number, first, times

    def strings(self, which: np.ndarray) -> pa.Array:
        """The texts of these words."""
        size = self.end[which] - self.start[which]
        offs = np.concatenate(([0], np.cumsum(size)))
        data = self.bytes[np.arange(offs[-1]) - np.repeat(offs[:-1] - self.start[which], size)]
        return pa.StringArray.from_buffers(len(which), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(data))

    def suffixes(self, number: np.ndarray) -> np.ndarray:
        """DEPTH columns: number (from 1) of each word and of those that follow it in its piece, 0 from where there is none and
        from a word of number 0."""
        out = np.zeros((len(number), DEPTH), np.int32)
        out[:, 0] = number
        run = np.cumsum(~self.follows)
        for d in range(1, DEPTH):
            same = (run[d:] == run[:-d]) & (out[: len(run) - d, d - 1] > 0)
            out[: len(run) - d, d] = np.where(same, number[d:], 0)
        return out


def _lang_hashes(langs: list[str]) -> np.ndarray:
    t = Texts(pa.array(langs, pa.string()), lower=False)
    return mix(t.hashes(t.offs[:-1], t.offs[1:])) if langs else np.zeros(1, U)


def _hashed(words: DataFrame) -> DataFrame:
    """(h): the hash that _Words gives to each (lang, phrase) of one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _Words(batch.column("phrase"), batch.column("lang")).hash
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["h"])

    return words.select("phrase", "lang").mapInArrow(run, "h bigint")


def _leading(suffixes: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the first 1, 2, .. DEPTH words of each suffix; an end counts as a word of hash 0."""
    known = np.concatenate(([U(0)], hashes))
    out = [known[suffixes[:, 0]]]
    for d in range(1, DEPTH):
        out.append(mix(out[-1] * U(BASE) + known[suffixes[:, d]]))
    return out


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """The words of the batches' rows (text, lang), about FLUSH_BYTES of text at a time; a longer text comes by itself."""
    held, size = [], 0
    for batch in batches:
        for part in steps(batch, "text", FLUSH_BYTES):
            held.append(part)
            size += part.nbytes
            if size >= FLUSH_BYTES:
                yield _words_of(held)
                held, size = [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _words_of(held)


def _words_of(held: list[pa.RecordBatch]) -> _Words:
    return _Words(*(pa.concat_arrays([part.column(c) for part in held]) for c in ("text", "lang")))


_COUNTED = "lang string, words array<string>, times array<bigint>, leading array<bigint>, load array<bigint>"


def _counted(rows: DataFrame, total_bytes: int, hot: float) -> DataFrame:
    """Of each flush and language: the words and their times; of each flush the leading two to four words that lead its
    share of `hot` different suffixes, as hash and number of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _flushes(batches):
            hashes, number, first, times = words.vocabulary()
            suffixes = words.suffixes(number.astype(np.int32) + 1)
            leading = _leading(suffixes, hashes)
            _, different = np.unique(leading[-1], return_index=True)
            least = max(2.0, hot / 2 * words.size / max(total_bytes, 1))
            found, loads = [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for d in range(1, DEPTH - 1):
                value, load = np.unique(leading[d][different], return_counts=True)
                value, load = value[load >= least], load[load >= least]
                found.append(value)
                loads.append(load)
                different = different[np.isin(leading[d][different], value)]
            found, loads = np.concatenate(found).view(np.int64), np.concatenate(loads)
            out = []
            for i, lang in enumerate(words.langs):
                own = np.flatnonzero(words.lang[first] == i)
                sent = (found, loads) if i == 0 else (found[:0], loads[:0])
                out.append((lang, words.strings(first[own]), times[own], *sent))
            kinds = [pa.string(), pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3]
            names = ["lang", "words", "times", "leading", "load"]
            for row in out:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

    return rows.mapInArrow(run, _COUNTED)


_ROUTED = "route int, lang string, depth int, n int, words binary, suffixes binary, times binary"


def _planes(rows: np.ndarray) -> bytes:
    """Rows of numbers as bytes that pack well: by column, the first two as steps from row to row, all low bytes before higher ones."""
    columns = rows.T.astype(np.uint32)
    columns[:2] = np.diff(columns[:2], axis=1, prepend=np.uint32(0))
    return np.ascontiguousarray(columns.reshape(DEPTH, -1, 1).view(np.uint8).transpose(0, 2, 1)).tobytes()


def _rows_of(planes: bytes, n: int) -> np.ndarray:
    """The rows that _planes took."""
    columns = np.frombuffer(planes, np.uint8).reshape(DEPTH, 4, n).transpose(0, 2, 1).copy().view(np.uint32)[:, :, 0]
    columns[:2] = np.cumsum(columns[:2], axis=1, dtype=np.uint32)
    return columns.T


class _Numbered:
    """The frequent words of all languages, numbered from 1 by their counts: few enough to be sent whole."""

    def __init__(self, words: pa.StringArray, langs: pa.StringArray):
        self.words, self.hashes = words, _Words(words, langs).hash
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, 0 for a word that is not frequent."""
        if not len(self.sorted):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at] + 1, 0).astype(np.int32)


class _Filtered:
    """The frequent words, and some others, as a bit filter of their hashes: for more words than can be sent."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers from 1 of the hashes that the filter has, 0 for the others."""
        places = bit_places(hashes, self.bits)
        keep = np.all((self.bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1, axis=0)
        return np.where(keep, np.cumsum(keep), 0).astype(np.int32)


class _Gathered:
    """Suffixes of several flushes under one numbering of their frequent words: that of _Numbered, or one of their own, whose
    words they then carry."""

    def __init__(self, frequent: _Numbered | _Filtered) -> None:
        self.frequent, self.known = frequent, isinstance(frequent, _Numbered)
        self.parts: list[tuple] = []
        self.rows = 0

    def add(self, words: _Words) -> None:
        """The suffixes of two words or more of a flush, up to its first word that is not frequent."""
        hashes, number, first, times = words.vocabulary()
        new = self.frequent.numbers(hashes)
        keep = np.flatnonzero(new) if not self.known else np.zeros(0, np.int64)
        suffixes = words.suffixes(new[number])
        some = np.flatnonzero(suffixes[:, 1])
        langs = pa.DictionaryArray.from_arrays(pa.array(words.lang[some]), pa.array(words.langs, pa.string()))
        self.parts.append((hashes[keep], words.strings(first[keep]), times[keep], suffixes[some], langs.dictionary_decode()))
        self.rows += len(some)

    def numbered(self) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.DictionaryArray]:
        """(hashes, words, suffixes, langs) of all; usual words get small numbers, which pack well."""
        langs = pa.concat_arrays([p[4] for p in self.parts]).dictionary_encode()
        if self.known:
            return self.frequent.hashes, pa.array([], pa.string()), np.concatenate([p[3] for p in self.parts]), langs
        every = np.concatenate([p[0] for p in self.parts])
        hashes, first, number = np.unique(every, return_index=True, return_inverse=True)
        order = np.argsort(-np.bincount(number, np.concatenate([p[2] for p in self.parts]), len(hashes)), kind="stable")
        place = np.empty(len(hashes), np.int32)
        place[order] = np.arange(1, len(hashes) + 1)
        number, at, suffixes = place[number], 0, []
        for p in self.parts:
            names = np.concatenate((np.zeros(1, np.int32), number[at : at + len(p[0])]))
            suffixes.append(names[p[3]])
            at += len(p[0])
        words = pa.concat_arrays([p[1] for p in self.parts]).take(pa.array(first[order]))
        return hashes[order], words, np.concatenate(suffixes), langs

    def packed(self, routes: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The different suffixes and their times, a row for each route, language and number of leading words that route them."""
        zstd = pa.Codec("zstd", compression_level=4)
        hashes, texts, suffixes, coded = self.numbered()
        langs, lang = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        leading = _leading(suffixes, hashes)
        _, at, times = np.unique(leading[-1], return_index=True, return_counts=True)
        leading, suffixes, lang = [x[at] for x in leading], suffixes[at], lang[at]
        depth = np.full(len(at), 2, np.int32)
        for d in range(2, DEPTH):
            depth[(depth == d) & np.isin(leading[d - 1], hot)] = d + 1
        by = np.choose(depth - 2, leading[1:]) if len(at) else np.zeros(0, U)
        route = ((by >> U(16)) % U(routes)).astype(np.int64)
        group = (route * (DEPTH + 1) + depth) * max(len(langs), 1) + lang
        order = np.lexsort((suffixes[:, 0].astype(np.int64) << 32 | suffixes[:, 1], group))
        group = group[order]
        edges = np.flatnonzero(np.diff(group, prepend=-1))
        out: list[list] = [[] for _ in range(7)]
        for a, b in zip(edges, np.append(edges[1:], len(group)), strict=True):
            own = order[a:b]
            i, rows, spelled = own[0], suffixes[own], b""
            if not self.known:
                used, local = np.unique(rows, return_inverse=True)
                if used[0] != 0:
                    used, local = np.concatenate(([0], used)), local + 1
                rows, spelled = local.reshape(b - a, DEPTH), "\n".join(texts.take(pa.array(used[1:] - 1)).to_pylist()).encode()
            row = (int(route[i]), langs[lang[i]], int(depth[i]), b - a, spelled, _planes(rows), times[own].astype(np.int32).tobytes())
            for column, x in zip(out, row, strict=True):
                column.append(len(x).to_bytes(4, "little") + zstd.compress(x, asbytes=True) if isinstance(x, bytes) else x)
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in _ROUTED.split(", ")])
        for a in range(0, made.num_rows, 64):
            yield made.slice(a, 64)


def _routed(rows: DataFrame, routes: int, frequent, hot) -> DataFrame:
    """Different suffixes of two words or more with their times, GATHERED or a task's at a time, by route, language and depth.

    frequent: broadcast _Numbered or _Filtered; hot: broadcast hashes of leading words that do not route.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(frequent.value)
        for words in _flushes(batches):
            held.add(words)
            if held.rows >= GATHERED:
                yield from held.packed(routes, hot.value)
                held = _Gathered(frequent.value)
        if held.rows:
            yield from held.packed(routes, hot.value)

    return rows.mapInArrow(run, _ROUTED)


def equal_parts(suffixes: np.ndarray, times: np.ndarray, least: int, from_depth: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, count) of each run of words, from_depth to all columns long, that begins rows of a count of `least` or more;
    row is one that it begins, counts are sums of times.

    Multikey quicksort: pointers to the rows are parted by the word at a depth, less, equal or greater than a pivot; equal ones
    go a word deeper. All parts of a round are handled at once, and those that weigh less than `least` are abandoned.
    """
    width = suffixes.shape[1]
    pointer = np.random.default_rng(0).permutation(len(suffixes))  # so any row of a part is a fair pivot
    start, depth = np.zeros(min(1, len(pointer)), np.int64), np.zeros(min(1, len(pointer)), np.int64)
    out = [(np.zeros(0, np.int64),) * 3]
    while len(pointer):
        size = np.diff(start, append=len(pointer))
        part = np.repeat(np.arange(len(start)), size)
        word = suffixes[pointer, depth[part]]
        pivot = word[start]
        side = np.sign(word - pivot[part]) + 1
        key = part * 3 + side
        order = np.argsort(key, kind="stable")
        pointer, key = pointer[order], key[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        weight = np.add.reduceat(times[pointer], start)
        part, side = key[start] // 3, key[start] % 3
        equal = side == 1
        deeper = depth[part] + equal
        found = equal & (weight >= least) & (pivot[part] > 0)
        new = found & (deeper >= from_depth)
        out.append((pointer[start[new]], deeper[new], weight[new]))
        go_on = (weight >= least) & np.where(equal, found & (deeper < width), True)
        size = np.diff(start, append=len(pointer))
        pointer = pointer[np.repeat(go_on, size)]
        start, depth = (np.cumsum(size[go_on]) - size[go_on]), deeper[go_on]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _unpacked(table: pa.Table, frequent: _Numbered | _Filtered) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(suffixes, times, words) of all rows of a table that _routed made; word i of suffixes is words[i - 1]."""
    zstd = pa.Codec("zstd")

    def opened(c: str) -> list[bytes]:
        return [zstd.decompress(x[4:], int.from_bytes(x[:4], "little"), asbytes=True) for x in table.column(c).to_pylist()]

    times = np.concatenate([np.frombuffer(x, np.int32) for x in opened("times")]).astype(np.int64)
    parts = [_rows_of(x, n) for x, n in zip(opened("suffixes"), table.column("n").to_pylist(), strict=True)]
    if isinstance(frequent, _Numbered):
        return np.concatenate(parts).astype(np.int32), times, frequent.words
    spelled = [x.decode().split("\n") if x else [] for x in opened("words")]
    coded = pa.array([w for x in spelled for w in x], pa.string()).dictionary_encode()
    number, at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + 1, 0
    for i, own in enumerate(spelled):
        parts[i] = np.concatenate((np.zeros(1, np.int32), number[at : at + len(own)]))[parts[i]]
        at += len(own)
    return np.concatenate(parts), times, coded.dictionary


def _phrases(words: pa.Array, suffixes: np.ndarray, row: np.ndarray, depth: np.ndarray) -> pa.Array:
    """The first `depth` words of each row, joined by spaces; in order of depth."""
    out = [pa.array([], pa.string())]
    for d in range(1, DEPTH + 1):
        own = row[depth == d]
        columns = [words.take(pa.array(suffixes[own, i] - 1)) for i in range(d)]
        out.append(pc.binary_join_element_wise(*columns, " ").cast(pa.string()))
    return pa.concat_arrays(out)


def _frequent_phrases(routed: DataFrame, frequent, least: int) -> DataFrame:
    """(lang, phrase, size, times) of phrases of two words and more. Those of leading words that several routes share come as one row
    a route, others once and only if they are frequent."""

    def run(key, table):
        out = [[], [], [], []]
        for lang in pc.unique(table.column("lang")).to_pylist():
            for first in range(2, DEPTH + 1):
                own = table.filter(pc.and_(pc.equal(table.column("lang"), lang), pc.equal(table.column("depth"), first)))
                if not own.num_rows:
                    continue
                suffixes, times, words = _unpacked(own, frequent.value)
                found = [equal_parts(suffixes, times, least, first)]
                for d in range(2, first):
                    _, at, back = np.unique(suffixes[:, :d], axis=0, return_index=True, return_inverse=True)
                    shared = np.zeros(len(at), np.int64)
                    np.add.at(shared, back.ravel(), times)
                    found.append((at, np.full(len(at), d), shared))
                row, depth, count = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(depth, kind="stable")
                row, depth, count = row[order], depth[order], count[order]
                for column, x in zip(out, (pa.array([lang] * len(row), pa.string()), _phrases(words, suffixes, row, depth), pa.array(depth, pa.int32()), pa.array(count)), strict=True):
                    column.append(x)
        names, kinds = ["lang", "phrase", "size", "times"], [pa.string(), pa.string(), pa.int32(), pa.int64()]
        return pa.table([pa.concat_arrays(c) if c else pa.array([], k) for c, k in zip(out, kinds, strict=True)], names)

    return routed.groupBy("route").applyInArrow(run, "lang string, phrase string, size int, times bigint")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """The phrases of each language that hold together best: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut at sentence signs and line ends into pieces and those at spaces and tabs into words. A phrase
    of 2 to 5 words with a count a of `least` or more is a candidate; cut after its first words, where the score floor(1000 * a *
    n / (l * r)) is least (n words of the language, l and r the counts of its two parts), it is worth that score. Candidates inside
    a longer one of the same count go. The first `top` by score, count and phrase are returned, all for None.

    Null texts are empty, null languages are `und`. Repeated rows count each time; other columns are ignored, whatever their
    names; an empty table gives none. Whole texts are read. Words are told apart by 64-bit hashes within a flush, by their letters
    elsewhere; counts are of all suffixes, and products are exact to 38 digits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    with tidy(spark):
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        routes = max(2 * shuffles, -(-size // (6 * ROUTE_ROWS)))
        hot = max(HOT_ROWS, size / 6 / MOST_HOT)
        counted = cut(_counted(rows, size, hot), "phrase-words")
        words = counted.select("lang", F.explode(F.arrays_zip("words", "times")).alias("w")).groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.times").alias("times"))
        words = cut(words, "phrase-vocabulary")
        totals = cut(words.groupBy("lang").agg(F.sum("times").alias("n")), "phrase-totals")
        words = words.where(F.col("times") >= least)
        led = counted.select(F.explode(F.arrays_zip("leading", "load")).alias("x")).groupBy("x.leading").agg(F.sum("x.load").alias("load"))
        led = led.where(F.col("load") >= hot / 2).select("leading").toArrow().column(0).to_numpy()  # 6 * MOST_HOT at most, see HOT_ROWS
        context = spark.sparkContext
        words = cut(words, "phrase-frequent")
        if words.count() * WORD_BYTES <= BROADCAST_BYTES:
            table = words.orderBy(F.col("times").desc(), "lang", "phrase").select("phrase", "lang").toArrow().combine_chunks()
            one = lambda c: pa.concat_arrays([pa.array([], pa.string()), *(x.cast(pa.string()) for x in table.column(c).chunks)])
            known = _Numbered(one("phrase"), one("lang"))
        else:
            known = _Filtered(bit_filter(_hashed(words)))
        frequent, leading = context.broadcast(known), context.broadcast(np.sort(led.view(U)))
        found = _frequent_phrases(_routed(rows, routes, frequent, leading), frequent, least).groupBy("lang", "phrase", "size").agg(F.sum("times").alias("times"))
        found = found.where(F.col("times") >= least).unionByName(words.select("lang", "phrase", F.lit(1).alias("size"), "times"))
        found = cut(found, "phrases")
        rated = _rated(found, totals)
        if top is not None:
            order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
            rated = rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        else:
            rated = rated.withColumn("rank", F.lit(None))
        return cut(rated.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations", keep=True)


#: Exact: counts up to 10 to the power of 16 make products of 38 digits at most.
_SCORE = "(1000 * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(16,0)) * cast(r as decimal(16,0)))"


def _rated(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among the frequent phrases `found`, a written table."""
    parts = maybe_broadcast(found.select("lang", "phrase", "times"), found.count(), 128)
    cuts = found.where("size > 1").select("lang", "phrase", "size", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("times").alias(name)), ["lang", part])
    cuts = cuts.join(maybe_broadcast(totals, totals.count(), 128), "lang").withColumn("score", F.expr(_SCORE))
    worst = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    # The phrases inside each candidate, with the largest count of a candidate that they are inside.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    inside = found.where("size > 2").select("lang", "times", F.explode(F.array_distinct(spans)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("times").alias("longer"))
    kept = worst.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < a")
    return kept.select("lang", "phrase", "a", "w.l", "w.r", "n", "w.score")
