"""N-gram Jaccard self-join by vertical partitioning.

The n-grams of all texts have one global order; it is cut into fragments. Each fragment counts what it alone can count
(how many texts have an n-gram, how much of a text or of a pair of texts overlaps), and the partial counts are summed
per text or per pair.

1. `sets`: the distinct n-grams of each text as 64-bit hashes, and two signatures of the set. Texts of equal sets form a
   class; from here on one row stands for a class, so a third of all rows being copies costs nothing.
2. First pass, in hash order: two sets with Jaccard t share their first k n-grams within the first n - ceil(t n) + k of
   each, so a class with fewer than k n-grams there that others have too is linked with nothing and leaves.
3. Second pass over the classes left, whole sets, rare n-grams first: a class needs ceil(t n) n-grams that others have,
   and each link has an n-gram of both prefixes. Common passages come last in this order and so give no candidates.
4. Candidates meet in groups around the smallest class of each prefix n-gram. Their n-grams are cut into fragments again:
   each fragment of a group counts the overlaps of its pairs in its own part of the order, as one packed array, and the
   arrays are summed per pair. A large group is cut into blocks, and each pair of blocks is compared by itself.
5. Where only components are wanted, a large group first meets some of its own members (pivots), which mostly joins it
   into one component; then only pairs of members that are not joined yet are compared. Nothing is lost by that: a pair
   inside one component adds nothing to it.

Hot fragments are cut into slices; counts are summed in the mappers first. Nothing but the slice count of hot fragments
(at most one entry for SLICE n-grams of input) reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Rolling, Texts, U, cut, lookup, maybe_broadcast, mix, perhaps_among, row_keys, text_function, tidy

#: N-grams in a fragment on average, in a slice of a hot fragment at most, and held back by a mapper before it sends.
FRAGMENT, SLICE, HELD = 250_000, 1_000_000, 250_000
#: Classes in a block of candidates, n-grams in a fragment of a pair of blocks or in a task of small groups, fragments that a
#: pair is counted in at least, and members that a large group meets first, about.
BLOCK_ROWS, BLOCK_GRAMS, LEAST_FRAGMENTS, PIVOTS = 400, 200_000, 2, 16
#: N-grams whose overlaps are counted at once for a pair of blocks.
PIECE = 4096


def _need(n, percent):
    """N-grams that a set of n must share with any set it is linked with."""
    return -(-n * percent // 100)


def _sets_of(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    found = Texts(texts, lower=True)
    start, end, row = found.words()
    rolling = Rolling(found.hashes(start, end))
    grams = rolling.of(words)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a < words:
            out.append(rolling.of(b - a)[a : a + 1] if b > a else np.zeros(0, U))
        else:
            own = np.sort(grams[a : b - words + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
    return out


def _signature(grams: np.ndarray, salt: int) -> int:
    return int(mix(grams + U(salt)).sum(dtype=U).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    flat = np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def sets(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, prefix: bool) -> DataFrame:
    """(id, key_a, key_b, n, class_id, check, grams): the set's size, its signatures (null for none), and the n-grams in hash
    order: the first n - ceil(t n) + max(1, n / 10), or all. Null and empty texts have n = 0."""

    def run(texts: pa.Array) -> list:
        found = _sets_of(texts, words)
        n = [len(x) for x in found]
        signs = [pa.array([_signature(x, salt) if len(x) else None for x in found], pa.int64()) for salt in (1, 2**40 + 1)]
        if prefix:
            found = [x[: len(x) - _need(len(x), percent) + max(1, len(x) // 10)] for x in found]
        return [pa.array(n, pa.int64()), *signs, _lists(found)]

    told = text_function(run, "n bigint, class_id bigint, check bigint, grams array<bigint>")(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text_col), told.alias("told")).select("id", "key_a", "key_b", "told.*")


def _clashes(rows: DataFrame) -> DataFrame:
    """(class_id) of the first signatures that different sets share, by the second: 128 bits tell sets apart."""
    signs = rows.where("n > 0").groupBy("class_id").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    return cut(signs.where("low <> high").select("class_id"), "clashes")


def _told_apart(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    """Rows of sets, with another class_id where the first signature does not tell."""
    if clashes.isEmpty():
        return rows
    other = rows.join(F.broadcast(clashes), "class_id", "left_semi").withColumn("class_id", F.xxhash64("class_id", "check"))
    return rows.join(F.broadcast(clashes), "class_id", "left_anti").unionByName(other)


def _by_fragment(frag: np.ndarray, count: int):
    """(fragment, positions) for the fragments that occur, in order."""
    if not len(frag):
        return
    order = np.argsort(frag, kind="stable")
    cuts = np.searchsorted(frag[order], np.arange(count + 1)) if count <= len(frag) else None
    if cuts is None:
        kinds, first = np.unique(frag[order], return_index=True)
        for f, a, b in zip(kinds, first, [*first[1:], len(order)], strict=True):
            yield int(f), order[a:b]
        return
    for f in range(count):
        if cuts[f + 1] > cuts[f]:
            yield f, order[cuts[f] : cuts[f + 1]]


def _held(batches, most: int):
    """Arrow batches gathered until they have `most` n-grams."""
    kept, size = [], 0
    for b in batches:
        if b.num_rows:
            kept.append(b)
            size += len(b.column("grams").flatten())
        if size >= most:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, size = [], 0
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def _grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes, row of each) of the grams column."""
    lists = table.column("grams")
    flat = np.concatenate([np.asarray(c.flatten()) for c in lists.chunks]) if lists.num_chunks else np.zeros(0, np.int64)
    size = np.asarray(pc.list_value_length(lists).combine_chunks(), dtype=np.int64)
    return flat.view(U), np.repeat(np.arange(len(size)), size)


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _frequencies(rows: DataFrame, fragments: int) -> DataFrame:
    """(frag, total, grams, dfs): the n-grams that two classes or more have, with their counts; total: all occurrences."""

    def pack(batches):
        for table in _held(batches, HELD):
            h, n = np.unique(_grams(table)[0], return_counts=True)
            got = [(f, _blob(h[at]), _blob(n[at].astype(np.int64))) for f, at in _by_fragment((h % U(fragments)).astype(np.int64), fragments)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()),
                    pa.array([g[2] for g in got], pa.binary()),
                ],
                ["frag", "grams", "dfs"],
            )

    def merge(key, table):
        h = np.concatenate([np.frombuffer(x, U) for x in table.column("grams").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("dfs").to_pylist()])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        h, n = h[first], np.add.reduceat(n, first)
        some = n >= 2
        return pa.table(
            {
                "frag": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()),
                "grams": pa.array([_blob(h[some])], pa.binary()), "dfs": pa.array([_blob(n[some])], pa.binary()),
            }
        )

    packed = rows.select("grams").mapInArrow(pack, "frag long, grams binary, dfs binary")
    return packed.groupBy("frag").applyInArrow(merge, "frag long, total long, grams binary, dfs binary")


def _shared_grams(rows: DataFrame, name: str, percent: int, count_only: bool) -> DataFrame:
    """Per class the n-grams that others have too. rows: (class_id, n, grams), one for each class.
    count_only: (class_id, n, shared); else (class_id, n, grams) of the classes that share enough of theirs with others, the
    rarest first, ties by hash. What the fragments count goes to buckets of classes, where it is added up for each class."""
    total = rows.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    fragments = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // FRAGMENT), 1)
    known = cut(_frequencies(rows, fragments), f"{name}-frequencies")
    slices = F.ceil(F.col("total") / SLICE).cast("long")
    hot = {r.frag: r.s for r in known.where(F.col("total") > SLICE).select("frag", slices.alias("s")).collect()}
    known = known.select(
        "frag", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(slices, F.lit(1).cast("long")) - 1)).alias("slice"), "grams", "dfs",
    )

    def pack(batches):
        turn = 0
        for table in _held(batches, HELD):
            h, row = _grams(table)
            ids, ns = np.asarray(table.column("class_id").combine_chunks()), np.asarray(table.column("n").combine_chunks())
            got = []
            for f, at in _by_fragment((h % U(fragments)).astype(np.int64), fragments):
                who = row[at]
                first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
                runs = np.diff(np.concatenate((first, [len(who)])))
                got.append((f, turn % hot.get(f, 1), _blob(ids[who[first]]), _blob(ns[who[first]]), _blob(runs.astype(np.int32)), _blob(h[at])))
                turn += f in hot
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()),
                    *(pa.array([g[i] for g in got], pa.binary()) for i in range(2, 6)),
                ],
                ["frag", "slice", "ids", "ns", "runs", "grams"],
            )

    def meet(key, left, right):
        known_h = np.concatenate([np.frombuffer(x, U) for x in right.column("grams").to_pylist()] or [np.zeros(0, U)])
        known_n = np.concatenate([np.frombuffer(x, np.int64) for x in right.column("dfs").to_pylist()] or [np.zeros(0, np.int64)])
        col = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in left.column(c).to_pylist()] or [np.zeros(0, kind)])
        ids, ns, runs, h = col("ids", np.int64), col("ns", np.int64), col("runs", np.int32), col("grams", U)
        at = np.minimum(np.searchsorted(known_h, h), max(len(known_h) - 1, 0))
        some = known_h[at] == h if len(known_h) else np.zeros(len(h), bool)
        per = np.bincount(np.repeat(np.arange(len(ids)), runs)[some], minlength=len(ids))
        live = np.flatnonzero(per)
        got, dfs, first = h[some], known_n[at[some]] if len(known_h) else known_n, np.concatenate(([0], np.cumsum(per)))
        rows = []
        for bucket, own in _by_fragment((mix(ids[live].view(U)) % U(fragments)).astype(np.int64), fragments):
            own = live[own]
            row = [bucket, _blob(ids[own]), _blob(ns[own]), _blob(per[own])]
            if not count_only:
                places = np.concatenate([np.arange(first[x], first[x + 1]) for x in own])
                row += [_blob(got[places]), _blob(dfs[places])]
            rows.append(row)
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i, name in enumerate(fields)})

    def add(key, table):
        col = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()])
        ids, ns, per = col("ids", np.int64), col("ns", np.int64), col("per", np.int64)
        classes, first, which = np.unique(ids, return_index=True, return_inverse=True)
        total = np.bincount(which, per, len(classes)).astype(np.int64)
        n = ns[first]
        if count_only:
            return pa.table({"class_id": classes, "n": n, "shared": total})
        enough = total >= _need(n, percent)
        who = np.repeat(which, per)
        h, df = col("grams", U)[enough[who]], col("dfs", np.int64)[enough[who]]
        order = np.lexsort((h, df, who[enough[who]]))
        offs = np.concatenate(([0], np.cumsum(total[enough]))).astype(np.int32)
        return pa.table(
            {
                "class_id": classes[enough], "n": n[enough],
                "grams": pa.ListArray.from_arrays(pa.array(offs), pa.array(h[order].view(np.int64))),
            }
        )

    packed = rows.select("class_id", "n", "grams").mapInArrow(
        pack, "frag long, slice long, ids binary, ns binary, runs binary, grams binary",
    )
    both = packed.groupBy("frag", "slice").cogroup(known.groupBy("frag", "slice"))
    fields = ["bucket", "ids", "ns", "per"] + ([] if count_only else ["grams", "dfs"])
    parts = both.applyInArrow(meet, ", ".join(f"{x} {'long' if x == 'bucket' else 'binary'}" for x in fields))
    return parts.groupBy("bucket").applyInArrow(
        add, "class_id long, n long, shared long" if count_only else "class_id long, n long, grams array<long>",
    )


def _overlaps(members: list[np.ndarray], split: int) -> np.ndarray:
    """How many n-grams each two members share; split > 0: only between the first `split` and the rest. The order is cut into
    pieces; overlaps are counted in each and summed."""
    flat = np.concatenate(members)
    row = np.repeat(np.arange(len(members)), [len(m) for m in members])
    _, gram, times = np.unique(flat, return_inverse=True, return_counts=True)
    again = times >= 2
    gram, row = (np.cumsum(again) - 1)[gram[again[gram]]], row[again[gram]]
    order = np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    common = np.zeros((split or len(members), len(members) - split if split else len(members)), np.int32)
    for low in range(0, int(again.sum()), PIECE):
        a, b = np.searchsorted(gram, (low, low + PIECE))
        has = np.zeros((len(members), int(min(PIECE, again.sum() - low))), np.float32)
        has[row[a:b], gram[a:b] - low] = 1
        common += (has[:split] @ has[split:].T if split else has @ has.T).astype(np.int32)
    return common


_UNIT = ["leader", "bi", "bj"]


def _units(table: pa.Table, columns: list[str]):
    """(unit, rows) of each pair of blocks in a task, rows being tuples of the named columns."""
    found: dict = {}
    for unit, row in zip(zip(*(table.column(c).to_pylist() for c in _UNIT), strict=True), zip(*(table.column(c).to_pylist() for c in columns), strict=True), strict=True):
        found.setdefault(unit, []).append(row)
    return found.items()


def _compare(placed: DataFrame, ordered: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): links between the members of each unit of placed (class_id, leader, mine, bi, bj, task, fragments): between its
    two blocks, or within its one. every: all links, else as many as join what is joined."""

    def cut_up(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("grams")
            size = np.asarray(pc.list_value_length(lists), dtype=np.int64)
            count = np.asarray(batch.column("fragments"), dtype=np.int64)
            flat = np.asarray(lists.flatten()).view(U)
            row = np.repeat(np.arange(len(size)), size)
            first = np.concatenate(([0], np.cumsum(count)))
            cell = first[row] + (flat % count[row].astype(U)).astype(np.int64)
            order = np.argsort(cell, kind="stable")
            offs = np.concatenate(([0], np.cumsum(np.bincount(cell, minlength=int(first[-1]))))).astype(np.int32)
            out = np.repeat(np.arange(len(size)), count)
            fragment = np.arange(int(first[-1])) - first[out]
            kept = batch.select(["task", *_UNIT, "mine", "class_id", "n"]).take(pa.array(out))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(fragment), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat[order].view(np.int64)))],
                [*kept.schema.names, "fragment", "grams"],
            )

    def count(key, table):
        lists = table.column("grams").combine_chunks()
        offs, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        table = table.append_column("at", pa.array(np.arange(table.num_rows)))
        out = []
        for unit, rows in _units(table, ["mine", "class_id", "n", "at"]):
            rows.sort(key=lambda r, bi=unit[1]: (r[0] != bi, r[1]))
            split = sum(r[0] == unit[1] for r in rows) if unit[1] != unit[2] else 0
            if len(rows) < 2 or (unit[1] != unit[2] and split in (0, len(rows))):
                continue
            common = _overlaps([flat[offs[r[3]] : offs[r[3] + 1]] for r in rows], split)
            out.append((key[0].as_py(), *unit, split, _blob(np.array([r[1] for r in rows])), _blob(np.array([r[2] for r in rows])), _blob(common)))
        return pa.table({f: pa.array([r[i] for r in out], t) for i, (f, t) in enumerate(zip(counted, kinds, strict=True))})

    def add_up(key, table):
        a, b = [], []
        for (_, bi, bj), rows in _units(table, ["split", "ids", "ns", "common"]):
            split = rows[0][0]
            ids, n = np.frombuffer(rows[0][1], np.int64), np.frombuffer(rows[0][2], np.int64)
            one, two = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
            common = sum(np.frombuffer(r[3], np.int32).astype(np.int64) for r in rows).reshape(len(ids[one]), len(ids[two]))
            left, right = np.nonzero(100 * common >= percent * (n[one][:, None] + n[two][None, :] - common))
            right = right + split
            some = (left < right) & (ids[left] != ids[right])
            left, right = left[some], right[some]
            for x, y in zip(left, right, strict=True) if every else _forest(left, right, len(ids)):
                a.append(ids[x])
                b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    counted = ["task", *_UNIT, "split", "ids", "ns", "common"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    pieces = placed.join(ordered, "class_id").mapInArrow(
        cut_up, "task long, leader long, bi int, bj int, mine int, class_id long, n long, fragment long, grams array<long>",
    )
    parts = pieces.groupBy("task", "fragment").applyInArrow(
        count, "task long, leader long, bi int, bj int, split int, ids binary, ns binary, common binary",
    )
    found = parts.groupBy("task").applyInArrow(add_up, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _links(ordered: DataFrame, percent: int, every: bool) -> DataFrame:
    """(a, b): links between classes; every: all of them, else as many as join what is joined. A written table."""
    prefix = ordered.select(
        "class_id", F.size("grams").alias("grams_n"),
        F.explode(F.expr(f"slice(grams, 1, cast(size(grams) - ceil(n * {percent} / 100) + 1 as int))")).alias("gram"),
    )
    leaders = prefix.groupBy("gram").agg(F.min("class_id").alias("leader"), F.count("*").alias("c")).where("c > 1").drop("c")
    groups = cut(prefix.join(leaders.hint("shuffle_hash"), "gram").select("leader", "class_id", "grams_n").distinct(), "groups")
    sizes = groups.groupBy("leader").agg(F.count("*").alias("rows"), F.sum("grams_n").alias("grams"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int"))
    sizes = sizes.withColumn(
        "fragments", F.greatest(F.lit(LEAST_FRAGMENTS), F.ceil(2 * F.col("grams") / F.col("blocks") / BLOCK_GRAMS)).cast("long"),
    )
    groups = cut(lookup(groups, cut(sizes, "sizes"), "leader"), "sized-groups")
    small, large = groups.where("blocks = 1"), groups.where("blocks > 1")
    tasks = max(1, -(-(small.agg(F.sum("grams_n")).first()[0] or 0) // BLOCK_GRAMS))
    none = F.lit(0)
    alone = small.select(
        "class_id", "leader", none.alias("mine"), none.alias("bi"), none.alias("bj"),
        F.pmod(F.xxhash64("leader"), F.lit(tasks)).alias("task"), "fragments",
    )
    mine = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    if every:
        pairs = large.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
        return cut(_compare(alone.unionByName(_paired(pairs)), ordered, percent, every), "links")

    pivot = (F.col("class_id") == F.col("leader")) | (F.pmod(F.xxhash64("class_id", "leader"), F.lit(1 << 30)) < F.lit(PIVOTS * (1 << 30)) / F.col("rows"))
    members = large.withColumn("mine", mine).withColumn("other", F.lit(-1))
    pivots = large.where(pivot).withColumn("mine", F.lit(-1)).withColumn("other", F.explode(F.sequence(none, F.col("blocks") - 1)))
    first = cut(_compare(alone.unionByName(_paired(members.unionByName(pivots))), ordered, percent, every), "links")
    if large.isEmpty():
        return first
    labels = cut(components(first), "labels")
    told = lookup(cut(large.withColumnRenamed("class_id", "node"), "large"), labels, "node").select(
        F.col("node").alias("class_id"), "leader", "fragments", F.coalesce("label", "node").alias("label"),
    )
    told = cut(told, "labelled-groups")
    counts = told.groupBy("leader", "label").agg(F.count("*").alias("c")).groupBy("leader").agg(
        F.max_by("label", F.struct("c", "label")).alias("main"), F.max("c").alias("pure"), F.sum("c").alias("rows"),
    )
    counts = counts.where("rows > pure").withColumn(
        "mixed", F.ceil((F.col("rows") - F.col("pure")) / BLOCK_ROWS).cast("int"),
    ).withColumn("blocks", F.col("mixed") + F.ceil(F.col("pure") / BLOCK_ROWS).cast("int"))
    rest = lookup(told, cut(counts, "mixed-groups"), "leader").where("main is not null")
    is_mixed, place = F.col("label") != F.col("main"), F.xxhash64("class_id")
    mine = F.when(is_mixed, F.pmod(place, F.col("mixed"))).otherwise(F.col("mixed") + F.pmod(place, F.col("blocks") - F.col("mixed"))).cast("int")
    other = F.explode(F.sequence(none, F.when(is_mixed, F.col("blocks")).otherwise(F.col("mixed")) - 1))
    second = _compare(_paired(rest.withColumn("mine", mine).withColumn("other", other)), ordered, percent, every)
    return cut(first.unionByName(second), "links")


def _paired(rows: DataFrame) -> DataFrame:
    """Members with the pair of blocks that they meet in, `mine` and `other`."""
    bi, bj = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.select(
        "class_id", "leader", "mine", bi.alias("bi"), bj.alias("bj"), F.xxhash64("leader", bi, bj).alias("task"), "fragments",
    )


def _forest(left: np.ndarray, right: np.ndarray, count: int):
    """Links that join what all links join, one fewer than the rows of each part."""
    up = list(range(count))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(left.tolist(), right.tolist(), strict=True):
        rx, ry = root(x), root(y)
        if rx != ry:
            up[max(rx, ry)] = min(rx, ry)
            yield x, y


def _candidates(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int):
    """The sets of all rows, the classes, and the ordered n-grams of the classes that may have links."""
    rows = cut(sets(docs, id_col, text_col, words, percent, prefix=True), "sets")
    clashes = _clashes(rows)
    rows = _told_apart(rows, clashes)
    classes = cut(
        rows.where("n > 0 and id is not null").groupBy("class_id").agg(F.min(F.struct("id", "key_a", "key_b")).alias("one")), "classes",
    )
    classes = classes.select("class_id", "one.id", "one.key_a", "one.key_b")
    first = _shared_grams(_one_each(rows, classes), "first", percent, count_only=True)
    some = first.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 10)))
    some = cut(some.join(classes, "class_id").select("class_id", "id", "key_a", "key_b"), "some")
    left = perhaps_among(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *row_keys(id_col, text_col)), some, ["key_a", "key_b"],
    )
    whole = _told_apart(cut(sets(left, "id", "text", words, percent, prefix=False), "whole-sets"), clashes)
    return rows, classes, cut(_shared_grams(_one_each(whole, some), "second", percent, count_only=False), "ordered")


def _one_each(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """One row of each class: the one with its row keys; repeated rows count once."""
    known = maybe_broadcast(classes.select("class_id", "key_a", "key_b"), classes.count(), 40)
    kept = rows.select("key_a", "key_b", "n", "class_id", "grams").join(known, ["class_id", "key_a", "key_b"], "left_semi")
    return kept.dropDuplicates(["class_id"]) if _repeats(rows) else kept


def _repeats(rows: DataFrame) -> bool:
    """Whether some row occurs twice."""
    return bool(rows.where("n > 0").groupBy("key_a", "key_b").count().where("count > 1").limit(1).count())


def ngram_links(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75,
) -> tuple[DataFrame, DataFrame]:
    """All links between different texts, and what stands for which.

    Returns (links, members): links (a, b) between class ids, a < b, for every two different sets with
    100 * intersection >= percent * union; members (id, n, class_id), one row for each row of docs with words and an id.
    """
    with tidy(docs.sparkSession):
        rows, _, ordered = _candidates(docs, id_col, text_col, words, percent)
        links = cut(_links(ordered, percent, every=True), "all-links", keep=True)
        return links, cut(rows.where("n > 0 and id is not null").select("id", "n", "class_id"), "members", keep=True)


def component_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id, key_a, key_b, n, component, is_first) for every row of docs, a written table; key_a and key_b are its row keys.
    is_first: whether the row, or one equal to it, stands for its component; null without an id or words. See
    ngram_components."""
    with tidy(docs.sparkSession):
        rows, classes, ordered = _candidates(docs, id_col, text_col, words, percent)
        labels = cut(components(_links(ordered, percent, every=False)), "labels")
        named = classes.join(labels, classes.class_id == labels.node, "left").select(
            "class_id", F.struct("id", "key_a", "key_b").alias("one"), F.coalesce("label", "class_id").alias("label"),
        )
        named = cut(named, "named")
        roots = cut(named.groupBy("label").agg(F.min("one").alias("root")), "roots")
        known = cut(lookup(named, roots, "label").select("class_id", "root"), "known")
        out = lookup(
            rows.select("id", "key_a", "key_b", "n", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id")), known,
            "class_id",
        )
        component = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("root.id"))
        is_first = (F.col("root.key_a") == F.col("key_a")) & (F.col("root.key_b") == F.col("key_b"))
        return cut(
            out.select("id", "key_a", "key_b", "n", component.alias("component"), is_first.alias("is_first")), "component-rows", keep=True,
        )


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    A text's set: distinct `words`-word n-grams of its words (runs of anything but ASCII white space, A-Z lower-cased);
    with fewer words the whole sequence as one. Two texts link at 100 * intersection >= percent * union;
    component_id is the smallest id reachable by links; ids may have any type that Spark orders. Null, empty and blank texts
    have no n-grams and link with nothing. A row without id keeps its n_shingles and gets no component. Rows that repeat an
    id are returned as often, each by its own text. Other columns of docs are ignored, whatever their names. An empty table
    gives an empty result. Hashes have 64 bits (a false overlap needs a collision), those of whole sets 128.
    """
    rows = component_rows(docs, id_col, text_col, words, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
