"""Multinomial naive Bayes over hashed features, and language identification with it.

Mappers add up the feature counts of each class over their whole partition, Spark sums them, and the log-probability
matrix (classes x buckets, whatever the corpus size) is broadcast; numpy scores sparse batches with it. A prediction is a
function of the row's text alone, so it is a column beside the others: no join brings it to the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_model import held_out
from .shared import Texts, U, mix, separators, steps, text_function, tidy

BUCKETS, WORD_BUCKETS = 1 << 15, 1 << 18
#: Bytes of a word's beginning that are features of their own: words of one stem share them.
STEMS = (5, 6, 7)
#: Orders of the character n-grams.
ORDERS = (1, 2, 3, 4)
#: Code points below this are folded by table: lower case, and everything but letters to one space.
FOLDED = 0x590
#: Bins in which surprises are counted, a nat and at most.
BINS, MOST_BINS = 100, 6400
_FOLD = np.array(
    [ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else (c if chr(c).isalpha() else 32) for c in range(FOLDED)],
    np.uint32,
)


def code_points(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(code point, row) of every character."""
    b = np.concatenate((texts.bytes, np.zeros(3, np.uint8))).astype(np.uint32)
    at = np.flatnonzero((texts.bytes & 0xC0) != 0x80)
    lead = b[at]
    point = lead.copy()
    for low, high, mask, tail in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        some = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[some] & mask
        for i in range(1, tail + 1):
            value = (value << 6) | (b[at[some] + i] & 0x3F)
        point[some] = value
    return point, np.searchsorted(texts.offs, at, "right") - 1


def letters(point: np.ndarray) -> np.ndarray:
    """Folded code points: lower-case letters, 32 for the rest."""
    out = np.full(len(point), 32, np.uint32)
    low = point < FOLDED
    out[low] = _FOLD[point[low]]
    high = np.flatnonzero(~low)
    if len(high):
        kinds, which = np.unique(point[high], return_inverse=True)
        out[high] = np.array([k if chr(k).isalpha() else 32 for k in kinds.tolist()], np.uint32)[which]
    return out


def character_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of letters and single spaces, and whether each row has a letter."""
    texts = Texts(column, lower=False)
    point, row = code_points(texts)
    point = letters(point)
    has = np.bincount(row[point != 32], minlength=len(column)) > 0
    space = point == 32
    keep = ~(space & np.concatenate(([True], space[:-1] & (row[1:] == row[:-1])))) if len(point) else space
    point, row = point[keep].astype(U), row[keep]
    rows, buckets = [], []
    for n in ORDERS:
        if len(point) >= n:
            h = point[: len(point) - n + 1] + U(n)
            for i in range(1, n):
                h = h * U(0x9E3779B97F4A7C15) + point[i : len(point) - n + 1 + i]
            inside = row[: len(row) - n + 1] == row[n - 1 :]
            rows.append(row[: len(row) - n + 1][inside])
            buckets.append((mix(h[inside]) % U(BUCKETS)).astype(np.int32))
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(buckets or [np.zeros(0, np.int32)]), has


#: Words are runs of ASCII letters, digits and anything above ASCII.
_ALNUM = separators(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def word_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, times), each pair once, of the words without their marks (A-Z lower-cased), of their beginnings and of the
    marks that end runs between white space; and the number of such runs of each row."""
    texts = Texts(column, lower=True)
    start, end, row = texts.words(_ALNUM)
    _, run_end, run_row = texts.words()
    ends = texts.bytes[run_end - 1].astype(U) if len(run_end) else np.zeros(0, U)
    marks = np.flatnonzero(_ALNUM[ends.astype(np.int64)])
    whole, *stems = texts.stems(start, end, STEMS)
    found, rows = [whole, mix(ends[marks] + U(1 << 40))], [row, run_row[marks]]
    for size, (hashes, some) in zip(STEMS, stems, strict=True):
        found.append(mix(hashes + U(size << 32)))
        rows.append(row[some])
    buckets = (np.concatenate(found) % U(WORD_BUCKETS)).astype(np.int64)
    once, times = np.unique(np.concatenate(rows) * WORD_BUCKETS + buckets, return_counts=True)
    return once // WORD_BUCKETS, (once % WORD_BUCKETS).astype(np.int32), times, np.bincount(run_row, minlength=len(column))


class NaiveBayes:
    """log_prob: (classes, buckets); log_prior: (classes,). counts: by class those of the buckets, then the rows."""

    def __init__(self, counts: dict[str, np.ndarray], smoothing: float, buckets: int):
        self.names = sorted(counts)
        both = np.array([counts[k] for k in self.names]) if counts else np.zeros((0, buckets + 1))
        tokens, docs = both[:, :buckets] + smoothing, both[:, buckets]
        self.log_prob = np.log(tokens / tokens.sum(1, keepdims=True)).astype(np.float32)
        self.log_prior = np.log(np.maximum(docs, 1e-9) / max(docs.sum(), 1e-9))
        #: What an n-gram of a text of the class tells about it, on average over the class's own texts.
        self.usual = (tokens / tokens.sum(1, keepdims=True) * self.log_prob).sum(1)

    def log_joint(self, row: np.ndarray, bucket: np.ndarray, rows: int) -> np.ndarray:
        return np.stack([np.bincount(row, lp[bucket], rows) for lp in self.log_prob], axis=1) + self.log_prior

    def surprises(self, log: np.ndarray, row: np.ndarray) -> np.ndarray:
        """(rows, classes), from log_joint: by how much the mean log probability of a text's n-grams falls short of what is
        usual in the class."""
        return self.usual - (log - self.log_prior) / np.maximum(np.bincount(row, minlength=len(log)), 1)[:, None]


def posteriors(log: np.ndarray) -> np.ndarray:
    p = np.exp(log - log.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def train(rows: DataFrame, features, buckets: int = BUCKETS, smoothing: float = 0.5) -> NaiveBayes:
    """From (label string, text): a model of all rows, with one row for each distinct label."""
    return NaiveBayes(feature_counts(rows, features, buckets), smoothing, buckets)


def feature_counts(rows: DataFrame, features, buckets: int) -> dict[str, np.ndarray]:
    """From (label string, text): by label the counts of its buckets, then of its rows. features gives (row, bucket, ...) of
    an Arrow string array."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                names, label = np.unique(np.array(part.column("label").to_pylist(), dtype=str), return_inverse=True)
                row, bucket, *_ = features(part.column("text"))
                for k, name in enumerate(names.tolist()):
                    own = counts.setdefault(name, np.zeros(buckets + 1, np.int64))
                    own[:buckets] += np.bincount(bucket[label[row] == k], minlength=buckets)
                    own[buckets] += int((label == k).sum())
        for name, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], ["label", "bucket", "n"],
            )

    parts = rows.where("label is not null").select("label", "text").mapInArrow(run, "label string, bucket int, n long")
    added = parts.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a number for each label and bucket
    names, label = np.unique(np.array(added.column("label").to_pylist(), dtype=str), return_inverse=True)
    bucket, n = (np.asarray(added.column(c)) for c in ("bucket", "n"))
    counts = {name: np.zeros(buckets + 1) for name in names.tolist()}
    for k, own in enumerate(counts.values()):
        own[bucket[label == k]] = n[label == k]
    return counts


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> NaiveBayes:
    """The model of all rows with text and language whose crc32(id as text) mod 3 is not 1."""
    with tidy(docs.sparkSession):
        rows = docs.select(
            F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("label"),
        )
        return train(rows.where(F.col("text").isNotNull() & F.col("label").isNotNull() & ~held_out("id", 3, 1)), character_features)


def language_verdict(docs: DataFrame, model: NaiveBayes, text_col: str = "text"):
    """struct(lang_pred, score, surprise) of the texts of docs. surprise: by how much the mean log probability of the text's
    n-grams falls short of what is usual in the predicted language; a text of a language or an alphabet that was not learnt
    has a large one, whatever the posterior says."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        model = shared.value
        names = np.array([*model.names, "und"], dtype=object)
        row, bucket, has = character_features(texts)
        best, score, surprise = np.full(len(texts), len(names) - 1), np.zeros(len(texts)), np.zeros(len(texts))
        if len(names) > 1:
            log = model.log_joint(row, bucket, len(texts))
            p = posteriors(log)
            best, score = np.where(has, p.argmax(1), best), np.where(has, p.max(1), 0.0)
            surprise = np.where(has, model.surprises(log, row)[np.arange(len(texts)), log.argmax(1)], 0.0)
        return [pa.array(names[best], pa.string()), score, surprise]

    return text_function(run, "lang_pred string, score double, surprise double")(F.col(text_col).cast("string"))


def language_bars(
    docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> dict[str, float]:
    """By language the surprise that half of the held-out texts of other languages reach in it, to a hundredth of a nat.

    A text that is as unusual as this in the language it is most like is of none that was learnt. All rows with a letter and a
    language whose crc32(id as text) mod 3 is 1 are counted, in bins, so it matters neither how many they are nor in which
    order they come. A language has no bar if no such text is of another one; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        counts = np.zeros((len(model.names), MOST_BINS), np.int64)
        for batch in batches:
            for part in steps(batch, "text"):
                label = np.array(part.column("label").to_pylist(), dtype=object)
                row, bucket, has = character_features(part.column("text"))
                found = model.surprises(model.log_joint(row, bucket, len(label)), row)
                at = np.clip(np.floor(found * BINS), 0, MOST_BINS - 1).astype(np.int64)
                for k, name in enumerate(model.names):
                    counts[k] += np.bincount(at[has & (label != name), k], minlength=MOST_BINS)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[k, b])], ["class", "bin", "n"])

    if not model.names:
        return {}
    with tidy(docs.sparkSession):
        rows = docs.where(held_out(id_col, 3, 1) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
        rows = rows.select(F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
        parts = rows.mapInArrow(run, "class int, bin int, n long")
        added = parts.groupBy("class", "bin").agg(F.sum("n").alias("n")).collect()  # MOST_BINS numbers a language at most
    counts = np.zeros((len(model.names), MOST_BINS), np.int64)
    for r in added:
        counts[r["class"], r["bin"]] = r["n"]
    below = counts.cumsum(1)
    return {name: (int(np.searchsorted(c, (c[-1] + 1) // 2)) + 1) / BINS for name, c in zip(model.names, below, strict=True) if c[-1]}


def language_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every row of docs; score is the posterior of the prediction.

    Learns from all rows with text and language whose crc32(id as text) mod 3 is not 1; only the text gives inputs of a
    prediction. Null texts and texts without a letter get `und` with score 0, as does every row where nothing could be
    learnt. Rows with a null id are learnt from and scored; ids may have any type. Repeated rows count and are scored each.
    Ties go to the first language by name. Other columns are ignored, whatever their names; an empty table gives none. Whole
    texts are read, a long one by itself.
    """
    told = docs.select(F.col(id_col), language_verdict(docs, fit_languages(docs, id_col, text_col, lang_col), text_col).alias("told"))
    return told.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "told.lang_pred", "told.score")
