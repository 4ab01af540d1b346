"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

The statistics of the labelled texts are made by numpy on Arrow batches; the class sums that means and covariances need are
added up by Spark, and only (1 + d) * (1 + d) numbers a class reach the driver. Scores are differences of two Gaussian log
densities, whose Mahalanobis terms use Cholesky factors made once and broadcast (d * d numbers). A score is a function of
the row's text alone, so it is a column beside the others: no join brings scores to texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repetition import SYMBOLS, Measures, _per_row
from .shared import U, cut, maybe_broadcast, mix, steps, text_function, tidy

_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = (_BYTES >= 97) & (_BYTES <= 122)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
HIGH = _BYTES >= 0x80
COMMON = np.isin(_BYTES, np.frombuffer(b".,;:'\"-()?", np.uint8))
SHOUT = _BYTES == 0x21
STATISTICS = [
    "symbols", "upper", "digits", "common_marks", "shouts", "other", "word_chars", "word_spread", "distinct", "repeat_3", "dup_lines",
    "marked_words", "top_word", "one_char_words",
]


def _statistics(column: pa.Array) -> np.ndarray:
    """(rows, d): shares of characters and words on a square-root scale, word lengths as logarithms."""
    m = Measures(column)
    chars, words = np.maximum(m.word_chars, 1), np.maximum(m.n_words, 1)
    counts = {k: m.count(t) for k, t in (("symbols", SYMBOLS), ("upper", UPPER), ("lower", LOWER), ("digits", DIGIT), ("high", HIGH), ("common_marks", COMMON), ("shouts", SHOUT))}
    other = np.maximum(
        chars - sum(counts[k] for k in ("symbols", "upper", "lower", "digits", "common_marks", "shouts")) - counts["high"] // 2, 0,
    )
    mean = m.word_chars / words
    square = np.bincount(m.row, m.size.astype(float) ** 2, m.rows) / words
    key = mix(m.words + mix(m.row.astype(U)))
    kinds, first, times = np.unique(key, return_index=True, return_counts=True)
    distinct = np.bincount(m.row[first], minlength=m.rows)
    top = np.zeros(m.rows, np.int64)
    np.maximum.at(top, m.row[first], times)
    line_row, line_chars, again, _ = m.lines()
    last = m.texts.bytes[m.end - 1] if len(m.end) else np.zeros(0, np.uint8)
    marked = _per_row((SYMBOLS | SHOUT)[last], m.row, m.rows)
    short = _per_row(m.size == 1, m.row, m.rows)
    share = lambda x, y: np.sqrt(np.clip(x / y, 0, 1))
    return np.stack(
        [
            share(counts["symbols"], chars), share(counts["upper"], chars), share(counts["digits"], chars), share(counts["common_marks"], chars), share(counts["shouts"], chars), share(other, chars),
            np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean**2, 0))), distinct / words, share(m.covered(3)[0], words), share(_per_row(line_chars[again], line_row[again], m.rows), chars),
            share(marked, words), share(top, words), share(short, words),
        ],
        axis=1,
    )


#: Labelled rows that a model is fitted on at most, about: beyond it a sample by the hash of their ids.
SAMPLE = 50_000


def sampled(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows of (label_id, ...): all, or where they are more than `most`, about 95 % of that many ids by their hash."""
    n = labels.count()
    if n <= most:
        return labels
    return labels.where(F.pmod(F.xxhash64("label_id", F.lit(29)), F.lit(1 << 30)) < int((1 << 30) * 0.95 * most / n))


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = SAMPLE) -> DataFrame:
    """(label, text) of the rows of docs that labels (label_id, label) name. Texts do not move: the labels, a bounded sample,
    are broadcast. A label row counts once for each row of docs with its id."""
    known = cut(sampled(labels, most), "sampled-labels")
    known = maybe_broadcast(known, known.count(), 64)
    return docs.select(
        F.col(id_col).alias("label_id"), F.col(text_col).cast("string").alias("text"),
    ).join(known, "label_id").select("label", "text")


def class_sums(rows: DataFrame, read) -> dict[int, np.ndarray]:
    """By label the sums of 1, x and x xT, in one array. read: from an Arrow batch of rows to pairs (labels, x); reading and
    adding up are one function, so that a task has one Python worker."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for label, x in (pair for batch in batches for pair in read(batch)):
            x = np.hstack((np.ones((len(x), 1)), x))
            for k in np.unique(label):
                own = x[label == k]
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        for k, s in sums.items():
            s = s.ravel()
            at = np.arange(len(s), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(at), pa.array(s)], ["label", "at", "value"])

    parts = rows.mapInArrow(run, "label int, at int, value double")
    added = parts.groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    d = round(max((r["at"] + 1 for r in added), default=1) ** 0.5)
    out: dict[int, np.ndarray] = {}
    for r in added:
        out.setdefault(r.label, np.zeros(d * d))[r.at] = r.value
    return {k: v.reshape(d, d) for k, v in out.items()}


class Discriminant:
    """Gaussians of the classes, with covariances shrunk to the pooled one and to its mean variance."""

    def __init__(self, sums: dict[int, np.ndarray], shrink: float, ridge: float):
        total = sum((s[0, 0] for s in sums.values()), 0.0)
        self.share = {k: float(s[0, 0] / total) for k, s in sums.items()}
        self.classes = {}
        cov = {k: s[1:, 1:] / s[0, 0] - np.outer(s[0, 1:], s[0, 1:]) / s[0, 0] ** 2 for k, s in sums.items()}
        pooled = sum(s[0, 0] * cov[k] for k, s in sums.items()) / max(total, 1.0)
        for k, s in sums.items():
            own = (1 - shrink) * cov[k] + shrink * pooled
            own += ridge * max(np.trace(own) / len(own), 1e-9) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.classes[k] = (s[0, 1:] / s[0, 0], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(s[0, 0] / total))

    def log_joint(self, x: np.ndarray, k: int) -> np.ndarray:
        """Log density of class k and log share of it."""
        mean, inverse, det, weight = self.classes[k]
        return weight - 0.5 * (det + (((x - mean) @ inverse.T) ** 2).sum(1))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        if not {0, 1} <= set(self.classes):
            return np.full(len(x), self.share.get(1, 0.0 if self.share else 0.5))
        return 1 / (1 + np.exp(np.clip(self.log_joint(x, 0) - self.log_joint(x, 1), -700, 700)))


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text falls into that part."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    shrink: float = 0.1,
    ridge: float = 1e-3,
    most: int = SAMPLE,
) -> Discriminant:
    """The fitted discriminant; see quality_scores for what it learns from."""
    known = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("label in (0, 1) and label_id is not null").where(~held_out("label_id", 4, 2))
    with tidy(docs.sparkSession):
        learnt = labelled_texts(docs, known, id_col, text_col, most)
        return Discriminant(class_sums(learnt, _labelled_statistics), shrink, ridge)


def _labelled_statistics(batch: pa.RecordBatch):
    """(labels, statistics) of slices of (label, text)."""
    for part in steps(batch, "text"):
        yield np.asarray(part.column("label")), _statistics(part.column("text"))


def quality_verdict(docs: DataFrame, model: Discriminant, text_col: str, threshold: float = 0.7):
    """struct(score, predicted) of the texts of docs by a fitted discriminant."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> list:
        score = shared.value.score(_statistics(texts))
        return [score, (score >= threshold).astype(np.int32)]

    return text_function(run, "score double, predicted int")(F.col(text_col).cast("string"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.7,
    shrink: float = 0.1,
    ridge: float = 1e-3,
    most: int = SAMPLE,
) -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs: score in 0 to 1, higher where label 1 is likelier.

    Learns from rows of labels with label 0 or 1 whose crc32(id as text) mod 4 is not 2 and whose document is there, from
    about `most` of them at most (a sample by the hash of the id); only the text gives inputs. Null and empty texts are
    scored as texts without words. Where one class or both lack rows, every score is the share of label 1 (0.5 without
    rows). Rows with null ids are scored and never learnt from; ids may have any type; repeated rows are scored each, and
    repeated label rows count each. Other columns are ignored, whatever their names; an empty table gives none.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, shrink, ridge, most)
    out = docs.select(F.col(id_col), quality_verdict(docs, model, text_col, threshold).alias("verdict"))
    return out.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "verdict.*")
