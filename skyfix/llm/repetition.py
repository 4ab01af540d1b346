"""Quality rules by repetition coverage: how many characters of a text lie inside n-grams and lines that it repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, Texts, U, mix, small_batches, text_function

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Share of a text's word characters that repeated n-grams of each length may cover, and repeated lines.
NGRAM_LIMITS = {5: 0.40, 8: 0.35, 12: 0.30}
LINE_LIMIT = 0.30


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows).astype(np.int64)


def _twice(key: np.ndarray) -> np.ndarray:
    """Flags of the values that occur twice or more."""
    order = np.argsort(key)
    sorted_key = key[order]
    same = sorted_key[1:] == sorted_key[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Flags of the values that an earlier place has too."""
    _, first = np.unique(key, return_index=True)
    out = np.ones(len(key), bool)
    out[first] = False
    return out


def repeated_words(rolling: Rolling, row: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words inside n-word windows that their row has twice or more, the first included."""
    if len(row) < n:
        return np.zeros(len(row), bool)
    inside = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :])
    again = inside[_twice(mix(rolling.of(n)[inside] + mix(row[inside].astype(U))))]
    cover = np.zeros(len(row) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + n, -1)
    return np.cumsum(cover[:-1]) > 0


class Measures:
    """Word, line and character counts of the rows of a text column."""

    def __init__(self, column: pa.Array):
        self.texts = texts = Texts(column, lower=False)
        self.rows = rows = len(texts.offs) - 1
        self.start, self.end, self.row = texts.words()
        self.points = np.concatenate(([0], np.cumsum((texts.bytes & 0xC0) != 0x80)))
        self.size = self.points[self.end] - self.points[self.start]
        self.words = texts.hashes(self.start, self.end)
        self.rolling = Rolling(self.words)
        self.n_words = np.bincount(self.row, minlength=rows).astype(np.int64)
        self.word_chars = _per_row(self.size, self.row, rows)

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each row that the table of 256 flags has."""
        upto = np.concatenate(([0], np.cumsum(table[self.texts.bytes])))
        return upto[self.texts.offs[1:]] - upto[self.texts.offs[:-1]]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, word characters, flag of being equal to an earlier line, n_lines of each row) of the lines that have a word."""
        offs = self.texts.offs
        starts = np.unique(np.concatenate((offs[:-1], np.flatnonzero(self.texts.bytes == 10) + 1)))
        starts = starts[starts < len(self.texts.bytes)]
        ends = np.concatenate((starts[1:], [len(self.texts.bytes)]))[: len(starts)]
        ends = ends - (self.texts.bytes[ends - 1] == 10)
        line = np.searchsorted(starts, self.start, "right") - 1
        chars = np.bincount(line, self.size, len(starts)).astype(np.int64)
        some = np.bincount(line, minlength=len(starts)) > 0
        starts, ends, chars = starts[some], ends[some], chars[some]
        row = np.searchsorted(offs, starts, "right") - 1
        again = _later(mix(self.texts.hashes(starts, ends) + mix(row.astype(U)))) if len(starts) else np.zeros(0, bool)
        return row, chars, again, np.bincount(row, minlength=self.rows)

    def covered(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words, word characters) of each row inside repeated n-word windows."""
        flags = repeated_words(self.rolling, self.row, n)
        return np.bincount(self.row[flags], minlength=self.rows).astype(np.int64), _per_row(self.size[flags], self.row[flags], self.rows)


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram_limits: dict[int, float] | None = None,
    line_limit: float = LINE_LIMIT,
) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and
    the shares of word characters inside repeated n-grams (dup_<n>) and repeated lines (dup_lines).

    Words are runs of anything but ASCII white space. base_failed: fewer than 50 words, or over half of them in 3-word
    windows that the text repeats. kept: not base_failed, and no share above its limit. Null and empty texts have no words
    and so fail. Repeated rows are judged each; ids may be null and of any type; other columns are ignored, whatever their
    names; an empty table gives none. Whole texts are read, a long one by itself. N-grams and lines are compared by 64-bit
    hashes within a text.
    """
    limits = NGRAM_LIMITS if ngram_limits is None else ngram_limits
    small_batches(docs.sparkSession)

    def run(texts: pa.Array) -> list:
        m = Measures(texts)
        line_row, line_chars, again, _ = m.lines()
        chars = np.maximum(m.word_chars, 1)
        repeat, _ = m.covered(3)
        shares = [m.covered(n)[1] / chars for n in limits]
        shares.append(_per_row(line_chars[again], line_row[again], m.rows) / chars)
        failed = (m.n_words < 50) | (100 * repeat > 50 * m.n_words)
        over = np.any([share > limit for share, limit in zip(shares, [*limits.values(), line_limit], strict=True)], axis=0)
        dup_lines = np.bincount(line_row[again], minlength=m.rows).astype(np.int64)
        return [m.n_words, m.word_chars, m.count(SYMBOLS).astype(np.int64), dup_lines, repeat, failed, ~failed & ~over, *shares]

    shape = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    shape += "base_failed boolean, kept boolean, " + ", ".join(f"dup_{n} double" for n in [*limits, "lines"])
    measured = text_function(run, shape)(F.col(text_col).cast("string"))
    return docs.select(F.col(id_col), measured.alias("measured")).select(id_col, "measured.*")
