"""Fill-in-middle transformation: texts cut at unit borders into prefix, middle and suffix, reordered around sentinels.

One match of the regex library against (unit)* keeps every repetition of its group; the group's ends are the units' ends, so
their number and both cut offsets are read off the match. The texts stay where they are: a task returns three numbers a row,
and the output is put together and taken apart again by column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, spare_name

#: A unit: a line with its line end, or a last line without one. Possessive, so that a match never goes back.
UNIT = r"[^\n]*+\n|[^\n]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SHAPE = "n bigint, prefix_end bigint, middle_end bigint"


def unit_ends(text: str, pattern: regex.Pattern) -> list[int]:
    """The ends, in code points, of the units that a text is made of; `pattern` is (unit)*. ValueError where units leave a gap."""
    match = pattern.fullmatch(text)
    if match is None:
        raise ValueError("the units do not cover the whole text")
    return match.ends(1)


def _cuts(unit: str):
    """A function of (text, first draw, second draw) to a struct of n, prefix_end and middle_end."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        pattern = regex.compile(f"({unit})*+")
        for texts, first, second in batches:
            out = np.zeros((3, len(texts)), np.int64)
            for i, (text, a, b) in enumerate(zip(texts, np.asarray(first), np.asarray(second), strict=True)):
                ends = unit_ends(text.as_py(), pattern)
                low, high = sorted((int(a) % (len(ends) + 1), int(b) % (len(ends) + 1)))
                out[:, i] = len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0
            yield pa.StructArray.from_arrays([pa.array(x) for x in out], ["n", "prefix_end", "middle_end"])

    return F.arrow_udf(run, _SHAPE).asNondeterministic()  # not to be run again for each place that the plan names it


def draws(id_col: str, seed: int) -> list[Column]:
    """Four 32-bit numbers of a row: the first hex digits of the sha256 of seed, colon and id (nothing for a null id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    unit: str = UNIT,
) -> DataFrame:
    """One row for each row of docs: id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if
    plain) and output, the text to train on.

    Cuts are drawn by seed and id among the n + 1 borders of units, both alike at times: an empty middle. plain, the text as it
    is: empty and null texts, texts that hold a sentinel, and 100 - fim_percent in a hundred others; spm_percent in a hundred
    of the rest get the suffix first. Repeated rows come out alike; rows of a null id share one draw, that of an empty id. Ids
    may be of any type, other columns are ignored, whatever their names; an empty table gives none. Whole texts are read and
    written, a long one by itself; no row moves.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), F.array(*draws(id_col, seed)).alias("_draws"))
    cuts = rows.withColumn("_cut", _cuts(unit)("_text", F.col("_draws")[0], F.col("_draws")[1]))
    p, s, m = sentinels
    holds = F.lit(False)
    for sentinel in sentinels:
        holds = holds | F.col("_text").contains(sentinel)
    plain = (F.col("_text") == "") | holds | (F.col("_draws")[2] % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("_draws")[3] % 100 < spm_percent, "spm").otherwise("psm")
    low, high = F.col("_cut.prefix_end").cast("int"), F.col("_cut.middle_end").cast("int")
    prefix, middle = F.substring("_text", F.lit(1), low), F.substring("_text", low + 1, high - low)
    suffix = F.substring("_text", high + 1, F.length("_text"))
    output = F.when(F.col("form") == "plain", F.col("_text")).when(
        F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle),
    ).otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
    split = F.col("form") != "plain"
    return cuts.withColumn("form", form).select(
        id_col, F.col("_cut.n").alias("n"), "form", F.when(split, F.col("_cut.prefix_end")).alias("prefix_chars"),
        F.when(split, F.col("_cut.middle_end") - F.col("_cut.prefix_end")).alias("middle_chars"), output.alias("output"),
    )


def restored(
    rows: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
) -> DataFrame:
    """rows with the text that each output was made of, taken from output and form alone (null if either is null). A name that rows
    have already gets an underscore."""
    p, s, m = sentinels
    output, name = F.col(output_col), spare_name(rows, name)

    def between(a: str, b: str) -> Column:
        begin = F.instr(output, a) + len(a)
        return F.substring(output, begin, F.instr(output, b) - begin)

    middle = F.substring(output, F.instr(output, m) + len(m), F.length(output))
    text = F.when(F.col(form_col) == "psm", F.concat(between(p, s), middle, between(s, m))).when(
        F.col(form_col) == "spm", F.concat(between(p, m), middle, between(s, p)),
    ).when(F.col(form_col) == "plain", output)
    return rows.withColumn(name, text)
