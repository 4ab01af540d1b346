"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are written by Spark's text writer (records have text payloads). They are read in splits: wherever the bytes look like
a record's beginning, the task of that split emits a candidate, its offset and the offset that its header says comes next, and
the digest of its payload. Pointer jumping over the candidates of a file, offsets alone, keeps those that the file's start
reaches: a record inside a payload is never reached. Only payloads that hold such bytes themselves are read a second time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from datetime import datetime, timezone
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, lookup, row_keys, shared_dir, tidy, without

#: Fixed by the format: the version line, the two line ends after a record, the digits of base32, the profile of revisits.
MAGIC, LINE, GAP = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What all version lines begin with; files are taken apart there.
MARK = "WARC/1."
#: Records a file has at most.
RECORDS = 20_000

_HEADER = re.compile(rb"[01]\r\n((?:[^\r\n]+\r\n)+)\r\n")
_PIECE = "path string, block long, seq long, size long, local long, length long, head long, content long, closed boolean, id string, url string, kind string, refers string, said_bytes long, said_digest string, digest string, raw binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: five hex digits give four letters."""
    digest = F.sha1(payload)
    letters = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), (F.shiftright(value, shift).bitwiseAND(31) + 1), F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, bytes, digest, refers): refers is the id of the record that has the same payload, null for itself; a
    revisit has no payload. Payloads stay where they are: what is joined are their digests, and of one payload with very many
    rows they stay spread."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), *row_keys(id_col, html_col),
    )
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    keyed = cut(rows.drop("payload").withColumn("same", F.concat_ws("/", "digest", "bytes")), "payloads")
    firsts = keyed.where((F.col("bytes") >= least_bytes) & F.col("id").isNotNull()).groupBy("same").agg(F.min("id").alias("refers"))
    later = lookup(keyed, cut(firsts, "first-payloads"), "same").where(F.col("id") > F.col("refers")).drop("same")
    later = cut(later, "revisits", keep=True)
    none = F.lit(None).cast(later.schema["refers"].dataType)
    responses = without(rows, later.select("key_a", "key_b").distinct(), ["key_a", "key_b"]).withColumn("refers", none)
    return responses.unionByName(later.withColumn("payload", F.lit("")).select(responses.columns)).drop("key_a", "key_b")


def write_warc(rows: DataFrame, path: str, records: int = RECORDS) -> None:
    """Write (id, url, payload, bytes, digest, refers) as records: a response with its payload, or a revisit without. Control
    characters, spaces and the mark of version lines in a url are percent-encoded."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(LINE))).otherwise("")
    urn = lambda value: F.concat(F.lit("<urn:page:"), F.replace(F.url_encode(value.cast("string")), F.lit(MARK), F.lit("WARC%2F1.")), F.lit(">"))
    revisit = F.col("refers").isNotNull()
    url = F.replace(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit(MARK), F.lit("WARC%2F1."))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("id")), F.lit("<urn:page>"))),
        line("WARC-Date", F.lit(datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"))),
        line("WARC-Target-URI", url),
        line("WARC-Profile", F.when(revisit, PROFILE)),
        line("WARC-Refers-To", urn(F.col("refers"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(LINE),
    )
    text = rows.select(F.concat(head, F.col("payload")).alias("value"))
    text.write.option("lineSep", GAP).option("maxRecordsPerFile", records).text(path)


def _page(value: bytes | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", (value or b"").decode("utf-8", "replace"))
    return unquote_plus(found[1]) if found else None


def parsed(piece: bytes) -> dict | None:
    """What a piece (the bytes from behind one mark up to the next) says if it looks like a record's beginning: head, the bytes
    before the payload, content, those of the payload, closed, whether the payload and the line ends after it are the rest of
    the piece; digest of a closed payload; and the header's fields."""
    m = _HEADER.match(piece)
    fields = dict(x.split(b": ", 1) for x in m[1].split(b"\r\n") if b": " in x) if m else {}
    size = fields.get(b"Content-Length", b"")
    if not (size.isdigit() and len(size) < 19):
        return None
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    said, end = fields.get(b"WARC-Payload-Length", b""), m.end() + int(size)
    closed = piece[end:] == GAP.encode()
    digest = base64.b32encode(hashlib.sha1(piece[m.end() : end]).digest()).decode() if closed else None
    return {
        "head": m.end(), "content": int(size), "closed": closed, "digest": digest, "kind": text(b"WARC-Type"), "url": text(b"WARC-Target-URI"),
        "id": _page(fields.get(b"WARC-Record-ID")), "refers": _page(fields.get(b"WARC-Refers-To")),
        "said_bytes": int(said) if said.isdigit() and len(said) < 19 else None, "said_digest": (text(b"WARC-Payload-Digest") or "").removeprefix("sha1:"),
    }


def pieces(files: DataFrame, raw: bool) -> DataFrame:
    """One row for each piece of files (value, path, block), in the splits that Spark reads: its place in the split (seq, and
    local, the bytes before it), its length, what `parsed` tells, and its bytes if raw."""

    def run(batches):
        here, seq, local = None, 0, 0
        for batch in batches:
            rows = []
            for value, path, block in zip(*(batch.column(c).to_pylist() for c in ("value", "path", "block")), strict=True):
                if (path, block) != here:
                    here, seq, local = (path, block), 0, 0
                row = {
                    "path": path, "block": block, "seq": seq, "size": len(value) + len(MARK), "local": local, "length": len(value),
                    "raw": value if raw else None,
                }
                rows.append(row | (parsed(value) or {}))
                seq, local = seq + 1, local + row["size"]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in kinds], [n for n, _ in kinds])

    arrow = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds = [(n, arrow[t]) for n, t in (f.split() for f in _PIECE.split(", "))]
    return files.mapInArrow(run, _PIECE)


def reachable(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Flags of the candidates that the chain from offset 0 reaches and that do not pass the end, by pointer jumping; each round
    doubles the reach. Offsets are in order."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    jump = np.where((at < n) & (successors < end), np.minimum(at, n - 1), n)
    jump = np.where((jump < n) & (offsets[np.minimum(jump, n - 1)] == successors), jump, n) if n else jump
    jump = np.append(jump, n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0 and offsets[0] == 0
    while True:
        new = reached.copy()
        new[jump[reached]] = True
        new[n] = False
        if (new == reached).all():
            return reached[:n] & (successors <= end)
        reached, jump = new, jump[jump]


def _chains(found: DataFrame) -> DataFrame:
    """The candidates among pieces with `at`, `next`, and `reached`: whether the chain of their file reaches them."""
    blocks = found.groupBy("path", "block").agg(F.sum("size").alias("bytes"))
    upto = F.sum("bytes").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, 0))
    blocks = blocks.select(
        F.col("path").alias("b_path"), F.col("block").alias("b_block"), (upto - F.col("bytes")).alias("base"),
        (F.sum("bytes").over(W.partitionBy("path")) - len(MARK)).alias("end"),
    )
    placed = found.where("content is not null").join(
        blocks, (F.col("path") == F.col("b_path")) & (F.col("block") == F.col("b_block")),
    ).drop("b_path", "b_block")
    placed = placed.withColumn("at", F.col("base") + F.col("local") - len(MARK)).withColumn(
        "next", F.col("at") + len(MARK) + F.col("head") + F.col("content") + len(GAP),
    ).drop("base", "raw")

    def jump(key, table):
        order = np.argsort(np.asarray(table.column("at")), kind="stable")
        table = table.take(pa.array(order))
        at, after = np.asarray(table.column("at")), np.asarray(table.column("next"))
        flags = reachable(at, after, int(table.column("end")[0].as_py()))
        return table.append_column("reached", pa.array(flags))

    shape = ", ".join(f"{n} {t}" for n, t in placed.dtypes) + ", reached boolean"
    return placed.groupBy("path").applyInArrow(jump, shape)


def _files(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MARK).option("pathGlobFilter", "*.txt").text(path)
    return text.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def _spanning(spark: SparkSession, path: str, found: DataFrame, records: DataFrame) -> DataFrame:
    """(path, at, digest, closed) of the records whose payload goes on behind a mark inside it. Their pieces are read again."""
    some = records.select("path", "block", "seq", "at", "next", "head", "content")
    blocks = found.groupBy("path", "block").agg(F.sum("size").alias("bytes"))
    base = F.sum("bytes").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - F.col("bytes")
    placed = found.select("path", "block", "seq", "local").join(
        blocks.select("path", "block", base.alias("base")), ["path", "block"],
    ).withColumn("place", F.col("base") + F.col("local") - len(MARK))
    # The pieces of a file that lie inside a record are those between it and the next: each meets the last record before it.
    marks = placed.select("path", "block", "seq", "place", F.lit(None).cast("long").alias("own"), F.lit(None).cast("long").alias("until"))
    starts = some.select(
        "path", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("seq"), F.col("at").alias("place"),
        F.col("at").alias("own"), F.col("next").alias("until"),
    )
    before = W.partitionBy("path").orderBy("place", F.col("block").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    both = marks.unionByName(starts).withColumn("record", F.last("own", True).over(before)).withColumn("until", F.last("until", True).over(before))
    inside = cut(
        both.where("block is not null and record is not null and place < until").select("path", "block", "seq", "record", "place"),
        "inside-pieces",
    )
    again = pieces(_files(spark, path), True).select("path", "block", "seq", "raw").join(inside, ["path", "block", "seq"])
    mark = F.lit(MARK.encode())
    whole = again.groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("place", "raw"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, p: F.concat(all_, mark, p["raw"]))
    whole = whole.select("path", F.col("record").alias("at"), joined.alias("bytes")).join(some.drop("block", "seq"), ["path", "at"])
    begin = F.col("head") + len(MARK)
    piece = lambda start, size: F.substring(F.col("bytes"), (start + 1).cast("int"), size.cast("int"))
    closed = piece(begin + F.col("content"), F.lit(len(GAP))) == F.lit(GAP.encode())
    return whole.select("path", "at", base32_sha1(piece(begin, F.col("content"))).alias("digest"), closed.alias("closed"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(id, url, record_type, payload_bytes, payload_digest, refers_to) of the records that each file's chain reaches.

    Length and digest of a response are of the payload read; those of a revisit are what its header says of the payload
    that it refers to. Whatever looks like a record inside a payload is left out. A chain that breaks off ends there: a record
    that passes the end of its file, or that two line ends do not follow, is left out; broken_chains counts such files. Ids are
    strings. Offsets of a file's candidates, not its bytes, meet in one task.
    """
    with tidy(spark):
        return _read(spark, path)[0]


def broken_chains(spark: SparkSession, path: str) -> DataFrame:
    """(path, records, lost_bytes) of the files whose chain of well-closed records ends before the file does."""
    with tidy(spark):
        return _read(spark, path)[1]


def _read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    found = cut(pieces(_files(spark, path), False), "pieces")
    records = cut(_chains(found).where("reached"), "reached")
    open_ = records.where("not closed")
    if not open_.isEmpty():
        spans = cut(_spanning(spark, path, found, open_), "spanning").withColumnsRenamed({"digest": "span_digest", "closed": "span_closed"})
        records = records.join(spans, ["path", "at"], "left").withColumn("digest", F.coalesce("digest", "span_digest")).withColumn(
            "closed", F.col("closed") | F.coalesce("span_closed", F.lit(False)),
        )
    # What comes after a record that is not closed is not known to be one.
    bad = records.where("not closed").groupBy("path").agg(F.min("at").alias("bad"))
    records = records.join(bad, "path", "left").where("bad is null or at < bad")
    ends = found.groupBy("path").agg((F.sum("size") - len(MARK)).alias("bytes"))
    broken = ends.join(records.groupBy("path").agg(F.count("*").alias("records"), F.max("next").alias("upto")), "path", "left")
    broken = broken.select(
        "path", F.coalesce("records", F.lit(0)).alias("records"), (F.col("bytes") - F.coalesce("upto", F.lit(0))).alias("lost_bytes"),
    ).where("lost_bytes > 0")
    revisit = F.col("kind") == "revisit"
    told = records.select(
        "id", "url", F.col("kind").alias("record_type"),
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"), F.col("refers").alias("refers_to"),
    )
    return cut(told, "records", keep=True), cut(broken, "broken-chains", keep=True)


def archive_round_trip(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, records: int = RECORDS,
) -> DataFrame:
    """(id_col, payload_bytes, payload_digest, record_type, refers_to) of every row of pages, written to archives in the
    shared folder and read back.

    Payload: the html in UTF-8 (null: empty). Of the rows with equal payloads of at least least_bytes, those with the
    smallest id are responses and the others revisits of it; shorter ones are all responses. Ids may have any type that is
    ordered and can be written as a string; a null id is never referred to and never refers. Repeated rows are records each.
    Payloads of any length are read; they are never held but in the task that reads them. Other columns are ignored, whatever
    their names; an empty table gives none.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    with tidy(spark):
        write_warc(with_revisits(pages, id_col, url_col, html_col, least_bytes), path, records)
    kind = pages.schema[id_col].dataType
    read = read_warc(spark, path)
    return read.select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
