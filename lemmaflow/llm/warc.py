"""WARC archives, and their capture index by external merging."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_value, materialize, shared_dir

#: Payloads under this many bytes are never revisits. Duplicate digests up to which they are broadcast.
LEAST, BROADCAST_ROWS = 100, 200_000
#: Packed bytes of an archive, but for one record that is longer; records handed to a packing worker at once.
ARCHIVE, BATCH = 16 << 20, 256
#: Captures that one task of the merge takes, in the mean, whatever their number: it holds their index rows only.
RANGE = 50_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, ``)``, and the rest. Null is empty; URLs without ``://`` stay as they are."""
    if not url or (at := url.find("://")) < 0:
        return url or ""
    host, rest = re.fullmatch(r"([^/?#]*)(.*)", url[at + 3 :], re.DOTALL).groups()
    return ",".join(reversed(host.translate(_LOWER).split("."))) + ")" + rest


def _whole_numbers(df: DataFrame, col: str) -> bool:
    return df.select(F.col(col)).schema[0].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def _record_id(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured: Column | None = None, least: int = LEAST) -> None:
    """Writes one WARC record for each row, a gzip member of its own, in archives of about ``ARCHIVE`` bytes under ``path``.

    Records are packed in Python; files are written by Spark's text writer, one archive a line and a line a file, so
    tasks that are lost or run twice leave no partial files, and any file system will do. (The line's end is a zero
    byte. That is the last byte of a member's length, which is left to the writer; a record of 16 MB or more at the
    end of an archive has another one there, and a zero byte of padding after it.) Rows with equal payloads of at least
    ``least`` bytes: the one with the smallest id is a response, the others are revisits of it and carry no payload.
    Null payloads are empty; a null id or URL has no header; line ends in URLs are percent-encoded. Ids are whole
    numbers or text. ``captured`` is the time of capture; by default a numeric id counts seconds.
    Rows repeated with the smallest id are all responses.
    """
    spark, numbers = pages.sparkSession, _whole_numbers(pages, id_col)
    body, page = F.coalesce(F.col(payload_col), F.lit("")), F.col(id_col).cast("long" if numbers else "string")
    when = captured if captured is not None else F.timestamp_seconds(F.coalesce(page, F.lit(0)) if numbers else F.lit(0))
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    p = pages.select(page.alias("id"), url.alias("url"), body.alias("body"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"))
    p = p.withColumn("n", F.octet_length("body").cast("long")).withColumn("digest", F.sha2("body", 256))
    twice = p.where(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("first")).where("copies > 1").select("digest", "first")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_ROWS else twice
    p = p.join(twice, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    end = F.lit("\r\n")

    def header(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, end)).otherwise("")

    def shown(page: Column) -> Column:
        return page.cast("string") if numbers else F.url_encode(page)

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("body")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", _record_id(F.coalesce(F.col("id").cast("string"), F.lit("null")))),
        header("WARC-Date", F.col("at")),
        header("WARC-Target-URI", F.col("url")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        header("WARC-Profile", F.when(revisit, PROFILE)),
        header("WARC-Refers-To", F.when(revisit, _record_id(F.col("first")))),
        header("X-Page-ID", shown(F.col("id"))),
        header("X-Refers-To-Page-ID", F.when(revisit, shown(F.col("first")))),
        header("Content-Type", F.lit("application/http;msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        end,
        block,
        F.lit("\r\n\r\n"),
    )
    packed = p.select(record.cast("binary").alias("record")).mapInArrow(_packer(ARCHIVE), "archive binary")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(min(int(before) if int(before) > 0 else BATCH, BATCH)))  # pages may be long
    try:
        packed.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    finally:
        spark.conf.set(setting, before)


def _packer(most: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archive(members: list[bytes]) -> pa.RecordBatch:
            whole = b"".join(members)
            return pa.record_batch([pa.array([whole[:-1] if whole.endswith(b"\0") else whole], pa.binary())], ["archive"])

        members, size = [], 0
        for b in batches:
            for record in b.column(0):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(record.as_py()) + z.flush()
                if members and size + len(member) > most:
                    yield archive(members)
                    members, size = [], 0
                members.append(member)
                size += len(member)
        if members:
            yield archive(members)

    return pack


def parse(packed: bytes, at: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes, bytes]]:
    """``(offset, length, headers, http head, payload)`` of each record of an archive from ``at`` on, a record at a time."""
    view = memoryview(packed)
    while at < len(view) and bytes(view[at : at + 2]) != b"\0":
        z, pieces, begin = zlib.decompressobj(31), [], at
        while not z.eof:
            if at >= len(view):
                raise ValueError("the archive ends within a record")
            piece = view[at : at + (1 << 16)]
            pieces.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        record = b"".join(pieces)
        head, _, block = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:] if x)
        n = int(headers["Content-Length"])
        if block[n:] != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        http, _, payload = block[:n].partition(b"\r\n\r\n")
        yield begin, at - begin, headers, http, payload


def _row_order(row: tuple) -> tuple:
    """Of ``(url_key, captured, page_id, ...)``: null ids first."""
    return row[0], row[1], row[2] is not None, row[2] if row[2] is not None else 0


def _captures(numbers: bool):
    """A sorted run for each archive, a row for each record; the payload of a response is checked against its digest."""
    read = int if numbers else unquote_plus
    page = pa.int64() if numbers else pa.string()
    kinds = (pa.string(), pa.string(), page, pa.string(), pa.int64(), pa.string(), pa.string(), page, pa.string(), pa.int64(), pa.int64())
    names = ["url_key", "captured", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, packed in zip(b.column(0), b.column(1), strict=True):
                rows: list[tuple] = []
                for at, size, h, http, payload in parse(packed.as_py()):
                    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    if h["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"record {h['WARC-Record-ID']}: the payload is not the one written")
                    url, ids = h.get("WARC-Target-URI"), [None if (x := h.get(k)) is None else read(x) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                    rows.append((url_key(url), h["WARC-Date"], ids[0], url, length, digest, h["WARC-Type"], ids[1], file.as_py(), at, size))
                rows.sort(key=_row_order)
                for k in range(0, len(rows), 5000):
                    yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names)

    return captures


def _index_schema(numbers: bool) -> str:
    page = "bigint" if numbers else "string"
    return f"url_key string, captured string, page_id {page}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {page}, file string, offset bigint, length bigint"


def read_archives(spark: SparkSession, path: str, numbers: bool = True) -> DataFrame:
    """A row for each record of the archives under ``path``: its key, headers, file, and the place of its member there.

    Each archive gives a sorted run. ``numbers``: ids are whole numbers, else text.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_captures(numbers), _index_schema(numbers))


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, the overall winner is on top."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.heads: list[Any] = [next(r, None) for r in runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:  # building: the first to come waits
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[top := self.tree[0]] is not None:
            yield self.heads[top]
            self.heads[top] = next(self.runs[top], None)
            self._play(top)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges a key range's stretches of sorted runs, which come one after another, into one history."""
    table = pa.Table.from_batches(found) if (found := list(batches)) else None
    if table is None or not table.num_rows:
        return
    table = table.combine_chunks()
    keys = list(map(_row_order, zip(*(table.column(k).to_pylist() for k in range(3)), strict=True)))
    of = table.column("file").combine_chunks().dictionary_encode().indices.to_numpy()
    edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(keys)]
    tree = LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(edges, edges[1:])])
    order = np.fromiter((i for _, i in tree), np.int64, len(keys))
    for k in range(0, len(order), 5000):
        yield from table.take(order[k : k + 5000]).combine_chunks().to_batches()


def capture_index(captures: DataFrame, per_range: int = RANGE) -> DataFrame:
    """The captures ordered by URL key, time and page id: each output partition is the next stretch of the order.

    Ranges of the whole key, as many as the captures need at ``per_range`` each, deal the captures out, so that even
    one URL's history spans partitions and a task's memory doesn't grow with the corpus. Within a range every
    archive's captures are a stretch of its sorted run, and a loser tree merges the runs.
    """
    order = ["url_key", "captured", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ranges = captures.repartitionByRange(max(1, -(-captures.count() // per_range)), *order)
    return ranges.sortWithinPartitions("file", *order[:3], "offset").mapInArrow(_merge, captures.schema)


def archive_pages(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives (under ``path``, or a new folder in the shared one), reads them back and indexes them.

    A row for each row of ``pages``: ``(url_key, captured, page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, file, offset, length)``, in the order of the index; the member at ``offset`` of ``file`` is the record.
    Null ids, URLs and payloads, repeated rows and empty tables are as ``write_archives`` says; other columns are not read.
    """
    import uuid

    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col, url_col, payload_col)
    runs = materialize(read_archives(pages.sparkSession, path, _whole_numbers(pages, id_col)), "runs")
    return capture_index(runs).withColumnRenamed("page_id", id_col)


by_value(__name__)
