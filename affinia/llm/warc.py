"""WARC archives of pages, and their index by an external merge.

`write_archives` writes one WARC/1.1 record per page: of equal payloads the page with the largest id is
a response, the others are revisits of it, without the payload. `read_archives` reads the files back,
checks each payload against its digest and gives one index row per record; each file's rows are sorted
by URL key, time and page: a sorted run. `merged_index` deals the runs by range, Spark's sorter (which
spills) puts each partition's part of a run together, and a loser tree merges those parts as they are
read, so that the output's partitions, in order, hold the capture histories of all URLs in order. A
partition's parts are held as Arrow columns; of each run only a few rows are Python objects at a time.

Archives are gzip files in the shared folder, written and read by Spark alone, which writes a file as one
gzip member; a record's place is that in the unpacked file. Files are unpacked piece by piece. Payloads
cross one shuffle, by their digest, in which Spark can split a hot payload.

Defined results: null html is an empty payload, a null url an empty one; a null page_id is never the
page referred to unless all its copies have none. Rows that repeat the id and the payload of a response
are responses too, and rows with one id have one WARC-Record-ID. A payload may be as long as Spark's
strings; its record is in memory as a whole. Line breaks in a url are percent-encoded. A capture's time is the page's id in
seconds after a fixed day. Extra columns are ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinia.llm.common import new_path, stored

#: Payloads of fewer bytes are never revisits.
MIN_BYTES = 0
#: Records of a file, so that a task can hold a file.
PER_FILE = 5_000
#: Seconds of the first capture (2020-01-01).
EPOCH = 1_577_836_800
_HEX5 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

INDEX = "url_key string, captured_at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, at long"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits give four of base32."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _HEX5)


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """WARC files of pages (page_id, url, html) under path."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    page = page.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    same = page.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    joined = page.join(same.where("n > 1").select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    sha = F.concat(F.lit("sha1:"), base32(F.col("digest")))
    id_ = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"),
        id_,
        F.lit(">\r\nWARC-Date: "),
        F.date_format(F.timestamp_seconds(F.coalesce(F.col("page_id"), F.lit(0)) + EPOCH), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "),
        F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")),
        F.lit("\r\nWARC-Payload-Digest: "),
        sha,
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # The writer ends each row with the last line feed of the record.
    joined.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def _unpacked(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked bytes of a gzip file of one or more members, piece by piece."""
    while content:
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = z.decompress(content, size)
            content = z.unconsumed_tail
            if piece:
                yield piece
            elif not content and not z.eof:
                raise ValueError("the archive ends within a gzip member")
        content = z.unused_data


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of each record of an archive."""
    pieces, held, at = _unpacked(content), bytearray(), 0

    def reach(n: int) -> bool:
        while len(held) < n:
            piece = next(pieces, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while reach(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not reach(len(held) + 1):
                raise ValueError(f"the record at byte {at} has no end of its headers")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(headers["content-length"])
        if not reach(stop):
            raise ValueError(f"the record at byte {at} is cut off")
        reach(stop + 4)
        yield at, headers, bytes(held[start:stop])
        del held[: stop + 4]
        at += stop + 4


def url_key(url: str) -> str:
    """The sort key of a URL: host parts reversed, then the path, in lower case."""
    rest = url.lower().partition("://")[2] or url.lower()
    host, slash, path = rest.partition("/")
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path


def _page(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def index_row(file: str, at: int, headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{file}: the record at byte {at} doesn't match its digest")
    page = _page(headers["warc-record-id"])
    url = headers["warc-target-uri"]
    return url_key(url), EPOCH + (page or 0), page, size, digest, kind, _page(headers.get("warc-refers-to")), url, file, at


def order_of(row: tuple) -> tuple:
    """Key, time, page (null first), file and place: no two records are alike."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 5000) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)
            some = []
    if some:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in INDEX.split(", "))])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """An index row of each record under path; the rows of a file are a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = file.rsplit("/", 1)[-1]
                yield from _batches(sorted((index_row(name, *r) for r in records(content.as_py())), key=order_of), _arrow_schema())

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """Merges sorted runs; each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.n = max(1, len(runs))
        self.heads = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.n
        self.winner = 0
        winners = [-1] * self.n + list(range(self.n))
        for node in range(self.n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        if self.n > 1:
            self.winner = winners[1]

    def _next(self, run: int) -> tuple | None:
        row = next(self.runs[run], None)
        return None if row is None else (order_of(row), row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[0] <= y[0])

    def __iter__(self) -> Iterator[tuple]:
        while self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w][1]
            self.heads[w] = self._next(w)
            node = (w + self.n) // 2
            while node:
                if self.losers[node] >= 0 and not self._before(w, self.losers[node]):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _rows_of(pieces: list[pa.RecordBatch], size: int = 256) -> Iterator[tuple]:
    for piece in pieces:
        for low in range(0, piece.num_rows, size):
            yield from zip(*(c.to_pylist() for c in piece.slice(low, size).columns), strict=True)


def merged_index(runs: DataFrame) -> DataFrame:
    """The rows of all runs in order of URL key and time: partition after partition, and within each.

    A partition takes a range of (key, time, page) from each run and merges the pieces; equal keys
    may lie in neighbouring partitions, so one URL of many captures is not one task.
    """
    order = ["url_key", "captured_at", "page_id", "file", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[pa.RecordBatch]] = []
        last = None
        for batch in batches:
            found = pc.run_end_encode(batch.column(8))
            low = 0
            for file, high in zip(found.values.to_pylist(), found.run_ends.to_pylist(), strict=True):
                if file != last:
                    parts.append([])
                parts[-1].append(batch.slice(low, high - low))
                low, last = high, file
        yield from _batches(LoserTree([_rows_of(p) for p in parts]), _arrow_schema())

    return runs.repartitionByRange(*order).sortWithinPartitions("file", *order[:3], "at").mapInArrow(run, INDEX)


def archived(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes pages to archives, reads them back and gives the merged index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return merged_index(stored(read_archives(spark, path), "runs"))
