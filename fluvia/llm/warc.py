"""WARC archives of pages, and their external capture index.

Every record is a gzip member of its own, so a reader can seek to it. Members are packed into files of
at most FILE_BYTES (a larger record is a file by itself), which Spark's own text writer writes, so
archives go wherever Spark can write; a file's line end is a last, empty member. Of pages with equal
payloads of at least MIN_BYTES that with the largest id is a response and the others revisit it;
groups are aggregated before the shuffle and only (id, id) pairs meet the pages again.

Reading an archive checks every payload's digest and gives a capture run sorted by URL key and
timestamp. The runs are merged externally: sampled splitters range-partition the captures into
partitions of some RUN_ROWS, and each merges its pieces of the runs, as they arrive, by a loser tree.
Partitions in order are the capture history.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import BROADCAST_IDS, partitions, written
from .textkit import tidy

MIN_BYTES = 1000
#: Compressed bytes of an archive file; only a larger record exceeds them.
FILE_BYTES = 32 << 20
#: Captures that one task merges, on average.
RUN_ROWS = 200_000
#: Bytes that are unpacked at once.
READ_BYTES = 1 << 16
#: Time of the first capture; page n follows n seconds later, as pages carry no time of their own.
EPOCH = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
#: A gzip member without content, as characters that stand for its bytes.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
CAPTURES = (
    "url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long, file string, offset long, length long"
)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """One WARC record (a string without its end) per row of pages; null html counts as empty."""
    own = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.regexp_replace(F.col(url_col), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    sized = own.select("*", F.octet_length("html").alias("size"), F.sha1(F.encode("html", "UTF-8")).alias("digest"))
    marks = written(sized.select("id", "size", "digest").filter(F.col("size") >= min_bytes), "warc-marks")
    groups = marks.groupBy(F.col("digest").alias("d"), F.col("size").alias("s")).agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    again = marks.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") == F.col("s"))).filter("refers_to is not null and not (id <=> refers_to)")
    again = written(again.select(F.col("id").alias("i"), "refers_to").distinct(), "warc-revisits")
    few = again.count() <= BROADCAST_IDS
    # Ids are unique; a revisit is decided by the id.
    joined = sized.join(F.broadcast(again) if few else again, F.col("id").eqNullSafe(F.col("i")) & (F.col("size") >= min_bytes), "left")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.col("size").cast("string")), F.lit("\r\n")
    )
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH).cast("timestamp")) + F.coalesce("id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    payload = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", name("id")),
        _line("WARC-Date", date),
        F.coalesce(_line("WARC-Target-URI", F.col("url")), F.lit("")),
        F.when(revisit, _line("WARC-Refers-To", name("refers_to"))).otherwise(F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(payload)).cast("string")),
        F.lit("\r\n"),
    )
    return joined.select(F.concat(head, http, payload).alias("value"))


def _packed(file_bytes: int):
    """Records to files: gzip members, one a record, as many as fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        size = 0

        def file() -> pa.RecordBatch:
            # Bytes go through the text writer as they are.
            own = pa.array([b"".join(members)], pa.large_binary())
            members.clear()
            return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_string(), 1, own.buffers()).cast(pa.string())], names=["value"])

        for batch in batches:
            for record in batch.column(0):
                member = gzip.compress(record.as_buffer().to_pybytes() + END.encode(), 6, mtime=0)
                if members and size + len(member) > file_bytes:
                    yield file()
                    size = 0
                members.append(member)
                size += len(member)
        if members:
            yield file()

    return tidy(run)


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, **options) -> None:
    """Archives of all pages under path: files of gzip members, one member a record."""
    files = records(pages, **options).mapInArrow(_packed(file_bytes), "value string")
    files.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def url_key(url: str | None) -> str:
    """Host labels in reverse, then the path and query, in lower case; scheme, www and fragment don't count."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0].lower()
    host, slash, path = re.match(r"(?s)([^/?]*)([/?]?)(.*)", rest).groups()
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (slash or "/") + path


def members(raw: memoryview) -> Iterator[tuple[bytes, int, int]]:
    """Content, offset and length of every gzip member that has content; of unpacked bytes these themselves."""
    if raw[:2] != b"\x1f\x8b":
        if len(raw):
            yield bytes(raw), 0, len(raw)
        return
    at = 0
    while at < len(raw):
        unpack, parts, to = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if to >= len(raw):
                raise ValueError(f"the gzip member at byte {at} doesn't end")
            parts.append(unpack.decompress(raw[to : to + READ_BYTES]))
            to = min(to + READ_BYTES, len(raw))
        to -= len(unpack.unused_data)
        if any(parts):
            yield b"".join(parts), at, to - at
        at = to


def parsed(raw: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes, int, int]]:
    """Header, HTTP head, payload, offset and length of every record of an archive.

    Offset and length are those of the record's gzip member; records that share a member share them.
    """
    for content, offset, length in members(memoryview(raw).cast("B")):
        at = 0
        while at < len(content):
            if content[at : at + 5] != b"WARC/":
                raise ValueError(f"no WARC record at byte {at} of the member at {offset}")
            body = content.index(b"\r\n\r\n", at) + 4
            lines = content[at : body - 4].decode().split("\r\n")[1:]
            header = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
            end = body + int(header["content-length"])
            block = content[body:end]
            split = block.index(b"\r\n\r\n") + 4
            if content[end : end + 4] != END.encode():
                raise ValueError(f"the record at byte {at} of the member at {offset} doesn't end where it says")
            yield header, block[:split], block[split:], offset, length
            at = end + 4


def _page(name: str | None) -> int | None:
    digits = name[len("<urn:x-page:") : -1] if name else "none"
    return None if digits == "none" else int(digits)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in CAPTURES.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for header, http, payload, at, length in parsed(content.as_buffer()):
                digest = header["warc-payload-digest"].removeprefix("sha1:")
                size = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
                response = header["warc-type"] == "response"
                if response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"the payload at byte {at} of {path} is not what its record says")
                url = header.get("warc-target-uri")
                stamp = re.sub(r"\D", "", header["warc-date"])
                rows.append((url_key(url), stamp, _page(header["warc-record-id"]), url, header["warc-type"], _page(header.get("warc-refers-to")), digest, size, path, at, length))
            rows.sort(key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2]))  # a capture run
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture per record of the archives under path; each file's captures are a sorted run."""
    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("path", "content").mapInArrow(_read, CAPTURES)


class LoserTree:
    """k sorted runs as one: inner nodes keep the loser of each match, so a step replays one path."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, k = runs, max(1, len(runs))
        self.size = 1 << (k - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.losers = [0] * self.size
        winners = list(range(self.size)) if self.size > 1 else [0]
        at = self.size
        while len(winners) > 1:
            at //= 2
            won = []
            for j in range(0, len(winners), 2):
                a, b = winners[j : j + 2]
                first, second = (a, b) if self._before(a, b) else (b, a)
                self.losers[at + j // 2] = second
                won.append(first)
            winners = won
        self.winner = winners[0]

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            run = self.winner
            self.heads[run] = next(self.runs[run], None)
            node = (run + self.size) // 2
            while node:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's pieces of runs, each in order as it arrives, to one run."""
    rows = [b for b in batches if len(b)]
    if not rows:
        return
    table = pa.Table.from_batches(rows)
    keys = list(zip(table["url_key"].to_pylist(), table["timestamp"].to_pylist(), (-1 if x is None else x for x in table["page_id"].to_pylist()), range(table.num_rows), strict=True))
    # A piece of a run ends where the next key is smaller.
    bounds = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    order = np.fromiter((x[3] for x in LoserTree([iter(keys[a:b]) for a, b in pairwise(bounds)])), np.int64, len(keys))
    for k in range(0, len(order), 10_000):
        yield from table.take(pa.array(order[k : k + 10_000])).combine_chunks().to_batches()


def merged_index(captures: DataFrame) -> DataFrame:
    """The capture history, in order of URL key and timestamp over all partitions, from sorted runs."""
    parts = max(partitions(captures.sparkSession), captures.count() // RUN_ROWS)
    return captures.repartitionByRange(parts, "url_key", "timestamp", "page_id", "file", "offset").mapInArrow(tidy(_merged), CAPTURES)


def archived(pages: DataFrame, path: str, **options) -> DataFrame:
    """Write the pages' archives under path, read them back, and give their merged capture index.

    One row per row of pages. Null html counts as empty and null URLs have an empty key; a null id
    stays null. Rows that repeat an id and payload are one page, of which each is a record; html of
    less than min_bytes never revisits. An empty table gives an empty index; other columns are ignored.
    """
    write_archives(pages, path, **options)
    captures = written(read_archives(pages.sparkSession, path), "warc-captures")
    return merged_index(captures)
