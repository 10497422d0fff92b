"""WARC archives of pages: writing with revisits, reading back, and one merged capture index."""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, n_buckets, schema_of, scratch

MIN_REVISIT_BYTES = 100
#: An archive holds so many records of up to SMALL_BYTES of payload (64 MB), or so many larger ones.
SMALL_BYTES, SMALL_PER_FILE, LARGE_PER_FILE = 65_536, 1_000, 8
EPOCH = 1_704_067_200
_PAGE = "urn:millrace:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "url_key string, capture_time string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, archive string, offset long, length long"
)


def plan_captures(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, first: the page whose record is the response.

    first is null where the record is a response itself.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("payload")
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    short = rows.where(F.col("payload_bytes") < MIN_REVISIT_BYTES).withColumn("first", F.lit(None).cast("long"))  # these meet nowhere
    long = rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
    lead = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    own = F.col("page_id").eqNullSafe(F.col("first"))
    joined = long.join(lead, "payload_digest", "left").withColumn("first", F.when(~own, F.col("first")))
    return joined.unionByName(short)


def capture_time(page_id: Column) -> Column:
    """Pages carry no time of capture: a second per id, from the start of 2024, in UTC."""
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100_000_000))
    return F.date_format(F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def record_text() -> Column:
    """One WARC record without its closing blank lines, from the columns of plan_captures()."""
    revisit = F.col("first").isNotNull()
    header = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    block = F.when(revisit, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), "payload"))
    urn = lambda c: F.concat(F.lit(f"<{_PAGE}"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn(F.coalesce(F.col("page_id").cast("string"), F.lit("")))),
        header("WARC-Date", capture_time(F.col("page_id"))),
        header("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        header("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        header("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        header("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Gzipped WARC files under path, each sorted by URL and time.

    A record is one value of Spark's text writer, whose line separator is the two blank
    lines that close a record; so any file system that Spark can write to will do, and
    tasks that are lost are written again by Spark's commit protocol.
    """
    size = F.coalesce(F.octet_length(F.col(html)), F.lit(0))
    for name, part, most in (("small", size <= SMALL_BYTES, SMALL_PER_FILE), ("large", size > SMALL_BYTES, LARGE_PER_FILE)):  # equal payloads are of one size
        rows = plan_captures(pages.where(part), page_id, url, html)
        rows.sortWithinPartitions(url_key_column(), "page_id").select(record_text().alias("value")).write.options(
            lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=most
        ).text(f"{path}/{name}")


def url_key_column(url: str = "url") -> Column:
    """Sort key of an address: host parts from the right, then path and query, in lower case."""
    bare = F.lower(F.regexp_replace(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://", ""))
    host, rest = F.regexp_extract(bare, r"^[^/?#:]*", 0), F.regexp_replace(bare, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def url_key(url: str) -> str:
    try:
        parts = urlsplit(url.lower())
        host, rest = parts.netloc.partition(":")[0], url.lower().partition("://")[2][len(parts.netloc) :]
    except ValueError:
        host, rest = "", url.lower()
    return ",".join(reversed(host.split("."))) + ")" + rest


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and block of each record; ValueError if a record is cut short."""
    offset = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        length, headers = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            length += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block, end = stream.read(size), stream.read(4)
        if len(block) < size or end != b"\r\n\r\n":
            raise ValueError(f"record at {offset} is cut short")
        length += 2 + size + 4
        yield offset, length, headers, block
        offset += length


def _index_rows(archive: str, content: bytes) -> Iterator[dict[str, object]]:
    page = lambda urn: int(x) if (x := urn.strip("<>").removeprefix(_PAGE)) else None
    for offset, length, h, block in read_records(gzip.GzipFile(fileobj=io.BytesIO(content))):
        digest, size = h["warc-payload-digest"].removeprefix("sha256:"), int(h["warc-payload-length"])
        if h["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                raise ValueError(f"{archive}: the payload at {offset} differs from its digest")
        yield {
            "url_key": url_key(h.get("warc-target-uri", "")), "capture_time": h["warc-date"], "page_id": page(h["warc-record-id"]),
            "url": h.get("warc-target-uri"), "record_type": h["warc-type"],
            "refers_to": page(h["warc-refers-to"]) if "warc-refers-to" in h else None,
            "payload_bytes": size, "payload_digest": digest, "archive": archive, "offset": offset, "length": length,
        }


def _order(row: dict[str, object]) -> tuple:
    return row["url_key"], row["capture_time"], row["page_id"] is None, row["page_id"] or 0, row["archive"], row["offset"]


def _reader(schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                rows = sorted(_index_rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), key=_order)
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return run


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A capture row for each record; the rows of an archive are one sorted run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    schema = schema_of(INDEX)
    return files.mapInArrow(_reader(schema), schema)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so a step costs log2(k) comparisons."""

    def __init__(self, runs: list[Iterable], key=lambda x: x):
        self.runs, self.key = [iter(r) for r in runs], key
        self.k = max(1, len(self.runs))
        self.heads: list[tuple | None] = [self._take(i) for i in range(len(self.runs))] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _take(self, i: int) -> tuple | None:
        value = next(self.runs[i], None)
        return None if value is None else (self.key(value), i, value)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # while the tree fills, the first to come waits
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator:
        return self

    def __next__(self):
        head = self.heads[w := self.losers[0]]
        if head is None:
            raise StopIteration
        self.heads[w] = self._take(w)
        self._replay(w)
        return head[2]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range of keys: its piece of each run, in order, stays as columns; the tree merges the rows' numbers."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    archive = table["archive"].to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.append(True, archive[1:] != archive[:-1]))
    runs = [range(a, b) for a, b in zip(start, [*start[1:], len(archive)], strict=True)]
    keys, times, pages, offsets = (table[c].to_pylist() for c in ("url_key", "capture_time", "page_id", "offset"))
    order = LoserTree(runs, lambda i: (keys[i], times[i], pages[i] is None, pages[i] or 0, archive[i], offsets[i]))
    for part in iter(lambda: list(islice(order, 5000)), []):
        yield from table.take(pa.array(part)).combine_chunks().to_batches()


def merge_index(index: DataFrame) -> DataFrame:
    """The capture rows of all runs in one order: URL key, time, page id, across partitions.

    Ranges are cut over all three, so the captures of one URL may lie in several tasks.
    A run's rows come to a task from one map task, in order.
    """
    return index.repartitionByRange(
        n_buckets(index), "url_key", "capture_time", F.col("page_id").asc_nulls_last()
    ).sortWithinPartitions("archive", "url_key", "capture_time", F.col("page_id").asc_nulls_last(), "offset").mapInArrow(
        _merge, index.schema
    )


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as WARC archives in the shared folder, reads them back and returns the merged index.

    Of records with equal payloads of MIN_REVISIT_BYTES or more, the one with the
    smallest page id is the response and the others revisit it.

    Defined cases: a null payload is empty; smaller payloads are always responses; a
    null page id is never the smallest (equal payloads that all lack one are all
    responses); pages of any length that fits in a row are written whole; other columns are
    not looked at, whatever their names; rows that repeat the smallest id are all responses; control characters
    and blanks in a URL become %20, and a null URL is left out; no pages give no rows.
    """
    path = scratch(pages.sparkSession, "warc")
    write_archives(pages, path, page_id, url, html)
    return merge_index(cut(read_archives(pages.sparkSession, path)))
