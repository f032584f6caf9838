"""WARC archives with an externally merged capture index (operator 3).

Pages become WARC/1.1 records that Spark writes as gzipped text files whose line separator is the
end of a record: a distributed, committed write to any store that Spark writes to. Of captures with equal
payloads the one with the smallest id is stored as a response, the others as revisits that refer
to it. Reading goes by Content-Length, so payloads may hold anything.

Every archive file gives a run of captures sorted by URL key, timestamp and id. The index cuts the
key space into ranges, and in each range a loser tree merges the runs' parts, so that the ranges
one after another are the captures in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm._common import fresh_path, slices, written

RECORD_END = "\r\n\r\n"
#: Bytes of payload that one archive file holds, about.
FILE_BYTES = 32 << 20
#: Payloads of at least so many bytes may be stored once for all their captures.
MIN_REVISIT_BYTES = 0
#: Captures of a range that one task merges, about.
RANGE_CAPTURES = 50_000
#: When captures without a time of their own were made.
CAPTURED = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:capture:"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digested(pages: DataFrame, id_col: str, url_col: str, html_col: str, time_col: str | None) -> DataFrame:
    """(page_id, url, at, html, payload_bytes, payload_digest)"""
    key = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = pa.array([payload_digest(t.encode()) for t in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=[*b.schema.names, "payload_digest"])

    at = F.date_format(F.col(time_col).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if time_col else F.lit(None)
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    picked = pages.select(
        F.col(id_col).alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("url"),
        F.coalesce(at, F.lit(CAPTURED)).alias("at"),
        html.alias("html"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    return picked.mapInArrow(run, f"page_id {key}, url string, at string, html string, payload_bytes bigint, payload_digest string")


def with_originals(captures: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """captures and the column original: the smallest id with the same payload, if that is a
    smaller one and the payload is long enough; else null.

    Ids are pre-aggregated by digest, so a payload that a third of all pages share sends one row
    from each task; the join back is one that Spark splits where a digest is frequent.
    """
    firsts = captures.filter(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n")).agg(F.min("page_id").alias("first"), F.count("*").alias("captures"))
    firsts = firsts.filter("captures > 1").drop("captures")
    joined = captures.join(firsts, (captures["payload_digest"] == F.col("d")) & (captures["payload_bytes"] == F.col("n")), "left").drop("d", "n")
    return joined.withColumn("original", F.when(F.col("first") < F.col("page_id"), F.col("first"))).drop("first")


def record_text(captures: DataFrame) -> Column:
    """A record without its end, as text: WARC headers, HTTP headers and, for responses, payload."""
    revisit = F.col("original").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "html"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), number("page_id"), F.lit(">"))),
        line("WARC-Date", F.col("at")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), number("original"), F.lit(">"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Write one record for each row of pages to gzipped archives in path, each one gzip member.

    Ids are integers; others are a TypeError, since a record's id is written and read back as one.
    Null ids stay null. Null html is an empty payload; null urls are empty. Rows that share the smallest id of their
    payload are all responses. Other columns are not read. No rows make a folder without records.
    """
    if not isinstance(pages.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"ids of captures are integers, not {pages.schema[id_col].dataType.simpleString()}")
    captures = with_originals(digested(pages, id_col, url_col, html_col, time_col), min_bytes)
    records = captures.select(record_text(captures).alias("record"))
    # Records of a partition go to files of bounded size, since a file is read back as a whole.
    records.write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", _records_per_file(pages, html_col)).text(path)


def _records_per_file(pages: DataFrame, html_col: str) -> int:
    n, total, longest = pages.agg(F.count("*"), F.sum(F.octet_length(html_col)), F.max(F.octet_length(html_col))).first()
    typical = max((total or 0) / max(1, n), (longest or 0) / 64) + 1024
    return max(1, int(FILE_BYTES / typical))


def surt(url: str) -> str:
    """The key that URLs sort by: host labels from the last to the first, then path and query."""
    parts = urlsplit(url if "//" in url else f"//{url}")
    host = (parts.netloc.rpartition("@")[2]).lower()
    name, _, port = host.partition(":")
    labels = [x for x in name.split(".") if x]
    if labels and labels[0] in ("www", "m") and len(labels) > 2:
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in ("80", "443") else "") + ")" + (parts.path or "/")
    return key + (f"?{parts.query}" if parts.query else "")


def url_key(url: str) -> str:
    """surt(), or for what is no URL the text as it is."""
    try:
        return surt(url)
    except ValueError:
        return url


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, gzipped or plain."""
    if archive[:2] == b"\x1f\x8b":
        archive = gzip.decompress(archive)
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start, length = end + 4, int(headers["content-length"])
        if archive[start + length : start + length + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield headers, archive[start : start + length]
        at = start + length + 4


def capture(headers: dict[str, str], block: bytes) -> tuple:
    """(urlkey, timestamp, page_id, url, payload_bytes, payload_digest, record_type, refers_to).

    The payload of a response is measured and digested anew and must match its header; a revisit
    keeps the HTTP headers, and so the length, of the payload that it stands for.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := headers[name].removeprefix(f"<{_ID}").removesuffix(">")) else None
    length = len(payload)
    if kind == "revisit":
        length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    elif payload_digest(payload) != digest:
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    url = headers["warc-target-uri"]
    return url_key(url), headers["warc-date"], number("warc-record-id"), url, length, digest, kind, number("warc-refers-to") if kind == "revisit" else None


_CAPTURE = ["urlkey", "timestamp", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_SCHEMA = "urlkey string, timestamp string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so that the next row costs
    one match for each level on the way from the winner's run to the root."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads = [self._next(i) for i in range(self.size)]
        self.losers = [0] * self.size
        self.winner = self._play(1)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None) if i < len(self.runs) else None
        return None if row is None else (_order(row), i, row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head[2]
            won = self.winner
            self.heads[won] = self._next(won)
            node = (won + self.size) // 2
            while node:
                if self._beats(self.losers[node], won):
                    won, self.losers[node] = self.losers[node], won
                node //= 2
            self.winner = won


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in path, each archive's sorted, with its name as run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = sorted((capture(*r) for r in records_of(content.as_py())), key=_order)
                columns = [pa.array(list(c)) for c in zip(*found, strict=True)] if found else [[]] * len(_CAPTURE)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), *(pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t) for c, t in zip(columns, _TYPES, strict=True))], names=["run", *_CAPTURE])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(run, f"run string, {_SCHEMA}")


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of sorted runs in global order of URL key, timestamp and id.

    Ranges of the key are the partitions; their order is the order of the captures. A URL that was
    captured very often still spreads over ranges, by timestamp and id. Their number grows with
    that of the captures. Within a range the rows are first put back into runs, then a loser tree
    merges those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for b in batches:
            for name, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts.setdefault(name, []).append(tuple(row))
        merged = iter(LoserTree([iter(rows) for _, rows in sorted(parts.items())]))
        while rows := list(itertools.islice(merged, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_CAPTURE)

    ranges = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RANGE_CAPTURES))
    ranged = runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id").sortWithinPartitions("run", "urlkey", "timestamp", "page_id")
    return ranged.mapInArrow(run, _SCHEMA)


def archive_and_index(pages: DataFrame, path: str | None = None, min_bytes: int = MIN_REVISIT_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Write pages to archives in path (a new one in the shared folder, if none), read these back
    and return their captures in global order; see write_warc for the defined cases.

    (urlkey, timestamp, page_id, url, payload_bytes, payload_digest, record_type, refers_to)
    """
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write_warc(pages, path, min_bytes, id_col, url_col, html_col, time_col)
    return merge_runs(written(read_runs(spark, path), "warc-runs"))
