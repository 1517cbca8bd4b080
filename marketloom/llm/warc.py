"""WARC archives of captures, and their index merged from sorted runs.

Pages become WARC/1.0 records (response, or revisit of the first capture with the same payload), which
Spark's text writer puts into gzipped archives. Reading parses every archive by content lengths; each
gives a run of captures sorted by URL key, time and id. The runs are cut at common range
boundaries, and each range's pieces of runs go through a k-way loser-tree merge, so that parts of the
result in order are one globally ordered capture history.

Edge cases: a null html is an empty payload; payloads under ``LEAST`` bytes are never revisits; a null url
has no target header and sorts last; control characters in a url are percent-encoded in the archive. Rows
with a null page_id are written, are never referred to, and refer to the smallest page_id of their
payload if there is one. Repeated rows with the smallest page_id are all responses. An empty
table gives no records. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, salted_join, table

LEAST = 100
ARCHIVE_BYTES = 48 << 20
INDEX_ROWS = 100_000
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
INDEX = (
    "url_key string, captured string, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long, archive string, offset long, length long"
)


def classified(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``page_id, url, captured, payload, payload_bytes, payload_digest, refers_to`` of every page."""
    payload = F.coalesce("html", F.lit(""))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    captured = start + F.make_interval(secs=F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 30)))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", F.date_format(captured, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"),
        payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"),
    )
    slim = rows.where(F.col("payload_bytes") >= LEAST).select("payload_digest", "page_id")
    firsts = slim.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    firsts = scratch.save(firsts.select("payload_digest", "first"), "firsts")
    found = salted_join(rows, firsts, "payload_digest", F.struct("page_id", "url"))
    again = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return found.withColumn("refers_to", F.when(F.col("payload_bytes") >= LEAST, again)).drop("first")


def record() -> F.Column:
    """The text of a WARC record, without the blank lines that end it."""
    header = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    safe_url = F.col("url")
    for c in "\t\n\r ":
        safe_url = F.replace(safe_url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        header("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}"),
        header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        header("WARC-Record-ID", urn(F.col("page_id"))),
        header("WARC-Date", F.col("captured")),
        F.coalesce(header("WARC-Target-URI", safe_url), F.lit("")),
        header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(header("WARC-Refers-To", urn(F.col("refers_to"))), header("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        header("Content-Type", F.lit("application/http; msgtype=response")),
        header("Content-Length", F.octet_length(http).cast("string")),
        F.lit(CRLF), http,
    )


def write_archives(rows: DataFrame, path: str, mean_bytes: float, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Gzipped archives under ``path``, of about ``archive_bytes`` at most where payloads have ``mean_bytes``."""
    most = max(1, int(archive_bytes / (mean_bytes + 600)))
    writer = rows.select(record().alias("value")).write.mode("overwrite").option("lineSep", CRLF * 2)
    writer.option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def url_key(url: str | None) -> str | None:
    """Host labels from the top domain down, then port, path and query, in lower case: ``com,example)/a?b``."""
    if url is None:
        return None
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    labels = host.split(".")
    labels = labels[1:] if labels[0] == "www" and len(labels) > 2 else labels
    return (",".join(reversed(labels)) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, block, offset and length of every record, by content lengths."""
    at = 0
    while at < len(archive):
        head = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:head].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        start = head + 4
        end = start + int(headers["content-length"])
        if archive[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is not closed")
        yield headers, archive[start:end], at, end + 4 - at
        at = end + 4


def captures(archive: bytes, name: str) -> list[tuple]:
    """The archive's captures in order: its run of the index. Digests of responses are those of the payload read."""
    from hashlib import sha256

    urn = lambda v: None if v in (None, "<urn:page:null>") else int(v[10:-1])
    run = []
    for h, block, offset, length in parse(archive):
        head = block.index(b"\r\n\r\n")
        stated = int(next(line[16:] for line in block[:head].split(b"\r\n") if line.lower().startswith(b"content-length: ")))
        digest = h["warc-payload-digest"].removeprefix("sha256:")
        if h["warc-type"] == "response":
            payload = block[head + 4 :]
            if len(payload) != stated or sha256(payload).hexdigest() != digest:
                raise ValueError(f"{name}: the payload at {offset} does not match its digest")
        url = h.get("warc-target-uri")
        run.append((url_key(url), h["warc-date"], urn(h["warc-record-id"]), url, stated, digest, h["warc-type"], urn(h.get("warc-refers-to")), name, offset, length))
    return sorted(run, key=order)


def order(entry: tuple) -> tuple:
    key, captured, page_id = entry[:3]
    return (key is None, key or "", captured, page_id is None, page_id or 0, entry[8], entry[9])


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Every capture of the archives under ``path``, each archive's in order."""
    schema = spark.createDataFrame([], INDEX).schema
    names = schema.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py().rsplit("/", 1)[-1]
                found = captures(zlib.decompress(batch.column(1)[i].as_buffer(), 31), name)
                columns = list(zip(*found, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge of sorted runs: inner nodes keep the loser of their match, so a new entry meets one path only."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.heads = [order(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.beats(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else 0

    def beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x <= y)

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            w = self.winner
            yield self.runs[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = order(self.runs[w][self.at[w]]) if self.at[w] < len(self.runs[w]) else None
            node = (w + self.k) // 2
            while node:
                if self.beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def merge_runs(runs: DataFrame, index_rows: int = INDEX_ROWS) -> DataFrame:
    """All runs as one history: the partitions in order, each merged by a loser tree over its pieces of runs.

    Ranges go by URL key, time and id, so that the captures of one URL can fill many of them.
    """
    parts = max(1, -(-runs.count() // index_rows))
    last = F.col("url_key").isNull()
    keys = (last, F.col("url_key"), F.col("captured"), F.col("page_id"), F.col("archive"), F.col("offset"))
    ranged = runs.repartitionByRange(parts, *keys)

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for entry in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                pieces.setdefault(entry[8], []).append(entry)
        for piece in pieces.values():
            piece.sort(key=order)  # a shuffle may deliver the blocks of a run in any order
        found: list[tuple] = []
        for entry in LoserTree(list(pieces.values())):
            found.append(entry)
            if len(found) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return ranged.mapInArrow(merge, INDEX)


def archive_and_index(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in the shared folder, read them back, and merge their index."""
    scratch = Scratch(spark, "warc")
    mean_bytes = pages.agg(F.avg(F.octet_length("html")).alias("m")).first()["m"] or 0.0
    write_archives(classified(pages, scratch), scratch.path("archives"), mean_bytes)
    runs = scratch.save(read_runs(spark, scratch.path("archives")), "runs")
    return merge_runs(runs)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_and_index(spark, table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
