"""Book messages in ZIP archives, one JSON a line, as a Spark data source with a partition for each archive member.

The directory of an archive is read when the scan is planned; a task then streams its own member, so that an archive of
many days is read by many tasks and no member is ever held whole. A name that begins with a date says that its archive
or member holds that day: outside the asked time (``start_ms``, ``end_ms``) it is not opened. Levels are not built if no
column asks for them. Lines that are no JSON, or of another type than snapshot and delta, are skipped.
"""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEVEL = pa.list_(pa.struct([("price", pa.float64()), ("qty", pa.float64())]))
COLUMNS = {"archive": pa.string(), "member": pa.string(), "symbol": pa.string(), "ts_ms": pa.int64(), "seq": pa.int64(), "type": pa.string(), "b": LEVEL, "a": LEVEL}
SCHEMA = {c: "array<struct<price:double,qty:double>>" if t is LEVEL else "bigint" if t == pa.int64() else "string" for c, t in COLUMNS.items()}
DAY_MS = 86_400_000
#: Messages of a batch, and bytes read ahead of a member.
BATCH, AHEAD = 2_000, 1 << 19


@dataclass
class Member(InputPartition):
    archive: str
    name: str

    def __post_init__(self) -> None:
        super().__init__(None)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"\w+:", uri) else (fs.LocalFileSystem(), uri)


def day_of(name: str) -> int | None:
    """Milliseconds of the date that a file's name begins with."""
    found = re.match(r"(\d{4})-?(\d\d)-?(\d\d)", name.rsplit("/", 1)[-1])
    try:
        return int(datetime(*map(int, found.groups()), tzinfo=UTC).timestamp() * 1000) if found else None
    except ValueError:
        return None


class BookArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start_ms", "end_ms"))

    def asked(self, name: str) -> bool:
        day = day_of(name)
        return day is None or ((self.start is None or day + DAY_MS > self.start) and (self.end is None or day < self.end))

    def partitions(self) -> list[Member]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = self.path[: self.path.index(root)] if root in self.path else ""
        out = []
        for archive in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip")):
            if self.asked(archive):
                with system.open_input_file(archive) as file, zipfile.ZipFile(file) as z:
                    out += [Member(prefix + archive, m.filename) for m in z.infolist() if not m.is_dir() and self.asked(m.filename)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        system, path = opened(partition.archive)
        with system.open_input_file(path) as file, zipfile.ZipFile(file) as z, z.open(partition.name) as member:
            rows: dict[str, list] = {c: [] for c in self.columns}
            for number, line in enumerate(lines(member)):
                row = self.row(partition, number, line)
                if row is not None:
                    for c, held in rows.items():
                        held.append(row[c])
                    if len(rows[self.columns[0]]) >= BATCH:
                        yield batch(rows)
                        rows = {c: [] for c in self.columns}
            if rows[self.columns[0]]:
                yield batch(rows)

    def row(self, partition: Member, number: int, line: bytes) -> dict | None:
        try:
            message = json.loads(line)
            kind, ts, data = message["type"], int(message["ts"]), message.get("data") or {}
        except (ValueError, TypeError, KeyError):
            return None
        if kind not in ("snapshot", "delta") or (self.start is not None and ts < self.start) or (self.end is not None and ts >= self.end):
            return None
        update = data.get("u")
        row = {"archive": partition.archive, "member": partition.name, "symbol": data.get("s"), "ts_ms": ts, "seq": number if update is None else update, "type": kind}
        return row | {side: levels(data.get(side)) for side in ("b", "a") if side in self.columns}


def levels(given: list | None) -> list[dict]:
    return [{"price": float(x[0]), "qty": float(x[1])} for x in given or []]


def lines(member: zipfile.ZipExtFile) -> Iterator[bytes]:
    """Lines of a member, of which only the one at hand is held."""
    rest = b""
    while ahead := member.read(AHEAD):
        *whole, rest = (rest + ahead).split(b"\n")
        yield from whole
    yield rest


def batch(rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, COLUMNS[c]) for c, v in rows.items()], list(rows))


class BookArchive(DataSource):
    """``spark.read.format("book_archive").load(path)``: an archive, or all archives below a folder."""

    @classmethod
    def name(cls) -> str:
        return "book_archive"

    @property
    def chosen(self) -> list[str]:
        asked = self.options.get("columns")
        return [c for c in COLUMNS if c in asked.split(",")] if asked else list(COLUMNS)

    def schema(self) -> str:
        return ", ".join(f"{c} {SCHEMA[c]}" for c in self.chosen)

    def reader(self, schema: object) -> BookArchiveReader:
        return BookArchiveReader(dict(self.options), self.chosen)


def read_book_archives(spark: SparkSession, path: str, start_ms: int | None = None, end_ms: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """Messages with ``start_ms <= ts_ms < end_ms`` of all archives below ``path``, in the form of ``read_book_json``."""
    spark.dataSource.register(BookArchive)
    reader = spark.read.format("book_archive")
    for key, value in (("start_ms", start_ms), ("end_ms", end_ms), ("columns", ",".join(columns or []))):
        if value is not None and value != "":
            reader = reader.option(key, value)
    return reader.load(path)


def write_book_archives(messages: DataFrame, path: str) -> DataFrame:
    """Writes ``symbol, ts_ms, seq, value`` as an archive a day with a member a symbol; runs when its rows, the members written, are read.

    A task writes one day. Its archive takes its name only when it is whole, so that a task may be run again.
    """

    def write(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("symbol", "ascending"), ("ts_ms", "ascending"), ("seq", "ascending")])
        day = datetime.fromtimestamp(rows["day"][0].as_py() * 86_400, UTC).strftime("%Y-%m-%d")
        system, root = opened(path)
        system.create_dir(root, recursive=True)
        names = []
        part = f"{root}/.{day}-{id(rows)}"
        with system.open_output_stream(part) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
            symbols = rows["symbol"].to_pylist()
            at = 0
            while at < len(symbols):
                end = at
                while end < len(symbols) and symbols[end] == symbols[at]:
                    end += 1
                names.append(f"{day}_{symbols[at]}.data")
                with z.open(names[-1], "w") as member:
                    for value in rows["value"].slice(at, end - at):
                        member.write(value.as_py().encode() + b"\n")
                at = end
        system.move(part, f"{root}/{day}_books.zip")
        return pa.table({"member": pa.array(names, pa.string())})

    day = F.floor(F.col("ts_ms") / DAY_MS).cast("long").alias("day")
    return messages.select("symbol", "ts_ms", "seq", "value", day).groupBy("day").applyInArrow(write, "member string")
