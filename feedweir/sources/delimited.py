"""A data source for dirty delimited feeds, with positions.

Spark's CSV reader tells neither rows, lines nor bytes, and can't tell a missing field from an empty one. This
source cuts a file at record boundaries into splits with their first row, line and byte, which executors read
independently. The cuts are planned by executors too: each scans a fixed block of the file from the two places at which a
record can begin there, at its first line or after a quote that may be open from before, and tells where its last record
ends and how many rows and lines it has. The driver chains these summaries; only where none begins at the place that the
chain has reached (a quoted field over more than a block), it scans the block itself.

Rules: fields are separated by commas; a quote opens a quoted field only at the begin of a field, and inside it ""
stands for a quote; after a closing quote the rest of the field is kept as it is; any other quote is literal.
LF or CRLF ends a record. Empty lines are skipped. A record that can't be read (a quote that never closes, a bare CR
outside quotes) gives a row with `parse_error` and no row number.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from feedweir.functions.text import csv_line, normalize_header
from feedweir.schema import REQUIRED
from feedweir.sources.scratch import workers_import_here

SCHEMA = "row_number long, line_number long, byte_end long, n_fields int, fields array<string>, parse_error string"
BOM = b"\xef\xbb\xbf"
UNCLOSED, BARE_CR = "a quoted field is never closed", "a carriage return stands outside quotes"
csv.field_size_limit(1 << 30)


class UnusableFile(ValueError):
    """The file can't be imported at all; trying again won't help."""


def open_file(path: str) -> io.BufferedReader:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return io.BufferedReader(system.open_input_file(inner), 1 << 20)


def _stays_open(line: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of the line, given whether one was at its begin."""
    at = 0
    while True:
        if inside:
            close = line.find(b'"', at)
            while close >= 0 and line[close + 1 : close + 2] == b'"':
                close = line.find(b'"', close + 2)
            if close < 0:
                return True
            at, inside = close + 1, False
        elif line[at : at + 1] == b'"':
            at, inside = at + 1, True
            continue
        comma = line.find(b",", at)
        if comma < 0:
            return False
        at = comma + 1


@dataclass
class Record:
    raw: bytes
    last_line: int
    byte_end: int
    error: str | None = None

    @property
    def content(self) -> bytes:
        return self.raw.removesuffix(b"\n").removesuffix(b"\r")

    def fields(self) -> list[str]:
        text = self.content.decode("utf-8", "replace")
        if '"' not in text:
            return text.split(",")
        return next(csv.reader(io.StringIO(self.raw.decode("utf-8", "replace"), newline="")))


def records(stream, byte: int, line: int, end: int | None = None) -> Iterator[Record]:
    """The records from a boundary on, up to the one that ends at or after byte `end`. `line` is the number of lines before."""
    held: list[bytes] = []
    for raw in stream:
        line += 1
        byte += len(raw)
        if held or b'"' in raw:
            if _stays_open(raw, bool(held)):
                held.append(raw)
                continue
            raw, held = b"".join(held) + raw, []
        record = Record(raw, line, byte)
        if b"\r" in record.content:
            try:
                record.fields()
                record.error = BARE_CR if b'"' not in record.raw else None
            except csv.Error:
                record.error = BARE_CR
        if record.content:
            yield record
        if end is not None and byte >= end:
            return
    if held:
        yield Record(b"".join(held), line, byte, UNCLOSED)


def read_header(path: str) -> tuple[list[str], int, int]:
    """The normalised header, the byte after it, and the number of its lines."""
    with open_file(path) as stream:
        skipped = len(BOM) if stream.peek(3)[:3] == BOM else 0
        stream.seek(skipped)
        first = next(records(stream, skipped, 0), None)
    if first is None or first.error:
        raise UnusableFile("the file has no header line")
    return normalize_header(first.fields()), first.byte_end, first.last_line


def missing_columns(header: list[str]) -> list[str]:
    return [c for c in REQUIRED if c not in header]


def check_header(header: list[str]) -> None:
    if missing := missing_columns(header):
        raise UnusableFile(f"the header has no column {', '.join(missing)}")
    if twice := sorted({c for c in REQUIRED if header.count(c) > 1}):
        raise UnusableFile(f"the header has more than one column {', '.join(twice)}")


@dataclass
class Split(InputPartition):
    path: str
    byte: int
    end: int
    row: int
    line: int

    def __post_init__(self):
        super().__init__(self.byte)


def scan_from(path: str, byte: int, end: int) -> tuple[int, int, int]:
    """From a record boundary up to the record that ends at or after `end`: (its end, rows, lines)."""
    rows, line, at = 0, 0, byte
    with open_file(path) as stream:
        stream.seek(byte)
        for record in records(stream, byte, 0, end):
            rows, line, at = rows + (record.error is None), record.last_line, record.byte_end
    return at, rows, line


def scan_block(path: str, begin: int, end: int) -> list[tuple[int, int, int, int]]:
    """(record boundary, end, rows, lines) for both places at which a record can begin in a block; none if the block has no such line."""
    with open_file(path) as stream:
        stream.seek(begin - 1 if begin else 0)
        first = begin + (len(stream.readline()) - 1 if begin else 0)  # a line that begins at `begin` follows a line end
        after, inside = first, True
        while inside and after < end:
            line = stream.readline()
            if not line:
                break
            after, inside = after + len(line), _stays_open(line, True)
    return [(at, *scan_from(path, at, end)) for at in dict.fromkeys([first] + [after] * (not inside)) if at < end]


def plan(spark: SparkSession, path: str, byte: int, row: int, line: int, stop: int, block_bytes: int) -> list[Split]:
    """The splits from a record boundary up to the record that ends at or after `stop`, a block each, planned by the executors."""
    edges = [*range(byte, stop, block_bytes), stop]
    blocks = [(i, path, a, b) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                found = scan_block(x["path"], x["a"], x["b"]) if x["i"] else [(x["a"], *scan_from(x["path"], x["a"], x["b"]))]
                yield pa.RecordBatch.from_pylist([dict(zip(("i", "at", "end", "rows", "lines"), (x["i"], *f))) for f in found], schema=SUMMARY)

    frame = spark.createDataFrame(blocks, "i int, path string, a long, b long").repartition(len(blocks), "i")
    known = {(r["i"], r["at"]): (r["end"], r["rows"], r["lines"]) for r in frame.mapInArrow(scan, "i int, at long, end long, rows long, lines long").collect()}  # two rows a block at most
    splits = []
    for i, _, _, edge in blocks:
        if byte >= edge:
            continue  # a record from before reaches beyond this block
        end, rows, lines = known.get((i, byte)) or scan_from(path, byte, edge)
        if end > byte:
            splits.append(Split(path, byte, end, row, line))
            byte, row, line = end, row + rows, line + lines
    return splits


SUMMARY = pa.schema([("i", pa.int32()), ("at", pa.int64()), ("end", pa.int64()), ("rows", pa.int64()), ("lines", pa.int64())])


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split_bytes = int(options.get("splitbytes", 64 << 20))
        self.most = int(options["maxbytes"]) if "maxbytes" in options else None
        self.start = (int(options["startbyte"]), int(options.get("startrow", 0)), int(options.get("startline", 0))) if "startbyte" in options else None
        self.planned = json.loads(options["splits"]) if "splits" in options else None

    def partitions(self) -> list[Split]:
        """The splits that `read_records` had planned; without them, a sequential plan."""
        if self.planned is not None:
            return [Split(self.path, *x) for x in self.planned] or [Split(self.path, 0, 0, 0, 0)]
        if self.start is None:
            _, byte, line = read_header(self.path)
            row = 0
        else:
            byte, row, line = self.start
        stop = None if self.most is None else byte + self.most
        splits, at = [], (byte, row, line)
        with open_file(self.path) as stream:
            stream.seek(byte)
            for record in records(stream, byte, line, stop):
                row += record.error is None
                byte, line = record.byte_end, record.last_line
                if byte - at[0] >= self.split_bytes:
                    splits.append(Split(self.path, at[0], byte, at[1], at[2]))
                    at = (byte, row, line)
        if byte > at[0]:
            splits.append(Split(self.path, at[0], byte, at[1], at[2]))
        return splits or [Split(self.path, byte, byte, row, line)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 6, types)], names)

        if split.end <= split.byte:
            return
        rows: list[tuple] = []
        row = split.row
        with open_file(split.path) as stream:
            stream.seek(split.byte)
            for record in records(stream, split.byte, split.line, split.end):
                if record.error:
                    rows.append((None, record.last_line, record.byte_end, None, None, record.error))
                else:
                    row += 1
                    fields = record.fields()
                    rows.append((row, record.last_line, record.byte_end, len(fields), fields, None))
                if len(rows) == 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class FeedSource(DataSource):
    """spark.read.format("feed").option("path", ...); options splitBytes, startByte, startRow, startLine, maxBytes."""

    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        return FeedReader(dict(self.options))


def file_size(path: str) -> int:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.get_file_info(inner).size


def read_records(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of a file, planned and read by the executors. Options: splitBytes, maxBytes, startByte, startRow, startLine."""
    workers_import_here(spark)
    spark.dataSource.register(FeedSource)
    if "startByte" in options:
        byte, row, line = int(options["startByte"]), int(options.get("startRow", 0)), int(options.get("startLine", 0))
    else:
        (_, byte, line), row = read_header(path), 0
    stop = min(file_size(path), byte + int(options.get("maxBytes", 1 << 62)))
    splits = plan(spark, path, byte, row, line, stop, int(options.get("splitBytes", 64 << 20))) if stop > byte else []
    numbers = json.dumps([(s.byte, s.end, s.row, s.line) for s in splits])
    return spark.read.format("feed").options(path=path, splits=numbers).load()


def by_name(rows: DataFrame, header: list[str], *keep: str) -> DataFrame:
    """Columns of the feed by their header names; a field beyond the end of a short row is null, surplus fields are dropped.
    `raw_line` is the record written anew in header order; `keep` are further columns of `rows`."""
    columns = {c: F.get("fields", F.lit(header.index(c))) for c in REQUIRED}
    whole = csv_line(F.array(*[F.get("fields", F.lit(i)) for i in range(len(header))]))
    return rows.select(*keep, "row_number", "line_number", "byte_end", *[e.alias(c) for c, e in columns.items()], whole.alias("raw_line"))


def is_short(header: list[str]) -> Column:
    return F.col("n_fields") < F.lit(len(header))


def read_feed(spark: SparkSession, path: str, header: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame, list[str]]:
    """(records by name, unparseable lines, header) of a file; a resumed read passes the stored header."""
    if header is None:
        header = read_header(path)[0]
    check_header(header)
    rows = read_records(spark, path, **options)
    return by_name(rows.where("parse_error is null"), header), rows.where("parse_error is not null").select("line_number", "byte_end", "parse_error"), header


def plain_csv(spark: SparkSession, path: str) -> DataFrame:
    """Spark's own reader, for files that need no positions: all columns text, quotes doubled, records over several lines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)


def header_json(header: list[str]) -> str:
    return json.dumps(header)
