"""A deterministic, sharded writer of web archives (WARC 1.1), and a reader.

Shard bounds come from the running sum of payload bytes over the sorted ids, so they depend on the rows
alone. Rows are dealt by shard, one a task, and sorted by id; a task writes each
record as a gzip member of its own, and rolls to a new file when the compressed size reaches the limit.
Files are written under temporary names and renamed, so that a lost or repeated task leaves the same
bytes; the manifest table, written last, lists the files that count.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from io import BytesIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedweir.llm.common import materialize, new_dir, salted_lookup, settled, prepare_workers

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:web-archive-records")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, file string, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
#: Where null ids are sorted.
LEAST = -(1 << 63)


def _one_line(text: str) -> str:
    """Header values can't hold line ends or other control characters; they become %-codes."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record with headers and digests made anew."""
    digest = hashlib.sha1(payload).hexdigest()
    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(url or "")),
        ("WARC-Payload-Digest", f"sha1:{base32}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
        ("WARC-X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", _record_id(refers_to, digest)), ("WARC-X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp: equal input gives equal bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class ShardWriter:
    """Writes the files of one shard; `done` gives their manifest rows."""

    def __init__(self, where: str, shard: int, limit: int):
        self.files, self.root = fs.FileSystem.from_uri(where)
        self.shard, self.limit, self.rolled, self.rows = shard, limit, 0, []
        self.out = None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.rolled:05d}.warc.gz"
        self.temporary = f"{self.root}/{self.name}.{uuid.uuid4().hex}.tmp"
        self.files.create_dir(self.root, recursive=True)
        self.out, self.hash, self.size, self.records = self.files.open_output_stream(self.temporary), hashlib.sha256(), 0, 0

    def _close(self) -> None:
        self.out.close()
        self.files.move(self.temporary, f"{self.root}/{self.name}")
        self.rows.append((self.shard, self.name, self.records, self.size, self.hash.hexdigest()))
        self.out, self.rolled = None, self.rolled + 1

    def add(self, member: bytes) -> None:
        if self.out is not None and self.size + len(member) > self.limit:
            self._close()
        if self.out is None:
            self._open()
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1

    def done(self) -> list[tuple]:
        if self.out is not None:
            self._close()
        return self.rows


def _write(where: str, limit: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, rows = None, []
        refers: dict = {}
        for batch in batches:
            shards, ids, urls, digests, refer, notes = (batch.column(n).to_pylist() for n in ("shard", "page_id", "url", "digest", "refers_to", "is_note"))
            for i, payload in enumerate(batch.column("payload")):
                if writer is None or writer.shard != shards[i]:
                    rows += writer.done() if writer else []
                    writer, refers = ShardWriter(where, shards[i], limit), {}
                if notes[i]:  # sorted before the pages of its id and digest
                    refers = {(ids[i], digests[i]): refer[i]}
                    continue
                revisit = (ids[i], digests[i]) in refers
                writer.add(gzip_member(make_record(ids[i], urls[i], payload.as_buffer().to_pybytes(), refers.get((ids[i], digests[i])), revisit, date)))
        rows += writer.done() if writer else []
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "file", "records", "bytes", "sha256"])

    return run


def _shard_bounds(keys: DataFrame, min_shards: int, shard_bytes: int) -> np.ndarray:
    """The first id of every shard but the first, so that shards weigh alike: from the exact running sum of bytes over
    the sorted ids, whatever their gaps. A null id is the least. The driver gets a row a shard."""
    weighed = keys.groupBy(F.coalesce("page_id", F.lit(LEAST)).alias("id")).agg(F.sum(F.col("bytes") + 400).alias("w"))
    ranged = materialize(weighed.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()), "ids")
    parts = {r["part"]: r["w"] for r in ranged.groupBy("part").agg(F.sum("w").alias("w")).collect()}  # a row a partition
    total = sum(parts.values())
    shards = max(min_shards, -(-total // shard_bytes))
    base, before = {}, 0
    for part in sorted(parts):
        base[part], before = before, before + parts[part]
    bases = keys.sparkSession.createDataFrame(list(base.items()), "part int, base long")
    running = F.sum("w").over(Window.partitionBy("part").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = ranged.join(F.broadcast(bases), "part").withColumn("middle", F.col("base") + running - F.floor(F.col("w") / 2))
    shard = F.least(F.lit(shards - 1), F.floor(F.col("middle") * shards / F.lit(max(1, total))))
    firsts = summed.groupBy(shard.alias("shard")).agg(F.min("id").alias("id")).orderBy("shard").collect()
    return np.array([r["id"] for r in firsts][1:], np.int64)


def write_archives(
    pages: DataFrame, where: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000, shard_bytes: int = 256 << 20, file_bytes: int = 64 << 20, min_shards: int = 12, date: str = "2000-01-01T00:00:00Z"
) -> DataFrame:
    """Write one record per row under `where` (a folder that all executors reach); return the manifest.

    Payload: the text in UTF-8, a null as no bytes. Among rows with equal payloads of at least
    `min_revisit_bytes` bytes, those with the greatest id are responses, the others revisits of it; a null id
    counts as the least. Repeated rows give repeated records. Null or strange addresses are kept with control
    characters as %-codes. Very long pages are records like any. An empty table writes no file and an empty manifest. Extra columns are ignored.
    """
    spark = pages.sparkSession
    prepare_workers(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.encode(F.coalesce(html_col, F.lit("")), "UTF-8").alias("payload"))
    sized = rows.withColumn("digest", F.sha1("payload"))
    keys = materialize(sized.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "digests")

    large = keys.where(F.col("bytes") >= min_revisit_bytes)
    copies = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    notes = salted_lookup(large, copies, ["digest"]).where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "digest", "refers_to").distinct()

    bounds = _shard_bounds(keys, min_shards, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(np.int64), side="right").astype("int32"), index=ids.index)

    shards = len(bounds) + 1
    union = sized.withColumn("is_note", F.lit(False)).unionByName(notes.withColumn("is_note", F.lit(True)), allowMissingColumns=True).withColumn("shard", shard_of(F.coalesce("page_id", F.lit(LEAST))))
    dealt = union.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "digest", F.desc("is_note"), "url")
    manifest = dealt.select("shard", "page_id", "url", "payload", "digest", "refers_to", "is_note").mapInArrow(_write(where, file_bytes, date), MANIFEST)
    manifest.write.parquet(f"{where}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{where}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    unpack, out = zlib.decompressobj(31), BytesIO()
    data = stream.read(1 << 20)
    while data:
        out.write(unpack.decompress(data))
        if unpack.eof:
            yield out.getvalue()
            data = unpack.unused_data or stream.read(1 << 20)
            unpack, out = zlib.decompressobj(31), BytesIO()
        else:
            data = stream.read(1 << 20)
    if out.getbuffer().nbytes:
        raise ValueError("an archive ends inside a record")


def parse_record(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a record: {first[:40]!r}")
    h = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(h["Content-Length"])]
    if f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" != h["WARC-Block-Digest"]:
        raise ValueError(f"{h['WARC-Record-ID']}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = h["WARC-Type"] == "revisit"
    digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{h['WARC-Record-ID']}: payload digest differs")
    number = lambda x: int(x) if x else None
    return {
        "page_id": number(h["WARC-X-Page-ID"]), "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": number(h.get("WARC-X-Refers-To-Page-ID")),
        "payload_bytes": int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]), "payload_digest": digest, "payload": None if revisit else payload,
    }


def read_archives(spark: SparkSession, where: str, *, with_payload: bool = False) -> DataFrame:
    """The records of the files that the manifest lists; digests are checked. A revisit has no payload here."""
    prepare_workers(spark)
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    names = [c.split()[0] for c in schema.split(", ")]

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(where)
        for frame in frames:
            for name, count in zip(frame["file"], frame["records"]):
                rows, seen = [], 0
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse_record(raw))
                        seen += 1
                        if len(rows) == 1000:
                            yield _frame(rows, names)
                            rows = []
                if seen != count:
                    raise ValueError(f"{name}: {seen} records, the manifest says {count}")
                yield _frame(rows, names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{where}/_manifest")
    return manifest.repartition(max(1, min(manifest.count(), 10_000)), "file").mapInPandas(read, schema)


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    frame = settled(pd.DataFrame(rows, columns=names))
    return frame.astype({n: "Int64" for n in ("page_id", "refers_to") if n in names})


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Write `pages` to a new folder of the shared directory and read the records back."""
    where = new_dir(pages.sparkSession, "warc")
    write_archives(pages, where, **options)
    return read_archives(pages.sparkSession, where)
