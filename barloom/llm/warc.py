"""WARC archives: captures are written once, headers are shuffled by payload digest, and repeated payloads become revisit records.

Files are gzip members one after another, a record each, so that a record can be read by its offset alone.  A task
starts a new file when the last one has ``roll_bytes``.  Files carry the name of the task attempt that wrote them; the index, which
Spark commits, names those that count.  The index holds headers only: a payload is never shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.records import file_system
from barloom.llm.textops import slices

ROLL_BYTES = 1 << 30  # compressed bytes of a file
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
#: One row per record, in the order of the file.
INDEX = ("path string, offset long, length long, record_id string, record_type string, page_id long, url string, date string, "
         "payload_digest string, payload_bytes long, refers_to_record string, refers_to_page long")
_NAMES = [x.split()[0] for x in INDEX.split(", ")]


class DamagedArchive(ValueError):
    """A record whose framing, lengths or digests do not fit."""


def digest(payload: bytes) -> str:
    """SHA-1 in base32, as WARC headers carry it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _escaped(url: str) -> str:
    """The URL with control characters and spaces, which would break a header line, percent-encoded."""
    return re.sub(r"[\x00-\x20\x7F]", lambda m: quote(m[0], safe=""), url)


def _block(head: dict, block: bytes) -> bytes:
    """A record: version, header lines, the block, and two line ends, as one gzip member."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + pack.flush()


def _record(row: dict, payload: bytes | None) -> bytes:
    """The record of an index row; a revisit has HTTP headers but no payload."""
    http = HTTP_HEAD % row["payload_bytes"]
    block = http if row["record_type"] == REVISIT else http + payload
    head = {
        "WARC-Type": row["record_type"], "WARC-Record-ID": f"<urn:uuid:{row['record_id']}>", "WARC-Date": row["date"],
        "WARC-Target-URI": None if row["url"] is None else _escaped(row["url"]),
        "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "WARC-Block-Digest": f"sha1:{digest(block)}",
        "Page-Id": row["page_id"], "Content-Type": "application/http; msgtype=response"}
    if row["record_type"] == REVISIT:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{row['refers_to_record']}>" if row["refers_to_record"] else None,
                 "Refers-To-Page-Id": row["refers_to_page"]}
    return _block(head, block)


def _parsed(data: bytes, where: str) -> tuple[dict, bytes]:
    """Header fields of a record and its payload (none in a revisit), checked against the record's own digests."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields.get("Content-Length", -1))
    if lines[0] != "WARC/1.1" or not gap or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise DamagedArchive(f"damaged record in {where}")
    block = rest[:size]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise DamagedArchive(f"block and digest differ in {where}")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == RESPONSE and (len(payload) != said or fields["WARC-Payload-Digest"] != f"sha1:{digest(payload)}"):
        raise DamagedArchive(f"payload and digest differ in {where}")

    def number(name: str) -> int | None:
        return int(fields[name]) if name in fields else None

    def identity(name: str) -> str | None:
        return fields[name].removeprefix("<urn:uuid:").removesuffix(">") if name in fields else None

    return {
        "record_id": identity("WARC-Record-ID"), "record_type": fields["WARC-Type"], "page_id": number("Page-Id"),
        "url": fields.get("WARC-Target-URI"), "date": fields["WARC-Date"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload_bytes": said,
        "refers_to_record": identity("WARC-Refers-To"), "refers_to_page": number("Refers-To-Page-Id")}, payload


class _Writer:
    """Record files of one task attempt; ``written`` collects their index rows."""

    def __init__(self, folder: str, roll_bytes: int):
        from pyspark import TaskContext

        self.roll_bytes = roll_bytes
        self.base = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        self.out, self.at, self.files, self.written = None, 0, 0, []

    def add(self, row: dict, payload: bytes | None) -> None:
        if self.out is None or self.at >= self.roll_bytes:
            self.close()
            self.path = f"{self.base}-{self.files:05d}.warc.gz"
            fs, local = file_system(self.path)
            fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
            self.out, self.at, self.files = fs.open_output_stream(local, compression=None), 0, self.files + 1
        data = _record(row, payload)
        self.out.write(data)
        self.written.append(row | {"path": self.path, "offset": self.at, "length": len(data)})
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def rows(self) -> pa.RecordBatch:
        found, self.written = self.written, []
        return _batch(found)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.RecordBatch.from_arrays(
        [pa.array([r[n] for r in rows], kinds[x.split()[1]]) for n, x in zip(_NAMES, INDEX.split(", "), strict=True)], _NAMES)


def write_captures(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a response record per row of ``pages`` (page_id, url, html) below ``folder``; the index of the records.

    The payload is the html in UTF-8, a null html an empty one.  A null page_id or url leaves its header out.  Other
    columns are ignored, repeated rows stay repeated, an empty table gives an empty index.  A page is one record
    whatever its length.  Control characters and spaces of a URL are percent-encoded.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, roll_bytes)
        for batch in batches:
            for piece in slices(batch, "html"):
                for page, url, html in zip(piece.column("page_id").to_pylist(), piece.column("url").to_pylist(), piece.column("html"), strict=True):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    writer.add({
                        "record_id": str(uuid.uuid4()), "record_type": RESPONSE, "page_id": page, "url": url, "date": DATE,
                        "payload_digest": digest(payload), "payload_bytes": len(payload), "refers_to_record": None, "refers_to_page": None}, payload)
                if piece.num_rows:
                    yield writer.rows()
        writer.close()

    index = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html")).mapInArrow(write, INDEX)
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _rank() -> Column:
    """Which of equal payloads is the original: a response before a revisit, the smallest page (null last), then URL and place."""
    return F.struct((F.col("record_type") != RESPONSE).alias("late"), F.col("page_id").isNull().alias("unknown"), "page_id", "url", "path", "offset")


def resolve(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The index with record types, and what revisits refer to, as payload digests decide.

    Headers are shuffled by digest.  Of records with equal payloads of at least ``min_bytes`` bytes, the response with the smallest
    page_id (null last, then by URL and place) stays a response; the others become revisits of it.  Smaller payloads
    are left as they are.  A revisit that came with the archives refers to the response found for its digest; without
    one it keeps what it says.  Copies are counted by an aggregate that combines before the shuffle, and only digests
    that occur more than once are joined, so that a digest of a third of all rows is a skewed join and no group.
    """
    of_size = F.col("payload_bytes") >= min_bytes
    originals = (index.where(of_size).groupBy("payload_digest", "payload_bytes")
                 .agg(F.min(F.struct(_rank().alias("rank"), "record_id")).alias("first"), F.count("*").alias("n"))
                 .where((F.col("n") > 1) & ~F.col("first.rank.late"))
                 .select("payload_digest", "payload_bytes", F.col("first.record_id").alias("first_record"), F.col("first.rank.page_id").alias("first_page")))
    revisits = F.col("first_record").isNotNull() & (F.col("first_record") != F.col("record_id"))
    return (index.join(originals, ["payload_digest", "payload_bytes"], "left")
            .withColumns({
                "record_type": F.when(revisits, F.lit(REVISIT)).otherwise(F.col("record_type")),
                "refers_to_record": F.when(revisits, F.col("first_record")).otherwise(F.col("refers_to_record")),
                "refers_to_page": F.when(revisits, F.col("first_page")).otherwise(F.col("refers_to_page"))})
            .select(*_NAMES))


def write_resolved(resolved: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the archives anew with the types of ``resolved``: payloads of responses, headers alone for revisits; the new index.

    A record is fetched by its offset, in the order of its file, so that each old file is read once and no payload moves
    between tasks.  Record ids stay, so that references hold.
    """
    spark = resolved.sparkSession

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, file = _Writer(folder, roll_bytes), None, None
        for batch in batches:
            for row in batch.to_pylist():
                payload = None
                if row["record_type"] == RESPONSE:
                    if row["path"] != name:
                        fs, local = file_system(row["path"])
                        name, file = row["path"], fs.open_input_file(local)
                    file.seek(row["offset"])
                    _, payload = _parsed(zlib.decompress(file.read(row["length"]), 31), f"{name} at {row['offset']}")
                writer.add(row, payload)
            if batch.num_rows:
                yield writer.rows()
        writer.close()

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    index = resolved.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(rewrite, INDEX)
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the files that an index names, read from the files alone and checked: the index columns and, if asked for, ``payload`` (null in a revisit)."""
    spark = index.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given(rows: list[dict], found: list[bytes | None]) -> pa.RecordBatch:
            heads = _batch(rows)
            return heads.append_column("payload", pa.array(found, pa.binary())) if payloads else heads

        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, found, waiting = [], [], 0
                for offset, length, data in members(path):
                    head, payload = _parsed(data, f"{path} at {offset}")
                    rows.append(head | {"path": path, "offset": offset, "length": length})
                    found.append(payload if payloads and head["record_type"] == RESPONSE else None)
                    waiting += len(data)
                    if waiting >= READ_BYTES:
                        yield given(rows, found)
                        rows, found, waiting = [], [], 0
                if rows:
                    yield given(rows, found)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    files = index.select("path").distinct().repartitionByRange(tasks, "path")
    return files.mapInArrow(read, f"{INDEX}, payload binary" if payloads else INDEX)


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of a file, read in pieces."""
    fs, local = file_system(path)
    with fs.open_input_stream(local, compression=None) as f:
        at, start, unpack, parts = 0, 0, zlib.decompressobj(31), []
        while True:
            data = f.read(READ_BYTES)
            if not data:
                break
            while data:
                parts.append(unpack.decompress(data))
                at += len(data) - len(unpack.unused_data)
                data = unpack.unused_data
                if unpack.eof:
                    yield start, at - start, b"".join(parts)
                    start, unpack, parts = at, zlib.decompressobj(31), []
        if parts:
            raise DamagedArchive(f"{path} ends inside a record")


def resolved_pages(records: DataFrame) -> DataFrame:
    """A row per record of ``read_archives`` with revisits joined to their originals: page_id, url, record_type, refers_to, payload_digest, payload_bytes, resolved.

    Lengths and digests are those of the full payload, which a revisit takes from the response that it refers to.
    ``resolved`` is false, and what the revisit says itself stands, if that response is not among the records.  The records
    are read twice: give a stored table, whose size also tells Spark how to join.
    """
    heads = records.select(*_NAMES)
    originals = heads.where(F.col("record_type") == RESPONSE).select(
        F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"))
    again = heads.where(F.col("record_type") == REVISIT).join(originals, "refers_to_record", "left")
    found = F.col("_digest").isNotNull() & (F.col("_digest") == F.col("payload_digest"))
    revisits = again.select(
        "page_id", "url", "record_type", F.when(found, F.col("_page")).otherwise(F.col("refers_to_page")).alias("refers_to"),
        F.when(found, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(found, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), found.alias("resolved"))
    responses = heads.where(F.col("record_type") == RESPONSE).select(
        "page_id", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("resolved"))
    return responses.unionByName(revisits)


def deduplicated(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Captures of all pages and their deduplicated archives below ``folder``; the index of the latter."""
    captures = write_captures(pages, f"{folder}/captures")
    return write_resolved(resolve(captures, min_bytes), f"{folder}/archives")
