"""Token ids as length-delimited binary records, with an offset index beside each file.

A data file is a run of frames: length (8 bytes), masked checksum of the length (4), payload, masked checksum of the
payload (4); all numbers little-endian.  A payload holds a flag byte, the document id (8 bytes) and the ids, two bytes
each if the vocabulary allows, else four.  The index file holds the frame offsets (8 bytes each) and a last one for the
end, so any record can be read on its own.  Files carry the name of the task attempt that wrote them; the manifest, which
Spark commits, names those that count.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from barloom.llm.bytebpe import byte_characters
from barloom.llm.pretokens import SPLIT_BYTES, PieceTable
from barloom.llm.textops import buffers, slices

NULL_ID, WIDE = 1, 2
HEAD, HEAD_SIZE = "<Bq", 9
FRAME = 12
READ_BYTES = 4 << 20
ROLL_BYTES = 1 << 30
FILES_OF_TASK = 1 << 32  # a file's part number: task times this, plus its place
MANIFEST = "part long, path string, index_path string, n_records long, n_ids long, n_bytes long"
RECORD = "part long, place long, doc_id long, before long, n_tokens long, ids binary"


def masked(data: bytes) -> int:
    """CRC-32, rotated and shifted, so that checksums of data that hold checksums stay useful."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int, where: str) -> tuple[memoryview, int]:
    """The payload of the frame at ``at`` and the place after it; damage is an error."""
    length = bytes(data[at:at + 8])
    size, check = struct.unpack("<Q", length)[0], struct.unpack("<I", data[at + 8:at + FRAME])[0]
    if check != masked(length):
        raise ValueError(f"damaged length in {where} at {at}")
    payload = data[at + FRAME:at + FRAME + size]
    if struct.unpack("<I", data[at + FRAME + size:at + FRAME + size + 4])[0] != masked(payload):
        raise ValueError(f"damaged record in {where} at {at}")
    return payload, at + FRAME + size + 4


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


class Coder:
    """Ids as the tokenizer's library gives them without special tokens added: added tokens that stand in a text are
    cut out first, as one id each, and what lies between goes through a table of pre-tokens."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        plain, own = Tokenizer.from_file(path), Tokenizer.from_file(path)
        plain.encode_special_tokens = True
        added = own.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("added tokens must stand for their own text only")
        self.added = {t.content.encode(): i for i, t in added.items()}
        self.marks = re.compile(b"|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.size = own.get_vocab_size()

        def encode(pieces: list[bytes]) -> list[list[int]]:
            return [x.ids for x in plain.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

        model, shown = plain.model, np.array(list(map(ord, byte_characters())), "<u2")

        def merged(pieces: list[bytes]) -> list[list[int]]:
            """Pieces are pre-tokens already, so the library's model takes them as they are, a character for each byte."""
            text = shown[np.frombuffer(b"".join(pieces), np.uint8)].tobytes().decode("utf-16-le")
            ends = list(accumulate(map(len, pieces)))
            return [[t.id for t in model.tokenize(text[a:b])] for a, b in zip([0, *ends], ends, strict=False)]

        split = plain.pre_tokenizer
        bare = plain.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and not split.add_prefix_space
        self.table = PieceTable(merged if bare else encode)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of each among them."""
        data = raw.tobytes()
        if self.marks is None or not self.marks.search(data):
            return self.table.encode(raw, offsets)
        cuts, found, first = [], {}, []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            first.append(len(cuts))
            cuts.append(a)
            for m in self.marks.finditer(data, a, b):
                found[len(cuts)] = self.added[m[0]]
                cuts += [m.start(), m.end()]
        first.append(len(cuts))
        ids, ends = self.table.encode(raw, np.array([*cuts, len(raw)], np.int64))
        pieces = [np.array([found[k]], ids.dtype) if k in found else ids[ends[k]:ends[k + 1]] for k in range(len(cuts))]
        total = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        return np.concatenate(pieces) if pieces else ids, total[first]


@cache
def coder(path: str) -> Coder:
    return Coder(path)


def write_records(df: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the ids of ``df``'s texts (doc_id, text) to record files below ``path`` in ascending doc_id order; the manifest.

    Each text is encoded as the tokenizer's library does without adding special tokens, and followed by ``end_id``; an
    added token that stands in a text is its one id.  A null text counts as empty, an empty text is the end id alone, and
    a text is one record whatever its length.  ``doc_id`` is of an integer type; a null one is kept as such and comes
    first.  Equal ids follow in the order of their texts, repeated rows stay repeated.  Other columns are ignored.  An
    empty table gives an empty manifest.  The tokenizer must split texts by the byte-level pattern of ``pretokens`` and
    have no normaliser.

    A task closes a file after ``roll_bytes`` and starts the next, so that files and their indexes stay small however
    much a task writes.
    """
    spark = df.sparkSession
    if not isinstance(df.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own_coder = coder(tokenizer)
        wide = max(own_coder.size - 1, end_id) >= 1 << 16
        kind = np.dtype("<u4" if wide else "<u2")
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, base, starts, at, total, files = None, "", [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            fs, local = file_system(base)
            with fs.open_output_stream(f"{local}.idx") as index:
                index.write(np.array([*starts, at], "<u8").tobytes())
            return pa.RecordBatch.from_pydict({
                "part": pa.array([task * FILES_OF_TASK + files], pa.int64()), "path": [f"{base}.rec"], "index_path": [f"{base}.idx"],
                "n_records": [len(starts)], "n_ids": [total], "n_bytes": [at]})

        for batch in batches:
            for piece in slices(batch, "text", SPLIT_BYTES):
                raw, offsets = buffers(piece.column("text"))
                ids, ends = own_coder.encode(raw, offsets)
                for k, doc in enumerate(piece.column("doc_id").to_pylist()):
                    if out is not None and at >= roll_bytes:
                        yield closed()
                        out, files = None, files + 1
                    if out is None:
                        base = f"{path}/part-{task:06d}-{attempt}-{files:05d}"
                        fs, local = file_system(base)
                        fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                        out, starts, at, total = fs.open_output_stream(f"{local}.rec"), [], 0, 0
                    own = np.append(ids[ends[k]:ends[k + 1]], end_id).astype(kind)
                    data = frame(struct.pack(HEAD, NULL_ID * (doc is None) | WIDE * wide, doc or 0) + own.tobytes())
                    out.write(data)
                    starts.append(at)
                    at, total = at + len(data), total + len(own)
        if out is not None:
            yield closed()

    ordered = (df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange(partitions, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text"))
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def _parsed(found: list[tuple], part: int) -> pa.RecordBatch:
    """Record rows from (place, payload, ids before it)."""
    docs, sizes, ids = [], [], []
    for _, payload, _ in found:
        flags, doc = struct.unpack(HEAD, payload[:HEAD_SIZE])
        own = np.frombuffer(payload[HEAD_SIZE:], "<u4" if flags & WIDE else "<u2")
        docs.append(None if flags & NULL_ID else doc)
        sizes.append(len(own))
        ids.append(own.astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays([
        pa.array([part] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array(docs, pa.int64()),
        pa.array([x[2] for x in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
    ], ["part", "place", "doc_id", "before", "n_tokens", "ids"])


def read_records(manifest: DataFrame) -> DataFrame:
    """All records of the files, checked: part, place in the file, doc_id, ids of earlier records, n_tokens, ids.

    ``before`` counts the ids of all records in earlier files and earlier in the same one.  A file is streamed in pieces
    of a few megabytes, found by its index.
    """
    # A row per file.
    files = manifest.withColumn("_base", F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids"))
    parts = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = file_system(row["path"])
                index_fs, index_path = file_system(row["index_path"])
                with index_fs.open_input_stream(index_path) as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64)
                if len(index) != row["n_records"] + 1 or index[-1] != row["n_bytes"]:
                    raise ValueError(f"damaged index {row['index_path']}")
                before, first = row["_base"], 0
                with fs.open_input_file(local) as f:
                    while first < row["n_records"]:
                        last = max(first + 1, int(np.searchsorted(index, index[first] + READ_BYTES, side="right")) - 1)
                        f.seek(int(index[first]))
                        data, found = memoryview(f.read(int(index[last] - index[first]))), []
                        for k in range(first, last):
                            payload, end = unframe(data, int(index[k] - index[first]), row["path"])
                            if end != index[k + 1] - index[first]:
                                raise ValueError(f"index and file differ in {row['path']} at record {k}")
                            found.append((k, payload, before))
                            wide = payload[0] & WIDE
                            before += (len(payload) - HEAD_SIZE) // (4 if wide else 2)
                        yield _parsed(found, row["part"])
                        first = last
                if before != row["_base"] + row["n_ids"]:
                    raise ValueError(f"{row['path']} holds other ids than its manifest says")

    return files.repartition(int(parts), "part").mapInArrow(read, RECORD)


def read_shuffled(manifest: DataFrame, seed: int, partitions: int | None = None) -> DataFrame:
    """The same records in a random order: the index entries are shuffled and each record is read from its own offset."""
    spark = manifest.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, local = file_system(row["index_path"])
                with fs.open_input_stream(local) as f:
                    index = np.frombuffer(f.read(), "<u8").astype(np.int64)
                n = len(index) - 1
                yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * n, pa.int64()), "path": [row["path"]] * n,
                                                  "place": np.arange(n), "at": index[:-1], "size": np.diff(index)})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != name:
                    fs, local = file_system(row["path"])
                    name, file = row["path"], fs.open_input_file(local)
                file.seek(row["at"])
                payload, _ = unframe(memoryview(file.read(row["size"])), 0, name)
                yield _parsed([(row["place"], payload, None)], row["part"])

    key = F.xxhash64(F.lit(seed), "part", "place")
    return (manifest.repartition(partitions, "part").mapInArrow(entries, "part long, path string, place long, at long, size long")
            .withColumn("_key", key).repartitionByRange(partitions, "_key").sortWithinPartitions("_key", "part", "place").drop("_key")
            .mapInArrow(fetch, RECORD).drop("before"))


def digests(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """A row per record read back: doc_id, ids before it, its token count and the CRC-32 of its ids."""
    return read_records(manifest).select(
        "doc_id", F.col("before").alias("start"), "n_tokens", F.crc32("ids").alias("ids_crc32"))
