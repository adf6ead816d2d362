"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank vocabulary.

Every byte stands for one printable character, so a vocabulary entry becomes a piece of such characters; its score is
minus its rank, hence sentencepiece merges in rank order.  Normalisation is the identity.  Pre-tokens are encoded one by
one, and ids are decoded by the inverse mapping of pieces to bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.pretokens import SPLIT_BYTES, PieceTable
from barloom.llm.textops import buffers, ragged, slices
from barloom.llm.work import free_name, small_batches


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next code point from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model: piece r has rank r, and the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("every single byte must have a rank")
    chars = byte_characters()
    model = proto.ModelProto()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        model.pieces.add(piece="".join(chars[b] for b in token), score=-float(rank), type=proto.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = proto.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(ranks)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import sentencepiece

        self.ranks = ranks
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        self.chars = byte_characters()
        back = {c: b for b, c in enumerate(self.chars)}
        pieces = [bytes(back[c] for c in self.processor.id_to_piece(i)) for i in range(len(ranks))]
        self.piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.piece_begin = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.table = PieceTable(self._encode_pieces)

    def _encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """A pre-token that is an entry itself takes its rank, as in the usual encoders; others are merged."""
        out = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        rest = [i for i, x in enumerate(out) if x is None]
        mapped = ["".join([self.chars[b] for b in pieces[i]]) for i in rest]
        for i, ids in zip(rest, self.processor.encode(mapped, num_threads=1) if rest else [], strict=True):
            out[i] = ids
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table.encode(raw, offsets)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        return self.piece_bytes[ragged(self.piece_begin[ids], self.piece_size[ids])]


@cache
def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker process."""
    return Codec(read_ranks(path))


def encode_and_decode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids (binary, little-endian unsigned 32-bit) of its texts and the bytes decoded from them.

    A null text counts as empty; an empty text has no ids.  Every row is encoded on its own, so repeated rows and empty
    tables need no care.  Columns of ``df`` called like the new ones are kept with a leading underscore.  Narrow: no
    shuffle.  ``vocabulary`` is the path of a rank file that every executor can read.
    """
    for name in (ids, decoded):
        for have in [c for c in df.columns if c.lower() == name.lower()]:
            df = df.withColumnRenamed(have, free_name(df, f"_{name}"))
    small_batches(df.sparkSession)
    return df.mapInArrow(_coder(vocabulary, text), _with(df, ids, decoded))


def _with(df: DataFrame, *names: str):
    from pyspark.sql.types import BinaryType, StructField, StructType

    return StructType([*df.schema.fields, *(StructField(n, BinaryType()) for n in names)])


def _coder(vocabulary: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from barloom.llm.textops import binary_column

        own = codec(vocabulary)
        for batch in batches:
            for part in slices(batch, text, SPLIT_BYTES):
                raw, offsets = buffers(part.column(text))
                ids, at = own.encode(raw, offsets)
                sizes = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(own.piece_size[ids], out=sizes[1:])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, binary_column(ids.astype("<u4"), at), binary_column(own.decode(ids), sizes[at])],
                    [*part.schema.names, "ids_", "decoded_"])

    return run


def digests(coded: DataFrame, *more: str) -> DataFrame:
    """doc_id, token count, SHA-256 of ids and decoded bytes, and any more of its columns."""
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *more)
