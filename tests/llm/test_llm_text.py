"""Tokenising, BPE, records and suffix sorting against the plain way of doing them."""

import base64
import hashlib
import random
import struct
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from barloom.llm import bytebpe, pretokens, records, suffixdedup, suffixsort, textops  # noqa: E402

PIECES = ["a", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "1", "½", "é", "ñ", " ", "\x85", "\x1c", ".", "!", "漢", "😀", "́"]


def texts(n, size, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, size))) for _ in range(n)]


def test_pretokens_equal_the_pattern():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    found = [*texts(3000, 12, 1), None, ""]
    raw, offsets = textops.buffers(pa.array(found, pa.string()))
    starts, ends = pretokens.pretokens(raw, offsets)
    data = raw.tobytes()
    assert [data[a:b].decode() for a, b in zip(starts, ends)] == [w for t in found for w in pattern.findall(t or "")]


def test_codec_equals_the_rank_encoder_and_inverts():
    import tiktoken

    own = bytebpe.codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    found = [*texts(2000, 30, 2), "x" * 3000, "<|endoftext|>", *("x" + chr(c) + " y" for c in range(1, 0x3000))]
    raw, offsets = textops.buffers(pa.array(found, pa.string()))
    ids, at = own.encode(raw, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [other.encode_ordinary(t) for t in found]
    assert own.decode(ids).tobytes() == raw.tobytes()


def test_a_vocabulary_with_gaps_or_missing_bytes_is_refused():
    ranks = {bytes([b]): b for b in range(256)}
    assert bytebpe.serialise_model(ranks)
    for bad in ({**ranks, b"ab": 300}, {k: v for k, v in ranks.items() if v < 255}):
        with pytest.raises(ValueError):
            bytebpe.serialise_model(bad)


def test_encoding_keeps_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "ab ab", "x"), (1, "ab ab", "x"), (None, None, None), (2, "", "y")], "doc_id long, text string, ids string")
    got = bytebpe.encode_and_decode(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "_ids", "ids", "decoded"] and len(rows) == 4
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows) and Counter(r["_ids"] for r in rows)["x"] == 2
    assert bytebpe.encode_and_decode(df.limit(0), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).count() == 0


def test_records_round_trip_in_order_and_shuffled(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(3, "b c"), (1, None), (None, "x"), (1, ""), (7, "long word " * 5000), (3, "b c"), (9, "<|endoftext|>"), (10, "a <|endoftext|> b"),
            (11, "<|endoftext|><|endoftext|>\n<|endoftext"), (12, "|>"), (13, "x<|endoftext|>'s  <|endof"), (14, "text|>")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int")
    path = f"{tempfile.mkdtemp(prefix='records-')}/out"
    want = [np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in rows]
    for roll in (1 << 30, 40):
        manifest = records.write_records(df, f"{path}-{roll}", public_tokenizers.path("byte_bpe_50k.json"), 2, partitions=3, roll_bytes=roll)
        assert (manifest.count() > 3) == (roll == 40)
        got = records.read_records(manifest).orderBy("before").collect()
        assert [r.doc_id for r in got] == [None, 1, 1, 3, 3, 7, 9, 10, 11, 12, 13, 14]
        assert sorted((r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((d or 0, x) for (d, _), x in zip(rows, want))
        assert [r.before for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]
        again = records.read_shuffled(manifest, 5).collect()
        assert sorted((r.part, r.place, bytes(r.ids)) for r in again) == sorted((r.part, r.place, bytes(r.ids)) for r in got)
    assert records.write_records(df.limit(0), path + "-none", public_tokenizers.path("byte_bpe_50k.json"), 2).count() == 0
    with pytest.raises(TypeError):
        records.write_records(df.selectExpr("string(doc_id) AS doc_id", "text"), path + "-no", public_tokenizers.path("byte_bpe_50k.json"), 2)


def test_added_tokens_are_cut_as_the_library_cuts_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, coder = Tokenizer.from_file(path), records.Coder(path)
    rnd = random.Random(3)
    found = ["".join(rnd.choice([*PIECES, "<|endoftext|>", "<|endoftext|>", "<|", "endoftext|>"]) for _ in range(rnd.randint(0, 9))) for _ in range(2000)]
    raw, offsets = textops.buffers(pa.array(found, pa.string()))
    ids, at = coder.encode(raw, offsets)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [own.encode(t, add_special_tokens=False).ids for t in found]


def test_damaged_frames_are_noticed():
    data = bytearray(records.frame(b"payload"))
    assert bytes(records.unframe(memoryview(bytes(data)), 0, "here")[0]) == b"payload"
    crc = zlib.crc32(b"payload")
    assert struct.unpack("<I", data[-4:])[0] == (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF
    for place in (0, 9, 14, len(data) - 1):
        broken = bytearray(data)
        broken[place] ^= 1
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(broken)), 0, "here")


@pytest.mark.parametrize("depth,shallow", [(48, 8), (48, 24), (24, 24), (200, 24)])
def test_deep_shallow_order_and_equality(depth, shallow):
    rng = np.random.default_rng(depth + shallow)
    for _ in range(12):
        raw = rng.integers(97, 99, 900, dtype=np.uint8)
        raw[300:600], raw[650:850] = raw[0:300], 97
        raw = np.r_[raw, np.zeros(8, np.uint8)]
        starts, bucket = np.arange(690), rng.integers(0, 3, 690)
        order, equal = suffixsort.deep_shallow(raw, starts, bucket, depth, shallow)
        whole = [(bucket[i], raw[i:i + depth].tobytes()) for i in starts]
        times = Counter(whole)
        assert [whole[i] for i in order] == sorted(whole) and [times[x] > 1 for x in whole] == equal.tolist()


def removed(found):
    """The contract, string by string."""
    data = [(t or "").encode() for t in found]
    times = Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if times[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    passage = " ".join(word() for _ in range(60))
    other = " ".join(word() for _ in range(90))
    found = [None, "", "short", "x" * 199, "y" * 200, "z" * 5000, passage, passage, "pre " + passage + " post", other]
    found += [" ".join(word() for _ in range(30)) + passage[k * 3:k * 3 + 260] + " ".join(word() for _ in range(30)) for k in range(12)]
    found += [other[:k * 40] + " " + word() + other[k * 40:] for k in range(1, 9)] + ["ab" * 150 + passage + "ab" * 130]
    rows = [(i, t) for i, t in enumerate(found)] + [(len(found), passage), (len(found), passage)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, kept string").repartition(3)
    got = suffixdedup.without_repeats(df)
    assert got.columns == ["doc_id", "text", "_kept", "kept", "n_spans", "n_removed"]
    key = lambda d, x: (d, *x)
    assert sorted(key(r.doc_id, (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())) for r in got.collect()) == sorted(
        key(d, x) for (d, _), x in zip(rows, removed([t for _, t in rows])))
    assert suffixdedup.without_repeats(df.limit(0)).count() == 0


def test_a_line_in_many_documents_is_not_sorted_by_one_task(spark, monkeypatch):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    line = "".join(rnd.choice("nopqrst") for _ in range(150))
    found = [" ".join(word() for _ in range(60)) + line + " ".join(word() for _ in range(60)) for _ in range(40)]
    found += [found[k][40 + k:-60] + word() for k in range(6)]
    rows = [(i, t) for i, t in enumerate(found)] + [(3, found[3])]
    sort = suffixdedup._sort_buckets

    def small_buckets(batches):
        for batch in batches:
            assert max(Counter(batch.column("anchor").to_pylist()).values(), default=0) <= 8
            yield from sort([batch])

    monkeypatch.setattr(suffixdedup, "HOT_REGIONS", 8, raising=False)
    monkeypatch.setattr(suffixdedup, "_sort_buckets", small_buckets)
    got = suffixdedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got.collect()) == sorted(
        (d, *x) for (d, _), x in zip(rows, removed([t for _, t in rows])))


def counting_table(limit):
    """A table of pieces and the list of what it had to encode, each byte as one id."""
    asked = []

    def encode(pieces):
        asked.extend(pieces)
        return [list(p) for p in pieces]

    return pretokens.PieceTable(encode, limit), asked


def test_a_nearly_full_table_encodes_known_pieces_no_more():
    table, asked = counting_table(8)
    for words in ("a b c d e f", "f e d c b a", "g h", "a b c d e f g h i j k l"):
        raw = np.frombuffer(words.encode(), np.uint8)
        ids, at = table.encode(raw, np.array([0, len(raw)]))
        assert bytes(ids.astype(np.uint8)) == words.encode() and at.tolist() == [0, len(raw)]
    # The second text brings "f" and " a" only; the third and the last do not fit with what is held then.
    assert len(asked) == 6 + 2 + 2 + 12


def test_a_full_table_takes_few_bytes_a_piece():
    import tracemalloc

    table, _ = counting_table(1 << 20)
    tracemalloc.start()
    for k in range(0, 200_000, 10_000):
        words = ("".join(chr(97 + i // 26**d % 26) for d in range(4)) for i in range(k, k + 10_000))
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        table.encode(raw, np.array([0, len(raw)]))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 110 * 200_000  # their ids, five each, are 20 of these bytes


@pytest.mark.parametrize("split", ["byte level", "sequence"])
def test_pieces_are_merged_as_the_library_merges_them(tmp_path, split):
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    if split == "sequence":  # the same pattern, stated otherwise: pieces go through the whole tokenizer
        own.pre_tokenizer = pre_tokenizers.Sequence([own.pre_tokenizer])
    own.save(path := str(tmp_path / "own.json"))
    coder = records.Coder(path)
    rows = ["", *texts(60, 60, 9), "\x00\x01 \x7f", "naïve antidisestablishmentarianism 漢字かな交じり文", "x" * 300]
    data = [r.encode() for r in rows]
    ids, at = coder.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [own.encode(r, add_special_tokens=False).ids for r in rows]
