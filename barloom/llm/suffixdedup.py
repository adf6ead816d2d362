"""Removal of repeated byte strings: suffixes are dealt to buckets by content, and buckets are suffix-sorted.

Every string of ``LENGTH`` bytes is assigned to an anchor: of the shorter strings of ``GRAM`` bytes in it, the one with
the least hash.  Equal strings have equal anchors at equal places, so they meet in the bucket of the anchor's hash.  The
strings that share one anchor in a document follow one another; together they are a region.  A bucket with one region
holds no repeat, a bucket of copies of one region nothing else; only buckets with different regions are sorted.  Buckets of
more than HOT_REGIONS regions are not sorted in a task: the hashes of their strings are counted by all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from barloom.llm.suffixsort import deep_shallow
from barloom.llm.textops import SpanHash, binary_column, buffers, mix, ragged, slices
from barloom.llm.work import Workspace, free_name, small_batches

LENGTH = 200
GRAM = 64
SPAN = LENGTH - GRAM + 1  # anchors that compete in one string; at most so many strings are in a region
_COUNT_BITS = 8
TEXT_BYTES = 512 << 10  # bytes of text or of regions handled at a time; the arrays of a pass take some 100 times as much
SORTED_AT_ONCE = 1 << 20  # suffixes
HOT_REGIONS = 4096  # regions up to which one task sorts a bucket: some 561,000 suffixes


def regions(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions of all documents: document, first string, number of strings, anchor hash, content hash."""
    n = len(raw)
    length = np.diff(offsets)
    strings = np.maximum(length - LENGTH + 1, 0)
    if not strings.any():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    own = SpanHash(raw)
    at = np.arange(n - GRAM + 1)
    gram = own.of(at, at + GRAM)
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-len(key) // SPAN) + 1
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max)
    padded[:len(key)] = key
    padded = padded.reshape(blocks, SPAN)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    start = ragged(offsets[:-1], strings)
    doc = np.repeat(np.arange(len(length)), strings)
    anchor = (np.minimum(behind[start], ahead[start + SPAN - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    begin = start[first]
    return doc[first], begin - offsets[doc[first]], count, gram[anchor[first]], own.of(begin, begin + count + LENGTH - 1)


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            doc, first, count, anchor, content = regions(*buffers(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("key").take(pa.array(doc)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)),
                 pa.array((first << _COUNT_BITS) | count)], ["key", "anchor", "content", "place"])


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each wanted region."""
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            raw, offsets = buffers(part.column("text"))
            wanted = part.column("wanted")
            doc = np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))
            fields = [wanted.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3)]
            place = fields[0]
            size = (place & ((1 << _COUNT_BITS) - 1)) + LENGTH - 1
            index = ragged(offsets[doc] + (place >> _COUNT_BITS), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields[1]), pa.array(fields[2]), binary_column(raw[index], np.r_[0, np.cumsum(size)])], ["anchor", "content", "bytes"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of each wanted region: a hash of anchor and bytes, and its place as a run of one."""
    for batch in batches:
        for cut in _cut_out([batch]):
            for part in slices(cut, "bytes", TEXT_BYTES):
                raw, offsets = buffers(part.column("bytes"))
                count = np.diff(offsets) - LENGTH + 1
                region, start = np.repeat(np.arange(len(count)), count), ragged(offsets[:-1], count)
                anchor = part.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64)[region]
                string = mix(SpanHash(raw).of(start, start + LENGTH) + anchor)
                yield pa.RecordBatch.from_arrays(
                    [part.column("anchor").take(pa.array(region)), part.column("content").take(pa.array(region)), pa.array(string.view(np.int64)),
                     pa.array(((start - offsets[region]) << _COUNT_BITS) | 1)], ["anchor", "content", "string", "run"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, content): each bucket's regions are suffix-sorted; runs of repeated strings are returned."""
    anchors, contents, texts, waiting = [], [], [], 0

    def flush():
        nonlocal anchors, contents, texts, waiting
        if not texts:
            return None
        anchor, content = np.concatenate(anchors), np.concatenate(contents)
        sizes = np.concatenate([np.diff(o) for _, o in texts])
        raw = np.concatenate([r for r, _ in texts] + [np.zeros(8, np.uint8)])
        offset = np.cumsum(sizes) - sizes
        # A repeated row of the documents brings its regions again.
        once = np.ones(len(anchor), bool)
        once[1:] = (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])
        anchor, content, sizes, offset = anchor[once], content[once], sizes[once], offset[once]
        strings = sizes - LENGTH + 1
        bucket = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
        starts, region = ragged(offset, strings), np.repeat(np.arange(len(anchor)), strings)
        _, equal = deep_shallow(raw, starts, bucket[region], LENGTH)
        anchors, contents, texts, waiting = [], [], [], 0
        at = starts - offset[region]
        edge = np.ones(len(starts), bool)
        edge[1:] = (region[1:] != region[:-1]) | (equal[1:] != equal[:-1])
        first = np.flatnonzero(edge)
        size = np.diff(np.r_[first, len(starts)])
        first, size = first[equal[first]], size[equal[first]]
        if not len(first):
            return None
        of, change = region[first], np.flatnonzero(np.r_[True, region[first][1:] != region[first][:-1]])
        packed = pa.ListArray.from_arrays(pa.array(np.r_[change, len(first)], pa.int32()), pa.array((at[first] << _COUNT_BITS) | size))
        return pa.RecordBatch.from_arrays([pa.array(anchor[of[change]]), pa.array(content[of[change]]), packed], ["anchor", "content", "runs"])

    for batch in batches:
        anchor, content = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "content"))
        cuts = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1), len(anchor)]
        raw, offsets = buffers(batch.column("bytes"))
        taken = 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            fresh = not anchors or anchors[-1][-1] != anchor[a]
            if fresh and waiting + (offsets[a] - offsets[taken]) >= SORTED_AT_ONCE:
                if a > taken:
                    anchors.append(anchor[taken:a])
                    contents.append(content[taken:a])
                    texts.append((raw[offsets[taken]:offsets[a]], offsets[taken:a + 1]))
                    taken = a
                if (done := flush()) is not None:
                    yield done
        if len(anchor) > taken:
            anchors.append(anchor[taken:])
            contents.append(content[taken:])
            texts.append((raw[offsets[taken]:], offsets[taken:]))
            waiting += int(offsets[-1] - offsets[taken])
    if (done := flush()) is not None:
        yield done


def removed_spans(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs of bytes from packed (first string, number of strings): starts and ends."""
    first = np.sort(found)
    start, end = first >> _COUNT_BITS, (first >> _COUNT_BITS) + (first & ((1 << _COUNT_BITS) - 1)) + LENGTH - 1
    reach = np.maximum.accumulate(end) if len(end) else end
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return start[at], reach[np.r_[at[1:] - 1, len(start) - 1]] if len(at) else reach


def without_repeats(documents: DataFrame, kept: str = "kept", spans: str = "n_spans", removed: str = "n_removed") -> DataFrame:
    """``documents`` (doc_id, text, any others) with ``kept`` (binary), ``n_spans`` and ``n_removed`` (longs).

    Each byte of a text's UTF-8 form that lies in a string of LENGTH bytes which also starts elsewhere, in the same or
    another document, is removed.  Strings never cross documents and are judged on the input.  Null counts as empty; texts
    shorter than LENGTH stay as they are.  Repeated rows are documents of their own, so each loses whatever the other has.
    Columns of ``documents`` called like the new ones are kept with a leading underscore.
    """
    for name in (kept, spans, removed):
        for have in [c for c in documents.columns if c.lower() == name.lower()]:
            documents = documents.withColumnRenamed(have, free_name(documents, f"_{name}"))
    small_batches(documents.sparkSession)
    work = Workspace(documents.sparkSession, "suffixes")
    key = F.xxhash64("doc_id", "text")
    texts = documents.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.mapInArrow(_regions, "key long, anchor long, content long, place long")
    found = work.store("regions", found)
    # Counted with map-side aggregation and joined back, so that a very common anchor is split as a skewed join is.
    buckets = found.groupBy("anchor").agg(F.count("*").alias("regions"), (F.min("content") != F.max("content")).alias("mixed")).where("regions > 1")
    hot = (F.col("mixed") & (F.col("regions") > HOT_REGIONS)).alias("hot")
    shared = work.store("shared", found.join(buckets, "anchor").select("key", "anchor", "content", "place", "mixed", hot))
    work.drop("regions")
    distinct = work.store("distinct", shared.where("mixed").groupBy("anchor", "content").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "place")).alias("one"), F.max("hot").alias("hot")))

    def wanted(which: DataFrame) -> DataFrame:
        lists = which.groupBy("one.key").agg(F.collect_list(F.struct("one.place", "anchor", "content")).alias("wanted"))
        return texts.join(lists, "key").select("text", "wanted")

    cut = wanted(distinct.where(~F.col("hot"))).mapInArrow(_cut_out, "anchor long, content long, bytes binary")
    partitions = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (cut.repartition(partitions, "anchor").sortWithinPartitions("anchor", "content")
            .mapInArrow(_sort_buckets, "anchor long, content long, runs array<long>"))
    if distinct.where("hot").take(1):
        # Equal strings of one bucket stand in different regions, so two contents tell them whatever rows are repeated.
        strings = work.store("strings", wanted(distinct.where("hot")).mapInArrow(_strings, "anchor long, content long, string long, run long"))
        several = strings.groupBy("string").agg((F.min("content") != F.max("content")).alias("several")).where("several").select("string")
        runs = runs.unionByName(strings.join(several, "string").groupBy("anchor", "content").agg(F.collect_set("run").alias("runs")))
    settled = work.store("settled", distinct.select("anchor", "content", "copies").join(runs, ["anchor", "content"], "left"))
    work.drop("distinct")
    whole = F.array("place")
    inside = F.transform("runs", lambda r: F.col("place") - F.col("place").bitwiseAND(F.lit((1 << _COUNT_BITS) - 1)) + r)
    spans_of = (shared.where(~F.col("mixed")).select("key", whole.alias("found")).unionByName(
        shared.where("mixed").join(settled, ["anchor", "content"]).select("key", F.when(F.col("copies") > 1, whole).otherwise(inside).alias("found"))
        .where(F.col("found").isNotNull()))
        .groupBy("key").agg(F.flatten(F.collect_list("found")).alias("found")))
    own_key, found_name = free_name(documents, "_suffix_key"), free_name(documents, "_suffix_found")
    joined = documents.withColumn(own_key, key).join(spans_of.withColumnsRenamed({"key": own_key, "found": found_name}), own_key, "left").drop(own_key)
    columns = documents.columns

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                raw, offsets = buffers(part.column("text"))
                lists = part.column(found_name)
                where = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)
                keep, n_spans = np.ones(len(raw) + 1, np.int64), np.zeros(part.num_rows, np.int64)
                change = np.zeros(len(raw) + 1, np.int64)
                for i in np.flatnonzero(np.diff(where)):
                    start, end = removed_spans(values[where[i]:where[i + 1]])
                    n_spans[i] = len(start)
                    change[offsets[i] + start] += 1
                    change[offsets[i] + end] -= 1
                keep = np.cumsum(change)[:-1] == 0
                before = np.r_[0, np.cumsum(keep)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), binary_column(raw[keep], before[offsets]), pa.array(n_spans),
                     pa.array(np.diff(offsets) - np.diff(before[offsets]))], [*columns, "kept_", "spans_", "removed_"])

    return joined.select(*[f"`{c}`" for c in columns], found_name).mapInArrow(remove, StructType(
        [*documents.schema.fields, StructField(kept, BinaryType()), StructField(spans, LongType()), StructField(removed, LongType())]))
