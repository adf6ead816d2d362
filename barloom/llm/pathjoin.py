"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles.  In each run every set is split on the shingles that the run's hash samples from it,
about 1 / SIMILARITY of them; sets that sampled a common shingle meet in a bucket, and a bucket that is too large is split
again, on shingles sampled for its path.  Small buckets, and whatever is left after LEVELS splits, are searched by brute
force on signatures.  A pair at the threshold meets in one run with a chance known from the branching process, and runs are
repeated until TARGET_RECALL.

What the buckets link are candidates.  Their connected groups are then compared exactly, shingle set by shingle set, in
blocks of bounded size, which gives every link inside a group, also one that no bucket had.  Copies (equal shingle sets)
are one node throughout; pairs are counted and joined into classes, never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.textops import binary_column, buffers, mix, ragged, slices, windows, words
from barloom.llm.work import Workspace, free_name, small_batches

SHINGLE_WORDS = 5
SIMILARITY = 0.8
LEVELS = 3
SMALL_BUCKET = 32
TARGET_RECALL = 0.99999
SIGNATURE = 64
#: Least share of equal signature places that makes a candidate: five deviations below SIMILARITY.
LEAST_AGREEMENT = 0.55
BLOCK = 192  # sets of a group that are compared with as many others in one task
WANTED_BUCKETS = 1 << 20
TEXT_BYTES = 256 << 10  # bytes of text described at a time
TOKENS_AT_ONCE = 1 << 18  # shingles of paths that are sampled at a time; the arrays take some 50 bytes for each
_ODD = np.random.default_rng(31).integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = 2.0**64


def runs_needed(similarity: float = SIMILARITY, levels: int = LEVELS, target: float = TARGET_RECALL) -> int:
    """Runs after which a pair at the threshold has met with the target chance.

    Common sampled shingles are Poisson with mean one at every split, so the chance to share a path of length d + 1 is
    1 - exp(-q), q being that of length d.
    """
    chance = 1.0
    for _ in range(levels):
        chance = 1 - math.exp(-chance)
    return math.ceil(math.log(1 - target) / math.log(1 - chance))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document, sorted, and the offsets of documents among them.

    A text of one to four words has one shingle of all its words.
    """
    hashes, doc, _, _ = words(raw, offsets)
    value, of, _ = windows(hashes, doc, SHINGLE_WORDS)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    value, of = value[new], of[new]
    return value, np.searchsorted(of, np.arange(len(offsets)))


def sampled(tokens: np.ndarray, at: np.ndarray, owner: np.ndarray, path: np.ndarray, factor: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Next steps of paths: for each (owner set, path) the shingles whose hash under the path is small enough.

    Gives the place of the path and the new path.
    """
    size = np.diff(at)[owner]
    limit = np.minimum(_TOP / (SIMILARITY * np.maximum(size, 1)), _TOP * (1 - 2.0**-53)).astype(np.uint64)
    part = (np.cumsum(size) - size) // TOKENS_AT_ONCE
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(size)]
    found, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        which = np.repeat(np.arange(a, b), size[a:b])
        token = tokens[ragged(at[owner[a:b]], size[a:b])]
        hit = np.flatnonzero((token ^ path[which]) * factor < limit[which])
        found.append(which[hit])
        hits.append(token[hit])
    which = np.concatenate(found)
    return which, mix(path[which] * np.uint64(0x9E3779B97F4A7C15) + np.concatenate(hits))


def paths(tokens: np.ndarray, at: np.ndarray, docs: np.ndarray, runs: int):
    """First steps of the sets ``docs`` in all runs, with what may follow: set, path, packed later steps.

    Later steps of a path are packed as the next path, how many follow it, and those.
    """
    owner = np.repeat(docs, runs)
    root = mix(np.tile(np.arange(1, runs + 1, dtype=np.uint64), len(docs)) * _ODD[500])
    which, first = sampled(tokens, at, owner, root, _ODD[0])
    owner = owner[which]
    up2, second = sampled(tokens, at, owner, first, _ODD[1])
    up3, third = sampled(tokens, at, owner[up2], second, _ODD[2])
    n3 = np.bincount(up3, minlength=len(second))
    width = 2 + n3
    end = np.r_[0, np.cumsum(width)]
    packed = np.zeros(end[-1], np.uint64)
    packed[end[:-1]], packed[end[:-1] + 1] = second, n3
    packed[ragged(end[:-1] + 2, n3)] = third
    bounds = end[np.searchsorted(up2, np.arange(len(first) + 1))]
    return owner, first, packed, bounds


def signatures(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One byte for each of SIGNATURE least hashes, of sets that are not empty."""
    out = np.zeros((len(at) - 1, SIGNATURE), np.uint8)
    for k in range(SIGNATURE):
        least = np.minimum.reduceat(tokens * _ODD[8 + k], at[:-1]) if len(at) > 1 else np.zeros(0, np.uint64)
        out[:, k] = (least * _ODD[501]) >> np.uint64(56)
    return out


def _describe(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                tokens, at = shingle_sets(*buffers(part.column("text")))
                size = np.diff(at)
                full = np.flatnonzero(size)
                sums = np.zeros(len(size), np.uint64)
                if len(full):
                    sums[full] = mix(np.add.reduceat(mix(tokens ^ _ODD[502]), at[full])) ^ mix(size[full].astype(np.uint64))
                # Copies that this task has met need no paths.
                own = []
                for i, s in zip(full.tolist(), sums[full].tolist(), strict=True):
                    if s not in seen:
                        own.append(i)
                        seen.add(s)
                if len(seen) > 1_000_000:
                    seen.clear()
                own = np.array(own, np.int64)
                owner, first, packed, bounds = paths(tokens, at, own, runs)
                dense = np.r_[0, np.cumsum(size[own])]
                mark = np.zeros((len(size), SIGNATURE), np.uint8)
                if len(own):
                    mark[own] = signatures(tokens[ragged(at[own], size[own])], dense)
                count = np.bincount(owner, minlength=len(size))
                ends = np.r_[0, np.cumsum(count)]
                marks = np.zeros(len(size) + 1, np.int64)
                chosen = np.zeros(len(size), bool)
                chosen[own] = True
                marks[1:] = np.cumsum(chosen * SIGNATURE)
                steps = pa.StructArray.from_arrays([pa.array(first.view(np.int64)), binary_column(packed, bounds)], ["path", "later"])
                yield pa.RecordBatch.from_arrays([
                    part.column("key"), pa.array(sums.view(np.int64), mask=size == 0), pa.array(size),
                    binary_column(mark[chosen].ravel(), marks), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps)],
                    ["key", "node", "size", "signature", "steps"])
    return run


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Next paths of the rows of large buckets."""
    for batch in batches:
        nodes, path, later = [], [], []
        for node, data in zip(batch.column("node").to_pylist(), batch.column("later").to_pylist(), strict=True):
            steps, i = np.frombuffer(data, np.uint64), 0
            while i < len(steps):
                n = int(steps[i + 1])
                nodes.append(node)
                path.append(steps[i])
                # The last steps have no more of their own.
                later.append(np.stack([steps[i + 2:i + 2 + n], np.zeros(n, np.uint64)], axis=1).tobytes())
                i += 2 + n
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(np.array(path, np.uint64).view(np.int64)), pa.array(later, pa.binary())], ["node", "path", "later"])


def _spanning(pairs: np.ndarray) -> list[int]:
    """Positions of pairs that join what was apart."""
    parent: dict[int, int] = {}
    out = []
    for i, (a, b) in enumerate(pairs.tolist()):
        while (p := parent.get(a, a)) != a:
            a = p
        while (p := parent.get(b, b)) != b:
            b = p
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append(i)
    return out


def _large(node: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Candidate pairs that span one large bucket's groups; sets already in one group are not compared again."""
    n = len(node)
    group, out = np.arange(n), []
    for i in range(n):
        other = np.flatnonzero(group != group[i])
        other = other[other > i]
        if not len(other):
            continue
        alike = ((mark[other] == mark[i]).mean(axis=1) >= LEAST_AGREEMENT) & _sizes_fit(size[other], size[i])
        for j in other[alike].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((node[i], node[j]))
    return np.array(out, np.int64).reshape(-1, 2)


def _sizes_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) >= SIMILARITY * np.maximum(a, b) - 1e-9


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and node: candidate pairs that span the groups of each bucket."""
    held: list[tuple] = []

    def found(rows: list[tuple]) -> pa.RecordBatch | None:
        path, node, size, mark = (np.concatenate(x) for x in zip(*rows, strict=True))
        once = np.ones(len(path), bool)
        once[1:] = (path[1:] != path[:-1]) | (node[1:] != node[:-1])
        path, node, size, mark = path[once], node[once], size[once], mark[once]
        begin = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
        count = np.diff(np.r_[begin, len(path)])
        out = [_large(node[b:b + n], size[b:b + n], mark[b:b + n]) for b, n in zip(begin, count, strict=True) if n > SMALL_BUCKET]
        small = (count > 1) & (count <= SMALL_BUCKET)
        begin, count = begin[small], count[small]
        if len(begin):
            # All pairs of the small buckets: each place with those behind it.
            at = ragged(begin, count)
            behind = np.repeat(begin + count, count) - at - 1
            a, b = np.repeat(at, behind), ragged(at + 1, behind)
            fit = _sizes_fit(size[a], size[b])
            a, b = a[fit], b[fit]
            same = np.concatenate([(mark[a[i:i + 65536]] == mark[b[i:i + 65536]]).mean(axis=1) >= LEAST_AGREEMENT
                                   for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
            out.append(np.stack([node[a[same]], node[b[same]]], axis=1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        pairs = pairs[_spanning(pairs)]
        return pa.RecordBatch.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1]}) if len(pairs) else None

    for batch in batches:
        path, node, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "node", "size"))
        mark = buffers(batch.column("signature"))[0].reshape(-1, SIGNATURE)
        last = np.flatnonzero(path != path[-1])[-1] + 1 if len(path) and path[0] != path[-1] else 0
        if last:
            held.append((path[:last], node[:last], size[:last], mark[:last]))
            if (done := found(held)) is not None:
                yield done
            held = []
        held.append((path[last:], node[last:], size[last:], mark[last:]))
    if held and (done := found(held)) is not None:
        yield done


def compare_block(tokens: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which sets (rows: left, columns: right) have SIMILARITY or more; exact."""
    n, size = len(at) - 1, np.diff(at)
    _, column, times = np.unique(tokens, return_inverse=True, return_counts=True)
    common = times[column] > 1
    owner = np.repeat(np.arange(n), size)[common]
    used, column = np.unique(column[common], return_inverse=True)
    both = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // max(n, 1))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, len(used), step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, min(step, len(used) - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    both = both[np.ix_(left, right)].astype(np.float64)
    union = size[left][:, None] + size[right][None, :] - both
    return both >= SIMILARITY * union - 1e-9


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell: exact links between the sets of a cell's blocks, counted per set, and spanning links."""
    cell, rows = None, []

    def found(cell: tuple, rows: list[tuple]) -> pa.RecordBatch | None:
        _, one, two = cell
        texts = pa.array([r[3] for r in rows], pa.string())
        tokens, at = shingle_sets(*buffers(texts))
        block = np.array([r[1] for r in rows])
        node, copies = np.array([r[0] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        linked = compare_block(tokens, at, left, right)
        if one == two:
            np.fill_diagonal(linked, False)
        links = np.zeros(len(rows), np.int64)
        links[left] += linked @ copies[right]
        if one != two:
            links[right] += copies[left] @ linked
        i, j = np.nonzero(np.triu(linked) if one == two else linked)
        pairs = np.stack([node[left[i]], node[right[j]]], axis=1)
        pairs = pairs[_spanning(pairs)]
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_pydict({
            "node": np.r_[node[some], pairs[:, 0]], "links": np.r_[links[some], np.zeros(len(pairs), np.int64)],
            "other": pa.array(np.r_[np.zeros(len(some), np.int64), pairs[:, 1]], mask=np.r_[np.ones(len(some), bool), np.zeros(len(pairs), bool)])})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("root", "one", "two", "node", "block", "copies", "text")]
        for root, one, two, *row in zip(*columns, strict=True):
            if (root, one, two) != cell:
                if cell is not None and (done := found(cell, rows)) is not None:
                    yield done
                cell, rows = (root, one, two), []
            if not rows or rows[-1][0] != row[0]:
                rows.append(tuple(row))
    if cell is not None and (done := found(cell, rows)) is not None:
        yield done


def near_duplicates(documents: DataFrame) -> DataFrame:
    """A row per document: key, class_key, doc_id, class_id, n_links, class_size.

    Two documents are linked if their sets of SHINGLE_WORDS-word shingles (words: digits, letters, everything beyond
    ASCII; A-Z lower-cased) have a Jaccard similarity of SIMILARITY or more; classes are the connected groups.
    ``n_links`` counts the other documents linked to this one, copies included; ``class_id`` is the least doc_id of the
    class.  A text of one to four words has one shingle.  A text without words (null, empty, signs only) is linked to
    none and has a class of its own.  ``key`` is a hash of doc_id and text; equal rows share it.  ``class_key`` tells
    classes apart even where ids are null or repeated.  Null ids are allowed; a
    class of null ids alone has a null id.  Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    work = Workspace(spark, "pathjoin")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    described = work.store("sets", keyed.select("key", "text").mapInArrow(
        _describe(runs_needed()), "key long, node long, size long, signature binary, steps array<struct<path:long,later:binary>>"))
    bucket = Window.partitionBy("path")
    level = described.where("node is not null").select("node", F.explode("steps").alias("s")).select("node", "s.path", "s.later")
    leaves = []
    for depth in range(LEVELS):
        counted = work.store(f"level-{depth}", level.withColumn("n", F.count("*").over(bucket)).where("n > 1"))
        last = depth == LEVELS - 1
        leaves.append((counted if last else counted.where(F.col("n") <= SMALL_BUCKET)).select("path", "node"))
        if not last:
            level = counted.where(F.col("n") > SMALL_BUCKET).select("node", "later").mapInArrow(_later, "node long, path long, later binary")
    marks = described.where(F.octet_length("signature") > 0).groupBy("node").agg(F.first("size").alias("size"), F.first("signature").alias("signature"))
    all_leaves = leaves[0]
    for more in leaves[1:]:
        all_leaves = all_leaves.unionByName(more)
    candidates = (all_leaves.join(marks, "node").repartition(partitions, "path").sortWithinPartitions("path", "node")
                  .mapInArrow(_search, "a long, b long"))
    group = components(candidates, work, "candidates")
    groups = work.store("groups", group.unionByName(group.select(F.col("root").alias("node"), "root").distinct())
                        .join(described.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.min("key").alias("key")), "node")
                        .withColumn("block", ((F.row_number().over(Window.partitionBy("root").orderBy("node")) - 1) / BLOCK).cast("int")))
    blocks = groups.groupBy("root").agg((F.max("block") + 1).alias("blocks"))
    # Few texts are wanted while the corpus is small: a table of key remainders, WANTED_BUCKETS rows at most, sifts them
    # before the shuffle.  The join that follows is the same at every size.
    bucket_of = F.pmod(F.col("key"), F.lit(WANTED_BUCKETS)).alias("part")
    wanted = groups.select(bucket_of).distinct()
    texts = keyed.select("key", "text", bucket_of).join(F.broadcast(wanted), "part", "left_semi").drop("part")
    cells = (texts.join(groups.join(blocks, "root").hint("merge"), "key")
             .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("root", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "node", "block", "copies", "text"))
    verified = work.store("verified", cells.repartition(partitions, "root", "one", "two").sortWithinPartitions("root", "one", "two", "node")
                          .mapInArrow(_verify, "node long, links long, other long"))
    classes = components(verified.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")), work, "classes")
    links = verified.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    rows = keyed.select("key", "doc_id").join(described.select("key", "node").distinct(), "key")
    rows = work.store("rows", rows.join(classes, "node", "left").join(links, "node", "left")
                      .withColumn("class", F.coalesce("root", "node")).drop("root"))
    for name in ("sets", *(f"level-{depth}" for depth in range(LEVELS)), "groups", "verified"):
        work.drop(name)  # what follows reads the rows alone
    # Counts of copies and classes combine before the shuffle.
    copies = rows.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"))
    sizes = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    lone = rows.where("class is null").select("key", F.col("key").alias("class_key"), "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"))
    return (rows.where("class is not null").join(copies, "node").join(sizes, "class")
            .select("key", F.col("class").alias("class_key"), "doc_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "class_size")).unionByName(lone)


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents with one of each class kept: the one with the least doc_id (null last), then the least key.

    All columns stay as they are.  Of equal rows (same id and text) one is kept.
    """
    key = free_name(documents, "_path_key")
    found = near_duplicates(documents)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("one")
    kept = found.groupBy("class_key").agg(first).select(F.col("one.key").alias(key))
    keyed = documents.withColumn(key, F.xxhash64("doc_id", "text")).join(kept, key, "left_semi")
    return keyed.dropDuplicates([key]).drop(key)
