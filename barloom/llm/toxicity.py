"""Toxicity by a factorization machine over hashed terms.

Terms are the words of a text and their first four and five bytes, told apart by 64-bit hashes; a document has a term or
not.  The score is a logistic function of a bias, a weight per term and the inner products of all pairs of term vectors,
so that a pair (an insult with a group's name) can count for more or less than its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textops import ASCII_LOWER, ALNUM_BYTES, SpanHash, buffers, slices, spans
from barloom.llm.work import Workspace, free_name, small_batches

MAX_LABELLED = 20_000  # labelled rows that a fit uses at most: those with the smallest hash of their id
MAX_TERMS = 50_000  # terms kept at most: those that tell the classes apart most clearly
MIN_Z = 3.5  # least deviation of a kept term's class counts, in standard deviations
MIN_ROWS = 3
FACTORS = 8
EPOCHS = 30
PREFIXES = (4, 5)
TEXT_BYTES = 512 << 10  # bytes of text that are cut into terms at a time
THRESHOLD = 0.7


def batch_terms(raw: np.ndarray, offsets: np.ndarray):
    """Distinct words of a batch: terms of each (one column a kind, 0 where there is none), word and document of each place."""
    low = ASCII_LOWER[raw]
    starts, ends, doc = spans(low, offsets, ALNUM_BYTES)
    own = SpanHash(low)
    keys, first, place = np.unique(own.of(starts, ends), return_index=True, return_inverse=True)
    columns = [keys]
    for kind, size in enumerate(PREFIXES, start=1):
        a, b = starts[first], ends[first]
        columns.append(np.where(b - a > size, own.of(a, np.minimum(b, a + size)) ^ np.uint64(kind), np.uint64(0)))
    return np.stack(columns, axis=1) if len(keys) else np.zeros((0, 1 + len(PREFIXES)), np.uint64), place, doc


def document_terms(raw: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs in order; terms as hashes, or as places in the sorted array ``keep``."""
    table, place, doc = batch_terms(raw, offsets)
    if keep is None:
        value, wanted = table, table != 0
    else:
        value = np.searchsorted(keep, table).clip(0, max(len(keep) - 1, 0)) if len(keep) else np.zeros(table.shape, np.int64)
        wanted = (keep[value] == table) & (table != 0) if len(keep) else np.zeros(table.shape, bool)
    useful = wanted.any(axis=1)[place] if len(place) else np.zeros(0, bool)
    place, doc = place[useful], doc[useful]
    kept = wanted[place]
    docs, values = np.repeat(doc, kept.sum(axis=1)), value[place][kept]
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


class Machine:
    """A fitted factorization machine; plain arrays, bounded by MAX_TERMS."""

    def __init__(self, terms: np.ndarray, bias: float = 0.0):
        self.terms, self.bias = terms, bias
        self.weights = np.zeros(len(terms))
        self.vectors = np.random.default_rng(5).normal(0, 0.05, (len(terms), FACTORS))

    def parts(self, docs: np.ndarray, at: np.ndarray, n: int):
        """Linear sums, vector sums and active terms of n documents."""
        count = np.maximum(np.bincount(docs, minlength=n), 1)
        linear = np.bincount(docs, self.weights[at], n)
        sums = np.stack([np.bincount(docs, self.vectors[at, f], n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(docs, (self.vectors[at] ** 2).sum(axis=1), n)
        return linear, sums, squares, count

    def margins(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        linear, sums, squares, count = self.parts(docs, at, n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares) / np.sqrt(count)

    def score(self, docs: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(docs, at, n), -30, 30)))

    def fit(self, docs: np.ndarray, at: np.ndarray, labels: np.ndarray, batch: int = 256) -> Machine:
        """Mini-batches of logistic loss with step sizes that shrink by each parameter's past gradients."""
        n = len(labels)
        if not n or labels.min() == labels.max():
            share = (labels.sum() + 0.5) / (n + 1)
            self.bias = float(np.log(share / (1 - share)))
            return self
        bounds = np.searchsorted(docs, np.arange(n + 1))
        seen_w, seen_v, seen_b = np.full(len(self.terms), 1e-6), np.full(self.vectors.shape, 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for low in range(0, n, batch):
                chosen = order[low:low + batch]
                sizes = bounds[chosen + 1] - bounds[chosen]
                index = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in chosen])
                d, t = np.repeat(np.arange(len(chosen)), sizes), at[index]
                linear, sums, squares, count = self.parts(d, t, len(chosen))
                margin = self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares) / np.sqrt(count)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
                seen_b += error.sum() ** 2
                self.bias -= 0.3 * error.sum() / seen_b**0.5
                used, inside = np.unique(t, return_inverse=True)
                grad = np.bincount(inside, error[d], len(used)) + 1e-3 * self.weights[used]
                seen_w[used] += grad**2
                self.weights[used] -= 0.3 * grad / np.sqrt(seen_w[used])
                pair = (error / np.sqrt(count))[d][:, None] * (sums[d] - self.vectors[t])
                grad = np.stack([np.bincount(inside, pair[:, f], len(used)) for f in range(FACTORS)], axis=1) + 1e-2 * self.vectors[used]
                seen_v[used] += grad**2
                self.vectors[used] -= 0.05 * grad / np.sqrt(seen_v[used])
        return self


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", TEXT_BYTES):
            raw, offsets = buffers(part.column("text"))
            docs, terms = document_terms(raw, offsets)
            cuts = np.searchsorted(docs, np.arange(part.num_rows + 1))
            from barloom.llm.textops import binary_column
            yield pa.RecordBatch.from_arrays([part.column("order"), part.column("toxic"), binary_column(terms, cuts)], ["order", "toxic", "terms"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, offsets = buffers(batch.column("terms"))
        terms = np.frombuffer(flat.tobytes(), np.uint64)
        label = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), np.diff(offsets) // 8)
        keys, inside = np.unique(terms, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"term": keys.view(np.int64), "rows": np.bincount(inside, minlength=len(keys)),
                                          "toxic": np.bincount(inside, label, len(keys)).astype(np.int64)})


def fit(documents: DataFrame, labels: DataFrame) -> Machine:
    """Fit on labelled documents (doc_id, text with doc_id, toxic), at most MAX_LABELLED of them.

    Rows without a label or id are left out; of several labels of an id the larger counts.  Without labels, or with one
    class only, every text gets the smoothed share of label 1.
    """
    spark = documents.sparkSession
    small_batches(spark)
    work = Workspace(spark, "toxicity")
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
              .join(documents.select("doc_id").where(F.col("doc_id").isNotNull()).distinct(), "doc_id", "left_semi")
              .withColumn("order", order).orderBy("order", "doc_id").limit(MAX_LABELLED))
    sample = work.store("features", documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                        .join(F.broadcast(chosen), "doc_id").select("order", "toxic", "text").mapInArrow(_extract, "order long, toxic int, terms binary"))
    n, positive = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = positive / n if n else 0.0
    counts = sample.select("toxic", "terms").mapInArrow(_count, "term long, rows long, toxic long").groupBy("term").agg(F.sum("rows").alias("rows"), F.sum("toxic").alias("toxic"))
    spread = F.sqrt(F.col("rows") * max(share * (1 - share), 1e-9) + 0.5)
    kept = (counts.where(F.col("rows") >= MIN_ROWS).withColumn("z", F.abs(F.col("toxic") - F.col("rows") * share) / spread)
            .where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(MAX_TERMS).select("term").collect())
    terms = np.sort(np.array([r[0] for r in kept], np.int64).view(np.uint64)) if kept else np.zeros(0, np.uint64)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, label, docs, at, have = [], [], [], [], 0
        for batch in batches:
            flat, offsets = buffers(batch.column("terms"))
            found = np.frombuffer(flat.tobytes(), np.uint64)
            doc = have + np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 8)
            place = np.searchsorted(terms, found).clip(0, max(len(terms) - 1, 0))
            good = terms[place] == found if len(terms) else np.zeros(len(found), bool)
            docs.append(doc[good])
            at.append(place[good])
            keys.append(batch.column("order").to_numpy(zero_copy_only=False))
            label.append(batch.column("toxic").to_numpy(zero_copy_only=False))
            have += batch.num_rows
        if not have:
            return
        keys, label, docs, at = (np.concatenate(x) for x in (keys, label, docs, at))
        # One order whatever the arrival: by hash of the id, then by the terms themselves.
        digest = np.bincount(docs, at.astype(float) + 1, have)
        order = np.lexsort((digest, keys))
        rank = np.empty(have, np.int64)
        rank[order] = np.arange(have)
        again = np.lexsort((at, rank[docs]))
        own = Machine(terms).fit(rank[docs][again], at[again], label[order].astype(float))
        yield pa.RecordBatch.from_pydict({"bias": [own.bias], "weights": [own.weights.tobytes()], "vectors": [own.vectors.tobytes()]})

    # One task fits: its input is bounded by MAX_LABELLED rows and the kept terms.
    fitted = sample.repartition(1).mapInArrow(train, "bias double, weights binary, vectors binary").first()
    own = Machine(terms)
    if fitted is None:
        own.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    else:
        own.bias = fitted.bias
        own.weights = np.frombuffer(fitted.weights)
        own.vectors = np.frombuffer(fitted.vectors).reshape(len(terms), FACTORS)
    work.drop("features")
    return own


def with_score(df: DataFrame, machine: Machine, name: str = "score", text: str = "text") -> DataFrame:
    """``df`` with the score of each text (0 to 1).  A null or empty text scores by the bias alone; no shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    for have in [c for c in df.columns if c.lower() == name.lower()]:
        df = df.withColumnRenamed(have, free_name(df, f"_{name}"))
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(machine)  # at most MAX_TERMS x (2 + FACTORS) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, text, TEXT_BYTES):
                raw, offsets = buffers(part.column(text))
                docs, at = document_terms(raw, offsets, own.terms)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.score(docs, at, part.num_rows))], [*part.schema.names, "score_"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
