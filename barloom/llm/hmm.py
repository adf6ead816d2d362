"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by a scaled forward recursion.

Words are emitted through classes: the commonest training words are classes of their own, all rarer ones share classes by
hash, and words not met in training form one class.  Within its class a word keeps its unigram share, so the model is a
proper distribution over the same outcomes as the unigram base.

A recursion over a long text is cut into segments of ``SEGMENT`` tokens.  The transfer matrices of all segments of a
batch are computed in step, chained per document, and give each segment's exact boundary vectors; no approximation is
made and one very long text takes no more steps than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textops import NON_SPACE_BYTES, ASCII_LOWER, SpanHash, binary_column, buffers, mix, slices, spans
from barloom.llm.work import Workspace, free_name

STATES = 4
SEGMENT = 64
RESCALE = 8  # steps between rescalings
OWN_CLASSES = 1 << 15  # words with a class of their own
SHARED_CLASSES = 1 << 10  # classes of the other training words
KNOWN_WORDS = 200_000  # commonest words whose counts every task holds (16 bytes each); others are joined
ITERATIONS = 4
PRIOR = 10.0
#: Counts travel as whole multiples of this, so that sums do not depend on their order.
UNIT = 2.0**-20
END = np.uint64(0x51ED270B9F3A7C15)


def batch_tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each document's end included, and the offsets of documents among them."""
    low = ASCII_LOWER[raw]
    starts, ends, doc = spans(low, offsets, NON_SPACE_BYTES)
    n = len(offsets) - 1
    at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n) + 1)])
    out = np.full(int(at[-1]), END, np.uint64)
    out[np.arange(len(starts)) + doc] = SpanHash(low).of(starts, ends)
    return out, at


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted keys; -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.searchsorted(keys, wanted).clip(0, len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Words:
    """The common training words with their counts and classes, and what is needed for all others."""

    def __init__(self, keys, counts, classes, total, distinct, class_mass):
        self.keys, self.counts, self.classes = keys, counts, classes
        self.total, self.distinct, self.class_mass = total, distinct, class_mass

    @property
    def outcomes(self) -> float:
        return self.total + self.distinct + 1.0

    def counts_of(self, tokens: np.ndarray, extra: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Training count and class of each token; ``extra`` holds the rarer known words among them."""
        unique, inverse = np.unique(tokens, return_inverse=True)
        at = lookup(self.keys, unique)
        count = np.where(at >= 0, self.counts[at], 0) if len(self.keys) else np.zeros(len(unique), np.int64)
        kind = np.where(at >= 0, self.classes[at], -1) if len(self.keys) else np.full(len(unique), -1)
        if len(extra[0]):
            more = lookup(extra[0], unique)
            rare = (at < 0) & (more >= 0)
            count = np.where(rare, extra[1][more], count)
            kind = np.where(rare, shared_class(unique), kind)
        kind = np.where(kind < 0, unknown_class(), kind)
        return count[inverse], kind[inverse]


def shared_class(keys: np.ndarray) -> np.ndarray:
    return OWN_CLASSES + (mix(np.asarray(keys, np.uint64)) % np.uint64(SHARED_CLASSES)).astype(np.int64)


def unknown_class() -> int:
    return OWN_CLASSES + SHARED_CLASSES


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start, move, emit):
        self.start, self.move, self.emit = start, move, emit

    @staticmethod
    def initial(class_mass: np.ndarray, states: int = STATES) -> Model:
        """States that keep to themselves, each with its own random tilt of the class distribution."""
        rng = np.random.default_rng(2)
        tilt = np.exp(rng.normal(0, 1.0, (len(class_mass), states)))
        emit = class_mass[:, None] * tilt
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def from_counts(starts, moves, emits, class_mass) -> Model:
        """Expected counts to probabilities.

        A state's chance of a class is the unigram's times a tilt; PRIOR counts without a tilt are added to each class, so
        that rare classes keep near the unigram and one that training never met keeps to it.
        """
        start = (starts + 0.1) / (starts + 0.1).sum()
        move = (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True)
        share = (emits.sum(axis=0) + 1) / (emits.sum() + emits.shape[1])
        emit = class_mass[:, None] * (emits + PRIOR * share) / ((emits.sum(axis=1, keepdims=True) + PRIOR) * share)
        return Model(start, move, emit / emit.sum(axis=0))


class Passes:
    """Scaled forward and backward recursions over all documents of a batch at once.

    Segments stand in order of their size, so that those still running at a step are a leading slice.
    """

    def __init__(self, model: Model, classes: np.ndarray, at: np.ndarray):
        self.model, k = model, model.emit.shape[1]
        lengths = np.diff(at)
        pieces = -(-lengths // SEGMENT)
        self.first = np.concatenate([[0], np.cumsum(pieces)])  # a document's first segment, in text order
        n = int(self.first[-1])
        doc = np.repeat(np.arange(len(lengths)), pieces)
        offset = at[doc] + (np.arange(n) - self.first[doc]) * SEGMENT
        size = np.minimum(SEGMENT, at[doc + 1] - offset)
        order = np.argsort(-size, kind="stable")
        self.slot = np.empty(n, np.int64)  # where a segment in text order stands
        self.slot[order] = np.arange(n)
        self.running = np.searchsorted(-size[order], -np.arange(SEGMENT))  # segments longer than t
        self.running[0] = n
        place = np.minimum(offset[order][None, :] + np.arange(SEGMENT)[:, None], max(len(classes) - 1, 0))
        self.classes = classes[place]
        self.emitted = model.emit[self.classes]
        self.n, self.k = n, k

    def transfer(self) -> tuple[np.ndarray, np.ndarray]:
        """Each segment's product of move-and-emit matrices, scaled to one in its largest entry, and the log10 of the scale."""
        n, k, move = self.n, self.k, self.model.move
        out, logs = np.tile(np.eye(k), (n, 1, 1)), np.zeros(n)
        for t in range(SEGMENT):
            m = self.running[t]
            if not m:
                break
            new = (out[:m].reshape(-1, k) @ move).reshape(m, k, k)
            np.multiply(new, self.emitted[t, :m, None, :], out=out[:m])
            if t % RESCALE == RESCALE - 1:
                scale = out[:m].max(axis=(1, 2))
                out[:m] /= scale[:, None, None]
                logs[:m] += np.log10(scale)
        scale = out.max(axis=(1, 2))
        return out / scale[:, None, None], logs + np.log10(scale)

    def before(self, matrices: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state vector before each segment, and each document's log10 likelihood."""
        docs, count = len(self.first) - 1, np.diff(self.first)
        vectors, total = np.zeros((self.n, self.k)), np.zeros(docs)
        state = np.tile(self.model.start, (docs, 1))
        for j in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > j)
            segment = self.slot[self.first[on] + j]
            vectors[segment] = state[on]
            new = np.einsum("nk,nkl->nl", state[on], matrices[segment])
            scale = new.sum(axis=1)
            total[on] += np.log10(scale) + logs[segment]
            state[on] = new / scale[:, None]
        return vectors, total

    def after(self, matrices: np.ndarray) -> np.ndarray:
        """The backward vector behind each segment, scaled."""
        docs, count = len(self.first) - 1, np.diff(self.first)
        vectors, state = np.ones((self.n, self.k)), np.ones((docs, self.k))
        for j in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > j)
            segment = self.slot[self.first[on + 1] - 1 - j]
            vectors[segment] = state[on]
            new = np.einsum("nkl,nl->nk", matrices[segment], state[on])
            state[on] = new / new.max(axis=1, keepdims=True)
        return vectors

    def counts(self, n_classes: int):
        """Expected starts, moves and emissions, and the log10 likelihoods of the documents."""
        matrices, logs = self.transfer()
        begin, total = self.before(matrices, logs)
        back = self.after(matrices)
        move, k = self.model.move, self.k
        forward = np.zeros((SEGMENT + 1, self.n, k))
        forward[0] = begin
        for t in range(SEGMENT):
            m = self.running[t]
            new = (forward[t, :m] @ move) * self.emitted[t, :m]
            if t % RESCALE == RESCALE - 1:
                new /= new.sum(axis=1, keepdims=True)
            forward[t + 1, :m] = new
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((n_classes, k))
        for t in range(SEGMENT - 1, -1, -1):
            m = self.running[t]
            if not m:
                continue
            here = forward[t + 1, :m]
            here *= back[:m]
            here /= here.sum(axis=1, keepdims=True)  # chances of the states at this token
            ahead = self.emitted[t, :m] * back[:m]
            behind = ahead @ move.T
            weight = np.einsum("nk,nk->n", forward[t, :m], behind)
            moves += (forward[t, :m] / weight[:, None]).T @ ahead
            if t == 0:
                one = self.slot[self.first[:-1]]
                starts += (forward[0, one] * behind[one] / weight[one, None]).sum(axis=0)
            if t % RESCALE == 0:
                behind /= behind.max(axis=1, keepdims=True)
            back[:m] = behind
        live = np.arange(self.n) < self.running[:, None]
        flat = self.classes[live]
        for s in range(k):
            emits[:, s] = np.bincount(flat, forward[1:, :, s][live], n_classes)
        return starts, moves * move, emits, total


def is_held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def out():
        return pa.RecordBatch.from_pydict({"word": keys.view(np.int64), "count": sums})

    for batch in batches:
        for part in slices(batch, "text"):
            tokens, _ = batch_tokens(*buffers(part.column("text")))
            new, count = np.unique(tokens, return_counts=True)
            keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([sums, count]), len(keys)).astype(np.int64)
            if len(keys) > 500_000:
                yield out()
                keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(keys):
        yield out()


class LanguageModel:
    """Word counts and, after ``fit``, the hidden Markov model."""

    def __init__(self, work: Workspace, words: Words, counts: DataFrame, model: Model):
        self.work, self.words, self.counts, self.model = work, words, counts, model


def count_words(documents: DataFrame, known_words: int = KNOWN_WORDS) -> LanguageModel:
    """Word counts over all texts of ``documents`` (text), and the model before training.

    A null text counts as empty: one end.  Without any row every token is unknown and the model is the base.
    """
    spark = documents.sparkSession
    work = Workspace(spark, "hmm")
    texts = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = work.store("counts", texts.mapInArrow(_count_words, "word long, count long").groupBy("word").agg(F.sum("count").alias("count")))
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    head = counts.orderBy(F.desc("count"), "word").limit(known_words).toArrow()  # at most known_words rows of 16 bytes
    keys = head.column("word").to_numpy().view(np.uint64)
    own = np.arange(len(keys)) < OWN_CLASSES
    classes = np.where(own, np.arange(len(keys)), shared_class(keys)).astype(np.int32)
    number, outcomes = unknown_class() + 1, float(total + distinct + 1)
    mass = np.bincount(classes, head.column("count").to_numpy() + 1.0, number).astype(float)
    if distinct > len(keys):
        # The rest of the training words, summed by shared class: a row per class.
        head_words = spark.createDataFrame(head.select(["word"]).to_pandas())
        found = (counts.join(head_words, "word", "left_anti").mapInArrow(_class_mass, "class long, mass double")
                 .groupBy("class").agg(F.sum("mass").alias("mass")).collect())
        for r in found:
            mass[r["class"]] += r["mass"]
    mass[unknown_class()] = 1.0
    mass /= outcomes
    order = np.argsort(keys)
    words = Words(keys[order], head.column("count").to_numpy()[order], classes[order], int(total), int(distinct), mass)
    return LanguageModel(work, words, counts, Model.initial(np.maximum(mass, 1e-300)))


def _class_mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind = shared_class(batch.column("word").to_numpy().view(np.uint64))
        keys, inverse = np.unique(kind, return_inverse=True)
        yield pa.RecordBatch.from_pydict({"class": keys, "mass": np.bincount(inverse, batch.column("count").to_numpy() + 1.0, len(keys))})


def _with_rare_words(language: LanguageModel, documents: DataFrame) -> DataFrame:
    """``documents`` with lists of its rarer training words and of their counts.

    Null as long as the tasks hold all training words; else the words beyond are looked up by a shuffled join.
    """
    words = language.words
    if words.distinct <= len(words.keys):
        return documents.withColumn("_rare", F.lit(None).cast("array<long>")).withColumn("_rare_counts", F.lit(None).cast("array<long>"))
    shared = documents.sparkSession.sparkContext.broadcast(words.keys)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = batch_tokens(*buffers(part.column("text")))
                far = np.flatnonzero(lookup(shared.value, tokens) < 0)
                row = np.searchsorted(at, far, side="right") - 1
                key = part.column("_key").to_numpy(zero_copy_only=False)[row]
                both = np.unique(np.stack([key, tokens[far].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["_key", "word"])

    key = F.xxhash64("text")
    keyed = documents.withColumn("_key", key)
    wanted = keyed.select("_key", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(rare, "_key long, word long")
    found = (wanted.distinct().join(language.counts, "word").groupBy("_key")
             .agg(F.collect_list(F.struct("word", "count")).alias("_found")))

    # Plain lists that the tasks view without copies: rows of Python objects, or another Python step beside the one that
    # encodes, would take a multiple of their memory.
    lists = found.select("_key", F.col("_found.word").alias("_rare"), F.col("_found.count").alias("_rare_counts"))
    return keyed.join(lists, "_key", "left").drop("_key")


def _extra(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_rare", "_rare_counts"))
    keys = keys.astype(np.int64, copy=False).view(np.uint64)
    keys, first = np.unique(keys, return_index=True)
    return keys, counts[first]


def encode(df: DataFrame, language: LanguageModel) -> DataFrame:
    """``df`` without its text but with n_tokens, n_known, base_score, ``_inside`` and ``_classes``.

    ``_inside`` is the log10 chance of the words within their classes, ``_classes`` holds the class of each token.
    """
    from pyspark.sql.types import BinaryType, DoubleType, LongType, StructField, StructType

    columns = [c for c in df.columns if c != "text"]
    prepared = _with_rare_words(language, df).select(*[f"`{c}`" for c in columns], "text", "_rare", "_rare_counts")
    shared = df.sparkSession.sparkContext.broadcast(language.words)  # bounded by known_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        within = np.log10(words.class_mass)
        for batch in batches:
            for part in slices(batch, "text"):
                tokens, at = batch_tokens(*buffers(part.column("text")))
                count, classes = words.counts_of(tokens, _extra(part))
                chance = np.log10(count + 1) - np.log10(words.outcomes)
                sums = lambda x: np.add.reduceat(x, at[:-1]) if len(at) > 1 else x[:0]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-3], pa.array(np.diff(at)), pa.array(sums((count > 0).astype(np.int64))), pa.array(sums(chance)),
                     pa.array(sums(chance - within[classes])), binary_column(classes.astype("<u2"), at)], [*columns, *(f"c{i}_" for i in range(5))])

    fields = [StructField(n, t) for n, t in (("n_tokens", LongType()), ("n_known", LongType()), ("base_score", DoubleType()),
                                             ("_inside", DoubleType()), ("_classes", BinaryType()))]
    return prepared.mapInArrow(run, StructType([*(df.schema[c] for c in columns), *fields]))


def _class_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for part in slices(batch, "_classes", 256 << 10):
            flat, offsets = buffers(part.column("_classes"))
            yield part, np.frombuffer(flat.tobytes(), "<u2").astype(np.int64), offsets // 2


def fit(language: LanguageModel, encoded: DataFrame, iterations: int = ITERATIONS) -> None:
    """Rounds of Baum-Welch over all rows of ``encoded``."""
    if language.words.total:
        for _ in range(iterations):
            language.model = _improve(language, encoded)


def _improve(language: LanguageModel, encoded: DataFrame) -> Model:
    """One round of Baum-Welch: expected counts of all partitions, summed by class."""
    shared = encoded.sparkSession.sparkContext.broadcast(language.model)  # bounded by the classes and states
    number, k = len(language.words.class_mass), language.model.emit.shape[1]

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((number, k))
        for _, classes, at in _class_batches(batches):
            a, b, c, _ = Passes(model, classes, at).counts(number)
            starts, moves, emits = starts + a, moves + b, emits + c
        used = np.flatnonzero(emits.any(axis=1))
        whole = np.rint(np.concatenate([emits[used], moves, starts[None]]) / UNIT).astype(np.int64)
        labels = np.concatenate([used, -1 - np.arange(k), [-1 - k]])
        yield pa.RecordBatch.from_pydict({"class": labels, **{f"s{s}": whole[:, s] for s in range(k)}})

    schema = "class long, " + ", ".join(f"s{s} long" for s in range(k))
    summed = (encoded.select("_classes").mapInArrow(expect, schema)
              .groupBy("class").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(k)]).toArrow())  # a row per class
    labels = summed.column("class").to_numpy()
    values = np.stack([summed.column(f"s{s}").to_numpy() for s in range(k)], axis=1) * UNIT
    emits, moves = np.zeros((number, k)), np.zeros((k, k))
    emits[labels[labels >= 0]] = values[labels >= 0]
    for s in range(k):
        moves[s] = values[labels == -1 - s].sum(axis=0)
    return Model.from_counts(values[labels == -1 - k].sum(axis=0), moves, emits, language.words.class_mass)


def score(encoded: DataFrame, language: LanguageModel) -> DataFrame:
    """``encoded`` with ``score``, the log10 likelihood of each text, in place of its working columns."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    columns = [c for c in encoded.columns if c not in ("_inside", "_classes")]
    shared = encoded.sparkSession.sparkContext.broadcast(language.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, classes, at in _class_batches(batches):
            passes = Passes(shared.value, classes, at)
            _, likelihood = passes.before(*passes.transfer())
            inside = part.column("_inside").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(likelihood + inside)], [*columns, "score_"])

    return encoded.select(*[f"`{c}`" for c in columns], "_inside", "_classes").mapInArrow(
        run, StructType([*(encoded.schema[c] for c in columns), StructField("score", DoubleType())]))


def scored(documents: DataFrame, training, iterations: int = ITERATIONS, known_words: int = KNOWN_WORDS) -> tuple[DataFrame, LanguageModel]:
    """``documents`` without text but with n_tokens, n_known, base_score and score; and the model.

    The model learns from the rows where the column expression ``training`` holds.  A null or empty text is one end token;
    repeated rows are scored each; an empty table gives no rows.  Columns of ``documents`` called like the new ones are
    kept with a leading underscore.  Texts are read twice; the rounds of training read stored classes.  The model returned
    can score the stored classes only, as its full word counts are dropped.
    """
    mark = free_name(documents, "_training")
    df = documents.withColumn(mark, F.coalesce(training, F.lit(False)))
    for name in ("n_tokens", "n_known", "base_score", "score"):
        for have in [c for c in df.columns if c.lower() == name]:
            df = df.withColumnRenamed(have, free_name(df, f"_{name}"))
    language = count_words(df.where(mark), known_words)
    encoded = language.work.store("classes", encode(df, language))
    language.work.drop("counts")
    fit(language, encoded.where(mark), iterations)
    return score(encoded, language).drop(mark), language
