"""Repair of conversations: the cheapest edits that make roles alternate, by Viterbi over chunks that run side by side.

A row is kept, given another role or deleted, and empty rows are inserted, so that the initials of the roles read
``(s?(ua)+)?``.  The machine has four states: nothing kept yet, after a system row, after a user row, after an assistant
row.  Costs to go are vectors over the states, taken from the end of a conversation to its start.  A conversation is cut
into chunks that all start at once from a guessed vector; fix-up passes run a chunk again from what its successor really
gives, until the new vector differs from the old one by a constant only: from there on nothing else changes.  Chunks are
dealt to ever longer runs of neighbours, so that the passes grow with the logarithm of their number even where vectors
never converge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.work import Workspace

CHUNK_BITS = 12  # rows of a chunk: 4,096 at most
FAN = 16  # chunks of a run in the first fix-up pass; each pass takes runs so many times as long
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1

#: Symbols: the role's initial, plus bits for a truncated row and for one that must go.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
TRUNCATED, FORCED = 4, 8
#: States: nothing kept, after system, after user, after assistant.  The state after a user or assistant row that fits:
FITS = (2, 2, 3, 2)
KEPT = ({}, {0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
TERMINAL = (0, 2 * INSERT_COST, INSERT_COST, 0)
WHITE_SPACE = " \t\n\x0b\x0c\r"
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


@cache
def step(after: tuple[int, ...], symbol: int) -> tuple[tuple[int, ...], int]:
    """The costs to go before a row from those after it, less their minimum, and that minimum."""
    if symbol & FORCED:
        return after, DELETE_COST
    extra = TRUNCATED_COST if symbol & TRUNCATED else 0
    keep, found = KEPT[symbol & 3], []
    for s in range(4):
        ways = [DELETE_COST + after[s], REROLE_COST + extra + after[FITS[s]]]
        if s in keep:
            ways.append(extra + after[keep[s]])
        found.append(min(ways))
    for _ in range(3):
        found = [min(x, INSERT_COST + found[FITS[s]]) for s, x in enumerate(found)]
    least = min(found)
    return tuple(x - least for x in found), least


def copies_cost(copies: list[int]) -> int:
    """Further copies of a row stand behind it and must go."""
    return DELETE_COST * sum(n - 1 for n in copies)


def backward(symbols: list[int], end: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before a chunk and its cost, for the vector behind it."""
    cost = 0
    for symbol in reversed(symbols):
        end, more = step(end, symbol)
        cost += more
    return end, cost


def rerun(symbols: list[int], new: tuple[int, ...], old: tuple[int, ...], start: tuple[int, ...], cost: int) -> tuple[tuple[int, ...], int]:
    """``backward`` from another vector; it stops where both runs differ only by a constant."""
    gained = 0
    for symbol in reversed(symbols):
        if new == old:
            return start, cost + gained
        new, a = step(new, symbol)
        old, b = step(old, symbol)
        gained += a - b
    return new, cost + gained


class Trace(NamedTuple):
    state: int  # after the chunk
    edits: str  # one for each row
    inserts: list[str]  # initials of the rows put before each row
    states: list[int]  # after each row


def forward(symbols: list[int], end: tuple[int, ...], state: int) -> Trace:
    """The cheapest edits of a chunk from a state, the least in ASCII order: at each place D before I before K before R."""
    vectors = [(end, 0)]
    for symbol in reversed(symbols):
        vectors.append(step(vectors[-1][0], symbol))
    vectors.reverse()
    edits, inserts, states = [], [], []
    for i, symbol in enumerate(symbols):
        (now, least), (after, _) = vectors[i], vectors[i + 1]
        extra, keep, put = TRUNCATED_COST if symbol & TRUNCATED else 0, KEPT[symbol & 3], ""
        while True:
            left = least + now[state]
            if DELETE_COST + after[state] == left:
                edits.append(DELETE)
                break
            if INSERT_COST + now[FITS[state]] == now[state]:
                state = FITS[state]
                put += " sua"[state]
                continue
            if state in keep and extra + after[keep[state]] == left:
                edits.append(KEEP)
                state = keep[state]
                break
            edits.append(REROLE)
            state = FITS[state]
            break
        inserts.append(put)
        states.append(state)
    return Trace(state, "".join(edits), inserts, states)


def closing(state: int) -> str:
    """Initials of the rows that a conversation still needs at its end."""
    return ("", "ua", "a", "")[state]


def illegal_pairs(symbols: list[int], copies: list[int], previous: int | None) -> int:
    """Neighbours whose initials are none of su, ua, au; a copy never fits behind its row."""
    initials = [x & 3 for x in symbols]
    pairs = zip([*([] if previous is None else [previous & 3]), *initials[:-1]], initials if previous is not None else initials[1:], strict=True)
    return sum(p not in _LEGAL for p in pairs) + sum(n - 1 for n in copies)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for small in (batch.slice(k, 256) for k in range(0, batch.num_rows, 256)):
            yield from small.to_pylist()


def _sent(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    found = []
    for row in rows:
        found.append(row)
        if len(found) == size:
            yield pa.RecordBatch.from_pylist(found, schema)
            found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, schema)


_LONG, _INT, _TEXT = pa.int64(), pa.int32(), pa.string()
_VECTORS = pa.schema([("chunk", _LONG), ("end", pa.list_(_INT)), ("start", pa.list_(_INT)), ("cost", _LONG), ("changed", pa.bool_())])
VECTORS = "chunk long, end array<int>, start array<int>, cost long, changed boolean"


def _first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every chunk as if its conversation ended behind it: right for last chunks, a guess for all others."""
    def run():
        for r in _rows(batches):
            start, cost = backward(r["symbols"], TERMINAL)
            yield {"chunk": r["chunk"], "end": TERMINAL, "start": start, "cost": cost + copies_cost(r["copies"]), "changed": False}

    return _sent(run(), _VECTORS)


def _fix_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of neighbouring chunks, last chunk first: each is run again if its successor gives another vector than it had."""
    def run():
        successor, start = None, None
        for r in _rows(batches):
            old, had, cost = tuple(r["end"]), tuple(r["start"]), r["cost"]
            if r["next"] is None:
                new = TERMINAL
            else:
                new = start if r["next"] == successor else tuple(r["known"])
            start = had
            if new != old:
                start, cost = rerun(r["symbols"], new, old, had, cost)
            successor = r["chunk"]
            yield {"chunk": r["chunk"], "end": new, "start": start, "cost": cost, "changed": new != old}

    return _sent(run(), _VECTORS)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a chunk for each state before it."""
    def run():
        for r in _rows(batches):
            yield {"chunk": r["chunk"], "exits": [forward(r["symbols"], tuple(r["end"]), s).state for s in range(4)]}

    return _sent(run(), pa.schema([("chunk", _LONG), ("exits", pa.list_(_INT))]))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation one after another: the state before each."""
    def run():
        state = 0
        for r in _rows(batches):
            state = 0 if r["previous"] is None else state
            yield {"chunk": r["chunk"], "entry": state}
            state = r["exits"][state]

    return _sent(run(), pa.schema([("chunk", _LONG), ("entry", _INT)]), 4096)


_EDITS = pa.schema([("chunk", _LONG), ("audit", _TEXT), ("illegal", _LONG), ("at", pa.list_(_LONG)), ("edit", pa.list_(_TEXT)), ("put", pa.list_(_TEXT)), ("state", pa.list_(_INT))])
EDITS = "chunk long, audit string, illegal long, at array<long>, edit array<string>, put array<string>, state array<int>"


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run():
        for r in _rows(batches):
            found = forward(r["symbols"], tuple(r["end"]), r["entry"] or 0)
            audit = "".join(INSERT * len(p) + e + DELETE * (n - 1) for p, e, n in zip(found.inserts, found.edits, r["copies"], strict=True))
            at, edits, put, states = list(r["at"]), list(found.edits), found.inserts, found.states
            if r["next"] is None:  # rows behind the last one hang on its place, after it
                last = closing(found.state)
                audit += INSERT * len(last)
                at, edits, put, states = [*at, at[-1]], [*edits, ""], [*put, last], [*states, 0]
            yield {"chunk": r["chunk"], "audit": audit, "illegal": illegal_pairs(r["symbols"], r["copies"], r["before"]),
                   "at": at, "edit": edits, "put": put, "state": states}

    return _sent(run(), _EDITS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which come in order; a line is read once and not held."""
    def run():
        group, own, state = None, None, None
        for r in _rows(batches):
            if r["group"] != group:
                if own is not None:
                    yield {"first": own, "sha": state.hexdigest()}
                group, own, state = r["group"], r["at"], hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(r["line"].encode())
        if own is not None:
            yield {"first": own, "sha": state.hexdigest()}

    return _sent(run(), pa.schema([("first", _LONG), ("sha", _TEXT)]), 4096)


class Repaired(NamedTuple):
    """``rows``: conv_id, at, step, turn, role, text, edit in the order (at, step); ``conversations``: one row for each conv_id with rows."""

    rows: DataFrame
    conversations: DataFrame


def repair(df: DataFrame, work: Workspace, chunk_bits: int = CHUNK_BITS, fan: int = FAN) -> Repaired:
    """Repair every conversation of ``df`` (conv_id of any type, turn an integer, role, text); other columns are ignored.

    A null role or text counts as one space; null conversation ids are one conversation.  Rows are taken by turn (nulls
    first), then role and text, so repeated rows stand side by side.  A row's first fault counts: blank (white space only),
    duplicate (role and text stood earlier), truncated (the last character that is no white space is none of ``.!?``).
    Costs: keep 0, another role 2, delete 3, insert an empty user or assistant row 2, a truncated row that stays 1; blank
    and duplicate rows must go.  Of the cheapest edits those with the least string of initials (D, I, K, R) are taken.

    ``conversations``: conv_id, gaps (missing turns between the least and the greatest; null beyond 64 bits), blank,
    duplicate, truncated, illegal (neighbours other than system-user, user-assistant, assistant-user), cost, audit (the
    edits) and ``first``, the place of its first row.  ``rows`` are the repaired rows, those inserted with a null turn.  An empty table gives none of either.

    Equal rows are added up before any shuffle of their conversation, and a conversation's rows are spread over tasks by
    range, so none is ever one group; only summaries of its chunks (of up to 2**chunk_bits rows) meet in one task, in a
    stream.  The audit of a conversation is one string, as long as its rows and inserts.
    """
    spark = df.sparkSession
    space = F.lit(" ")
    stripped = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    equal = (df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
             .groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")))
    hashes = [F.xxhash64(F.lit(k), "conv_id", "role", "text").alias(f"key{k}") for k in (1, 2)]
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keyed = equal.select("*", *hashes)
    firsts = (keyed.groupBy("key1", "key2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
              .where("n > 1").select("key1", "key2", "first"))
    initial = F.substring("role", 1, 1)
    symbol = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    fault = (F.when(stripped == "", "blank").when(F.col("first").isNotNull() & (F.col("first") < place), "duplicate")
             .when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated"))
    order = ["conv_id", "turn", "role", "text"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = work.store("rows", keyed.join(firsts, ["key1", "key2"], "left").select(*order, "copies", fault.alias("fault"), symbol.alias("symbol"))
                      .repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))

    symbols = F.col("symbol") + F.when(F.col("fault").isin("blank", "duplicate"), FORCED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(0)
    entry = F.struct("at", symbols.cast("int").alias("symbol"), "copies")
    cut = rows.groupBy("conv_id", F.shiftright("at", chunk_bits).alias("block")).agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    cut = work.store("cut", cut.select("conv_id", F.col("rows.at").alias("at"), F.col("rows.symbol").alias("symbols"), F.col("rows.copies").alias("copies"),
                                       F.col("rows")[0]["at"].alias("chunk")))
    # From here on only a few numbers per chunk meet those of other chunks.
    along = Window.partitionBy("conv_id").orderBy(F.desc("chunk"))
    chain = (cut.select("conv_id", "chunk", F.element_at("symbols", -1).alias("last"))
             .select("chunk", (F.row_number().over(along) - 1).alias("place"), F.lag("chunk").over(along).alias("next"),
                     F.lead("chunk").over(along).alias("previous"), F.lead("last").over(along).alias("before")))
    chunks = work.store("chunks", cut.join(chain, "chunk"))
    vectors = work.store("vectors-0", chunks.mapInArrow(_first_run, VECTORS))
    several = chunks.where(F.col("next").isNotNull() | F.col("previous").isNotNull())
    longest = several.agg(F.max("place")).first()[0] or 0
    done, run = longest == 0, 1
    while not done:
        length = fan ** run
        given = vectors.select(F.col("chunk").alias("next"), F.col("start").alias("known"))
        task = [F.col("conv_id"), F.floor(F.col("place") / length).alias("run")]
        dealt = several.select("conv_id", "chunk", "place", "next", "symbols").join(vectors, "chunk").join(given, "next", "left")
        fixed = (dealt.select("*", task[1]).repartition(tasks, "conv_id", "run").sortWithinPartitions("conv_id", "run", "place")
                 .select("chunk", "next", "symbols", "end", "start", "cost", "known").mapInArrow(_fix_up, VECTORS))
        alone = vectors.join(several.select("chunk"), "chunk", "left_anti")
        vectors = work.store(f"vectors-{run}", fixed.unionByName(alone.withColumn("changed", F.lit(False))))
        done = length > longest or not vectors.where("changed").limit(1).count()
        run += 1

    joined = chunks.join(vectors.select("chunk", "end", "cost", "start"), "chunk")
    if longest:
        exits = several.select("chunk", "symbols").join(vectors.select("chunk", "end"), "chunk").mapInArrow(_exits, "chunk long, exits array<int>")
        entries = (exits.join(several.select("conv_id", "chunk", "previous"), "chunk").repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "chunk")
                   .select("chunk", "previous", "exits").mapInArrow(_entries, "chunk long, entry int"))
        joined = joined.join(entries, "chunk", "left")
    else:
        joined = joined.withColumn("entry", F.lit(0))
    edits = work.store("edits", joined.select("chunk", "at", "symbols", "copies", "next", "before", "end", "entry").mapInArrow(_traced, EDITS))

    each = edits.select(F.explode(F.arrays_zip("at", "edit", "put", "state")).alias("e")).select("e.*")
    kept = rows.join(each.where(F.col("edit").isin(KEEP, REROLE)).select("at", "edit", "state"), "at").select(
        "conv_id", "at", F.lit(2).alias("step"), "turn", F.when(F.col("edit") == KEEP, F.col("role")).when(F.col("state") == USER, "user").otherwise("assistant").alias("role"),
        "text", "edit")
    # Before a row come steps 0 and 1, behind the last one 3 and 4.
    put = (each.where(F.col("put") != "").select("at", F.when(F.col("edit") == "", 3).otherwise(0).alias("base"), F.posexplode(F.split("put", "")).alias("k", "initial"))
           .join(rows.select("at", "conv_id"), "at")
           .select("conv_id", "at", (F.col("base") + F.col("k")).alias("step"), F.lit(None).cast("long").alias("turn"),
                   F.when(F.col("initial") == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit(INSERT).alias("edit")))

    turns = (rows.where(F.col("turn").isNotNull()).select("conv_id", "turn").distinct().groupBy("conv_id")
             .agg(F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("*")).alias("gaps"), F.lit(True).alias("timed")))
    # Of a row with copies the first may be truncated; the others are duplicates, or blank like it.
    counts = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", F.col("copies")).otherwise(F.col("copies") - 1)).alias("duplicate"),
        F.count(F.when(F.col("fault") == "truncated", 1)).alias("truncated"), F.min("at").alias("first"))
    audits = joined.select("conv_id", "chunk", "cost", F.when(F.col("previous").isNull(), F.col("start")[0]).otherwise(0).alias("open")).join(
        edits.select("chunk", "audit", "illegal"), "chunk").groupBy("conv_id").agg(
        F.sum(F.col("cost") + F.col("open")).alias("cost"), F.sum("illegal").alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    # Conversations may have a null id, so their parts are grouped, not joined.
    parts = turns.unionByName(counts, allowMissingColumns=True).unionByName(audits, allowMissingColumns=True)
    conversations = parts.groupBy("conv_id").agg(
        F.when(F.max("timed"), F.max("gaps")).otherwise(F.lit(0)).cast("long").alias("gaps"),
        *[F.max(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.max("audit").alias("audit"), F.max("first").alias("first"))
    return Repaired(kept.unionByName(put), conversations)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's repaired ``role:text`` lines, joined by line ends.

    The hash takes a conversation's lines one after another: they pass one task, as a stream of constant memory.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # The id as text tells conversations apart whatever its type; the place finds the id again.
    group = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("group")
    lines = rows.select(group, "at", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    hashed = (lines.repartition(tasks, "group").sortWithinPartitions("group", "at", "step").select("group", "at", "line")
              .mapInArrow(_hashed, "first long, sha string"))
    ids = rows.groupBy("conv_id").agg(F.min("at").alias("first"))
    return hashed.join(ids, "first").select("conv_id", "sha")


def damaged(df: DataFrame) -> DataFrame:
    """Rows with faults planted by the checksum of ``conv_id:turn`` modulo 20; a null counts as one space, turns stay null.

    0: dropped; 1: text emptied; 2: its ``.!?`` removed; 3: the row twice; 4: role user.
    """
    space = F.lit(" ")
    named = F.concat(*[x for c in ("conv_id", "turn") for x in (F.lit(":"), F.coalesce(F.col(c).cast("string"), space))][1:])
    code = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    return (df.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where(F.col("code") != 0)
            .select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def audited(df: DataFrame, work: Workspace, **options: int) -> DataFrame:
    """A row per conversation of the undamaged ``df``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows, conversations = repair(damaged(df), work, **options)
    rows = work.store("repaired", rows)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = (df.select("conv_id").distinct().unionByName(conversations.select("conv_id", *numbers, "audit"), allowMissingColumns=True)
             .unionByName(digests(rows), allowMissingColumns=True))
    empty = hashlib.sha256().hexdigest()
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("sha"), F.lit(empty)).alias("repaired_sha256"))
