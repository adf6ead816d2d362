"""Benchmark decontamination by templates: windows of canonical words are hash-joined, then slots are checked.

Numbers (3, 3.5, 1,250), runs of names and units become typed placeholders, so a question with other numbers or names keeps
its template.  A document leaks an item where template windows that stand in it, at neighbouring relative positions, hold
enough of the item's words, with slot values that map one to one: the same number or name in the item is the same one in the
document, and the other way round.  Lower-cased windows without placeholders are joined beside them, so that exact copies do
not depend on capitals or on what stands before a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textops import ALNUM_BYTES, ASCII_LOWER, SpanHash, buffers, mix, slices, spans
from barloom.llm.work import Workspace, small_batches

WIDTH = 8  # words of a window
LEAST_LITERAL = 3  # of them, those that are literal; with fewer, numbers, names and units count by value
LEAST_SHARE = 0.5  # of an item's windows
LEAST_EVIDENCE = 3  # words, or edges of the sentence, line or text, that the copy of a very short item must have
NEAR_SHIFTS = 8  # relative positions that add up, so that words put in or left out do not part a copy
LONG_RUN = 24  # consecutive words of an item that are a leak whatever their share
TEXT_BYTES = 512 << 10  # bytes of text whose windows are made at a time
FILTER_WINDOWS = 4_000_000  # benchmark windows up to which their hashes (8 bytes each) sift the documents' windows early

#: Words that are units when they follow a number.
UNITS = ("mm cm m km mg g kg t ml l s ms min h hr hrs hour hours minute minutes second seconds day days week weeks month"
         " months year years meter meters metre metres mile miles foot feet inch inches gram grams liter liters litre litres"
         " percent dollar dollars euro euros cent cents usd eur gbp degree degrees").split()
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F3A5C7E9B2D4F61, 0x2E4B6D8FA1C3E507, 0x3D5F7A9CBED0F218))
_STEP, _EXACT, _PLAIN = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x5B7D9FA1C3E50719, 0x4C6E8A0B2D4F6183))
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[[ord(c) for c in ".!?\n:"]] = True
_POINT, _JOINS_NAMES = np.zeros(256, bool), np.zeros(256, bool)
_POINT[[ord(c) for c in ".,"]] = True
_JOINS_NAMES[[ord(c) for c in " \t\r-'"]] = True


def lower_case(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case, byte for byte."""
    low = ASCII_LOWER[raw]
    second = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    low[second] += 32
    return low


def templates(raw: np.ndarray, offsets: np.ndarray):
    """Canonical word hashes, slot values (0 for literal words), document and number of edges before and after every word; then the plain words so.

    Digit groups joined by one point or comma are one word, and so are names with nothing but white space, hyphens or
    apostrophes between them.
    """
    low = lower_case(raw)
    starts, ends, doc = spans(low, offsets, ALNUM_BYTES)
    own = SpanHash(low)
    value = own.of(starts, ends)
    if not len(starts):
        return [(value, value, doc, doc, doc)] * 2
    total = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    digits, capitals, stops = total((raw >= 48) & (raw < 58)), total((raw >= 65) & (raw < 91)), total(_SENTENCE_END[raw])
    number = digits[ends] - digits[starts] == ends - starts
    ascii_capital = (raw[starts] >= 65) & (raw[starts] < 91)
    second = raw[np.minimum(starts + 1, len(raw) - 1)]
    accented = (raw[starts] == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    capitalised = (ascii_capital & (capitals[ends] - capitals[starts] == 1)) | (accented & (capitals[ends] == capitals[starts]))
    opens = np.ones(len(starts), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    name = capitalised & ~opens & (ends - starts > 1)
    unit_raw = np.frombuffer("".join(UNITS).encode(), np.uint8)
    unit_at = np.concatenate([[0], np.cumsum([len(u) for u in UNITS])])
    unit = np.isin(value, SpanHash(unit_raw).of(unit_at[:-1], unit_at[1:]))
    unit[1:] &= number[:-1] & (doc[1:] == doc[:-1])
    unit[0] = False
    unit &= ~number
    name &= ~unit
    canonical = np.where(number, _NUMBER, np.where(name, _NAME, np.where(unit, _UNIT, value)))
    between, breaks = starts[1:] - ends[:-1], total(~_JOINS_NAMES[raw])
    one = doc[1:] == doc[:-1]
    follows = np.zeros(len(starts), bool)
    follows[1:] = one & number[1:] & number[:-1] & (between == 1) & _POINT[raw[ends[:-1].clip(0, len(raw) - 1)]]
    follows[1:] |= one & name[1:] & name[:-1] & (breaks[starts[1:]] == breaks[ends[:-1]])
    opens &= ~follows
    before, after = opens.astype(np.int64), np.append(opens[1:], True).astype(np.int64)
    plain = value, np.zeros(len(value), np.uint64), doc, before, after
    head = np.flatnonzero(~follows)
    tail = np.append(head[1:], len(starts)) - 1
    place = np.arange(len(starts)) - head[np.cumsum(~follows) - 1]
    value = np.add.reduceat(np.where(place == 0, value, mix(value + place.astype(np.uint64))), head)
    canonical, doc, literal = canonical[head], doc[head], ~(number | name | unit)[head]
    return [(canonical, np.where(literal, np.uint64(0), value | np.uint64(1)), doc, before[head], after[tail]), plain]


def template_windows(raw: np.ndarray, offsets: np.ndarray, widths: list[int], whole: bool):
    """Windows of the given widths: hash, document, first word, width, words of the document, whether plain, and slots of each of its words.

    With ``whole`` a document shorter than WIDTH words has one window of all its words and others have windows of WIDTH.
    Windows of fewer than LEAST_LITERAL literal words (all of them, in shorter windows) hold the slot values themselves in
    place of the placeholders, so only the same numbers and names meet there.
    """
    out, slots, behind = [tuple(np.zeros(0, t) for t in (np.uint64, *[np.int64] * 5, bool))], [], 0
    for is_plain, (canonical, slot, doc, before, after) in zip((False, True), templates(raw, offsets), strict=True):
        length = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, np.int64)
        begin = np.cumsum(length) - length
        by_value = np.where(slot == 0, canonical, slot)
        for width in widths:
            n = len(canonical) - width + 1
            if n <= 0 or width < 1:
                continue
            first = np.flatnonzero(doc[:n] == doc[width - 1:])
            if whole:
                first = first[length[doc[first]] == width] if width < WIDTH else first
            if width < LEAST_EVIDENCE:
                first = first[width + before[first] + after[first + width - 1] >= LEAST_EVIDENCE]
            total, exact, literal = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
            for k in range(width):
                total = total * _STEP + canonical[k:k + n]
                if not is_plain:
                    exact = exact * _STEP + by_value[k:k + n]
                    literal += slot[k:k + n] == 0
            total = total + _PLAIN if is_plain else np.where(literal >= min(LEAST_LITERAL, width), total, exact + _EXACT)
            of = doc[first]
            out.append((mix(total[first] + np.uint64(width)), of, first - begin[of], np.full(len(first), width), length[of], first + behind,
                        np.full(len(first), is_plain)))
        slots.append(slot)
        behind += len(slot)
    hashes, of, at, width, length, first, plain = (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, of, at, width, length, plain, first, np.concatenate(slots)


def _windows_of(column: str, widths: list[int], whole: bool, keep=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = keep.value if keep is not None else None
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                hashes, of, at, width, length, plain, first, slot = template_windows(*buffers(part.column("text")), widths, whole)
                if wanted is not None:
                    place = np.searchsorted(wanted, hashes).clip(0, max(len(wanted) - 1, 0))
                    hit = np.flatnonzero(wanted[place] == hashes) if len(wanted) else np.zeros(0, np.int64)
                    hashes, of, at, width, length, plain, first = (x[hit] for x in (hashes, of, at, width, length, plain, first))
                ends = np.concatenate([[0], np.cumsum(width)])
                index = np.repeat(first - ends[:-1], width) + np.arange(ends[-1])
                values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(slot[index].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(column).take(pa.array(of)), pa.array(hashes.view(np.int64)), pa.array(at.astype(np.int64)),
                     pa.array(length.astype(np.int64)), pa.array(plain), values], [column, "window", "at", "words", "plain", "slots"])
    return run


def _covered(windows: list[int], width: int) -> int:
    """The item's words in windows that begin at the given words, as bits."""
    found = 0
    for at in windows:
        found |= ((1 << width) - 1) << at
    return found


def _has_run(bits: int, length: int) -> bool:
    have = 1
    while have < length and bits:
        step = min(have, length - have)
        bits &= bits >> step
        have += step
    return bits != 0


def _added_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of each item in the windows found at neighbouring shifts whose slots map one to one together.

    The share counts the covered words beyond the first WIDTH - 1, so one unbroken run counts as its windows do, and a
    word put in, left out or changed inside costs no more than itself.
    """
    for batch in batches:
        rows = []
        for key, item, words, shifts in zip(*(batch.column(c).to_pylist() for c in ("key", "item", "words", "shifts")), strict=True):
            width = min(WIDTH, words)
            parts = sorted(((_covered(x["found"], width), x["shift"], x["same"], x["slots"]) for x in shifts), key=lambda x: (-x[0].bit_count(), x[1]))
            best = None
            for lead in parts:  # at most 2 * NEAR_SHIFTS of them
                bits, same, there, back = 0, True, {}, {}
                for more, _, alike, slots in [lead, *(x for x in parts if x is not lead)]:
                    if more | bits == bits or any(there.get(a, b) != b or back.get(b, a) != a for a, b in map(dict.values, slots)):
                        continue
                    bits, same = bits | more, same and alike
                    for a, b in map(dict.values, slots):
                        there[a], back[b] = b, a
                share = (bits.bit_count() - width + 1) / (words - width + 1)
                if share >= LEAST_SHARE or _has_run(bits, LONG_RUN):
                    best = max(best or (share, same), (share, same))
            if best is not None:
                rows.append((key, item, *best))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.bool_()))], ["key", "item", "share", "same"])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that it leaks: key, doc_id, item_id, share, exact.

    ``documents`` has doc_id and text, ``benchmark`` item_id and text; other columns are ignored.  ``key`` is a hash of
    doc_id and text that equal rows share; repeated rows give one row.  ``share`` is the part of the item's windows found,
    where windows parted by a few other words count as one run; runs of LONG_RUN words are reported with any share.
    ``exact`` tells whether all slots are as in the item.  Null or empty texts hold nothing and leak nothing; an item of
    fewer than WIDTH words has one window of all its words.  Where few words are literal, numbers and names must be the same.
    Repeated items are reported by each of their ids.  An item without WIDTH words in a row unchanged is not found,
    and one of one or two words only where it has LEAST_EVIDENCE words and edges: one stands alone in its sentence, line or
    text, two begin or end it.
    """
    spark = documents.sparkSession
    small_batches(spark)
    work = Workspace(spark, "decontaminate")
    named = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = work.store("items", named.select(F.xxhash64("item_id", "text").alias("item"), "text")
                       .mapInArrow(_windows_of("item", list(range(1, WIDTH + 1)), True), "item long, window long, at long, words long, plain boolean, slots array<long>"))
    widths = sorted(r[0] for r in items.select(F.size("slots")).distinct().collect())  # at most WIDTH of them
    n = items.count()
    keep = None
    if n <= FILTER_WINDOWS:  # beyond, all windows go to the join, with the same result
        found = items.select("window").distinct().toArrow().column("window").to_numpy().view(np.uint64)
        keep = spark.sparkContext.broadcast(np.sort(found))
    keyed = documents.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    windows = keyed.select("key", "text").mapInArrow(_windows_of("key", widths, False, keep), "key long, window long, at long, words long, plain boolean, slots array<long>")
    pairs = (windows.drop("words", "plain").join(items.withColumnsRenamed({"at": "item_at", "slots": "item_slots"}), "window")
             .select("key", "item", "words", "plain", (F.col("at") - F.col("item_at")).alias("shift"), "item_at",
                     F.filter(F.arrays_zip("item_slots", "slots"), lambda x: x["item_slots"] != 0).alias("slots")))
    slots = F.array_distinct(F.flatten(F.collect_set("slots")))
    # Groups are bounded by an item's windows: at one relative position each stands once.
    placed = pairs.groupBy("key", "item", "words", "plain", "shift").agg(F.collect_set("item_at").alias("found"), slots.alias("slots"))
    one_way = lambda side: F.size(F.array_distinct(F.transform("slots", lambda x: x[side]))) == F.size("slots")
    consistent = placed.where(one_way("item_slots") & one_way("slots")).withColumn(
        "same", F.forall("slots", lambda x: x["item_slots"] == x["slots"]))
    # Each shift is in two ranges of 2 * NEAR_SHIFTS, so any two that near meet in one; groups stay bounded.
    cell = F.floor(F.col("shift") / NEAR_SHIFTS)
    near = (consistent.withColumn("cell", F.explode(F.array(cell, cell - 1))).groupBy("key", "item", "words", "plain", "cell")
            .agg(F.collect_list(F.struct("shift", "found", "same", "slots")).alias("shifts")))
    best = (near.select("key", "item", "words", "shifts").mapInArrow(_added_up, "key long, item long, share double, same boolean")
            .groupBy("key", "item").agg(F.max(F.struct("share", "same")).alias("best")))
    return (best.join(named.select(F.xxhash64("item_id", "text").alias("item"), "item_id"), "item")
            .join(keyed.select("key", "doc_id").distinct(), "key")
            .select("key", "doc_id", "item_id", F.col("best.share").alias("share"), F.col("best.same").alias("exact")))


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all their columns as they are."""
    from barloom.llm.work import free_name

    key = free_name(documents, "_leak_key")
    found = leaks(documents, benchmark).select(F.col("key").alias(key)).distinct()
    return documents.withColumn(key, F.xxhash64("doc_id", "text")).join(found, key, "left_anti").drop(key)
