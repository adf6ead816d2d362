"""Conversation repair against a plain search over all edits of each conversation."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from barloom.llm import conversations as conv
from barloom.llm import queries
from barloom.llm.work import Workspace

SCHEMA = "conv_id long, turn long, role string, text string, at string, chunk int, copies int"
SPACE = r"[^\x20\x09-\x0D]"


def hurt(rows):
    found = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        found += [(c, t, "user" if code == 4 else role, text)] * (0, 1, 1, 2)[min(code, 3)] if code < 4 else [(c, t, "user" if code == 4 else role, text)]
    return found


def fits(before, initial):
    """The state after a row, or None: 0 nothing, 1 s, 2 u, 3 a."""
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((before, initial))


def cheapest(rows):
    """rows: (initial, truncated, must go); the cheapest edits, then the least string of them."""
    @cache
    def best(i, state, inserts):
        ways = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if inserts:
            for x in "ua":
                if fits(state, x) is not None:
                    cost, edits = best(i, fits(state, x), inserts - 1)
                    ways.append((cost + 2, "I" + edits))
        if i < len(rows):
            initial, cut, forced = rows[i]
            cost, edits = best(i + 1, state, 2)
            ways.append((cost + 3, "D" + edits))
            if not forced:
                for name, price, x in (("K", 0, initial), ("R", 2, "u"), ("R", 2, "a")):
                    if fits(state, x) is not None:
                        cost, edits = best(i + 1, fits(state, x), 2)
                        ways.append((cost + price + cut, name + edits))
        return min(ways, default=(10**9, ""))

    return best(0, 0, 2)


def plain(rows, plant=True):
    groups = {c: [] for c, *_ in rows}
    for c, *rest in hurt(rows) if plant else rows:
        groups[c].append(rest)
    found = []
    for c, own in groups.items():
        own = sorted(([t, " " if r is None else r, " " if x is None else x] for t, r, x in own), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in own:
            solid = re.findall(SPACE, text)
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], int(fault == "truncated"), fault in ("blank", "duplicate")))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = cheapest(tuple(kinds))
        lines, state, left = [], 0, iter(zip(own, kinds))
        for edit in audit:
            row = None if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit == "K":
                state = fits(state, row[1][0])
                lines.append(f"{row[0][1]}:{row[0][2]}")
            else:
                state = 3 if state == 2 else 2
                lines.append(f"{'user' if state == 2 else 'assistant'}:{row[0][2] if row else ''}")
        found.append((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(found, key=str)


def some(n, seed, roles=("system", "user", "assistant", "tool", None, "", "user", "assistant")):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(n), None]:
        for _ in range(rnd.choice([1, 2, 3, 5, 8, 13])):
            text = rnd.choice(["hello.", "what?", "cut off", "cut é\t\n", "", " \x0b", None, f"own {rnd.random()}!", f"no end {rnd.random()}", "x\xa0", "!"])
            rows.append((c, rnd.choice([None, *range(12)]), rnd.choice(roles), text))
    return rows


def given(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_backward_and_rerun_agree_from_every_vector():
    rnd = random.Random(1)
    vectors = {conv.TERMINAL}
    for _ in range(6):
        vectors |= {conv.step(v, x)[0] for v in vectors for x in range(16)}
    for _ in range(300):
        symbols = [rnd.choice([0, 1, 2, 3, 2, 3, 6, 7, 8, 11]) for _ in range(rnd.randint(0, 30))]
        old, new = rnd.choice(sorted(vectors)), rnd.choice(sorted(vectors))
        assert conv.rerun(symbols, new, old, *conv.backward(symbols, old)) == conv.backward(symbols, new)


def test_repair_equals_plain_search(spark, tmp_path):
    rows = [*some(60, 3), (5, 3, "user", "same."), (5, 3, "user", "same."), (5, 3, "user", "same."), (6, 2**62, "user", "far."), (900, 1, "user", "x. " * 300_000)]
    dropped = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    want = plain(rows)
    assert (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in want
    given(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert result(queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path))) == want


@pytest.mark.parametrize("roles", [("user", "assistant"), ("tool", "tool", "tool", "user"), ("user",), ("system", "user", None)])
def test_long_conversations_in_many_chunks(spark, roles):
    sys.setrecursionlimit(20_000)
    rnd = random.Random(len(roles))
    rows = [(1, t, rnd.choice(roles), rnd.choice(["a.", "b", f"{t}.", f"{t}", ""])) for t in range(500)]
    rows += [(2, t, "tool", f"{t}.") for t in range(300)] + [(3, t, "user", "") for t in range(100)] + some(5, 9)
    got = conv.audited(given(spark, rows), Workspace(spark, "test"), chunk_bits=3, fan=2)
    assert result(got) == plain(rows)


def test_repaired_rows_alternate(spark):
    rows = some(30, 4)
    found, summary = conv.repair(given(spark, rows), Workspace(spark, "test"), chunk_bits=2)
    by = {}
    for r in sorted(found.collect(), key=lambda r: (r.at, r.step)):
        by.setdefault(r.conv_id, []).append(r)
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in own)) for own in by.values())
    assert all(r.text == "" and r.turn is None for own in by.values() for r in own if r.edit == "I")
    for r in summary.collect():
        assert re.sub("D", "", r.audit) == "".join(x.edit for x in by.get(r.conv_id, []))


def test_an_empty_table_and_text_ids(spark):
    assert result(conv.audited(given(spark, []), Workspace(spark, "test"))) == []
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), (None, 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    _, summary = conv.repair(df, Workspace(spark, "test"))
    assert {(r.conv_id, r.audit, r.cost) for r in summary.collect()} == {("a", "KK", 0), (None, "KI", 2)}
