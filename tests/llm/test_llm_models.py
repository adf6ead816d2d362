"""Sharding, search, joins, decontamination, licences and the two models against brute force."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import components, decontaminate, hmm, licenses, pathjoin, sharding, topk, toxicity
from barloom.llm.work import Workspace

DOC = "doc_id long, text string"


def random_text(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


def test_hypergeometric_law_and_exact_margins():
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(rng, 10, 7, 20) for _ in range(20_000)])
    law = [math.comb(7, k) * math.comb(13, 10 - k) / math.comb(20, 10) for k in range(8)]
    assert np.abs(np.bincount(draws, minlength=8) / len(draws) - law).max() < 0.015
    assert abs(sharding.hypergeometric(rng, 4 * 10**9, 10**10, 3 * 10**10) - 4 * 10**9 / 3) < 10**6
    sizes, capacity = np.array([5, 0, 17, 3, 40]), sharding.shard_sizes(65, 8)
    matrix = np.stack([sharding.block_row(sizes, b, capacity, 3) for b in range(5)])
    assert (matrix.sum(axis=1) == sizes).all() and (matrix.sum(axis=0) == capacity).all() and (matrix >= 0).all()


@pytest.mark.parametrize("n,shards", [(0, 4), (3, 8), (101, 7)])
def test_shards_are_exact_and_keep_every_row(spark, n, shards):
    rows = [(i % 50 if i else None, None if i % 9 == 0 else "t" * (i % 5), i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard long").repartition(5)
    got = sharding.shuffle_into_shards(spark, df, shards).collect()
    assert sorted((str(r.doc_id), str(r.text), r["_shard"]) for r in got) == sorted((str(a), str(b), c) for a, b, c in rows)
    counts = Counter(r.shard for r in got)
    assert [counts[s] for s in range(shards)] == sharding.shard_sizes(n, shards).tolist()
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_shuffle_is_uniform_over_shards(spark):
    df = spark.range(40).repartition(3)
    hits = Counter()
    for seed in range(25):
        hits.update((r.id, r.shard) for r in sharding.shuffle_into_shards(spark, df, 2, seed).collect())
    share = np.array([hits[i, 0] for i in range(40)]) / 25
    assert abs(share.mean() - 0.5) < 1e-9 and 0.15 < share.min() and share.max() < 0.85


def test_top_k_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-0.5, 0.25, 0.0, 1 / 64]) for _ in range(4)]) for i in range(0, 400)]
    rows += [(500, None), (520, [1.0, None, 0.0, 0.0]), (540, [float("nan")] * 4), (560, [float("inf")] * 4), (None, [1.0] * 4),
             (600, [0.5, 0.5]), (601, [0.25, 0.5]), (620, []), (640, [1e300, -1e300, 0.0, 1.0]), (641, [0.3e10, 1.0, 1.0, -2e9])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(4)
    good = [(i, [math.floor(64 * x) if abs(64 * x) < 2**62 else int(64 * x) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    limit = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q, a in good:
        if q % 20 == 0:
            scored = sorted((-limit(sum(x * y for x, y in zip(a, b))), i) for i, b in good if i != q and len(a) == len(b))
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:7])]
    got = [tuple(r) for r in topk.top_k(df, 7).select("query_id", "rank", "vec_id", "score").collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def shingles(text):
    words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def near_texts():
    rnd = random.Random(9)
    out = [None, "", "...", "one", "One!", "two words", random_text(rnd, 3000)]
    for size in (30, 60, 200):
        base = random_text(rnd, size).split()
        for _ in range(14):
            words = list(base)
            for _ in range(rnd.randint(0, size // 40 + 1)):
                words[rnd.randrange(size)] = f"x{rnd.randrange(9)}"
            out.append(" ".join(words))
    shared = random_text(rnd, 40)
    return out + [f"{random_text(rnd, 60)} {shared} {random_text(rnd, 60)}" for _ in range(45)] + [out[9], out[9], "one"]


def test_near_duplicates_equal_brute_force(spark):
    found = near_texts()
    sets = [shingles(t) for t in found]
    linked = {i: set() for i in range(len(found))}
    for i, j in itertools.combinations(range(len(found)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
            linked[i].add(j), linked[j].add(i)
    group = {}
    for i in linked:
        if i not in group:
            todo = [i]
            while todo:
                if (k := todo.pop()) not in group:
                    group[k] = i
                    todo += linked[k]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(found)], DOC + ", class_id int").repartition(4)
    got = {r.doc_id: r for r in pathjoin.near_duplicates(df).collect()}
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (group[i], len(linked[i])) for i in linked}
    kept = pathjoin.one_of_each(df)
    assert kept.columns == ["doc_id", "text", "class_id"] and sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))
    assert pathjoin.near_duplicates(df.limit(0)).count() == 0


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pathjoin, "BLOCK", 5)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:i], f"n{i}", *base[i + 1:]])) for i in range(40)] + [(40, " ".join(base)), (None, "lone"), (None, None)]
    got = {r.doc_id: r for r in pathjoin.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    sets = [shingles(t) for _, t in rows[:41]]
    want = [sum(a is not b and len(a & b) >= 0.8 * len(a | b) - 1e-9 for b in sets) for a in sets]
    assert [got[i].n_links for i in range(41)] == want and {got[i].class_id for i in range(41)} == {0}


def test_top_k_of_repeated_ids_and_lengths_without_queries(spark):
    rows = [(20, [1.0, 0.5]), (20, [0.25, -1.0]), (40, [0.5, 0.5]), *[(1, [k / 8, 1.0]) for k in range(6)], *[(20, [9.0, k / 4]) for k in range(5)],
            (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4).select("query_id", "rank", "vec_id", "score").collect()]
    exact = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for query in (20, 40):
        pairs = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in exact for j, w in exact if i == query != j and len(v) == len(w))
        want += [(query, n + 1, j, -score) for n, (score, j) in enumerate(pairs[:4])]
    assert sorted(got) == want


def test_runs_reach_the_target():
    assert pathjoin.runs_needed() == 25 and pathjoin.runs_needed(levels=1, target=0.99) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201), (201, 200), (300, 310), (305, 310), (7, 60)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test"), "c").collect()
    assert sorted((r.node, r.root) for r in got) == sorted([(i, 0) for i in range(1, 61)] + [(201, 200), (305, 300), (310, 300)])
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test"), "c").count() == 0


def test_leaks_with_other_numbers_names_and_units(spark):
    items = [(1, "A train leaves Boston at 40 km per hour and returns to Boston after 3 hours at 40 km"), (2, "Two short words here"), (3, None), (4, "")]
    docs = [(1, "Well. A train leaves Denver at 55 miles per hour and returns to Denver after 7 hours at 55 miles ok"),
            (2, "A train leaves Denver at 55 miles per hour and returns to Paris after 7 hours at 9 miles"),
            (3, None), (4, ""), (5, "see two short words here."), (6, "A TRAIN leaves a station"), (7, "x " * 20_000 + items[0][1]), (None, items[0][1]),
            (None, items[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOC + ", item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.leaks(df, bench).collect()}
    assert got == {(1, 1, False), (5, 2, True), (7, 1, True), (None, 1, True)}
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]
    assert decontaminate.leaks(df.limit(0), bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_leaks_without_the_early_filter_are_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(i, random_text(rnd, 20, 50)) for i in range(6)]
    docs = spark.createDataFrame([(i, f"{random_text(rnd, 30)} {items[i % 6][1]} tail" if i % 3 else random_text(rnd, 50)) for i in range(30)], DOC)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect())
    assert want == [(i, i % 6) for i in range(30) if i % 3]
    monkeypatch.setattr(decontaminate, "FILTER_WINDOWS", 0)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()) == want


def test_leaks_of_items_with_few_literal_words(spark):
    items = [(1, "What is 12 + 7 * 30 - 5 / 2"), (2, "Add 4 8 15 16 23 42 108 and 9"), (3, "Answer 42")]
    docs = [(i, f"Some words first. {text}. Some words last.") for i, text in items] + [(4, "Well. What is 13 + 8 * 31 - 6 / 3"), (5, "Reply 42. Answer 43.")]
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 3, True)}


def test_leaks_with_longer_values_and_words_put_in_or_left_out(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(59)]
    story = "every morning the baker Ann sells 3 loaves to her oldest neighbour and keeps 40 more for the small village school"
    plain, long = " ".join(words[:20]), " ".join(words)
    items = [(1, story), (2, plain), (3, long)]
    docs = [(1, "So. " + story.replace("3", "3.5").replace("40", "1,250").replace("Ann", "Mary Ann") + " then."),
            (2, " ".join([*words[:10], "really", *words[10:20]])), (3, " ".join([*words[:9], *words[10:20]])), (4, " ".join([*words[:10], "really", *words[11:20]])),
            (5, "before " + " ".join(words[25:55]) + " after"), (6, " ".join(words[22:37])), (7, " ".join([*words[:8], *(["gap"] * 40), *words[12:20]]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 3)}


def test_leaks_whatever_the_capitals_and_the_word_before(spark):
    story = "Today Anna visits Rome while Peter and Ärne wait near Paris until Maria calls"
    items = [(1, "Which planet orbits closest to the bright Sun"), (2, story), (3, "Gravity")]
    docs = [(1, "Quiz 7, Which planet orbits closest to the bright Sun"), (2, "so " + story.lower()), (3, "so " + story.upper()),
            (4, "Everybody knows gravity and the falling apple"), (5, "It is said. Gravity. So it is.")]
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1, True), (2, 2, True), (3, 2, True), (5, 3, True)}


def test_license_places_and_notices(spark):
    docs = [(1, "CC BY, cc-by. Cc By"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."), (5, "apache version license 2.0 the under"),
            (6, "x" * 50_000 + " all rights   reserved! General Public\nLicense"), (7, "---"), (7, "---"), (None, "Knnow all rights reserved")]
    got = sorted(licenses.scan(spark.createDataFrame([(*d, 9) for d in docs], DOC + ", score int")).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    base = {r.doc_id: r for r in got}
    assert (base[1].n_words, base[1].n_base, base[1].first_word, base[1].last_word, base[1].base_labels) == (6, 3, 0, 4, "cc-by")
    assert (base[2].n_words, base[2].n_base, base[2].first_word, base[2].labels, base[2].score) == (0, 0, None, "", 0.0)
    assert base[4].labels == "apache-2.0" and base[4].base_labels == "" and base[4].score == 1.0
    assert base[5].labels == "" and 0 < base[5].score < 1
    assert (base[6].base_labels, base[6].first_word, base[6].last_word, base[6].n_base) == ("gpl,reserved", 1, 4, 2)
    assert base[None].base_labels == "reserved" and len(got) == len(docs)
    assert licenses.scan(spark.createDataFrame([], DOC)).count() == 0


def test_toxicity_learns_words_and_survives_odd_input(spark):
    rnd = random.Random(1)
    rows = [(i, random_text(rnd, 40) + (" badword other" if i % 4 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([(*r, 0.5) for r in [*rows, (900, None), (901, ""), (None, "badword")]], DOC + ", score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.with_score(docs, toxicity.fit(docs, labels))
    assert got.columns == ["doc_id", "text", "_score", "score"]
    scores = {r.doc_id: r.score for r in got.collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[900] == scores[901]
    assert all((scores[i] >= 0.7) == (i % 4 == 0) for i in range(200, 300)) and scores[None] > scores[900]
    none = toxicity.fit(docs, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.with_score(docs, none).collect()} == {0.5}


def test_pairs_of_terms_count_beyond_their_parts():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (400, 2))
    docs, at = np.nonzero(x)
    own = toxicity.Machine(np.arange(2, dtype=np.uint64)).fit(docs, at, (x[:, 0] != x[:, 1]).astype(float), batch=32)
    score = own.score(docs, at, 400)
    assert ((score > 0.5) == (x[:, 0] != x[:, 1])).mean() > 0.95


def plain_forward_backward(model, o):
    k = len(model.start)
    forward, scale = np.zeros((len(o) + 1, k)), np.ones(len(o) + 1)
    forward[0] = model.start
    for t, c in enumerate(o):
        forward[t + 1] = (forward[t] @ model.move) * model.emit[c]
        scale[t + 1] = forward[t + 1].sum()
        forward[t + 1] /= scale[t + 1]
    back = np.ones((len(o) + 1, k))
    for t in range(len(o) - 1, -1, -1):
        back[t] = model.move @ (model.emit[o[t]] * back[t + 1]) / scale[t + 1]
    return forward, back, np.log10(scale).sum()


def test_segmented_recursion_is_the_plain_one():
    rng = np.random.default_rng(0)
    k, c = 3, 7
    model = hmm.Model(np.array([0.5, 0.3, 0.2]), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(c), k).T)
    at = np.r_[0, np.cumsum([1, 5, 64, 65, 200, 130, 63])]
    classes = rng.integers(0, c, at[-1])
    starts, moves, emits, total = hmm.Passes(model, classes, at).counts(c)
    s, m, e = np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for i in range(len(at) - 1):
        o = classes[at[i]:at[i + 1]]
        forward, back, log = plain_forward_backward(model, o)
        assert total[i] == pytest.approx(log, abs=1e-9)
        chance = forward * back / (forward * back).sum(axis=1, keepdims=True)
        s += chance[0]
        for t, w in enumerate(o):
            pair = forward[t][:, None] * model.move * (model.emit[w] * back[t + 1])
            m += pair / pair.sum()
            e[w] += chance[t + 1]
    assert np.allclose(starts, s) and np.allclose(moves, m) and np.allclose(emits, e)


@pytest.mark.parametrize("known", [hmm.KNOWN_WORDS, 20])
def test_language_model_scores(spark, known):
    rnd = random.Random(6)
    rows = [(i, random_text(rnd, rnd.randint(0, 90), 60 + 300 * (i % 2))) for i in range(150)] + [(500, None), (501, ""), (501, ""), (None, "A a\tB")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", score int").repartition(3)
    found, language = hmm.scored(df, ~hmm.is_held_out(), iterations=2, known_words=known)
    tokens = {r: re.findall(r"[^\x20\x09-\x0D]+", (r[1] or "").lower()) + [None] for r in rows}
    count = Counter()
    for r in rows:
        if not held(r[0]):
            count.update(tokens[r])
    n, v = sum(count.values()), len(count)
    assert (language.words.total, language.words.distinct) == (n, v)
    assert found.columns == ["doc_id", "_score", "n_tokens", "n_known", "base_score", "score"]
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found.collect())
    assert got == sorted((str(r[0]), len(tokens[r]), sum(count[w] > 0 for w in tokens[r]),
                          round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[r]), 6)) for r in rows)
    # Over all outcomes of one token the model's chances add up to one.
    words, model = language.words, language.model
    classes = words.class_mass @ np.ones(1) if words.class_mass.ndim > 1 else words.class_mass.sum()
    assert classes == pytest.approx(1, abs=1e-9) and np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    both = found.agg(F.sum("score"), F.sum("base_score")).first()
    assert both[0] > both[1]


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(1, "a b")], DOC)
    found, language = hmm.scored(df, F.lit(False))
    row = found.first()
    assert (row.n_tokens, row.n_known, language.words.total) == (3, 0, 0) and row.base_score == 0.0 and row.score == pytest.approx(0)
    assert hmm.scored(df.limit(0), F.lit(True))[0].count() == 0


def test_top_k_with_more_query_blocks_than_partitions(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(i, [rnd.uniform(-2, 2) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in topk.top_k(df, 3, 2).collect())
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "CELL_ROWS", 30)
    assert sorted(tuple(r) for r in topk.top_k(df, 3, 2).collect()) == want and len(want) == 300


def test_rare_words_reach_the_encoder_without_another_python_step(spark):
    """Besides the step that lists the words and the one that encodes, none runs in the tasks."""
    rows = [(1, "a a b c"), (2, "a b d"), (2, "a b d"), (None, None), (4, "e e zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    language = hmm.count_words(df.where("doc_id < 4"), 2)
    encoded = hmm.encode(df, language)
    assert encoded._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known) for r in encoded.collect()) == [("1", 5, 5), ("2", 4, 4), ("2", 4, 4), ("4", 4, 1), ("None", 1, 1)]
