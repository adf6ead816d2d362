"""What a Python worker holds at a time, and how much Spark hands to it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import pathjoin, suffixdedup, toxicity
from barloom.llm.work import BATCH_SETTING, MOST_BATCH_BYTES


def text_of(rnd, n):
    return " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    return [text_of(rnd, 300) for _ in range(1200)]  # 1.9 MB


def peak(task, batch):
    for _ in task(iter([batch.slice(0, 20)])):
        pass
    tracemalloc.start()
    rows = sum(b.num_rows for b in task(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return rows, most / 1e6


def test_steps_over_texts_hold_little_at_a_time(texts):
    keys = pa.array(np.arange(len(texts)))
    rows, most = peak(pathjoin._describe(pathjoin.runs_needed()), pa.record_batch([keys, pa.array(texts)], ["key", "text"]))
    assert rows == len(texts) and most < 80
    _, most = peak(suffixdedup._regions, pa.record_batch([keys, pa.array(texts)], ["key", "text"]))
    assert most < 70
    rows, most = peak(toxicity._extract, pa.record_batch([keys, keys, pa.array(texts)], ["order", "toxic", "text"]))
    assert rows == len(texts) and most < 25


def test_a_long_text_is_sampled_in_parts(texts):
    whole = " ".join(texts)
    rows, most = peak(pathjoin._describe(pathjoin.runs_needed()), pa.record_batch([pa.array([1] * 21), pa.array(["a b"] * 20 + [whole])], ["key", "text"]))
    assert rows == 21 and most < 250


def test_sampling_in_parts_gives_the_same_paths(monkeypatch):
    tokens = np.random.default_rng(2).integers(0, 1 << 63, 4000, dtype=np.uint64)
    at = np.array([0, 0, 7, 900, 900, 901, 4000])
    docs = np.arange(6)
    want = pathjoin.paths(tokens, at, docs, 12)
    for size in (1, 50, 5000):
        monkeypatch.setattr(pathjoin, "TOKENS_AT_ONCE", size)
        assert all(np.array_equal(a, b) for a, b in zip(pathjoin.paths(tokens, at, docs, 12), want, strict=True))
    assert len(pathjoin.paths(tokens, at, np.zeros(0, np.int64), 12)[0]) == 0


def test_batches_of_texts_are_bounded_and_smaller_settings_stay(spark, tmp_path):
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, text_of(rnd, 40) + str(i) * 20_000) for i in range(400)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    before = spark.conf.get(BATCH_SETTING)
    try:
        for start, most in ((None, MOST_BATCH_BYTES), (before, MOST_BATCH_BYTES), ("1m", 1 << 20)):
            spark.conf.set(BATCH_SETTING, start) if start else spark.conf.unset(BATCH_SETTING)
            pathjoin.near_duplicates(docs.limit(3))
            found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
            assert sum(found) > 2 * most and max(found) < most + 200_000
    finally:
        spark.conf.set(BATCH_SETTING, before)
