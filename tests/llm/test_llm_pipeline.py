"""The pipeline's stages on a small table of planted cases."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    passage, item = text(60), " ".join(f"q{k}" for k in range(25))
    rows = [(i, text(80) + (" horrid" if i % 5 == 0 else "")) for i in range(200)]
    copy = text(120)
    rows += [(300, copy), (301, copy), (302, copy + " end"), (400, f"{text(50)} {passage} {text(50)}"), (401, f"{text(50)} {passage} {text(50)}"),
             (500, f"{text(30)} {item} {text(30)}"), (600, None), (601, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, passage


def test_stages(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], path).write.parquet(f"{path}/stage-{i}")
        tables.append(spark.read.parquet(f"{path}/stage-{i}"))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tables[-1].columns == docs.columns
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    assert ids[0] - ids[1] == {i for i in range(0, 200, 5)}
    assert ids[1] - ids[2] == {301, 302}
    assert ids[2] == ids[3]
    assert ids[3] - ids[4] == {500} and ids[4] == ids[5]
    after = {r.doc_id: r for r in tables[3].collect()}
    assert all(passage[5:-5] not in after[i].text and after[i].n_chars == len(after[i].text) for i in (400, 401))
    before = {r.doc_id: r.text for r in tables[2].collect()}
    assert all(after[i].text == before[i] for i in ids[3] - {400, 401})
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == ids[5]


def test_cut_characters_go_and_replacement_characters_stay(spark):
    from pyspark.sql import functions as F

    whole = "é\ufffd\x01b\x01\ufffd\x01a漢😀"
    data = whole.encode()
    rows = [(data,), (data[1:],), (data[:-1],), (data[:-2],), ("漢".encode()[:2] + data + "😀".encode()[1:],), (b"\xef\xbf" + data,), (b"",)]
    got = spark.createDataFrame(rows, "b binary").select(corpus_pipeline.without_cut_characters(F.col("b").cast("string")).alias("t")).collect()
    assert [r.t for r in got] == [whole, whole[1:], whole[:-1], whole[:-1], whole, whole, ""]


def test_stages_on_odd_tables(spark, folder):
    path, _ = folder
    rnd = random.Random(3)
    long = " ".join(f"v{rnd.randrange(50_000)}é" for _ in range(60_000))
    shared = "\ufffd" + "漢" * 120
    rows = [(1, "a b c", 1), (1, "a b c", 2), (None, "only a null id \ufffd here", 3), (None, None, 4), (2, "", 5), (2, None, 6), (3, long, 7), (4, f"x é{shared}ü y", 8), (5, f"z è{shared}ö w", 9)]
    names = "doc_id long, text string, _toxicity int, _kept string, _spans string, _removed string, key string"
    docs = spark.createDataFrame([(i, t, k, "k", "s", "r", "y") for i, t, k in rows], names)
    tables = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], path).write.parquet(f"{path}/odd-{i}")
        tables.append(spark.read.parquet(f"{path}/odd-{i}"))
        assert stage(spark, docs.limit(0), path).count() == 0
    assert all(t.columns == docs.columns for t in tables[:-1])
    assert tables[1].count() == len(rows)
    near = tables[2].collect()
    assert sorted(r.doc_id or 0 for r in near) == [0, 0, 1, 2, 3, 4, 5] or sorted(r.doc_id or 0 for r in near) == [0, 0, 1, 2, 2, 3, 4, 5]
    cut = {r.doc_id: r.text for r in tables[3].collect() if r.doc_id}
    # The first byte of ü and ö is shared too: what is left of them goes.
    assert cut[4] == "x é y" and cut[5] == "z è w" and cut[3] == long
    assert {r.text for r in tables[3].collect() if r.doc_id is None} == {None, "only a null id \ufffd here"}
    assert tables[4].count() == tables[5].count() == len(near)
    assert sum(r.n_tokens == 0 for r in tables[5].collect()) >= 2
