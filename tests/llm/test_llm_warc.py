"""WARC archives: round trips, revisits against grouping in plain Python, damage."""

import base64
import gzip
import hashlib
import random

import pytest

from barloom.llm import queries, warc

SCHEMA = "page_id long, url string, html string, payload_digest string, path int"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, min_bytes=0):
    groups = {}
    for i, url, html in rows:
        groups.setdefault(html or "", []).append((i is None, i or 0, url is not None, url or "", i))
    found = []
    for html, pages in groups.items():
        size = len(html.encode())
        for k, page in enumerate(sorted(pages)):
            again = k > 0 and size >= min_bytes
            found.append((page[4], size, sha(html), "revisit" if again else "response", sorted(pages)[0][4] if again else None))
    return sorted(found, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)


def some_rows():
    rnd = random.Random(2)
    rows = [(i, f"http://h/{i % 7}", rnd.choice(["<p>é 漢</p>", "a", "b\r\n\r\nc", "", None, "WARC/1.1\r\n\r\n", "x" * 3_000_000, f"own {i}"])) for i in range(150)]
    return [*rows, (3, "http://h/3", "a"), (3, "http://h/3", "a"), (None, None, "a"), (None, "http://z", "only null ids"), (7, "bad\r\nHeader: 1 é\t", "b"), (8, None, "c")]


def test_pages_round_trip_and_equal_payloads_become_revisits(spark, tmp_path):
    rows = some_rows()
    random.Random(4).shuffle(rows)
    index = warc.deduplicated(pages_of(spark, rows).repartition(5), str(tmp_path))
    records = warc.read_archives(index)
    pages = warc.resolved_pages(records)
    assert rows_of(pages) == plain(rows)
    assert pages.where("not resolved").count() == 0
    got = records.where("record_type = 'response'").collect()
    assert sorted(bytes(r.payload).decode() for r in got) == sorted({h or "" for _, _, h in rows})
    assert all(r.payload is None for r in records.where("record_type = 'revisit'").collect())
    assert {r.url for r in got if r.page_id == 8} <= {None, "http://h/1"}
    assert "bad%0D%0AHeader:%201%20é%09" in {r.url for r in records.collect()}


def test_small_payloads_stay_responses(spark, tmp_path):
    rows = some_rows()
    index = warc.deduplicated(pages_of(spark, rows), str(tmp_path), min_bytes=2)
    assert rows_of(warc.resolved_pages(warc.read_archives(index))) == plain(rows, 2)


def test_files_roll_over_and_read_as_plain_gzip(spark, tmp_path):
    rows = [(i, "u", f"text {i} " * 50) for i in range(40)]
    index = warc.write_captures(pages_of(spark, rows).coalesce(1), str(tmp_path), roll_bytes=2000)
    files = [r.path for r in index.select("path").distinct().collect()]
    assert len(files) > 3
    assert sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == 40
    again = warc.write_resolved(warc.resolve(index), f"{tmp_path}/again", roll_bytes=3000)
    assert rows_of(warc.resolved_pages(warc.read_archives(again))) == plain(rows)


def test_revisits_of_the_input_are_joined_or_kept(spark, tmp_path):
    index = warc.write_captures(pages_of(spark, [(5, "u", "a"), (6, "u", "b")]), str(tmp_path))
    more = [r.asDict() for r in index.collect()]
    for page, digest in ((1, sha("a")), (2, sha("gone"))):
        more.append(more[0] | {"record_id": f"r{page}", "record_type": "revisit", "page_id": page, "payload_digest": digest,
                               "payload_bytes": 1, "refers_to_record": "lost", "refers_to_page": 99})
    resolved = warc.resolve(spark.createDataFrame(more, warc.INDEX))
    found = warc.resolved_pages(warc.read_archives(warc.write_resolved(resolved, f"{tmp_path}/again")))
    assert sorted((r.page_id, r.record_type, r.refers_to, r.resolved) for r in found.collect()) == [
        (1, "revisit", 5, True), (2, "revisit", 99, False), (5, "response", None, True), (6, "response", None, True)]


def test_damage_is_an_error(spark, tmp_path):
    index = warc.write_captures(pages_of(spark, [(1, "u", "a" * 500)]).coalesce(1), str(tmp_path))
    path = index.first().path
    data = gzip.open(path).read()
    for bad in (data.replace(b"aaaa\r\n", b"aaab\r\n"), data[:-2], data.replace(b"WARC/1.1", b"WARC/9.9")):
        with gzip.open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(Exception, match="DamagedArchive"):
            warc.read_archives(index).collect()
    with open(path, "wb") as f:
        f.write(gzip.compress(data)[:-20])
    with pytest.raises(Exception, match="DamagedArchive"):
        warc.read_archives(index).collect()


def test_an_empty_table_gives_no_archive(spark, tmp_path):
    index = warc.deduplicated(pages_of(spark, []), str(tmp_path))
    assert warc.resolved_pages(warc.read_archives(index)).count() == 0


def test_query_over_a_table(spark, tmp_path):
    rows = some_rows()
    pages_of(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    df = queries.QUERIES["op12_warc_revisits"](spark, str(tmp_path))
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows_of(df) == plain(rows)
