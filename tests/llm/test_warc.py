"""WARC archives, written, rewritten and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import zlib

import duckdb
import pytest

from brindle.llm import op13_warc as warc
from brindle.llm import queries, store

SCHEMA = "page_id long, url string, html string, payload string, digest string, first int, record_type string"
TEXTS = ["<p>one</p>", "", None, "", "ends in \r", "ends in \n", "ends in \r\n\r\n", "\r\n\r\n", "WARC/1.1\r\nContent-Length: 7\r\n\r\n", "é漢🙂\x00", "x" * 3_000_000, "<p>one</p>", "a\nb\nc", "\n" * 5000]


def plain(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) of rows (page_id, url, html)."""
    first: dict[bytes, int] = {}
    for i, _, t in rows:
        p = (t or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, t in rows:
        p = (t or "").encode()
        again = i is not None and p in first and first[p] < i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    made = [(i, None if i == 3 else f"http://h/{i}\r\nX: y <{i}>", t) for i, t in enumerate(TEXTS)]
    return made + [(100 - k, "http://same/", "the same page") for k in range(40)] + [(100, "http://same/", "the same page"), (None, "http://none/", "<p>one</p>")]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "d", 1, "t") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize(("least", "broadcast"), [(0, warc.BROADCAST), (9, warc.BROADCAST), (100, 0), (0, 0)])
def test_round_trip(table, rows, least, broadcast, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", broadcast)
    assert sorted((tuple(r) for r in warc.digest(table, least).collect()), key=repr) == plain(rows, least)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = queries.op13_warc_round_trip(spark, sf_dir)
    want = con.execute(warc.SQL)
    at = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in at) for r in got.collect()) == sorted(want.fetchall())


def test_each_record_is_a_member_and_the_sidecar_tells_where(spark, table, rows):
    source = warc.write(table)
    streams = [open(f"{source}/{f}", "rb").read() for f in os.listdir(source) if f.endswith(".gz")]
    assert all(zlib.decompressobj(31).decompress(s) == gzip.decompress(s) for s in streams)  # one member for all
    done = warc.normalise(spark, source)
    folder, names = done.folder.removeprefix("file://"), set()
    for r in done.index.collect():
        with open(f"{folder}/{r['archive']}", "rb") as f:
            whole = f.read()
        member = whole[r["offset"] : r["offset"] + r["length"]]
        record = zlib.decompress(member, 31)
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
        with open(f"{folder}/{r['archive']}.idx") as f:
            assert f"{r['offset']} {r['length']} {r['record_type']} {r['record_id']}\n" in f.read()
        names.add(r["archive"])
    assert sum(len(gzip.decompress(s)) for s in streams) == sum(len(gzip.open(f"{folder}/{n}").read()) for n in names)
    assert sorted(os.listdir(folder)) == sorted([*names, *(f"{n}.idx" for n in names)])  # no drafts left
    read = warc.read(done, payload=True).collect()
    assert sorted(bytes(r["payload"]).decode() for r in read if r["record_type"] == "response" and r["page_id"] is not None) == sorted({t or "" for _, _, t in rows})
    again = warc.normalise(spark, done.folder)  # archives of one member a record pass through as well
    assert sorted(r["length"] for r in again.index.collect()) == sorted(r["length"] for r in done.index.collect())


def test_a_task_run_twice_leaves_one_file(tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab"
    for _ in range(2):
        out = warc._Out(f"file://{tmp_path}", 7)
        for line in (record + b"\r\n\r").split(b"\n"):
            out.feed(line)
        out.close()
    assert len(os.listdir(tmp_path)) == 2


@pytest.mark.parametrize("text", [b"no record\r\n", b"WARC/1.1\r\nContent-Length: 50\r\n\r\nshort", b"WARC/1.1\r\nWARC-Type: x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 2\r\n\r\nlonger\r\n\r\n"])
def test_broken_archives_raise(text):
    records = warc.Records()
    with pytest.raises(ValueError):
        for line in text.split(b"\n"):
            records.feed(line)
        records.finish()


def test_stretches_are_read_by_themselves(spark, table, rows, monkeypatch):
    monkeypatch.setattr(warc, "STRETCH", 300)
    assert sorted((tuple(r) for r in warc.digest(table).collect()), key=repr) == plain(rows)


def test_empty_table(spark):
    assert warc.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_our_folders_are_dropped(spark, tmp_path):
    (tmp_path / "kept").mkdir()
    store.drop_folder(spark, str(tmp_path / "kept"))
    assert (tmp_path / "kept").exists()
