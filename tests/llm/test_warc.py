import gzip
import hashlib
import io
import random

import pytest

from larkspur.llm import warc
from tests.llm.helpers import clashing

PAGES = "page_id long, url string, html string"


def written(*rows):
    return b"".join(warc.record(*r) for r in rows)


def test_records_are_plain_gzip_members():
    data = written((1, "http://é.x/ a\r\nb", b"x" * 500), (2, None, b"", None), (3, "u", b"x" * 500, 1))
    whole = gzip.decompress(data)
    assert whole.count(b"WARC/1.1\r\n") == 3 and b"\r\nb\r\n" not in whole
    got = list(warc.read_records(io.BytesIO(data)))
    assert [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got] == [(1, 500, "response", None), (2, 0, "response", None), (3, 500, "revisit", 1)]
    assert got[0]["payload_digest"] == got[2]["payload_digest"] == hashlib.sha256(b"x" * 500).hexdigest()


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_blocks_of_any_size(block):
    rnd = random.Random(block)
    payloads = [rnd.randbytes(n) for n in (0, 1, 99, 100, 3000)] + [b"\r\n\r\n" * 50, b"WARC/1.1\r\n"]
    data = written(*[(i, "http://x/", p) for i, p in enumerate(payloads)])
    got = list(warc.read_records(io.BytesIO(data), block=block))
    assert [r["payload_digest"] for r in got] == [hashlib.sha256(p).hexdigest() for p in payloads]


def _damaged(change):
    z = gzip.decompress(warc.record(1, "u", b"p" * 200))
    return gzip.compress(change(z)) + warc.record(2, "u", b"q")


@pytest.mark.parametrize("change", [lambda z: z.replace(b"ppp", b"ppq", 1), lambda z: z[:-10], lambda z: z + b"x", lambda z: b"HTTP" + z, lambda z: b"", lambda z: z.replace(b"WARC-Block-Digest", b"X-Block"), lambda z: z.replace(b"sha256:", b"sha256:0", 1)])
def test_damage_is_found(change):
    data = _damaged(change)
    with pytest.raises((warc.WarcError, KeyError, ValueError)):
        list(warc.read_records(io.BytesIO(data)))
    got = list(warc.read_records(io.BytesIO(data), strict=False))
    assert got[0]["error"] and got[1]["page_id"] == 2


def test_a_cut_archive():
    data = written((1, "u", b"p" * 200), (2, "u", b"q" * 200))[:-30]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(data)))
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(data), strict=False)] == [1, None]


def test_round_trip_on_spark(spark, tmp_path):
    rows = [(5, "http://a/", "x" * 200), (3, "http://b/", "x" * 200), (9, None, "x" * 200), (1, "http://c/", "short"), (2, "http://c/", "short"), (4, "u", None), (6, "u", ""), (None, "u", "x" * 200), (7, "u", "ü" * 60), (8, "u", "ü" * 60)]
    pages = warc.with_revisits(clashing(spark.createDataFrame(rows, PAGES)))
    manifest = warc.write_archives(pages.repartition(2), f"file://{tmp_path}/a", archive_bytes=300)
    assert manifest.count() > 2
    got = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert len(got) == len(rows) and all(got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest() for i, _, h in rows)
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3, None: 3, 8: 7}
    empty = warc.write_archives(warc.with_revisits(spark.createDataFrame([], PAGES)), f"file://{tmp_path}/b")
    assert warc.read_archives(empty).collect() == []


def test_records_have_their_payload():
    payloads = [b"x" * 500, b"", b"\r\n\r\n" * 200]
    data = written(*[(i, "u", p) for i, p in enumerate(payloads)], (9, "u", b"x" * 500, 0))
    for block in (1, 64, 1 << 16):
        assert [r["payload"] for r in warc.read_records(io.BytesIO(data), block=block)] == [*payloads, None]
    assert {r["payload"] for r in warc.read_records(io.BytesIO(data), payloads=False)} == {None}


def _archives(spark, folder, *archives):
    for i, data in enumerate(archives):
        (folder / f"{i}.warc.gz").write_bytes(data)
    return spark.createDataFrame([(f"file://{folder}/{i}.warc.gz",) for i in range(len(archives))], "path string")


def test_payloads_of_responses_and_revisits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "REVISIT_ROWS", 3)
    rows = [(i, "u", ("é" * 100 + str(i % 4)) if i % 3 else f"<p>{i}" * 40) for i in range(60)] + [(60, None, None), (None, "u", "é" * 100 + "1"), (1, "again", "other " * 30)]
    manifest = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, PAGES)).repartition(3), f"file://{tmp_path}/a", archive_bytes=2000)
    assert manifest.count() > 3
    got = warc.read_archives(manifest).collect()
    assert sorted((r.page_id or -1, bytes(r.payload)) for r in got) == sorted((i or -1, (h or "").encode()) for i, _, h in rows)
    assert all((r.payload_bytes, r.payload_digest) == (len(r.payload), hashlib.sha256(r.payload).hexdigest()) for r in got)
    assert sum(r.record_type == "revisit" for r in got) == 37
    bare = warc.read_archives(manifest, payloads=False).collect()
    assert {r.payload for r in bare} == {None} and sorted(map(str, (r[:7] for r in bare))) == sorted(map(str, (r[:7] for r in got)))


def _told_length(data, was, told):
    head, http, end = gzip.decompress(data).split(b"\r\n\r\n", 2)
    block = http + b"\r\n\r\n"
    other = block.replace(b"Content-Length: %d" % was, b"Content-Length: %d" % told)
    sha = lambda b: hashlib.sha256(b).hexdigest().encode()
    return gzip.compress(head.replace(sha(block), sha(other)) + b"\r\n\r\n" + other + end)


def test_revisits_are_held_against_their_responses(spark, tmp_path):
    x, y = b"x" * 200, b"y" * 200
    bad = {2: warc.record(2, "u", y, 1), 3: warc.record(3, "u", x, 99), 4: _told_length(warc.record(4, "u", x, 1), 200, 201)}
    good = written((1, "u", x), (6, "u", y))
    for i, data in bad.items():
        folder = tmp_path / str(i)
        folder.mkdir()
        manifest = _archives(spark, folder, written((5, "u", x, 1)) + data, good)
        for payloads in (True, False):
            with pytest.raises(Exception, match="a revisit"):
                warc.read_archives(manifest, payloads=payloads).collect()
            got = {r.page_id: r for r in warc.read_archives(manifest, strict=False, payloads=payloads).collect()}
            assert {*got} == {1, 5, 6, i} and [k for k, r in got.items() if r.error] == [i] and got[i].payload is None
            assert got[5].payload == (x if payloads else None)


def test_archives_are_compressed_once(spark, tmp_path):
    rows = [(1, "u", "x" * 200), (2, "u", "y" * 200)]
    manifest = warc.write_archives(warc.with_revisits(spark.createDataFrame(rows, PAGES)).coalesce(1), f"file://{tmp_path}/a")
    path, size = manifest.select("path", "bytes").first()
    data = open(path.removeprefix("file://"), "rb").read()
    assert len(data) == size and sorted(r["page_id"] for r in warc.read_records(io.BytesIO(data))) == [1, 2]


def test_names_of_file_systems(monkeypatch):
    asked = []
    monkeypatch.setattr(warc, "pafs", type("fs", (), {"FileSystem": type("f", (), {"from_uri": staticmethod(asked.append)})}))
    for uri in ("s3a://b/x", "s3n://b/x", "s3://b/x", "/a/b", "file:/a/b", "hdfs://h/x"):
        warc._file_system(uri)
    assert asked == ["s3://b/x"] * 3 + ["file:///a/b"] * 2 + ["hdfs://h/x"]
