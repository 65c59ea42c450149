"""Archives: written and read back, sought by record, and as plain Zstandard and WARC."""

import base64
import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from actfold.llm import warc
from actfold.llm.common import Scratch

PAGES = "page_id long, url string, html string"


def pages(n=300):
    rng = random.Random(5)
    common = "<p>same</p>" * 50
    rows = []
    for i in range(n):
        html = common if i % 3 == 0 else None if i % 20 == 1 else "" if i % 20 == 2 else f"<p>é漢 {rng.randint(0, 60)}</p>\r\n\r\nWARC/1.1\r\n" * rng.randint(1, 40)
        rows.append((i if i % 50 != 7 else None, f"http://x/{i}?q=\r\n é" if i % 9 else None, html))
    return [*rows, *rows[:12]]


def wanted(rows):
    first, out = {}, []
    for pid, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (html or "").encode()
        kind, ref = ("revisit", first[raw]) if raw in first else ("response", None)
        first.setdefault(raw, pid)
        out.append((pid, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, ref))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"frame_bytes": 1, "bundle_bytes": 500}, {"frame_bytes": 3000, "bundle_bytes": 4000}, {}])
def test_records_come_back(spark, sizes):
    rows = pages()
    df = spark.createDataFrame([(*r, "x") for r in rows], PAGES + ", URL string").repartition(4)
    assert sorted(map(tuple, warc.page_records(df, **sizes).collect()), key=str) == wanted(rows)


def test_edges(spark):
    assert warc.page_records(spark.createDataFrame([], PAGES)).collect() == []
    long = "long text " * 1_000_000
    df = spark.createDataFrame([(1, "u", long), (2, "u", long), (3, "u", None)], PAGES)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_records(df).collect()}
    assert got == {1: (10_000_000, "response", None), 2: (10_000_000, "revisit", 1), 3: (0, "response", None)}
    text = spark.createDataFrame([("a b/é", "u", "x")], "page_id string, url string, html string")
    assert warc.page_records(text).first().page_id == "a b/é"


def test_archives_are_plain_zstandard_and_have_every_record_once(spark, tmp_path):
    rows = pages(80)
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), str(tmp_path / "a"), frame_bytes=2000)
    places = {(r.file, r.frame, r.offset): r for r in index.collect()}
    seen = []
    for path in sorted((tmp_path / "a").iterdir()):
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(path.read_bytes()), read_across_frames=True) as z:
            whole = z.read()
        archive, parts = warc.Frames(str(path)), []
        for k in range(len(archive.places)):
            frame = archive[k]
            parts.append(frame)
            seen += [(str(path), k, at, n, f["warc-type"], f["warc-record-id"]) for at, n, f, _ in warc.records(frame) if f["warc-type"] != "warcinfo"]
        assert whole == b"".join(parts)
    assert {(f, k, at): (n, t, i) for f, k, at, n, t, i in seen} == {p: (r.length, r.record_type, r.record_id) for p, r in places.items()}
    assert len({s[5] for s in seen}) == len(rows)


def test_fetch_reads_wanted_records_only(spark, tmp_path):
    rows = pages(60)
    index = warc.write_archives(spark.createDataFrame(rows, PAGES), str(tmp_path / "b"), frame_bytes=500)
    ids = [0, 3, 4, 21, 999, None, 3]
    got = warc.fetch(index, spark.createDataFrame([(i,) for i in ids], "page_id long")).collect()
    want = sorted((str(p), (h or "").encode()) for p, _, h in rows if p in (0, 3, 4, 21))
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == want


def test_damage_is_seen(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "abc")], PAGES), str(tmp_path / "c"))
    path = tmp_path / "c" / next(iter((tmp_path / "c").iterdir())).name
    raw = bytearray(path.read_bytes())
    raw[-45] ^= 0xFF
    path.write_bytes(raw)
    with pytest.raises(Exception, match=r"(?s)zstd|frame|Zstd"):
        warc.read_archives(index.withColumn("file", F.lit(str(path)))).collect()
    with pytest.raises(ValueError):
        warc.opened({"warc-type": "response", "warc-payload-digest": "sha1:X", "warc-record-id": "r", "warc-target-uri": "u"}, b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\na", True)


def test_strays_of_lost_tasks_are_not_read(spark, tmp_path):
    index = warc.write_archives(spark.createDataFrame([(1, "u", "abc"), (2, "u", "d")], PAGES), str(tmp_path / "d"), work=Scratch(spark))
    (tmp_path / "d" / "000000-stray.warc.zst").write_bytes(b"half a file")
    assert sorted(r.page_id for r in warc.read_archives(index).collect()) == ["1", "2"]
