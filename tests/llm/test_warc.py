"""op13: round trips of archives, plain readings of the files, damaged files."""

import gzip
import hashlib
import io
import zlib
from pathlib import Path

import pytest

from veilspan.llm import warc

PAGES = "page_id long, url string, html string"
BIG, SAME = "<p>große Seite\r\n\r\n</p>" * 60, "<p>same</p>" * 100


def pages():
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>" * (i % 7 * 50)) for i in range(60)]
    rows += [(100 + i, "http://b/%20 x", SAME) for i in range(9)] + [(200, "http://c\r\nWARC-Type: resource", BIG), (201, None, BIG), (201, "u", BIG)]
    return rows + [(300, "u", None), (301, "u", ""), (302, "u", "x" * 999), (303, "u", "x" * 999), (304, "u", "x" * 1000), (305, "u", "x" * 1000), (None, "u", SAME), (None, "u", "n" * 2000), (None, "u", "n" * 2000), (400, "u", "y" * 3_000_000)]


def plain(rows):
    keeper = {}
    for i, _, html in rows:
        if len((html or "").encode()) >= 1000 and i is not None:
            keeper[html] = max(keeper.get(html, i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = keeper.get(html)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if to in (None, i) else "revisit", None if to in (None, i) else to))
    return sorted(out, key=repr)


def test_equals_plain(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], f"{PAGES}, digest string, size int").repartition(3)
    got = warc.write_and_read(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=repr) == plain(pages())
    assert warc.write_and_read(df.limit(0)).collect() == []


def test_archives_are_members_behind_an_index(spark, tmp_path):
    rows = pages()
    streams, folder = f"file://{tmp_path}/s", f"file://{tmp_path}/a"
    warc.write_streams(spark.createDataFrame(rows, PAGES).repartition(3), streams)
    for f in Path(tmp_path, "s").glob("*.gz"):
        d = zlib.decompressobj(31)
        d.decompress(f.read_bytes())
        assert d.eof and not d.unused_data  # one stream for the whole file
    told = warc.normalise(spark, streams, folder).collect()
    assert sum(r.n_records for r in told) == len(rows)
    lines = {(r.archive, r.offset): r for r in warc.index(spark, folder).collect()}
    assert len(lines) == len(rows)
    for (archive, offset), r in lines.items():
        raw = Path(tmp_path, "a", archive).read_bytes()
        record = gzip.decompress(raw[offset : offset + r.length])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"WARC-Record-ID: {r.record_id}\r\n".encode() in record
    got = warc.read(spark, folder).collect()
    want = {(i, url, html or "") for i, url, html in rows}
    assert {(r.page_id, r.url, r.payload) for r in got if r.record_type == "response"} <= want
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(i), str(url)) for i, url, _ in rows)
    assert not [p for p in Path(tmp_path, "a").iterdir() if p.name.startswith("_")]
    warc.normalise(spark, streams, folder)  # again: the same archives
    assert warc.index(spark, folder).count() == len(rows)


@pytest.mark.parametrize("damage", [lambda b: b[:-9], lambda b: gzip.compress(gzip.decompress(b)[:-3]), lambda b: gzip.compress(gzip.decompress(b)[:-4] + b"more\r\n\r\n"), lambda b: gzip.compress(gzip.decompress(b) + b"WARC/1.1\r\n")])
def test_damaged_streams_are_errors(damage):
    record = b"WARC/1.1\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    whole = gzip.compress(record * 3)
    assert len(list(iter(warc._Stream(io.BytesIO(whole)).record, None))) == 3
    assert len(list(iter(warc._Stream(io.BytesIO(gzip.compress(record) * 3)).record, None))) == 3  # of several members
    with pytest.raises(ValueError):
        list(iter(warc._Stream(io.BytesIO(damage(whole))).record, None))


def test_a_changed_payload_is_an_error(spark, tmp_path):
    streams, folder = f"file://{tmp_path}/s", f"file://{tmp_path}/a"
    warc.write_streams(spark.createDataFrame([(1, "u", "abc")], PAGES).coalesce(1), streams)
    warc.normalise(spark, streams, folder)
    (archive,) = Path(tmp_path, "a").glob("*.warc.gz")
    changed = gzip.compress(gzip.decompress(archive.read_bytes()).replace(b"abc", b"abd"))
    archive.write_bytes(changed)
    (index,) = Path(tmp_path, "a").glob("*.idx")
    name, at, _, record = index.read_text().split("\t")
    index.write_text(f"{name}\t{at}\t{len(changed)}\t{record}")
    Path(tmp_path, "a", f".{index.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not what its header says"):
        warc.read(spark, folder).collect()
