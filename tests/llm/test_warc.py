import base64
import gzip
import hashlib
from pathlib import Path

from tablerecon.llm import warc
from tablerecon.llm.common import new_folder


def test_round_trip(spark):
    long = "€x" * 50_000
    rows = [
        (1, "http://a/1", "same"),
        (2, "http://a/2", "same"),
        (3, "http://a/3\r\nX-Evil: 1", "WARC/1.1\r\n\r\nodd\r\n\r\n"),
        (4, None, None),
        (5, "http://a/5", ""),
        (6, "u", long),
        (None, "u", long),
        (None, "u", "alone"),
        (8, "u", "twice"),
        (8, "u", "twice"),
    ]
    pages = spark.createDataFrame([r + ("x",) for r in rows], "page_id long, url string, html string, digest string")
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder, written_at="2024-01-01T00:00:00Z", records_per_file=3)
    archive = warc.read_archives(spark, folder)
    got = sorted(map(tuple, warc.resolved_records(archive).collect()), key=str)
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page is None else page)
    expected = []
    for page, _, html in rows:
        data = (html or "").encode()
        original = best[html or ""]
        response = (-1 if page is None else page) == original
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((page, len(data), digest, "response" if response else "revisit", None if response else original))
    assert got == sorted(expected, key=str)
    # Every payload is stored once, and headers hold no line of a url.
    kept = archive.where("record_type = 'response'")
    assert {bytes(r.payload) for r in kept.collect()} == {(h or "").encode() for _, _, h in rows}
    texts = [gzip.decompress(p.read_bytes()) for p in Path(folder.removeprefix("file:")).glob("*.gz")]
    assert not any(b"\nX-Evil" in t for t in texts)


def test_no_pages_and_a_least_size(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    warc.write_archives(pages.where("false"), folder, written_at="d")
    assert warc.read_archives(spark, folder).count() == 0
    kinds = {r.page_id: r.refers_to for r in warc.resolve(pages, least_bytes=3).collect()}
    assert kinds == {1: None, 2: None, 3: 4, 4: None}
