import zstandard
from hypothesis import given, settings, strategies as st

from gleanery.llm import warc

PAGES = "page_id long, url string, html string, refers_to string, same int"
LONG = "x" * 1000


def test_revisits_nulls_and_repeats(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a/é b", LONG, "clash", 1), (7, None, LONG, None, 2), (3, "http://a\r\nX: y", LONG, None, 3),
            (7, None, LONG, None, 2), (None, "u", LONG, None, 4), (4, "u", "short", None, 5), (5, "u", "short", None, 6),
            (6, "u", None, None, 7), (8, "u", "", None, 8), (9, "u", "é" * 500, None, 9), (2, "u", "é" * 500, None, 9),
        ],
        PAGES,
    )
    found = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.report(pages).collect())
    assert found == sorted(
        [
            ("1", 1000, "revisit", 7), ("3", 1000, "revisit", 7), ("7", 1000, "response", None),
            ("7", 1000, "response", None), ("None", 1000, "response", None), ("4", 5, "response", None),
            ("5", 5, "response", None), ("6", 0, "response", None), ("8", 0, "response", None),
            ("9", 1000, "response", None), ("2", 1000, "revisit", 9),
        ]
    )


def test_no_pages(spark):
    assert warc.report(spark.createDataFrame([], PAGES)).count() == 0


def test_files_hold_a_dictionary_and_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>page {i} of many</p>" * 40) for i in range(300)], "page_id long, url string, html string")
    archives = warc.write_archives(pages.coalesce(1), archive_bytes=60_000).cache()
    assert archives.count() > 3
    uri = f"file://{tmp_path}/archives"
    assert warc.save(archives, uri).count() == warc.save(archives, uri).count() == archives.count()
    read = warc.read_archives(warc.load(spark, uri))
    assert {(r.page_id, bytes(r.payload).decode()) for r in read.collect()} == {(r.page_id, r.html) for r in pages.collect()}
    content = bytes(archives.first().content)
    assert content[:4] == b"\x5d\x2a\x4d\x18"
    size = int.from_bytes(content[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(content[8:8 + size])
    first = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj().decompress(content[8 + size:])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: response")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=3000), min_size=1, max_size=40))
def test_round_trip(records):
    assert list(warc.read_archive(warc.archive(records))) == records
