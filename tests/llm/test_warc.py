import io
import zlib

import pytest
from pyspark.sql import functions as F

from lexquarry.llm import warc


def test_round_trip(spark):
    pages = [(3, "http://a/x y", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "u", None), (5, "u", ""), (4, "u\r\nX: 1", "big" * 100000), (1, "again", "<p>é</p>"), (None, "u", "null id")]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("hash", F.lit(2)).repartition(3)
    got = warc.records(warc.written(d, archive_bytes=200)).collect()
    assert len(got) == 7 and all(r.verified and r.error is None for r in got)
    first = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert first == {(1, "response", None), (3, "revisit", 1), (2, "response", None), (5, "revisit", 2), (4, "response", None), (None, "response", None)}
    by = {(r.page_id, r.record_type): r for r in got}
    assert by[3, "revisit"].payload_bytes == 9 and by[3, "revisit"].payload_digest == warc.digest("<p>é</p>".encode()) and by[3, "revisit"].target == "http://a/x%20y"
    assert bytes(by[4, "response"].payload) == b"big" * 100000 and by[4, "response"].target == "u%0D%0AX:%201"
    assert warc.records(warc.written(d.where("false"))).count() == 0


def read(data):
    return list(warc.rows("a", io.BytesIO(data), True))


def test_broken_archives():
    good = warc.record(1, "u", b"payload", None, False)
    assert [r[2] for r in read(good * 3)] == ["response"] * 3
    out = read(good + good[:-9])
    assert out[0][8] and out[1][10] == "the archive ends inside a member" and out[1][1] == len(good)
    assert read(good + b"junk")[1][10]
    short = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert "content length" in read(short.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nx\r\n\r\n") + short.flush())[0][10]
    plain = zlib.decompress(good, 31).replace(b"payload", b"pAyload")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert read(z.compress(plain) + z.flush())[0][8] is False
    assert read(b"") == []


@pytest.mark.parametrize("size", [0, 1, warc.CHUNK - 1, warc.CHUNK * 3 + 7])
def test_payload_sizes(size):
    data = bytes(i % 251 for i in range(size))
    (r,) = read(warc.record(7, None, data, None, False))
    assert r[9] == data and r[3] == 7
