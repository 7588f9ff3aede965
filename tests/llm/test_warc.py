import hashlib
import io
import struct

import zstandard

from lossweave.llm import warc
from lossweave.runtime import shared_dir


def rows():
    page = lambda k: f"<html><body class='a'>" + f"<p>paragraph {k} of the page</p>" * (k % 7 + 3) + "é</body></html>"
    out = [(k, f"https://host/{k}", page(k)) for k in range(80)]
    out += [(90, "u", page(5)), (91, "u\r\nX: y", page(5)), (95, None, None), (96, "", ""), (97, "s", "short"), (98, "s", "short")]
    return out + [(None, "n", page(5)), (99, "m", "x\r\n\r\nWARC/1.1\r\n" * 20), (99, "m", "x\r\n\r\nWARC/1.1\r\n" * 20)]


def test_round_trip(spark):
    data = rows()
    pages = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages.withColumn("digest", pages.url), shared_dir(spark, "warc"), archive_bytes=20_000)
    got = warc.read_archives(index).collect()
    assert len(got) == len(data) == index.count()
    first = {}
    for number, _, html in data:
        if len((html or "").encode()) >= 100 and number is not None:
            first[html] = min(number, first.get(html, number))
    want = sorted(
        (
            -1 if n is None else n, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(),
            *(("revisit", first[h]) if h in first and first[h] != n else ("response", -1)),
        )
        for n, _, h in data
    )
    have = sorted(
        (-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to)
        for r in got
    )
    assert have == want
    texts = {n: (h or "").encode() for n, _, h in data if n is not None}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response")
    assert index.select("path").distinct().count() > 1


def test_records_stand_alone_behind_the_dictionary(spark):
    pages = spark.createDataFrame(rows()[:80] * 2, "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(pages, shared_dir(spark, "warc"), least_bytes=10**9).collect()
    where, name = warc.filesystem(index[0].path)
    data = where.open_input_file(name).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.DICTIONARY_MAGIC
    trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    for r in (index[0], index[57], index[-1]):
        frame = data[r.offset : r.offset + r.size]
        assert zstandard.get_frame_parameters(frame).dict_id == trained.dict_id() != 0
        text = zstandard.ZstdDecompressor(dict_data=trained).decompress(frame)
        [(fields, _)] = list(warc.parse(io.BufferedReader(io.BytesIO(text))))
        assert fields["warc-record-id"] == f"<urn:page:{r.page_id}>"


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
