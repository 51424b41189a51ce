import base64
import hashlib
import io

import zstandard
from pyspark.sql import functions as F

from tracklake.llm import warc


def expected(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(h or "")
        revisit = len(b) >= least and i != ref
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", ref if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://a/{i % 7}\r\nX: y", f"<p>{'é' * (i % 9)} page {i % 13} \r\n\r\n WARC/1.1</p>") for i in range(120)]
ROWS += [(500, None, None), (501, "u", ""), (502, "u", "x" * 3_000_000), (503, "u", "x" * 3_000_000), (504, "u", "x"), (504, "u", "x"), (None, "u", "x"), (505, "u", "P*M\x18\x00\x00\x00\x00" * 50)]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    for least in (0, 30):
        got = sorted((tuple(r)[:5] for r in warc.round_trip(pages, least).collect()), key=str)
        assert got == expected(ROWS, least)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(empty).collect() == []


def test_archives_are_plain_zstandard(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    files = [p for p in (tmp_path / "w").glob("part-*") if p.stat().st_size]
    total = 0
    for p in files:
        data = p.read_bytes()
        assert data[:4] == warc.DICTIONARY_MAGIC
        n = int.from_bytes(data[4:8], "little")
        body = data[8 : 8 + n]
        kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind)).stream_reader(io.BytesIO(data[8 + n :]), read_across_frames=True)
        plain = reader.read()
        total += sum(1 for _ in warc.records_of(data))
        assert plain.startswith(b"WARC/1.1\r\n")
        assert all(b"\r\n" not in h["WARC-Target-URI"].encode() for h, _ in warc.records_of(data) if "WARC-Target-URI" in h)
    assert total == len(ROWS)


def test_archives_are_cut(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, str(tmp_path / "w"), records=10)
    found = {p: list(warc.records_of(p.read_bytes())) for p in (tmp_path / "w").glob("part-*") if p.stat().st_size}
    assert sum(map(len, found.values())) == len(ROWS) and max(map(len, found.values())) == 9 and len(found) >= len(ROWS) / 9
    got = sorted((tuple(r)[:5] for r in warc.read(spark, str(tmp_path / "w")).collect()), key=str)
    assert got == expected(ROWS, 0)


def test_separator_inside_a_frame(monkeypatch):
    assert zstandard.ZstdDecompressor().decompressobj().decompress(warc.SEPARATOR) == b""
    frames = list(warc.frames(iter([warc.record(i, "u", b"z" * i, "D", i, None) for i in range(300)])))
    assert len(frames) == 301 and not any(warc.SEPARATOR in f for f in frames[1:])
    back = list(warc.records_of(warc.SEPARATOR.join(frames)))
    assert [len(b.partition(b"\r\n\r\n")[2]) for _, b in back] == list(range(300))
