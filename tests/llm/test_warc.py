import hashlib
import random
import zlib

import pytest

from cairnflow.llm import warc
from cairnflow.llm._common import shared_dir


def test_round_trip(spark, tmp_path):
    rng = random.Random(4)
    big = "".join(rng.choice("abcdefghij<>é😀 \n") for _ in range(300000))
    copy = "<p>" + "copy " * 40
    rows = [(i, f"http://x/{i}", "".join(rng.choice("abc \x1f") for _ in range(rng.randrange(400))), "e") for i in range(60)]
    rows += [(100, "u\r\nX: y", copy, "e"), (90, None, copy, "e"), (None, "n", copy, "e"), (90, "again", copy, "e"), (101, "s", "small", "e"), (102, "s", "small", "e"), (103, "b", big, "e"), (104, "nul", None, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write(pages, f"{shared_dir(spark)}/warc-test")
    first = {}
    for i, _, html, _ in rows:
        if html and len(html.encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, url, html, _ in rows:
        data = (html or "").encode()
        to = first.get(html) if first.get(html) != i else None
        want.append((i, "revisit" if to is not None else "response", to, len(data), hashlib.sha256(data).hexdigest(), None if to is not None else data))
    for split in (1 << 22, 1000, 17):  # many ranges hold no start of a record
        if split == 17:
            archives = archives.where("bytes < 20000")
            ids = {r["page_id"] for r in warc.read(spark, archives).collect()}
            assert {r["page_id"] for r in warc.read(spark, archives, split).collect()} == ids
            continue
        got = warc.read(spark, archives, split).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload").collect()
        assert sorted((tuple(r) for r in got), key=repr) == sorted(((*w[:5], None if w[5] is None else bytearray(w[5])) for w in want), key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_false_magic_is_no_member(tmp_path):
    inner = zlib.compressobj(6, zlib.DEFLATED, 31)
    decoy = inner.compress(b"not an archive") + inner.flush()
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the decoy's bytes appear as they are
    data = warc.record(7, "u", decoy * 3 + warc.MAGIC, len(decoy) * 3 + 3, "0" * 64, None)
    member = packer.compress(data) + packer.flush()
    path = tmp_path / "x.warc.gz"
    path.write_bytes(member * 2)
    n = 2 * len(member)
    with path.open("rb") as f:
        whole = list(warc.members(f, n, 0, n))
        assert whole == [(0, n // 2, data), (n // 2, n // 2, data)]
        for cut in range(1, n, 37):
            assert len([*warc.members(f, n, 0, cut)] + [*warc.members(f, n, cut, n)]) == 2


def packed(*parts: bytes) -> bytes:
    out = b""
    for p in parts:
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += packer.compress(p) + packer.flush()
    return out


def foreign(kind, name, block, *more, version="1.0"):
    head = [f"WARC/{version}", f"warc-type: {kind}", f"WARC-RECORD-ID:<urn:uuid:{name}>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"content-length:  {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(spark, path, data):
    path.write_bytes(data)
    return spark.createDataFrame([(str(path), len(data))], "path string, bytes long")


def test_archives_of_others(spark, tmp_path):
    from base64 import b32encode

    body = b"<html>hello</html>"
    sha1 = b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    coded = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n0\r\n\r\n"
    records = [
        foreign("warcinfo", "a", b"software: x\r\n", "Content-Type: application/warc-fields"),
        foreign("response", "b", http, "WARC-Target-URI: <http://x/>", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1}", version="1.1"),
        foreign("request", "c", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("response", "d", coded, "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha1}", "X-Folded: one", "  two"),
        foreign("revisit", "e", http[:-len(body)], "WARC-Refers-To:<urn:uuid:b>", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{sha1}"),
        foreign("resource", "f", b"", "Content-Type: text/plain"),
    ]
    archives = archive(spark, tmp_path / "x.warc.gz", packed(*records))
    for split in (1 << 20, 64):
        got = warc.read(spark, archives, split)
        warc.whole(archives, got)
        rows = sorted(got.collect(), key=lambda r: r["offset"])
        assert [r["record_type"] for r in rows] == ["warcinfo", "response", "request", "response", "revisit", "resource"]
        assert {r["page_id"] for r in rows} == {None} and rows[4]["refers_to_id"] == "<urn:uuid:b>" and rows[1]["url"] == "http://x/"
        assert bytes(rows[1]["payload"]) == body and rows[1]["payload_digest"] == hashlib.sha256(body).hexdigest() and rows[1]["payload_bytes"] == len(body)
        assert rows[4]["payload"] is None and bytes(rows[5]["payload"]) == b""


def test_damage_is_an_error(spark, tmp_path):
    parts = [packed(warc.record(i, "u", bytes([65 + i]) * 300, 300, hashlib.sha256(bytes([65 + i]) * 300).hexdigest(), None)) for i in range(5)]
    whole = b"".join(parts)
    third = len(parts[0]) + len(parts[1])
    flipped = whole[: third + 40] + bytes([whole[third + 40] ^ 255]) + whole[third + 41 :]
    gone = whole[:third] + b"\0" * 4 + whole[third + 4 :]  # no magic where the third record starts
    wrong = b"".join(parts[:2]) + packed(warc.record(9, "u", b"x" * 300, 300, "0" * 64, None)) + parts[3]
    for name, data in (("flipped", flipped), ("cut", whole[:-20]), ("gone", gone), ("wrong", wrong), ("tail", whole + b"\0" * 100)):
        archives = archive(spark, tmp_path / f"{name}.warc.gz", data)
        for split in (1 << 20, third, 50):
            with pytest.raises(Exception, match=r"no gzip member|records cover|cut short|not what its header"):
                warc.whole(archives, warc.read(spark, archives, split))
    archives = archive(spark, tmp_path / "good.warc.gz", whole)
    warc.whole(archives, warc.read(spark, archives, 50))
    with pytest.raises(ValueError, match="records cover"):
        from pyspark.sql import functions as F

        warc.whole(archives.withColumn("records", F.lit(6)), warc.read(spark, archives))
