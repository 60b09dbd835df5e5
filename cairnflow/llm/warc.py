"""WARC archives: writing pages as gzip members, and a splittable reader of these and of other archives.

Writer tasks store one archive per partition in the shared folder, under a name that holds the partition's number: a task
that runs again replaces its file. Equal payloads of at least MIN_REVISIT bytes are stored once; later copies are revisit
records. Reader tasks take byte ranges. A task scans its range for the gzip magic, takes a candidate for a member only if
it inflates to a WARC version line and complete headers, and owns the records whose first byte lies in its range; from
its first record on, each member's end is the next one's start, and bytes that are no member there are an error. Every
record carries its member's place and length: whole() holds their sum against the archive's size, so that damage at a
range's start, which looks like chance magic to the range's own task, is an error too.

Other archives' records may be of any type, with header names in any case and ids of any form; page_id and refers_to are
null where an id isn't of ours. Payloads are held against digests of SHA-256 (hexadecimal) and SHA-1 (base 32), but for
bodies in a transfer coding.

Files are opened by pyarrow.fs for every scheme it knows, and as local paths for file:.

Defined cases: a null html is an empty payload; a very long one is one member, inflated a piece at a time but held whole; a
null url is an empty target; a null page_id is kept and never preferred as the first of equal payloads; rows with equal
page_id and payload are all responses if theirs is the least id (their records then share an id); no rows give no archives
and no records; other columns, of any name, are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import cut, join_checked, remove, shared_dir

MIN_REVISIT, SPLIT_BYTES, LEVEL = 100, 4 << 20, 4
MAGIC = b"\x1f\x8b\x08"
RECORD = (
    "path string, offset long, length long, record_id string, page_id long, url string, record_type string, refers_to long, "
    "refers_to_id string, payload_bytes long, payload_digest string, payload binary"
)
_OWN_ID = re.compile(r"<urn:page:(?:none|(-?[0-9]+)):[0-9a-f]{64}(?::revisit)?>")


def open_fs(path: str):
    """A pyarrow file system and the path within it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses)."""
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    firsts = cut(
        rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    rows = join_checked(rows, firsts, "payload_digest", "left")
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _clean(url: str | None) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url or "")


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record, uncompressed."""
    name = lambda x: f"<urn:page:{'none' if x is None else x}:{digest}"
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id) + (">" if refers_to is None else ":revisit>")), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", _clean(url))]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(size))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        head += [("WARC-Refers-To", name(refers_to) + ">"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        payload = b""
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(http) + len(payload)))]
    return b"".join([b"WARC/1.1\r\n", "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass"), b"\r\n", http, payload, b"\r\n\r\n"])


def _headers(block: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    found: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "surrogateescape").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            found[last] = value.strip()
    return found


def parse(data: bytes) -> dict | None:
    """The fields of a record, or None if data is none; ValueError for a record that is cut short or belies its digest."""
    from base64 import b32encode
    from hashlib import sha1, sha256

    if not data.startswith(b"WARC/"):
        return None
    top, sep, body = data.partition(b"\r\n\r\n")
    head = _headers(top.partition(b"\r\n")[2])
    if not sep or not {"warc-type", "warc-record-id", "content-length"} <= head.keys():
        return None
    size = int(head["content-length"])
    if len(body) < size:
        raise ValueError(f"{head['warc-record-id']} is cut short")
    block, kind = body[:size], head["warc-type"].lower()
    payload, coded = block, False
    if "http" in head.get("content-type", "").lower():
        http, _, payload = block.partition(b"\r\n\r\n")
        coded = "transfer-encoding" in _headers(http)
    stored = kind != "revisit"
    algorithm, _, given = head.get("warc-payload-digest", "").partition(":")
    algorithm = algorithm.lower().replace("-", "")
    digest = sha256(payload).hexdigest() if stored else None
    if stored and not coded:
        belied = algorithm == "sha256" and len(given) == 64 and given.lower() != digest
        belied |= algorithm == "sha1" and len(given) == 32 and given.upper() != b32encode(sha1(payload).digest()).decode()
        belied |= "x-payload-length" in head and int(head["x-payload-length"]) != len(payload)
        if belied:
            raise ValueError(f"the payload of {head['warc-record-id']} is not what its header says")
    length = int(head["x-payload-length"]) if "x-payload-length" in head else len(payload) if stored else None
    page = lambda x: int(m[1]) if x and (m := _OWN_ID.fullmatch(x)) and m[1] else None
    refers = head.get("warc-refers-to")
    return {
        "record_id": head["warc-record-id"], "page_id": page(head["warc-record-id"]), "url": head.get("warc-target-uri", "").strip("<>"), "record_type": kind, "refers_to": page(refers), "refers_to_id": refers,
        "payload_bytes": length, "payload_digest": digest if stored else given.lower() if algorithm == "sha256" else given or None, "payload": payload if stored else None,
    }


def write(pages: DataFrame, folder: str, level: int = LEVEL, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write pages as archives into folder. Returns a cut table: path, bytes, records, one row per archive."""

    def run(batches: Iterator) -> Iterator:
        import os
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        path, n, size, out = f"{top}/part-{task.partitionId():06d}.warc.gz", 0, 0, None
        own = f"{path}.{task.taskAttemptId()}.{os.getpid()}"
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out = out or fs.open_output_stream(own, compression=None)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = packer.compress(record(*row)) + packer.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
        if out:
            out.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{task.partitionId():06d}.warc.gz"]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], ["path", "bytes", "records"])

    return cut(with_roles(pages, min_revisit).select("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "path string, bytes long, records long"))


def members(handle, size: int, start: int, end: int, block: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(place, length, inflated record) of a gzip file's members whose first byte lies in [start, end)."""
    import zlib

    def inflate(at: int):
        """The member at a position and where it ends, or None if none starts there."""
        packer, got, known, pos = zlib.decompressobj(31), [], b"", at
        while not packer.eof:
            handle.seek(pos)
            data = handle.read(min(block, size - pos))
            if not data:
                return None
            try:
                got.append(packer.decompress(data))
            except zlib.error:
                return None
            pos += len(data)
            if len(known) < 5:
                known = b"".join(got)[:5]
                if known and not b"WARC/".startswith(known):
                    return None
        return b"".join(got), pos - len(packer.unused_data)

    def is_record(data: bytes) -> bool:
        try:
            return parse(data) is not None
        except ValueError:
            return True  # one that is damaged, which its reader says

    at, found = start, None
    while at < end and found is None:  # the first member that starts in the range
        handle.seek(at)
        window = handle.read(min(block, end - at + len(MAGIC) - 1, size - at))
        k = window.find(MAGIC)
        while k >= 0 and at + k < end:
            found = inflate(at + k)
            if found and is_record(found[0]):
                at += k
                break
            found, k = None, window.find(MAGIC, k + 1)
        if found is None:
            at += max(len(window) - len(MAGIC) + 1, 1)
    while found is not None:
        yield at, found[1] - at, found[0]
        at = found[1]
        if at >= end or at >= size:
            return
        found = inflate(at)
        if found is None:
            raise ValueError(f"no gzip member at byte {at} of {size}")


def read(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of archives (path, bytes): see RECORD. Damage within a range is an error; whole() finds damage between ranges."""
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))
    splits = archives.select("path", "bytes", F.explode(cuts).alias("start"))
    splits = splits.repartition(max(1, min(int(splits.count()), 65536)))  # dealt in turn: tasks of equal size

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        types = [kinds[x.split()[1]] for x in RECORD.split(", ")]
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, types, strict=True)], names)
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                fs, at = open_fs(path)
                rows, held = [], 0
                with fs.open_input_file(at) as handle:
                    for place, length, data in members(handle, size, start, min(start + split_bytes, size)):
                        try:
                            x = parse(data)
                        except ValueError as e:
                            raise ValueError(f"{path}, byte {place}: {e}") from None
                        if x is None:
                            raise ValueError(f"{path}, byte {place}: a member that is no record")
                        x |= {"path": path, "offset": place, "length": length, **({} if with_payload else {"payload": None})}
                        rows.append(x)
                        held += len(data)
                        if held > 16 << 20:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    return splits.mapInArrow(run, RECORD)


def whole(archives: DataFrame, records: DataFrame) -> None:
    """Raise ValueError if records (a cut of read()'s) don't cover each archive (path, bytes) to the byte, or miss a count (records, where archives have it)."""
    counted = "records" in archives.columns
    found = records.groupBy("path").agg(F.sum("length").alias("_bytes"), F.count(F.lit(1)).alias("_records"))
    off = F.coalesce("_bytes", F.lit(0)) != F.col("bytes")
    if counted:
        off |= F.coalesce("_records", F.lit(0)) != F.col("records")
    first = archives.join(found, "path", "left").where(off).first()
    if first:
        raise ValueError(f"{first['path']}: records cover {first['_bytes']} of {first['bytes']} bytes")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages as archives into the shared folder and read them back, whole. The records, without payloads, are kept; the archives go."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write(pages, folder)
    records = cut(read(spark, archives, with_payload=False).drop("payload", "url"))
    whole(archives, records)
    remove(spark, folder)
    return records
