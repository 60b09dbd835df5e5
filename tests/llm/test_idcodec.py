import io
from zlib import crc32

import numpy as np
import pytest

pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cairnflow.llm import idcodec  # noqa: E402
from cairnflow.llm._common import shared_dir  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


class Handle(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    skewed = np.minimum(rng.zipf(1.3, 9000), 50256).astype(np.uint16)
    cases = [[7] * 4096, list(range(4096)), rng.integers(0, 65536, 4096), skewed[:4096], [65535, 0] * 2048, skewed[4096:8000], [3], []]
    blocks = [np.array(c, np.uint16) for c in cases]
    order0 = idcodec.Order0.unpack(idcodec.Order0.of(np.concatenate(blocks)).pack())
    payloads = idcodec.encode_blocks(blocks, order0)
    back = idcodec.decode_blocks(payloads, [len(b) for b in blocks], order0)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert len(payloads[0]) < 400 and len(payloads[3]) < 2 * 4096 * 0.8
    alone = idcodec.decode_blocks([payloads[3]], [4096], order0)  # each block decodes without the others
    assert (alone[0] == blocks[3]).all()


def test_any_ids(monkeypatch):
    """Large ids, more different ones than a chunk's table takes, documents over several chunks, chunks read apart."""
    monkeypatch.setattr(idcodec, "LANES", 3)
    monkeypatch.setattr(idcodec, "BLOCK", 64)
    monkeypatch.setattr(idcodec.Order0, "MOST", 50)
    rng = np.random.default_rng(5)
    docs = [(i, rng.integers(0, 2**32 if i % 2 else 40, int(n), dtype=np.uint64).astype(np.uint32)) for i, n in enumerate(rng.integers(1, 900, 40))]
    docs += [(50, np.array([2**32 - 1, 0, 70000] * 400, np.uint32)), (51, np.array([0], np.uint32))]
    out = Handle()
    writer = idcodec._Writer(out)
    for d, ids in docs:
        writer.add(d, ids)
    total, size, chunks = writer.close()
    assert (total, size) == (sum(len(i) for _, i in docs), len(out.getvalue())) and chunks == -(-total // (3 * 64))
    handle, start = Handle(out.getvalue()), 0
    got = list(idcodec.read_file(handle))
    assert [x for c in reversed(range(chunks)) for x in [d for d, _, _ in idcodec.read_file(handle, c)][::-1]] == [d for d, _ in docs][::-1]
    for (d, ids), (e, at, back) in zip(docs, got, strict=True):
        assert d == e and at == start and (ids == back).all()
        start += len(ids)


def test_damage_is_found(monkeypatch):
    monkeypatch.setattr(idcodec, "BLOCK", 256)
    out = Handle()
    writer = idcodec._Writer(out)
    writer.add(5, list(range(600)))
    writer.add(None, [0])
    writer.close()
    data = out.getvalue()
    assert [(d, len(i)) for d, _, i in idcodec.read_file(Handle(data))] == [(5, 600), (None, 1)]
    for place in [*range(0, len(data), 97), *range(len(data) - 24, len(data))]:
        spoiled = bytearray(data)
        spoiled[place] ^= 255
        with pytest.raises(ValueError):
            list(idcodec.read_file(Handle(bytes(spoiled))))


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(9, "Hello world", "a"), (2, None, "b"), (None, "no id", "c"), (4, "", "d"), (7, "é😀 <|endoftext|> x" * 3000, "e"), (4, "again", "f"), (4, "again", "f")]
    rows += [(100 + i, f"text {i} " * i, "z") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = idcodec.read(idcodec.write(docs, f"{shared_dir(spark)}/ids-test", PATH)).orderBy("start").collect()
    library = Tokenizer.from_file(PATH)
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 0
        assert r["ids_crc32"] == crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    want = sorted([*library.encode(t or "", add_special_tokens=False).ids, 0] for _, t, _ in rows)
    assert sorted(r["ids"] for r in got) == want
    assert idcodec.round_trip(docs.limit(0), PATH).count() == 0


def test_splits_are_the_library_s(spark):
    """Every character of the fast path in four surroundings, and runs of blanks and signs, split and encode as the library does."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    chars = [chr(c) for c in [*range(0x530), *range(0x2000, 0x2070)]]
    texts = [f"a{c}b {c} 1{c}2{c}{c}x  {c}\n{c}" for c in chars]
    texts += ["it's we'll I'D 're''s  x", "a  b\n\n c\t ", "   ", " \u00a0 x\u2003\u2003y", "x\u3000y", "<|endoftext|> a", "\u06f1\u4e2d\U0001f600 z", "é" * 50, "don't  \r\n stop 12 345.6 ...", ""]
    with open(PATH, encoding="utf-8") as f:
        fast = idcodec._split_by_jvm(f.read())
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)
    rows = df.select("i", "text", F.when(fast, F.regexp_extract_all("text", F.lit(idcodec.SPLIT), F.lit(0))).alias("p")).orderBy("i").collect()
    assert sum(r["p"] is not None for r in rows) == len(texts) - 3  # the ideographic space, the special token, the emoji
    for r in rows:
        if r["p"] is not None:
            assert "".join(r["p"]) == r["text"]
            want = [r["text"][s:e] for _, (s, e) in library.pre_tokenizer.pre_tokenize_str(r["text"])]
            assert r["p"] == want, r["text"]
    got = idcodec.read(idcodec.write(df.select(F.col("i").cast("long").alias("doc_id"), "text"), f"{shared_dir(spark)}/ids-split", PATH)).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_numpy_splits_as_the_library():
    """Random texts of the characters that matter, with neighbours in the same buffer, split as the library splits each alone."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(PATH), np.random.default_rng(11)
    signs = ["'", "'", "s", "t", "re", "ll", "ve", "a", "Z", " ", " ", "\n", "\t", "1", "²", "!", "é", " ", "\u0085", " ", "…", "ж", "́", ""]
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 12, 4000)]
    column = pa.array(texts)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(texts) + 1)
    raw = column.buffers()[2].to_pybytes()[: offsets[-1]]
    begins = idcodec._Splitter()(raw + bytes(3), offsets)
    for text, low, high in zip(texts, offsets, offsets[1:], strict=False):
        cuts = [*begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)], high]
        assert [raw[a:b].decode() for a, b in zip(cuts, cuts[1:], strict=False)] == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_runs_of_ids_are_coded_in_one_step(monkeypatch):
    """Frequent runs and pairs take one step; they come back whole where blocks, chunks and forgotten runs cut them."""
    monkeypatch.setattr(idcodec, "LANES", 4)
    monkeypatch.setattr(idcodec, "BLOCK", 256)
    rng, out = np.random.default_rng(2), Handle()
    writer, want = idcodec._Writer(out), []
    for d in range(12):
        if d == 7:
            writer.restart(idcodec.Runs())
        runs = [np.array(r, np.uint32) for r in ([5], [1, 2, 3], [9, 2**32 - 1, 9, 9, 8], list(range(100, 300)))]
        numbers = writer.runs.add(np.concatenate(runs), np.array([len(r) for r in runs]))
        chosen = rng.choice(4, 60, p=[0.3, 0.4, 0.28, 0.02])
        ids = np.r_[np.concatenate([runs[i] for i in chosen]), np.tile(np.array([40, 41, 40], np.uint32), 30)]
        items = np.r_[numbers[chosen], -1 - np.tile([40, 41, 40], 30)]
        writer.extend([d], items, [len(ids)])
        want.append(ids)
    writer.close()
    assert sum(b[4] for b in writer.blocks) < 0.7 * sum(b[2] for b in writer.blocks)
    got = list(idcodec.read_file(Handle(out.getvalue())))
    assert [d for d, _, _ in got] == list(range(12)) and all((a == b).all() for a, (_, _, b) in zip(want, got, strict=True))


def test_more_ids_and_runs_than_places():
    """Runs and ids share a chunk's table; ids without a place are escaped, and all come back."""
    rng, out = np.random.default_rng(8), Handle()
    writer = idcodec._Writer(out)
    numbers = writer.runs.add(rng.integers(0, 60000, 60000).astype(np.uint32), np.full(30000, 2))
    items = np.r_[np.tile(numbers, 4), -1 - np.arange(60000), -1 - np.tile(np.arange(20000), 3)]
    want = -1 - writer.runs.spelled(items, np.ones(len(items), bool))
    writer.extend([1], items, [len(want)])
    writer.close()
    ((_, _, ids),) = idcodec.read_file(Handle(out.getvalue()))
    assert (ids == want).all()
