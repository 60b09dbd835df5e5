import random
from array import array
from hashlib import sha256

import pytest

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")

from cairnflow.llm import bpe  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def codec(tokens):
    return bpe.Codec(bpe.PerfectHash(tokens), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokens):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_perfect_hash_is_minimal(tokens):
    table = bpe.PerfectHash(tokens)
    assert sorted(table.slots) == list(range(len(tokens)))
    assert [table.find(t) for t in tokens] == list(range(len(tokens)))
    assert table.find(b"no such entry at all") == -1


def test_equals_library(codec, library):
    rng = random.Random(1)
    texts = ["", " ", "\n\n  x", "don't we'll I'm", "a" * 5000, "ab " * 2000, "naïve Übergröße 東京 😀👍🏽", "<|endoftext|> \x00\x1c\x1d\x85　x", "１２ ３٤", "\t\r\n   y"]
    texts += ["".join(chr(rng.choice([32, 10, 9, 0x1C, 0x85, 0xA0, 39, 48, 57, 65, 97, 0xE9, 0x4E00, 0x1F600, 0x300, 0x2028])) for _ in range(rng.randrange(200))) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_every_character(codec, library):
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]):
        text = f"a{c}  {c}b"
        assert codec.encode(text) == library.encode_ordinary(text), hex(ord(c))


def test_query_cases(spark, library):
    rows = [(1, None, "x"), (1, "", "x"), (None, "Hello  world", None), (2, "q" * 30000, "y"), (2, "Hello  world", "y"), (2, "Hello  world", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.digests(docs, PATH).collect()), key=repr)
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha256(array("I", ids).tobytes()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    back = bpe.decode(bpe.encode(docs.where("doc_id = 2"), PATH), PATH)
    assert {r["text"] for r in back.collect()} == {"q" * 30000, "Hello  world"}
