"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the vocabulary's pattern. Tier one resolves whole pre-tokens that are vocabulary entries by a minimal
perfect hash: one slot per entry, confirmed by its bytes. Tier two merges what is left: bytes in a linked list, adjacent
pairs in a heap by rank, so a pre-token of n bytes takes O(n log n) however long it is. Resolved pre-tokens are kept in a
bounded memo per worker process. The driver reads the rank file and broadcasts the tables, whose size is that of the vocabulary.

Defined cases: a null text is empty and gives no ids; special tokens are ordinary text; repeated rows give repeated
results; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches

MEMO = 300_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by id."""
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0 to {len(ranks) - 1}")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash over byte strings: a key's bucket has a displacement that moves all its keys to free slots."""

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        from xxhash import xxh3_64_intdigest as digest

        n = self.n = max(len(keys), 1)
        self.buckets = -(-n // per_bucket)
        grouped: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            h = digest(key)
            grouped[h % self.buckets].append((h, i))
        self.move, self.slots, taken = [0] * self.buckets, [-1] * n, bytearray(n)
        for b in sorted(range(self.buckets), key=lambda b: -len(grouped[b])):
            d = 0
            while grouped[b]:
                at = [self._slot(h, d) for h, _ in grouped[b]]
                if len(set(at)) == len(at) and not any(taken[x] for x in at):
                    for x, (_, i) in zip(at, grouped[b], strict=True):
                        taken[x], self.slots[x] = 1, i
                    break
                d += 1
            self.move[b] = d
        self.keys = keys

    @classmethod
    def of(cls, state: dict) -> PerfectHash:
        """From vars() of another: broadcasts hold plain values, as executors need no copy of this package."""
        table = cls.__new__(cls)
        vars(table).update(state)
        return table

    def _slot(self, h: int, d: int) -> int:
        return (((h >> 20) ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93 >> 29 & 0xFFFFFFFF) % self.n

    def find(self, key: bytes) -> int:
        """The key's index, or -1."""
        from xxhash import xxh3_64_intdigest as digest

        h = digest(key)
        i = self.slots[self._slot(h, self.move[h % self.buckets])]
        return i if i >= 0 and self.keys[i] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all adjacent pairs that are entries, the one of least rank (leftmost first) merges, until none is left.

    The heap holds rank << 40 | start; a popped entry counts only if the pair at its start still has that rank.
    """
    n, rank_of = len(piece), ranks.get
    end, before = [*range(1, n + 1), n], list(range(-1, n))  # of the part that starts here; of a merged one, end is 0
    pair = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    heap = [r << 40 | i for i, r in enumerate(pair) if r >= 0]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFFFF
        if pair[i] != top >> 40:
            continue  # one of the two has merged since
        j = end[i]
        stop = end[i] = end[j]
        pair[j], before[stop] = -1, i
        pair[i] = r = rank_of(piece[i : end[stop]], -1) if stop < n else -1
        if r >= 0:
            heappush(heap, r << 40 | i)
        p = before[i]
        if p >= 0:
            pair[p] = r = rank_of(piece[p:stop], -1)
            if r >= 0:
                heappush(heap, r << 40 | p)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Codec:
    """Encoder and decoder over a table of tokens and a splitting pattern."""

    def __init__(self, table: PerfectHash, pattern: str):
        import regex

        self.table, self.split, self.memo = table, regex.compile(pattern).findall, {}
        self.ranks = {t: i for i, t in enumerate(table.keys)}  # of parts, in merges

    def _resolve(self, word: str) -> tuple[int, ...]:
        piece = word.encode("utf-8", "surrogatepass")
        whole = self.table.find(piece)
        ids = (whole,) if whole >= 0 else tuple(merge(piece, self.ranks))
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(word) < 256:
            self.memo[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        get, out = self.memo.get, []
        for word in self.split(text or ""):
            ids = get(word)
            out += self._resolve(word) if ids is None else ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.keys.__getitem__, ids))


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def worker_codec(name: str, state: dict, pattern: str) -> Codec:
    """The codec of this worker process, which later tasks find again with its (bounded) memo."""
    import sys

    kept = sys.__dict__.setdefault("_cairnflow_codecs", {})
    if name not in kept:
        kept.clear()
        kept[name] = Codec(PerfectHash.of(state), pattern)
    return kept[name]


def _shared_table(spark: SparkSession, path: str):
    bound_batches(spark)
    return spark.sparkContext.broadcast(vars(PerfectHash(read_ranks(path))))


def encode(docs: DataFrame, path: str, pattern: str | None = None, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, ids array<int>, n_tokens, exact (whether the ids decode to the text's bytes)."""
    table, pattern = _shared_table(docs.sparkSession, path), pattern or _pattern()
    name = f"{docs.sparkSession.sparkContext.applicationId} {path} {pattern}"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = worker_codec(name, table.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [codec.encode(t) for t in texts]
                exact = [codec.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(exact, pa.bool_())], [key, "ids", "n_tokens", "exact"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, column).mapInArrow(run, f"{key} {kind}, ids array<int>, n_tokens long, exact boolean")


def digests(docs: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded bytes stay in the worker that made them."""
    table, pattern = _shared_table(docs.sparkSession, path), pattern or _pattern()
    name = f"{docs.sparkSession.sparkContext.applicationId} {path} {pattern}"

    def run(batches: Iterator) -> Iterator:
        import sys
        from array import array
        from hashlib import sha256

        import pyarrow as pa

        codec = worker_codec(name, table.value, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text)
                packed = array("I", ids)
                if sys.byteorder == "big":
                    packed.byteswap()
                n.append(len(ids))
                a.append(sha256(packed.tobytes()).hexdigest())
                b.append(sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """rows with text: the ids of column, decoded (bytes that are no UTF-8 become replacement characters)."""
    tokens = rows.sparkSession.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: None if x is None else b"".join(map(tokens.value.__getitem__, x)).decode("utf-8", "replace"))

    return rows.withColumn("text", text_of(F.col(column)))
