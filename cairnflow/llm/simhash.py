"""SimHash near-duplicates: fingerprints of word shingles, joined by binary tries with a Hamming error budget.

Fingerprints are dealt to groups by keys that close ones share. Groups come to a task sorted by key and pass through it as
a stream, a bounded block of whole groups at a time; a block is one forest of binary tries over its sorted values: pairs
of nodes are traversed together, level by level, differing bits add up, and a pair over the budget is pruned. A group of
over `chunk` fingerprints is handed on and dealt as pairs of chunks, so no task holds a hot group. Copies never enter the
join: it works on distinct fingerprints. Tasks emit spanning edges only; components are found over these.

near_components() is exact: fingerprints that differ in at most `bits` of 64 bits agree in all but `bits` of more blocks,
so each combination of agreeing blocks is a key. The number of blocks grows with that of the fingerprints, and with it the
key's length, so that groups stay small.

keep_one() filters documents at a lower similarity, for which 64 bits are too few: wide fingerprints of 256 bits give keys
of sampled bits, as many keys as find a pair at SIMILARITY with probability RECALL, and a pair is linked only if the exact
Jaccard similarity of its texts' shingle sets reaches SIMILARITY.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a text of fewer words than a shingle is
one shingle; a very long text takes time and memory in proportion to its words; repeated rows and equal texts share a
component; a null id takes no part in minima and a component of null ids only has a null id; no rows give no rows; other
columns, of any name, are ignored by near_components() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from math import acos, ceil, comb, log2, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_checked
from .components import connected_components, spanning

SHINGLE, BITS, SEED, CHUNK = 3, 3, 42, 4096
#: Rows of a block of groups; rows that a task of the join is meant for; fingerprints of a group that keys aim at.
BLOCK_ROWS, TASK_ROWS, GROUP = 1 << 16, 2_000_000, 32


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and \x20 \x09-\x0D only
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), seed)] if words else []
    line, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    return [xxh64_intdigest(line[s:e], seed) for s, e in zip(starts, ends[shingle - 1 :], strict=False)]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half the shingles' hashes."""
    import numpy as np

    hashes = shingle_hashes(text, shingle, seed)
    ones, step = np.zeros(64, dtype=np.int64), 1 << 16
    for at in range(0, len(hashes), step):
        part = np.array(hashes[at : at + step], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little") if hashes else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as signed long)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x - (x >> 63 << 64) for x in found], pa.int64())], ["doc_id", "fp"])

    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def trie_pairs(values, groups, bits: int, counted: int = (1 << 64) - 1, accept=None, label=None):
    """Index pairs (i, j) of a sorted forest: values (uint64) sorted within groups (sorted); those of one group that differ in at most bits of the counted bits, and that accept(i, j) takes.

    A node is a run of the sorted values. The frontier holds pairs of nodes (lo, hi, lo, hi) with the differing bits of
    their prefixes; each level splits both nodes by one bit. Pairs of single values are settled at once, pairs of equal
    ones at the last level. Wide frontiers are halved and finished one after the other, which bounds memory. With label,
    pairs of one label are left out, and so are nodes that hold nothing else: what is known to be joined costs no more.
    """
    import numpy as np

    n = len(values)
    turns = None if label is None else np.r_[0, np.cumsum(label[1:] != label[:-1])]
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    last = np.r_[first[1:], n]
    many = last - first > 1
    zeros = {}

    def split(lo, hi, level):
        if level not in zeros:
            zeros[level] = np.r_[0, np.cumsum((values >> np.uint64(level)) & np.uint64(1) == 0)].astype(np.int32)
        return lo + zeros[level][hi] - zeros[level][lo]

    found_i, found_j = [], []

    def joined(a0, a1, b0, b1):
        """Whether all of both nodes has one label."""
        return (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1]) & (label[a0] == label[b0])

    def settle(i, j):
        near = np.bitwise_count((values[i] ^ values[j]) & np.uint64(counted)) <= bits
        i, j = i[near], j[near]
        if accept is not None and len(i):
            near = accept(i, j)
            i, j = i[near], j[near]
        found_i.append(i)
        found_j.append(j)

    stack = [(63, first[many], last[many], first[many], last[many], np.zeros(int(many.sum()), np.int8))]
    while stack:
        level, a0, a1, b0, b1, wrong = stack.pop()
        while len(a0):
            lone = (a1 - a0 == 1) & (b1 - b0 == 1)
            if lone.any():
                i, j = a0[lone], b0[lone]
                unlike = i != j if label is None else label[i] != label[j]
                settle(i[unlike], j[unlike])
                a0, a1, b0, b1, wrong = (x[~lone] for x in (a0, a1, b0, b1, wrong))
            if label is not None and len(a0):
                open_ = ~joined(a0, a1, b0, b1)
                a0, a1, b0, b1, wrong = (x[open_] for x in (a0, a1, b0, b1, wrong))
            if level < 0:
                for x0, x1, y0, y1 in zip(a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist(), strict=True):  # equal values
                    for x in range(x0, x1):
                        y = np.arange(max(y0, x + 1) if x0 == y0 else y0, y1)
                        y = y if label is None else y[label[y] != label[x]]
                        settle(np.full(len(y), x), y)
                break
            if len(a0) > 1 << 18:
                half = len(a0) // 2
                stack.append((level, a0[half:], a1[half:], b0[half:], b1[half:], wrong[half:]))
                a0, a1, b0, b1, wrong = (x[:half] for x in (a0, a1, b0, b1, wrong))
            am, bm, own = split(a0, a1, level), split(b0, b1, level), a0 == b0
            more = wrong + (counted >> level & 1)
            parts = [(a0, am, b0, bm, wrong, None), (am, a1, bm, b1, wrong, None), (a0, am, bm, b1, more, None), (am, a1, b0, bm, more, ~own)]
            kept = []
            for x0, x1, y0, y1, e, crossed in parts:
                alive = (x1 > x0) & (y1 > y0) & (e <= bits)
                alive &= ~((x0 == y0) & (x1 - x0 == 1))  # a value with itself
                if crossed is not None:
                    alive &= crossed
                kept.append([x[alive] for x in (x0, x1, y0, y1, e)])
            a0, a1, b0, b1, wrong = (np.concatenate(x) for x in zip(*kept, strict=True))
            level -= 1
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _spanning_edges(fp, values, groups, bits: int, counted: int, close):
    """Edges (u, v) that span what pairs of trie_pairs() connect. close(i, j): which pairs of places are near.

    Neighbours in order, and each value and its group's first, are tried beforehand. So a large group of copies is joined
    by a few comparisons a member, and the tries are left with what that keeps apart.
    """
    import numpy as np

    names, at = np.unique(fp, return_inverse=True)
    n = len(fp)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    hub = np.repeat(first, np.diff(np.r_[first, n]))
    i, j = np.r_[np.arange(1, n), np.arange(n)], np.r_[np.arange(n - 1), hub]
    same = (groups[i] == groups[j]) & (i != j)
    i, j = i[same], j[same]
    near = close(i, j)
    root = spanning(len(names), at[i[near]], at[j[near]])
    i, j = trie_pairs(values, groups, bits, counted, close, root[at])
    root = spanning(len(names), root[at[i]], root[at[j]])[root]
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def _group_join(keyed: DataFrame, rows: int, edges: Callable, chunk: int) -> DataFrame:
    """u, v: what edges(columns) finds in groups of equal key. keyed: key, fp and more longs; rows: about how many.

    edges gets arrays by name and group, the groups' numbers, in blocks of whole groups sorted by key. Groups of over chunk
    rows come back as rows; they are dealt a second time, as pairs of chunks.
    """
    columns = keyed.columns

    def run(defer: bool) -> Callable:
        def stream(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            def batch(u, v, rest) -> Iterator:
                arrays = [u, v, *rest]
                for k in range(0, max(map(len, (x for x in arrays if x is not None))), 1 << 16):
                    part = [None if x is None else x[k : k + (1 << 16)] for x in arrays]
                    n = next(len(x) for x in part if x is not None)
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if x is None else pa.array(x) for x in part], ["u", "v", *columns])

            def work(x: np.ndarray) -> Iterator:
                """Rows (of columns) of whole groups."""
                opens = np.flatnonzero(np.r_[True, (x[0, 1:] != x[0, :-1])])
                size = np.diff(np.r_[opens, x.shape[1]])
                if defer and (size > chunk).any():
                    hot = np.repeat(size > chunk, size)
                    yield from batch(None, None, list(x[:, hot]))
                    x = x[:, ~hot]
                    size = size[size <= chunk]
                live = np.repeat(size > 1, size)
                if live.any():
                    u, v = edges(dict(zip(columns, x[:, live], strict=True)), np.repeat(np.arange(len(size)), size)[live])
                    if len(u):
                        yield from batch(u, v, [None] * len(columns))

            held, n, hot_key = [], 0, None
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns])
                held.append(x)
                n += x.shape[1]
                if n < BLOCK_ROWS:
                    continue
                x = np.concatenate(held, axis=1)
                end = int(np.searchsorted(x[0], x[0, -1], "left"))  # where the last, open group begins
                if x[0, 0] == hot_key:  # the rest of a group whose first rows have been handed on
                    more = int(np.searchsorted(x[0], hot_key, "right"))
                    yield from batch(None, None, list(x[:, :more]))
                    x, end = x[:, more:], max(end - more, 0)
                if end:
                    yield from work(x[:, :end])
                x = x[:, end:]
                if defer and x.shape[1] > chunk:
                    hot_key = x[0, 0]
                    yield from batch(None, None, list(x))
                    x = x[:, :0]
                held, n = [x], x.shape[1]
            if n:
                x = np.concatenate(held, axis=1)
                if x[0, 0] == hot_key:
                    more = int(np.searchsorted(x[0], hot_key, "right"))
                    yield from batch(None, None, list(x[:, :more]))
                    x = x[:, more:]
                if x.shape[1]:
                    yield from work(x)

        return stream

    shape = ", ".join(f"{c} long" for c in ("u", "v", *columns))
    tasks = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
    first = cut(keyed.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run(True), shape))
    hot = first.where("u is null").select(*columns)
    sizes = cut(hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / chunk).alias("chunks")))
    found = first.where("u is not null").select("u", "v")
    if sizes.isEmpty():
        return found
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    # the key of a pair of chunks takes the place of the group's
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda i: F.xxhash64("key", F.least(i, own), F.greatest(i, own)))
    dealt = join_checked(hot, sizes, "key").select(F.explode(others).alias("pair"), *columns[1:]).withColumnRenamed("pair", "key")
    again = dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run(False), shape)
    return found.unionByName(again.select("u", "v"))


def blocks_for(n: int, bits: int) -> int:
    """Least number of blocks, above bits, whose agreeing ones make keys long enough for groups of about GROUP x 32 of n fingerprints."""
    blocks = bits + 1
    while blocks < 2 * bits + 2 and n >> (64 * (blocks - bits) // blocks) > 32 * GROUP:
        blocks += 1
    return blocks


def near_edges(fps: DataFrame, bits: int = BITS, chunk: int = CHUNK, blocks: int | None = None) -> DataFrame:
    """From distinct fp: u, v, edges that span what fingerprints within bits bits of each other connect."""
    n = fps.count()
    blocks = blocks or blocks_for(n, bits)
    masks = [sum(1 << i for i in range(64 * b // blocks, 64 * (b + 1) // blocks)) for b in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - bits)]
    signed = lambda x: F.lit(x - (x >> 63 << 64)).cast("long")
    # a key is the hash of a combination's number and its bits; groups whose keys collide are joined as one, to no harm
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(signed(m))) for i, m in enumerate(chosen)]
    keyed = fps.select(F.explode(F.array(*keys)).alias("key"), "fp")

    def edges(x, group):
        import numpy as np

        value = x["fp"].view(np.uint64)
        order = np.lexsort((value, group))
        value = value[order]
        return _spanning_edges(x["fp"][order], value, group[order], bits, (1 << 64) - 1, lambda i, j: np.bitwise_count(value[i] ^ value[j]) <= bits)

    return _group_join(keyed, n * len(chosen), edges, chunk)


#: Wide fingerprints: bits; how many of the first WORD bits of the check, and of all its CHECK bits, may differ. At a Jaccard
#: similarity of 0.8 of five-word shingles a bit differs with probability 0.15 or so, 6.1 bits of 40 with a spread of 2.3,
#: 19.4 bits of 128 with a spread of 4.1.
WIDE_SHINGLE, WIDE_BITS, WORD, WORD_ERRORS, CHECK_ERRORS = 5, 256, 40, 14, 34
#: Least Jaccard similarity of linked texts, as a fraction; the share of isolated pairs at it that keys find.
SIMILARITY, RECALL = (4, 5), 0.996
#: Rounds that try a large component's members against one of them.
STARS = 3
#: Members, and bytes of their shingle sets, that a chunk of a component holds.
SET_ROWS, SET_BYTES = 2048, 8 << 20
_STREAMS = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Odd multipliers of a shingle's words.
_TURNS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """XXH64 by word (bytes); a bounded memo."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxh64_intdigest(word, SEED)
        return value


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE, hashes: WordHashes | None = None):
    """Different hashes of a text's shingles (a text of fewer words is one), sorted: those of the words, weighed by place and mixed."""
    import numpy as np

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and \x20 \x09-\x0D only
    get = (WordHashes() if hashes is None else hashes).__getitem__
    h = np.fromiter(map(get, words), np.uint64, len(words))
    width = min(shingle, len(words))
    total = np.full(max(len(words) - width + 1, 0) if words else 0, width, np.uint64)
    for k in range(width):
        total = total + h[k : k + len(total)] * np.uint64(_TURNS[k % len(_TURNS)] + 2 * (k // len(_TURNS)))
    return np.unique(_mixed(total))


def similar(a, b) -> bool:
    """Whether the Jaccard similarity of two shingle sets is SIMILARITY or more."""
    import numpy as np

    part, whole = SIMILARITY
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def wide_fingerprint(hashes) -> bytes:
    """256-bit SimHash (32 bytes) of a shingle set: four streams of bits are derived from each shingle's hash."""
    import numpy as np

    n = len(hashes)
    if not n:
        return bytes(WIDE_BITS // 8)
    ones = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)]
        streams = np.stack([_mixed(part ^ np.uint64(s)) for s in _STREAMS], axis=1)
        found = np.unpackbits(streams.view(np.uint8), axis=1, bitorder="little")
        whole = len(found) // 255 * 255  # sums of 255 bits fit a byte
        ones += found[:whole].reshape(-1, 255, WIDE_BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + found[whole:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").tobytes()


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """From doc_id, text: doc_id, hash (of the text), wide (the fingerprint), fp (hash of the shingle set)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        memo = WordHashes()
        for batch in batches:
            wide, fp = [], []
            for text in batch.column(2).to_pylist():
                hashes = shingle_set(text, shingle, memo)
                wide.append(wide_fingerprint(hashes))
                x = xxh64_intdigest(hashes.tobytes(), SEED)
                fp.append(x - (x >> 63 << 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(wide, pa.binary()), pa.array(fp, pa.int64())], ["doc_id", "hash", "wide", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").mapInArrow(run, f"doc_id {kind}, hash long, wide binary, fp long")


@lru_cache
def tables_for(key_bits: int, recall: float = RECALL) -> int:
    """Number of keys of key_bits sampled bits of which a pair at SIMILARITY shares one with probability recall."""
    part, whole = SIMILARITY
    differ = acos(2 * part / (whole + part)) / pi  # of two sets of equal size
    chance = [(comb(WIDE_BITS, d) * differ**d * (1 - differ) ** (WIDE_BITS - d), comb(WIDE_BITS - d, key_bits) / comb(WIDE_BITS, key_bits)) for d in range(WIDE_BITS - key_bits + 1)]
    n = 8
    while sum(w * (1 - (1 - agree) ** n) for w, agree in chance) < recall:
        n = ceil(n * 1.05)
    return n


def wide_edges(fps: DataFrame, chunk: int = CHUNK, n: int | None = None) -> DataFrame:
    """From distinct fp, wide: u, v (fp), spanning edges of candidates: fingerprints that share a key and differ in at most CHECK_ERRORS of the check's bits.

    Keys sample log2(n / GROUP) bits, so groups keep their size as n grows, and their number grows with about its fourth
    root.
    """
    n = n or max(fps.count(), 1)
    key_bits = max(8, ceil(log2(max(n / GROUP, 1))))
    tables = tables_for(key_bits)

    def keys(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        sampled = np.zeros((WIDE_BITS, tables), np.float64)
        rng = np.random.default_rng(SEED)
        for t in range(tables):
            sampled[rng.choice(WIDE_BITS, key_bits, replace=False), t] = 2.0 ** np.arange(key_bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if not part.num_rows:
                    continue
                wide = np.frombuffer(b"".join(part["wide"].to_pylist()), np.uint8).reshape(-1, WIDE_BITS // 8)
                key = (np.unpackbits(wide, axis=1).astype(np.float64) @ sampled).astype(np.int64) | np.arange(tables, dtype=np.int64) << key_bits
                check = np.ascontiguousarray(wide).view(np.int64)
                out = [key.ravel(), *(np.repeat(x, tables) for x in (part["fp"].to_numpy(), check[:, 0], check[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "fp", "c1", "c2"])

    keyed = fps.select("fp", "wide").mapInArrow(keys, "key long, fp long, c1 long, c2 long")

    def edges(x, group):
        import numpy as np

        c1, c2 = x["c1"].view(np.uint64), x["c2"].view(np.uint64)
        # below the word stand bits of the name, which tell most equal words apart and count for nothing
        value = c1 >> np.uint64(64 - WORD) << np.uint64(64 - WORD) | x["fp"].view(np.uint64) >> np.uint64(WORD)
        order = np.lexsort((value, group))
        value, group, c1, c2, fp = (y[order] for y in (value, group, c1, c2, x["fp"]))

        def close(i, j):
            return np.bitwise_count(c1[i] ^ c1[j]).astype(np.int16) + np.bitwise_count(c2[i] ^ c2[j]) <= CHECK_ERRORS

        return _spanning_edges(fp, value, group, WORD_ERRORS, ((1 << WORD) - 1) << (64 - WORD), close)

    return _group_join(keyed, n * tables, edges, chunk)


def _verified(pairs: DataFrame) -> DataFrame:
    """u, v, near (whether their sets are similar) of pairs with u, v, a, b (sets as bytes)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a, b = ([np.frombuffer(x, "<u8") for x in batch.column(k).to_pylist()] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(similar, a, b), pa.bool_())], ["u", "v", "near"])

    return pairs.select("u", "v", "a", "b").mapInArrow(run, "u long, v long, near boolean")


def _sets(docs: DataFrame, rows: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """node, component, wide, set (bytes) of members (node, component). docs: doc_id, hash, text."""
    first = rows.join(members, F.col("fp") == F.col("node")).groupBy("node", "component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")).alias("at"))
    first = cut(first.select("node", "component", F.col("at.doc_id").alias("_id"), F.col("at.hash").alias("_of")))
    texts = join_checked(docs, first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_of")))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo = WordHashes()
        for batch in batches:
            found = [shingle_set(t, shingle, memo) for t in batch.column(2).to_pylist()]
            wide, sets = (pa.array(x, pa.binary()) for x in (map(wide_fingerprint, found), (x.tobytes() for x in found)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), wide, sets], ["node", "component", "wide", "set"])

    return cut(texts.select("node", "component", "text").mapInArrow(run, "node long, component long, wide binary, set binary").dropDuplicates(["node"]))


def similar_edges(node, wide, sets: list, label, part):
    """Edges (u, v) that, with equal labels, span what similar pairs connect of those within CHECK_ERRORS of each other.

    Pairs are those of places of part 0, and those of a place of part 1 and one of part 2. Arrays; wide: rows of uint64.
    Intersections are counted by marking one set's shingles and summing the marks of all sets it is tried against, so a
    pair costs some nanoseconds a shingle; pairs that have become joined are not tried.
    """
    import numpy as np

    part_, whole = SIMILARITY
    sizes = np.array([len(x) for x in sets], np.int64)
    names, at = np.unique(np.concatenate(sets), return_inverse=True)
    # shingles of a single set are in no intersection
    shared = np.bincount(at, minlength=len(names))[at] > 1
    place = np.r_[0, np.cumsum(shared)][np.r_[0, np.cumsum(sizes)]]
    at, mark = at[shared], np.zeros(len(names), np.int8)
    root = np.unique(label, return_inverse=True)[1]
    own, second = np.flatnonzero(part == 0), np.flatnonzero(part == 2)
    u, v = [], []
    for i in np.flatnonzero(part < 2).tolist():
        j = second if part[i] else own[np.searchsorted(own, i, "right") :]
        j = j[root[j] != root[i]]
        j = j[whole * np.minimum(sizes[i], sizes[j]) >= part_ * np.maximum(sizes[i], sizes[j])]
        j = j[np.bitwise_count(wide[j, :2] ^ wide[i, :2]).sum(axis=1, dtype=np.int64) <= CHECK_ERRORS]
        if not len(j):
            continue
        mine = at[place[i] : place[i + 1]]
        mark[mine] = 1
        lengths = place[j + 1] - place[j]
        bounds = np.flatnonzero(np.diff(np.cumsum(lengths) >> 20)) + 1  # about a million marks at once
        for k, n in zip(np.split(j, bounds), np.split(lengths, bounds), strict=True):
            ends = np.cumsum(n)
            marks = mark[at[np.repeat(place[k] - (ends - n), n) + np.arange(int(ends[-1]))]]
            upto = np.r_[0, np.cumsum(marks, dtype=np.int64)]
            both = upto[ends] - upto[ends - n]
            for x in k[whole * both >= part_ * (sizes[i] + sizes[k] - both)].tolist():
                if root[x] != root[i]:
                    u.append(i)
                    v.append(x)
                    root[root == root[x]] = root[i]
        mark[mine] = 0
    return node[np.array(u, np.int64)], node[np.array(v, np.int64)]


def _dealt_edges(dealt: DataFrame, tasks: int) -> DataFrame:
    """u, v: similar_edges() of groups of equal key. dealt: key, part, node, label, wide, set."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def work(rows: pa.Table, keys: np.ndarray) -> Iterator:
            """Rows of whole groups."""
            bounds = np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)].tolist()
            part, node, label = (rows[c].to_numpy() for c in ("part", "node", "label"))
            wide = np.frombuffer(b"".join(rows["wide"].to_pylist()), "<u8").reshape(-1, WIDE_BITS // 64)
            found = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x, "<u8") for x in rows["set"].slice(a, b - a).to_pylist()]
                    found.append(similar_edges(node[a:b], wide[a:b], sets, label[a:b], part[a:b]))
            if found:
                u, v = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held, n, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n < SET_ROWS and size < SET_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows["key"].to_numpy()
            end = int(np.searchsorted(keys, keys[-1], "left"))  # where the last, open group begins
            if end:
                yield from work(rows.slice(0, end), keys[:end])
                rows = rows.slice(end)
            held, n, size = rows.to_batches(), rows.num_rows, rows.nbytes
        if n:
            rows = pa.Table.from_batches(held)
            yield from work(rows, rows["key"].to_numpy())

    return dealt.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _stars(sets: DataFrame) -> DataFrame | None:
    """u, v: members of components that are similar to one member of theirs, or, of those that are not, to one of these, STARS times."""
    links, left = None, sets
    for _ in range(STARS):
        least = cut(left.groupBy("component").agg(F.min("node").alias("v")))
        hubs = cut(join_checked(left.select("node", F.col("set").alias("b")), least, F.col("node") == F.col("v")).select("component", "v", "b"))
        tried = cut(_verified(join_checked(left.select(F.col("node").alias("u"), "component", F.col("set").alias("a")), hubs, "component").where("u <> v")))
        near = tried.where("near").select("u", "v")
        links = near if links is None else links.unionByName(near)
        left = cut(left.join(tried.where("not near").select(F.col("u").alias("node")), "node", "left_semi"))
        if left.isEmpty():
            break
    return links


def similar_components(docs: DataFrame, rows: DataFrame, shingle: int = WIDE_SHINGLE, chunk: int = SET_ROWS) -> DataFrame:
    """node, root as connected_components() gives them: of candidates whose shingle sets are similar.

    Links lie within components of candidates, and all candidate pairs of a component are tried in the tasks, which hand on
    only edges that span the links. A component of at most chunk members and SET_BYTES is one group. Of a larger one,
    members are first tried against one of them (STARS times); then those outside of the largest star are dealt, in
    chunks, to groups with each chunk of the component. So a large group of copies takes about one comparison a member, a
    pair stays untried only if its ends are joined, and rows grow with a component's members times the chunks of those
    outside of its largest star.
    """
    wide = cut(rows.select("fp", "wide").dropDuplicates(["fp"]))
    found = cut(connected_components(wide_edges(wide, n=wide.count())))
    members = cut(found.select("node", F.col("root").alias("component")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("component")).distinct()))
    sets = _sets(docs, rows, members, shingle)

    def chunks(own: Column) -> Column:
        """Of the rows that own is true of."""
        return F.greatest(F.ceil(F.count_if(own) / chunk), F.ceil(F.sum(F.when(own, F.length("set")).otherwise(0)) / SET_BYTES))

    sizes = sets.groupBy("component").agg(chunks(F.lit(True)).alias("chunks"))
    large = cut(sizes.where("chunks > 1").select("component"))
    columns = ["key", "part", "node", "label", "wide", "set"]
    small = sets if large.isEmpty() else join_checked(sets, large, "component", "left_anti")
    dealt = small.select(F.xxhash64("component").alias("key"), F.lit(0).alias("part"), "node", F.col("node").alias("label"), "wide", "set")
    links = None
    if not large.isEmpty():
        hot = cut(join_checked(sets, large, "component", "left_semi"))
        links = cut(_stars(hot))
        named = cut(hot.select("node", "component", "wide", "set").join(links.select(F.col("u").alias("node"), F.col("v").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node")))
        stars = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
        top = cut(stars.groupBy("component").agg(F.max(F.struct("n", "label")).alias("top")).select("component", F.col("top.label").alias("top")))
        named = join_checked(named, top, "component").withColumn("apart", F.col("label") != F.col("top"))
        plan = cut(named.groupBy("component").agg(chunks(F.col("apart")).alias("outer"), chunks(~F.col("apart")).alias("inner")).where("outer > 0"))
        # chunks of those outside come first; each of these meets itself and every other
        own = F.when(F.col("apart"), F.pmod(F.xxhash64("node"), "outer")).otherwise(F.col("outer") + F.pmod(F.xxhash64("node"), "inner"))
        others = F.sequence(F.lit(0).cast("long"), F.when(F.col("apart"), F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1)
        spread = join_checked(named, plan, "component").withColumn("own", own).withColumn("other", F.explode(others))
        part = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        key = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other"))
        dealt = dealt.unionByName(spread.select(key.alias("key"), part.alias("part"), "node", "label", "wide", "set"))
    volume = sets.agg(F.sum(F.length("set"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(volume) // (4 * SET_BYTES) + 1)
    edges = _dealt_edges(dealt.select(*columns), tasks)
    return connected_components(edges if links is None else edges.unionByName(links))


def keep_one(docs: DataFrame, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """docs with one row of each group of near-duplicates: the row of least id, then of least text hash.

    A row is told by its id and a hash of its text. The groups' kept rows come from an aggregation by group; the others
    are found by these two alone, so no task meets a large group's members, and their list, which mostly is the shorter
    one, is what the documents are joined with.
    """
    slim = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    rows = cut(wide_fingerprints(slim, shingle))
    roots = cut(similar_components(slim, rows, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "hash")
    # the least row of each shingle set, then, with one row for each set, of each group: partial aggregations only
    least = rows.groupBy("fp").agg(F.min(place).alias("least"))
    grouped = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("root", "fp").alias("group"), "least")
    first = cut(grouped.groupBy("group").agg(F.min("least").alias("at")).select(F.col("at.doc_id").alias("_id"), F.col("at.hash").alias("_of")))
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_own"), F.xxhash64("text").alias("_hash"))
    same = F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_of"))
    others = rows.select(F.col("doc_id").alias("_own"), F.col("hash").alias("_hash")).distinct()
    dropped = cut(join_checked(others, first, same, "left_anti").select(F.col("_own").alias("_id"), F.col("_hash").alias("_of")))
    kept = join_checked(whole, dropped, same, "left_anti")
    # rows repeated as they are: one of them
    twice = cut(rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_of")))
    if not twice.isEmpty():
        once = join_checked(kept, twice, same, "left_semi").dropDuplicates(["_own", "_hash"])
        kept = join_checked(kept, twice, same, "left_anti").unionByName(once)
    return kept.select("row.*")


def near_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, fp (signed long), component_id (least doc_id that links reach, itself included).

    Rows of one fingerprint, however many, get their component by a join that broadcasts or lets AQE split them.
    """
    rows = cut(fingerprints(docs, shingle, seed))
    reps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(near_edges(reps.select("fp"), bits, chunk))
    of = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = of.join(least, "root").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")
