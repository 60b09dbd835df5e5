"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Exactly equal vectors are one class. Every class is projected on many random directions. A pair at the similarity limit is
limit_distance apart, so each of its projection differences is normal with that spread.

Counting. A pair collides in one of `count` projections if its values lie within a window of each other, centred on the row
that asks; the window (in spreads) and the least number of collisions are set so that a pair at the limit passes with the
wanted recall. A passing pair misses at most `misses` windows, so it collides in one of the first misses + 1 projections:
rows are sorted by these and scanned for pairs, in the others they are counted. Passing pairs are verified by cosine in
double precision.

Groups. In 64 dimensions one window holds half of all rows, so single projections select nothing. Rows meet only in groups:
further projections are cut into cells of CELL spreads, from a random offset, and the cells of several make a key. Their
number grows with the logarithm of the rows, so groups keep their size; keys are drawn as often as it takes for a pair at
the limit to share one with the wanted recall. Work grows as about n to 1.2 where vectors spread evenly. A pair that shares
several keys counts in the first. A group of over `chunk` rows is dealt as pairs of chunks. Tasks emit a row per class and
block (its links) and spanning edges, never all pairs.

Defined cases: vectors that are null, all zero, or hold null or non-finite components link with nothing; shorter vectors
count as padded with zeros; equal vectors link (their cosine is 1); repeated rows count as rows; null ids take no part in
minima; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb, erf, exp, log, log1p, pi, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_checked
from .components import connected_components, spanning
from .maxscore import usable

COSINE, PROJECTIONS, WINDOW, RECALL, SEED = 0.95, 16, 3.0, 0.999, 20240
#: Width of a cell in spreads of a pair at the limit; rows of a group that keys aim at; most rows of a group in one task.
CELL, GROUP_ROWS, CHUNK = 6.0, 512, 4096


def keys_for(n: int, spread: float, recall: float, group_rows: int = GROUP_ROWS) -> tuple[int, int]:
    """(projections of a key, keys): groups of about group_rows of n evenly spread unit vectors, and a pair spread apart shares a key with probability recall."""
    width = CELL * spread
    shared = lambda s: erf(width / s / sqrt(2)) - s / width * sqrt(2 / pi) * (1 - exp(-((width / s) ** 2) / 2))  # noqa: E731  of a pair whose difference has spread s
    cells = ceil(log(n / group_rows) / -log(shared(sqrt(2)))) if n > group_rows else 0
    agree = shared(spread) ** cells
    return cells, 1 if agree >= recall else ceil(log1p(-recall) / log1p(-agree))


def least_collisions(count: int, window: float, recall: float) -> int:
    """Most collisions that may be asked for: a pair at the limit has so many with at least this probability."""
    p = erf(window / sqrt(2))
    tail = 0.0
    for c in range(count, -1, -1):
        tail += comb(count, c) * p**c * (1 - p) ** (count - c)
        if tail >= recall:
            return c
    return 0


def directions(dim: int, count: int, seed: int):
    import numpy as np

    return np.random.default_rng(seed).standard_normal((dim, count))


def _matrix(column, dim: int):
    import numpy as np

    if len(column) and all(len(v) == dim for v in column):
        return np.stack([np.asarray(v, dtype=np.float64) for v in column])
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _unit(x):
    import numpy as np

    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def pairs_of_runs(a, pa, b, pb, same: bool, lead: int, window: float, misses: int, cosine: float):
    """Index pairs of unit rows a, b (projections pa, pb) that collide in projection lead but in none before, pass the count, and verify."""
    import numpy as np

    ia, ib = np.argsort(pa[:, lead], kind="stable"), np.argsort(pb[:, lead], kind="stable")
    va, vb = pa[ia, lead], pb[ib, lead]
    lo, hi = np.searchsorted(vb, va - window, "left"), np.searchsorted(vb, va + window, "right")
    if same:
        lo = np.maximum(lo, np.arange(len(a)) + 1)
    others = [p for p in range(pa.shape[1]) if p != lead]
    # single precision for counting, with room for its rounding; verification is in double precision
    fa, fb, room = pa[ia].astype(np.float32), np.ascontiguousarray(pb[ib].T.astype(np.float32)), np.float32(window * (1 + 1e-5))
    found_i, found_j = [], []
    for at in range(0, len(a), 128):
        rows = np.arange(at, min(at + 128, len(a)))
        left, right = int(lo[rows].min()), int(hi[rows].max())
        if left >= right:
            continue
        cols = np.arange(left, right)
        wrong = ((cols < lo[rows, None]) | (cols >= hi[rows, None])).astype(np.int8) * np.int8(misses + 1)
        gap = np.empty(wrong.shape, np.float32)
        for p in others[: max(3, misses)]:
            np.subtract(fa[rows, p][:, None], fb[p, left:right][None, :], out=gap)
            np.abs(gap, out=gap)
            # pairs that collide in an earlier leading projection have been found by it
            wrong += gap > room if p > lead else np.where(gap > room, 1, misses + 1).astype(np.int8)
            np.minimum(wrong, misses + 1, out=wrong)
        i, j = np.nonzero(wrong <= misses)
        e, i, j = wrong[i, j], rows[i], cols[j]
        for p in others[max(3, misses) :]:
            e = e + (np.abs(fa[i, p] - fb[p, j]) > room)
            near = e <= misses
            e, i, j = e[near], i[near], j[near]
        i, j = ia[i], ib[j]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = (a[x] * b[y]).sum(axis=1) >= cosine
            found_i.append(x[near])
            found_j.append(y[near])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _keys(unit, cells: int, keys: int, spread: float, seed: int):
    """Hashed keys (rows x keys, int64) of unit vectors."""
    import numpy as np

    rng = np.random.default_rng(seed + 1)
    out = np.zeros((len(unit), keys), np.uint64)
    width = CELL * spread
    for t in range(keys):
        x = np.full(len(unit), (t + 1) * 0xD6E8FEB86659FD93 % 2**64, np.uint64)  # far apart: keys of two tables never meet
        if cells:
            values = unit @ rng.standard_normal((unit.shape[1], cells))
            for c in np.floor((values + rng.random(cells) * width) / width).astype(np.int64).T:
                x = (x ^ c.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(29)
        out[:, t] = x
    return out.view(np.int64)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, count: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL, group_rows: int = GROUP_ROWS, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "embedding", F.coalesce(usable() & F.exists("embedding", lambda x: x != 0), F.lit(False)).alias("good"))
    classes = cut(
        rows.where("good").groupBy(F.xxhash64("embedding").alias("hash"), "embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("class", F.monotonically_increasing_id())
    )
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    dim, spread = max(size["d"] or 1, 1), sqrt(2 - 2 * cosine)
    half = 1 - (1 - recall) / 2  # recall of the keys, and of the count
    cells, keys = keys_for(max(size["n"], 1), spread, half, group_rows)
    misses = count - least_collisions(count, window, half)

    def deal(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.ascontiguousarray(_keys(_unit(_matrix(part["embedding"].to_pylist(), dim)), cells, keys, spread, seed))
                again = pa.array(np.repeat(np.arange(len(found)), keys))
                table = pa.Table.from_batches([part]).take(again)
                table = table.append_column("keys", pa.array([x.tobytes() for x in found], pa.binary()).take(again))
                table = table.append_column("table", pa.array(np.tile(np.arange(keys, dtype=np.int32), len(found)))).append_column("key", pa.array(found.ravel()))
                yield from table.to_batches()

    kind = classes.schema["embedding"].dataType.simpleString()
    dealt = classes.select("class", "n", "embedding").mapInArrow(deal, f"class long, n long, embedding {kind}, keys binary, table int, key long")
    hot = cut(dealt.select("key").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > chunk).select("key", F.ceil(F.col("size") / chunk).cast("int").alias("chunks")))
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("class"), chunks).cast("int")
    others = F.transform(F.sequence(F.lit(0), chunks - 1), lambda i: F.struct((F.least(i, own) * chunks + F.greatest(i, own)).alias("part"), (i != own).alias("cross")))
    parted = join_checked(dealt, hot, "key", "left").select("class", "n", "embedding", "keys", "table", "key", own.alias("own"), F.explode(others).alias("to"))
    parted = parted.select("class", "n", "embedding", "keys", "table", "key", "own", "to.part", "to.cross")

    def meet(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        aim = directions(dim, count, seed)

        def groups() -> Iterator:
            """Blocks of whole groups."""
            held, n = [], 0
            for b in batches:
                held.append(b)
                n += b.num_rows
                if n < 1 << 13:
                    continue
                t = pa.Table.from_batches(held)
                key, part = t["key"].to_numpy(), t["part"].to_numpy()
                end = int(np.argmax((key == key[-1]) & (part == part[-1])))
                if end:
                    yield t.slice(0, end)
                held, n = t.slice(end).combine_chunks().to_batches(), t.num_rows - end
            if n:
                yield pa.Table.from_batches(held)

        for t in groups():
            key, part, own, tables, cross = (t[c].to_numpy() for c in ("key", "part", "own", "table", "cross"))
            classes_, copies = t["class"].to_numpy(), t["n"].to_numpy()
            unit = _unit(_matrix(t["embedding"].to_pylist(), dim))
            values = unit @ aim
            known = np.frombuffer(b"".join(t["keys"].to_pylist()), np.int64).reshape(-1, keys)
            opens = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            names, at = np.unique(classes_, return_inverse=True)
            links, ends = np.zeros(len(names), np.int64), []
            for lo, hi in zip(opens, np.r_[opens[1:], len(key)], strict=True):
                if hi - lo < 2:
                    continue
                a = np.flatnonzero(own[lo:hi] == own[lo]) + lo
                b = np.flatnonzero(own[lo:hi] != own[lo]) + lo if cross[lo] else a
                same = not cross[lo]  # else a pair of chunks, of which one may be empty
                for lead in range(misses + 1):
                    i, j = pairs_of_runs(unit[a], values[a], unit[b], values[b], same, lead, window * spread, misses, cosine)
                    i, j = a[i], b[j]
                    first = (known[i] == known[j]).argmax(axis=1) == tables[i]  # in no earlier group
                    i, j = i[first], j[first]
                    np.add.at(links, at[i], copies[j])
                    np.add.at(links, at[j], copies[i])
                    ends.append((at[i], at[j]))
            if ends:
                root = spanning(len(names), *map(np.concatenate, zip(*ends, strict=True)))
                has = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays([pa.array(names[has]), pa.array(links[has]), pa.array(names[root[has]])], ["class", "links", "root"])

    tasks = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), size["n"] * keys // 100_000 + 1)
    found = cut(parted.repartition(tasks, "key", "part").sortWithinPartitions("key", "part").mapInArrow(meet, "class long, links long, root long"))
    roots = connected_components(found.select(F.col("class").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    of = (
        classes.join(links, "class", "left")
        .join(roots.withColumnRenamed("node", "class"), "class", "left")
        .select("hash", "embedding", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "class").alias("root"))
    )
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    of = of.join(least, "root").select("hash", "embedding", "n_links", "component_id")
    linked = rows.where("good").withColumn("hash", F.xxhash64("embedding")).join(of, ["hash", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
