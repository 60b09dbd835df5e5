"""Exact top-k inner products by MaxScore over dimension postings.

A component x counts as the integer floor(1024 x). Vectors are dealt to shards, once; a shard's task holds its vectors and
has the queries pass by in batches, so neither side's number bounds the other and no task holds more than a shard and a
batch. Within a shard each dimension is a term whose posting list is that column. A term adds between its least and its
most to a query's score; terms are ordered by that range. With a threshold (a score that k rows are known to reach) the
non-essential terms are the most of the narrow ones that together, with all others at their least, don't reach it.
Essential postings are traversed for all rows, then the others are probed one by one, for rows whose bound still reaches
the threshold, which rises to the k-th best exact score found. The first shard answers first: its k-th scores are the
thresholds with which queries go to all others. Shards keep their k best; merging these is exact.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; a query is a row, and its candidates are all other rows, those of its own id too; rows of equal id ask each for
themselves; null ids neither ask nor answer; equal scores go to the smaller id; no rows give no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

SCALE, TOP = 1024, 10
SHARD_ROWS = 16384
#: Rows of essential traversal that are compared with the threshold at a time.
PROBE = 8


def usable(column: str = "embedding") -> Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


class Shard:
    """Posting lists of integer rows (n x d) with ids (which break ties) and names (which tell rows apart)."""

    def __init__(self, rows, ids, names):
        import numpy as np

        order = np.argsort(ids, kind="stable")  # places then break ties as ids do
        self.ids, self.names = ids[order], names[order]
        self.largest = int(np.abs(rows).max(initial=0))
        self.ints = rows[order]
        self.postings = np.ascontiguousarray(self.ints.T, dtype=np.float64)
        self.high, self.low = self.ints.max(axis=0, initial=-(2**62)), self.ints.min(axis=0, initial=2**62)

    def best(self, query, name: int, k: int, floor=None) -> list[tuple[int, int]]:
        """(id, score) of the k best rows, but for the one of that name, of those that can reach floor."""
        import numpy as np

        n, d = self.ints.shape
        if not n:
            return []
        if self.largest * int(np.abs(query).max(initial=0)) * max(d, 1) >= 2**52:  # doubles no longer hold such sums exactly
            scores = [int(s) for s in self.ints.astype(object) @ query.astype(object)]
            places = sorted((i for i in range(n) if self.names[i] != name), key=lambda i: (-scores[i], i))[:k]
            return [(int(self.ids[i]), scores[i]) for i in places]
        q = query.astype(np.float64)
        most, least = np.maximum(q * self.high, q * self.low), np.minimum(q * self.high, q * self.low)
        terms = np.argsort(least - most, kind="stable")  # widest ranges first
        reach = np.r_[np.cumsum((most - least)[terms][::-1])[::-1], 0.0] + least.sum()  # with the first t terms at their least
        bound = np.r_[np.cumsum(most[terms][::-1])[::-1], 0.0]  # of what the terms from t on can add
        essential = d if floor is None else int(np.argmax(reach < floor)) if (reach < floor).any() else d
        part = np.zeros(n)
        alive = None  # all rows
        for t in range(essential):
            part += q[terms[t]] * self.postings[terms[t]]
        gone = np.flatnonzero(self.names == name)
        part[gone] = -np.inf
        threshold = -np.inf if floor is None else float(floor)
        alive = np.flatnonzero(part + bound[essential] >= threshold)
        part = part[alive]
        for at in range(essential, d, PROBE):
            if len(alive) > k:
                lead = alive[np.argpartition(-part, k - 1)[:k]]
                threshold = max(threshold, (self.ints[lead].astype(np.float64) @ q).min())  # k exact scores
                keep = part + bound[at] >= threshold
                alive, part = alive[keep], part[keep]
            for t in terms[at : at + PROBE]:
                part = part + q[t] * self.postings[t][alive]
        keep = part > -np.inf
        alive, part = alive[keep], part[keep]
        if len(alive) > k:
            kth = np.partition(part, len(part) - k)[len(part) - k]
            alive, part = alive[part >= kth], part[part >= kth]
        order = np.lexsort((alive, -part))[:k]
        return [(int(self.ids[alive[i]]), int(part[i])) for i in order]


def _asked(rows: DataFrame, k: int, dim: int) -> DataFrame:
    """name, query_id, vec_id, score: each shard's best. rows: shard, ask, name, vec_id, floor, v."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def padded(lists) -> np.ndarray:
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(flat) == dim * len(lists):
                return flat.reshape(-1, dim)
            out = np.zeros((len(lists), dim), np.int64)
            for i, part in enumerate(np.split(flat, ends[:-1]) if len(lists) else []):
                out[i, : len(part)] = part
            return out

        shard, held, index = None, [], None
        for b in batches:
            at = 0
            numbers, asks = b["shard"].to_numpy(), b["ask"].to_numpy(zero_copy_only=False)
            while at < b.num_rows:  # runs of one shard's vectors or queries
                end = at + int(np.argmin(np.r_[(numbers[at:] == numbers[at]) & (asks[at:] == asks[at]), False]))
                part = b.slice(at, end - at)
                if numbers[at] != shard:
                    shard, held, index = numbers[at], [], None
                if not asks[at]:
                    held.append((padded(part["v"]), part["vec_id"].to_numpy(), part["name"].to_numpy()))
                else:
                    if index is None:
                        index = Shard(*map(np.concatenate, zip(*held, strict=True))) if held else Shard(np.zeros((0, dim), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                        held = []
                    out = []
                    for query, query_id, name, floor in zip(padded(part["v"]), part["vec_id"].to_pylist(), part["name"].to_pylist(), part["floor"].to_pylist(), strict=True):
                        out += [(name, query_id, *x) for x in index.best(query, name, k, floor)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["name", "query_id", "vec_id", "score"])
                at = end

    dealt = rows.repartition(F.col("shard")).sortWithinPartitions("shard", "ask")
    return dealt.mapInArrow(run, "name long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors: vec_id, embedding; queries: which of these rows ask. Gives query_id, rank, vec_id, score."""
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select("vec_id", ints.alias("v"), queries.alias("asks"))
    good = cut(rows.withColumn("name", F.monotonically_increasing_id()))
    size = good.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first()
    shards, dim = -(-max(size["n"], 1) // shard_rows), max(size["d"] or 0, 1)
    none = F.lit(None).cast("long")
    held = good.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("ask"), "name", "vec_id", none.alias("floor"), "v")
    asked = good.where("asks")
    to_shards = lambda rows, first, last: rows.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("shard"), F.lit(True).alias("ask"), "name", "vec_id", "floor", "v")
    best = cut(_asked(held.where("shard = 0").unionByName(to_shards(asked.withColumn("floor", none), 0, 0)), k, dim))
    if shards > 1:
        floors = best.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).drop("n")
        told = asked.join(floors, "name", "left")
        best = best.unionByName(_asked(held.where("shard > 0").unionByName(to_shards(told, 1, shards - 1)), k, dim))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.col("score").desc(), F.col("vec_id"))).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
