"""Deterministic sampling: pair quotas, weighted and uniform draws without replacement, dataset resampling.

Random numbers are MD5 hashes of keys, so that a rerun, a retry or another partitioning draws the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .datasets import numbered
from .trajectories import HARD, SOFT, stratify

K, HARD_RATIO, SEED = 10, 0.7, 42


def hash32(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """In (0, 1]."""
    return (hash32(*parts) + 1) / F.lit(float(1 << 32))


def quotas(n_hard: Column, n_soft: Column, k: int | Column = K, hard_ratio: float = HARD_RATIO) -> tuple[Column, Column]:
    """Hard and soft pairs to draw: k x hard_ratio rounded half to even, clamped to the pools, shortfalls filled from the other pool."""
    k = F.lit(k) if isinstance(k, int) else k
    want_hard = F.bround(k * F.lit(hard_ratio)).cast("long")
    want_soft = k - want_hard
    hard, soft = F.least(want_hard, n_hard), F.least(want_soft, n_soft)
    return F.least(hard + want_soft - soft, n_hard), F.least(soft + want_hard - hard, n_soft)


def draw_key(weight: Column, u: Column) -> Column:
    """Exponential clocks: the smallest keys are a weighted draw without replacement; weight zero comes after all others, in uniform order."""
    return F.struct((weight <= 0).alias("last"), F.when(weight > 0, -F.ln(u) / weight).otherwise(u).alias("key"))


def with_draw_order(stratified: DataFrame, seed: int = SEED) -> DataFrame:
    """stratified with draw: the place of a row among its problem's hard (by visits) or soft (uniform) negatives."""
    u = uniform(F.col("problem_id"), F.col("traj_ord"), F.lit(seed))
    weight = F.when(F.col("stratum") == HARD, F.col("visit_count")).otherwise(1)
    keyed = stratified.withColumn("draw_key", draw_key(weight, u))
    return keyed.withColumn("draw", F.row_number().over(Window.partitionBy("problem_id", "stratum").orderBy("draw_key", "traj_ord"))).drop("draw_key")


def contrastive_pairs(trajectories: DataFrame, k: int = K, hard_ratio: float = HARD_RATIO, seed: int = SEED) -> DataFrame:
    """problem_id, pair_ord (hard first), contrast_type, positive, negative (structs): each problem's anchor with its drawn negatives.

    One scan and one shuffle by problem: strata, pool sizes and the anchor (shortest correct, of these the highest
    max_q_value, of these the first) are windows over the same partitioning that the draws use.
    """
    columns = [c for c in trajectories.columns if c != "problem_id"]
    pools = Window.partitionBy("problem_id")
    first = F.struct(F.col("length"), -F.col("max_q_value"), F.col("traj_ord"))
    anchor = F.min_by(F.struct(*columns), F.when(F.col("is_correct"), first)).over(pools)
    count = lambda stratum: F.count_if(F.col("stratum") == stratum).over(pools)
    rows = stratify(trajectories).withColumns({"n_hard": count(HARD), "n_soft": count(SOFT), "positive": anchor})
    rows = with_draw_order(rows.where(F.col("min_correct_length").isNotNull() & F.col("stratum").isin(HARD, SOFT)), seed)
    take_hard, take_soft = quotas(F.col("n_hard"), F.col("n_soft"), k, hard_ratio)
    hard = F.col("stratum") == HARD
    kept = rows.where(F.col("draw") <= F.when(hard, take_hard).otherwise(take_soft))
    place = F.when(hard, F.col("draw")).otherwise(take_hard + F.col("draw"))
    return kept.select("problem_id", place.alias("pair_ord"), F.when(hard, "hard").otherwise("soft").alias("contrast_type"), "positive", F.struct(*columns).alias("negative"))


def pair_records(pairs: DataFrame, problems: DataFrame) -> DataFrame:
    """Flat records (schema.PAIR) of pairs whose structs hold steps and final_answer."""
    joined = pairs.join(problems.select("problem_id", "problem", "ground_truth", F.coalesce("source", F.lit("unknown")).alias("source")), "problem_id")
    return joined.select("problem", "ground_truth", "source", "contrast_type", F.col("positive.steps").alias("positive_steps"), F.col("negative.steps").alias("negative_steps"), F.col("positive.final_answer").alias("positive_answer"))


def rehydrate(records: DataFrame) -> DataFrame:
    """Records back to pairs; statistics that records don't hold become constants."""
    hard = F.col("contrast_type") == "hard"

    def trajectory(steps: str, correct: Column, reward: Column, q: float, answer: Column) -> Column:
        return F.struct(F.col(steps).alias("steps"), correct.alias("is_correct"), reward.alias("reward"), F.lit(1).cast("long").alias("visit_count"), F.size(steps).alias("length"), F.lit(q).alias("max_q_value"), answer.alias("final_answer"))

    return records.withColumn("positive", trajectory("positive_steps", F.lit(True), F.lit(1.0), 1.0, F.col("positive_answer"))).withColumn(
        "negative", trajectory("negative_steps", ~hard, F.when(hard, 0.0).otherwise(1.0), 0.0, F.lit(None).cast("string"))
    )


def resample(pool: DataFrame, target: int, key: Column, seed: int = SEED) -> DataFrame:
    """Exactly target rows (none of an empty pool), with draw (from 1): without replacement if the pool suffices, else with.

    key tells rows apart. Without replacement the smallest hashes win: counts by the hash's first 16 bits give the bucket
    in which the target ends, and only rows up to it are put in order. With replacement draws pick row numbers in hash
    order. Rows are numbered over range partitions, so no task holds them all.
    """
    hashed = pool.withColumns({"_h": F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary")), "_k": key})
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")
    counts = [(r["bucket"], r["n"]) for r in hashed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).orderBy("bucket").collect()]  # 65,536 rows at most
    n, last = 0, 0
    for b, rows in counts:
        if n < target:
            last = b
        n += rows
    if n == 0:
        return pool.withColumn("draw", F.lit(0))
    order = [F.col("_h"), F.col("_k")]
    if n >= target:
        placed = numbered(hashed.where(bucket <= last), order).where(F.col("ord") < target)
        return placed.withColumn("draw", (F.col("ord") + 1).cast("int")).drop("_h", "_k", "ord")
    draws = pool.sparkSession.range(1, target + 1).select(F.col("id").cast("int").alias("draw"), F.pmod(hash32(F.col("id"), F.lit(seed)), F.lit(n)).alias("ord"))
    return draws.join(numbered(hashed, order).drop("_h", "_k"), "ord").drop("ord")
