"""Resume filters, verification, evaluation and training-set operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import numbered_solution
from ..lineage import cut


def resume_problems(seeds: DataFrame, done: DataFrame) -> DataFrame:
    """Seeds whose problem has no pair yet."""
    return seeds.join(done.select("problem").distinct(), "problem", "left_anti")


def lossy_key(problem: Column, contrast_type: Column) -> Column:
    return F.concat(F.substring(problem, 1, 80), F.coalesce(contrast_type, F.lit("")))


def resume_pairs(pairs: DataFrame, done: DataFrame, lossy: bool = False) -> DataFrame:
    """Pairs not yet verified, by problem and type (equal if both null). lossy, for parity with older results, keys on the problem's first 80 characters and the type, so that one result stands for all pairs of that key."""
    if lossy:
        keys = done.select(lossy_key(F.col("problem"), F.col("contrast_type")).alias("_key")).distinct()
        return pairs.join(keys, lossy_key(F.col("problem"), F.col("contrast_type")) == F.col("_key"), "left_anti")
    keys = done.select(F.col("problem").alias("_problem"), F.col("contrast_type").alias("_type")).distinct()
    return pairs.join(keys, F.col("problem").eqNullSafe(F.col("_problem")) & F.col("contrast_type").eqNullSafe(F.col("_type")), "left_anti")


def with_ground_truth(paths: DataFrame, truths: DataFrame) -> DataFrame:
    """paths with ground_truth (null where unknown)."""
    return paths.join(truths.select("problem", "ground_truth"), "problem", "left")


def verify_paths(paths: DataFrame, truths: DataFrame) -> DataFrame:
    """paths with status: no_ground_truth, passed or failed."""
    joined = with_ground_truth(paths, truths)
    passed = answers.verify(F.col("final_answer"), F.col("ground_truth"))
    return joined.withColumn("status", F.when(F.col("ground_truth").isNull(), "no_ground_truth").when(passed, "passed").otherwise("failed"))


def verification_stats(verified: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    rate = F.coalesce(F.try_divide(n("passed") * 100.0, F.count(F.lit(1))), F.lit(0.0))
    return verified.agg(F.count(F.lit(1)).alias("total"), n("passed").alias("passed"), n("failed").alias("failed"), n("no_ground_truth").alias("missing"), rate.alias("pass_rate"))


def verified_records(paths: DataFrame) -> DataFrame:
    """schema.VERIFIED of passed paths: steps joined by newlines, not numbered."""
    return paths.where(F.col("status") == "passed").select("problem", F.array_join("steps", "\n").alias("solution"), F.col("final_answer").alias("answer"), "source", "contrast_type")


def parse_failures(responses: DataFrame, critique: str = "critique") -> DataFrame:
    """total, failed, failure_rate (percent)."""
    failed = F.count_if(F.col(critique).isNull())
    return responses.agg(F.count(F.lit(1)).alias("total"), failed.alias("failed"), F.coalesce(F.try_divide(failed * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("failure_rate"))


def phase1_stats(trajectories: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: processed problems, those without a correct trajectory, gold trajectories, pairs."""
    from .trajectories import GOLD, stratify

    per = stratify(trajectories).groupBy("problem_id").agg(F.count_if(F.col("stratum") == GOLD).alias("gold"))
    left = per.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("gold") == 0).alias("no_correct"), F.sum("gold").alias("correct_found"))
    right = pairs.agg(F.count(F.lit(1)).alias("pairs_saved"))
    # two single-row tables
    return left.withColumn("_1", F.lit(1)).join(right.withColumn("_1", F.lit(1)), "_1").drop("_1")


def first_rows(rows: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first limit rows; none or zero is no limit."""
    return rows.orderBy(*order).limit(limit) if limit else rows


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with ord (from 0) in order; rows that order leaves equal are numbered in some fixed way.

    The rows are range-partitioned and sorted once, into a cut. Numbers of partitions and within them, and the counts that
    lead from these to ord, all come from that one placement (a second plan of it would draw other range bounds). No task
    holds all rows.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = counts.select("_part", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn("ord", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_at", "_before")


def shard(rows: DataFrame, order: list[Column], n_shards: int) -> DataFrame:
    """rows with ord and shard: contiguous pieces of ceil(n / n_shards) rows; the last ones may be empty."""
    found = numbered(rows, order)
    size = -(-found.count() // n_shards) or 1
    return found.withColumn("shard", F.floor(F.col("ord") / size).cast("int"))


def progress(stats: DataFrame, total: Column, done: Column, seconds: Column) -> DataFrame:
    """stats with seconds_each, per_hour and eta_hours of the rest; null rates before any time or row is counted."""
    rate = F.try_divide(done * 3600.0, seconds)
    return stats.withColumns({"seconds_each": F.try_divide(seconds * 1.0, done), "per_hour": rate, "eta_hours": F.try_divide((total - done) * 1.0, rate)})


def accuracy(details: DataFrame, *by: str) -> DataFrame:
    """correct, total, accuracy (percent; null without rows) by group."""
    correct = F.count_if("correct")
    return details.groupBy(*by).agg(correct.alias("correct"), F.count(F.lit(1)).alias("total"), F.try_divide(correct * 100.0, F.count(F.lit(1))).alias("accuracy"))


def sft_records(paths: DataFrame) -> DataFrame:
    return paths.select("problem", numbered_solution(F.col("steps")).alias("solution"))


def mask_labels(prompt_length: Column, full_ids: Column, eos_id: int, max_length: int) -> tuple[Column, Column, Column]:
    """input_ids, attention_mask, labels: ids cut to leave room for the end id, prompt positions masked by -100."""
    ids = F.concat(F.slice(full_ids, 1, max_length - 1), F.array(F.lit(eos_id).cast("int")))
    masked = F.least(F.least(prompt_length, F.lit(max_length)), F.size(ids))
    labels = F.concat(F.array_repeat(F.lit(-100), masked), F.slice(ids, masked + 1, F.greatest(F.size(ids) - masked, F.lit(0))))
    return ids, F.array_repeat(F.lit(1), F.size(ids)), labels


def pad_batches(rows: DataFrame, batch: str, pad_id: int, side: str = "right") -> DataFrame:
    """input_ids, attention_mask and labels padded to the longest row of their batch."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    out = rows.withColumn("_pad", longest - F.size("input_ids"))
    for name, fill in (("input_ids", pad_id), ("attention_mask", 0), ("labels", -100)):
        parts = [F.col(name), F.array_repeat(F.lit(fill), F.col("_pad"))]
        out = out.withColumn(name, F.concat(*(parts if side == "right" else parts[::-1])))
    return out.drop("_pad")
