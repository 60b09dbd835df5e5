"""Writers: JSON lines by append or overwrite, evaluation details and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import accuracy, sft_records, shard
from ..operators.sampling import resample


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_dataset(paths: DataFrame, target: int, path: str, key, seed: int = 42) -> None:
    """Training set of exactly target rows (an empty pool gives an empty file): problem, numbered solution."""
    sft_records(resample(paths, target, key, seed)).write.mode("overwrite").json(path)


def write_seed_shards(seeds: DataFrame, order: list[Column], n_shards: int, path: str) -> None:
    """Seed problems in contiguous shards, a folder (shard=k) each."""
    shard(seeds, order, n_shards).drop("ord").write.mode("overwrite").partitionBy("shard").option("ignoreNullFields", "false").json(path)


def write_details(details: DataFrame, path: str) -> None:
    details.write.mode("overwrite").partitionBy("bench").option("ignoreNullFields", "false").json(path)


def eval_summary(details: DataFrame) -> DataFrame:
    """A row per model and few_shot: benchmarks as a map to accuracy, correct, total; all shards together."""
    per = accuracy(details, "model", "few_shot", "bench")
    return per.groupBy("model", "few_shot").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bench", F.struct("accuracy", "correct", "total"))))).alias("benchmarks"))


def write_summary(details: DataFrame, path: str) -> None:
    eval_summary(details).coalesce(1).write.mode("overwrite").json(path)


def write_progress(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)
