"""Readers: JSON lines with explicit schemas, benchmark tables, resume state, configuration."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import is_blank, strip
from ..schema import PAIR, SEED, VERIFIED


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed problems; a malformed line fails the read."""
    return spark.read.schema(SEED).option("mode", "FAILFAST").json(path)


def read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pair records of <folder>/<part>/pairs.jsonl, one level deep; a malformed line fails the read."""
    return spark.read.schema(PAIR).option("mode", "FAILFAST").json(f"{folder}/*/pairs.jsonl")


def read_verified(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VERIFIED).json(path)


def parse_sft_lines(rows: DataFrame, column: str = "value") -> DataFrame:
    """problem and solution of JSON lines; blank, malformed and keyless lines are skipped, null values kept."""
    text = strip(F.col(column))
    keys = F.json_object_keys(text)
    strict = F.try_parse_json(text).isNotNull()
    kept = rows.where(~is_blank(F.col(column)) & strict & F.array_contains(keys, "problem") & F.array_contains(keys, "solution"))
    return kept.select(F.get_json_object(text, "$.problem").alias("problem"), F.get_json_object(text, "$.solution").alias("solution"))


def read_sft(spark: SparkSession, path: str) -> DataFrame:
    return parse_sft_lines(spark.read.text(path))


def gsm_problems(rows: DataFrame) -> DataFrame:
    """From question, answer: problem, ground_truth."""
    return rows.select(F.col("question").alias("problem"), answers.gsm_ground_truth(F.col("answer")).alias("ground_truth"))


def math_problems(rows: DataFrame) -> DataFrame:
    """From problem, solution: problem, ground_truth."""
    return rows.select("problem", answers.math_ground_truth(F.col("solution")).alias("ground_truth"))


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of problem, ground_truth with their source's name, one after the other."""
    out = None
    for name, part in parts.items():
        part = part.select("problem", "ground_truth", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


DEFAULTS = {
    "mcts": {"c_puct": 1.4, "max_depth": 16, "max_actions_per_node": 3, "num_rollouts": 10, "expand_max_tokens": 256, "simulate_max_tokens": 2048, "batch_size": 8},
    "trajectory": {"contrastive_pairs_per_problem": 10},
    "analysis": {"max_tokens": 1024},
    "synthesis": {"max_tokens": 2048},
    "dataset": {"target_size": 30000},
}


def read_config(path: str | None = None) -> dict:
    """Defaults, overridden by a YAML file (if the library is there) or a JSON one; ${NAME} becomes the environment's value."""
    given: dict = {}
    if path:
        with open(path, encoding="utf-8") as f:
            text = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), f.read())
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as e:
                raise RuntimeError("YAML configuration needs the yaml library; JSON doesn't") from e
            given = yaml.safe_load(text) or {}
        else:
            import json

            given = json.loads(text)
    merged = {k: {**v, **(given.get(k) or {})} for k, v in DEFAULTS.items()}
    return {**given, **merged}
