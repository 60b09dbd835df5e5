"""Trajectories: collection, strata, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers
from .trees import terminal_paths

GOLD, HARD, SOFT = "gold_positive", "hard_negative", "soft_negative"


def collect(nodes: DataFrame, problems: DataFrame, extract=answers.extract_pipeline, verify=answers.verify) -> DataFrame:
    """Trajectories (schema.TRAJECTORY) of trees; correctness comes from the answer in the actions, not from the reward."""
    found = terminal_paths(nodes).join(problems.select("problem_id", "ground_truth"), "problem_id")
    found = found.withColumn("final_answer", extract(F.array_join("steps", "\n")))
    return found.withColumn("is_correct", verify(F.col("final_answer"), F.col("ground_truth"))).drop("ground_truth", "node_id")


def split_correct(trajectories: DataFrame) -> tuple[DataFrame, DataFrame]:
    return trajectories.where("is_correct"), trajectories.where("not is_correct")


def stratify(trajectories: DataFrame) -> DataFrame:
    """trajectories with min_correct_length and stratum: shortest correct, other correct, incorrect."""
    least = F.min(F.when(F.col("is_correct"), F.col("length"))).over(Window.partitionBy("problem_id"))
    stratum = F.when(~F.col("is_correct"), HARD).when(F.col("length") == F.col("min_correct_length"), GOLD).otherwise(SOFT)
    return trajectories.withColumn("min_correct_length", least).withColumn("stratum", stratum)


def anchors(trajectories: DataFrame) -> DataFrame:
    """A row per problem with a correct trajectory: the shortest one, of these the one of highest max_q_value, of these the first. Partial aggregation, no sort."""
    order = F.struct(F.col("length"), -F.col("max_q_value"), F.col("traj_ord"))
    best = F.min_by(F.struct(*[c for c in trajectories.columns if c != "problem_id"]), order)
    return trajectories.where("is_correct").groupBy("problem_id").agg(best.alias("anchor")).select("problem_id", "anchor.*")


def without_gold(trajectories: DataFrame) -> DataFrame:
    """Problems that have no correct trajectory."""
    return trajectories.groupBy("problem_id").agg(F.max("is_correct").alias("any")).where("not any").select("problem_id")


def with_gold_only(trajectories: DataFrame) -> DataFrame:
    gold = trajectories.where("is_correct").select("problem_id").distinct()
    return trajectories.join(gold, "problem_id", "left_semi")
