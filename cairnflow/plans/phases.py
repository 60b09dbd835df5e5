"""The phases end to end: problems to contrastive pairs, pairs to verified solutions, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, prompts, text
from ..functions.critique import parse_critique
from ..functions.segment import format_trajectory
from ..operators import datasets, sampling, trajectories
from ..schema import VERIFIED
from .plugins import OWN, Plugins
from .provider import TextProvider, generate
from .search import Settings, search_trees


def phase1(seeds: DataFrame, factory: Callable[[], TextProvider], settings: Settings | None = None, k: int = sampling.K, seed: int = sampling.SEED, plugins: Plugins = OWN) -> DataFrame:
    """Pair records (schema.PAIR) of seeds (problem_id, problem, ground_truth, source)."""
    found = trajectories.collect(search_trees(seeds, factory, settings), seeds, plugins.extract, plugins.verify)
    return sampling.pair_records(sampling.contrastive_pairs(found, k, seed=seed), seeds)


def analyze(pairs: DataFrame, factory: Callable[[], TextProvider], max_tokens: int = 1024, plugins: Plugins = OWN, keep: list[str] | None = None) -> DataFrame:
    """Pair records, or their columns keep, with analysis (the model's text) and critique (null where it can't be parsed)."""
    ask = plugins.analysis(F.col("problem"), format_trajectory(F.col("positive_steps")), format_trajectory(F.col("negative_steps")))
    asked = pairs.select(*(keep or pairs.columns), ask["user"].alias("prompt"), ask["system"].alias("system"))
    return generate(asked, factory, out="analysis", max_tokens=max_tokens, system="system").drop("prompt", "system").withColumn("critique", parse_critique(F.col("analysis")))


def synthesize(judged: DataFrame, factory: Callable[[], TextProvider], max_tokens: int = 2048, plugins: Plugins = OWN) -> DataFrame:
    """Rows of problem and critique with solution (the model's text), steps and final_answer."""
    write = plugins.synthesis(F.col("problem"), F.col("critique"))
    told = judged.withColumns({"prompt": write["user"], "system": write["system"]})
    solved = generate(told, factory, out="solution", max_tokens=max_tokens, system="system").drop("prompt", "system")
    return solved.withColumn("steps", text.parse_steps(F.col("solution"))).withColumn("final_answer", plugins.extract(F.col("solution")))


def phase2(pairs: DataFrame, factory: Callable[[], TextProvider], analysis_tokens: int = 1024, synthesis_tokens: int = 2048, plugins: Plugins = OWN) -> DataFrame:
    """Verified records (schema.VERIFIED) of pair records. Filters stand before the calls that they save, and columns are dropped before they travel."""
    judged = analyze(pairs, factory, analysis_tokens, plugins, ["problem", "ground_truth", "source", "contrast_type"]).where("critique is not null")
    kept = judged.select("problem", "ground_truth", F.coalesce("source", F.lit("unknown")).alias("source"), "contrast_type", "critique")
    solved = synthesize(kept, factory, synthesis_tokens, plugins)
    passed = plugins.verify(F.col("final_answer"), F.col("ground_truth"))
    return datasets.verified_records(solved.withColumn("status", F.when(passed, "passed").otherwise("failed")))


def phase2_until(pairs: DataFrame, factory: Callable[[], TextProvider], target: int, order: list, chunk: int, path: str) -> int:
    """Append verified records to path, chunk pairs at a time in order, until target records are there; returns their number.

    A limit alone would not save the calls before it. Pairs are put in order once, so each chunk sees its own pairs and
    every pair is seen once. Only counts come to the driver.
    """
    spark = pairs.sparkSession
    placed = datasets.numbered(pairs, order)
    have = 0
    for k in range(-(-placed.count() // chunk)):
        if have >= target:
            break
        part = placed.where(F.col("ord").between(k * chunk, (k + 1) * chunk - 1)).drop("ord")
        phase2(part, factory).orderBy("problem", "contrast_type", "solution").limit(target - have).write.mode("append").json(path)
        have = spark.read.schema(VERIFIED).json(path).count()
    return have


def evaluate(problems: DataFrame, factory: Callable[[], TextProvider], exemplars: list[tuple[str, str]] | None = None, max_tokens: int = 4096) -> DataFrame:
    """problems (problem, ground_truth, ...) with response, predicted, correct."""
    asked = problems.withColumn("prompt", prompts.eval_prompt(F.col("problem"), exemplars))
    found = generate(asked, factory, max_tokens=max_tokens).drop("prompt")
    found = found.withColumn("predicted", answers.extract_eval(F.col("response"), bool(exemplars)))
    return found.withColumn("correct", answers.check(F.col("predicted"), F.col("ground_truth")))
