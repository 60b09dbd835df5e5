"""Prompt building. Templates are parameters; the ones below are fixed values where results depend on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import format_steps, numbered_solution

# Layouts of prompts, with their slots.
EXPANSION = (
    "Problem: {problem}\n"
    "Write the next single step in solving this problem. Do NOT write the full solution, just one reasoning step.\n"
    "Solution so far:{steps}\n"
    "Next step:"
)
SIMULATION = "{exemplars}Problem: {problem}\nSolution:{steps}"
ZERO_SHOT = "{problem}\nPlease reason step by step, and put your final answer within \\boxed{}."
FEW_SHOT = "{exemplars}Problem: {problem}\nSolution:"
EXEMPLAR = "Problem: {problem}\nSolution: {solution}\n\n"
NO_STEPS = "No steps yet."
MISSING = "N/A"

#: The wording of system prompts and of the analysis and synthesis requests changes no operator's result; these are ours,
#: and callers pass their own.
ANALYSIS_SYSTEM = "You compare two solutions of one problem, step by step and as a whole, and answer in JSON."
ANALYSIS_USER = (
    "**Problem:**\n{problem}\n\n**Trajectory A (Correct):**\n{positive}\n\n**Trajectory B (Incorrect):**\n{negative}\n\n"
    "Answer with one JSON object with the keys divergence_step_index (integer), local_step_critique (object with "
    "trajectory_a_logic, trajectory_b_logic, critique_of_difference), global_strategic_analysis (string) and "
    "synthesized_guidance (object with success_pattern, failure_mode_to_avoid), and nothing else."
)
SYNTHESIS_SYSTEM = "You write a numbered solution that takes the insights given as your own and never mentions them."
SYNTHESIS_USER = (
    "**Problem:**\n{problem}\n\n- What works: {success_pattern}\n- What to avoid: {failure_mode_to_avoid}\n"
    "- At step {divergence_step_index}: {critique_of_difference}\n- Overview: {global_strategic_analysis}\n\n"
    "Style: {style}\n\nStep 1: ...\nFinal Answer: \\boxed{...}"
)
STYLE = "Numbered steps, formulas in LaTeX, no remarks about the task."
LIBRARY_EXPANSION = "{system}\n\n**Problem:**\n{problem}\n\n**Reasoning so far:**\n{steps}\n\nWrite the next step only."
LIBRARY_SIMULATION = "{system}\n\n**Problem:**\n{problem}\n\n**Reasoning so far:**\n{steps}\n\nFinish the solution and close with Final Answer: \\boxed{...}"


def fill(template: str, **slots: Column) -> Column:
    """template with {name} slots filled; other braces stand for themselves."""
    import re

    parts, at = [], 0
    for m in re.finditer("|".join(rf"\{{{k}\}}" for k in slots), template):
        parts += [F.lit(template[at : m.start()]), slots[m[0][1:-1]]]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def exemplar_text(exemplars: list[tuple[str, str]]) -> str:
    return "".join(EXEMPLAR.replace("{problem}", q).replace("{solution}", a) for q, a in exemplars)


def expansion_prompt(problem: Column, steps: Column) -> Column:
    return fill(EXPANSION, problem=problem, steps=format_steps(steps))


def simulation_prompt(problem: Column, steps: Column, exemplars: list[tuple[str, str]] = ()) -> Column:
    return fill(SIMULATION, exemplars=F.lit(exemplar_text(list(exemplars))), problem=problem, steps=format_steps(steps))


def library_prompt(template: str, system: str, problem: Column, steps: Column) -> Column:
    """Alternative expansion and simulation prompts, with numbered steps."""
    shown = F.when(F.size(steps) == 0, F.lit(NO_STEPS)).otherwise(numbered_solution(steps))
    return fill(template, system=F.lit(system), problem=problem, steps=shown)


def _pair(system: str, user: Column) -> Column:
    return F.struct(F.lit(system).alias("system"), user.alias("user"))


def analysis_prompt(problem: Column, positive: Column, negative: Column, system: str = ANALYSIS_SYSTEM, user: str = ANALYSIS_USER) -> Column:
    """Struct of system and user text; positive and negative are formatted trajectories."""
    return _pair(system, fill(user, problem=problem, positive=positive, negative=negative))


def synthesis_prompt(problem: Column, critique: Column, system: str = SYNTHESIS_SYSTEM, user: str = SYNTHESIS_USER, style: str = STYLE) -> Column:
    """Absent values show as N/A, empty ones as they are."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    local = F.try_element_at(critique["local_step_critique"], F.lit("critique_of_difference"))
    slots = {k: shown(critique[k]) for k in ("success_pattern", "failure_mode_to_avoid", "divergence_step_index", "global_strategic_analysis")}
    return _pair(system, fill(user, problem=problem, critique_of_difference=shown(local), style=F.lit(style), **slots))


def eval_prompt(problem: Column, exemplars: list[tuple[str, str]] | None = None) -> Column:
    """Few-shot with exemplars, else zero-shot."""
    if exemplars:
        return fill(FEW_SHOT, exemplars=F.lit(exemplar_text(exemplars)), problem=problem)
    return fill(ZERO_SHOT, problem=problem)


def benchmark_prompt(problem: Column, bench: Column, exemplars: dict[str, list[tuple[str, str]]], other: list[tuple[str, str]]) -> Column:
    """Few-shot with the exemplars of the first key that the benchmark's name (in lower case) holds, else the others."""
    shown = eval_prompt(problem, other)
    for key, own in reversed(exemplars.items()):
        shown = F.when(F.contains(F.lower(bench), F.lit(key)), eval_prompt(problem, own)).otherwise(shown)
    return shown


def chat_text(messages: Column) -> Column:
    """An array of role and content as plain lines; other roles are dropped; ends with the assistant's turn."""
    role = lambda m: F.when(m["role"] == "system", "System").when(m["role"] == "user", "User").when(m["role"] == "assistant", "Assistant")
    known = F.filter(messages, lambda m: role(m).isNotNull())
    return F.concat(F.array_join(F.transform(known, lambda m: F.concat(role(m), F.lit(": "), m["content"], F.lit("\n"))), ""), F.lit("Assistant:"))
