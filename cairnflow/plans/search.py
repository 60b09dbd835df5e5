"""Tree search over reasoning steps: rollouts of select, expand, simulate, back up, many problems at once.

Search is the one imperative part: it runs in mapInArrow, a batch of problems at a time, so that each rollout makes at most
two batched provider calls. Its result is a node table; all that follows is relational.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.prompts import EXPANSION, SIMULATION
from ..functions.segment import segment_steps
from ..functions.symbolic import equal
from ..schema import NODE
from .provider import TextProvider


@dataclass
class Settings:
    c_puct: float = 1.4
    max_depth: int = 16
    max_actions: int = 3
    num_rollouts: int = 10
    expand_max_tokens: int = 256
    simulate_max_tokens: int = 2048
    batch_size: int = 8
    exemplars: str = ""


@dataclass
class Tree:
    """Columns of one tree's nodes; index 0 is the root."""

    parent: list = field(default_factory=lambda: [None])
    order: list = field(default_factory=lambda: [0])
    depth: list = field(default_factory=lambda: [0])
    action: list = field(default_factory=lambda: [None])
    visits: list = field(default_factory=lambda: [0])
    value: list = field(default_factory=lambda: [0.0])
    reward: list = field(default_factory=lambda: [None])
    terminal: list = field(default_factory=lambda: [False])
    children: list = field(default_factory=lambda: [[]])

    def add(self, parent: int, action: str, terminal: bool) -> int:
        for column, x in ((self.parent, parent), (self.order, len(self.children[parent])), (self.depth, self.depth[parent] + 1), (self.action, action), (self.visits, 0), (self.value, 0.0), (self.reward, None), (self.terminal, terminal), (self.children, [])):
            column.append(x)
        self.children[parent].append(len(self.parent) - 1)
        return len(self.parent) - 1

    def score(self, node: int, c: float) -> float:
        n = self.visits[node]
        if n == 0:
            return math.inf
        return self.value[node] / n + c * math.sqrt(math.log(max(self.visits[self.parent[node]], 1)) / n)

    def select(self, c: float) -> int:
        at = 0
        while self.children[at] and not self.terminal[at]:
            at = max(self.children[at], key=lambda x: self.score(x, c))
        return at

    def steps(self, node: int) -> list[str]:
        out = []
        while self.parent[node] is not None:
            out.append(self.action[node])
            node = self.parent[node]
        return out[::-1]

    def back_up(self, node: int, reward: float) -> None:
        while node is not None:
            self.visits[node] += 1
            self.value[node] += reward
            node = self.parent[node]


def usable_actions(candidates: list[str], max_tokens: int) -> list[str]:
    """The first step of each candidate, without blanks and repeats."""
    out: list[str] = []
    for text in candidates:
        text = text.strip()
        if text and text not in out:
            first = (segment_steps(text, max_tokens) or [text])[0].strip()
            if first and first not in out:
                out.append(first)
    return out


def search(problems: list[str], truths: list[str], provider: TextProvider, reward: Callable[[str, str], float], s: Settings) -> list[Tree]:
    trees = [Tree() for _ in problems]
    shown = lambda t, node: " " + " ".join(t.steps(node)) if t.parent[node] is not None else " "
    fill = lambda template, problem, steps: template.replace("{exemplars}", s.exemplars, 1).replace("{steps}", "\0", 1).replace("{problem}", problem, 1).replace("\0", steps, 1)
    for _ in range(s.num_rollouts):
        at = [t.select(s.c_puct) for t in trees]
        grow = [i for i, t in enumerate(trees) if not t.terminal[at[i]] and t.depth[at[i]] < s.max_depth]
        if grow:
            answers = provider([fill(EXPANSION, problems[i], shown(trees[i], at[i])) for i in grow], s.max_actions, s.expand_max_tokens)
            for i, candidates in zip(grow, answers, strict=True):
                t, actions = trees[i], usable_actions(candidates, s.expand_max_tokens)
                if not actions:
                    t.terminal[at[i]], t.reward[at[i]] = True, 0.0
                    continue
                new = [t.add(at[i], a, t.depth[at[i]] + 1 >= s.max_depth) for a in actions]
                at[i] = new[0]
        play = [i for i, t in enumerate(trees) if not (t.terminal[at[i]] and t.reward[at[i]] is not None)]
        if play:
            answers = provider([fill(SIMULATION, problems[i], shown(trees[i], at[i])) for i in play], 1, s.simulate_max_tokens)
            for i, texts in zip(play, answers, strict=True):
                t, steps, done = trees[i], shown(trees[i], at[i]), texts[0].strip() if texts else ""
                t.reward[at[i]] = reward(f"{steps}\n{done}" if done else steps, truths[i])
                t.terminal[at[i]] = True
        for t, node in zip(trees, at, strict=True):
            t.back_up(node, t.reward[node])
    return trees


def last_box(text: str) -> str | None:
    at = text.rfind("\\boxed{")
    if at < 0:
        return None
    depth, begin = 1, at + 7
    for pos in range(begin, len(text)):
        depth += {"{": 1, "}": -1}.get(text[pos], 0)
        if depth == 0:
            return text[begin:pos]
    return None


def binary_reward(text: str, truth: str | None) -> float:
    """1 if the last box or number of text equals truth."""
    import re

    found = last_box(text)
    if found is None:
        numbers = re.findall(r"-?\d+(?:\.\d+)?", text)
        found = numbers[-1] if numbers else None
    if found is None or truth is None or not found.strip() or not truth.strip():
        return 0.0
    a, b = found.strip().strip("$").strip(), truth.strip().strip("$").strip()
    return float(a == b or equal(a.replace("\\dfrac", "frac").replace("\\frac", "frac"), b.replace("\\dfrac", "frac").replace("\\frac", "frac")))


def search_trees(seeds: DataFrame, factory: Callable[[], TextProvider], settings: Settings | None = None, reward: Callable[[str, str], float] = binary_reward) -> DataFrame:
    """Node tables (schema.NODE) of seeds (problem_id, problem, ground_truth). Each task makes one provider."""
    s = settings or Settings()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in NODE.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
        provider = factory()
        for b in batches:
            for at in range(0, b.num_rows, s.batch_size):
                ids, problems, truths = (c.to_pylist() for c in b.slice(at, s.batch_size).columns)
                rows = []
                for key, t in zip(ids, search([p or "" for p in problems], truths, provider, reward, s), strict=True):
                    rows += zip([key] * len(t.parent), range(len(t.parent)), t.parent, t.order, t.depth, t.action, t.visits, t.value, t.reward, t.terminal, strict=True)
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return seeds.select("problem_id", "problem", "ground_truth").mapInArrow(run, NODE)
