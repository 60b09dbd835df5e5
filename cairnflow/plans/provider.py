"""Text providers: where completions come from.

A provider is a callable (prompts, n, max_tokens) -> list of n completions per prompt, made anew in each worker by its
factory; one with a chat method also takes messages with roles. Task retries repeat calls, so providers must be idempotent; Replay is, and real back ends can be wrapped by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TextProvider(Protocol):
    def __call__(self, prompts: list[str], n: int = 1, max_tokens: int = 256) -> list[list[str]]: ...


class Stub:
    """Completions made from the prompt's hash: the same prompt always gets the same ones."""

    def __init__(self, answers: int = 3):
        self.answers = answers

    def __call__(self, prompts: list[str], n: int = 1, max_tokens: int = 256) -> list[list[str]]:
        out = []
        for p in prompts:
            h = [int(sha256(f"{k}:{p}".encode()).hexdigest()[:8], 16) for k in range(n)]
            if n > 1:
                out.append([f"Consider case {x % 5}.\nThen go on." for x in h])
            else:
                out.append([f"So we finish. The answer is {h[0] % self.answers}. Final Answer: \\boxed{{{h[0] % self.answers}}}"])
        return out


class Replay:
    """Recorded completions by prompt; unknown prompts get empty ones, as a failed call does."""

    def __init__(self, recorded: dict[str, list[str]]):
        self.recorded = recorded

    def __call__(self, prompts: list[str], n: int = 1, max_tokens: int = 256) -> list[list[str]]:
        return [(self.recorded.get(p, []) + [""] * n)[:n] for p in prompts]


class HttpChat:
    """Completions of a chat endpoint that takes and gives JSON: model, messages, max_tokens, temperature; choices[0].message.content.

    key_variable names an environment variable with the bearer token, if there is one. Refusals for load and server errors
    are tried again, with growing pauses.
    """

    def __init__(self, url: str, model: str, temperature: float = 0.7, key_variable: str | None = None, retries: int = 3, pause: float = 1.0, timeout: float = 120.0):
        self.url, self.model, self.temperature, self.key_variable = url, model, temperature, key_variable
        self.retries, self.pause, self.timeout = retries, pause, timeout

    def _ask(self, messages: list[dict], max_tokens: int) -> str:
        import json
        import os
        import time
        import urllib.error
        import urllib.request

        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        body = json.dumps({"model": self.model, "messages": messages, "max_tokens": max_tokens, "temperature": self.temperature}).encode()
        for attempt in range(self.retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                    return json.load(answer)["choices"][0]["message"]["content"] or ""
            except (urllib.error.URLError, TimeoutError) as e:
                passing = not isinstance(e, urllib.error.HTTPError) or e.code == 429 or e.code >= 500
                if attempt == self.retries or not passing:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def chat(self, conversations: list[list[dict]], n: int = 1, max_tokens: int = 256) -> list[list[str]]:
        return [[self._ask(c, max_tokens) for _ in range(n)] for c in conversations]

    def __call__(self, prompts: list[str], n: int = 1, max_tokens: int = 256) -> list[list[str]]:
        return self.chat([[{"role": "user", "content": p}] for p in prompts], n, max_tokens)


BACKENDS: dict[str, Callable[..., TextProvider]] = {"stub": Stub, "http": HttpChat}


def provider_factory(name: str, **settings) -> Callable[[], TextProvider]:
    if name not in BACKENDS:
        raise ValueError(f"unknown back end {name!r}; known: {', '.join(sorted(BACKENDS))}")
    make = BACKENDS[name]
    return lambda: make(**settings)


#: Rows of an Arrow batch whose prompts are taken up at once, rounded to whole batches of prompts.
PIECE = 64


def generate(rows: DataFrame, factory: Callable[[], TextProvider], prompt: str = "prompt", out: str = "response", n: int = 1, max_tokens: int = 256, batch: int = 8, system: str | None = None) -> DataFrame:
    """rows with out: the first completion (n = 1) or all (array). One provider per task, batches of prompts.

    system names a column of system texts: a provider with a chat method gets both as messages, others get one text with
    the turns as lines. A batch that fails is asked again prompt by prompt; a prompt that fails gets an empty text and its
    error in <out>_error.
    """
    names, kind = rows.columns, "string" if n == 1 else "array<string>"
    at, told = names.index(prompt), None if system is None else names.index(system)
    step = batch * max(1, PIECE // batch)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        provider = factory()

        def ask(part: list) -> list[list[str]]:
            if told is None:
                return provider([p or "" for _, p in part], n, max_tokens)
            if hasattr(provider, "chat"):
                return provider.chat([[{"role": "system", "content": s or ""}, {"role": "user", "content": p or ""}] for s, p in part], n, max_tokens)
            return provider([f"System: {s or ''}\nUser: {p or ''}\nAssistant:" for s, p in part], n, max_tokens)

        def answer(part: list) -> list[tuple[list[str], str | None]]:
            try:
                return [(list(g), None) for g in ask(part)]
            except Exception as e:  # noqa: BLE001  a back end may raise anything
                if len(part) > 1:
                    return [x for one in part for x in answer([one])]
                return [([""] * n, f"{type(e).__name__}: {e}")]

        for b in batches:
            # prompts and answers of few rows are there as Python's objects at once; provider calls are those of the whole batch
            for start in range(0, b.num_rows, step):
                part = b.slice(start, step)
                prompts = part.column(at).to_pylist()
                systems = [None] * len(prompts) if told is None else part.column(told).to_pylist()
                pairs = list(zip(systems, prompts, strict=True))
                got = [x for k in range(0, len(pairs), batch) for x in answer(pairs[k : k + batch])]
                texts = [g[0] if n == 1 else g for g, _ in got]
                extra = [pa.array(texts, pa.string() if n == 1 else pa.list_(pa.string())), pa.array([e for _, e in got], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*names, out, f"{out}_error"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{ddl}, {out} {kind}, {out}_error string")


def replay(rows: DataFrame, recorded: DataFrame, prompt: str = "prompt", out: str = "response") -> DataFrame:
    """rows with out from recorded (prompt_sha, sample, text): a join on the prompt's hash instead of calls."""
    texts = recorded.groupBy("prompt_sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "text"))), lambda s: s["text"]).alias("_texts"))
    joined = rows.withColumn("_sha", F.sha2(F.col(prompt), 256)).join(texts, F.col("_sha") == F.col("prompt_sha"), "left")
    return joined.withColumn(out, F.coalesce(F.try_element_at("_texts", F.lit(1)), F.lit(""))).drop("_sha", "prompt_sha", "_texts")
