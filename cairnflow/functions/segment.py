"""Segmentation of reasoning text into steps, formulas kept whole."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import in_pieces
from .text import CONNECTORS, ENUMERATIONS, lines

MAX_TOKENS = 256
# Formulas, in the order in which they are hidden (and shown again: one within another stays hidden).
FORMULAS = [re.compile(p, re.DOTALL) for p in (r"\\\[.*?\\\]", r"\\\(.*?\\\)", r"\$[^$]+\$")]
_HIDDEN = re.compile("\x00MATH([0-9]+)\x00")
_OPENINGS = [re.compile(rf"(?:(?:^|\n)\s*|(?<=\. )){p}", re.MULTILINE) for p in (CONNECTORS, ENUMERATIONS)]


def hide_formulas(text: str) -> tuple[str, list[str]]:
    hidden: list[str] = []

    def name(m: re.Match) -> str:
        hidden.append(m[0])
        return f"\x00MATH{len(hidden) - 1}\x00"

    for pattern in FORMULAS:
        text = pattern.sub(name, text)
    return text, hidden


def show_formulas(text: str, hidden: list[str]) -> str:
    """Put formulas back in one pass. A formula hidden within another one's text stays hidden."""
    return _HIDDEN.sub(lambda m: hidden[int(m[1])] if int(m[1]) < len(hidden) else m[0], text)


def masked(c: Column) -> Column:
    """Struct of masked (formulas hidden) and shown (put back)."""

    @F.pandas_udf("masked string, shown string")
    def run(texts):
        import pandas as pd

        found = [(None, None) if t is None else (hide_formulas(t)[0], show_formulas(*hide_formulas(t))) for t in texts]
        return pd.DataFrame(found, columns=["masked", "shown"], dtype=object)

    return run(c)


def _cut(text: str, places: list[int]) -> list[str]:
    edges = [0, *(p for p in places if p > 0), len(text)]
    return [text[a:b] for a, b in zip(edges, edges[1:])]


def _pack(text: str, limit: int, count) -> list[str]:
    out: list[list[str]] = []
    room = -1
    for word in text.split():
        need = count(word)
        if not out or room < need and out[-1]:
            out.append([])
            room = limit
        out[-1].append(word)
        room -= need
    return [" ".join(w) for w in out]


def segment_steps(text: str | None, max_tokens: int = MAX_TOKENS, count=lambda s: len(s.split())) -> list[str]:
    """Lines; those over max_tokens are cut further at LaTeX line breaks, connectors, enumerations, and at last anywhere between words."""
    if not text or not text.strip():
        return []
    masked, hidden = hide_formulas(text)
    cutters = [lambda s: s.split("\\\\") if "\\\\" in s else [s], *(lambda s, p=p: _cut(s, [m.start() for m in p.finditer(s)]) for p in _OPENINGS)]
    parts = [s for s in masked.split("\n") if s.strip()]
    for cutter in cutters:
        parts = [p for s in parts for p in (filter(str.strip, cutter(s)) if count(s) > max_tokens else [s])]
    parts = [p for s in parts for p in (_pack(s, max_tokens, count) if count(s) > max_tokens else [s])]
    return [show_formulas(s, hidden) for s in map(str.strip, parts) if s]


def segment(c: Column, max_tokens: int = MAX_TOKENS) -> Column:
    """Exact segmentation. Text without formulas, NULs and long lines takes the built-in path; only the rest reaches Python."""

    exact = F.arrow_udf(in_pieces(lambda t: segment_steps(t, max_tokens), "list"), "array<string>", F.ArrowUDFType.SCALAR_ITER)
    # a line of over n words has over 2n - 1 characters
    plain = ~c.rlike(rf"(?dm)[$\x00\x0b\x0c\x1c-\x1e\x85\u2028\u2029]|\\[\[(]|^[^\n]{{{2 * max_tokens},}}")
    return F.coalesce(F.when(plain, lines(c)), exact(F.when(~plain, c)))


def format_trajectory(steps: Column) -> Column:
    """Steps cut anew (kept if nothing is left), numbered from 1."""

    def one(x: list) -> str:
        flat = [p for s in x for p in (segment_steps(s) or [s])]
        return "\n".join(f"Step {i}: {s}" for i, s in enumerate(flat, 1))

    return F.arrow_udf(in_pieces(one, "string"), "string", F.ArrowUDFType.SCALAR_ITER)(steps)
