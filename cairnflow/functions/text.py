"""String functions with the semantics of Unicode-aware stripping, splitting and step formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the data's producers strip it: Unicode's, and the four separators below the space.
SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"(?U)\A{SPACE}+", ""), rf"(?U){SPACE}+\z", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"(?U)[^\s\x1c-\x1f]")


def words(c: Column) -> Column:
    """Parts between white space, none of them empty."""
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def token_count(c: Column) -> Column:
    return F.size(words(c))


def hard_split(c: Column, max_tokens: int) -> Column:
    """Pieces of at most max_tokens words, joined by single spaces."""
    # the words are bound to a lambda's variable: named in the inner lambda, their expression would run for each piece
    pieces = lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(max_tokens)), lambda i: F.array_join(F.slice(w, i, max_tokens), " "))
    none = F.array().cast("array<string>")
    return F.element_at(F.transform(F.array(words(c)), lambda w: F.when(F.size(w) > 0, pieces(w)).otherwise(none)), 1)


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank: how text without formulas and without long lines falls into steps."""
    return F.transform(F.filter(F.split(c, "\n"), lambda s: ~is_blank(s)), strip)


def format_steps(steps: Column) -> Column:
    """Steps as the continuation of a prompt."""
    return F.when(F.size(steps) == 0, F.lit(" ")).otherwise(F.concat(F.lit(" "), F.array_join(steps, " ")))


def numbered_solution(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")


def rollout_text(steps_text: Column, completion: Column) -> Column:
    done = F.coalesce(completion, F.lit(""))
    return F.when(F.length(done) > 0, F.concat(steps_text, F.lit("\n"), done)).otherwise(steps_text)


# Fixed value: what opens a numbered step in a model's answer.
STEP_MARK = r"(?iU)(?:^|\n)\s*\**\s*Step\s+\d+\s*[:.]\s*\**\s*"


def parse_steps(c: Column) -> Column:
    """Numbered steps of an answer, without what stands before the first; the whole answer if it has no marks."""
    parts = F.split(c, STEP_MARK, -1)
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    kept = F.transform(F.filter(rest, lambda s: ~is_blank(s)), strip)
    whole = F.when(is_blank(c), F.array().cast("array<string>")).otherwise(F.array(strip(c)))
    return F.when(F.size(kept) > 0, kept).otherwise(whole)


# Openings of sentences that start a new step.
CONNECTORS = r"(?:Therefore|Thus|Hence|So|Consequently),\s"
ENUMERATIONS = r"(?:Step\s+\d+[:.]\s|\d+[.)]\s|(?:First|Second|Third|Next|Finally),\s)"


def split_before(c: Column, opening: str) -> Column:
    """Text cut before each opening that stands at its start, after a newline, or after a full stop and a space."""
    marked = F.regexp_replace(c, rf"(?mU)((?:(?:^|\n)\s*|(?<=\. )){opening})", "\u0001$1")
    return F.filter(F.split(marked, "\u0001"), lambda s: ~is_blank(s))


def ordered_distinct(candidates: Column) -> Column:
    """Stripped candidates without blanks and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(candidates, strip), lambda s: s != ""))
