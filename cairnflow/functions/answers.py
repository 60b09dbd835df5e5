"""Answer extraction, normalization and equality, each variant under its own name.

Regular expressions run in Java: (?U) makes classes Unicode-aware, (?d) makes the newline the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

BOX = "\\boxed{"
# Patterns that results depend on.
FINAL_ANSWER = r"(?sU)[Ff]inal\s+[Aa]nswer\s*:\s*(.+?)(?:\n|\z)"
THE_ANSWER_IS = r"(?sU)[Tt]he\s+answer\s+is\s*:?\s*(.+?)(?:\.\s|\.\z|\n|\z)"
NUMBER_REWARD = r"(?U)-?\d+(?:\.\d+)?"
NUMBER_PIPELINE = r"(?U)-?\d+(?:,\d{3})*(?:\.\d+)?(?:/\d+)?"
NUMBER_EVAL = r"(?U)[-+]?\d*\.?\d+"
BOX_EVAL = r"\\boxed\{((?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+)\}"
ANSWER_EVAL = r"(?dU)(?:The answer is|the answer is)\s*[:\s]*(.*?)(?:\.|$)"
GSM_ANSWER = r"(?dU)####\s*(.+)"


def balanced_box(text: Column) -> Column:
    """What the last \\boxed{ encloses, braces balanced; null without one or if it isn't closed."""
    tail = F.substring_index(text, BOX, -1)
    pieces = F.regexp_extract_all(tail, F.lit(r"[^{}]*[{}]"), F.lit(0))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("taken"))
    walk = F.aggregate(
        pieces,
        start,
        lambda at, piece: F.when(at["depth"] == 0, at).otherwise(
            F.struct((at["depth"] + F.when(F.endswith(piece, F.lit("{")), 1).otherwise(-1)).alias("depth"), (at["taken"] + F.length(piece)).alias("taken"))
        ),
    )
    return F.when(F.contains(text, F.lit(BOX)) & (walk["depth"] == 0), F.substring(tail, F.lit(1), walk["taken"] - 1))


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """The last match, or null."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def first_group(text: Column, pattern: str) -> Column:
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def extract_reward(text: Column) -> Column:
    """For rewards: the last box, else the last number, else null."""
    return F.coalesce(strip(balanced_box(text)), last_match(text, NUMBER_REWARD))


def extract_pipeline(text: Column) -> Column:
    """For trajectories: the last box, the first "Final Answer:", the first "The answer is", the last number; null for none and for empty text."""
    number = F.replace(last_match(text, NUMBER_PIPELINE), F.lit(","), F.lit(""))
    return F.when(text != "", F.coalesce(strip(balanced_box(text)), first_group(text, FINAL_ANSWER), first_group(text, THE_ANSWER_IS), number))


def truncate_continuation(text: Column) -> Column:
    """Text before the next problem that a base model goes on with."""
    for mark in ("\nProblem:", "\n\nProblem:"):
        at = F.instr(text, mark) - 1
        text = F.when(at > 0, F.substring(text, F.lit(1), at)).otherwise(text)
    return text


def extract_eval(text: Column, few_shot: bool = False) -> Column:
    """For evaluation: the last box of at most two inner levels, the first "The answer is" to its first full stop, the last number, else empty."""
    text = truncate_continuation(text) if few_shot else text
    return F.coalesce(strip(last_match(text, BOX_EVAL, 1)), first_group(text, ANSWER_EVAL), last_match(text, NUMBER_EVAL), F.when(text.isNotNull(), F.lit("")))


def gsm_ground_truth(answer: Column) -> Column:
    return F.coalesce(F.replace(first_group(answer, GSM_ANSWER), F.lit(","), F.lit("")), strip(answer))


def math_ground_truth(solution: Column) -> Column:
    """What the first box encloses, else the whole solution."""
    return F.coalesce(first_group(solution, BOX_EVAL), strip(solution))


def replace_all(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


# Replacements in order.
PIPELINE_REPLACEMENTS = [
    ("\\frac", "frac"),
    ("\\dfrac", "frac"),
    ("\\tfrac", "frac"),
    ("\\left", ""),
    ("\\right", ""),
    ("\\,", ""),
    ("\\;", ""),
    ("\\!", ""),
    ("\\quad", " "),
    ("\\text", ""),
    ("\\mathrm", ""),
    ("\\mathbf", ""),
]
EVAL_REPLACEMENTS = [
    ("\\dfrac", "\\frac"),
    ("\\tfrac", "\\frac"),
    ("\\left(", "("),
    ("\\right)", ")"),
    ("\\left[", "["),
    ("\\right]", "]"),
    ("\\left{", "{"),
    ("\\right}", "}"),
    ("\\left|", "|"),
    ("\\right|", "|"),
]


def normalize_pipeline(answer: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(strip(F.coalesce(answer, F.lit(""))), r"\A\$+", ""), r"\$+\z", "")
    s = F.regexp_replace(replace_all(s, PIPELINE_REPLACEMENTS), r"(?U)(\d),(\d)", "$1$2")
    return strip(F.regexp_replace(s, r"(?U)[\s\x1c-\x1f]+", " "))


_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = rf"\A[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"


def as_float(c: Column) -> Column:
    """A decimal literal's value, or null; letters such as a trailing d are no literal."""
    return F.when(c.rlike(_FLOAT), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def six_places(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("%.6f", x))


def normalize_eval(answer: Column) -> Column:
    s = F.regexp_replace(replace_all(strip(answer), EVAL_REPLACEMENTS), r"(?U)[\s\x1c-\x1f]+", "")
    s = replace_all(s, [("$", ""), ("%", "")])
    parts = F.split(s, "/", -1)
    over, under = as_float(F.get(parts, 0)), as_float(F.get(parts, 1))
    quotient = F.when((F.size(parts) == 2) & ~F.contains(s, F.lit("\\")) & (under != 0), over / F.nullif(under, F.lit(0.0)))
    return F.coalesce(six_places(quotient), six_places(as_float(s)), F.lower(s))


def verify_exact(predicted: Column, truth: Column) -> Column:
    """Equality of normal forms; null or empty ones are equal to nothing."""
    a, b = normalize_pipeline(predicted), normalize_pipeline(truth)
    return F.coalesce(predicted.isNotNull() & truth.isNotNull() & (a != "") & (b != "") & (a == b), F.lit(False))


def check_exact(predicted: Column, truth: Column) -> Column:
    return F.coalesce((predicted != "") & (normalize_eval(predicted) == normalize_eval(truth)), F.lit(False))


def verify(predicted: Column, truth: Column) -> Column:
    """verify_exact, and for pairs that it leaves open the symbolic comparison (only these reach Python work)."""
    from .symbolic import equal_udf

    exact, a, b = verify_exact(predicted, truth), normalize_pipeline(predicted), normalize_pipeline(truth)
    open_ = ~exact & predicted.isNotNull() & truth.isNotNull() & (a != "") & (b != "")
    return exact | equal_udf(F.when(open_, a), F.when(open_, b))


def check(predicted: Column, truth: Column) -> Column:
    from .symbolic import same_udf

    exact = check_exact(predicted, truth)
    open_ = ~exact & F.coalesce(predicted != "", F.lit(False))
    return exact | same_udf(F.when(open_, predicted), F.when(open_, truth))


def binary_reward(text: Column, truth: Column) -> Column:
    return F.when(verify(extract_reward(text), truth), 1.0).otherwise(0.0)

