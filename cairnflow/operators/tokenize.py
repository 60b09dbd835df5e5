"""Tokenized training rows: prompt and solution as ids, labels masked over the prompt. Uses the tokenizers library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.batches import pieces, text_sizes
from .datasets import mask_labels


def tokenize(rows: DataFrame, tokenizer_path: str, columns: dict[str, str]) -> DataFrame:
    """rows with ids (array<int>) of text columns, by name; a null text is empty. The driver reads the tokenizer file, tasks get its content."""
    with open(tokenizer_path, encoding="utf-8") as f:
        description = rows.sparkSession.sparkContext.broadcast(f.read())
    names, places = rows.columns, [rows.columns.index(c) for c in columns.values()]

    def run(batches: Iterator) -> Iterator:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(description.value)
        for b in batches:
            # an encoding takes some hundred times the memory of its ids, so few are there at once
            for start, n in pieces(text_sizes(*[b.column(k) for k in places])):
                part = b.slice(start, n)
                found = [pa.array([encoder.encode_batch_fast([t or ""], add_special_tokens=False)[0].ids for t in part.column(k).to_pylist()], pa.list_(pa.int32())) for k in places]
                yield pa.RecordBatch.from_arrays([*part.columns, *found], [*names, *columns])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{ddl}, " + ", ".join(f"`{c}` array<int>" for c in columns))


def plain_template(user: Column, solution: Column | None = None) -> Column:
    """The request, and the solution on a line of its own."""
    return F.concat(user, F.lit("\n"), *([] if solution is None else [solution]))


def chat_template(user: Column, solution: Column | None = None) -> Column:
    """Turns as lines; the prompt ends where the assistant's turn begins."""
    asked = prompts.chat_text(F.array(F.struct(F.lit("user").alias("role"), user.alias("content"))))
    return asked if solution is None else F.concat(asked, F.lit(" "), solution)


def sft_rows(records: DataFrame, tokenizer_path: str, eos_id: int, max_length: int, template: Callable[..., Column] = plain_template) -> DataFrame:
    """records (problem, solution) with input_ids, attention_mask, labels, of at most max_length ids with the end id."""
    user = prompts.eval_prompt(F.col("problem"))
    texts = records.withColumns({"_prompt": template(user), "_full": template(user, F.coalesce("solution", F.lit("")))})
    ids = tokenize(texts, tokenizer_path, {"_prompt_ids": "_prompt", "_full_ids": "_full"})
    inputs, mask, labels = mask_labels(F.size("_prompt_ids"), F.col("_full_ids"), eos_id, max_length)
    return ids.select(*records.columns, inputs.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))
