"""What callers can put in the place of the library's own extractors, verifiers and prompts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column

from ..functions import answers, prompts


class Extractor(Protocol):
    def __call__(self, text: Column) -> Column:
        """The answer that a text gives, or null."""


class Verifier(Protocol):
    def __call__(self, predicted: Column, truth: Column) -> Column:
        """Whether an answer is right; never null."""


class AnalysisPrompt(Protocol):
    def __call__(self, problem: Column, positive: Column, negative: Column) -> Column:
        """Struct of system and user text."""


class SynthesisPrompt(Protocol):
    def __call__(self, problem: Column, critique: Column) -> Column:
        """Struct of system and user text."""


@dataclass(frozen=True)
class Plugins:
    extract: Extractor = answers.extract_pipeline
    verify: Verifier = answers.verify
    analysis: AnalysisPrompt = prompts.analysis_prompt
    synthesis: SynthesisPrompt = prompts.synthesis_prompt


OWN = Plugins()
