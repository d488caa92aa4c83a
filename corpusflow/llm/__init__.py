"""Operators for training data. Nothing outside this subpackage imports it."""

from corpusflow.llm import alignment, language, leakage, lookalike, packing, split, truncation

MODULES = [split, alignment, truncation, lookalike, packing, leakage, language]
