"""Cleaning of raw model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fence markers, in the order in which they are tried, and the clean-up patterns.
FENCE = "```"
OPENERS = ("json```", "```json")
HEX_PATTERN = r": (0x[0-9A-Fa-f]+)"
COMMENT_PATTERN = r'("(?:[^"\\]|\\.)*")|//[^\n]*'


def _after(raw: Column, opener: str) -> Column:
    """Text between an opener and the next fence; the whole text when that fence is missing."""
    rest = F.substr(raw, F.instr(raw, opener) + F.lit(len(opener)))
    return F.when(F.instr(rest, FENCE) > 0, F.substring_index(rest, FENCE, 1)).otherwise(raw)


def fenced_part(raw: Column) -> Column:
    first, second = OPENERS
    return (
        F.when(F.instr(raw, FENCE) == 0, raw)
        .when(F.instr(raw, first) > 0, _after(raw, first))
        .when(F.instr(raw, second) > 0, _after(raw, second))
        .otherwise(raw)
    )


def clean_answer(raw: Column) -> Column:
    """Fenced part, tripled quotes reduced, bare hex quoted, ``//`` comments cut."""
    single = F.replace(fenced_part(raw), F.lit('"""'), F.lit('"'))
    quoted = F.regexp_replace(single, HEX_PATTERN, ': "$1"')
    return F.regexp_replace(quoted, COMMENT_PATTERN, "$1")
