"""Raw model answers derived from ``events``: one answer per event, twelve shapes.

A shape is a template over ``{u}`` (user), ``{s}`` and ``{e}`` (line range), ``{k}`` (event id),
rendered as a Spark expression for the query and as SQL text for its oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import spread, table

_FOUND = '{"actions": [{"name": "found_target", "input": {"function_name": "f{u}", "start_line": {s}, "end_line": {e}}}]}'
_RETRIES = (
    '{"actions": [{"name": "retry_with", "input": {"start": 1, "end": 3}}, '
    '{"name": "retry_with", "input": {"start": {s}, "end": {e}, "omitted_lines": "2-3"}}]}'
)
_CALLS = (
    '{"actions": [{"name": "record_function_call", "input": {"name": "g{u}", "file_line": {s}}}, '
    '{"name": "record_function_call", "input": {"name": "h{u}", "file_line": "{e}"}}]}'
)

# Per shape: raw text, text after cleaning, actions as (name, key field, first int, second int).
SHAPES = [
    (_FOUND, _FOUND, [("found_target", "f{u}", "{s}", "{e}")]),
    ("Here you are:\n```json\n" + _FOUND + "\n```\nDone.", "\n" + _FOUND + "\n", [("found_target", "f{u}", "{s}", "{e}")]),
    ("json```" + _FOUND + "``` and more", _FOUND, [("found_target", "f{u}", "{s}", "{e}")]),
    (
        '{"actions": [ // the only one\n{"name": "found_target", "input": {"function_name": "f{u}", '
        '"start_line": {s}, "end_line": {e}, "file": "http://x/{k}.py"}}]} // end',
        '{"actions": [ \n{"name": "found_target", "input": {"function_name": "f{u}", '
        '"start_line": {s}, "end_line": {e}, "file": "http://x/{k}.py"}}]} ',
        [("found_target", "f{u}", "{s}", "{e}")],
    ),
    (
        '{"actions": [{"name": "found_target", "input": {"function_name": 0x1f{u}, "start_line": {s}, "end_line": {e}}}]}',
        '{"actions": [{"name": "found_target", "input": {"function_name": "0x1f{u}", "start_line": {s}, "end_line": {e}}}]}',
        [("found_target", "0x1f{u}", "{s}", "{e}")],
    ),
    (
        '{"actions": [{"name": "open_door", "input": {"name": "d{u}"}}]}',
        '{"actions": [{"name": "open_door", "input": {"name": "d{u}"}}]}',
        [("open_door", "d{u}", None, None)],
    ),
    (
        '{"actions": [{"name": "found_target", "input": {"function_name": "f{u}", "start_line": {s}}}]}',
        '{"actions": [{"name": "found_target", "input": {"function_name": "f{u}", "start_line": {s}}}]}',
        [("found_target", "f{u}", "{s}", None)],
    ),
    (
        '{"actions": [{"name": "found_target", "input": {"function_name": "f{u}", "start_line": "top", "end_line": {e}}}]}',
        '{"actions": [{"name": "found_target", "input": {"function_name": "f{u}", "start_line": "top", "end_line": {e}}}]}',
        [("found_target", "f{u}", "top", "{e}")],
    ),
    ("I found nothing in part {k}.", "I found nothing in part {k}.", []),
    ("", "", []),
    (_RETRIES, _RETRIES, [("retry_with", None, "1", "3"), ("retry_with", None, "{s}", "{e}")]),
    (
        _CALLS.replace('"g{u}"', '"""g{u}"""'),
        _CALLS,
        [("record_function_call", "g{u}", "{s}", None), ("record_function_call", "h{u}", "{e}", None)],
    ),
]
N = len(SHAPES)
REASONS = {5: "unknown_action", 6: "missing_field", 7: "bad_type"}

_SLOT = re.compile(r"(\{[usek]\})")


def _pieces(template: str) -> list[str]:
    return [p for p in _SLOT.split(template) if p]


def render(template: str | None) -> Column:
    if template is None:
        return F.lit(None).cast("string")
    parts = [F.col(p[1]) if _SLOT.fullmatch(p) else F.lit(p) for p in _pieces(template)]
    return F.concat(*parts) if parts else F.lit("")


def sql(template: str | None) -> str:
    if template is None:
        return "NULL::VARCHAR"
    parts = [p[1] if _SLOT.fullmatch(p) else _quote(p) for p in _pieces(template)]
    return " || ".join(parts) if parts else "''"


def _quote(text: str) -> str:
    lines = ["'" + t.replace("'", "''") + "'" for t in text.split("\n")]
    return "(" + " || chr(10) || ".join(lines) + ")"


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(request_id, path, target_id, raw)``; the range lies in 1..60."""
    rows = spread(table(spark, sf_dir, "events").select("event_id", "user_id")).select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("k"),
        F.col("user_id").cast("string").alias("u"),
        (F.col("event_id") % 37 + 1).cast("string").alias("s"),
        (F.col("event_id") % 37 + 1 + F.col("user_id") % 23).cast("string").alias("e"),
    )
    raw = None
    for i, (template, _, _) in enumerate(SHAPES):
        test = F.col("event_id") % N == i
        raw = F.when(test, render(template)) if raw is None else raw.when(test, render(template))
    return rows.select(
        F.col("k").alias("request_id"),
        F.concat(F.lit("docs/"), (F.col("event_id") % 200).cast("string"), F.lit(".txt")).alias("path"),
        F.lit("function").alias("target_id"),
        raw.alias("raw"),
    )


BASE_SQL = """ev AS (SELECT event_id, event_id::VARCHAR AS k, user_id::VARCHAR AS u,
  (event_id % 37 + 1)::VARCHAR AS s, (event_id % 37 + 1 + user_id % 23)::VARCHAR AS e,
  'docs/' || (event_id % 200) || '.txt' AS path FROM events)"""


def sql_case(index: int) -> str:
    """CASE over the shapes for the raw (0) or the cleaned (1) text."""
    arms = " ".join(f"WHEN {i} THEN {sql(shape[index])}" for i, shape in enumerate(SHAPES))
    return f"CASE event_id % {N} {arms} END"


def sql_actions() -> str:
    """Every expected action: (event_id, path, request_id, ordinal, name, key, first, second, shape)."""
    selects = []
    for i, (_, _, actions) in enumerate(SHAPES):
        for n, (name, key, first, second) in enumerate(actions):
            selects.append(
                f"SELECT event_id, path, k AS request_id, {n} AS ordinal, '{name}' AS name, {sql(key)} AS key, "
                f"{sql(first)} AS first, {sql(second)} AS second, {i} AS shape FROM ev WHERE event_id % {N} = {i}"
            )
    return "act AS (" + " UNION ALL ".join(selects) + ")"
