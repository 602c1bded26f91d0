"""Schemas of the tables the engine reads and produces."""

from __future__ import annotations

from dataclasses import dataclass, field

GOLDEN = "nodes ARRAY<STRUCT<name: STRING>>, edges MAP<STRING, ARRAY<STRING>>"
ANSWER = "actions ARRAY<STRUCT<name: STRING, input: MAP<STRING, STRING>>>"


@dataclass(frozen=True)
class Action:
    """One action a model may answer with; ``fields`` maps a field to ``string`` or ``integer``."""

    name: str
    description: str
    fields: dict[str, str]
    required: tuple[str, ...] = ()


# Columns of a definition besides its name.
PLACE = ("start_line", "end_line", "file")


@dataclass(frozen=True)
class Target:
    """Something to look for; children are looked for inside each parent that was found.

    ``mapping`` names the answer's field for a column: ``start_line``, ``end_line`` or ``file`` where the
    answer calls them otherwise, and any further column, which becomes an entry of ``fields``.
    """

    target_id: str
    description: str
    name_field: str
    children: tuple["Target", ...] = field(default=())
    mapping: tuple[tuple[str, str], ...] = ()

    def field_of(self, column: str) -> str:
        return dict(self.mapping).get(column, self.name_field if column == "name" else column)

    @property
    def further(self) -> dict[str, str]:
        return {c: f for c, f in self.mapping if c not in ("name", *PLACE)}


# Target ids, action names and field names are part of the answer format.
FUNCTION = Target("function", "function definition", "function_name")
CLASS = Target("class", "class definition", "class_name", (FUNCTION,))
TARGETS = (CLASS, FUNCTION)

RETRY_WITH = Action(
    "retry_with",
    "Ask for another line range when the current one cuts a definition short.",
    {"start": "integer", "end": "integer", "omitted_lines": "string"},
    ("start", "end"),
)
RECORD_CALL = Action(
    "record_function_call",
    "Report one call made by the function.",
    {"name": "string", "file_line": "integer"},
    ("name", "file_line"),
)


def found_action(target: Target) -> Action:
    """The action that reports one definition of ``target``."""
    return Action(
        "found_target",
        f"Report one {target.description}.",
        {
            target.field_of("name"): "string",
            target.field_of("start_line"): "integer",
            target.field_of("end_line"): "integer",
            target.field_of("file"): "string",
            **dict.fromkeys(target.further.values(), "string"),
        },
        tuple(map(target.field_of, ("name", "start_line", "end_line"))),
    )
