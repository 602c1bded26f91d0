"""Model answers as a table: clean, parse, route, check, convert, count."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import clean_answer
from ..plans.lookup import join_lookup
from ..schema import ANSWER, TARGETS, Action, Target


def clean_answers(raw: DataFrame) -> DataFrame:
    """``(request_id, raw)`` -> the same rows with ``clean``."""
    return raw.withColumn("clean", clean_answer(F.col("raw")))


def _parsed(clean: DataFrame) -> DataFrame:
    """Add ``_doc`` and ``_bad``.

    The text is parsed as the only element of an array, so anything after the JSON object, a
    second object or a value that is no object shows as a parse failure.
    """
    wrapped = F.concat(F.lit("["), F.col("clean"), F.lit("]"))
    empty = F.col("clean").isNull() | (F.trim("clean") == "")
    docs = clean.withColumn("_empty", empty).withColumn(
        "_docs", F.when(~empty, F.from_json(wrapped, f"ARRAY<STRUCT<{_ddl(ANSWER)}>>"))
    )
    whole = F.coalesce(F.size("_docs") == 1, F.lit(False)) & F.get("_docs", F.lit(0)).isNotNull()
    untyped = F.get("_docs", F.lit(0))["actions"].isNull() & F.coalesce(
        F.get_json_object("clean", "$.actions").isNotNull(), F.lit(False)
    )
    return docs.withColumn("_bad", ~F.col("_empty") & (~whole | untyped))


def _ddl(fields: str) -> str:
    name, kind = fields.split(" ", 1)
    return f"{name}: {kind}"


def parse_answers(clean: DataFrame) -> DataFrame:
    """``actions(request_id, ordinal, name, input)``; empty answers and no ``actions`` give none.

    A ``part`` of the request, where there is one, is carried on.

    Bad answers are left out by an outer explode of NULL, not by a filter: a filter on the parse
    result would be pushed below the parse and clean the text once more for each mention.
    """
    actions = F.when(~F.col("_bad"), F.get("_docs", F.lit(0))["actions"])
    keys = ["request_id", "part"] if "part" in clean.columns else ["request_id"]
    return (
        _parsed(clean)
        .select(*keys, F.posexplode_outer(actions).alias("ordinal", "action"))
        .where(F.col("ordinal").isNotNull())
        .select(
            *keys,
            "ordinal",
            F.col("action.name").alias("name"),
            F.coalesce("action.input", F.create_map().cast("map<string,string>")).alias("input"),
        )
    )


def bad_answers(clean: DataFrame) -> DataFrame:
    """Answers that are no JSON object: quarantine rows with reason ``bad_json``."""
    bad = F.when(F.col("_bad"), F.array("raw"))
    return (
        _parsed(clean)
        .select("request_id", F.lit("bad_json").alias("reason"), F.explode_outer(bad).alias("raw"))
        .where(F.col("raw").isNotNull())
    )


def _literal_map(pairs: list[tuple[str, Column]], value_type: str) -> Column:
    flat = list(chain.from_iterable((F.lit(k), v) for k, v in pairs))
    return F.create_map(*flat).cast(f"map<string,{value_type}>")


def route_actions(actions: DataFrame, catalog: list[Action]) -> DataFrame:
    """Add ``reason``: ``unknown_action`` for a name the catalog lacks, else NULL.

    The catalog is code, a handful of entries; it becomes a literal, not a join.
    """
    known = F.array(*[F.lit(a.name) for a in catalog])
    hit = F.coalesce(F.array_contains(known, F.col("name")), F.lit(False))
    return actions.withColumn("reason", F.when(~hit, "unknown_action"))


def check_required(actions: DataFrame, catalog: list[Action]) -> DataFrame:
    """Set ``reason`` to ``missing_field`` or ``bad_type`` where a known action's input fails."""
    strings = "array<string>"
    required = _literal_map(
        [(a.name, F.array(*[F.lit(f) for f in a.required]).cast(strings)) for a in catalog], strings
    )
    integers = _literal_map(
        [
            (a.name, F.array(*[F.lit(f) for f, kind in a.fields.items() if kind == "integer"]).cast(strings))
            for a in catalog
        ],
        strings,
    )
    routed = actions if "reason" in actions.columns else route_actions(actions, catalog)
    fields = F.col("input")
    complete = F.forall(F.try_element_at(required, F.col("name")), lambda f: fields[f].isNotNull())
    typed = F.forall(
        F.try_element_at(integers, F.col("name")),
        lambda f: fields[f].isNull() | fields[f].try_cast("int").isNotNull(),
    )
    return routed.withColumn(
        "reason",
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(~complete, "missing_field")
        .when(~typed, "bad_type"),
    )


def good_actions(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("reason").isNull()).drop("reason")


def quarantined(checked: DataFrame) -> DataFrame:
    """Failing actions as ``quarantine(request_id, reason, raw)``."""
    return checked.where(F.col("reason").isNotNull()).select(
        "request_id",
        "reason",
        F.to_json(F.struct("name", "input"), {"ignoreNullFields": "false"}).alias("raw"),
    )


def _with_request(actions: DataFrame, requests: DataFrame, columns: list[str]) -> DataFrame:
    return join_lookup(actions, requests.select("request_id", *columns), "request_id")


def _with_children(targets: tuple[Target, ...]) -> list[Target]:
    return [x for t in targets for x in (t, *_with_children(t.children))]


def answers_to_found(
    actions: DataFrame, requests: DataFrame, targets: tuple[Target, ...] = TARGETS
) -> DataFrame:
    """``found_target`` actions -> ``found`` rows plus ``file``; the file falls back to the path.

    ``requests`` has one row per ``request_id`` with ``path`` and ``target_id``, and with
    ``parent_id`` when it reads inside a parent. The name is in the field that the request's target
    names, or else in the field of another of the ``targets``. Further columns of a target's mapping
    become ``fields MAP<STRING, STRING>``, a column that is there only if some target has such.
    """
    nested = "parent_id" in requests.columns
    columns = ["path", "target_id", "parent_id"] if nested else ["path", "target_id"]
    rows = _with_request(actions.where(F.col("name") == "found_target"), requests, columns)
    field = F.col("input")
    known = _with_children(targets)
    further = sorted({((t.target_id, c), f) for t in known for c, f in t.further.items()})
    own = [F.when(F.col("target_id") == t.target_id, field[t.field_of("name")]) for t in known]

    def mapped(column: str) -> Column:
        """The field that the request's target maps the column to."""
        differ = [t for t in known if t.field_of(column) != column]
        return reduce(lambda out, t: F.when(F.col("target_id") == t.target_id, field[t.field_of(column)]).otherwise(out), differ, field[column])

    found = rows.select(
        "path",
        "target_id",
        F.coalesce(*own, *[field[t.field_of("name")] for t in known]).alias("name"),
        mapped("start_line").try_cast("int").alias("start_line"),
        mapped("end_line").try_cast("int").alias("end_line"),
        (F.col("parent_id") if nested else F.lit(None).cast("string")).alias("parent_id"),
        F.coalesce(mapped("file"), F.col("path")).alias("file"),
        *[field[f].alias(f"_further_{i}") for i, (_, f) in enumerate(further)],
    )
    if not further:
        return found
    entries = [F.when(F.col("target_id") == t, F.struct(F.lit(c).alias("key"), F.col(f"_further_{i}").alias("value"))) for i, ((t, c), _) in enumerate(further)]
    given = F.filter(F.array(*entries), lambda e: e.isNotNull() & e["value"].isNotNull())
    return found.withColumn("fields", F.map_from_entries(given)).drop(*[f"_further_{i}" for i in range(len(further))])


def answers_to_calls(actions: DataFrame, requests: DataFrame) -> DataFrame:
    """``record_function_call`` actions -> ``calls``; ``requests`` names caller and path."""
    rows = _with_request(
        actions.where(F.col("name") == "record_function_call"), requests, ["caller_id", "path"]
    )
    field = F.col("input")
    return rows.select(
        "caller_id",
        field["name"].alias("callee_name"),
        F.col("path").alias("file"),
        field["file_line"].try_cast("int").alias("line_no"),
    )


def estimated_tokens(text: Column) -> Column:
    """Stated estimate where a log brings no token counts: words and single marks."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), 0)), F.lit(0)).cast("bigint")


def usage_rollup(log: DataFrame, by: tuple[str, ...] = ("stage",)) -> DataFrame:
    """Sums of ``usage(stage, path, in_tokens, out_tokens, time_secs)`` over all stages."""
    return log.groupBy(*by).agg(
        F.sum("in_tokens").alias("in_tokens"),
        F.sum("out_tokens").alias("out_tokens"),
        F.sum("time_secs").alias("time_secs"),
        F.count(F.lit(1)).alias("n_calls"),
    )
