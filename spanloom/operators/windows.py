"""Planning of read windows over line ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookup import join_lookup
from ..schema import Action, Target
from . import lines as ln

# The first window has 30 lines, every later one 31; hence a grid of 31 from 0.
GRID = 31


def _cut(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Explode a line range into the grid cells it touches; an empty range touches none.

    Empty ranges go after the outer explode: a filter in front of it would be pushed down to the scan, where it
    works out every text's lines once more, before the rows are dealt out.
    """
    touched = F.sequence(F.floor(start / F.lit(GRID)).cast("int"), F.floor(end / F.lit(GRID)).cast("int"))
    cells = df.withColumn("window_id", F.explode_outer(F.when(end >= start, touched))).where(F.col("window_id").isNotNull())
    base = F.col("window_id") * GRID
    return cells.withColumn("_lo", F.greatest(start, base)).withColumn(
        "_hi", F.least(end, base + GRID - 1)
    )


def plan_windows(counts: DataFrame) -> DataFrame:
    """``(path, n_lines)`` -> ``(path, window_id, start_line, end_line)``; no text is read."""
    cells = _cut(counts, F.lit(1), F.col("n_lines"))
    return cells.select(
        "path", "window_id", F.col("_lo").alias("start_line"), F.col("_hi").alias("end_line")
    )


def plan_windows_within(parents: DataFrame) -> DataFrame:
    """The same grid inside each parent's line range; other columns of ``parents`` are kept."""
    inner = parents.withColumnRenamed("start_line", "_from").withColumnRenamed("end_line", "_to")
    return (
        _cut(inner, F.col("_from"), F.col("_to"))
        .withColumnRenamed("_lo", "start_line")
        .withColumnRenamed("_hi", "end_line")
        .drop("_from", "_to")
    )


def _bits(start: Column, end: Column) -> Column:
    """Bits of the lines start..end inside their grid cell."""
    low = (start % GRID).cast("int")
    high = (end % GRID).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), high + 1) - F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), low
    )


def _has(mask: Column, bit: Column) -> Column:
    return F.when((bit >= 0) & (bit < GRID), F.call_function("shiftright", mask, bit) % 2 == 1).otherwise(
        F.lit(False)
    )


def subtract_claimed(windows: DataFrame, claimed: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """What is left of each window once claimed lines are taken out, as maximal runs.

    ``claimed`` has ``keys`` and ``(start_line, end_line)``. Claims are cut to grid cells and
    or-ed into one bit mask per cell before the shuffle, so repeated or overlapping claims cost
    one row per cell, and a cell never holds more than 31 lines.
    """
    masks = (
        _cut(claimed.select(*keys, "start_line", "end_line"), F.col("start_line"), F.col("end_line"))
        .groupBy(*keys, "window_id")
        .agg(F.bit_or(_bits(F.col("_lo"), F.col("_hi"))).alias("_taken"))
    )
    joined = windows.join(masks, [*keys, "window_id"], "left")
    whole = _bits(F.col("start_line"), F.col("end_line"))
    free = joined.withColumn(
        "_free", whole.bitwiseAND(F.bitwise_not(F.coalesce("_taken", F.lit(0).cast("bigint"))))
    ).where(F.col("_free") != 0)
    bits = F.sequence(F.lit(0), F.lit(GRID - 1))
    mask = F.col("_free")
    starts = F.filter(bits, lambda b: _has(mask, b) & ~_has(mask, b - 1))
    ends = F.filter(bits, lambda b: _has(mask, b) & ~_has(mask, b + 1))
    runs = free.withColumn("_run", F.explode(F.arrays_zip(starts.alias("lo"), ends.alias("hi"))))
    base = F.col("window_id") * GRID
    return (
        runs.withColumn("start_line", base + F.col("_run.lo"))
        .withColumn("end_line", base + F.col("_run.hi"))
        .drop("_taken", "_free", "_run")
    )


def window_requests(windows: DataFrame, targets: tuple[Target, ...] | list[Target]) -> DataFrame:
    """One read request per window and target; further columns of ``windows`` are kept."""
    ids = F.array(*[F.lit(t.target_id) for t in targets])
    return (
        windows.withColumn("target_id", F.explode(ids))
        .withColumn("spec", F.lit(""))
        .withColumn("start", F.col("start_line"))
        .withColumn("end", F.col("end_line"))
        .withColumn("request_id", request_id("parent_id" in windows.columns))
        .drop("window_id", "start_line", "end_line")
    )


def window_prompts(files: DataFrame, targets: tuple[Target, ...] | list[Target], actions) -> DataFrame:
    """The prompts of the first round, for every window of every file and every target; map-only."""
    ids = F.array(*[F.lit(t.target_id) for t in targets])
    windows = ln.window_excerpts(files, GRID).withColumnRenamed("n_lines", "scope_lines")
    asked = windows.select(
        "path",
        F.explode(ids).alias("target_id"),
        F.col("start_line").alias("start"),
        F.col("end_line").alias("end"),
        F.lit("").alias("spec"),
        F.lit(0).alias("part"),
        "excerpt",
        "scope_lines",
    )
    return build_prompts(asked.withColumn("request_id", request_id()), targets, actions)


def request_id(nested: bool = False) -> Column:
    """Identity of a request: what is asked, where and without which lines."""
    scope = ["parent_id"] if nested else ["path"]
    return F.concat_ws(
        ":", *scope, "target_id", F.col("start").cast("string"), F.col("end").cast("string"), "spec"
    )


def _menu(actions: list[Action]) -> str:
    rows = ["You may answer with these actions:"]
    for action in actions:
        shown = ", ".join(
            f"{name} ({kind}{', required' if name in action.required else ''})"
            for name, kind in action.fields.items()
        )
        rows.append(f"* {action.name}: {action.description} Fields: {shown}.")
    return "\n".join(rows)


ANSWER_FORM = (
    'Answer with one JSON object of the form {"actions": [{"name": "<action>", "input": {<fields>}}]}.'
)


def prompt_head(actions: list[Action]) -> str:
    return _menu(actions) + "\n\n"


def window_ask(target: Target) -> str:
    return f"List every {target.description} in this part of a document.\n"


BODY_ASK = "List the calls this function makes.\n"
RETRY_HINT = (
    "If the last one is cut off, add at most one retry_with for a range of up to 30 further lines.\n"
)


def build_prompts(excerpts: DataFrame, targets: tuple[Target, ...] | list[Target], actions) -> DataFrame:
    """One prompt per excerpt part: ``(request_id, path, target_id, part, prompt, prompt_key)``.

    ``excerpts`` needs ``(request_id, path, target_id, part, excerpt, scope_lines)``;
    ``actions`` maps a target to the actions its answers may use.
    """
    heads = {t.target_id: prompt_head(actions(t)) + window_ask(t) for t in targets}
    head = reduce(
        lambda acc, item: acc.when(F.col("target_id") == item[0], F.lit(item[1])),
        list(heads.items())[1:],
        F.when(F.col("target_id") == list(heads)[0], F.lit(heads[list(heads)[0]])),
    )
    prompt = F.concat(
        head,
        F.lit("Path: "),
        F.col("path"),
        F.lit("\nLines in scope: "),
        F.col("scope_lines").cast("string"),
        F.lit("\n"),
        F.lit(RETRY_HINT),
        F.lit("Part of the document:\n"),
        F.col("excerpt"),
        F.lit("\n\n" + ANSWER_FORM),
    )
    return _keyed(excerpts.withColumn("prompt", prompt)).select(
        "request_id", "path", "target_id", "part", "prompt", "prompt_key"
    )


def build_body_prompts(excerpts: DataFrame, action: Action) -> DataFrame:
    """One prompt per function body part: ``(request_id, path, part, prompt, prompt_key)``."""
    prompt = F.concat(
        F.lit(prompt_head([action]) + BODY_ASK + "Source:\n"),
        F.col("excerpt"),
        F.lit("\n\n" + ANSWER_FORM),
    )
    return _keyed(excerpts.withColumn("prompt", prompt)).select(
        "request_id", "path", "part", "prompt", "prompt_key"
    )


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("prompt_key", F.sha2("prompt", 256))


def next_round(
    actions: DataFrame,
    requests: DataFrame,
    counts: DataFrame,
    seen: DataFrame | None = None,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Follow-up requests from ``retry_with`` actions, never one that was asked before.

    Specs that leave the same excerpt are one request. Of several retries in one answer (to a request, or to a ``part`` of it) the last one counts. Ranges are cut to the file. The
    columns of a request are ``(request_id, path, target_id, start, end, spec)`` and ``carry``.
    """
    keys = ["request_id", "part"] if "part" in actions.columns else ["request_id"]
    retry = (
        actions.where(F.col("name") == "retry_with")
        .select(
            *keys,
            "ordinal",
            F.col("input")["start"].try_cast("int").alias("start"),
            F.col("input")["end"].try_cast("int").alias("end"),
            F.coalesce(F.col("input")["omitted_lines"], F.lit("")).alias("spec"),
        )
        .where(F.col("start").isNotNull() & F.col("end").isNotNull())
        .groupBy(*keys)
        .agg(F.max(F.struct("ordinal", "start", "end", "spec")).alias("r"))
    )
    kept = ["path", "target_id", *carry]
    asked = join_lookup(retry, requests.select("request_id", *kept), "request_id")
    sized = join_lookup(asked, counts.select("path", "n_lines"), "path")
    fresh = (
        sized.select(
            *kept,
            F.greatest(F.col("r.start"), F.lit(1)).alias("start"),
            F.least(F.col("r.end"), F.col("n_lines")).alias("end"),
            F.col("r.spec").alias("spec"),
        )
        .where(F.col("start") <= F.col("end"))
        .withColumn("spec", ln.omission_key(F.col("spec"), F.col("start"), F.col("end")))
        .distinct()
        .withColumn("request_id", request_id("parent_id" in carry))
    )
    past = requests.select("request_id") if seen is None else seen.select("request_id")
    return fresh.join(past, "request_id", "left_anti").select(
        "request_id", *kept, "start", "end", "spec"
    )
