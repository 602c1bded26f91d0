"""Flow B: definitions and calls from answers, recorded or asked for in batches.

An ``answer`` function maps ``prompts(prompt_key, prompt, ...)`` to a log ``(prompt_key, raw)``:
a lookup in recorded answers, or ``extract_with`` around a batch function. Each round is one set
of Spark jobs over all files; its outputs are written to the shared folder before they are used,
so no answer is asked for twice and lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import answers as an
from ..operators import extraction as ex
from ..operators import graph as gr
from ..operators import lines as ln
from ..operators import windows as wn
from ..plans.callgraph import CallGraph
from ..plans.lookup import join_lookup
from ..schema import RECORD_CALL, RETRY_WITH, TARGETS, Target, found_action
from ..session import cut, keyed_store
from ..sources.answers import attach_responses

Answer = Callable[[DataFrame], DataFrame]
IDENTITY = ["path", "target_id", "name", "start_line", "end_line", "parent_id"]


@dataclass
class Extraction:
    """``open_requests`` are follow-ups left when a round limit stopped the loop."""

    found: DataFrame
    quarantine: DataFrame
    usage: DataFrame
    open_requests: DataFrame | None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _ask(prompts: DataFrame, answer: Answer, stage: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Answers per request, the usage rows of the stage, and requests whose question failed as ``quarantine`` rows."""
    prompts = cut(prompts, "prompts")
    log, failed = cut(answer(prompts), "answers"), []
    if "error" in log.columns:
        errors = log.where(F.col("raw").isNull()).select("prompt_key", "error")
        failed = [prompts.join(errors, "prompt_key").select("request_id", F.lit("no_answer").alias("reason"), F.col("error").alias("raw"))]
        log = log.where(F.col("raw").isNotNull())
    answered = attach_responses(prompts, log)
    if "time_secs" in log.columns:
        spent = log.groupBy("prompt_key").agg(F.sum("time_secs").alias("time_secs"))
        timed = join_lookup(answered, spent, "prompt_key", "left")
    else:
        timed = answered.withColumn("time_secs", F.lit(0.0))
    usage = timed.select(
        F.lit(stage).alias("stage"),
        "path",
        an.estimated_tokens(F.col("prompt")).alias("in_tokens"),
        an.estimated_tokens(F.col("raw")).alias("out_tokens"),
        "time_secs",
        "prompt_key",
    )
    # a question that several requests share was asked, and is counted, once
    usage = usage.dropDuplicates(["prompt_key"]).drop("prompt_key")
    return answered.select("request_id", "part", "raw"), usage, failed


def _unreadable(checked: DataFrame) -> DataFrame:
    """Requests with an error as ``quarantine`` rows."""
    return checked.where(F.col("error").isNotNull()).select(
        "request_id", F.col("error").alias("reason"), F.concat_ws(":", "path", "start", "end").alias("raw")
    )


def _inside(ranges: DataFrame, counts: DataFrame) -> DataFrame:
    """Answered line ranges cut to their file; one that lies outside is left out."""
    sized = join_lookup(ranges, counts.select("path", "n_lines"), "path")
    cut_to = sized.withColumn("start_line", F.greatest("start_line", F.lit(1))).withColumn(
        "end_line", F.least("end_line", "n_lines")
    )
    return cut_to.where(F.col("start_line") <= F.col("end_line")).drop("n_lines")


def run_rounds(
    requests: DataFrame,
    files: DataFrame,
    counts: DataFrame,
    target: Target,
    answer: Answer,
    max_rounds: int | None = None,
) -> Extraction:
    """Read requests, answer, follow up until no new range is asked for.

    The loop ends by itself: a range is asked once, and ranges lie inside their file.
    """
    carry = ("parent_id", "scope_lines") if "parent_id" in requests.columns else ("scope_lines",)
    found, bad, usage = [], [], []
    seen, turn = None, 0
    catalog = [found_action(target), RETRY_WITH]
    requests = cut(requests, "requests")
    while True:
        checked_requests = ln.check_requests(requests, counts)
        excerpts = ln.cut_excerpts(files, checked_requests).drop("path")
        prompts = wn.build_prompts(
            requests.join(excerpts, "request_id"), [target], lambda t: catalog
        )
        raw, used, failed = _ask(prompts, answer, f"find_{target.target_id}")
        clean = an.clean_answers(raw)
        checked = cut(an.check_required(an.parse_answers(clean), catalog), "actions")
        good = an.good_actions(checked)
        found.append(an.answers_to_found(good, requests, (target,)))
        bad += [an.quarantined(checked), an.bad_answers(clean), _unreadable(checked_requests), *failed]
        usage.append(used)
        seen = requests if seen is None else seen.unionByName(requests)
        turn += 1
        follow = cut(wn.next_round(good, requests, counts, seen, carry), "requests")
        if follow.isEmpty():
            left = None
            break
        if max_rounds is not None and turn >= max_rounds:
            left = follow
            break
        requests = follow.select(*requests.columns)
    # A follow-up may show a definition again that its window has shown already.
    return Extraction(_union(found).dropDuplicates(IDENTITY), _union(bad), _union(usage), left)


def _merge(parts: list[Extraction]) -> Extraction:
    open_parts = [p.open_requests for p in parts if p.open_requests is not None]
    left = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), open_parts) if open_parts else None
    return Extraction(
        _union([p.found for p in parts]),
        _union([p.quarantine for p in parts]),
        _union([p.usage for p in parts]),
        left,
    )


def _level(scope: DataFrame, keys: tuple[str, ...], targets, files, counts, answer, max_rounds) -> list[Extraction]:
    """Targets of one level in order; what one has claimed the next does not read."""
    out: list[Extraction] = []
    claimed = None
    for target in targets:
        windows = scope
        if claimed is not None:
            windows = wn.subtract_claimed(scope, claimed, keys)
        requests = wn.window_requests(windows, [target])
        got = run_rounds(requests, files, counts, target, answer, max_rounds)
        got.found = cut(got.found, "found")
        out.append(got)
        claims = _inside(got.found.select("path", *keys[1:], "start_line", "end_line"), counts)
        claimed = claims if claimed is None else claimed.unionByName(claims)
        if target.children:
            ranges = got.found.select(
                "path",
                tx.node_id(F.col("path"), F.col("start_line"), F.col("name")).alias("parent_id"),
                "start_line",
                "end_line",
            )
            parents = _inside(ranges.dropDuplicates(["path", "parent_id"]), counts).withColumn(
                "scope_lines", F.col("end_line") - F.col("start_line") + 1
            )
            inner = wn.plan_windows_within(parents)
            out += _level(inner, ("path", "parent_id"), target.children, files, counts, answer, max_rounds)
    return out


def extract_targets(
    files: DataFrame,
    answer: Answer,
    targets: tuple[Target, ...] = TARGETS,
    max_rounds: int | None = None,
) -> Extraction:
    """All targets of all files, children inside each parent found."""
    files = keyed_store(files.select("path", "content"), "path", "files")
    counts = cut(ln.line_counts(files), "counts")
    scope = join_lookup(
        wn.plan_windows(counts), counts.withColumnRenamed("n_lines", "scope_lines"), "path"
    )
    return _merge(_level(scope, ("path",), targets, files, counts, answer, max_rounds))


def call_graph_from_answers(
    files: DataFrame, answer: Answer, max_rounds: int | None = None, targets: tuple[Target, ...] = TARGETS
) -> tuple[CallGraph, Extraction]:
    """Flow A with answers instead of rules: definitions, then the calls of each body.

    Targets with the id ``function``, also as children, become nodes, with what their mapping adds as ``fields``.
    """
    got = extract_targets(files, answer, targets, max_rounds)
    found = cut(got.found, "found")
    nodes = gr.build_nodes(found)
    bodies = nodes.select(
        F.col("node_id").alias("request_id"),
        F.col("file").alias("path"),
        F.col("line_start").alias("start"),
        F.col("line_end").alias("end"),
    ).dropDuplicates(["request_id"])
    readable = ln.check_requests(bodies, ln.line_counts(files))
    prompts = wn.build_body_prompts(ln.cut_excerpts(files, readable.withColumn("spec", F.lit(""))), RECORD_CALL)
    raw, used, failed = _ask(prompts, answer, "find_calls")
    clean = an.clean_answers(raw)
    checked = cut(an.check_required(an.parse_answers(clean), [RECORD_CALL]), "actions")
    callers = bodies.select("request_id", "path", F.col("request_id").alias("caller_id"))
    calls = an.answers_to_calls(an.good_actions(checked), callers)
    edges = gr.build_edges(gr.resolve_callees(calls, nodes))
    merged = Extraction(
        found,
        _union([_unreadable(readable), got.quarantine, an.quarantined(checked), an.bad_answers(clean), *failed]),
        got.usage.unionByName(used),
        got.open_requests,
    )
    return CallGraph(found, nodes, calls, edges), merged


def asking(batch: Callable[[list[str]], list[str]], parallelism: int | None = None, log: str | None = None, **more) -> Answer:
    """An answer function around a caller's batch function, over a log at path ``log`` where one is named."""
    if log is None:
        return lambda prompts: ex.extract_with(prompts, batch, parallelism, **more)
    return lambda prompts: ex.ask_log(prompts, batch, log, parallelism, **more)
