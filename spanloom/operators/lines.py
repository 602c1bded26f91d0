"""Line operators: split, count, slice, omit, render."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lookup import join_lookup
from ..plans.spans import join_spans

SLICE_CELL = 32
PART_LINES = 4096
OMISSION_BLOCK = 65536
# Line number and text frame of an omission marker.
NO_LINE = -1
MARKER = ("[omitted lines: ", "]")


def split_lines(files: DataFrame) -> DataFrame:
    """``files`` -> ``lines(path, line_no, text)``; map-only."""
    row = F.transform("body", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text")))
    numbered = tx.with_line_array(files.select("path", "content")).select(
        "path", F.explode(row).alias("row")
    )
    return numbered.select("path", "row.line_no", "row.text")


def line_counts(files: DataFrame) -> DataFrame:
    """``files`` -> ``(path, n_lines)``; map-only, builds no lines."""
    return files.select("path", tx.line_count(F.col("content")).alias("n_lines"))


def check_requests(requests: DataFrame, counts: DataFrame) -> DataFrame:
    """Add ``error`` (NULL when the range can be read) to ``requests(path, start, end, ...)``.

    ``counts(path, n_lines)`` has one row per path.
    """
    joined = join_lookup(requests, counts.select("path", "n_lines"), "path", "left")
    error = (
        F.when(F.col("n_lines").isNull(), "no_such_file")
        .when(F.col("start") < 1, "start_before_first_line")
        .when((F.col("end") >= F.col("start")) & (F.col("end") > F.col("n_lines")), "end_after_last_line")
    )
    return joined.withColumn("error", error)


def slice_lines(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """Lines of each readable request: ``(request_id, path, pos, line_no, text)``.

    ``pos`` counts from 0 at the start of the request. Requests come from ``check_requests``;
    those with an error give no lines.
    """
    wanted = requests
    if "error" in requests.columns:
        wanted = requests.where(F.col("error").isNull())
    wanted = wanted.select("request_id", "path", F.col("start").alias("_start"), F.col("end").alias("_end"))
    hits = join_spans(lines, wanted, ["path"], "line_no", "_start", "_end", cell=SLICE_CELL)
    return hits.select(
        "request_id",
        "path",
        (F.col("line_no") - F.col("_start")).alias("pos"),
        "line_no",
        "text",
    )


def _tokens(requests: DataFrame) -> DataFrame:
    """One row per comma-separated token with its bounds; bounds are NULL for a bad token."""
    token = F.trim(F.col("token"))
    pair = token.rlike(r"^\+?\d+\s*-\s*\d+$")
    single = token.rlike(r"^\+?\d+$")
    first = F.regexp_extract(token, r"^[+]?(\d+)", 1).try_cast("int")
    last = F.when(pair, F.regexp_extract(token, r"(\d+)$", 1).try_cast("int")).otherwise(first)
    return (
        requests.where(F.col("spec").isNotNull() & (F.col("spec") != ""))
        .select("request_id", F.explode(F.split("spec", ",", -1)).alias("token"))
        .withColumn("first", F.when(pair | single, first))
        .withColumn("last", F.when(pair | single, last))
    )


def bad_omissions(requests: DataFrame) -> DataFrame:
    """Tokens of ``requests(request_id, spec)`` that are no line or line range."""
    bad = _tokens(requests).where(F.col("first").isNull() | F.col("last").isNull())
    return bad.select("request_id", F.lit("bad_omission").alias("reason"), F.col("token").alias("raw"))


def expand_omissions(requests: DataFrame, n_lines: str | None = None) -> DataFrame:
    """``requests(request_id, spec)`` -> distinct ``(request_id, line_no)``.

    ``n_lines`` names a column with the last line to give. Ranges are cut into blocks first, so
    that no array is longer than a block.
    """
    good = _tokens(requests)
    if n_lines:
        sizes = requests.select("request_id", F.col(n_lines).alias("_size")).distinct()
        good = join_lookup(good, sizes, "request_id").withColumn("last", F.least("last", "_size"))
    block = F.lit(OMISSION_BLOCK)
    blocks = F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))
    cells = good.where(F.col("first") <= F.col("last")).withColumn(
        "_from", F.explode(F.transform(blocks, lambda b: b * block))
    )
    lines = F.sequence(
        F.greatest("first", F.col("_from")).cast("int"),
        F.least("last", F.col("_from") + block - 1).cast("int"),
    )
    return cells.select("request_id", F.explode(lines).alias("line_no")).distinct()


def omission_runs(requests: DataFrame) -> DataFrame:
    """Omitted lines as disjoint, non-adjacent runs ``(request_id, run_start, run_end)``.

    Works on the ranges, never on single lines; a request's ranges come from one string value.
    """
    by_start = Window.partitionBy("request_id").orderBy("first", "last")
    reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    ranges = _tokens(requests).where(F.col("first") <= F.col("last")).drop("token").distinct()
    opened = ranges.withColumn("_reach", reach).withColumn(
        "_new", F.when(F.col("first") <= F.col("_reach") + 1, 0).otherwise(1)
    )
    return (
        opened.withColumn("_run", F.sum("_new").over(by_start))
        .groupBy("request_id", "_run")
        .agg(F.min("first").alias("run_start"), F.max("last").alias("run_end"))
        .drop("_run")
    )


def omission_key(spec: Column, start: Column, end: Column) -> Column:
    """One text for all specs that leave the same excerpt of ``start .. end``: ``2,2``, `` 2`` and ``2-2`` are ``2``.

    Runs are merged and sorted, those outside the range left out; of one that reaches past the end,
    which leaves no marker, only the lines inside and the first one behind count. Bad tokens have no part in it.
    """
    number = lambda t, pattern: F.call_function("regexp_extract", t, F.lit(pattern), F.lit(1)).try_cast("int")
    tokens = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t.rlike(r"^\+?\d+(?:\s*-\s*\d+)?$"))
    ranges = F.transform(tokens, lambda t: F.struct(number(t, r"^\+?(\d+)").alias("low"), number(t, r"(\d+)$").alias("high")))
    good = F.array_sort(F.filter(ranges, lambda r: r["low"] <= r["high"]))
    done = F.array().cast("array<struct<low:int,high:int>>")

    def joined(runs: Column, r: Column) -> Column:
        last = F.element_at(runs, -1)
        wider = F.concat(
            F.slice(runs, 1, F.size(runs) - 1),
            F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], r["high"]).alias("high"))),
        )
        return F.when((F.size(runs) > 0) & (r["low"] <= F.try_element_at(runs, F.lit(-1))["high"] + 1), wider).otherwise(
            F.concat(runs, F.array(r))
        )

    def shown(r: Column) -> Column:
        past = r["high"] > end
        low, high = F.when(past, F.greatest(r["low"], start)).otherwise(r["low"]), F.when(past, end + 1).otherwise(r["high"])
        return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low, high))

    inside = F.filter(F.aggregate(good, done, joined), lambda r: (r["high"] >= start) & (r["low"] <= end))
    return F.when(F.coalesce(spec, F.lit("")) == "", "").otherwise(F.array_join(F.transform(inside, shown), ","))


def collapse_omissions(sliced: DataFrame, requests: DataFrame) -> DataFrame:
    """Take omitted lines out of a slice and put one marker where each run ends.

    ``requests`` has ``(request_id, start, end, spec)`` and, from ``check_requests``, ``error``.
    A run that reaches past the slice leaves no marker. Markers carry ``line_no = -1``.
    """
    readable = requests.where(F.col("error").isNull()) if "error" in requests.columns else requests
    readable = readable.where(F.col("spec").isNotNull() & (F.col("spec") != ""))
    runs = omission_runs(readable).join(
        readable.select("request_id", "path", "start", "end"), "request_id"
    )
    inside = runs.select(
        "request_id",
        F.greatest("run_start", "start").alias("_from"),
        F.least("run_end", "end").alias("_to"),
    )
    kept = join_spans(
        sliced, inside, ["request_id"], "line_no", "_from", "_to", "left_anti", SLICE_CELL
    )
    span = F.when(F.col("run_start") == F.col("run_end"), F.col("run_start").cast("string")).otherwise(
        F.concat_ws("-", "run_start", "run_end")
    )
    markers = runs.where(F.col("run_end").between(F.col("start"), F.col("end"))).select(
        "request_id",
        "path",
        (F.col("run_end") - F.col("start")).alias("pos"),
        F.lit(NO_LINE).alias("line_no"),
        F.concat(F.lit(MARKER[0]), span, F.lit(MARKER[1])).alias("text"),
    )
    return kept.unionByName(markers)


def _shown(text: Column, line_no: Column, numbered: bool) -> Column:
    return F.concat(line_no.cast("string"), F.lit(": "), text) if numbered else text


def window_excerpts(files: DataFrame, size: int, numbered: bool = True) -> DataFrame:
    """Excerpts of every window of a grid of ``size`` lines: ``(path, n_lines, window_id, start_line, end_line, excerpt)``.

    Cut from each file's own line array where the file is read; nothing is shuffled.
    """
    body, n = F.col("body"), F.size("body")

    def window(w: Column) -> Column:
        start, end = F.greatest(F.lit(1), w * size), F.least(n, w * size + size - 1)
        lines = F.transform(F.slice(body, start, end - start + 1), lambda x, i: _shown(x, start + i, numbered))
        return F.struct(w.alias("window_id"), start.alias("start_line"), end.alias("end_line"), F.array_join(lines, "\n").alias("excerpt"))

    grid = F.sequence(F.lit(0), F.floor(n / F.lit(size)).cast("int"))
    cut = tx.with_line_array(files.select("path", "content")).where(n > 0).select("path", n.alias("n_lines"), F.explode(F.transform(grid, window)).alias("w"))
    return cut.select("path", "n_lines", "w.*").where(F.col("start_line") <= F.col("end_line"))


def cut_excerpts(files: DataFrame, requests: DataFrame, numbered: bool = True, part_lines: int = PART_LINES) -> DataFrame:
    """What ``render_excerpts(collapse_omissions(slice_lines(..)))`` gives, cut from each file's own line array.

    Requests (numbers only) are gathered by path and block of lines and sent to the files, which are not
    exploded into lines. On ``files`` written by ``keyed_store`` only the requests are shuffled.
    """
    readable = requests.where(F.col("error").isNull()) if "error" in requests.columns else requests
    readable = readable.where(F.col("end") >= F.col("start"))
    runs = omission_runs(readable).groupBy("request_id").agg(F.collect_list(F.struct("run_start", "run_end")).alias("runs"))
    asked = readable.join(runs, "request_id", "left").select(
        "path",
        F.floor(F.col("start") / F.lit(16 * part_lines)).alias("block"),
        F.struct("request_id", "start", "end", F.coalesce("runs", F.array().cast("array<struct<run_start:int,run_end:int>>")).alias("runs")).alias("ask"),
    )
    gathered = asked.groupBy("path", "block").agg(F.collect_list("ask").alias("asks")).drop("block")
    body = F.col("body")

    def line(ask: Column, text: Column, no: Column) -> Column:
        inside = F.filter(ask["runs"], lambda r: (r["run_start"] <= no) & (no <= r["run_end"]))
        run = F.get(inside, F.lit(0))
        span = F.when(run["run_start"] == run["run_end"], no.cast("string")).otherwise(F.concat_ws("-", run["run_start"], run["run_end"]))
        marker = F.when(run["run_end"] == no, F.concat(F.lit(MARKER[0]), span, F.lit(MARKER[1])))
        return F.when(F.size(inside) == 0, _shown(text, no, numbered)).otherwise(marker)

    def part(ask: Column, p: Column) -> Column:
        start = ask["start"] + p * part_lines
        lines = F.slice(body, start, F.least(ask["end"] - start + 1, F.lit(part_lines)))
        left = F.filter(F.transform(lines, lambda x, i: line(ask, x, start + i)), lambda x: x.isNotNull())
        excerpt = F.when(F.size(left) > 0, F.array_join(left, "\n"))
        return F.struct(ask["request_id"].alias("request_id"), p.cast("int").alias("part"), excerpt.alias("excerpt"))

    def parts(ask: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((ask["end"] - ask["start"]) / F.lit(part_lines)).cast("int")), lambda p: part(ask, p))

    joined = tx.with_line_array(files.select("path", "content").join(gathered, "path"))
    pieces = joined.select("path", F.explode(F.flatten(F.transform("asks", parts))).alias("piece"))
    return pieces.select("piece.request_id", "path", "piece.part", "piece.excerpt").where(F.col("excerpt").isNotNull())


def render_excerpts(sliced: DataFrame, numbered: bool = True, part_lines: int = PART_LINES) -> DataFrame:
    """One text per request and part: ``(request_id, path, part, excerpt)``.

    A request longer than ``part_lines`` continues in further parts, so no group is unbounded
    and no line is lost.
    """
    line = F.col("text")
    if numbered:
        line = F.when(F.col("line_no") == NO_LINE, line).otherwise(
            F.concat(F.col("line_no").cast("string"), F.lit(": "), line)
        )
    packed = F.array_sort(F.collect_list(F.struct(F.col("pos"), line.alias("line"))))
    return (
        sliced.withColumn("part", F.floor(F.col("pos") / F.lit(part_lines)).cast("int"))
        .groupBy("request_id", "path", "part")
        .agg(F.array_join(F.transform(packed, lambda x: x["line"]), "\n").alias("excerpt"))
    )
