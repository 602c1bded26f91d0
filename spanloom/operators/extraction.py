"""Definitions, their line ranges, nesting and calls, by rules on lines and tokens.

``code_lines`` turns files into slim rows with everything the later steps need (definition, its last line,
calls, the functions around them) and without the text. The step is map-only: blocks come from the file's
own lines, brackets of the brace languages from its tokens. ``code_lines_of`` gives line rows for
a bare ``lines`` table; there a comment or literal ends with its line, and brace languages have
line rules only.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as bl
from ..functions import languages as lang
from ..functions import text as tx
from ..functions import tokens as tk
from ..plans.lookup import join_lookup
from ..plans.ordered import following, following_by_size, preceding, running_sum
from ..plans.ranked import numbered
from ..plans.spans import join_spans
from ..session import cut, ship

# A line that starts with one of these continues the statement above it.
_CLOSERS = ")]}" + lang.CARRIED


def code_lines(files: DataFrame, whole: bool = False) -> DataFrame:
    """``files`` -> code rows of the files with a known suffix; map-only.

    Indented languages give one row per non-blank line. Brace languages give a row for each definition
    with a body, its last line known, and one for each line with calls (style ``token``).

    With ``whole`` the definitions of indented languages know their last line too, and calls the functions
    around them (style ``whole``), so that no look-up per path is left. Files that share a path with another
    one see each other's lines in those look-ups; a count of path hashes finds them first, and they stay as they are.
    """
    if not whole:
        return _indented_lines(files).unionByName(_token_lines(files))
    indented = files.where(lang.is_source(F.col("path"), "indent"))
    path_hash = F.xxhash64("path")
    counted = indented.groupBy(path_hash.alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    shared = cut(counted.where(F.col("_n") > 1).select("_h"), "shared")
    if shared.isEmpty():
        return _whole_files(files).unionByName(_token_lines(files))
    alone = indented.join(shared, path_hash == F.col("_h"), "left_anti")
    others = indented.join(shared, path_hash == F.col("_h"), "left_semi")
    return _whole_files(alone).unionByName(_indented_lines(others)).unionByName(_token_lines(files))


def _whole_files(files: DataFrame) -> DataFrame:
    """Rows of indented files, each worked out from its file alone; a text goes to its task's batches as it is."""
    ship(files.sparkSession)
    path, content = F.col("path"), F.col("content")
    bare = files.where(lang.is_source(path, "indent")).select("path", lang.bare_text(content, tx.suffix_of(path)).alias("content"))
    # Only these texts are split here; the plain test stands for nothing but speed.
    crossing = content.rlike(r"\n[ \t]*+\(") & content.rlike(lang.CROSSING)
    lines = F.transform("body", lambda x, i: F.struct((i + 1).alias("line_no"), F.octet_length(x).alias("size"), _rest(x).alias("rest")))
    below = F.transform(lang.calls_below(F.col("filled")), lambda i: F.get("filled", i)["line_no"])
    rows = (
        bare.withColumn("content", F.when(content.rlike(tx.RARE_BREAK), F.regexp_replace(content, tx.LINE_BREAK, "\n")).otherwise(content))
        .withColumn("body", F.when(crossing, F.split("content", "\n", -1)))
        .withColumn("filled", F.when(F.col("body").isNotNull(), F.filter(lines, lambda x: x["rest"] != "")))
        .select("path", "content", F.when(F.col("filled").isNotNull(), below).alias("joined"))
    )
    none = F.lit(None)
    return rows.mapInArrow(bl.block_rows, bl.SCHEMA).select(
        "path",
        "line_no",
        F.lit("whole").alias("style"),
        *[none.cast("int").alias(c) for c in ("indent", "prev_line")],
        none.cast("array<int>").alias("closes"),
        *[none.cast("int").alias(c) for c in ("next_indent", "last_line")],
        "kind",
        "name",
        "calls",
        "has_bracket",
        *[none.cast("int").alias(c) for c in ("net", "dip")],
        none.cast("string").alias("mark"),
        "end_line",
        "owners",
        "n_named",
    )


def _bare_files(files: DataFrame) -> DataFrame:
    """Lines (``body``) of indented files without comments and literals.

    ``crossing``: a line may start with the bracket of a call above; the lines are looked at before the pattern is.
    """
    path = F.col("path")
    known = files.where(lang.is_source(path, "indent")).select(
        "path", lang.bare_text(F.col("content"), tx.suffix_of(path)).alias("content")
    )
    bracket = F.exists("body", lambda x: F.startswith(_rest(x), F.lit("(")))
    split = tx.with_line_array(known.withColumn("bare", F.col("content")))
    return split.select("path", "body", (bracket & F.col("bare").rlike(lang.CROSSING)).alias("crossing"))


def _token_lines(files: DataFrame) -> DataFrame:
    ship(files.sparkSession)
    suffix = tx.suffix_of(F.col("path"))
    pattern = lang.by_suffix(F.col("suffix"), tk.TOKENS, F.lit)
    bare = files.where(lang.is_source(F.col("path"), "brace")).select(
        "path", suffix.alias("suffix"), lang.bare_text(F.col("content"), suffix).alias("content")
    )
    tokens = bare.select("path", "suffix", F.regexp_extract_all("content", pattern, F.lit(0)).alias("tokens"))
    none = F.lit(None)
    return tokens.mapInArrow(tk.token_rows, tk.SCHEMA).select(
        "path",
        "line_no",
        F.lit("token").alias("style"),
        *[none.cast("int").alias(c) for c in ("indent", "prev_line")],
        none.cast("array<int>").alias("closes"),
        *[none.cast("int").alias(c) for c in ("next_indent", "last_line")],
        "kind",
        "name",
        "calls",
        F.col("calls").isNotNull().alias("has_bracket"),
        *[none.cast("int").alias(c) for c in ("net", "dip")],
        none.cast("string").alias("mark"),
        "end_line",
        none.cast("array<string>").alias("owners"),
        none.cast("int").alias("n_named"),
    )


def _indented_lines(files: DataFrame) -> DataFrame:
    stripped = F.transform(
        "body",
        lambda x, i: F.struct(
            (i + 1).alias("line_no"), F.octet_length(x).alias("size"), _rest(x).alias("rest")
        ),
    )
    body = F.col("body")
    filled = (
        _bare_files(files)
        .select("path", "crossing", F.filter(stripped, lambda x: x["rest"] != "").alias("body"))
        .withColumn("joined", F.when(F.col("crossing"), lang.calls_below(body)))
        .withColumn("indents", F.array_distinct(F.transform(body, _indent)))
    )

    def with_neighbours(x, i):
        back, back2, ahead = F.get(body, i - 1), F.get(body, i - 2), F.get(body, i + 1)
        above = _prev_indent(_indent(back), back["rest"], _indent(back2))
        closes = F.filter("indents", lambda lv: (lv >= _indent(x)) & (lv < above))
        return F.struct(
            x["line_no"].alias("line_no"),
            x["rest"].alias("rest"),
            back["rest"].alias("above"),
            _indent(x).alias("indent"),
            back["line_no"].alias("prev_line"),
            F.when(_dedents(x["rest"], _indent(x), above), closes).alias("closes"),
            _indent(ahead).alias("next_indent"),
            F.element_at(body, -1)["line_no"].alias("last_line"),
            F.coalesce(F.array_contains("joined", i), F.lit(False)).alias("called_below"),
        )

    rows = filled.select("path", F.explode_outer(F.transform(body, with_neighbours)).alias("row"))
    return _features(rows.where(F.col("row").isNotNull()).select("path", "row.*"))


def code_lines_of(lines: DataFrame) -> DataFrame:
    """``lines`` -> code rows; neighbours come from ordered look-ups per path."""
    bare = lang.bare_text(F.col("text"), tx.suffix_of(F.col("path")))
    known = lines.where(lang.is_source(F.col("path"))).select("path", "line_no", bare.alias("text"))
    stripped = known.select(
        "path", "line_no", F.octet_length("text").alias("size"), _rest(F.col("text")).alias("rest")
    )
    filled = stripped.where(F.col("rest") != "").withColumn(
        "indent", F.col("size") - F.octet_length("rest")
    )
    here = F.struct("line_no", "indent", "rest")
    back = preceding(filled, ["path"], "line_no", here, "_back")
    back = preceding(
        back, ["path"], "line_no", F.struct(F.col("_back.indent").alias("indent")), "_back2"
    )
    both = following(back, ["path"], "line_no", here, "_ahead")
    ends = filled.groupBy("path").agg(F.max("line_no").alias("last_line"))
    above = _prev_indent(F.col("_back.indent"), F.col("_back.rest"), F.col("_back2.indent"))
    rows = join_lookup(both, ends, "path").select(
        "path",
        "line_no",
        "rest",
        F.col("_back.rest").alias("above"),
        "indent",
        F.col("_back.line_no").alias("prev_line"),
        F.when(
            _dedents(F.col("rest"), F.col("indent"), above), F.sequence("indent", above - 1)
        ).alias("closes"),
        F.col("_ahead.indent").alias("next_indent"),
        "last_line",
        F.lit(False).alias("called_below"),
    )
    return _features(rows)


def _rest(text: Column) -> Column:
    """The line from its first visible character on; empty for a blank line."""
    return F.ltrim(text, F.lit(" \t"))


def _indent(line: Column) -> Column:
    """Leading white space in characters (all of them one byte)."""
    return line["size"] - F.octet_length(line["rest"])


def _continues(rest: Column) -> Column:
    return F.instr(F.lit(_CLOSERS), F.left(rest, F.lit(1))) > 0


def _prev_indent(indent: Column, rest: Column, before: Column) -> Column:
    """Indent above a line; a line of closing brackets stands for the deeper line above it."""
    return F.when(_continues(rest), F.greatest(indent, before)).otherwise(indent)


def _dedents(rest: Column, indent: Column, above: Column) -> Column:
    """The line ends every block whose level lies from its own indent to below the one above."""
    return (above > indent) & ~_continues(rest)


def _features(rows: DataFrame) -> DataFrame:
    """Definition, calls and braces of each line.

    Every pattern is evaluated in a layer of its own, so that no later expression repeats it.
    """
    suffix, bare = F.col("suffix"), F.col("rest")
    name = F.when(F.col("function") != "", F.col("function")).when(F.col("class") != "", F.col("class"))
    typed_above = (
        suffix.isin("c", "cpp")
        & (F.col("indent") == 0)
        & bare.rlike(lang.NAME_LINE)
        & F.col("above").rlike(lang.TYPE_LINE)
    )
    last = F.regexp_extract(bare, lang.LAST_NAME, 1)
    below = F.concat(F.coalesce("called", F.array().cast("array<string>")), F.array(last))
    named = (
        rows.withColumn("suffix", tx.suffix_of(F.col("path")))
        .withColumn("head", F.when(typed_above, F.concat_ws(" ", "above", bare)).otherwise(bare))
        .withColumn("function", lang.match_name(F.col("head"), lang.rule_for(suffix, lang.FUNCTION_RULES)))
        .withColumn(
            "class",
            F.when(
                F.col("function") == "",
                lang.match_name(bare, lang.rule_for(suffix, lang.CLASS_RULES)),
            ).otherwise(F.lit("")),
        )
        .withColumn("called", lang.call_names(bare, lang.rule_for(suffix, lang.CALL_RULES)))
        .withColumn("called", F.when(F.col("called_below"), below).otherwise(F.col("called")))
        .withColumn("style", lang.block_style(suffix))
        .withColumn("braces", F.when(F.col("style") == "brace", lang.braces_of(bare)))
    )
    own_first = F.get("called", F.lit(0)) == name
    return named.select(
        "path",
        "line_no",
        "style",
        "indent",
        "prev_line",
        "closes",
        "next_indent",
        "last_line",
        F.when(F.col("function") != "", "function").when(F.col("class") != "", "class").alias("kind"),
        name.alias("name"),
        F.when(own_first, F.slice("called", 2, F.size("called")))
        .otherwise(F.col("called"))
        .alias("calls"),
        ((F.instr("rest", "(") > 0) | F.col("called_below")).alias("has_bracket"),
        lang.depth_change(F.col("braces")).alias("net"),
        lang.depth_dip(F.col("braces")).alias("dip"),
        F.when(F.col("style") == "brace", lang.first_mark(bare)).alias("mark"),
        F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("array<string>").alias("owners"),
        F.lit(None).cast("int").alias("n_named"),
    )


def find_definitions(code: DataFrame, kind: str | None = None) -> DataFrame:
    """Lines that start a definition: ``(path, target_id, name, start_line)``; map-only.

    In brace languages a declaration without a body still appears here; ``span_ends`` drops it.
    """
    rows = code.where(F.col("kind").isNotNull() if kind is None else F.col("kind") == kind)
    return rows.select(
        "path", F.col("kind").alias("target_id"), "name", F.col("line_no").alias("start_line")
    )


def _indent_events(code: DataFrame) -> DataFrame:
    """Queries (definitions) and closers of indented languages, one stream per (path, level).

    A line closes the levels from its own indent up to just below the indent above it, so the
    rows emitted are bounded by the white space in the file.
    """
    closes = F.transform(
        "closes",
        lambda lv: F.struct(
            lv.alias("level"),
            F.col("prev_line").alias("closed_at"),
            F.lit(None).cast("string").alias("kind"),
        ),
    )
    asks = F.when(
        F.col("kind").isNotNull(),
        F.array(
            F.struct(
                F.col("indent").alias("level"),
                F.lit(None).cast("int").alias("closed_at"),
                F.col("kind").alias("kind"),
            )
        ),
    )
    none = F.array().cast("array<struct<level:int,closed_at:int,kind:string>>")
    flat = F.col("kind").isNotNull() & (
        F.col("next_indent").isNull() | (F.col("next_indent") <= F.col("indent"))
    )
    return (
        code.where(F.col("style") == "indent")
        .withColumn("_event", F.explode(F.concat(F.coalesce(closes, none), F.coalesce(asks, none))))
        .select(
            "path",
            F.col("_event.level").alias("level"),
            F.col("line_no").alias("at"),
            F.col("_event.closed_at").alias("closed_at"),
            F.col("_event.kind").alias("kind"),
            F.when(F.col("_event.kind").isNotNull(), F.col("name")).alias("name"),
            F.col("line_no").alias("start_line"),
            "last_line",
            F.when(flat, F.col("line_no")).alias("end_known"),
        )
    )


def _brace_events(code: DataFrame) -> DataFrame:
    """The same stream for brace languages; the level is the depth around the definition."""
    braces = code.where(
        (F.col("style") == "brace")
        & (F.col("mark").isNotNull() | (F.col("net") != 0) | (F.col("dip") < 0) | F.col("kind").isNotNull())
    ).select("path", "line_no", "kind", "name", "net", "dip", "mark", "last_line")
    deep = running_sum(braces, ["path"], "line_no", F.col("net"), "after").withColumn(
        "before", F.col("after") - F.col("net")
    )
    mark = F.struct("mark", "line_no", "after")
    opened = following(
        deep, ["path"], "line_no", F.when(F.col("mark").isNotNull(), mark), "_next"
    ).withColumn("_open", F.when(F.col("mark").isNotNull(), mark).otherwise(F.col("_next")))
    low = F.col("before") + F.col("dip")
    closes = F.when(
        F.col("dip") < 0,
        F.transform(
            F.sequence(low, F.col("before") - 1),
            lambda lv: F.struct(
                lv.alias("level"),
                F.col("line_no").alias("at"),
                F.col("line_no").alias("closed_at"),
                F.lit(None).cast("string").alias("kind"),
                F.lit(None).cast("int").alias("end_known"),
            ),
        ),
    )
    asks = F.when(
        F.col("kind").isNotNull() & (F.col("_open.mark") == "{"),
        F.array(
            F.struct(
                low.alias("level"),
                F.col("_open.line_no").alias("at"),
                F.lit(None).cast("int").alias("closed_at"),
                F.col("kind").alias("kind"),
                F.when(F.col("_open.after") <= low, F.col("_open.line_no")).alias("end_known"),
            )
        ),
    )
    none = F.array().cast("array<struct<level:int,at:int,closed_at:int,kind:string,end_known:int>>")
    return opened.withColumn(
        "_event", F.explode(F.concat(F.coalesce(closes, none), F.coalesce(asks, none)))
    ).select(
        "path",
        "_event.level",
        "_event.at",
        "_event.closed_at",
        "_event.kind",
        F.when(F.col("_event.kind").isNotNull(), F.col("name")).alias("name"),
        F.col("line_no").alias("start_line"),
        "last_line",
        "_event.end_known",
    )


def span_ends(
    code: DataFrame, styles: tuple[str, ...] = ("indent", "brace"), stored: bool = False
) -> DataFrame:
    """Definitions with their last line: ``found`` rows without parents.

    ``styles`` names the block styles to look for; leave one out when the corpus has none of it.
    Rows of whole files know the last line; rows of ``code_lines_of`` and of shared paths look for it.
    ``stored`` says that ``code`` is a written table, which makes further reads of it cheap.
    """
    known = [name for style, name in (("indent", "whole"), ("brace", "token")) if style in styles]
    read = code.where(F.col("style").isin(known) & F.col("kind").isNotNull()).select(
        "path",
        F.col("kind").alias("target_id"),
        "name",
        F.col("line_no").alias("start_line"),
        "end_line",
        F.lit(None).cast("string").alias("parent_id"),
    )
    if stored and code.where(F.col("style").isin(*styles)).isEmpty():
        return read
    parts = [events(code) for style, events in (("indent", _indent_events), ("brace", _brace_events)) if style in styles]
    return _looked_up(reduce(DataFrame.unionByName, parts), stored).unionByName(read)


def leading_functions(code: DataFrame, styles: tuple[str, ...] = ("indent", "brace"), stored: bool = False) -> DataFrame:
    """Functions that may be the first of their name, with the number ``n_named`` of functions they stand for.

    Files that were worked on together have one such function a name; of all other rows each function is one.
    The first of a name over all files and the sum of ``n_named`` are those of all functions of ``span_ends``.
    """
    rest = code.where(F.col("style") != "whole")
    none = stored and rest.isEmpty()
    parts = []
    if "indent" in styles:
        known = code.where((F.col("style") == "whole") & F.col("n_named").isNotNull())
        parts.append(known.select("path", F.col("kind").alias("target_id"), "name", F.col("line_no").alias("start_line"), "end_line", "n_named"))
    if not (parts and none):
        others = span_ends(rest, styles, stored).where(F.col("target_id") == "function")
        parts.append(others.select("path", "target_id", "name", "start_line", "end_line", F.lit(1).alias("n_named")))
    return reduce(DataFrame.unionByName, parts)


def _looked_up(events: DataFrame, stored: bool) -> DataFrame:
    look_up = (events, ["path", "level"], "at", F.col("closed_at"), "end_found")
    closed = following_by_size(*look_up, last="last_line") if stored else following(*look_up)
    return closed.where(F.col("kind").isNotNull()).select(
        "path",
        F.col("kind").alias("target_id"),
        "name",
        "start_line",
        F.coalesce("end_known", "end_found", "last_line").alias("end_line"),
        F.lit(None).cast("string").alias("parent_id"),
    )


def nest(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Set ``parent_id`` of each child to the innermost parent its first line lies in.

    Children outside every parent are dropped. Both sides are ``found`` rows.
    """
    outer = parents.select(
        "path",
        tx.node_id(F.col("path"), F.col("start_line"), F.col("name")).alias("_pid"),
        F.col("start_line").alias("_from"),
        F.col("end_line").alias("_to"),
    )
    hits = join_spans(children.drop("parent_id"), outer, ["path"], "start_line", "_from", "_to")
    own = tx.node_id(F.col("path"), F.col("start_line"), F.col("name"))
    keys = ["path", "target_id", "name", "start_line", "end_line"]
    return (
        hits.where(F.col("_pid") != own)
        .groupBy(*keys)
        .agg(F.max(F.struct("_from", "_pid"))["_pid"].alias("parent_id"))
    )


def nested_view(found: DataFrame, part_children: int = 4096) -> DataFrame:
    """Children per parent as arrays: ``(path, parent_id, part, children)``.

    An array holds at most ``part_children`` children; longer lists go on in further parts. Children
    are numbered by ranges, so a parent with most of them is spread over many tasks.
    """
    place = ["start_line", "end_line", "target_id", "name"]
    rows = numbered(found.where(F.col("parent_id").isNotNull()).select("path", "parent_id", *place), ["path", "parent_id"], place)
    rows = rows.withColumn("part", F.floor((F.col("place") - 1) / F.lit(part_children)).cast("int"))
    child = F.struct(*place)
    return rows.groupBy("path", "parent_id", "part").agg(
        F.array_sort(F.collect_list(child)).alias("children")
    )


def exclude_claimed(found: DataFrame, earlier: DataFrame) -> DataFrame:
    """Drop definitions that start inside a range an earlier target has claimed."""
    claims = earlier.select(
        "path", F.col("start_line").alias("_from"), F.col("end_line").alias("_to")
    )
    return join_spans(found, claims, ["path"], "start_line", "_from", "_to", "left_anti")


def find_calls(code: DataFrame, functions: DataFrame | None = None, innermost: bool = False, stored: bool = False) -> DataFrame:
    """Call sites inside functions: ``calls(caller_id, callee_name, file, line_no)``.

    An outer function also owns the calls of an inner one, because a body is read whole;
    ``innermost=True`` keeps the inner owner only. Calls outside any function give no row. Without
    ``functions`` the functions of ``code`` itself are meant: rows of whole files hold them, the others
    are joined to theirs. ``stored`` says that ``code`` is a written table.
    """
    if functions is not None:
        return _joined_calls(code, functions, innermost)
    rest = code.where(F.col("style") != "whole")
    owner = F.slice("owners", -1, 1) if innermost else F.col("owners")
    sites = code.where((F.col("style") == "whole") & (F.size("owners") > 0))
    owned = _call_rows(sites.select("path", "line_no", "calls", F.explode(owner).alias("owner")).withColumn("caller_id", F.concat_ws(":", "path", "owner")))
    if stored and rest.isEmpty():
        return owned
    theirs = span_ends(rest, stored=stored).where(F.col("target_id") == "function")
    return owned.unionByName(_joined_calls(rest, theirs, innermost))


def _call_rows(hits: DataFrame) -> DataFrame:
    return hits.select(
        "caller_id",
        F.explode_outer("calls").alias("callee_name"),
        F.col("path").alias("file"),
        "line_no",
    ).where(F.col("callee_name").isNotNull())


def _joined_calls(code: DataFrame, functions: DataFrame, innermost: bool) -> DataFrame:
    # Filtering on the cheap flag keeps the call pattern from being evaluated a second time.
    sites = code.where("has_bracket").select("path", "line_no", "calls")
    spans = functions.select(
        "path",
        tx.node_id(F.col("path"), F.col("start_line"), F.col("name")).alias("caller_id"),
        F.col("start_line").alias("_from"),
        F.col("end_line").alias("_to"),
    )
    hits = join_spans(sites, spans, ["path"], "line_no", "_from", "_to")
    if innermost:
        hits = (
            hits.groupBy("path", "line_no", "calls")
            .agg(F.max(F.struct("_from", "caller_id"))["caller_id"].alias("caller_id"))
        )
    return _call_rows(hits)


ANSWER_LOG = "prompt_key STRING, raw STRING, time_secs DOUBLE, error STRING"


def extract_with(
    prompts: DataFrame, batch: Callable[[list[str]], list[str]], parallelism: int | None = None, batch_size: int = 256
) -> DataFrame:
    """Ask a caller's batch function: ``(prompt_key, raw, time_secs, error)``, one row per distinct prompt.

    ``parallelism`` is the number of calls in flight, by default the session's; Spark does not merge
    these partitions. A call gets at most ``batch_size`` prompts; one that fails gives rows with ``error``
    and no ``raw``, the others go on. Write the result once (``cut``, or ``ask_log`` to go on
    after a stop) and attach it as recorded answers, so that a re-run does not ask again.
    """
    n = parallelism or prompts.sparkSession.sparkContext.defaultParallelism
    asked = prompts.select("prompt_key", "prompt").repartition(n, "prompt_key").dropDuplicates(["prompt_key"])

    def run(batches):
        import time

        import pandas as pd

        for whole in batches:
            for at in range(0, len(whole), batch_size):
                frame = whole.iloc[at : at + batch_size]
                began, error = time.perf_counter(), None
                try:
                    answers = list(batch(frame["prompt"].tolist()))
                    if len(answers) != len(frame):
                        raise ValueError(f"{len(answers)} answers to {len(frame)} prompts")
                except Exception as failure:  # the batch function is the caller's: whatever it raises, the others go on
                    answers, error = [None] * len(frame), f"{type(failure).__name__}: {failure}"
                spent = (time.perf_counter() - began) / len(frame)
                yield pd.DataFrame({"prompt_key": frame["prompt_key"], "raw": answers, "time_secs": spent, "error": error})

    return asked.mapInPandas(run, ANSWER_LOG)


def ask_log(
    prompts: DataFrame,
    batch: Callable[[list[str]], list[str]],
    path: str,
    parallelism: int | None = None,
    batch_size: int = 256,
    turns: int = 1,
) -> DataFrame:
    """``extract_with`` over a log at ``path`` that outlives the job: what it holds is not asked again.

    Open prompts are asked in ``turns`` parts; each is appended when it is done, so that a stop loses one part.
    Failed prompts count as open. Gives a row per prompt of ``prompts``, failed ones with their last error.
    """
    spark = prompts.sparkSession
    spark.createDataFrame([], ANSWER_LOG).write.mode("append").parquet(path)

    def log() -> DataFrame:
        return spark.read.schema(ANSWER_LOG).parquet(path)

    turn = F.pmod(F.xxhash64("prompt_key"), F.lit(turns))
    for k in range(turns):
        done = log().where(F.col("raw").isNotNull()).select("prompt_key").distinct()
        open_ = prompts.where(turn == k).select("prompt_key", "prompt").join(done, "prompt_key", "left_anti")
        extract_with(open_, batch, parallelism, batch_size).write.mode("append").parquet(path)
    state = F.max(F.struct(F.col("raw").isNotNull(), "raw", "time_secs", "error")).alias("s")
    latest = log().groupBy("prompt_key").agg(state).select("prompt_key", "s.raw", "s.time_secs", "s.error")
    return latest.join(prompts.select("prompt_key").distinct(), "prompt_key", "left_semi")


def map_fields(found: DataFrame, mapping: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Reshape raw fields with column expressions; a missing ``file`` becomes the window's path."""
    given = F.col("file") if "file" in found.columns else F.lit(None).cast("string")
    return found.withColumn("file", F.coalesce(given, "path")).transform(mapping)


def as_node_fields(found: DataFrame) -> DataFrame:
    """The usual mapping: ``(name, loc STRUCT<file, line_start, line_end>)``."""
    return found.select(
        "name",
        F.struct(
            F.col("file"),
            F.col("start_line").alias("line_start"),
            F.col("end_line").alias("line_end"),
        ).alias("loc"),
    )
