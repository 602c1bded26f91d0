"""Registered queries: each runs one operator over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as an
from ..operators import extraction as ex
from ..operators import graph as gr
from ..operators import lines as ln
from ..operators import scoring as sc
from ..operators import windows as wn
from ..plans.callgraph import CallGraph, call_graph, graph_from, most_called, stored_edges
from ..schema import CLASS, FUNCTION, RECORD_CALL, RETRY_WITH, found_action
from ..session import cut, new_folder
from ..sinks import graph as sk
from ..sources import answers as sa
from ..sources import files as sf
from ..sources import golden as gl
from . import corpus
from .answer_log import raw_answers

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
CATALOG = [found_action(FUNCTION), RETRY_WITH, RECORD_CALL]

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def forget() -> None:
    """Drop the shared tables, so that the next query derives everything again."""
    _TABLES.clear()


def _shared(spark: SparkSession, sf_dir: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the derived corpus that several queries read, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _TABLES:
        _TABLES[key] = cut(build(), label, "zstd")
    return _TABLES[key]


def code_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir, "code", lambda: ex.code_lines(corpus.code_files(spark, sf_dir), whole=True))


def found_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has Python files only, so the brace branch is left out. Read from the code rows unless paths repeat."""
    code = code_of(spark, sf_dir)
    if code.where(F.col("style") == "indent").isEmpty():
        return ex.span_ends(code, ("indent",), stored=True)
    return _shared(spark, sf_dir, "found", lambda: ex.span_ends(code, ("indent",), stored=True))


def _graph(spark: SparkSession, sf_dir: str) -> CallGraph:
    """The graph whose edges are worked out where they are read; the corpus has Python files only."""
    return graph_from(code_of(spark, sf_dir), found_of(spark, sf_dir), stored=True, styles=("indent",))


def graph_of(spark: SparkSession, sf_dir: str) -> CallGraph:
    graph = _graph(spark, sf_dir)
    graph.edges = _shared(spark, sf_dir, "edges", lambda: stored_edges(graph))
    return graph


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_of(spark, sf_dir).where(F.col("target_id") == "function")


def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_of(spark, sf_dir).where(F.col("target_id") == "class")


@query
def most_called_functions(spark, sf_dir):
    return most_called(graph_of(spark, sf_dir))


@query
def order_files(spark, sf_dir):
    return corpus.order_files(spark, sf_dir)


@query
def split_lines(spark, sf_dir):
    return ln.split_lines(corpus.document_files(spark, sf_dir))


@query
def line_counts(spark, sf_dir):
    return ln.line_counts(corpus.document_files(spark, sf_dir))


@query
def plan_windows(spark, sf_dir):
    return wn.plan_windows(ln.line_counts(corpus.document_files(spark, sf_dir)))


@query
def find_functions(spark, sf_dir):
    return ex.find_definitions(code_of(spark, sf_dir), "function").drop("target_id")


@query
def find_classes(spark, sf_dir):
    return ex.find_definitions(code_of(spark, sf_dir), "class").drop("target_id")


@query
def span_ends(spark, sf_dir):
    return found_of(spark, sf_dir).drop("parent_id")


@query
def build_nodes(spark, sf_dir):
    return gr.build_nodes(found_of(spark, sf_dir))


@query
def find_calls(spark, sf_dir):
    return ex.find_calls(code_of(spark, sf_dir), stored=True)


def _brace_query(suffix: str):
    def run(spark, sf_dir):
        """Definitions and calls of one brace language, over a file per customer."""
        graph = call_graph(corpus.brace_files(spark, sf_dir, suffix), ("brace",))
        found = graph.found.select("path", F.col("target_id").alias("kind"), "name", F.lit("").alias("owner"), "start_line", "end_line")
        calls = graph.calls.select(
            F.col("file").alias("path"),
            F.lit("call").alias("kind"),
            F.col("callee_name").alias("name"),
            F.col("caller_id").alias("owner"),
            F.col("line_no").alias("start_line"),
            F.col("line_no").alias("end_line"),
        )
        return found.unionByName(calls)

    run.__name__ = f"code_{suffix}"
    return query(run)


for _suffix in corpus.BRACE_TEXTS:
    _brace_query(_suffix)


@query
def resolve_callees(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.resolve_callees(graph.calls, graph.leading, gr.hot_names(graph.calls)).select(
        "caller_id", "callee_name", "callee_id", "line_no"
    )


@query
def unresolved_calls(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.unresolved_calls(graph.calls, graph.leading)


@query
def name_candidates(spark, sf_dir):
    graph = _graph(spark, sf_dir)
    return gr.name_candidates(graph.calls, graph.leading, gr.hot_names(graph.calls)).drop("file")


@query
def build_edges(spark, sf_dir):
    return graph_of(spark, sf_dir).edges


@query
def edges_with_endpoints(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return gr.edges_with_endpoints(graph.edges, graph.nodes).select(
        "caller_name", "callee_name", "file", "line_start"
    )


@query
def graph_summary(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return gr.graph_summary(graph.nodes, graph.edges)


@query
def dot_ids(spark, sf_dir):
    return gr.dot_ids(gr.build_nodes(found_of(spark, sf_dir)))


@query
def dot_id_collisions(spark, sf_dir):
    """Half of the ids get a second one that differs in a mapped character only."""
    nodes = gr.build_nodes(found_of(spark, sf_dir)).select("node_id")
    twins = nodes.where(F.endswith("node_id", F.lit("1"))).select(
        F.replace("node_id", F.lit(".py:"), F.lit("-py:")).alias("node_id")
    )
    return gr.dot_id_collisions(nodes.unionByName(twins))


@query
def adjacency(spark, sf_dir):
    lists = gr.adjacency(graph_of(spark, sf_dir).edges)
    return lists.select("caller_id", "part", F.array_join("callees", " ").alias("callees"))


@query
def nest_methods(spark, sf_dir):
    return ex.nest(_classes(spark, sf_dir), _functions(spark, sf_dir)).drop("target_id")


@query
def nested_view(spark, sf_dir):
    view = ex.nested_view(ex.nest(_classes(spark, sf_dir), _functions(spark, sf_dir)))
    names = F.array_join(F.transform("children", lambda x: x["name"]), " ")
    return view.select("path", "parent_id", "part", names.alias("children"))


@query
def exclude_claimed(spark, sf_dir):
    return ex.exclude_claimed(_functions(spark, sf_dir), _classes(spark, sf_dir)).select(
        "path", "name", "start_line", "end_line"
    )


@query
def windows_within(spark, sf_dir):
    parents = _classes(spark, sf_dir).select("path", "name", "start_line", "end_line")
    return wn.plan_windows_within(parents)


@query
def subtract_claimed(spark, sf_dir):
    """Windows of the order and library files less the class ranges (one level per file)."""
    files = corpus.code_files(spark, sf_dir)
    windows = wn.plan_windows(ln.line_counts(files))
    methods = _functions(spark, sf_dir).where(~F.startswith("name", F.lit("run_")))
    return wn.subtract_claimed(windows, methods)


def _document_requests(spark, sf_dir):
    """One read request per document; some lie outside it, some specs have a bad token."""
    key = F.col("doc_id")
    start = F.when(key % 11 == 0, 0).otherwise(key % 7 + 1)
    spec = F.when(key % 3 == 0, F.lit("")).otherwise(
        F.concat(
            (key % 7 + 2).cast("string"), F.lit("-"), (key % 7 + 4).cast("string"), F.lit(","),
            (key % 7 + 5 + key % 2).cast("string"),
            F.when(key % 13 == 0, F.lit(",x")).when(key % 13 == 1, F.lit(",40-60")).otherwise(F.lit("")),
        )
    )
    docs = corpus.spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))
    requests = docs.select(
        key.cast("string").alias("request_id"),
        F.concat(F.lit("docs/"), key.cast("string"), F.lit(".txt")).alias("path"),
        start.cast("int").alias("start"),
        (start + key % 40).cast("int").alias("end"),
        spec.alias("spec"),
    )
    counts = ln.line_counts(corpus.document_files(spark, sf_dir))
    return ln.check_requests(requests, counts)


@query
def check_requests(spark, sf_dir):
    bad = _document_requests(spark, sf_dir).where(F.col("error").isNotNull())
    return bad.select("request_id", "path", "start", "end", "error")


def _document_slices(spark, sf_dir):
    lines = ln.split_lines(corpus.document_files(spark, sf_dir))
    requests = _document_requests(spark, sf_dir)
    return ln.slice_lines(lines, requests), requests


@query
def slice_lines(spark, sf_dir):
    return _document_slices(spark, sf_dir)[0]


@query
def expand_omissions(spark, sf_dir):
    return ln.expand_omissions(_document_requests(spark, sf_dir))


@query
def bad_omissions(spark, sf_dir):
    return ln.bad_omissions(_document_requests(spark, sf_dir))


@query
def omission_runs(spark, sf_dir):
    return ln.omission_runs(_document_requests(spark, sf_dir))


@query
def collapse_omissions(spark, sf_dir):
    return ln.collapse_omissions(*_document_slices(spark, sf_dir))


@query
def cut_excerpts(spark, sf_dir):
    """The excerpts of ``render_excerpts``, cut in place."""
    return ln.cut_excerpts(corpus.document_files(spark, sf_dir), _document_requests(spark, sf_dir))


@query
def render_excerpts(spark, sf_dir):
    return ln.render_excerpts(ln.collapse_omissions(*_document_slices(spark, sf_dir)))


def _document_windows(spark, sf_dir):
    counts = ln.line_counts(corpus.document_files(spark, sf_dir))
    return wn.window_requests(wn.plan_windows(counts), (CLASS, FUNCTION)), counts


def _window_prompts(spark, sf_dir):
    files = corpus.document_files(spark, sf_dir)
    return wn.window_prompts(files, (CLASS, FUNCTION), lambda t: [found_action(t), RETRY_WITH])


@query
def window_requests(spark, sf_dir):
    return _document_windows(spark, sf_dir)[0].select("request_id", "path", "target_id", "start", "end")


@query
def build_prompts(spark, sf_dir):
    return _window_prompts(spark, sf_dir).select(
        "request_id", "path", "target_id", "prompt_key", F.length("prompt").alias("n_chars")
    )


@query
def build_body_prompts(spark, sf_dir):
    """One prompt per function of the code corpus, over its whole body."""
    spans = _functions(spark, sf_dir).select(
        ex.tx.node_id(F.col("path"), F.col("start_line"), F.col("name")).alias("request_id"),
        "path", F.col("start_line").alias("start"), F.col("end_line").alias("end"),
    )
    excerpts = ln.cut_excerpts(corpus.code_files(spark, sf_dir), spans.withColumn("spec", F.lit("")))
    return wn.build_body_prompts(excerpts, RECORD_CALL).select("request_id", "part", "prompt_key")


def _recorded(spark, sf_dir):
    """A log that answers two thirds of the window prompts, some of them twice."""
    prompts = _window_prompts(spark, sf_dir)
    turn = F.length("prompt") % 3
    first = prompts.where(turn > 0).select(
        "prompt_key", F.lit(1).alias("seq"), F.concat(F.lit("first "), F.length("prompt")).alias("raw")
    )
    second = prompts.where(turn > 1).select(
        "prompt_key", F.lit(2).alias("seq"), F.concat(F.lit("second "), F.length("prompt")).alias("raw")
    )
    return prompts, first.unionByName(second)


@query
def attach_responses(spark, sf_dir):
    prompts, log = _recorded(spark, sf_dir)
    return sa.attach_responses(prompts, log).select("request_id", "raw")


@query
def open_prompts(spark, sf_dir):
    prompts, log = _recorded(spark, sf_dir)
    return sa.open_prompts(prompts, log).select("request_id")


def _shout(prompts: list[str]) -> list[str]:
    """A stand-in for a model: answers with the number of characters it was given."""
    return [str(len(p)) for p in prompts]


@query
def extract_with(spark, sf_dir):
    prompts = _window_prompts(spark, sf_dir)
    return ex.extract_with(prompts, _shout).select("prompt_key", "raw")


def _clean(spark, sf_dir):
    return an.clean_answers(raw_answers(spark, sf_dir))


@query
def clean_answers(spark, sf_dir):
    return _clean(spark, sf_dir).select("request_id", "clean")


def _flat(actions: DataFrame) -> DataFrame:
    field = F.col("input")
    return actions.withColumn("key", F.coalesce(field["function_name"], field["name"])).withColumn(
        "first", F.coalesce(field["start_line"], field["start"], field["file_line"])
    ).withColumn("second", F.coalesce(field["end_line"], field["end"])).drop("input")


@query
def parse_answers(spark, sf_dir):
    return _flat(an.parse_answers(_clean(spark, sf_dir)))


@query
def bad_answers(spark, sf_dir):
    return an.bad_answers(_clean(spark, sf_dir))


@query
def route_actions(spark, sf_dir):
    routed = an.route_actions(an.parse_answers(_clean(spark, sf_dir)), CATALOG)
    return routed.select("request_id", "ordinal", "name", "reason")


def _checked(spark, sf_dir):
    return an.check_required(an.parse_answers(_clean(spark, sf_dir)), CATALOG)


@query
def check_required(spark, sf_dir):
    return _checked(spark, sf_dir).select("request_id", "ordinal", "name", "reason")


@query
def quarantine(spark, sf_dir):
    return an.quarantined(_checked(spark, sf_dir)).select("request_id", "reason")


@query
def answers_to_found(spark, sf_dir):
    good = an.good_actions(_checked(spark, sf_dir))
    return an.answers_to_found(good, raw_answers(spark, sf_dir)).drop("parent_id")


@query
def map_fields(spark, sf_dir):
    good = an.good_actions(_checked(spark, sf_dir))
    found = an.answers_to_found(good, raw_answers(spark, sf_dir))
    return ex.map_fields(found, ex.as_node_fields).select("name", "loc.file", "loc.line_start", "loc.line_end")


@query
def answers_to_calls(spark, sf_dir):
    good = an.good_actions(_checked(spark, sf_dir))
    callers = raw_answers(spark, sf_dir).withColumn("caller_id", F.concat("path", F.lit(":1:caller")))
    return an.answers_to_calls(good, callers)


@query
def next_round(spark, sf_dir):
    good = an.good_actions(_checked(spark, sf_dir))
    counts = ln.line_counts(corpus.document_files(spark, sf_dir))
    return wn.next_round(good, raw_answers(spark, sf_dir), counts)


@query
def request_chain(spark, sf_dir):
    """Five rounds of follow-ups from the first lines of every document; each answer comes in two spellings."""
    counts = cut(ln.line_counts(corpus.document_files(spark, sf_dir)).where(F.col("n_lines") > 0), "counts")
    first = counts.select(
        "path", F.lit("function").alias("target_id"), F.lit(1).alias("start"), F.least(F.lit(10), "n_lines").alias("end"), F.lit("").alias("spec")
    )
    asked = [cut(first.select(wn.request_id().alias("request_id"), "*"), "requests")]
    for _ in range(5):
        line = (F.col("start") + 11).cast("string")
        spelled = F.array(F.concat_ws(",", line, line), F.concat(F.lit(" +"), line, F.lit(" - "), line))
        actions = asked[-1].select(
            "request_id",
            F.posexplode(spelled).alias("part", "spec"),
            F.lit(0).alias("ordinal"),
            F.lit("retry_with").alias("name"),
            (F.col("start") + 10).cast("string").alias("from"),
            (F.col("end") + 10).cast("string").alias("to"),
        )
        fields = F.create_map(F.lit("start"), "from", F.lit("end"), "to", F.lit("omitted_lines"), "spec")
        seen = reduce(DataFrame.unionByName, asked)
        asked.append(cut(wn.next_round(actions.withColumn("input", fields), asked[-1], counts, seen), "requests"))
    return reduce(DataFrame.unionByName, asked)


@query
def usage_rollup(spark, sf_dir):
    log = corpus.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.col("user_id").cast("bigint").alias("in_tokens"),
        F.length("props").cast("bigint").alias("out_tokens"),
        F.col("value").cast("decimal(18,2)").alias("time_secs"),
    )
    return an.usage_rollup(log).withColumn("time_secs", F.col("time_secs").cast("double"))


@query
def estimated_tokens(spark, sf_dir):
    """Token estimate per answer text, for a log that brings no counts."""
    return raw_answers(spark, sf_dir).select("request_id", an.estimated_tokens(F.col("raw")).alias("out_tokens"))


def _golden_texts(spark, sf_dir):
    """A golden graph per order file as JSON, right in some projects, wrong in others."""
    k, m = F.col("k"), F.col("m")
    orders = corpus.evenly(
        corpus.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ).select(
        F.col("o_orderkey").alias("k"),
        corpus.name_part(F.col("o_orderpriority")).alias("p"),
        corpus.steps_of(F.col("o_totalprice")).alias("m"),
        F.concat(F.lit("src/orders/o"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"),
    )
    steps = F.sequence(F.lit(1), m)
    named = lambda c: F.struct(c.alias("name"))
    run = F.concat(F.lit("run_"), k.cast("string"))
    nodes = F.concat(
        F.transform(steps, lambda j: named(F.concat(F.lit("step_"), j.cast("string")))),
        F.array(named(run)),
        F.when(k % 5 == 1, F.array(named(F.concat(F.lit("ghost_"), k.cast("string"))))).otherwise(
            F.array().cast("array<struct<name:string>>")
        ),
    )
    prio = F.concat(F.lit("src/lib/prio_"), F.col("p"), F.lit(".py:1:prio_"), F.col("p"))
    entry = lambda key, value: F.struct(key.alias("key"), value.alias("value"))
    edges = F.concat(
        F.transform(
            steps,
            lambda j: entry(
                F.concat(F.col("path"), F.lit(":"), (4 * j - 2).cast("string"), F.lit(":step_"), j.cast("string")),
                F.array(prio),
            ),
        ),
        F.array(entry(F.concat(F.col("path"), F.lit(":"), (4 * m + 2).cast("string"), F.lit(":"), run), F.array(F.lit("nowhere")))),
        F.when(
            k % 5 == 2,
            F.array(entry(F.concat(F.col("path"), F.lit(":99:ghost")), F.array().cast("array<string>"))),
        ).otherwise(F.array().cast("array<struct<key:string,value:array<string>>>")),
    )
    body = F.struct(nodes.alias("nodes"), F.map_from_entries(edges).alias("edges"))
    return orders.select(F.col("path").alias("project"), F.to_json(body).alias("json"))


def _scored(spark, sf_dir, both: bool = False):
    """Golden and found tables of the order files; ``both`` kinds of golden rows come from texts parsed once."""
    graph = graph_of(spark, sf_dir)
    parsed = gl.parse_texts(_golden_texts(spark, sf_dir))
    golden_nodes, golden_edges = gl.golden_tables(cut(parsed, "golden", "zstd") if both else parsed)
    ours = F.startswith("file", F.lit("src/orders/"))
    nodes = graph.nodes.where(ours).withColumn("project", F.col("file"))
    edges = graph.edges.where(ours).withColumn("project", F.col("file"))
    return golden_nodes, golden_edges, nodes, edges


@query
def golden_nodes(spark, sf_dir):
    return gl.parse_golden(_golden_texts(spark, sf_dir))[0]


@query
def golden_edges(spark, sf_dir):
    return gl.parse_golden(_golden_texts(spark, sf_dir))[1]


@query
def golden_findings(spark, sf_dir):
    """One golden text in seven is left out, and another cut short, so that it can't be read."""
    texts = _golden_texts(spark, sf_dir)
    k = F.regexp_extract("project", r"o(\d+)\.py$", 1).cast("bigint")
    json = F.when(k % 7 == 3, F.left("json", F.length("json") - 1)).otherwise(F.col("json"))
    return sc.golden_findings(texts, texts.where(k % 7 != 0).select("project", json.alias("json")))


@query
def node_count_diff(spark, sf_dir):
    golden_nodes, _, nodes, _ = _scored(spark, sf_dir)
    return sc.node_count_diff(golden_nodes, nodes)


@query
def missing_functions(spark, sf_dir):
    golden_nodes, _, nodes, _ = _scored(spark, sf_dir)
    return sc.missing_functions(golden_nodes, nodes)


@query
def missing_callers(spark, sf_dir):
    _, golden_edges, _, edges = _scored(spark, sf_dir)
    return sc.missing_callers(golden_edges, edges)


@query
def edge_diff(spark, sf_dir):
    _, golden_edges, _, edges = _scored(spark, sf_dir)
    return sc.edge_diff(golden_edges, edges)


@query
def verdict(spark, sf_dir):
    parts = _scored(spark, sf_dir, both=True)
    return sc.verdict(_golden_texts(spark, sf_dir), sc.score(*parts))


@query
def early_verdict(spark, sf_dir):
    """The verdict with what ends a project early: no golden graph that can be read, or no source file."""
    early = golden_findings(spark, sf_dir).unionByName(missing_sources(spark, sf_dir))
    projects = _golden_texts(spark, sf_dir).select("project").unionByName(sf.pick_source_file(_project_files(spark, sf_dir)).select("project"))
    return sc.verdict(projects, sc.score(*_scored(spark, sf_dir, both=True), early=early))


@query
def pick_source_file(spark, sf_dir):
    return sf.pick_source_file(_project_files(spark, sf_dir))


@query
def missing_sources(spark, sf_dir):
    return sf.missing_sources(sf.pick_source_file(_project_files(spark, sf_dir)))


def _project_files(spark, sf_dir):
    """Three customers to a project folder; the file name follows the nation."""
    nation = F.col("c_nationkey")
    name = (
        F.when(nation % 5 == 0, F.lit("main.py"))
        .when(nation % 5 == 1, F.lit("main.rs"))
        .when(nation % 5 == 2, F.lit("main.txt"))
        .otherwise(F.concat(F.lit("util_"), F.col("c_custkey").cast("string"), F.lit(".go")))
    )
    return corpus.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("proj/"), F.floor(F.col("c_custkey") / 3).cast("string"), F.lit("/"), name).alias("path")
    )


@query
def overlay_files(spark, sf_dir):
    base = corpus.document_files(spark, sf_dir)
    key = F.col("doc_id")
    path = F.concat(F.lit("docs/"), key.cast("string"), F.lit(".txt"))
    edits = (
        corpus.table(spark, sf_dir, "documents")
        .select("doc_id")
        .where(key % 4 == 0)
        .select(path.alias("path"), key, F.explode(F.sequence(F.lit(1), F.lit(2))).alias("seq"))
        .select("path", "seq", F.concat(F.lit("edit "), "seq", F.lit(" of "), "doc_id").alias("content"))
    )
    fresh = corpus.table(spark, sf_dir, "documents").select("doc_id").where(key % 50 == 0).select(
        F.concat(F.lit("docs/new_"), key.cast("string"), F.lit(".txt")).alias("path"),
        F.lit(1).alias("seq"),
        F.lit("a new file").alias("content"),
    )
    return sf.overlay_files(base, edits.unionByName(fresh))


@query
def filter_paths(spark, sf_dir):
    return sf.filter_paths(corpus.document_files(spark, sf_dir), ["docs/1", "docs/25"]).select("path")


@query
def filter_paths_by_table(spark, sf_dir):
    prefixes = corpus.table(spark, sf_dir, "nation").select(
        F.concat(F.lit("docs/"), (F.col("n_nationkey") * 7).cast("string")).alias("prefix")
    )
    return sf.filter_paths(corpus.document_files(spark, sf_dir), prefixes).select("path")


@query
def scan_files(spark, sf_dir):
    """Document texts written as text files of 200 texts, scanned back and counted."""
    out = new_folder(spark, "texts")
    texts = corpus.document_files(spark, sf_dir).select("content")
    texts.write.option("maxRecordsPerFile", "200").text(out)
    counts = ln.line_counts(sf.scan_files(spark, out))
    return counts.agg(F.sum("n_lines").alias("n_lines"))


@query
def graph_json(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    nodes = sk.node_records(graph.nodes).select(F.to_json(F.struct("*")).alias("value"))
    edges = sk.edge_records(graph.edges).select(F.to_json(F.struct("*")).alias("value"))
    return nodes.unionByName(edges)


@query
def graph_dot(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return sk.dot_lines(graph.nodes, graph.edges).select("section", "value")


@query
def graph_report(spark, sf_dir):
    graph = graph_of(spark, sf_dir)
    return sk.report_lines(graph.nodes, graph.edges).select("section", "value")
