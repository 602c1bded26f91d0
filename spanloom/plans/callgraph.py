"""Flow A: files to call graph by line rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extraction as ex
from ..operators import graph as gr
from ..session import cut


@dataclass
class CallGraph:
    """The tables of one graph; a multigraph, so edges are never made distinct.

    ``leading`` holds the nodes that may be the first of their name, where they are known.
    """

    found: DataFrame
    nodes: DataFrame
    calls: DataFrame
    edges: DataFrame
    leading: DataFrame | None = None


def call_graph(
    files: DataFrame,
    styles: tuple[str, ...] = ("indent", "brace"),
    materialize: bool = True,
    innermost: bool = False,
) -> CallGraph:
    """Definitions, nodes, calls and edges of a corpus.

    The text is read once: with ``materialize`` the code rows (no text), the definitions and the
    edges are written to the shared folder, and every reader takes only its columns from there.
    Without it each branch derives the rows again, which suits a single small output.
    """
    code = ex.code_lines(files, whole="indent" in styles)
    if not materialize:
        return graph_from(code, ex.span_ends(code, styles), innermost)
    code = cut(code, "code")
    found = cut(ex.span_ends(code, styles, stored=True), "found")
    graph = graph_from(code, found, innermost, stored=True, styles=styles)
    graph.edges = cut(stored_edges(graph), "edges")
    return graph


def graph_from(
    code: DataFrame, found: DataFrame, innermost: bool = False, stored: bool = False, styles: tuple[str, ...] = ("indent", "brace")
) -> CallGraph:
    """The graph over code rows and the definitions found in them; ``stored``: ``code`` is a written table.

    For look-ups by name only the functions that may be the first of their name are compared then.
    """
    nodes = gr.build_nodes(found)
    calls = ex.find_calls(code, innermost=innermost, stored=stored)
    leading = gr.build_nodes(ex.leading_functions(code, styles, stored)) if stored else nodes
    return CallGraph(found, nodes, calls, gr.build_edges(gr.resolve_callees(calls, leading)), leading)


def stored_edges(graph: CallGraph) -> DataFrame:
    """The edges of a graph over a written table, whose calls are cheap to count: those of hot names are not shuffled."""
    return gr.build_edges(gr.resolve_callees(graph.calls, graph.leading, gr.hot_names(graph.calls)))


def most_called(graph: CallGraph) -> DataFrame:
    """Edges per callee: ``(callee_id, n_calls)``."""
    return graph.edges.groupBy("callee_id").agg(F.count(F.lit(1)).alias("n_calls"))
