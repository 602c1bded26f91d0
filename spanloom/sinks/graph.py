"""Call graphs as JSON, Graphviz text and a plain report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import graph as gr


def node_records(nodes: DataFrame) -> DataFrame:
    return nodes.select("name", F.struct("file", "line_start", "line_end").alias("loc"))


def edge_records(edges: DataFrame) -> DataFrame:
    loc = F.struct("file", "line_start", "line_end").alias("loc")
    return edges.select("caller_id", "callee_id", F.struct(loc).alias("attributes"))


def write_graph_json(nodes: DataFrame, edges: DataFrame, out: str) -> None:
    """``out/nodes`` and ``out/edges`` as JSON lines with nested ``loc``."""
    node_records(nodes).write.json(f"{out}/nodes")
    edge_records(edges).write.json(f"{out}/edges")


def _fixed(df: DataFrame, section: int, texts: list[str]) -> DataFrame:
    rows = [(section, "", i, text) for i, text in enumerate(texts)]
    return df.sparkSession.createDataFrame(rows, "section INT, file STRING, line INT, value STRING")


def _body(df: DataFrame, section: int, file: str, line: str, value: Column) -> DataFrame:
    return df.select(
        F.lit(section).alias("section"),
        F.col(file).alias("file"),
        F.col(line).cast("int").alias("line"),
        value.alias("value"),
    )


# The texts in the two functions below are the output formats.
def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Graphviz text as rows ``(section, file, line, value)``; these three order the text."""
    quoted = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    label = F.concat(quoted("name"), F.lit("\\n"), quoted("file"), F.lit(":"), F.col("line_start"))
    node = F.concat(F.lit("  "), gr.dot_id(F.col("node_id")), F.lit(' [label="'), label, F.lit('"];'))
    edge = F.concat(
        F.lit("  "), gr.dot_id(F.col("caller_id")), F.lit(" -> "), gr.dot_id(F.col("callee_id")), F.lit(";")
    )
    return (
        _fixed(nodes, 0, ["digraph CallGraph {", "  rankdir=LR;", "  node [shape=box];", ""])
        .unionByName(_body(nodes, 1, "file", "line_start", node))
        .unionByName(_fixed(nodes, 2, [""]))
        .unionByName(_body(edges, 3, "file", "line_start", edge))
        .unionByName(_fixed(nodes, 4, ["}"]))
    )


def report_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The plain report as rows; edges with a missing endpoint are left out of the list."""
    totals = gr.graph_summary(nodes, edges)
    head = totals.select(
        F.posexplode(
            F.array(
                F.lit("Call Graph Summary:"),
                F.format_string("  Nodes (Functions): %d", "n_nodes"),
                F.format_string("  Edges (Calls): %d", "n_edges"),
                F.lit(""),
                F.lit("Functions:"),
            )
        ).alias("line", "value")
    ).select(F.lit(0).alias("section"), F.lit("").alias("file"), "line", "value")
    node = F.format_string("  - %s (%s:%d-%d)", "name", "file", "line_start", "line_end")
    edge = F.format_string("  - %s -> %s (at %s:%d)", "caller_name", "callee_name", "file", "line_start")
    return (
        head.unionByName(_body(nodes, 1, "file", "line_start", node))
        .unionByName(_fixed(nodes, 2, ["", "Function Calls:"]))
        .unionByName(_body(gr.edges_with_endpoints(edges, nodes), 3, "file", "line_start", edge))
    )


def write_lines(rows: DataFrame, out: str, partitions: int | None = None) -> None:
    """Write ordered rows as text; part files in name order give the whole text in order."""
    order = ["section", "file", "line", "value"]
    ranged = rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("value").write.text(out)


def write_graph_dot(nodes: DataFrame, edges: DataFrame, out: str, partitions: int | None = None) -> None:
    write_lines(dot_lines(nodes, edges), out, partitions)


def write_graph_report(nodes: DataFrame, edges: DataFrame, out: str, partitions: int | None = None) -> None:
    write_lines(report_lines(nodes, edges), out, partitions)
