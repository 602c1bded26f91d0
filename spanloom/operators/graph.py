"""Nodes, callee resolution, edges and views of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.lookup import HOT_ROWS, bucket_of, dealt_by, hot_buckets, join_lookup
from ..plans.ranked import numbered
from ..session import cut

LIST_CALLS = 4096
HOT_PARTS = 256


def build_nodes(found: DataFrame) -> DataFrame:
    """Functions -> ``nodes``; ``node_id = file:line_start:name``.

    Mapped ``fields`` of answers and the number ``n_named`` of functions a row stands for are carried on.
    """
    return found.where(F.col("target_id") == "function").select(
        tx.node_id(F.col("path"), F.col("start_line"), F.col("name")).alias("node_id"),
        "name",
        (F.coalesce("file", "path") if "file" in found.columns else F.col("path")).alias("file"),
        F.col("start_line").alias("line_start"),
        F.col("end_line").alias("line_end"),
        *[c for c in found.columns if c in ("fields", "n_named")],
    )


def first_by_name(nodes: DataFrame) -> DataFrame:
    """The node a name stands for: the first in (file, line) order. Combined map-side."""
    first = F.min(F.struct("file", "line_start", "node_id"))
    return nodes.groupBy("name").agg(first["node_id"].alias("callee_id"))


def hot_names(calls: DataFrame, parts: int = HOT_PARTS) -> DataFrame:
    """Names with more than one in ``parts`` of all calls."""
    return _hot_keys(calls, "callee_name", parts)


def _hot_keys(rows: DataFrame, key: str, parts: int = HOT_PARTS) -> DataFrame:
    """Keys with more than one in ``parts`` of all rows, so fewer than ``parts`` of them; written, as several joins read them.

    Rows are counted per key in each task first.
    """
    counted = cut(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "counts")
    total = counted.agg(F.sum("n").alias("total"))
    return cut(counted.join(F.broadcast(total), F.col("n") * parts > F.col("total")).select(key), "hot")


def resolve_callees(calls: DataFrame, nodes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Calls with the node their name stands for; a call without one is dropped.

    Calls of the few ``hot`` names (``hot_names``) meet a copy of their nodes in each task, and are neither shuffled nor sorted.
    """
    index = first_by_name(nodes).withColumnRenamed("name", "callee_name")
    return _look_up(calls, index, hot)


def _look_up(calls: DataFrame, index: DataFrame, hot: DataFrame | None, how: str = "inner", key: str = "callee_name", met: bool = False) -> DataFrame:
    """``calls`` with their row of ``index``; ``met``: the index lies by key already, and is not shuffled again."""
    join = (lambda left, right: left.join(right, key, how).select(*left.columns, *[c for c in right.columns if c != key])) if met else (
        lambda left, right: join_lookup(left, right, key, how)
    )
    if hot is None:
        return join(calls, index)
    # a proven bound: there are fewer hot names than HOT_PARTS, and one row of the index for each
    few = F.broadcast(hot)
    known = F.broadcast(cut(index.join(few, key, "left_semi"), "hot"))
    often = calls if how == "inner" else calls.join(few, key, "left_semi")
    seldom = join(calls.join(few, key, "left_anti"), index)
    return often.join(known, key, how).select(*seldom.columns).unionByName(seldom)


def unresolved_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names called without a definition anywhere: ``(callee_name, n_calls)``.

    Calls are counted per name before the anti-join, so a hot name crosses it once.
    """
    counted = calls.groupBy("callee_name").agg(F.count(F.lit(1)).alias("n_calls"))
    names = nodes.select(F.col("name").alias("callee_name")).distinct()
    return counted.join(names, "callee_name", "left_anti")


def name_candidates(calls: DataFrame, nodes: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Calls with the number of same-named nodes and ``none`` / ``unique`` / ``ambiguous``; a node may stand for ``n_named``."""
    n = F.sum(F.col("n_named").cast("bigint")) if "n_named" in nodes.columns else F.count(F.lit(1))
    counted = nodes.groupBy(F.col("name").alias("callee_name")).agg(
        n.alias("n_candidates"), F.min("node_id").alias("only_id")
    )
    many = F.coalesce("n_candidates", F.lit(0).cast("bigint"))
    return _look_up(calls, counted, hot, "left").select(
        *calls.columns,
        many.alias("n_candidates"),
        F.when(many == 0, "none").when(many == 1, "unique").otherwise("ambiguous").alias("status"),
        F.when(many == 1, F.col("only_id")).alias("candidate_id"),
    )


def build_edges(resolved: DataFrame) -> DataFrame:
    """One edge per call site, located at the call; repeats and self-calls stay."""
    return resolved.select(
        "caller_id",
        "callee_id",
        "file",
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
    )


def edges_with_endpoints(edges: DataFrame, nodes: DataFrame, least: int = HOT_ROWS) -> DataFrame:
    """Edges with both names; an edge with a missing endpoint is skipped. ``edges`` are read several times.

    Names are shuffled once for both look-ups. Edges to the few hot callees meet a copy of their names in each task, the
    others are shuffled by callee; then all are shuffled by caller. Those of hot callers (``hot_buckets``) meet fresh
    shuffles of their names, so that AQE can split a caller with most of the edges.
    """
    few, n = hot_buckets(edges, "caller_id", least=least)
    hot = bucket_of("caller_id").isin(few)
    names = nodes.select("node_id", "name").repartition(n, "node_id").groupBy("node_id").agg(F.min("name").alias("name"))
    callers = names.select(F.col("node_id").alias("caller_id"), F.col("name").alias("caller_name"))
    callees = names.select(F.col("node_id").alias("callee_id"), F.col("name").alias("callee_name"))
    ended = _look_up(edges, callees, _hot_keys(edges, "callee_id"), key="callee_id", met=True)
    begun = _look_up(ended.where(~hot) if few else ended, callers, None, key="caller_id", met=True)
    if few:
        begun = begun.unionByName(join_lookup(ended.where(hot), callers, "caller_id"))
    return begun.select(*edges.columns, "caller_name", "callee_name")


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``(n_nodes, n_edges)``; rows are counted map-side."""
    flags = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(
        edges.select(F.lit(0).alias("n"), F.lit(1).alias("e"))
    )
    return flags.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_nodes"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("n_edges"),
    )


def dot_id(col):
    """Fixed mapping of ``: / . -`` to ``_``."""
    return F.translate(col, ":/.-", "____")


def dot_ids(nodes: DataFrame) -> DataFrame:
    """``(node_id, dot_id, n_sharing)``: how many node ids fall on the same DOT id.

    Distinct ids are counted where they lie, after one shuffle by DOT id; ids are never joined to their counts.
    """
    ids = nodes.select("node_id").distinct().withColumn("dot_id", dot_id(F.col("node_id")))
    return ids.where(F.col("dot_id").isNotNull()).withColumn("n_sharing", F.count(F.lit(1)).over(Window.partitionBy("dot_id")))


def dot_id_collisions(nodes: DataFrame) -> DataFrame:
    """Number of DOT ids that stand for more than one node id."""
    ids = nodes.select("node_id").distinct().groupBy(dot_id(F.col("node_id")).alias("dot_id"))
    return ids.count().agg(F.count_if(F.col("count") > 1).alias("n_collisions"))


def adjacency(edges: DataFrame, list_calls: int = LIST_CALLS, least: int = HOT_ROWS) -> DataFrame:
    """Callees per caller in call order: ``(caller_id, part, callees)``; ``edges`` are read twice.

    A list holds at most ``list_calls`` calls; longer ones go on in further parts. All calls of a caller meet in
    one task, after one shuffle. Calls of the few hot callers (``hot_buckets``) are numbered by ranges, so a caller with
    most of the edges is spread over many tasks.
    """
    calls = edges.select("caller_id", "line_start", "callee_id")
    few, n = hot_buckets(calls, "caller_id", least=least)
    if not few:
        return _lists(_met_calls(calls, n), list_calls)
    hot = bucket_of("caller_id").isin(few)
    spread = numbered(calls.where(hot), ["caller_id"], ["line_start", "callee_id"])
    return _lists(_met_calls(calls.where(~hot), n), list_calls).unionByName(_lists(spread, list_calls))


def _met_calls(calls: DataFrame, n: int) -> DataFrame:
    """Calls with their ``place`` 1, 2, ... among those of their caller."""
    inside = Window.partitionBy("_h", "caller_id").orderBy("line_start", "callee_id")
    return dealt_by(calls, n, "caller_id").withColumn("place", F.row_number().over(inside))


def _lists(placed: DataFrame, list_calls: int) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "callee_id"))), lambda x: x["callee_id"])
    part = F.floor((F.col("place") - 1) / F.lit(list_calls)).cast("int").alias("part")
    return placed.groupBy("caller_id", part).agg(listed.alias("callees"))
