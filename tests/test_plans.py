"""Plan shapes that matter at scale."""

import contextlib
import io
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import graph as gr
from spanloom.operators import lines as ln
from spanloom.operators import windows as wn
from spanloom.plans import ranked
from spanloom.sources import files as sf
from spanloom.workload import corpus, queries as registered

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_hot_name_is_split(spark):
    """A third of all calls go to one name; AQE splits its partition and the result stays whole."""
    old = {k: spark.conf.get(k) for k in (
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "200k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
        name = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("n"), F.col("id") % 5000))
        calls = spark.range(0, 300000, 1, 8).select(
            F.sha2(F.col("id").cast("string"), 256).alias("caller_id"), name.alias("callee_name"),
            F.lit("f").alias("file"), F.lit(1).alias("line_no"),
        )
        nodes = spark.range(5000).select(F.concat(F.lit("n"), "id").alias("name")).union(
            spark.sql("SELECT 'hot'")).selectExpr("name", "name AS node_id", "'f' AS file", "1 AS line_start")
        resolved = gr.resolve_callees(calls, nodes)
        assert resolved.count() == calls.count()
        resolved.write.format("noop").mode("overwrite").save()
        counted = resolved.groupBy("callee_id").count().where("callee_id = 'hot'")
        assert counted.collect()[0]["count"] == 100000
        resolved.collect()
        assert "skew=true" in resolved._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_line_and_window_steps_do_not_shuffle(spark):
    files = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat('d', doc_id) AS path", "text AS content")
    for df in (ln.split_lines(files), wn.plan_windows(ln.line_counts(files))):
        text = plan(df)
        assert "Exchange" not in text and "Python" not in text
    counts = plan(ln.line_counts(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("source AS path", "text AS content")))
    assert re.search(r"ReadSchema: struct<text:string,source:string>", counts)


def test_prefix_filter_is_pushed_down(spark):
    files = spark.read.schema("path STRING, content STRING").parquet(SF + "/documents.parquet")
    assert "StringStartsWith(path,src/)" in plan(sf.filter_paths(files, ["src/"]))


def test_no_cross_join_in_any_query(spark):
    for name, fn in registered.REGISTRY.items():
        text = plan(fn(spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_corpus_files_come_row_by_row(spark):
    assert "Aggregate" not in plan(corpus.order_files(spark, SF))


def test_hot_caller_is_spread(spark):
    """One caller makes a third of all calls: its edges lie in many ranges, the lists stay whole and in order."""
    caller = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("c"), F.col("id") % 2000))
    edges = spark.range(0, 60000, 1, 8).select(
        caller.alias("caller_id"), F.sha2(F.col("id").cast("string"), 256).alias("callee_id"), (F.hash("id") % 500).alias("line_start")
    )
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        parts = ranked.dealt(edges, ["caller_id"], ["line_start", "callee_id"]).groupBy("_part").count().collect()
        assert len(parts) > 20 and max(r["count"] for r in parts) < 2.5 * 60000 / 24
        lists = gr.adjacency(edges, 1000)
        hot = sorted((r.part, list(r.callees)) for r in lists.where("caller_id = 'hot'").collect())
        want = [r.callee_id for r in edges.where("caller_id = 'hot'").orderBy("line_start", "callee_id").collect()]
        assert [c for _, part in hot for c in part] == want and [p for p, _ in hot] == list(range(20))
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_numbers_equal_a_window(spark):
    """Null and hot keys, ties and equal rows."""
    rows = spark.range(0, 5000, 1, 6).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), (F.hash("id") % 20).alias("o"), (F.col("id") % 900).alias("v")
    )
    order = Window.partitionBy("k").orderBy("o", "v")
    want = rows.withColumn("place", F.row_number().over(order).cast("long"))
    got = ranked.numbered(rows, ["k"], ["o", "v"])
    assert got.count() == 5000 and got.exceptAll(want.select(*got.columns)).count() == 0
    assert ranked.numbered(rows.limit(0), ["k"], ["o"]).count() == 0


def test_dot_ids_are_not_joined_to_their_counts(spark):
    ids = ["a.py:1:f", "a.py:1:f", "a-py:1:f", "a_py:1:f", "b.py:2:g", None]
    out = gr.dot_ids(spark.createDataFrame([(i,) for i in ids], "node_id STRING"))
    text = plan(out)
    assert "Join" not in text and len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 2  # one for equal ids, one by DOT id
    assert sorted(map(tuple, out.select("node_id", "dot_id", "n_sharing").collect())) == [
        ("a-py:1:f", "a_py_1_f", 3), ("a.py:1:f", "a_py_1_f", 3), ("a_py:1:f", "a_py_1_f", 3), ("b.py:2:g", "b_py_2_g", 1),
    ]


def test_lists_are_moved_once(spark):
    """Calls with null callers and equal rows; the same lists whether callers count as hot or not."""
    edges = spark.range(0, 3000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 > 0, F.concat(F.lit("c"), F.col("id") % 40)).alias("caller_id"),
        F.when(F.col("id") % 7 > 0, F.concat(F.lit("f"), F.col("id") % 5)).alias("callee_id"), (F.hash("id") % 20).alias("line_start"),
    )
    met, spread = gr.adjacency(edges, 16), gr.adjacency(edges, 16, least=100)
    assert len(re.findall(r"^\(\d+\) Exchange", plan(met), re.M)) == 1
    rows = [sorted(df.collect(), key=str) for df in (met, spread)]
    assert rows[0] == rows[1]
    for caller in (None, "hot", "c7"):
        mine = edges.where(F.col("caller_id").eqNullSafe(F.lit(caller))).orderBy("line_start", "callee_id").collect()
        lists = sorted((r.part, r.callees) for r in rows[0] if r.caller_id == caller)
        assert [c for _, part in lists for c in part] == [r.callee_id for r in mine]
        assert [(p, len(part)) for p, part in lists] == [(i, min(16, len(mine) - 16 * i)) for i in range((len(mine) + 15) // 16)]


def test_names_of_endpoints_are_moved_once(spark):
    """Repeated and missing ids, a hot callee; the same edges whether a caller counts as hot or not."""
    ids = [f"f{i}" for i in range(40)] + ["f1", "f2", None]
    nodes = spark.createDataFrame([(k, None if k == "f3" else f"{k}_{i}") for i, k in enumerate(ids)], "node_id STRING, name STRING")
    edges = spark.range(0, 900, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "f1").when(F.col("id") % 20 > 0, F.concat(F.lit("f"), F.hash("id") % 50)).alias("caller_id"),
        F.when(F.col("id") % 2 == 0, "f2").when(F.col("id") % 9 > 0, F.concat(F.lit("f"), F.col("id") % 700)).alias("callee_id"),
        F.lit("a.py").alias("file"), F.col("id").cast("int").alias("line_start"),
    )
    names = {}
    for row in nodes.collect():
        names[row.node_id] = min([n for n in (row["name"], names.get(row.node_id)) if n], default=None)
    names.pop(None)
    want = sorted((*e, names[e.caller_id], names[e.callee_id]) for e in edges.collect() if e.caller_id in names and e.callee_id in names)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for least in (1 << 20, 50):
            out = gr.edges_with_endpoints(edges, nodes, least)
            assert len(re.findall(r"^\(\d+\) Exchange", plan(out), re.M)) == (4 if least > 50 else 9)
            assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str) and out.columns[-2:] == ["caller_name", "callee_name"]
            assert "ReusedExchange" in plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
