"""Look-ups by name, line counts and dealt rows that grow no faster than the corpus."""

import random

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import extraction as ex
from spanloom.operators import graph as gr
from spanloom.operators import scoring as sc
from spanloom.operators import windows as wn
from spanloom.plans.callgraph import call_graph
from spanloom.session import cut
from spanloom.workload import corpus

from .test_extraction import files


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def rows(df):
    return sorted(map(str, df.collect()))


def _corpus(spark):
    """Few names over many files, some of them twice under one path, and one language without blocks by file."""
    rng = random.Random(11)
    texts = []
    for n in range(80):
        body = "".join(f"def {rng.choice('abcdefgh')}{rng.choice(['', n])}(): {rng.choice('abcxyz')}()\n" for _ in range(rng.randint(1, 9)))
        texts.append((f"r{n % 77}.py", body))
    return files(spark, *texts, ("d.rs", "fn a() { b(); }\nfn zz() { a(); }\n")).repartition(3)


def test_leading_functions_stand_for_all(spark):
    """The first of a name and the number of its functions follow from one function a name and batch."""
    code = cut(ex.code_lines(_corpus(spark), whole=True), "code")
    nodes = gr.build_nodes(ex.span_ends(code, stored=True))
    leading = gr.build_nodes(ex.leading_functions(code, stored=True))
    assert rows(gr.first_by_name(leading)) == rows(gr.first_by_name(nodes))
    assert leading.count() < nodes.count() == leading.agg(F.sum("n_named")).first()[0]
    calls = ex.find_calls(code, stored=True)
    assert rows(gr.name_candidates(calls, leading)) == rows(gr.name_candidates(calls, nodes))
    assert rows(gr.unresolved_calls(calls, leading)) == rows(gr.unresolved_calls(calls, nodes))
    for style in ("indent", "brace"):
        some = gr.build_nodes(ex.span_ends(code, (style,), stored=True))
        assert rows(gr.first_by_name(gr.build_nodes(ex.leading_functions(code, (style,), True)))) == rows(gr.first_by_name(some))


def test_calls_of_hot_names_are_not_shuffled(spark):
    """The same calls with and without a list of hot names, which may be defined nowhere."""
    code = cut(ex.code_lines(_corpus(spark), whole=True), "code")
    nodes, calls = gr.build_nodes(ex.span_ends(code, stored=True)), cut(ex.find_calls(code, stored=True), "calls")
    hot = gr.hot_names(calls, 8)
    names = {r.callee_name for r in hot.collect()}
    counts = dict(calls.groupBy("callee_name").count().collect())
    assert names == {k for k, n in counts.items() if n * 8 > sum(counts.values())} and 0 < len(names) < 8
    assert names & set("xyz") and names & set("abc")
    resolved = gr.resolve_callees(calls, nodes)
    assert rows(gr.resolve_callees(calls, nodes, hot).select(*resolved.columns)) == rows(resolved)
    assert rows(gr.name_candidates(calls, nodes, hot)) == rows(gr.name_candidates(calls, nodes))
    none = calls.where("false")
    assert gr.resolve_callees(none, nodes, gr.hot_names(none)).count() == 0


def test_stored_graph_has_the_edges_of_a_plain_one(spark):
    source = _corpus(spark)
    stored, plain = call_graph(source), call_graph(source, materialize=False)
    assert rows(stored.edges.select(*plain.edges.columns)) == rows(plain.edges) and plain.edges.count() > 100


def test_missing_callers_shuffle_no_callees(spark):
    golden = spark.createDataFrame([("p", "a", "x"), ("p", "a", None), ("p", "b", "x"), ("p", None, "x"), (None, "c", "y"), ("q", "a", "x")], "project STRING, caller_id STRING, callee_id STRING")
    edges = spark.createDataFrame([("p", "a", "z"), ("p", "a", "z"), ("q", "b", "x"), (None, "c", None)], golden.schema)
    found = sc.missing_callers(golden, edges)
    assert rows(found) == rows(sc._missing_callers(sc.edge_flags(golden, edges)))
    assert sorted(str(r.detail) for r in found.collect()) == ["None", "a", "b"]
    assert "callee_id" not in plan(found).split("Union")[0] and plan(found).count("Aggregate") == 1


def test_windows_work_out_line_counts_once(spark):
    """No filter on the line count gets below the dealing out of the rows."""
    texts = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None)], "k INT, t STRING").repartition(2).select(
        F.concat(F.lit("p"), "k").alias("path"), F.concat("t", F.lit("")).alias("content")
    )
    windows = wn.plan_windows(texts.select("path", tx.line_count(F.col("content")).alias("n_lines")))
    assert rows(windows) == ["Row(path='p1', window_id=0, start_line=1, end_line=2)"]
    below = plan(windows).split("Repartition")[1]
    assert "Filter" not in below and "RLIKE" not in below


def test_line_count_of_rare_breaks(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(["a", "é", "\n", "\r", "\r\n", "\x0c", "\u2028", "\x85"], weights=[5, 5, 5, 1, 1, 1, 1, 1], k=rng.randrange(12))) for _ in range(200)]
    texts += ["", "\n", "a", "a\n\n", "ñ\nñ"]
    got = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", tx.line_count(F.col("t")).alias("n")).collect()
    assert all(r.n == len(r.t.splitlines()) for r in got)


def test_rows_of_few_row_groups_are_dealt_out(spark, tmp_path):
    """All rows lie in one row group, in a table with splits enough; repeated rows are spread too."""
    path = str(tmp_path / "t.parquet")
    spark.range(40_000).select(F.lit(7).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in old:
            spark.conf.set(key, "200k")
        table = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert table.rdd.getNumPartitions() >= cores
        share = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert share(corpus.spread(table)) == 40_000
        dealt = corpus.evenly(table)
        assert dealt.columns == ["k", "x"] and dealt.count() == 40_000 and share(dealt) < 2 * 40_000 / cores
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_names_of_priorities_are_made_once_a_priority(spark):
    """The pattern on priorities is not evaluated for each order, not by a filter on the path either."""
    lib = corpus.library_files(spark, "/root/testdata/sf0.001").where(F.endswith("path", F.lit(".py")))
    last = plan(lib).split("src/lib/prio_")[-1]
    assert "regexp_replace" not in last.split("Aggregate")[-1] and lib.where(F.col("path").contains("prio_")).count() == 5
