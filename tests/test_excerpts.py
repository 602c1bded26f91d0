"""Excerpts cut in place, the identity of requests, durable asking, mapped fields."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import answers as an
from spanloom.operators import extraction as ex
from spanloom.operators import lines as ln
from spanloom.operators import windows as wn
from spanloom.plans.rounds import asking, call_graph_from_answers
from spanloom.schema import CLASS, FUNCTION, TARGETS, Target
from spanloom.session import keyed_store
from tests.test_plans import plan

SF = "/root/testdata/sf0.001"


def some_files(spark, rng):
    rows = [(f"f{i}", "".join(rng.choice(["a", "", "bb", "é"]) + rng.choice(["\n", "\r\n", "\x0c"]) for _ in range(rng.randrange(0, 60)))) for i in range(20)]
    return spark.createDataFrame([*rows, ("empty", ""), ("open", "x\ny")], "path STRING, content STRING")


def some_requests(spark, rng, n=400):
    rows = []
    for i in range(n):
        start = rng.randrange(1, 40)
        spec = ",".join(rng.choice(["{0}", "{0}-{1}", " {0} - {1}", "+{0}", "x", "{1}-{0}"]).format(a := rng.randrange(0, 50), a + rng.randrange(0, 9)) for _ in range(rng.choice([0, 0, 1, 3, 6])))
        rows.append((str(i), f"f{rng.randrange(22)}", start, start + rng.randrange(-2, 25), rng.choice([spec, spec, None])))
    return spark.createDataFrame(rows, "request_id STRING, path STRING, start INT, end INT, spec STRING")


@pytest.mark.parametrize("numbered,part", [(True, 4096), (False, 4)])
def test_cut_in_place_gives_the_same_excerpts(spark, numbered, part):
    rng = random.Random(part)
    files = some_files(spark, rng)
    requests = ln.check_requests(some_requests(spark, rng), ln.line_counts(files)).cache()
    want = ln.render_excerpts(ln.collapse_omissions(ln.slice_lines(ln.split_lines(files), requests), requests), numbered, part)
    got = ln.cut_excerpts(files, requests, numbered, part)
    rows = lambda df: sorted(tuple(r) for r in df.select("request_id", "path", "part", "excerpt").collect())
    assert rows(got) == rows(want) and got.count() > 100


def test_specs_of_one_key_leave_one_excerpt(spark):
    """Over random specs: equal keys mean equal excerpts; the usual spellings are one."""
    rng = random.Random(8)
    files = spark.createDataFrame([("f", "\n".join(f"l{i}" for i in range(1, 13)))], "path STRING, content STRING")
    specs = ["", "2", "2,2", " 2", "2-2", "+2", "2-3,4", "2-4", "3,2,4", "x,2-4", "0", "0-1", "1", "12-40", "12-13", "13", "9-99999999999"]
    specs += [",".join(f"{(a := rng.randrange(0, 15))}-{a + rng.randrange(0, 4)}" for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    rows = spark.createDataFrame([(str(i), "f", 2, 11, s) for i, s in enumerate(specs)], "request_id STRING, path STRING, start INT, end INT, spec STRING")
    keyed = rows.withColumn("key", ln.omission_key(F.col("spec"), F.col("start"), F.col("end")))
    excerpts = {r.request_id: r.excerpt for r in ln.cut_excerpts(files, rows).collect()}
    by_key = {}
    for r in keyed.collect():
        by_key.setdefault(r.key, set()).add(excerpts.get(r.request_id))
    assert all(len(x) == 1 for x in by_key.values()) and len(by_key) > 60
    key = {r.spec: r.key for r in keyed.collect()}
    assert key["2"] == key["2,2"] == key[" 2"] == key["2-2"] == key["+2"] == "2"
    assert key["2-3,4"] == key["2-4"] == key["3,2,4"] == key["x,2-4"] == "2-4"
    assert key["0"] == key["13"] == key["12-13"] == key["9-99999999999"] == ""


def test_first_prompts_move_no_text(spark):
    files = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat('d', doc_id) AS path", "text AS content")
    text = plan(wn.window_prompts(files, (CLASS, FUNCTION), lambda t: []))
    assert "Exchange" not in text and "Join" not in text


def test_stored_files_stay_where_they_are(spark):
    """Only the requests of a round are shuffled, also when they are too many to broadcast."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        files = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("concat('d', doc_id) AS path", "text AS content")
        stored = keyed_store(files, "path", "files")
        requests = files.selectExpr("path AS request_id", "path", "1 AS start", "3 AS end", "'' AS spec")
        text = plan(ln.cut_excerpts(stored, requests))
        moved = re.findall(r"\(\d+\) Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", text)
        assert moved and not any("content" in m or "excerpt" in m for m in moved)
        assert ln.cut_excerpts(stored, requests).count() == ln.cut_excerpts(files, requests).count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def prompts_of(spark, n=80):
    return spark.range(n).selectExpr("sha2(cast(id AS string), 256) AS prompt_key", "concat('p', id) AS prompt")


def test_a_failing_batch_loses_only_itself(spark, tmp_path):
    prompts, path = prompts_of(spark), str(tmp_path / "log")

    def failing(batch):
        if "p7" in batch:
            raise RuntimeError("down")
        return [p.upper() for p in batch]

    first = {r.prompt_key: r for r in ex.ask_log(prompts, failing, path, parallelism=8).collect()}
    lost = {k for k, r in first.items() if r.raw is None}
    assert len(first) == 80 and 0 < len(lost) <= 20 and all("down" in first[k].error for k in lost)

    asked = spark.sparkContext.accumulator(0)

    def counting(batch):
        asked.add(len(batch))
        return [p.upper() for p in batch]

    second = ex.ask_log(prompts, counting, path, parallelism=8, turns=3).collect()
    assert sorted(r.raw for r in second) == sorted(f"P{i}" for i in range(80)) and asked.value == len(lost)
    ex.ask_log(prompts, counting, path).collect()
    assert asked.value == len(lost)
    wrong = ex.extract_with(prompts, lambda batch: batch[:-1]).collect()
    assert len(wrong) == 80 and all(r.raw is None and "answers to" in r.error for r in wrong)


def test_default_parallelism_survives(spark):
    asked = ex.extract_with(prompts_of(spark, 400), lambda batch: [str(len(batch))] * len(batch), batch_size=1000)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    parts = asked.withColumn("part", F.spark_partition_id()).select("part").distinct().count()
    assert parts == spark.sparkContext.defaultParallelism


def test_failed_questions_are_quarantined(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    g()\n")], "path STRING, content STRING")

    def batch(prompts):
        raise RuntimeError("no model")

    _, got = call_graph_from_answers(files, asking(batch))
    assert {(r.reason, r.raw) for r in got.quarantine.collect()} == {("no_answer", "RuntimeError: no model")}
    assert got.found.count() == 0


def test_mapped_fields_reach_the_nodes(spark):
    routine = Target("function", "routine", "title", mapping=(("start_line", "first"), ("end_line", "last"), ("file", "where"), ("scope", "visible")))

    def batch(prompts):
        answer = {"title": "f", "first": 1, "last": 2, "where": "b.py", "visible": "public"}
        return [json.dumps({"actions": [{"name": "found_target", "input": answer}]}) if "routine" in p else "" for p in prompts]

    files = spark.createDataFrame([("a.py", "def f():\n    g()\n")], "path STRING, content STRING")
    graph, got = call_graph_from_answers(files, asking(batch), targets=(routine,))
    rows = [(r.node_id, r.file, r.line_start, r.line_end, r.fields) for r in graph.nodes.collect()]
    assert rows == [("a.py:1:f", "b.py", 1, 2, {"scope": "public"})]
    assert set(an.answers_to_found(spark.createDataFrame([], "request_id STRING, name STRING, input MAP<STRING,STRING>"), spark.createDataFrame([], "request_id STRING, path STRING, target_id STRING"), TARGETS).columns) == {
        "path", "target_id", "name", "start_line", "end_line", "parent_id", "file",
    }
