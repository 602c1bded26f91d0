"""The answer-driven flow with a small stand-in for a model."""

import json
import re

from spanloom.plans.rounds import asking, call_graph_from_answers, extract_targets
from spanloom.schema import TARGETS

from tests.test_extraction import CLASSES, EXAMPLE


def model(prompts):
    """Finds ``def`` / ``class`` lines by indent, asks for more lines when a body is cut off."""
    out = []
    for prompt in prompts:
        rows = [(int(n), t) for n, t in re.findall(r"^(\d+): (.*)$", prompt, re.M)]
        actions = []
        if "calls this function makes" in prompt:
            for n, text in rows[1:]:
                actions += [{"name": "record_function_call", "input": {"name": c, "file_line": n}} for c in re.findall(r"(\w+)\(", text)]
        else:
            word, field = ("class", "class_name") if "class definition" in prompt else ("def", "function_name")
            for i, (n, text) in enumerate(rows):
                hit = re.match(rf"(\s*){word} (\w+)", text)
                if not hit:
                    continue
                end, closed = n, False
                for m, other in rows[i + 1:]:
                    if other.strip() and len(other) - len(other.lstrip()) <= len(hit[1]):
                        closed = True
                        break
                    end = m if other.strip() else end
                if closed or "LAST" in text or rows[-1][0] >= 60 or rows[-1][0] < 30:
                    actions.append({"name": "found_target", "input": {field: hit[2], "start_line": n, "end_line": end}})
                else:
                    actions.append({"name": "retry_with", "input": {"start": n, "end": rows[-1][0] + 30}})
                    break
        out.append("```json\n" + json.dumps({"actions": actions}) + "\n```")
    return out


def files(spark, *pairs):
    return spark.createDataFrame(list(pairs), "path STRING, content STRING")


def test_class_sample(spark):
    got = extract_targets(files(spark, ("/example.py", CLASSES)), asking(model))
    rows = sorted((r.target_id, r.name, r.start_line, r.end_line, r.parent_id) for r in got.found.collect() if r.parent_id is None)
    assert rows == [("class", "Basket", 13, 20, None), ("function", "report", 8, 10, None), ("function", "total", 4, 5, None)]
    inner = sorted((r.name, r.parent_id) for r in got.found.where("parent_id is not null").collect())
    assert inner == [("add", "/example.py:13:Basket"), ("clear", "/example.py:13:Basket")]
    assert got.open_requests is None and got.quarantine.count() == 0
    stages = {r.stage for r in got.usage.select("stage").distinct().collect()}
    assert stages == {"find_class", "find_function"}


def test_two_files_and_the_graph(spark):
    graph, got = call_graph_from_answers(files(spark, ("main.py", EXAMPLE), ("z.py", "def func_c():\n    other()\n")), asking(model, 2))
    edges = sorted((r.caller_id, r.callee_id, r.line_start) for r in graph.edges.collect())
    assert edges == [
        ("main.py:12:main", "main.py:6:func_b", 14), ("main.py:12:main", "main.py:9:func_a", 13),
        ("main.py:6:func_b", "main.py:3:func_c", 7), ("main.py:9:func_a", "main.py:6:func_b", 10),
    ]
    assert "find_calls" in {r.stage for r in got.usage.select("stage").distinct().collect()}


def test_retry_reads_on(spark):
    body = "\n".join(["x = 1"] * 24 + ["def long():"] + ["    step()"] * 12 + ["y = 2"] * 20)
    source = files(spark, ("long.py", body))
    got = extract_targets(source, asking(model), TARGETS[1:])
    assert [(r.name, r.start_line, r.end_line) for r in got.found.collect()] == [("long", 25, 37)]
    stopped = extract_targets(source, asking(model), TARGETS[1:], max_rounds=1)
    assert stopped.found.count() == 0
    assert [(r.start, r.end) for r in stopped.open_requests.collect()] == [(25, 57)]


def answers(found):
    """One class answer over all prompts that show its first line."""
    def batch(prompts):
        return [json.dumps({"actions": [{"name": "found_target", "input": found}]}) if "class definition" in p and f"\n{found['start_line']}: " in p else "" for p in prompts]
    return asking(batch)


def test_ranges_past_the_file_lose_nothing(spark):
    """A class said to end after the file still has its methods looked for."""
    def batch(prompts):
        out = model(prompts)
        return [o.replace('"end_line": 20', '"end_line": 2147483647') if "class definition" in p else o for p, o in zip(prompts, out)]

    got = extract_targets(files(spark, ("/example.py", CLASSES)), asking(batch))
    assert sorted(r.name for r in got.found.where("parent_id is not null").collect()) == ["add", "clear"]
    assert sorted(r.name for r in got.found.where("parent_id is null").collect()) == ["Basket", "report", "total"]


def test_custom_target_and_unreadable_body(spark):
    from spanloom.schema import Target

    struct = Target("struct", "class definition", "struct_name")
    got = extract_targets(files(spark, ("a.py", "class A:\n    pass\n")), answers({"struct_name": "A", "start_line": 1, "end_line": 2}), (struct,))
    assert [(r.target_id, r.name) for r in got.found.collect()] == [("struct", "A")]

    def bodies(prompts):
        return [json.dumps({"actions": [{"name": "found_target", "input": {"function_name": "f", "start_line": 1, "end_line": 9}}]}) if "function definition" in p else "" for p in prompts]

    _, seen = call_graph_from_answers(files(spark, ("a.py", "def f():\n    g()\n")), asking(bodies))
    assert [(r.reason, r.raw) for r in seen.quarantine.collect()] == [("end_after_last_line", "a.py:1:9")]


def test_each_part_has_its_retry(spark):
    from spanloom.operators import windows as wn

    actions = spark.createDataFrame(
        [("r", p, 0, "retry_with", {"start": str(10 * p + 1), "end": str(10 * p + 5)}) for p in range(2)],
        "request_id STRING, part INT, ordinal INT, name STRING, input MAP<STRING,STRING>",
    )
    requests = spark.createDataFrame([("r", "a.py", "function", 1, 9000, "")], "request_id STRING, path STRING, target_id STRING, start INT, end INT, spec STRING")
    counts = spark.createDataFrame([("a.py", 9000)], "path STRING, n_lines INT")
    assert sorted((r.start, r.end) for r in wn.next_round(actions, requests, counts).collect()) == [(1, 5), (11, 15)]
