"""Cleaning, parsing, routing and checking of answers."""

from pyspark.sql import functions as F

from spanloom.operators import answers as an
from spanloom.schema import FUNCTION, RECORD_CALL, RETRY_WITH, found_action

CATALOG = [found_action(FUNCTION), RETRY_WITH, RECORD_CALL]
F3 = "```"


def clean(spark, *texts):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    return an.clean_answers(spark.createDataFrame(rows, "request_id STRING, raw STRING"))


def cleaned(spark, *texts):
    return [r.clean for r in clean(spark, *texts).orderBy(F.col("request_id").cast("int")).collect()]


def test_clean(spark):
    got = cleaned(
        spark,
        f"{F3}json\n{{}}\n{F3} tail",
        f"a json{F3}[1]{F3} b {F3}json[2]{F3}",
        f"{F3}json {{never closed",
        '{"a": """x""", "b": 0x4e2F, "c": 1} // note',
        '{"u": "http://x//y"} // gone\n{"v": "a\\"//b"}',
        "",
    )
    assert got == [
        "\n{}\n", "[1]", f"{F3}json {{never closed", '{"a": "x", "b": "0x4e2F", "c": 1} ',
        '{"u": "http://x//y"} \n{"v": "a\\"//b"}', "",
    ]


def test_parse_and_quarantine(spark):
    texts = [
        '{"actions": [{"name": "a", "input": {"x": 1, "y": {"z": 2}}}, {"name": "b"}]}',
        '{"actions": []} trailing words', "prose", "[1]", "", '{"k": 1}', '{"actions": []},{"actions": []}',
        '{"actions": 5}', '{"actions": [{"name": "a", "input": {"x": 1}},]}', '{"actions": [{"input": {"x": 1}}]}',
    ]
    table = clean(spark, *texts)
    actions = sorted((r.request_id, r.ordinal, r.name, tuple(sorted(r.input.items()))) for r in an.parse_answers(table).collect())
    assert actions == [
        ("0", 0, "a", (("x", "1"), ("y", '{"z":2}'))), ("0", 1, "b", ()), ("9", 0, None, (("x", "1"),)),
    ]
    assert sorted(r.request_id for r in an.bad_answers(table).collect()) == ["1", "2", "3", "6", "7", "8"]


def test_route_and_check(spark):
    rows = [
        ("1", 0, "found_target", {"function_name": "f", "start_line": "1", "end_line": "2"}),
        ("2", 0, "found_target", {"function_name": "f", "start_line": "1"}),
        ("3", 0, "found_target", {"function_name": "f", "start_line": "one", "end_line": "2"}),
        ("4", 0, "fly", {}), ("5", 0, None, {}),
        ("6", 0, "retry_with", {"start": "1", "end": "2"}),
        ("7", 0, "record_function_call", {"name": "g", "file_line": "4"}),
    ]
    actions = spark.createDataFrame(rows, "request_id STRING, ordinal INT, name STRING, input MAP<STRING,STRING>")
    checked = an.check_required(actions, CATALOG)
    reasons = {r.request_id: r.reason for r in checked.collect()}
    assert reasons == {
        "1": None, "2": "missing_field", "3": "bad_type", "4": "unknown_action", "5": "unknown_action", "6": None, "7": None,
    }
    assert an.good_actions(checked).count() == 3 and an.quarantined(checked).count() == 4


def test_usage(spark):
    log = spark.createDataFrame(
        [("a", "p", 3, 1, 0.5), ("a", "q", 4, 2, 0.25), ("b", "p", 1, 1, 1.0)],
        "stage STRING, path STRING, in_tokens BIGINT, out_tokens BIGINT, time_secs DOUBLE",
    )
    rows = {r.stage: (r.in_tokens, r.out_tokens, r.time_secs, r.n_calls) for r in an.usage_rollup(log).collect()}
    assert rows == {"a": (7, 3, 0.75, 2), "b": (1, 1, 1.0, 1)}
    assert an.usage_rollup(log, ("stage", "path")).count() == 3
