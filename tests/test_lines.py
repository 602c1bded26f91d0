"""Line operators against small plain-Python models."""

import random

from pyspark.sql import functions as F

from spanloom.operators import lines as ln

BREAKS = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", chr(0x2028), chr(0x2029)]


def texts(seed, n):
    rng = random.Random(seed)
    out = ["", "a", "\n", "a\n", "\n\n", "a\r\nb", "a\r\n", "\r\n", "x\x85"]
    for _ in range(n):
        out.append("".join(rng.choice(BREAKS + ["a", "bc", " ", "é"]) for _ in range(rng.randint(0, 14))))
    return out


def test_split_and_count_match_splitlines(spark):
    cases = [(f"f{i}", t) for i, t in enumerate(texts(1, 300))]
    files = spark.createDataFrame(cases, "path STRING, content STRING")
    got = {}
    for row in ln.split_lines(files).collect():
        got.setdefault(row.path, {})[row.line_no] = row.text
    counts = {r.path: r.n_lines for r in ln.line_counts(files).collect()}
    for path, content in cases:
        want = content.splitlines()
        assert [got.get(path, {}).get(i + 1) for i in range(len(want))] == want
        assert len(got.get(path, {})) == len(want)
        assert counts[path] == len(want)


def collapsed(spark, n, spec, start=1, end=None):
    lines = spark.createDataFrame([("f", i, f"L{i}") for i in range(1, n + 1)], "path STRING, line_no INT, text STRING")
    requests = spark.createDataFrame(
        [("r", "f", start, end or n, spec)], "request_id STRING, path STRING, start INT, end INT, spec STRING"
    )
    rows = ln.collapse_omissions(ln.slice_lines(lines, requests), requests).orderBy("pos").collect()
    return [r.text if r.line_no == -1 else r.line_no for r in rows]


def test_omission_fixtures(spark):
    assert collapsed(spark, 5, "") == [1, 2, 3, 4, 5]
    assert collapsed(spark, 5, "3") == [1, 2, "[omitted lines: 3]", 4, 5]
    assert collapsed(spark, 6, "2-4") == [1, "[omitted lines: 2-4]", 5, 6]
    assert collapsed(spark, 10, "2,4-5,8") == [
        1, "[omitted lines: 2]", 3, "[omitted lines: 4-5]", 6, 7, "[omitted lines: 8]", 9, 10,
    ]
    assert collapsed(spark, 5, "1,5") == ["[omitted lines: 1]", 2, 3, 4, "[omitted lines: 5]"]


def test_runs_merge_and_reach_over_the_edges(spark):
    assert collapsed(spark, 6, "3-4,5") == [1, 2, "[omitted lines: 3-5]", 6]
    assert collapsed(spark, 6, "5-9") == [1, 2, 3, 4]
    assert collapsed(spark, 9, "1-4,8", 3, 9) == ["[omitted lines: 1-4]", 5, 6, 7, "[omitted lines: 8]", 9]
    assert collapsed(spark, 9, "1-2,6", 4, 9) == [4, 5, "[omitted lines: 6]", 7, 8, 9]


def model(n, omitted, start, end):
    """Independent of the table version: walk the lines, close a run at its last line."""
    out = []
    for i in range(start, end + 1):
        if i not in omitted:
            out.append(i)
        elif i + 1 not in omitted:
            first = i
            while first - 1 in omitted:
                first -= 1
            out.append(f"[omitted lines: {first}]" if first == i else f"[omitted lines: {first}-{i}]")
    return out


def test_random_omissions(spark):
    rng = random.Random(7)
    cases, wants = [], {}
    for i in range(60):
        spec = ",".join(
            str(rng.randint(1, 90)) if rng.random() < 0.5 else "{}-{}".format(*sorted((rng.randint(1, 90), rng.randint(1, 90))))
            for _ in range(rng.randint(1, 5))
        )
        start = rng.randint(1, 80)
        end = rng.randint(start, 90)
        omitted = set()
        for token in spec.split(","):
            a, _, b = token.partition("-")
            omitted |= set(range(int(a), int(b or a) + 1))
        cases.append((f"r{i}", "f", start, end, spec))
        wants[f"r{i}"] = (model(90, omitted, start, end), omitted)
    lines = spark.createDataFrame([("f", i, f"L{i}") for i in range(1, 91)], "path STRING, line_no INT, text STRING")
    requests = spark.createDataFrame(cases, "request_id STRING, path STRING, start INT, end INT, spec STRING")
    got = {}
    for r in ln.collapse_omissions(ln.slice_lines(lines, requests), requests).orderBy("pos").collect():
        got.setdefault(r.request_id, []).append(r.text if r.line_no == -1 else r.line_no)
    expanded = {}
    for r in ln.expand_omissions(requests).collect():
        expanded.setdefault(r.request_id, set()).add(r.line_no)
    for key, (want, omitted) in wants.items():
        assert got.get(key, []) == want
        assert expanded[key] == omitted


def test_bad_tokens_and_bad_ranges(spark):
    requests = spark.createDataFrame(
        [("a", "2-4,6,x"), ("b", "5-3"), ("c", ""), ("d", "1-2-3,,-5"), ("e", "99999999999")], "request_id STRING, spec STRING"
    )
    assert {r.line_no for r in ln.expand_omissions(requests).where("request_id = 'a'").collect()} == {2, 3, 4, 6}
    assert ln.expand_omissions(requests).where("request_id in ('b', 'c')").count() == 0
    bad = sorted((r.request_id, r.raw) for r in ln.bad_omissions(requests).collect())
    assert bad == [("a", "x"), ("d", ""), ("d", "-5"), ("d", "1-2-3"), ("e", "99999999999")]


def test_requests_are_checked(spark):
    counts = spark.createDataFrame([("f", 10)], "path STRING, n_lines INT")
    requests = spark.createDataFrame(
        [("ok", "f", 1, 10), ("empty", "f", 5, 4), ("low", "f", 0, 3), ("high", "f", 9, 11), ("gone", "g", 1, 2)],
        "request_id STRING, path STRING, start INT, end INT",
    )
    errors = {r.request_id: r.error for r in ln.check_requests(requests, counts).collect()}
    assert errors == {
        "ok": None, "empty": None, "low": "start_before_first_line", "high": "end_after_last_line", "gone": "no_such_file",
    }


def test_long_excerpts_continue_in_parts(spark):
    lines = spark.range(1, 101).select(
        F.lit("f").alias("path"), F.col("id").cast("int").alias("line_no"), F.concat(F.lit("t"), "id").alias("text")
    )
    requests = spark.createDataFrame([("r", "f", 11, 95)], "request_id STRING, path STRING, start INT, end INT")
    rows = ln.render_excerpts(ln.slice_lines(lines, requests), part_lines=20).orderBy("part").collect()
    assert len(rows) == 5
    assert "\n".join(r.excerpt for r in rows) == "\n".join(f"{i}: t{i}" for i in range(11, 96))
    plain = ln.render_excerpts(ln.slice_lines(lines, requests), numbered=False).collect()[0].excerpt
    assert plain == "\n".join(f"t{i}" for i in range(11, 96))


def test_omissions_cut_to_the_file(spark):
    requests = spark.createDataFrame([("r", "3-2147483647,1", 5), ("s", "65530-65540", 70000), ("t", "9", 5)], "request_id STRING, spec STRING, n INT")
    got = sorted((r.request_id, r.line_no) for r in ln.expand_omissions(requests, "n").collect())
    assert got == [("r", n) for n in (1, 3, 4, 5)] + [("s", n) for n in range(65530, 65541)]
    assert ln.expand_omissions(requests.where("request_id = 's'")).count() == 11
