"""Window planning against the reading loop it replaces."""

import random

from spanloom.operators import windows as wn


def loop(n):
    out, start, end = [], 1, min(30, n)
    while n:
        out.append((start, end))
        if end >= n:
            break
        start, end = end + 1, min(end + 31, n)
    return out


def test_grid_equals_loop(spark):
    counts = spark.createDataFrame([(str(n), n) for n in range(0, 400)], "path STRING, n_lines INT")
    got = {}
    for r in wn.plan_windows(counts).orderBy("path", "window_id").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    for n in range(400):
        assert got.get(str(n), []) == loop(n)


def test_windows_within_cover_the_parent(spark):
    rng = random.Random(3)
    spans = [(f"f{i}", *sorted((rng.randint(1, 200), rng.randint(1, 200)))) for i in range(80)]
    parents = spark.createDataFrame(spans, "path STRING, start_line INT, end_line INT")
    got = {}
    for r in wn.plan_windows_within(parents).orderBy("path", "window_id").collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    for path, start, end in spans:
        lines = [x for a, b in got[path] for x in range(a, b + 1)]
        assert lines == list(range(start, end + 1))


def test_subtract_claimed(spark):
    counts = spark.createDataFrame([("f", 40), ("g", 10)], "path STRING, n_lines INT")
    claimed = spark.createDataFrame(
        [("f", 10, 20), ("f", 33, 34), ("f", 12, 15), ("g", 1, 10)], "path STRING, start_line INT, end_line INT"
    )
    rows = wn.subtract_claimed(wn.plan_windows(counts), claimed).orderBy("path", "start_line").collect()
    assert [(r.path, r.start_line, r.end_line) for r in rows] == [
        ("f", 1, 9), ("f", 21, 30), ("f", 31, 32), ("f", 35, 40),
    ]


def test_subtract_claimed_random(spark):
    rng = random.Random(5)
    counts = [(f"f{i}", rng.randint(1, 150)) for i in range(40)]
    claims = []
    for path, n in counts:
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(1, n)
            claims.append((path, a, min(n, a + rng.randint(0, 40))))
    got = {}
    frame = spark.createDataFrame(claims, "path STRING, start_line INT, end_line INT")
    for r in wn.subtract_claimed(wn.plan_windows(spark.createDataFrame(counts, "path STRING, n_lines INT")), frame).collect():
        got.setdefault(r.path, []).append((r.start_line, r.end_line))
    for path, n in counts:
        taken = {x for p, a, b in claims if p == path for x in range(a, b + 1)}
        want = []
        for a, b in loop(n):
            run = []
            for x in range(a, b + 2):
                if x <= b and x not in taken:
                    run.append(x)
                elif run:
                    want.append((run[0], run[-1]))
                    run = []
        assert sorted(got.get(path, [])) == want


def test_next_round_never_repeats(spark):
    actions = spark.createDataFrame(
        [
            ("q1", 0, "retry_with", {"start": "5", "end": "99"}),
            ("q2", 0, "retry_with", {"start": "1", "end": "3"}),
            ("q2", 1, "retry_with", {"start": "2", "end": "4", "omitted_lines": "3"}),
            ("q3", 0, "found_target", {"start_line": "1"}),
            ("q4", 0, "retry_with", {"start": "50", "end": "60"}),
        ],
        "request_id STRING, ordinal INT, name STRING, input MAP<STRING,STRING>",
    )
    requests = spark.createDataFrame(
        [(q, "f", "function") for q in ("q1", "q2", "q3", "q4")], "request_id STRING, path STRING, target_id STRING"
    )
    counts = spark.createDataFrame([("f", 40)], "path STRING, n_lines INT")
    first = wn.next_round(actions, requests, counts)
    got = sorted((r.start, r.end, r.spec) for r in first.collect())
    assert got == [(2, 4, "3"), (5, 40, "")]
    seen = requests.select("request_id").union(first.select("request_id"))
    assert wn.next_round(actions, requests, counts, seen).count() == 0


def test_a_chain_of_requests_reads_the_texts_once(spark, monkeypatch):
    from spanloom.workload import corpus, queries

    texts = spark.createDataFrame([(k, "\n".join(f"line {i}" for i in range(60))) for k in range(5)], "doc_id BIGINT, text STRING")
    plans = []
    monkeypatch.setattr(corpus, "table", lambda *_: texts)
    whole = queries.wn.next_round
    monkeypatch.setattr(queries.wn, "next_round", lambda a, r, counts, seen: plans.append(counts._jdf.queryExecution().optimizedPlan().toString()) or whole(a, r, counts, seen))
    assert queries.request_chain(spark, "none").count() > 5
    assert len(plans) == 5 and all("text" not in p for p in plans)
