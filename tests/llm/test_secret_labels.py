"""Labels, counts and added spans of the secret scan against a count by hand."""

import random
import re
from collections import Counter, defaultdict

from spanloom.llm import secret_scan

SCHEMA = "doc_id long, text string, source string, repository string"


def corpus():
    rng = random.Random(2)
    value = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789abcdefghjkmnpqrstuvwxyz") for _ in range(32))
    owners = [f"o{i}" for i in range(30)] + [None]
    spread = {value(): n for n in (1, 2, 3, 6, 7, 12)}  # by owners
    wide = {value(): n for n in (1, 4, 30, 60)}  # by repositories of one owner
    rows = []
    for i, o in enumerate(owners):
        rows += [(len(rows) + k, f"plain text {i} {k}", o, f"r{i}-{k}") for k in range(5)]
    for v, n in spread.items():
        rows += [(1000 + len(rows), f"see {v} here, token = {v[:9]}", owners[k], f"r{k}-0") for k in range(n)]
    for v, n in wide.items():
        rows += [(1000 + len(rows), f"use {v} now", "hot", f"h{k}") for k in range(n)] * 2
    rows += [(5000, None, None, None), (5001, "password: changeme", "o1", None), (None, "password: hunter2", "o1", "r1-0")]
    return rows


def by_hand(rows):
    owners, repositories = defaultdict(set), defaultdict(set)
    for _, text, o, r in rows:
        for _, _, _, a, b in secret_scan.candidates(text or ""):
            owners[text[a:b]].add(o)
            repositories[text[a:b]].add((o, r))
    all_owners, all_pairs = {o for _, _, o, _ in rows}, {(o, r) for _, _, o, r in rows}
    most = max(2, int(0.2 * len(all_owners))), max(4, int(0.2 * len(all_pairs)))
    out = Counter()
    for i, text, _, _ in rows:
        labels, kept, counts = Counter(), [], [(0, 0)]
        for kind, start, end, a, b in secret_scan.candidates(text or ""):
            v = text[a:b]
            n = len(owners[v]), len(repositories[v])
            counts.append(n)
            copied = n[0] > most[0] or n[1] > most[1]
            label = "example" if copied else "live" if secret_scan.looks_random(v) else "weak"
            labels[label] += 1
            if kind < 3 or label == "live":
                kept.append(f"{secret_scan.KINDS[kind]}:{start}:{end}")
        out[i, ",".join(kept), labels["live"], labels["example"], labels["weak"], max(n for n, _ in counts), max(n for _, n in counts)] += 1
    return out, most


def test_labels_follow_owners_and_repositories(spark):
    rows = corpus()
    want, most = by_hand(rows)
    assert most[0] == 6 and most[1] > 30
    names = ["doc_id", "spans", "n_live", "n_example", "n_weak", "n_owners", "n_repositories"]
    out = secret_scan.scan_secrets(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(tuple(r) for r in out.select(names).collect()) == want
    assert sum(k[3] * n for k, n in want.items()) > 60 and sum(k[2] * n for k, n in want.items()) > 30


def test_redaction_follows_the_labels(spark):
    """Values of three owners go, values of many owners or of many repositories of one owner stay."""
    rows = corpus()
    got = {r.doc_id: r.text for r in secret_scan.redact(spark.createDataFrame(rows, SCHEMA)).collect()}
    want, _ = by_hand(rows)
    example = {k[0] for k in want if k[3] and not k[2]}
    live = {k[0] for k in want if k[2]}
    text = {i: t for i, t, _, _ in rows}
    assert all(got[i] == text[i] or "token" in text[i] for i in example if i not in live)
    assert all(secret_scan.REDACTED in got[i] for i in live) and len(live) >= 7
    assert not any(re.search(r"password: hunter2", t or "") for t in got.values()) and got[5001] == "password: changeme"
