"""Operators 11 to 13 against brute force: nulls, ties, repeats, long and empty texts, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from spanloom.llm import conversation_trie, filter_audit, token_counts
from spanloom.llm.queries import PIECES

from .helpers import empty, frame, sample

LABELS = "doc_id long, quality int, toxic int"
TURNS = "conv_id long, turn long, role string, text string"


def labels(spark):
    rows = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 0, 1), (None, 1, 1), (99999, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, LABELS)


# --- 11


def audit_rows():
    rows = sample()
    texts = [t or "" for _, t, *_ in rows]
    rows += [(2000, "X" * 40 + " $", "en", "s1", 0), (None, texts[3], "en", "s1", 0), (1, texts[3], "en", "only here", 0)]
    rows += [(2001 + k, " ".join(["same"] * 60), "en", "s2", 0) for k in range(3)]
    return rows


def brute_audit(rows, rated):
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    docs = [(i, t or "", s or "") for i, t, _, s, _ in rows]
    least = defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            least[t].append(i)
    good = {i for i, q, _ in rated if q == 1}
    toxic = {i for i, _, x in rated if x == 1}
    fails = []
    for i, t, s in docs:
        w = words(t)
        f = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and any(j < i for j in least[t]),
        }
        fails.append((s, {x for x in f if f[x]}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for part in {s for s, *_ in fails}:
        own = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            live = own
            for step, now in enumerate(order, 1):
                gone = [f for f in live if now in f[1]]
                before = [f for f in own if now in f[1] and f[1] & set(order[: step - 1])]
                live = [f for f in live if now not in f[1]]
                out[part, order, step] = [len(live), len(gone), len(before), sum(f[1] == {now} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)]
                shapley[part, now] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rows, rated = audit_rows(), [tuple(r) for r in labels(spark).collect()]
    out = filter_audit.audit(frame(spark, rows), labels(spark))
    got = {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in out.collect()}
    want = brute_audit(rows, rated)
    assert got == want and len(got) == 600 * len({k[0] for k in want})
    assert any(v[6] for v in got.values()) and any(v[2] for v in got.values()) and any(v[5] for v in got.values())


def test_audit_without_rows_or_labels(spark):
    assert filter_audit.audit(empty(spark), labels(spark)).count() == 0
    out = filter_audit.audit(frame(spark), spark.createDataFrame([], LABELS))
    assert out.filter("good_lost + toxic_lost > 0").count() == 0 and out.count() % 600 == 0


def test_contraction_is_exact_for_large_counts():
    counts = np.full((1, 3, 2, 2, 2, 2, 2), 2**53 + 1, np.int64)
    found = filter_audit.audit_steps(counts)
    assert found["kept"][0, 4] == 2**53 + 1 and found["removed"][0, 0] == 16 * (2**53 + 1)


# --- 12


def test_token_counts_equal_the_library(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "the", " of", "1", "23", "é", "漢", "▁", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", " ", "𝔘", "ﬁ", "\r\n", "==", "   "]
    rows = sample() + [(9000 + k, "".join(rng.choice(parts) for _ in range(rng.randrange(30))), "en", "s", 0) for k in range(400)]
    rows += [(9500, "a" * 20_000, "en", "s", 0), (9501, " " * 3000, "en", "s", 0), (9502, "▁", None, None, None), (9503, "x y " * 4000, "en", "s", 0)]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for size in (1 << 15, 3):
        got = Counter(tuple(r) for r in token_counts.count_tokens(frame(spark, rows), PIECES, size=size).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
        counts = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, *_ in rows]
        assert got == Counter((*c, c[2] > 4096) for c in counts)
    assert token_counts.count_tokens(empty(spark), PIECES).count() == 0


def test_summary_holds_every_frequent_word(spark):
    words = ["hot"] * 4000 + [f"w{k}" for k in range(4000)]
    random.Random(1).shuffle(words)
    rows = [(k, " ".join(words[k::40]), "en", "s", 0) for k in range(40)]
    found = token_counts.frequent(frame(spark, rows).repartition(35), PIECES, 16)
    assert b" hot" in found and len(found) <= 16


def test_length_table_is_exact():
    name = lambda k: "w" + "".join("abcdefghij"[int(d)] for d in str(k))
    words = [f" {name(k)}".encode() for k in range(3000)] + [b"x" * 16, b"x" * 15, b"\x00", b"\x00\x00"]
    packed = token_counts.LengthTable.compile(words, [k % 200 for k in range(len(words))])
    table = token_counts.LengthTable(packed)
    model = token_counts.Model(PIECES)
    cuts = token_counts.Cuts(pa.array([f"{name(7)} {name(2999)} unseen {name(30001)}", "", name(7)]), model.alone)
    held = dict(zip(words, range(len(words))))
    want = [held.get(cuts.word(i), -200) % 200 if cuts.word(i) in held else -1 for i in range(len(cuts.at))]
    assert table.find(cuts).tolist() == want and -1 in want and max(want) > 0


def test_counting_forgets_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "HELD", 5)
    counting = token_counts.Counting(PIECES, token_counts.LengthTable.compile([], []))
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = [f"one{k} two{k} " + "three" * 20 + f" four{k}" for k in range(30)]
    for at in range(0, 30, 4):
        part = texts[at : at + 4]
        assert counting.tokens(pa.array(part)).tolist() == [len(x) for x in library.encode(part)]
    assert all(len(w) <= token_counts.HELD_BYTES for w in counting.held)


# --- 13


def turn_rows(seed=0, n=260):
    rng, rows = random.Random(seed), []
    words = ["a", "b", "longer", "", "é漢"]
    for c in [*range(0, n, 2), -7, -100, -201, 10**12, 10**12 + 3, 10_001]:
        if rng.random() < 0.15:
            continue
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, None if rng.random() < 0.05 and turn == 0 else turn, rng.choice(["user", "assistant", None]), rng.choice([*words, None])))
    rows += [(300 + k, t, "user", "copy") for k in range(80) for t in range(6)]
    rows += [(7001, t, "user", f"turn {t % 7}") for t in range(300)] + [(7002, t, "user", f"turn {t % 7}") for t in range(299)]
    rows += [(None, 1, "user", "nobody"), (9, 3, "user", "same"), (9, 3, "user", "same"), (9, 3, "user", "same")]
    return rows


def brute_trie(rows):
    """Turns of one number are equal rows here: by the contract they have no order but that of their digests."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = Counter()
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out[min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def trie(spark, rows, **more):
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS depth", "'x' AS f1", "0 AS place").repartition(3)
    return Counter(tuple(r) for r in conversation_trie.prefix_trie(df, **more).collect())


@pytest.mark.parametrize("least,block,depths", [(256, 4096, 1 << 16), (1, 16, 50)])
def test_trie_equals_brute_force(spark, monkeypatch, least, block, depths):
    monkeypatch.setattr(conversation_trie, "BLOCK", block)
    monkeypatch.setattr(conversation_trie, "CROWN_DEPTHS", depths)
    monkeypatch.setattr(conversation_trie, "CHUNK", 50)
    rows = turn_rows()
    assert trie(spark, rows, least_crown=least) == brute_trie(rows)


def test_trie_of_little(spark):
    assert trie(spark, []) == Counter()
    assert trie(spark, [(None, 1, "user", "x")]) == Counter()
    # crc32("1") % 6 turns come from conversation 0, which has none: no turn is left
    assert zlib.crc32(b"1") % 6 > 0
    one = trie(spark, [(1, 0, "user", "x")])
    assert one == Counter({(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest()): 1})


def test_minimal_hash_is_minimal_and_verified():
    rng = np.random.default_rng(1)
    one, two = (rng.integers(-(2**63), 2**63 - 1, 5000) for _ in range(2))
    hashed = conversation_trie.MinimalHash(one, two)
    assert sorted(hashed.slots) == list(range(5000))
    assert (hashed.find(one, two) == hashed.slots).all() and (hashed.find(two, one) == -1).all()
    assert len(conversation_trie.MinimalHash(one[:0], two[:0]).find(one, two)) == 5000
    with pytest.raises(ValueError):
        conversation_trie.MinimalHash(np.array([1, 1]), np.array([2, 2]))
