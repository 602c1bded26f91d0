"""Pairs of divided buckets: the filter leaves out no pair that can be a link."""

import random

import numpy as np

from spanloom.llm import near_dedup

from .helpers import prose


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.4 and out:
            out[at % len(out)] = f"e{rng.randrange(10**6)}"
        elif kind < 0.7:
            out.insert(at, f"i{rng.randrange(10**6)}")
        elif len(out) > 1:
            del out[at % len(out)]
    return out


def texts():
    rng = random.Random(4)
    passage = prose(rng, 60).split()
    out = [[], ["one"], ["one", "two"]]
    for _ in range(14):
        base = prose(rng, rng.choice([5, 8, 20, 60, 200])).split()
        for k in range(5):
            out.append(edited(rng, base, rng.choice([0, 1, 1, 2, 4, len(base) // 25])))
            out.append(prose(rng, rng.choice([1, 4, 9, 14, 16, 40])).split() + passage)  # mostly the passage
        out.append(base + edited(rng, base, 2)[: len(base) // 5])
    return list({" ".join(t): t for t in out}.values())


def test_no_pair_of_a_shared_bucket_is_lost(spark):
    found, hashes = texts(), near_dedup.WordHashes()
    packed = [hashes.of([w.encode() for w in t]).astype(np.uint32) for t in found]
    words = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(packed)], "node long, words binary").repartition(3)
    rng = random.Random(5)
    rows = [(i, rng.randrange(40), [rng.choice([1, 1, 1, 2])]) for i in range(len(found))]
    divided = spark.createDataFrame(rows, "node long, label long, buckets array<long>")
    got = [tuple(r) for r in near_dedup._candidates(divided, words).collect()]
    assert len(got) == len(set(got))
    could, links = 0, set()
    for i, _, of_i in rows:
        for j in range(i + 1, len(rows)):
            if rows[j][1] != rows[i][1] and set(of_i) & set(rows[j][2]):
                could += 1
                if len(packed[i]) and len(packed[j]) and near_dedup.similarity(*(packed[x].astype(np.uint64) for x in (i, j)))[0] >= near_dedup.LEAST:
                    links.add((i, j))
    assert links <= set(got) and len(links) > 60
    assert len(got) < could / 4


def test_hubs_of_one_passage_make_no_pairs(spark):
    """Texts that share a passage and are otherwise their own: a bucket of them stays divided at no cost."""
    rng = random.Random(6)
    passage = prose(rng, 50).split()
    found = [[f"w{rng.randrange(10**6)}" for _ in range(16)] + passage for _ in range(200)]
    hashes = near_dedup.WordHashes()
    rows = [(i, bytearray(hashes.of([w.encode() for w in t]).astype(np.uint32).tobytes())) for i, t in enumerate(found)]
    words = spark.createDataFrame(rows, "node long, words binary")
    divided = spark.createDataFrame([(i, i, [7]) for i in range(200)], "node long, label long, buckets array<long>")
    assert near_dedup._candidates(divided, words).count() == 0
