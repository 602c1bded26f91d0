"""A small table with every awkward case, and brute-force forms of the contracts."""

import random

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "row long, spans string, kept boolean, label string, words string, bucket int, sketch string, queue int"


def prose(rng, n, words=None):
    words = words or ["the", "and", "ention", "thhahe", "oner", "été", "größe", "ñci", "42", "it's"]
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def sample(seed=0, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 90)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 0:
            text = None if i % 20 else ""
        elif kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2:
            text = prose(rng, 20) + " " + shared + " " + prose(rng, 20)
        elif kind == 3:
            words = prose(rng, 120).split()
            rows.append((1000 + i, " ".join(words), "en", "s1", 1))
            words[60] = "changed"
            text = " ".join(words)
        elif kind == 4:
            text = "ab" * rng.randrange(0, 600)
        elif kind == 5:
            text = "x \t\n y" + " " * i
        elif kind == 6:
            text = f'token = "{rng.getrandbits(160):040x}" PASSWORD:hunter2 AKIA{"Q7" * 9} <|endoftext|> 漢字'
        else:
            text = prose(rng, rng.randrange(1, 150))
        rows.append((i, text, "en", None if i % 7 == 0 else f"s{i % 4}", len(text or "")))
    rows.append((7, rows[8][1], "en", "s0", 0))
    rows += [rows[-1], (None, "no id here", None, None, None), (5000, prose(rng, 9000), "en", "s2", 0)]
    return rows


def frame(spark, rows=None, clashing=True):
    df = spark.createDataFrame(sample() if rows is None else rows, SCHEMA).repartition(3)
    if clashing:
        for part in CLASHING.split(", "):
            name, kind = part.split()
            df = df.selectExpr("*", f"cast(null as {kind}) as {name}")
    return df


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def by_id(df) -> dict:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def empty(spark):
    return frame(spark, [])


def pandas(df) -> pd.DataFrame:
    return df.toPandas()
