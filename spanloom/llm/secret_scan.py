"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text, then their hashes are counted by distinct repositories and
owners over the corpus. A value that many owners share, or that stands in many repositories of
whatever owners, is a widely copied example; one that is specific to few and looks random is a live
credential. What counts as many follows from the numbers of owners and repositories (``limits``). Values
leave the scan as hashes only.

Kinds: ``assign``, ``access`` and ``hex`` are always kept. ``opaque`` (long mixed strings that no
other candidate covers) is added by the frequency: only if it looks live and is owner-specific.

Defined cases: a null text is empty; a null owner or repository counts as one of its own; repeated
rows give repeated results, and don't make a value look copied (owners are distinct); places are
code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import forget_encoders, slices
from .common import KEYS, content_keys, read_texts, with_keys

# Kinds in their order, patterns and least lengths of the scan's contract.
KINDS = ("assign", "access", "hex", "opaque")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
#: A value is a copied example if it has more than this share of all owners, or of all repositories ...
SHARE = 0.2
#: ... and more than so many owners, or repositories.
MOST_OWNERS, MOST_REPOSITORIES = 2, 4
#: Bits a character from which a value looks random, and letters and digits it needs.
LEAST_BITS, LEAST_OF_EACH = 2.8, 3
PLACEHOLDER = re.compile(r"example|changeme|placeholder|dummy|sample|your|test|xxx|1234567|abcdef", re.I)
REDACTED = "<secret>"

_SPAN = "struct<kind:int,start:int,end:int,from:int,to:int,hash:binary,random:boolean,placeholder:boolean>"


def looks_random(value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if min(digits, letters) < LEAST_OF_EACH or PLACEHOLDER.search(value):
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= LEAST_BITS


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """``kind, start, end, from, to`` of a text by start, then kind; from and to enclose the value."""
    found = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= LEAST_ASSIGN:
                found.append((0, m.start(), m.end(), m.start(2), m.end(2)))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                found.append((1, m.start(), m.end(), m.start(), m.end()))
    for m in _HEX.finditer(text):
        found.append((2, m.start(), m.end(), m.start(), m.end()))
    base = sorted((s, e) for _, s, e, _, _ in found)
    at = reach = 0
    for m in _OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and looks_random(m.group()):
            found.append((3, m.start(), m.end(), m.start(), m.end()))
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan(docs: DataFrame, owner: str = "source", repository: str = "repository") -> DataFrame:
    """``row, doc_id, owner, repository, spans`` and the content keys, written once without texts.

    A table without the repository column gets the pair of source and language in its place.
    """
    repo = F.col(repository) if repository in docs.columns else F.to_json(F.struct(owner, *[c for c in ("lang",) if c in docs.columns]))
    read = docs.select("doc_id", "text", F.col(owner).cast("string").alias("owner"), repo.cast("string").alias("repository"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        row = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("from", pa.int32()), ("to", pa.int32()), ("hash", pa.binary()), ("random", pa.bool_()), ("placeholder", pa.bool_())]))
        for batch in batches:
            for part in slices(batch):
                spans = []
                for text in part.column(0).to_pylist():
                    own = []
                    for k, start, end, low, high in candidates(text):
                        value = text[low:high]
                        own.append({"kind": k, "start": start, "end": end, "from": low, "to": high, "hash": hashlib.sha256(value.encode()).digest()[:16], "random": looks_random(value), "placeholder": bool(PLACEHOLDER.search(value))})
                    spans.append(own)
                rows = pa.array(range(row, row + part.num_rows), pa.int64())
                row += part.num_rows
                yield pa.record_batch([rows, *part.columns[1:], pa.array(spans, kind)], ["row", *part.schema.names[1:], "spans"])

    wanted = read_texts(read, "owner", "repository").select("text", "doc_id", "owner", "repository", *content_keys())
    schema = f"row long, doc_id long, owner string, repository string, {KEYS[0]} long, {KEYS[1]} long, spans array<{_SPAN}>"
    return cut(wanted.mapInArrow(run, schema), "candidates")


def ownership(scanned: DataFrame) -> DataFrame:
    """``hash, n_owners, n_repositories, n_rows``; a value of a third of all rows leaves each task once for a repository."""
    each = scanned.select("owner", "repository", F.explode("spans.hash").alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repositories"), F.sum("n").alias("n_rows")
    )


def limits(scanned: DataFrame, share: float = SHARE) -> tuple[int, int]:
    """The most owners, and the most repositories, of a value that is no copied example."""
    pairs = scanned.groupBy("owner", "repository").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("owner").agg(F.count("*").alias("repositories"))
    all_ = owners.agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories")).first()
    return max(MOST_OWNERS, int(share * all_.owners)), max(MOST_REPOSITORIES, int(share * (all_.repositories or 0)))


def classified(scanned: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per span: ``row, span, label, n_owners, n_repositories``; labels are ``live``, ``example`` and ``weak``."""
    spans = scanned.select("row", F.explode("spans").alias("span")).withColumn("hash", F.col("span.hash"))
    most_owners, most_repositories = limits(scanned, share)
    copied = (F.col("n_owners") > most_owners) | (F.col("n_repositories") > most_repositories)
    label = F.when(copied, "example").when(F.col("span.random"), "live").otherwise("weak")
    return spans.join(ownership(scanned), "hash").select("row", "span", label.alias("label"), "n_owners", "n_repositories")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame, owner: str = "source", repository: str = "repository", share: float = SHARE) -> DataFrame:
    """One row per document: counts and spans, how many are live, examples or weak, and the most owners and
    repositories that one of its values has (0 without any)."""
    scanned = scan(docs, owner, repository)
    labels = classified(scanned, share)
    per_row = labels.groupBy("row").agg(
        *[F.count_if(F.col("label") == name).alias(f"n_{name}") for name in ("live", "example", "weak")],
        F.max("n_owners").alias("n_owners"),
        F.max("n_repositories").alias("n_repositories"),
        F.collect_set(F.when((F.col("span.kind") == 3) & (F.col("label") != "live"), F.col("span.start"))).alias("left_out"),
    )
    joined = scanned.join(per_row, "row", "left")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    nothing = F.array().cast("array<int>")
    stay = F.filter("spans", lambda s: (s["kind"] < 3) | ~F.array_contains(F.coalesce(F.col("left_out"), nothing), s["start"]))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(stay).alias("spans"),
        *[F.coalesce(F.col(f"n_{name}"), F.lit(0).cast("long")).alias(f"n_{name}") for name in ("live", "example", "weak", "owners", "repositories")],
    )


def redact(docs: DataFrame, owner: str = "source", repository: str = "repository", share: float = SHARE) -> DataFrame:
    """``docs`` (all rows and columns) with the values of secrets replaced; ``n_chars`` follows where present.

    Examples stay, and so do weak ``hex`` runs and weak ``assign`` values that are placeholders; access
    keys and passwords need not look random.
    """
    scanned = scan(docs, owner, repository)
    weak = (F.col("label") == "weak") & ((F.col("span.kind") == 1) | ((F.col("span.kind") == 0) & ~F.col("span.placeholder")))
    live = classified(scanned, share).filter((F.col("label") == "live") | weak)
    span = F.struct(F.col("span.from").alias("from"), F.col("span.to").alias("to"))
    by_row = live.groupBy("row").agg(F.array_sort(F.collect_set(span)).alias("sp_values"))
    by_key = cut(scanned.select("row", *KEYS).join(by_row, "row").drop("row").dropDuplicates(KEYS), "live")
    # values that overlap (a token that is also a hex run) are one
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done, value):
        begin = F.greatest(value["from"], done["at"])
        gap = F.substring(F.col("text"), done["at"] + 1, begin - done["at"])
        fresh = value["from"] >= done["at"]
        return F.struct(
            F.greatest(value["to"], done["at"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, F.lit(REDACTED))).otherwise(done["out"]).alias("out"),
        )

    def finish(done):
        return F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))

    joined = with_keys(docs).join(by_key, KEYS, "left")
    text = F.when(F.col("sp_values").isNull(), F.col("text")).otherwise(F.aggregate("sp_values", start, step, finish))
    columns = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    out = joined.select(*columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out
