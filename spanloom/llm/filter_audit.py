"""Interaction audit of a chain of filters by contingency tensors.

Every document fails or passes each filter whatever the order, so what a part of the corpus loses
at any step of any order follows from its counts by failure pattern: a tensor of shape 2x2x2x2x2, one
axis a filter, index 0 pass and 1 fail. Three such tensors a part (all documents, good ones, toxic
ones) are contracted with a selector for each axis: pass for the filters applied before, fail or
pass for the one applied, all for the others. Documents are read once; what is shuffled are digests
of 32 bytes and then at most 32 counts a part and task.

Filters (words are maximal runs of anything but space and tab to carriage return):
A under 50 words; B distinct words under 65 % of the words; C capitals A-Z over 5 % of the code
points; D any of ``#$%&*|``; E the text of a smaller id, anywhere in the table, is identical.

Defined cases: null texts are empty and equal to each other; a null source is the part ``''``; a
null id is smaller than no id and no id is smaller than it, so such a row passes E, as do repeated
rows of the least id; an id is good or toxic if any of its labels says so; labels without an id are
left out; parts are the sources that have documents; an empty table has none. An empty text fails A only
(and E where it is repeated).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import SPACE

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Parts whose rows a task makes at a time; 600 rows each.
PARTS_AT_ONCE = 32
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PASS, _FAIL, _ALL = (1, 0), (0, 1), (1, 1)


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D, as booleans named after them."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    return [
        (F.size(words) < 50).alias("A"),
        (100 * F.size(F.array_distinct(words)) < 65 * F.size(words)).alias("B"),
        (100 * capitals.cast("long") > 5 * F.length(text).cast("long")).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
    ]


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, A, B, C, D, E`` of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        text.alias("text"),
    )
    scanned = cut(read.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *text_failures(F.col("text"))), "failures")
    # only texts of several ids matter to E; a group of copies reaches the shuffle once a task
    first = scanned.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    first = cut(first, "copied")  # both sides of the joins are shuffled anew, so that Spark can split a group of copies
    # joined on both, so that the copies of one text are spread by their ids
    lowest = first.select(F.col("digest").alias("_d"), F.col("least").alias("_i"), F.lit(True).alias("_lowest"))
    copied = first.select("digest", F.lit(True).alias("_copied"))
    marked = scanned.join(copied, "digest", "left")
    return marked.join(lowest, (F.col("digest") == F.col("_d")) & (F.col("doc_id") == F.col("_i")), "left").select(
        "doc_id",
        "part",
        *FILTERS[:4],
        (F.col("_copied").isNotNull() & F.col("_lowest").isNull() & F.col("doc_id").isNotNull()).alias("E"),
    )


def tensors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cells``: at most 32 structs ``(cell, n, n_good, n_toxic)`` a part.

    ``cell`` has one bit a filter, A the highest, set for failing documents.
    """
    rated = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"),
        )
    )
    cell = sum((F.col(f).cast("int") * F.lit(1 << (4 - i)) for i, f in enumerate(FILTERS)), F.lit(0))
    counts = (
        failures(docs)
        .select("doc_id", "part", cell.alias("cell"))
        .join(rated, "doc_id", "left")
        .groupBy("part", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("n_good"), F.sum("toxic").alias("n_toxic"))
    )
    zero = F.lit(0).cast("long")
    counted = F.struct("cell", "n", F.coalesce("n_good", zero).alias("n_good"), F.coalesce("n_toxic", zero).alias("n_toxic"))
    return counts.groupBy("part").agg(F.collect_list(counted).alias("cells"))


def selectors() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Selectors ``(600, 5, 2)`` of the documents kept after a step, removed in it, failing its filter and failing only it.

    Rows go by order, then step; the second axis is the filter.
    """
    kept, removed, failing, alone = [], [], [], []
    for order in ORDERS:
        for step, now in enumerate(order):
            before = set(order[:step])
            kept.append([_PASS if f in before or f == now else _ALL for f in FILTERS])
            removed.append([_FAIL if f == now else _PASS if f in before else _ALL for f in FILTERS])
            failing.append([_FAIL if f == now else _ALL for f in FILTERS])
            alone.append([_FAIL if f == now else _PASS for f in FILTERS])
    return tuple(np.array(x, np.int64) for x in (kept, removed, failing, alone))  # type: ignore[return-value]


def contract(tensor: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``(parts, rows)`` sums of ``tensor`` ``(parts, 2, 2, 2, 2, 2)`` under ``chosen`` ``(rows, 5, 2)``; exact integers."""
    out = np.einsum("pabcde,re->prabcd", tensor, chosen[:, 4])
    for axes, axis in (("prabcd,rd->prabc", 3), ("prabc,rc->prab", 2), ("prab,rb->pra", 1), ("pra,ra->pr", 0)):
        out = np.einsum(axes, out, chosen[:, axis])
    return out


def audit_steps(counts: np.ndarray) -> dict[str, np.ndarray]:
    """All measures ``(parts, 600)`` from ``counts`` ``(parts, 3, 2, 2, 2, 2, 2)``: all, good and toxic documents."""
    kept, removed, failing, alone = selectors()
    every, good, toxic = (counts[:, k] for k in range(3))
    lost = contract(every, removed)
    # by filter: removed at its step, over all orders
    filters = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    total = np.stack([lost[:, filters == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
    return {
        "kept": contract(every, kept),
        "removed": lost,
        "redundant": contract(every, failing) - lost,
        "unique_fails": contract(every, alone),
        "good_lost": contract(good, removed),
        "toxic_lost": contract(toxic, removed),
        "shapley": total[:, filters],
    }


MEASURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """600 rows a part: ``part, filter_order, step`` and the counts of MEASURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [order for order in ORDERS for _ in FILTERS]
        steps = list(range(1, len(FILTERS) + 1)) * len(ORDERS)
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                piece = batch.slice(at, PARTS_AT_ONCE)
                parts, counts = piece.column(0).to_pylist(), np.zeros((piece.num_rows, 3, 2 ** len(FILTERS)), np.int64)
                for row, cells in enumerate(piece.column(1).to_pylist()):
                    for c in cells:
                        counts[row, :, c["cell"]] += (c["n"], c["n_good"], c["n_toxic"])
                found = audit_steps(counts.reshape(len(parts), 3, *[2] * len(FILTERS)))
                columns = [
                    pa.array([p for p in parts for _ in orders], pa.string()),
                    pa.array(orders * len(parts), pa.string()),
                    pa.array(steps * len(parts), pa.int32()),
                    *[pa.array(found[m].reshape(-1), pa.int64()) for m in MEASURES],
                ]
                yield pa.record_batch(columns, ["part", "filter_order", "step", *MEASURES])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    return tensors(docs, labels).mapInArrow(run, schema)
