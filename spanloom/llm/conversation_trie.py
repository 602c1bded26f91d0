"""Prefix trie of conversations as minimal-perfect-hash node tables.

A prefix has a digest of 128 bits: the exclusive or of a hash of each turn with its place, so it is
worked out as a running value over blocks of turns, whatever a conversation's length. Equal digests are one
node. Heavy nodes, whose members have more than a limit of turns below them, form the crown: as the limit is
the root of all turns, there are at most that many on each depth. What hangs below the crown falls
into units of at most that many turns; a task takes the units of its partition as one shard. In a
shard a minimal perfect hash gives every digest a slot of flat arrays, a look-up compares the
digest stored in the slot (so a digest from elsewhere finds none), counts are scattered to the slots, and
children are added to their parents' slots from the deepest depth upwards. Totals of the units then
go into the crown, which is one more shard (one for each CROWN_DEPTHS depths of very long conversations).

Rebuilding: conversation c starts with the first h turns of conversation c - c % 100 (of what it has), then
goes on with its own turns after its first h; h is crc32 of c in decimal, mod 6.

Defined cases: turns go by ``turn``, nulls first, turns of one number by their digests; repeated rows are
turns of their own; null role or text is empty; rows without ``conv_id`` belong to no conversation and are
left out; a conversation whose rebuilt form has no turn is a member of the root and ends there; the
root's last text has no code points; ``%`` takes the sign of the id, as SQL does; an empty table has no node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranked import numbered
from ..session import cut

MOST_SHARED = 5
#: Turns of a conversation whose digests are worked out in one group.
BLOCK = 4096
#: Least turns below a crown node.
LEAST_CROWN = 256
#: Depths of the crown that make one shard.
CROWN_DEPTHS = 1 << 16
#: Characters of ids that one row of an ends list holds.
CHUNK = 1 << 15
_NODE = ["f1", "f2"]
_PARENT = ["p1", "p2"]


class MinimalHash:
    """Slots 0 .. n - 1 for n distinct digests of two 64-bit words.

    A digest that is alone at its place of a level has its bit there; the others go to the next level.
    The slot is the number of bits before. ``find`` compares the stored digest, -1 is none.
    """

    def __init__(self, one: np.ndarray, two: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        left, base = np.arange(len(one)), 0
        slots = np.empty(len(one), np.int64)
        while len(left):
            if len(self.levels) == 64:
                raise ValueError("digests repeat")
            width = len(left) + len(left) // 2 + 1
            place = self._place(one[left], two[left], len(self.levels), width)
            bits = np.bincount(place, minlength=width) == 1
            rank = np.cumsum(bits) + (base - 1)
            alone = bits[place]
            slots[left[alone]] = rank[place[alone]]
            base += int(bits.sum())
            left = left[~alone]
            self.levels.append((bits, rank))
        self.slots = slots
        self.one, self.two = np.empty_like(one), np.empty_like(two)
        self.one[slots], self.two[slots] = one, two

    @staticmethod
    def _place(one: np.ndarray, two: np.ndarray, level: int, width: int) -> np.ndarray:
        x = (one.view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32)) ^ two.view(np.uint64)) * np.uint64(0xA0761D6478BD642F)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(width)).astype(np.int64)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, left = np.full(len(one), -1, np.int64), np.arange(len(one))
        for level, (bits, rank) in enumerate(self.levels):
            place = self._place(one[left], two[left], level, len(bits))
            out[left[bits[place]]] = rank[place[bits[place]]]
            left = left[~bits[place]]
        hit = out >= 0
        hit[hit] = (self.one[out[hit]] == one[hit]) & (self.two[out[hit]] == two[hit])
        return np.where(hit, out, -1)


def prefixes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth, n_turns, f1, f2, p1, p2, chars`` and conversations ``conv_id, n_turns``.

    ``f`` is the digest of the first ``depth`` turns, ``p`` of those before the last of them.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    slim = turns.select(
        "conv_id",
        "turn",
        F.xxhash64("role", "text").alias("k1"),
        F.xxhash64(F.lit(1), "text", F.length("role"), "role").alias("k2"),
        F.length("text").cast("long").alias("chars"),
    )
    placed = cut(numbered(slim, ["conv_id"], ["turn", "k1", "k2"]).drop("turn"), "turns")
    own = placed.groupBy("conv_id").agg(F.max("place").alias("n_own"))
    shared = F.crc32(F.col("conv_id").cast("string")) % 6
    heads = placed.where(F.col("place") <= MOST_SHARED)
    given = heads.groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("n_base"))
    based = own.select("conv_id", "n_own", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    lead = F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))
    convs = based.join(given, "base", "left").select("conv_id", "base", "h", lead.alias("lead"), (lead + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = cut(convs, "conversations")
    opening = convs.join(heads.withColumnRenamed("conv_id", "base"), "base").where(F.col("place") <= F.col("lead"))
    going_on = placed.where(F.col("place") > shared).join(convs.select("conv_id", "h", "lead", "n_turns"), "conv_id")
    keys = ["k1", "k2", "chars"]
    rows = opening.select("conv_id", F.col("place").alias("depth"), "n_turns", *keys).unionByName(
        going_on.select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("depth"), "n_turns", *keys)
    )
    block = F.floor((F.col("depth") - 1) / BLOCK)
    marked = rows.select(
        "conv_id", "depth", "n_turns", "chars", block.alias("block"),
        F.xxhash64("k1", "k2", "depth").alias("g1"), F.xxhash64(F.lit(7), "k2", "depth", "k1").alias("g2"),
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations longer than a block have anything to carry on
    blocks = marked.where(F.col("n_turns") > BLOCK).groupBy("conv_id", "block").agg(*[F.bit_xor(g).alias(g) for g in ("g1", "g2")])
    carried = blocks.select("conv_id", "block", *[F.bit_xor(g).over(before).alias(f"c{g[1]}") for g in ("g1", "g2")]).where("block > 0")
    local = marked.select("*", *[F.bit_xor(g).over(inside).alias(f"x{g[1]}") for g in ("g1", "g2")]).join(carried, ["conv_id", "block"], "left")
    digests = [F.coalesce(F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}")), f"x{i}").alias(f"f{i}") for i in (1, 2)]
    found = local.select("conv_id", "depth", "n_turns", "chars", "g1", "g2", *digests)
    parents = [F.col(f"f{i}").bitwiseXOR(F.col(f"g{i}")).alias(f"p{i}") for i in (1, 2)]
    return cut(found.select("conv_id", "depth", "n_turns", *_NODE, *parents, "chars"), "prefixes"), convs.select("conv_id", "n_turns")


_NUMBERS = ["f1", "f2", "p1", "p2", "depth", "chars", "conv_id", "n_convs", "add_children", "add_leaves", "add_saved"]
_OUT = [*_NODE, *_PARENT, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def _shard(nodes: DataFrame) -> DataFrame:
    """Each partition of ``nodes`` (columns _NUMBERS) as one shard; ``top`` marks rows whose parent lies elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not read:
            return
        one, two, p1, p2, *values = (np.concatenate(x).astype(np.int64) for x in zip(*read))
        hashed = MinimalHash(one, two)
        flat = [np.empty_like(v) for v in (p1, p2, *values)]
        for to, v in zip(flat, (p1, p2, *values)):
            to[hashed.slots] = v
        p1, p2, depth, chars, conv, n, children, leaves, saved = flat
        # the root is its own parent's digest (no turn); it has none
        parent = np.where(depth > 0, hashed.find(p1, p2), -1)
        inner = np.flatnonzero(parent >= 0)
        np.add.at(children, parent[inner], 1)
        leaves += children == 0
        saved += (n - 1) * chars
        deepest = inner[np.argsort(-depth[inner], kind="stable")]
        for level in np.split(deepest, np.flatnonzero(np.diff(depth[deepest])) + 1):
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(saved, parent[level], saved[level])
        above = np.where(parent >= 0, conv[parent], 0)
        columns = [hashed.one, hashed.two, p1, p2, conv, depth, pa.array(above, pa.int64(), mask=parent < 0), n, children, leaves, saved]
        for at in range(0, len(conv), 10_000):
            part = [pa.array(c[at : at + 10_000]) if isinstance(c, np.ndarray) else c.slice(at, 10_000) for c in columns]
            yield pa.record_batch([*part, pa.array((parent < 0)[at : at + 10_000])], [*_OUT, "top"])

    return nodes.select(*_NUMBERS).mapInArrow(run, ", ".join(f"{c} long" for c in _OUT) + ", top boolean")


def _totals(tops: DataFrame) -> DataFrame:
    """What the parents elsewhere get: a row for each, reduced in each task first."""
    return tops.groupBy(*_PARENT).agg(F.count(F.lit(1)).alias("add_children"), F.sum("n_leaves").alias("add_leaves"), F.sum("saved_tokens").alias("add_saved"))


def _ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """``f1, f2, ends_sha256`` of every node where a conversation ends.

    The ids are dealt out in ranges and joined to texts there; what is left of a group of copies of any
    size is a few long rows, hashed one after the other.
    """
    nothing = F.lit(0).cast("long")
    ended = rows.where("depth = n_turns").select(*_NODE, "conv_id").unionByName(
        convs.where("n_turns = 0").select(nothing.alias("f1"), nothing.alias("f2"), "conv_id")
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        node, ids, size = None, [], 0

        def close() -> None:
            nonlocal ids, size, number
            if ids:
                held.append((*node, part, number, ",".join(ids)))
                number += 1
                ids, size = [], 0

        for batch in batches:
            for one, two, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (one, two) != node or size >= CHUNK:
                    close()
                    node = (one, two)
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            yield _rows(held, "f1 f2 part number ids")
            held = []
        close()
        yield _rows(held, "f1 f2 part number ids")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        for batch in batches:
            done = []
            for one, two, _, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if (one, two) != node:
                    if node:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (one, two), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield _rows(done, "f1 f2 ends_sha256")
        if node:
            yield _rows([(*node, sha.hexdigest())], "f1 f2 ends_sha256")

    sorted_ids = ended.repartitionByRange(*_NODE, "conv_id").sortWithinPartitions(*_NODE, "conv_id")
    listed = sorted_ids.mapInArrow(chunks, "f1 long, f2 long, part long, number long, ids string")
    return listed.repartition(*_NODE).sortWithinPartitions(*_NODE, "part", "number").mapInArrow(digests, "f1 long, f2 long, ends_sha256 string")


def _rows(rows: list[tuple], names: str) -> pa.RecordBatch:
    """A batch of long columns, the last a string."""
    columns = list(zip(*rows)) or [[]] * len(names.split())
    kinds = [pa.int64()] * (len(columns) - 1) + [pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names.split())


def prefix_trie(conversations: DataFrame, least_crown: int = LEAST_CROWN) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows, convs = prefixes(conversations)
    limit = max(least_crown, math.isqrt(rows.count()))
    below = F.col("n_turns") - F.col("depth")
    crown = rows.groupBy("depth", *_NODE).agg(F.sum(below).alias("below")).where(F.col("below") > limit)
    crown = cut(crown.select("depth", *_NODE, F.lit(True).alias("heavy")), "crown")
    marked = rows.join(crown, ["depth", *_NODE], "left")
    light = marked.where("heavy IS NULL")
    units = light.groupBy("conv_id").agg(F.min(F.struct("depth", *_NODE)).alias("unit")).select("conv_id", F.col("unit.f1").alias("u1"), F.col("unit.f2").alias("u2"))
    counted = [F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")]
    no_more = [F.lit(0).cast("long").alias(c) for c in ("add_children", "add_leaves", "add_saved")]
    nodes = light.join(units, "conv_id").groupBy("depth", *_NODE, *_PARENT, "chars", "u1", "u2").agg(*counted)
    shards = cut(_shard(nodes.repartition("u1", "u2").select("*", *no_more)), "shards")

    nothing = [F.lit(0).cast("long").alias(c) for c in ("depth", *_NODE, *_PARENT, "chars")]
    root = convs.agg(*counted).where("n_convs > 0").select(*nothing, "conv_id", "n_convs")
    heavy = cut(marked.where("heavy").groupBy("depth", *_NODE, *_PARENT, "chars").agg(*counted).unionByName(root), "heavy")
    deepest = heavy.agg(F.max("depth")).collect()[0][0] or 0
    totals, done = _totals(shards.where("top")), []
    for band in reversed(range(deepest // CROWN_DEPTHS + 1)):
        here = heavy.where(F.floor(F.col("depth") / CROWN_DEPTHS) == band)
        added = totals.select(*[F.col(p).alias(f) for p, f in zip(_PARENT, _NODE)], *[F.col(c) for c in _NUMBERS[-3:]])
        fed = here.join(added, _NODE, "left").select(*_NUMBERS[:-3], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _NUMBERS[-3:]])
        # one shard: at most the root of all turns on each depth
        done.append(cut(_shard(fed.repartition(1)), "crown"))
        totals = totals.unionByName(_totals(done[-1].where("top")))

    crowned = done[0]
    for part in done[1:]:
        crowned = crowned.unionByName(part)
    owners = crowned.select(*[F.col(f).alias(p) for f, p in zip(_NODE, _PARENT)], F.col("conv_id").alias("above"))
    every = shards.unionByName(crowned)
    tops = every.where("top AND depth > 0").join(owners, _PARENT).withColumn("parent_conv_id", F.col("above")).drop("above")
    whole = every.where("NOT top OR depth = 0").unionByName(tops.select(*every.columns))
    return whole.join(_ends(rows, convs), _NODE, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
