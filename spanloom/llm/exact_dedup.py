"""Exact dedup of normalised texts with cuckoo-filter indexes, one per digest shard.

Texts are equal when they are identical after each run of white space (space, tab to carriage
return) becomes one space. The digest is SHA-256 of that text. An index is a cuckoo filter (four
places a bucket, 16-bit marks, two buckets a digest) with the live digests in their home buckets:
no mark means a new digest, a mark is verified against the bucket's content, a full filter is made
twice as large from the stored digests. Each task of the scan first merges its own rows in an index
(so copies that hold a third of all rows leave each task once), then a digest's entries meet in the
index of its shard.

Defined cases: null texts count as empty and are equal to each other; null ids never win over other
ids; of rows equal in id and text one stays; empty tables give empty results.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import KEYS, SPACE, content_keys, read_texts, with_keys

SLOTS = 4
#: Moves before the filter counts as full.
KICKS = 200
#: Digests that a scanning task holds before it hands them on.
FLUSH = 200_000


class CuckooIndex:
    """Live digests (bytes of at least 12) with a payload each."""

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._make(buckets)
        self.content: dict[int, list[list]] = {}
        self.size = 0

    def _make(self, buckets: int) -> None:
        self.buckets = buckets  # a power of two
        self.marks = bytearray(2 * SLOTS * buckets)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        home, mark = struct.unpack_from("<QH", digest)
        mark = mark or 1
        home &= self.buckets - 1
        return mark, home, self._other(home, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _slots(self, bucket: int) -> tuple[int, ...]:
        return struct.unpack_from(f"<{SLOTS}H", self.marks, 2 * SLOTS * bucket)

    def _put(self, bucket: int, slot: int, mark: int) -> None:
        struct.pack_into("<H", self.marks, 2 * (SLOTS * bucket + slot), mark)

    def _hit(self, digest: bytes) -> bool:
        mark, home, other = self._places(digest)
        return mark in self._slots(home) or mark in self._slots(other)

    def _mark(self, digest: bytes) -> bool:
        mark, home, other = self._places(digest)
        for bucket in (home, other):
            slots = self._slots(bucket)
            if 0 in slots:
                self._put(bucket, slots.index(0), mark)
                return True
        bucket = other
        for kick in range(KICKS):
            slot = (kick + mark) % SLOTS
            moved = self._slots(bucket)[slot]
            self._put(bucket, slot, mark)
            mark, bucket = moved, self._other(bucket, moved)
            slots = self._slots(bucket)
            if 0 in slots:
                self._put(bucket, slots.index(0), mark)
                return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled anew from the stored digests."""
        entries = [e for bucket in self.content.values() for e in bucket]
        buckets = self.buckets
        while True:
            buckets *= 2
            self.resizes += 1
            self._make(buckets)
            if all(self._mark(e[0]) for e in entries):
                break
        self.content = {}
        for e in entries:
            self.content.setdefault(self._places(e[0])[1], []).append(e)

    def get(self, digest: bytes) -> list | None:
        """The entry ``[digest, *payload]`` of a live digest."""
        if not self._hit(digest):
            return None
        home = self._places(digest)[1]
        return next((e for e in self.content.get(home, ()) if e[0] == digest), None)

    def insert(self, entry: list) -> None:
        """Add an entry whose digest is not live yet."""
        self.content.setdefault(self._places(entry[0])[1], []).append(entry)
        self.size += 1
        if not self._mark(entry[0]):
            self._grow()

    def delete(self, digest: bytes) -> bool:
        """Take a live digest out; False if it isn't live."""
        if self.get(digest) is None:
            return False
        mark, home, other = self._places(digest)
        bucket = home if mark in self._slots(home) else other
        self._put(bucket, self._slots(bucket).index(mark), 0)
        self.content[home] = [e for e in self.content[home] if e[0] != digest]
        self.size -= 1
        return True

    def __iter__(self) -> Iterator[list]:
        return (e for bucket in self.content.values() for e in bucket)


_ENTRY = "digest binary, keep_id long, keep_row long, n long"


def _merged(rows: DataFrame, flush: bool) -> DataFrame:
    """``digest, keep_id, keep_row, n`` of rows of the same form, merged by one index in each task."""

    def out(index: CuckooIndex) -> pa.RecordBatch:
        columns = list(zip(*index)) or [[], [], [], []]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "keep_id", "keep_row", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, doc_id, row, n in zip(*(c.to_pylist() for c in batch.columns)):
                entry = index.get(digest)
                if entry is None:
                    index.insert([digest, doc_id, row, n])
                else:
                    if (doc_id is None, doc_id, row) < (entry[1] is None, entry[1], entry[2]):
                        entry[1:3] = doc_id, row
                    entry[3] += n
            if flush and index.size >= FLUSH:
                yield out(index)
                index = CuckooIndex()
        yield out(index)

    return rows.mapInArrow(run, _ENTRY)


def normalised(text: str = "text"):
    return F.regexp_replace(text, SPACE, " ")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slim rows (written once, so a row's number holds) and one entry for each digest."""
    read = read_texts(docs)
    rows = read.select(
        "doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"), *content_keys(), F.monotonically_increasing_id().alias("row")
    )
    rows = cut(rows, "digests")
    local = _merged(rows.select("digest", "doc_id", "row", F.lit(1).cast("long").alias("n")), flush=True)
    return rows, _merged(local.repartition("digest"), flush=False)


def dedup_map(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows, groups = _groups(docs)
    return rows.join(groups, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay."""
    rows, groups = _groups(docs)
    stay = rows.join(groups.select(F.col("keep_row").alias("row")), "row", "left_semi").select(*KEYS)
    joined = with_keys(docs).join(stay, KEYS, "left_semi")
    return joined.dropDuplicates(KEYS).drop(*KEYS)


def live_index(docs: DataFrame) -> DataFrame:
    """``digest, keep_id, n`` of all texts: the stored form of the index."""
    return _groups(docs)[1].select("digest", "keep_id", "n")


def update_index(index: DataFrame, inserted: DataFrame, deleted: DataFrame) -> DataFrame:
    """The index after documents left and others came; deletions happen first.

    A digest stays live while any of its documents does. Its ``keep_id`` is that of the document
    that stood for it last, also if that one is deleted while others stay. Deleting a text that is
    not live changes nothing.
    """

    def changes(docs: DataFrame, step: int) -> DataFrame:
        read = read_texts(docs).select(F.unhex(F.sha2(normalised(), 256)).alias("digest"), "doc_id")
        return read.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")).withColumn("step", F.lit(step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live = CuckooIndex()
        for batch in batches:
            for digest, keep_id, n, step in zip(*(c.to_pylist() for c in batch.columns)):
                entry = live.get(digest)
                if step == 1:
                    if entry is not None and entry[2] > n:
                        entry[2] -= n
                    else:
                        live.delete(digest)
                elif entry is None:
                    live.insert([digest, keep_id, n])
                else:
                    if entry[1] is None or (keep_id is not None and keep_id < entry[1]):
                        entry[1] = keep_id
                    entry[2] += n
        columns = list(zip(*live)) or [[], [], []]
        kinds = (pa.binary(), pa.int64(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "keep_id", "n"])

    steps = index.select("digest", "keep_id", "n", F.lit(0).alias("step")).unionByName(changes(deleted, 1)).unionByName(changes(inserted, 2))
    return steps.repartition("digest").sortWithinPartitions("step").mapInArrow(run, "digest binary, keep_id long, n long")
