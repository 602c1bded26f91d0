"""Removal of repeated strings by prefix-free parsing.

A byte is removed if a string of LENGTH bytes that starts anywhere else too covers it. Places whose
rolling hash is the least of all in some window of LENGTH bytes are triggers; what triggers a
window depends on its bytes alone, so equal windows have their trigger at the same place. Triggers
cut the texts into phrases. The windows of a phrase's trigger, in blocks of equal distance to it,
are the parse's entries: each has a core (the bytes that all its windows share) and a context (the
bytes of all of them).

The suffix order is needed to a depth of LENGTH only, so ranks are classes of equal strings here:
equal contexts are one class of the parse, whose windows are all repeated; a core met once has none.
Only contexts that share a core without being equal go to the dictionary step, where the suffixes
around the core are compared. That step works core by core; a core with more than GROUP contexts is
spread over the cluster window by window.

Defined cases: texts are UTF-8 bytes, null is empty; texts shorter than LENGTH stay whole; rows that
are equal are repeats of each other; long texts are parsed in pieces with overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import slices
from .common import KEYS, content_keys, read_texts, spread, with_keys

LENGTH = 400
#: Bytes under the rolling hash.
GRAM = 32
#: Window starts of a block.
BLOCK = 192
#: Contexts of a core that one task compares.
GROUP = 2000
#: Window starts of a long text that are parsed at once.
PIECE = 1 << 20
_PLACE = (1 << 21) - 1
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        back = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.array([1] + [b] * (size - 1), np.uint64), dtype=np.uint64) for b in (_BASE, back)]
    return _POWERS[0][:n], _POWERS[1][:n]


def triggers(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Triggers of the windows of ``data`` and the first and last start that each has."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    keys = (h & np.uint64(~_PLACE & (1 << 64) - 1)) | np.arange(len(h), dtype=np.uint64)
    wide = length - GRAM + 1
    filled = np.full(-(-len(keys) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
    filled[: len(keys)] = keys
    grid = filled.reshape(-1, wide)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    least = np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts])
    owner = (least & np.uint64(_PLACE)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    last = np.concatenate([first[1:] - 1, [starts - 1]])
    return owner[first], first, last


def blocks_of(raw: bytes) -> tuple[np.ndarray, ...]:
    """``start, n, lead, core, full`` of a text's blocks; lead is how far the core lies after the first start."""
    out = []
    for begin in range(0, len(raw) - LENGTH + 1, PIECE):
        piece = raw[begin : begin + PIECE + LENGTH - 1]
        at, first, last = triggers(np.frombuffer(piece, np.uint8))
        near, far = at - last, at - first  # from a start to the trigger
        which, number = spread(near // BLOCK, far // BLOCK - near // BLOCK + 1)
        high = np.minimum(far[which], number * BLOCK + BLOCK - 1)
        low = np.maximum(near[which], number * BLOCK)
        start, core = at[which] - high, at[which] - number * BLOCK
        view, digest = memoryview(piece), xxhash.xxh3_64_intdigest
        size = LENGTH - BLOCK + 1
        cores = [digest(view[c : c + size], k) for c, k in zip(core.tolist(), number.tolist())]
        ends = (at[which] - low + LENGTH).tolist()
        fulls = [digest(view[a:b], x << 16 | y) for a, b, x, y in zip(start.tolist(), ends, low.tolist(), high.tolist())]
        out.append((start + begin, high - low + 1, core - start, *(np.array(x, np.uint64).view(np.int64) for x in (cores, fulls))))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def parse(docs: DataFrame) -> DataFrame:
    """One row per document with its blocks, written once; blocks met twice within it are kept once and marked."""
    block = [("start", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()), ("core", pa.int64()), ("full", pa.int64()), ("twice", pa.int32())]
    own = [("start", pa.int32()), ("n", pa.int32())]

    def lists(sizes: list[int], columns: list[np.ndarray], fields: list[tuple[str, pa.DataType]]) -> pa.Array:
        arrays = [pa.array(c, k) for c, (_, k) in zip(columns, fields)]
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(arrays, [n for n, _ in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch):
                found, again, sizes, more = [], [], [], []
                for text in part.column(0).to_pylist():
                    start, n, lead, core, full = blocks_of(text.encode())
                    pairs = list(zip(core.tolist(), full.tolist()))
                    twice = np.zeros(len(pairs), np.int64)
                    keep = slice(None)
                    repeated = np.zeros(0, np.int64)
                    if len(set(pairs)) < len(pairs):
                        _, first, where, count = np.unique(np.array(pairs), axis=0, return_index=True, return_inverse=True, return_counts=True)
                        twice = (count[where.ravel()] > 1).astype(np.int64)
                        repeated, keep = np.flatnonzero(twice), np.sort(first)
                    found.append([x[keep] for x in (start, n, lead, core, full, twice)])
                    again.append([start[repeated], n[repeated]])
                    sizes.append(len(found[-1][0]))
                    more.append(len(repeated))
                if part.num_rows:
                    rows = pa.array(range(row, row + part.num_rows), pa.int64())
                    row += part.num_rows
                    columns = [rows, part.column(1), part.column(2), lists(sizes, [np.concatenate(c) for c in zip(*found)], block), lists(more, [np.concatenate(c) for c in zip(*again)], own)]
                    yield pa.record_batch(columns, ["row", *KEYS, "blocks", "own"])

    schema = f"row long, {KEYS[0]} long, {KEYS[1]} long, blocks array<struct<start:int,n:int,lead:int,core:long,full:long,twice:int>>, own array<struct<start:int,n:int>>"
    return cut(read_texts(docs).select("text", *content_keys()).mapInArrow(run, schema), "parse")


_SPAN = "row long, start int, n int"


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n if not differ else n - (differ.bit_length() + 7) // 8


def repeated_in(members: list[tuple[int, int, int, int, bytes, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Runs of repeated windows among contexts around one core: ``row, start, n``.

    A member has ``row, start, lead, n`` and the bytes left and right of the core. The window that
    starts j bytes before the core needs j bytes on the left and BLOCK - 1 - j on the right.
    """
    marked = [set() for _ in members]
    span = [range(lead - n + 1, lead + 1) for _, _, lead, n, _, _ in members]
    if len(members) <= 12:
        backward = [m[4][::-1] for m in members]
        for i in range(len(members)):
            for k in range(i):
                high = min(_shared(backward[i], backward[k]), span[i][-1], span[k][-1])
                low = max(BLOCK - 1 - _shared(members[i][5], members[k][5]), span[i][0], span[k][0])
                marked[i].update(range(low, high + 1))
                marked[k].update(range(low, high + 1))
    else:
        for j in range(BLOCK):
            seen: dict[tuple[bytes, bytes], list[int]] = {}
            for i, (_, _, _, _, left, right) in enumerate(members):
                if j in span[i]:
                    seen.setdefault((left[len(left) - j :], right[: BLOCK - 1 - j]), []).append(i)
            for same in seen.values():
                if len(same) > 1:
                    for i in same:
                        marked[i].add(j)
    for (row, start, lead, _, _, _), js in zip(members, marked):
        run: list[int] = []
        for j in sorted(js, reverse=True):
            if run and run[-1] != j + 1:
                yield row, start + lead - run[0], len(run)
                run = []
            run.append(j)
        if run:
            yield row, start + lead - run[0], len(run)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of the wanted blocks; of cores with many, a row for each window."""
    names = ["core", "window", "row", "start", "lead", "n", "left", "right"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = text.encode()
            for b in wanted:
                row, start, lead, n, core = b["row"], b["start"], b["lead"], b["n"], b["core"]
                if b["many"]:
                    for s in range(start, start + n):
                        h = xxhash.xxh3_64_intdigest(raw[s : s + LENGTH], start + lead - s)
                        out.append((core, (h >> 1) + 1, row, s, 0, 1, None, None))
                else:
                    middle, end = start + lead, start + lead + LENGTH - BLOCK + 1
                    out.append((core, 0, row, start, lead, n, raw[start:middle], raw[end : end + BLOCK - 1 - (lead - n + 1)]))
            if len(out) > 20_000:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of rows in the order of core and window."""
    key, members, seen, out = None, {}, 0, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["row", "start", "n"])

    for batch in batches:
        for core, window, row, start, lead, n, left, right in zip(*(c.to_pylist() for c in batch.columns)):
            if (core, window) != key:
                if len(members) > 1 and key[1] == 0:
                    out.extend(repeated_in(list(members.values())))
                key, members, seen = (core, window), {}, 0
            if window:  # rows of one window: all are repeated if there are two
                if not members:
                    members[row, start] = (row, start, 1)
                elif (row, start) not in members:
                    if not seen:
                        out.extend(members.values())
                    seen = 1
                    out.append((row, start, 1))
            else:
                members[row, start] = (row, start, lead, n, left, right)
        yield batch_of(out)
        out = []
    if len(members) > 1 and key[1] == 0:
        out.extend(repeated_in(list(members.values())))
    yield batch_of(out)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Repeated window starts of every document that has some: the content keys and ``spans`` (start, n)."""
    parsed = parse(docs)
    blocks = parsed.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    cores = blocks.groupBy("core").agg(
        (F.count("*") + F.sum("twice")).alias("met"), (F.min("full") == F.max("full")).alias("same")
    )
    shared = cut(blocks.join(cores.filter("met > 1").select("core", "same"), "core"), "shared")
    sure = shared.filter("same").select("row", "start", "n")
    mixed = shared.filter("not same")
    contexts = mixed.groupBy("core", "full").agg(
        (F.count("*") + F.sum("twice")).alias("met"), F.min(F.struct("row", "start", "lead", "n")).alias("one")
    )
    contexts = cut(contexts, "contexts")
    equal = contexts.filter("met > 1").select("core", "full")
    also = mixed.join(equal, ["core", "full"], "left_semi").select("row", "start", "n")
    members = contexts.groupBy("core").agg(F.count("*").alias("members"))
    wanted = contexts.select("core", "one.*").join(members, "core")
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct("row", "start", "lead", "n", "core", (F.col("members") > GROUP).alias("many"))).alias("wanted"))
    by_key = parsed.select("row", *KEYS).join(by_row, "row").select(*KEYS, "wanted")
    texts = with_keys(read_texts(docs))
    fetched = texts.join(by_key, KEYS).select("text", "wanted").mapInArrow(
        _fetch, "core long, window long, row long, start int, lead int, n int, left binary, right binary"
    )
    resolved = fetched.repartition("core", "window").sortWithinPartitions("core", "window").mapInArrow(_compare, _SPAN)
    own = parsed.select("row", F.explode("own").alias("o")).select("row", "o.start", "o.n")
    spans = sure.unionByName(also).unionByName(resolved).unionByName(own)
    by_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return parsed.select("row", *KEYS).join(by_row, "row").dropDuplicates(KEYS).select(*KEYS, "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes, end exclusive."""
    out: list[tuple[int, int]] = []
    for start, n in sorted(spans):
        end = start + n - 1 + LENGTH
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            size, removed, runs, kept, left, texts = [], [], [], [], [], []
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                raw = text.encode()
                gone = merged([(s["start"], s["n"]) for s in spans or ()])
                edges = [0, *(x for run in gone for x in run), len(raw)]
                stay = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                size.append(len(raw))
                removed.append(len(raw) - len(stay))
                runs.append(len(gone))
                kept.append(hashlib.sha256(stay).hexdigest())
                left.append(len(stay))
                texts.append(stay.decode("utf-8", "ignore"))  # a run may start or end inside a character
            numbers = [pa.array(c, pa.int64()) for c in (size, removed, runs)]
            columns = [part.column(0), *numbers, pa.array(kept, pa.string()), pa.array(left, pa.int64()), pa.array(texts, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, kept_text``, one row per input row.

    ``kept_text`` is what remains, without bytes that are no whole character any more.
    """
    joined = with_keys(read_texts(docs)).join(repeated_spans(docs), KEYS, "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, kept_text string"
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut_out, schema)
