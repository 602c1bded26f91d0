"""Mixture-controlled packing: deficit round-robin over source queues fills every window.

Each source has a queue. In every round each queue is granted its share of one window; what a grant
leaves over in whole tokens is its deficit and is carried on. The grant up to round r is
``floor(r * window * weight / 2^16)`` tokens, so a queue's deficit at any round is known in closed
form, in every partition, without a walk through the rounds before: a token's place in the packed
stream follows from its place in its queue alone. Places in a queue come from the token counts of
whole partitions, so no text or id is shuffled. The stream is cut into windows without gaps; only
the last one is padded. A queue that has run dry grants its place to the others.

Every source has its own queue. A round deals with at most QUEUES of them: where there are more, half of the
places go to the largest sources and the others are dealt out over groups, each of which is packed by a
round-robin of its own and stands as one queue in the round above it.

Defined cases: a null or empty text is one piece with the end id; a null source is a source of its
own; documents of any length are cut where a window or grant ends; repeated rows are packed each;
an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .bpe import encoder_of, slices
from .common import read_texts, spread

#: Length of a sequence.
WINDOW = 2048
#: Id put after each document.
END_ID = 1
#: Weights are whole parts of this.
UNIT = 1 << 16
#: Queues of one round-robin.
QUEUES = 64


def queues_of(docs: DataFrame, source: str = "source") -> list[str | None]:
    """All sources, those with the most bytes first; one short row a source."""
    sizes = read_texts(docs, source).groupBy(F.col(source).cast("string")).agg(F.sum(F.octet_length("text") + 1).alias("size"))
    return [r[0] for r in sorted(sizes.collect(), key=lambda r: (-r[1], r[0] is not None, r[0] or ""))]


def weights_of(shares: list[float]) -> list[int]:
    """Whole weights of at least 1 that add up to UNIT."""
    total = sum(shares) or 1.0
    free = UNIT - len(shares)
    exact = [free * s / total for s in shares]
    weights = [1 + int(x) for x in exact]
    for i in sorted(range(len(shares)), key=lambda i: int(exact[i]) - exact[i])[: UNIT - sum(weights)]:
        weights[i] += 1
    return weights


def tokenised(docs: DataFrame, path: str, queues: list[str | None], source: str = "source", end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, queue, before, n, ids``: each row with the tokens that its queue has before it in its partition."""
    number = {s: i for i, s in enumerate(queues)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(path, library=True), TaskContext.get().partitionId()
        kind = "<u2" if max(len(encoder.vocabulary.bytes_of), end_id) < 1 << 16 else "<u4"
        so_far = [0] * len(queues)
        for batch in batches:
            for piece in slices(batch):
                queue, before, n, ids = [], [], [], []
                for text, name in zip(piece.column(1).to_pylist(), piece.column(2).to_pylist()):
                    q = number[name]
                    own = np.append(np.frombuffer(encoder.encode(text), "<u4"), end_id).astype(kind)
                    queue.append(q)
                    before.append(so_far[q])
                    n.append(len(own))
                    ids.append(own.tobytes())
                    so_far[q] += len(own)
                columns = [piece.column(0), pa.array([part] * len(n), pa.int32()), pa.array(queue, pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "part", "queue", "before", "n", "ids"])

    read = read_texts(docs, source).select("doc_id", "text", F.col(source).cast("string"))
    return read.mapInArrow(run, "doc_id long, part int, queue int, before long, n long, ids binary")


class Grants:
    """The round-robin in closed form. Totals and weights by queue."""

    def __init__(self, totals: list[int], weights: list[int], window: int):
        self.totals, self.window = np.array(totals, np.int64), window
        self.rates = np.array(weights, np.int64) * window

    def rounds(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The round that grants the token at each place: the last with a grant up to it of at most that."""
        return ((place + 1) * UNIT - 1) // self.rates[queue]

    def up_to(self, queue: np.ndarray, round_: np.ndarray) -> np.ndarray:
        return round_ * self.rates[queue] // UNIT

    def stream_place(self, queue: np.ndarray, round_: np.ndarray) -> np.ndarray:
        """Place in the stream where the queue's turn in the round begins."""
        here = np.minimum(round_[:, None] * self.rates // UNIT, self.totals)
        then = np.minimum((round_[:, None] + 1) * self.rates // UNIT, self.totals)
        turns = np.cumsum(then - here, axis=1) - (then - here)
        return here.sum(axis=1) + turns[np.arange(len(queue)), queue]


def granted_runs(queue: np.ndarray, begin: np.ndarray, n: np.ndarray, grants: Grants) -> tuple[np.ndarray, ...]:
    """Runs at ``begin .. begin + n`` of their queue, cut where grants end: row, start in it, length, place in the stream."""
    first, last = grants.rounds(queue, begin), grants.rounds(queue, begin + n - 1)
    row, round_ = spread(first, last - first + 1)
    q = queue[row]
    granted = grants.up_to(q, round_)
    start = np.maximum(begin[row], granted)
    end = np.minimum((begin + n)[row], grants.up_to(q, round_ + 1))
    place = grants.stream_place(q, round_) + start - granted
    some = end > start
    return row[some], start[some] - begin[row[some]], (end - start)[some], place[some]


def cut_at_windows(row: np.ndarray, start: np.ndarray, length: np.ndarray, place: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """The runs, cut where a window ends."""
    piece, number = spread(place // window, (place + length - 1) // window - place // window + 1)
    low = np.maximum(place[piece], number * window)
    high = np.minimum(place[piece] + length[piece], (number + 1) * window)
    return row[piece], start[piece] + low - place[piece], high - low, low


def pieces_of(queue: np.ndarray, begin: np.ndarray, n: np.ndarray, grants: Grants) -> tuple[np.ndarray, ...]:
    """Pieces of documents that lie at ``begin .. begin + n`` of their queue: row, start, length, place in the stream."""
    return cut_at_windows(*granted_runs(queue, begin, n, grants), grants.window)


class Rounds:
    """The round-robins of all sources: one, or a tree of them. Sources are numbered, the largest first."""

    def __init__(self, totals: list[int], shares: list[float], window: int, width: int = QUEUES):
        self.grants: list[Grants] = []
        self.above: list[tuple[int, int] | None] = []  # of each round-robin: the one that it is a queue of, and which queue
        self.leaf = np.zeros((len(totals), 2), np.int64)  # of each source: its round-robin and queue
        self._build(np.array(totals, np.int64), np.array(shares, float), np.arange(len(totals)), None, window, width)

    def _build(self, totals: np.ndarray, shares: np.ndarray, members: np.ndarray, above: tuple[int, int] | None, window: int, width: int) -> None:
        here = len(self.grants)
        own = members if len(members) <= width else members[: width // 2]
        rest = members[len(own) :]
        groups = [rest[k :: width // 2] for k in range(min(len(rest), width // 2))]
        self.leaf[own] = np.stack([np.full(len(own), here), np.arange(len(own))], axis=1)
        queues = [*([m] for m in own), *groups]
        self.grants.append(Grants([int(totals[q].sum()) for q in queues], weights_of([float(shares[q].sum()) for q in queues]), window))
        self.above.append(above)
        for k, group in enumerate(groups):
            self._build(totals, shares, group, (here, len(own) + k), window, width)

    def pieces(self, source: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """As ``pieces_of``, for runs of the sources' own queues."""
        node, queue = self.leaf[source].T
        row, start, length, place, done = np.arange(len(source)), np.zeros_like(n), n, begin, []
        while len(row):
            out = []
            for k in np.unique(node):
                at = np.flatnonzero(node == k)
                i, s, size, where = granted_runs(queue[at], place[at], length[at], self.grants[k])
                out.append((row[at][i], start[at][i] + s, size, where, np.full(len(i), k)))
            row, start, length, place, node = map(np.concatenate, zip(*out))
            top = node == 0  # the first one is the root
            done.append((row[top], start[top], length[top], place[top]))
            row, start, length, place, node = (x[~top] for x in (row, start, length, place, node))
            steps = np.array([self.above[k] for k in node], np.int64).reshape(-1, 2)
            node, queue = steps[:, 0], steps[:, 1]
        parts = [np.concatenate(x) for x in zip(*done)] if done else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((parts[1], parts[0]))
        return cut_at_windows(*(x[order] for x in parts), self.grants[0].window)


def pack(docs: DataFrame, path: str, mixture: dict[str, float] | None = None, source: str = "source", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue``.

    ``mixture`` gives target shares by source, of any number of sources; one that it lacks keeps its own
    share of all tokens. Without it, every source's target is its share of all tokens, so that all
    run dry together.
    """
    queues = queues_of(docs, source)
    rows = cut(tokenised(docs, path, queues, source, end_id), "tokens")
    sums = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(sums.select("part", "queue", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")), "offsets")
    totals = [0] * len(queues)
    for r in offsets.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # one row a source
        totals[r.queue] = r.n
    shares = [float(t) for t in totals]
    if mixture is not None:
        every = max(1, sum(totals))
        rest = sum(t for s, t in zip(queues, totals) if s not in mixture) / every
        listed = sum(v for s, v in mixture.items() if s in queues) or 1.0
        shares = [(1 - rest) * mixture[s] / listed if s in mixture else t / every for s, t in zip(queues, totals)]
    rounds = Rounds(totals, shares, window) if queues else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if not part.num_rows:
                    continue
                queue, begin, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
                row, start, length, place = rounds.pieces(queue, begin, n)
                ids = part.column(4)
                crc = np.zeros(len(row), np.int64)
                for i in range(part.num_rows):
                    raw = ids[i].as_py()
                    wide = memoryview(np.frombuffer(raw, f"<u{len(raw) // n[i]}").astype("<u4").tobytes())
                    for j in range(*np.searchsorted(row, [i, i + 1])):
                        crc[j] = zlib.crc32(wide[4 * start[j] : 4 * (start[j] + length[j])])
                columns = [part.column(0).take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], place // window, place % window, queue[row].astype(np.int32)))]
                yield pa.record_batch(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    placed = rows.join(offsets.select("part", "queue", "offset"), ["part", "queue"])
    placed = placed.select("doc_id", "queue", (F.col("offset") + F.col("before")).alias("begin"), "n", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")
